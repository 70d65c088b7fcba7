"""Ten failure modes from the wording of posts: evidence, metrics and severities per room.

One pass flags every post; items become events; what depends on order is a frame over a union of events (what was reported done strictly
before, what was delivered up to and including a post); what depends on the whole board is an anti join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.patterns import has, java
from colloquy.functions.text import items, redact, seqrefs, shingles
from colloquy.functions.times import epoch_ms
from colloquy.operators.board import Board, message_posts
from colloquy.operators.ordered import position, previous, running_max, running_maxima
from colloquy.session import cut

ACTS = ["accept", "hedge", "done", "review", "review_unread", "ask", "proxy", "wait", "pause", "pay", "upload", "push", "identity", "authorized"]

# Confidence of a mode, and the rates from which it is high, medium and low.
CONFIDENCE = {"R1": 0.4, "R2": 0.35, "B1": 0.55, "B2": 0.5, "D1": 0.3, "D2": 0.3, "D3": 0.6, "D4": 0.4, "REP": 0.85, "HB": 0.9}
CONFIDENCE_D1_WITH_RECORD = 0.7
THRESHOLDS = {
    "R1": (0.4, 0.2, 0.05), "R2": (0.4, 0.2, 0.05), "B1": (0.5, 0.25, 0.08), "B2": (0.05, 0.02, 0.004), "D1": (0.9, 0.5, 0.1),
    "D2": (0.5, 0.25, 0.08), "D4": (0.3, 0.1, 0.02), "REP": (0.15, 0.07, 0.02), "HB": (0.15, 0.07, 0.02),
}
BUCKETS = ["1-20", "21-40", "41-60", "61+"]
#: Posts an earlier near-duplicate may lie back, the likeness, and the least shingles for a post to be compared.
WINDOW, LIKENESS, LEAST_SHINGLES = 80, 0.6, 8
#: Places that are brought together at once.
BLOCK = 10 * WINDOW
FRESH_MS = 6 * 3600 * 1000
#: Evidence rows given out per mode; the caps on B1, D1 (without a record) and REP limit the mode's count too. Each may be None: then there is no cap.
ROWS, D1_ROWS, REP_ROWS, B1_ROWS = 25, 10, 40, 40


@dataclass(frozen=True)
class Caps:
    rows: int | None = ROWS
    d1: int | None = D1_ROWS
    rep: int | None = REP_ROWS
    b1: int | None = B1_ROWS


def _least(n: Column, cap: int | None) -> Column:
    return n if cap is None else F.least(n, F.lit(cap))


def flags(posts: DataFrame) -> DataFrame:
    """Messages between seats with a boolean per speech act, ``heartbeat`` (of the first 220 characters), ``bucket`` and ``items``."""
    p = message_posts(posts)
    return p.select("*", *(has(F.col("text"), a).alias(a) for a in ACTS), has(F.col("text"), "role").alias("role_claim"), has(F.substring("text", 1, 220), "heartbeat").alias("heartbeat"), bucket(F.col("seq")).alias("bucket"), items(F.col("text")).alias("items"))


def bucket(seq: Column) -> Column:
    return F.when(seq <= 20, "1-20").when(seq <= 40, "21-40").when(seq <= 60, "41-60").otherwise("61+")


def item_events(flagged: DataFrame) -> DataFrame:
    """One row per post and item: ``room, item, seq, who``, and what the post says of it."""
    kinds = [(F.col("accept")).alias("claims"), F.col("done"), (F.col("upload") | F.col("pay") | F.col("push")).alias("delivers"), F.col("review"), F.col("hedge")]
    return flagged.select("room", "seq", "who", "at_ms", *kinds, F.posexplode("items").alias("item_pos", "item"))


def placed(events: DataFrame) -> DataFrame:
    """The events with what was there before each: ``last_done`` (the item's last done report, with the last one before it by another author) and
    ``delivered`` (whether the item was done or delivered before or in the post). One pass over the ranges of an item serves both.
    """
    key = ["room", "item"]
    # written before the running step, which reads them twice
    d = cut(previous(events.where("done").select(*key, "seq", "who"), key, "seq", ["seq", "who"]))
    changed = F.when(F.col("prev_who") != F.col("who"), F.struct("seq", F.col("prev_seq").alias("by_seq"), F.col("prev_who").alias("by_who")))
    d = cut(running_max(d, key, "seq", changed, "alt", inclusive=True).select(*key, "seq", F.lit(True).alias("is_done"), "alt.by_seq", "alt.by_who"))
    own = F.col("done") | F.col("delivers")
    e = running_maxima(events.join(d, [*key, "seq"], "left"), key, "seq", {"last_done": F.when(F.col("is_done"), F.struct("seq", "who", "by_seq", "by_who")), "before": own}, inclusive=False)
    return e.withColumn("delivered", F.coalesce("before", F.lit(False)) | own).drop("before", "is_done", "by_seq", "by_who")


def reclaims(placed: DataFrame, first_posts: DataFrame, seats: DataFrame) -> DataFrame:
    """Claims of items that were reported done before: ``mode`` R1, or R2 in a seat's first hours after joining late.

    By another seat (the last such report is named), else by the claimant itself. Every report knows the last one before it by another
    author; a claim takes the last report before it, or, if that is its own, the one by another that this report knows.
    """
    c = placed.where("claims and last_done is not null")
    other = F.when(F.col("last_done.who") != F.col("who"), F.struct(F.col("last_done.seq").alias("seq"), F.col("last_done.who").alias("who")))
    c = c.withColumn("other", F.coalesce(other, F.when(F.col("last_done.by_seq").isNotNull(), F.struct(F.col("last_done.by_seq").alias("seq"), F.col("last_done.by_who").alias("who")))))
    joined = seats.select("room", "who", epoch_ms(F.col("joined_at")).alias("joined_ms"))
    c = c.join(joined, ["room", "who"], "left").join(first_posts.select("room", "first_ms"), "room", "left")
    fresh = F.coalesce((F.col("joined_ms") > F.col("first_ms")) & (F.col("at_ms") - F.col("joined_ms") < FRESH_MS), F.lit(False))
    return c.select("room", "item", "seq", "who", "item_pos", F.col("other.who").alias("other_who"), F.coalesce("other.seq", "last_done.seq").alias("done_seq"), F.when(F.col("other").isNotNull() & fresh, "R2").otherwise("R1").alias("mode"), F.col("other").isNull().alias("own"))


def reviews_of_nothing(flagged: DataFrame, placed: DataFrame) -> DataFrame:
    """Reviews on a description, and reviews of items of which none was delivered up to and including the post."""
    none = placed.where("review").groupBy("room", "seq").agg(F.bool_or("delivered").alias("d")).where("not d").select("room", "seq", F.lit(True).alias("nothing"))
    r = flagged.where("review").join(none, ["room", "seq"], "left")
    return r.where("review_unread or nothing").select("room", "seq", "who", F.when(F.col("review_unread"), "review given on a description, not the artifact").otherwise("review of items without a visible prior delivery").alias("why"))


def unanswered(flagged: DataFrame, last: DataFrame) -> DataFrame:
    """Asks that no post replies to or cites (wherever it stands), the last two numbers of the board apart."""
    answered = flagged.select("room", F.explode(F.array_append(seqrefs(F.col("text")), F.when(F.col("reply_to") != 0, F.col("reply_to")))).alias("seq")).where("seq is not null").distinct()
    asks = flagged.where("ask").join(last.select("room", "last_seq"), "room").where(F.col("seq") < F.col("last_seq") - 2)
    return asks.join(answered, ["room", "seq"], "left_anti").select("room", "seq", "who")


def near_duplicates(flagged: DataFrame) -> DataFrame:
    """Posts like one of the 80 comparable posts before them: ``room, seq, who, of_seq, of_who`` of the oldest such post.

    Posts are numbered by place among the comparable ones of their board and brought together by blocks of places, each with the last 80 places of the
    block before. Inside a block a post meets, by shingle, the posts at most 80 places before it that hold the shingle too, at most 80 of them.
    Only likenesses are counted, no sets are compared.
    """
    # written before they are placed, which reads them twice
    s = cut(flagged.select("room", "seq", "who", shingles(F.col("text")).alias("sh")).where(F.size("sh") >= LEAST_SHINGLES))
    s = cut(position(s, ["room"], "seq", "rank"))
    block = F.floor(F.col("rank") / BLOCK)
    blocks = F.when(F.col("rank") % BLOCK >= BLOCK - WINDOW, F.array(block, block + 1)).otherwise(F.array(block))
    # shuffled as sets; from here to the oldest like post of each all rows of a block stay in one partition
    x = s.select("room", "rank", F.size("sh").alias("n"), "sh", F.explode(blocks).alias("block")).repartition("room", "block")
    x = x.select("room", "block", "rank", "n", F.explode("sh").alias("shingle"))
    near = Window.partitionBy("room", "block", "shingle").orderBy("rank").rangeBetween(-WINDOW, -1)
    x = x.select("room", "block", "rank", "n", F.collect_list(F.struct("rank", "n")).over(near).alias("before"))
    pairs = x.where((F.floor(F.col("rank") / BLOCK) == F.col("block")) & (F.size("before") > 0)).select("room", "block", "rank", "n", F.explode("before").alias("of"))
    like = pairs.groupBy("room", "block", "rank", F.col("of.rank").alias("of_rank")).agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("of.n").alias("of_n"))
    first = like.where(F.col("both") / (F.col("n") + F.col("of_n") - F.col("both")) >= LIKENESS).groupBy("room", "block", "rank").agg(F.min("of_rank").alias("of_rank"))
    out = s.drop("sh").join(first.drop("block"), ["room", "rank"])
    return out.join(s.select("room", F.col("rank").alias("of_rank"), F.col("seq").alias("of_seq"), F.col("who").alias("of_who")), ["room", "of_rank"]).select("room", "seq", "who", "of_seq", "of_who")


def role_conflicts(flagged: DataFrame) -> DataFrame:
    """Roles that two or more seats claim, with the first post that claims each; ``authorized`` counts as a role."""
    said = flagged.where("role_claim").select("room", F.lower(F.regexp_extract("text", java("role"), 1)).alias("role_word"), "who", "seq")
    said = said.unionByName(flagged.where("authorized").select("room", F.lit("authorized").alias("role_word"), "who", "seq")).groupBy("room", "role_word", "who").agg(F.min("seq").alias("seq"))
    return said.groupBy("room", "role_word").agg(F.array_join(F.array_sort(F.collect_list("who")), ", ").alias("who"), F.min("seq").alias("first_seq"), F.count("*").alias("n")).where("n >= 2").drop("n")


def item_log(events: DataFrame) -> DataFrame:
    """What each post says of each item: ``room, item, log, seq, who, firm``; ``log`` is claims, done, reviews or uploads, ``firm`` of claims alone."""
    kinds = {"claims": F.col("claims"), "done": F.col("done"), "reviews": F.col("review"), "uploads": F.col("delivers")}
    each = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())), lambda x: x.isNotNull())
    log = events.select("room", "item", F.explode(each).alias("log"), "seq", "who", "hedge")
    return log.withColumn("firm", F.when(F.col("log") == "claims", ~F.col("hedge"))).drop("hedge")


def item_states(events: DataFrame) -> DataFrame:
    """Per room and item: first mention, counts, and the state at the end (reviewed, done, claimed, mentioned)."""
    e = events.groupBy("room", "item").agg(
        F.min("seq").alias("first_mention"), F.min(F.struct("seq", "item_pos")).alias("first_place"), F.count_if("claims").alias("claims"), F.count_if("done").alias("dones"), F.count_if("review").alias("reviews"), F.count_if("delivers").alias("uploads"),
        F.count_if(F.col("claims") & ~F.col("hedge")).alias("firm_claims"), F.min(F.when(F.col("claims"), F.struct("seq", "who"))).alias("first_claim"),
    )
    status = F.when((F.col("reviews") > 0) & (F.col("dones") > 0), "reviewed").when(F.col("dones") > 0, "done").when(F.col("firm_claims") > 0, "claimed").otherwise("mentioned")
    return e.withColumn("status_at_end", status).where("claims > 0 or dones > 0 or reviews > 0")


def severity(rate: Column, mode: str) -> Column:
    high, medium, low = THRESHOLDS[mode]
    return F.when(rate >= high, "high").when(rate >= medium, "medium").when(rate >= low, "low").otherwise("none")


class Modes:
    """The detector over a board; its parts are DataFrames and are computed once, on the flagged posts."""

    def __init__(self, board: Board, caps: Caps = Caps()) -> None:
        self.board, self.caps = board, caps
        self.flagged = cut(flags(board.posts))
        ends = self.flagged.groupBy("room").agg(F.min_by("at_ms", "seq").alias("first_ms"), F.max_by(F.struct("seq", "text", "at_ms"), "seq").alias("l"))
        self.ends = cut(ends.select("room", "first_ms", F.col("l.seq").alias("last_seq"), F.col("l.text").alias("last_text"), F.col("l.at_ms").alias("last_ms")))
        self.events = item_events(self.flagged)
        self.record = cut(board.rooms.select("room", F.col("source_kind").isin("export", "episode").alias("has_record")))
        self.seats = cut(board.seats.select("room", "who", "joined_at", "principal"))

    def claims_checked(self) -> DataFrame:
        """Upload, payment and push claims with ``verifiable``: the source has artifact rows, and for an upload the seat has one."""
        up = self.board.artifacts.select("room", "who").distinct().withColumn("has_artifact", F.lit(True))
        a = self.flagged.where("upload or pay or push").join(up, ["room", "who"], "left").join(self.record, "room", "left")
        has_record = F.coalesce("has_record", F.lit(False))
        return a.withColumn("has_record", has_record).withColumn("verifiable", has_record & (~F.col("upload") | F.coalesce("has_artifact", F.lit(False))))

    def placed(self) -> DataFrame:
        """The events of claims and reviews with what was there before them, written once."""
        if not hasattr(self, "_placed"):
            self._placed = cut(placed(self.events).where("review or (claims and last_done is not null)"))
        return self._placed

    def parts(self) -> dict[str, DataFrame]:
        """The rows that the modes count, without their texts."""
        if not hasattr(self, "_parts"):
            placed = self.placed()
            # each is written by a job of its own: one plan of all of them takes the driver too much memory, whatever the rows
            parts = {
                "reclaims": reclaims(placed, self.ends, self.seats),
                "nothing": reviews_of_nothing(self.flagged, placed),
                "unanswered": unanswered(self.flagged, self.ends),
                "near": near_duplicates(self.flagged),
                "roles": role_conflicts(self.flagged),
                "items": item_states(self.events),
                "checked": self.claims_checked().select("room", "seq", "who", "has_record", "verifiable"),
            }
            self._parts = {k: cut(d) for k, d in parts.items()}
        return self._parts

    def metrics(self) -> DataFrame:
        """One row per room with the numbers that the severities rest on."""
        p, yes = self.parts(), F.lit(True)
        buckets = lambda name: {f"{name}_{b}": bucket(F.col("seq")) == b for b in BUCKETS}
        marks = lambda *names: {n: F.col(c) for n, c in names}
        # what a row of each table counts as; one aggregation over the union of them serves all numbers
        counted = [
            (self.flagged, {"posts": yes, **marks(("asks", "ask"), ("wait_signals", "wait")), "claim_posts": F.col("accept") & (F.size("items") > 0), "done_claims": F.col("done") & (F.size("items") > 0), **marks(("reviews", "review"), ("heartbeat_posts", "heartbeat"), ("identity_posts", "identity")), "ev_D4": F.col("ask") & F.col("proxy")}),
            (self.events.where("claims"), {"claims": yes, **buckets("claims")}),
            (p["reclaims"], {"re_claims": yes, "self_contradicting_re_claims": F.col("own"), "ev_R1": F.col("mode") == "R1", "ev_R2": F.col("mode") == "R2", **buckets("re_claims")}),
            (p["checked"], {"action_claims": yes, "action_claims_unverifiable": ~F.col("verifiable")}),
            (p["items"], {"hedged_items": F.expr("claims > 0 and firm_claims = 0 and dones = 0"), "open_items_at_end": F.col("status_at_end") == "claimed"}),
            *((p[k], {name: yes}) for k, name in (("unanswered", "asks_unanswered"), ("near", "duplicate_posts"), ("nothing", "ev_D2"), ("roles", "role_conflicts"))),
        ]
        names = [n for n in dict.fromkeys(n for _, c in counted for n in c) if n not in ("identity_posts", "ev_D4")] + ["identity_posts", "ev_D4"]
        m = None
        for d, c in counted:
            d = d.select("room", *((c[n] if n in c else F.lit(None).cast("boolean")).alias(n) for n in names))
            m = d if m is None else m.unionByName(d)
        # one row per room, written before the joins with what else is known of rooms
        m = cut(m.groupBy("room").agg(*(F.count_if(n).alias(n) for n in names)))
        m = m.join(self.seats.groupBy("room").agg(F.count("*").alias("seats"), F.nullif(F.count_distinct("principal"), F.lit(0)).alias("principals")), "room", "left").fillna(0, ["seats"])
        m = m.join(self.ends, "room").join(self.record, "room", "left")
        t = F.col("last_text")
        kind = F.when(has(t, "pause"), "pause").when(has(t, "ask"), "ask").when(has(t, "heartbeat"), "heartbeat").when(has(t, "done"), "done").otherwise("other")
        span = F.when((F.col("posts") > 1), F.bround((F.col("last_ms") - F.col("first_ms")) / 3600000, 1))
        return m.withColumn("last_post_kind", kind).withColumn("span_hours", span).withColumn("heartbeat_share", F.bround(F.col("heartbeat_posts") / F.col("posts"), 3)).drop("last_ms", "first_ms")

    def _measured(self) -> DataFrame:
        """The metrics, written once."""
        if not hasattr(self, "_m"):
            self._m = cut(self.metrics().withColumn("has_record", F.coalesce("has_record", F.lit(False))))
        return self._m

    @staticmethod
    def _ends_open() -> Column:
        return (F.col("open_items_at_end") > 0) | F.col("last_post_kind").isin("ask", "heartbeat", "pause") | (F.col("wait_signals") >= F.greatest(F.lit(3), F.floor(F.col("posts") / 20)))

    def modes(self) -> DataFrame:
        """``room, mode, present, severity, count, confidence`` for all ten modes of every room."""
        m = self._measured()
        ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
        n, hb = F.col("posts"), F.col("heartbeat_posts") / F.col("posts")
        d3 = self._ends_open()
        d3_high = ((hb >= 0.15) | F.col("last_post_kind").isin("pause", "ask")) & ((F.col("open_items_at_end") > 0) | (F.col("wait_signals") >= 3))
        d1 = F.when(F.col("has_record"), F.col("action_claims_unverifiable")).otherwise(_least(F.col("action_claims_unverifiable"), self.caps.d1))
        b1 = _least(F.col("asks_unanswered"), self.caps.b1) + F.col("hedged_items")
        b2 = F.col("identity_posts") + F.col("role_conflicts")
        rows = {
            "R1": (F.col("ev_R1"), severity(ratio("ev_R1", "claims"), "R1")),
            "R2": (F.col("ev_R2"), severity(ratio("ev_R2", "claims"), "R2")),
            "B1": (b1, severity(ratio("asks_unanswered", "asks"), "B1")),
            "B2": (b2, severity(b2 / n, "B2")),
            "D1": (d1, F.when(F.col("has_record"), severity(ratio("action_claims_unverifiable", "action_claims"), "D1")).otherwise("unknown")),
            "D2": (F.col("ev_D2"), severity(ratio("ev_D2", "reviews"), "D2")),
            "D3": (d3.cast("long"), F.when(d3_high, "high").when(d3, "medium").otherwise("none")),
            "D4": (F.col("ev_D4"), severity(ratio("ev_D4", "asks"), "D4")),
            "REP": (_least(F.col("duplicate_posts"), self.caps.rep), severity(F.col("duplicate_posts") / n, "REP")),
            "HB": (F.col("heartbeat_posts"), severity(hb, "HB")),
        }
        conf = lambda k: F.when(F.col("has_record"), CONFIDENCE_D1_WITH_RECORD).otherwise(CONFIDENCE[k]) if k == "D1" else F.lit(CONFIDENCE[k])
        all_ = F.array(*(F.struct(F.lit(k).alias("mode"), (c > 0).alias("present"), s.alias("severity"), c.cast("long").alias("count"), conf(k).alias("confidence")) for k, (c, s) in rows.items()))
        return m.select("room", F.explode(all_).alias("x")).select("room", "x.*")

    def evidence(self) -> DataFrame:
        """``room, mode, n, seq, who, excerpt, why``: the rows to read, at most ``caps.rows`` a mode.

        Rows come by post, then place of the item. Of B1 the unanswered asks come before the hedged items (by first mention), of B2 the posts before the roles
        (by first claim); what a cap limits is its first rows.
        """
        caps, p = self.caps, dict(self.parts())
        # one join fetches the texts of all parts that have none
        bare = [k for k in p if k not in ("roles", "items")]
        rows = None
        for k in bare:
            d = p[k].select(F.lit(k).alias("part"), "*")
            rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
        rows = cut(rows.join(self.flagged.select("room", "seq", "text"), ["room", "seq"]))
        p |= {k: rows.where(F.col("part") == k) for k in bare}

        def row(df, mode, why, place=("seq",), seq="seq", who="who", text="text", group=0):
            # the place orders rows inside the group
            at = F.struct(F.lit(group).alias("g"), *((F.col(c) if isinstance(c, str) else c).cast("long").alias(f"p{i}") for i, c in enumerate((*place, F.lit(0))[:2])))
            lit = lambda x: F.lit(x) if isinstance(x, str) else x
            return df.select("room", lit(mode).alias("mode"), at.alias("at"), F.col(seq).cast("long").alias("seq"), F.col(who).alias("who"), redact(F.col(text)).alias("excerpt"), lit(why).alias("why"))

        def first(df, cap, keep=None):
            # a top-k: Spark keeps only the first rows of each room before the shuffle
            if cap is None:
                return df
            k = F.row_number().over(Window.partitionBy("room").orderBy("seq"))
            return df.withColumn("k", k).where((F.col("k") <= cap) | (keep if keep is not None else F.lit(False))).drop("k")

        fresh = F.when(F.col("mode") == "R2", " (first hours after joining)").otherwise("")
        again = F.when(F.col("own"), F.format_string("re-claims '%s' that it reported done itself at #%d", "item", "done_seq")).otherwise(F.concat(F.format_string("claims '%s', reported done by %s at #%d", "item", "other_who", "done_seq"), fresh))
        none = p["items"].where("claims > 0 and firm_claims = 0 and dones = 0").select("room", "first_place", F.col("first_claim.seq").alias("seq"), F.col("first_claim.who").alias("who"), F.format_string("hedged claim on '%s'", "item").alias("text"))
        ends = self._measured().where(self._ends_open()).select("room", F.col("last_seq").alias("seq"), F.lit("").alias("who"), F.col("last_text").alias("text"), F.format_string("ends with a %s; %d claimed item(s) never reported done; %d waiting/blocked signals", "last_post_kind", "open_items_at_end", "wait_signals").alias("why"))
        out = [
            row(p["reclaims"], F.col("mode"), again, ("seq", "item_pos")),
            row(first(p["unanswered"], caps.b1), "B1", "no later post replies to or cites this ask"),
            row(none, "B1", "never firmed up or delivered", ("first_place.seq", "first_place.item_pos"), group=1),
            row(self.flagged.where("identity"), "B2", "identity or seat ambiguity being negotiated on the board"),
            row(p["roles"].withColumn("seq", F.lit(0)).withColumn("text", F.lit("")), "B2", F.format_string("two or more seats claim the role '%s'", "role_word"), ("first_seq", F.when(F.col("role_word") == "authorized", 1).otherwise(0)), group=1),
            row(first(p["checked"].where("not verifiable"), caps.d1, F.col("has_record")), "D1", F.when(F.col("has_record"), "action claimed with no matching artifact row by this seat").otherwise("action claimed; this source has no artifact rows to check it against")),
            row(p["nothing"], "D2", F.col("why")),
            row(ends, "D3", F.col("why")),
            row(self.flagged.where("ask and proxy"), "D4", "asks the holder to act instead of taking the item over"),
            row(first(p["near"], caps.rep), "REP", F.format_string("near-duplicate of #%d by %s", "of_seq", "of_who")),
        ]
        rows = out[0]
        for o in out[1:]:
            rows = rows.unionByName(o)
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("room", "mode").orderBy("at", "who", "why"))).drop("at")
        return rows if caps.rows is None else rows.where(F.col("n") <= caps.rows)
