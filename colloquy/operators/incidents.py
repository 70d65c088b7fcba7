"""Incident records of several passes: checks against the board, matching of two passes, and their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import jaccard
from colloquy.operators.board import Board, post_ops
from colloquy.operators.ordered import running_max
from colloquy.session import cut

# The classes of the codebook, and what a record may say.
CLASSES = ("unsaid", "unreceived", "misread", "disagreement", "ungrounded", "stalled")
SOURCES, CONFIDENCES, DECISIONS = ("agents", "harness"), ("low", "medium", "high"), ("agreed", "merged", "kept", "added", "adjusted")
CAUSES = ("incident", "capability", "collective_judgement", "task_data", "harness", "grader")
#: What counts as the same incident by posts, and how long after its end a turn still takes a post.
SAME, GRACE_MS = 0.5, 1000


def records(incidents: DataFrame, record: str) -> DataFrame:
    """One pass's incidents, one row each: the latest of repeated or revised rows."""
    key = ["room_id", "incident_id"]
    rest = [c for c in incidents.columns if c not in key]
    latest = F.struct(F.coalesce("annotated_at", F.lit("0001-01-01").cast("timestamp_ntz")), "annotation_id")
    one = incidents.where((F.col("record") == record) & F.col("incident_id").isNotNull()).groupBy(*key).agg(F.max_by(F.struct(*rest), latest).alias("r"))
    return one.select(F.col("room_id").alias("room"), "incident_id", *(F.col("r")[c].alias(c) for c in rest))


def evidence_levels(board: Board) -> DataFrame:
    """``room, level``: E3 with actions, E2 with turns, else E1."""
    r = board.rooms.select("room")
    ops = board.ops.select("room").distinct().withColumn("o", F.lit(True))
    wakes = board.wakes.select("room").distinct().withColumn("w", F.lit(True))
    return r.join(ops, "room", "left").join(wakes, "room", "left").select("room", F.when(F.col("o"), "E3").when(F.col("w"), "E2").otherwise("E1").alias("level"))


def seen(board: Board) -> DataFrame:
    """``room, seq, who, turn, seen``: the highest post that each agent post's author had received when it wrote.

    The turn is that of the posting command, or the one whose time holds the post (a second of grace; open without an end). What the turn was handed
    counts (1 where it was handed the goal), raised by the board reads before the post in the same turn.
    """
    p = board.posts.where("role is null or role = 'agent'").select("room", "seq", "who", "at_ms")
    w = board.wakes.select("room", "who", "turn", "start_ms", "end_ms", F.coalesce("through_sequence", F.lit(1)).alias("handed"))
    links = cut(post_ops(board.ops)).select("room", "seq", "who", "turn", "i")
    linked = p.join(links, ["room", "seq", "who"]).join(w.select("room", "who", "turn", "handed"), ["room", "who", "turn"], "left")
    reads = board.ops.select("room", "who", "turn", "i", "read_max")
    reads = reads.withColumn("m", F.max("read_max").over(Window.partitionBy("room", "who", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))).select("room", "who", "turn", "i", "m")
    linked = linked.join(reads, ["room", "who", "turn", "i"], "left").select("room", "seq", "who", F.when(F.col("handed").isNotNull(), F.col("turn")).alias("turn"), F.when(F.col("handed").isNotNull(), F.greatest("handed", "m")).alias("seen"))
    # unlinked: the last turn that began before the post, if it hadn't ended; turns of one seat follow one another
    free = p.join(links.select("room", "seq"), ["room", "seq"], "left_anti")
    stream = free.select("room", "who", F.col("at_ms").alias("t"), "seq", F.lit(None).cast("struct<t:bigint,turn:bigint,end_ms:bigint,handed:bigint>").alias("wake")).where("t is not null")
    starts = w.where("start_ms is not null").select("room", "who", F.col("start_ms").alias("t"), F.lit(None).cast("bigint").alias("seq"), F.struct(F.col("start_ms").alias("t"), "turn", F.coalesce("end_ms", F.lit(1 << 60)).alias("end_ms"), "handed").alias("wake"))
    at = running_max(stream.unionByName(starts), ["room", "who"], "t", F.col("wake"), "last", inclusive=True, width=86_400_000).where("seq is not null")
    hit = F.col("t") <= F.col("last.end_ms") + GRACE_MS
    timed = at.select("room", "seq", "who", F.when(hit, F.col("last.turn")).alias("turn"), F.when(hit, F.col("last.handed")).alias("seen"))
    untimed = free.where("at_ms is null").select("room", "seq", "who", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("bigint").alias("seen"))
    return linked.unionByName(timed).unionByName(untimed)


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of two passes that may be the same incident: ``room, a, b, score``.

    Same anchor, or at least half of all posts shared. Two incidents that share half their posts share one of the rarest of either: only by
    those (as many as could all be missing, and one more) and by their anchors are they brought together, so a post that many name brings none together alone.
    """
    side = lambda d, n: d.select("room", F.col("incident_id").alias(n), F.array_distinct(F.filter(F.coalesce("posts", F.array().cast("array<bigint>")), lambda x: x.isNotNull())).alias(f"{n}_posts"), F.col("anchor").alias(f"{n}_anchor"))
    x, y = side(a, "a"), side(b, "b")
    named = x.select("room", F.explode("a_posts").alias("post")).unionByName(y.select("room", F.explode("b_posts").alias("post"))).groupBy("room", "post").agg(F.count("*").alias("n"))

    def key(d: DataFrame, n: str) -> DataFrame:
        rare = d.select("room", n, F.explode(f"{n}_posts").alias("post")).join(named, ["room", "post"]).groupBy("room", n).agg(F.array_sort(F.collect_list(F.struct("n", "post"))).alias("r"))
        size = F.size("r")
        rare = rare.select("room", n, F.slice("r", F.lit(1), (size - F.ceil(SAME * size) + 1).cast("int")).alias("r")).select("room", n, F.explode("r").alias("x")).select("room", n, F.lit("post").alias("by"), F.col("x.post").alias("post"))
        anchors = d.where(F.col(f"{n}_anchor").isNotNull()).select("room", n, F.lit("anchor").alias("by"), F.col(f"{n}_anchor").alias("post"))
        return rare.unionByName(anchors)

    met = key(x, "a").join(key(y, "b"), ["room", "by", "post"]).select("room", "a", "b").distinct()
    j = met.join(x, ["room", "a"]).join(y, ["room", "b"])
    same, likeness = F.coalesce(F.col("a_anchor") == F.col("b_anchor"), F.lit(False)), jaccard(F.col("a_posts"), F.col("b_posts"))
    return j.where(same | (likeness >= SAME)).select("room", "a", "b", F.when(same, 1.0 + likeness).otherwise(likeness).alias("score"))


def greedy(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs, best score first, ties by ids: ``room, a, b, score``.

    A pair that is the best of both its sides is taken, and the pairs of taken incidents fall away, until none is left: the same as going through all
    pairs in order, in a few rounds of joins.
    """
    left, out = cut(pairs), None
    while not left.isEmpty():
        best = F.struct((-F.col("score")).alias("s"), "a", "b")
        at_a = left.groupBy("room", "a").agg(F.min(best).alias("m"))
        at_b = left.groupBy("room", "b").agg(F.min(best).alias("m"))
        taken = cut(at_a.select("room", "m").join(at_b.select("room", "m"), ["room", "m"]).select("room", "m.a", "m.b", (-F.col("m.s")).alias("score")))
        out = taken if out is None else out.unionByName(taken)
        left = cut(left.join(taken.select("room", "a"), ["room", "a"], "left_anti").join(taken.select("room", "b"), ["room", "b"], "left_anti"))
    return out if out is not None else left


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per room: incidents of both passes, matches, F1 (a match counts if the class agrees too), kappas, mean severities.

    Kappa is null where chance explains everything, F1 where both are empty. Weights of severities are quadratic over 1 to 5.
    """
    m = cut(greedy(candidates(a, b)))
    val = lambda d, n: d.select("room", F.col("incident_id").alias(n), F.col("class").alias(f"{n}_class"), F.col("severity").alias(f"{n}_sev"))
    m = m.join(val(a, "a"), ["room", "a"]).join(val(b, "b"), ["room", "b"])
    size = lambda d, n: d.groupBy("room").agg(F.count("*").alias(f"n_{n}"), F.avg("severity").alias(f"mean_{n}"))
    out = size(a, "a").join(size(b, "b"), "room", "full").fillna(0, ["n_a", "n_b"])
    out = out.join(m.groupBy("room").agg(F.count("*").alias("matched"), F.count_if(F.col("a_class") == F.col("b_class")).alias("matched_same_class")), "room", "left").fillna(0, ["matched", "matched_same_class"])
    for name, x, y, weight in (("class_kappa", "a_class", "b_class", lambda i, j: (i != j).cast("int").cast("double")), ("severity_weighted_kappa", "a_sev", "b_sev", lambda i, j: F.pow(i - j, F.lit(2)) / 16)):
        out = out.join(_kappa(m.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, weight, name), "room", "left")
    f1 = F.when(F.col("n_a") + F.col("n_b") > 0, 2 * F.col("matched_same_class") / (F.col("n_a") + F.col("n_b")))
    return out.withColumn("incident_f1", F.round(f1, 3)).withColumn("mean_a", F.round("mean_a", 2)).withColumn("mean_b", F.round("mean_b", 2))


def _kappa(pairs: DataFrame, x: str, y: str, weight, name: str) -> DataFrame:
    cell = pairs.groupBy("room", F.col(x).alias("i"), F.col(y).alias("j")).agg(F.count("*").alias("n"))
    total = cell.groupBy("room").agg(F.sum("n").alias("t"), F.sum(F.col("n") * weight(F.col("i"), F.col("j"))).alias("obs"))
    pa, pb = cell.groupBy("room", "i").agg(F.sum("n").alias("na")), cell.groupBy("room", "j").agg(F.sum("n").alias("nb"))
    exp = pa.join(pb, "room").groupBy("room").agg(F.sum(F.col("na") * F.col("nb") * weight(F.col("i"), F.col("j"))).alias("exp"))  # a handful of values a side
    return total.join(exp, "room").select("room", F.when(F.col("exp") != 0, F.round(1 - F.col("obs") * F.col("t") / F.col("exp"), 3)).alias(name))


def problems(incidents: DataFrame, board: Board, patterns: DataFrame | None = None) -> DataFrame:
    """``room, incident_id, record, problem``: what a record's rows get wrong, one row per rule.

    Posts that don't exist, an anchor outside its posts, unknown classes, severities, sources and confidences, reasons that don't name
    their severity, too short texts, a pattern of another class (``patterns``: ``pattern, group``), and an unreceived incident
    whose author had received everything it lists. Null lists count as empty.
    """
    i = incidents.select("room", "incident_id", "record", "posts", "anchor", "actions", "class", "pattern", "class_reason", "cause", "consequence", "severity", "severity_reason", "repaired", "source", "confidence")
    i = i.withColumn("posts", F.coalesce("posts", F.array().cast("array<bigint>")))
    short = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) < 10
    not_in = lambda c, v: ~F.coalesce(F.col(c).isin(*v), F.lit(False))
    rules = [
        (F.size("posts") == 0, "posts must be a non-empty list"),
        (~F.coalesce(F.array_contains("posts", F.col("anchor")), F.lit(False)), "the anchor must be one of its posts"),
        (not_in("class", CLASSES), "unknown class"),
        (~F.coalesce(F.col("severity").between(1, 5), F.lit(False)), "severity must be from 1 to 5"),
        (F.col("severity").between(1, 5) & ~F.coalesce(F.trim("severity_reason").startswith(F.col("severity").cast("string")), F.lit(False)), "severity_reason must begin with the level"),
        (short("class_reason"), "class_reason must say what happened"),
        (short("cause"), "cause must say what happened"),
        (short("consequence"), "consequence must say what happened"),
        (F.col("repaired").isNull(), "repaired must be true or false"),
        (not_in("source", SOURCES), "unknown source"),
        (not_in("confidence", CONFIDENCES), "unknown confidence"),
    ]
    key = ["room", "incident_id", "record"]
    out = i.select(*key, F.explode(F.array(*(F.when(c, p) for c, p in rules))).alias("problem")).where("problem is not null")
    each = i.select(*key, "class", "source", "anchor", F.explode("posts").alias("seq"))
    known = board.posts.select("room", "seq").distinct()
    missing = each.join(known, ["room", "seq"], "left_anti").select(*key, F.lit("a post does not exist").alias("problem")).distinct()
    levels = evidence_levels(board)
    blind = i.where(F.size("actions") > 0).join(levels.where("level <> 'E3'"), "room").select(*key, F.lit("actions without agents' logs").alias("problem"))
    unsaid = i.where("class = 'unsaid'").join(levels.where("level <> 'E3'"), "room").select(*key, F.lit("unsaid needs the agents' logs").alias("problem"))
    s = seen(board).where("seen is not null").select("room", F.col("seq").alias("anchor"), F.col("who").alias("author"), "seen")
    un = each.where("class = 'unreceived' and source = 'agents'").join(s, ["room", "anchor"]).join(board.posts.select("room", "seq", "who"), ["room", "seq"])
    excuse = (F.col("who") != F.col("author")) & (((F.col("seq") > F.col("seen")) & (F.col("seq") < F.col("anchor"))) | (F.col("seq") > F.col("anchor")))
    received = un.groupBy(*key).agg(F.bool_or(excuse).alias("ok")).where("not ok").select(*key, F.lit("unreceived, but its author had received every other post").alias("problem"))
    out = out.unionByName(missing).unionByName(blind).unionByName(unsaid).unionByName(received)
    if patterns is not None:
        j = i.where(~F.col("pattern").startswith("NEW:")).join(patterns.select("pattern", "group"), "pattern", "left")
        why = F.when(F.col("group").isNull(), "pattern is not in the codebook").when(F.col("group") == "overhead", "overhead is no failure").when(F.col("group") != F.col("class"), "pattern of another class")
        out = out.unionByName(j.select(*key, why.alias("problem")).where("problem is not null"))
    return out


def accounting(judged: DataFrame, rejected: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``room, id, problem``: incidents of both passes (as ``A:id``, ``B:id``) that a judgement doesn't use exactly once.

    ``judged``: ``room, from array``; ``rejected``: ``room, from string``.
    """
    want = a.select("room", F.concat(F.lit("A:"), F.col("id")).alias("id")).unionByName(b.select("room", F.concat(F.lit("B:"), F.col("id")).alias("id"))).distinct()
    used = judged.select("room", F.explode("from").alias("id")).unionByName(rejected.select("room", F.col("from").alias("id"))).groupBy("room", "id").agg(F.count("*").alias("n"))
    j = want.withColumn("w", F.lit(True)).join(used, ["room", "id"], "full")
    problem = F.when(F.col("n").isNull(), "neither kept nor rejected").when(F.col("w").isNull(), "does not exist").when(F.col("n") > 1, "used twice")
    return j.select("room", "id", problem.alias("problem")).where("problem is not null")


def sweep_gaps(posts: DataFrame, sweep: DataFrame, incidents: DataFrame) -> DataFrame:
    """``room, seq, problem``: agent posts that a sweep (``room, seq, incidents array, note``) misses, repeats or ties wrongly."""
    agent = posts.where("role = 'agent'").select("room", "seq")
    row = lambda d, p: d.select("room", "seq", F.lit(p).alias("problem"))
    named = sweep.select("room", "seq", F.explode("incidents").alias("id"))
    listed = incidents.select("room", "id", F.explode("posts").alias("seq"))
    out = row(agent.join(sweep, ["room", "seq"], "left_anti"), "missing")
    out = out.unionByName(row(sweep.groupBy("room", "seq").count().where("count > 1"), "more than once"))
    out = out.unionByName(row(sweep.join(posts, ["room", "seq"], "left_anti"), "no such post"))
    out = out.unionByName(row(sweep.where("trim(coalesce(note, '')) = ''"), "no note"))
    out = out.unionByName(row(named.join(listed, ["room", "id", "seq"], "left_anti"), "names an incident that doesn't include it"))
    return out.unionByName(row(listed.join(agent, ["room", "seq"], "left_semi").join(named, ["room", "id", "seq"], "left_anti"), "an incident includes it, the entry doesn't say so"))


def grade_gaps(grade: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rubric items (``room, index, score``) that lost points and have no entry in the verdict (``room, index``)."""
    return grade.where("score < 100").join(verdict, ["room", "index"], "left_anti").select("room", "index")


def batch_summary(runs: DataFrame) -> DataFrame:
    """``selected, completed, failed, pending`` of a batch (``run, status``)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.agg(F.count("*").alias("selected"), n("completed"), n("failed"), n("pending"))


def timeline(board: Board) -> DataFrame:
    """``room, at_ms, rank, line``: turn starts, posts and turn ends; sort by time, then rank (nulls first, ends without a time last)."""
    p = board.posts.select("room", "at_ms", F.when(F.col("role") == "goal", 0).otherwise(1).alias("rank"), F.format_string("P%d %s: %s", "seq", "who", "text").alias("line"))
    w = board.wakes
    s = w.select("room", F.col("start_ms").alias("at_ms"), F.lit(0).alias("rank"), F.format_string("--- %s turn %d starts", "who", "turn").alias("line"))
    e = w.select("room", F.coalesce("end_ms", F.lit(1 << 60)).alias("at_ms"), F.lit(2).alias("rank"), F.format_string("--- %s turn %d ends%s", F.col("who"), F.col("turn"), F.when(F.col("cut_by_end"), " (cut by the end of the run)").otherwise("")).alias("line"))
    return p.unionByName(s).unionByName(e)


def action_list(ops: DataFrame) -> DataFrame:
    """``room, action_id, line`` of every action."""
    text = F.coalesce("query", "name", "text", F.lit(""))
    line = (
        F.when(F.col("posted").isNotNull(), F.concat(F.lit("posted P"), F.col("posted")))
        .when(F.col("read_max").isNotNull(), F.concat(F.lit("read the board: up to P"), F.col("read_max")))
        .when(F.col("kind") == "command", F.concat(F.lit("command [exit "), F.coalesce(F.col("exit_code").cast("string"), F.lit("none")), F.lit("]: "), F.substring(F.coalesce("command", F.lit("")), 1, 400)))
        .when(F.col("kind") == "file_change", F.concat(F.lit("file change: "), F.array_join(F.coalesce("paths", F.array().cast("array<string>")), ", ")))
        .when(F.col("kind") == "message", F.concat(F.lit("final text of the turn: "), F.substring(text, 1, 400)))
        .otherwise(F.substring(F.concat_ws(": ", "kind", text), 1, 240))
    )
    return ops.select("room", F.concat_ws(":", "who", "turn", "i").alias("action_id"), "who", "turn", "i", "kind", line.alias("line"))


def bundle_index(board: Board) -> tuple[DataFrame, DataFrame]:
    """What a record is checked against: posts (``room, seq, who, role, created_at, seen, level``) and action ids."""
    s = seen(board).select("room", "seq", "seen")
    p = board.posts.select("room", "seq", "who", "role", "created_at").join(s, ["room", "seq"], "left").join(evidence_levels(board), "room", "left")
    return p, board.ops.select("room", F.concat_ws(":", "who", "turn", "i").alias("action_id"), "who", "turn", "kind")


def annotation_problems(items: DataFrame, incidents: DataFrame, undecidable: DataFrame, levels: DataFrame) -> DataFrame:
    """``room, problem`` of annotations: items without id or name, incident ids missing or repeated, unknown undecidable classes, and
    ``unsaid`` not given as undecidable where the room has no agents' logs.

    ``items``: ``room, id, name``; ``incidents``: ``room, id, items array``; ``undecidable``: ``room, class``; ``levels``: ``room, level``.
    """
    row = lambda d, p: d.select("room", F.lit(p).alias("problem")).distinct()
    out = row(items.where("coalesce(id, '') = '' or coalesce(name, '') = ''"), "each item needs an id and a name")
    out = out.unionByName(row(incidents.where("id is null"), "incident ids must be present"))
    out = out.unionByName(row(incidents.where("id is not null").groupBy("room", "id").count().where("count > 1"), "incident ids must be unique"))
    named = incidents.select("room", F.explode("items").alias("id"))
    out = out.unionByName(row(named.join(items, ["room", "id"], "left_anti"), "an incident names an item that isn't listed"))
    out = out.unionByName(row(undecidable.where(~F.col("class").isin(*CLASSES)), "undecidable holds an unknown class"))
    silent = levels.where("level <> 'E3'").join(undecidable.where("class = 'unsaid'"), "room", "left_anti")
    return out.unionByName(row(silent, "without agents' logs, unsaid must be undecidable"))


def verdict_problems(verdict: DataFrame, incidents: DataFrame) -> DataFrame:
    """``room, index, problem`` of a verdict's causes (``room, index, kind, incidents array``): unknown kinds, incidents missing or unknown."""
    v = verdict.select("room", "index", F.when(~F.coalesce(F.col("kind").isin(*CAUSES), F.lit(False)), "unknown kind of cause").when((F.col("kind") == "incident") & (F.coalesce(F.size("incidents"), F.lit(0)) < 1), "an incident cause must list incidents").alias("problem"))
    named = verdict.where("kind = 'incident'").select("room", "index", F.explode("incidents").alias("id"))
    unknown = named.join(incidents.select("room", "id"), ["room", "id"], "left_anti").select("room", "index", F.lit("no such incident").alias("problem")).distinct()
    return v.where("problem is not null").unionByName(unknown)


def accepted(runs: DataFrame, artifacts: DataFrame, needed: list[str], agreements: DataFrame, recomputed: DataFrame) -> DataFrame:
    """``run, ok`` of a batch: all needed artifacts are there, evidence is E3, and the stored agreement equals the recomputed one.

    ``runs``: ``run, level``; ``artifacts``: ``run, name``; ``agreements`` and ``recomputed``: ``run, incident_f1, class_kappa``.
    """
    have = artifacts.where(F.col("name").isin(*needed)).groupBy("run").agg(F.count_distinct("name").alias("n"))
    a = agreements.select("run", F.struct("incident_f1", "class_kappa").alias("a"))
    r = recomputed.select("run", F.struct("incident_f1", "class_kappa").alias("r"))
    j = runs.join(have, "run", "left").join(a, "run", "left").join(r, "run", "left")
    return j.select("run", F.coalesce((F.col("n") == len(needed)) & (F.col("level") == "E3") & F.col("a").eqNullSafe(F.col("r")) & F.col("a").isNotNull(), F.lit(False)).alias("ok"))
