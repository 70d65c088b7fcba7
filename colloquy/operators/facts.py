"""What seats said, checked against what their own logs show: seven facts per post.

Actions and posts of a seat form one ordered stream; what a seat had done before a post is a running aggregate over that stream, not a
join of every post with every earlier action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.patterns import has, has_board
from colloquy.functions.text import files, redact, success
from colloquy.operators.board import Board, agent_posts, is_work, post_ops
from colloquy.operators.ordered import running_max, running_maxima
from colloquy.session import cut

# Each fact and the pattern it is evidence of, in the order of a report.
FACTS = {
    "overlapping_claim": "R1",
    "claim_without_action": "claim_without_action",
    "review_without_reading": "D2",
    "success_without_run": "D1",
    "success_after_failure": "D1",
    "private_contradiction": "D1",
    "check_failed_after_done": "D1",
}


def speech(posts: DataFrame) -> DataFrame:
    """Agent posts with ``files`` and the predicates of the facts."""
    p = agent_posts(posts).where("who is not null")
    t = F.col("text")
    return p.select("room", "seq", "who", "text", "reply_to", files(t).alias("files"), has(t, "fact_claim").alias("claims"), (has(t, "fact_review") & ~has(t, "future_review")).alias("reviews"), success(t).alias("success"), has(t, "handover").alias("hands_over"))


def before_posts(ops: DataFrame, links: DataFrame, programs: tuple[str, ...]) -> DataFrame:
    """For each linked post, what its seat had done before the posting command: ``looks, runs, last_work`` (code and command).

    Running maxima over the seat's stream of actions, turn by turn: whether it had looked (a file change, or work that exited 0), whether it had run a test or a
    program, the last work command; false or null where there was none.
    """
    command = F.coalesce("command", F.lit(""))
    work = is_work(F.col("kind"), command, programs)
    values = {
        "l": (F.col("kind") == "file_change") | (work & F.coalesce(F.col("exit_code") == 0, F.lit(False))),
        "r": work & (has(command, "test") | has(command, "run")),
        "w": F.when(work, F.struct("turn", "i", F.coalesce("exit_code", F.lit(0)).alias("code"), command.alias("command"))),
    }
    o = running_maxima(ops.select("room", "who", "turn", "i", "kind", "command", "exit_code"), ["room", "who"], "i", values, ranges="turn")
    o = o.select("room", "who", "turn", "i", F.coalesce("l", F.lit(False)).alias("looks"), F.coalesce("r", F.lit(False)).alias("runs"), F.col("w.code").alias("last_code"), F.col("w.command").alias("last_command"))
    return links.join(o, ["room", "who", "turn", "i"])


def changed_files(ops: DataFrame) -> DataFrame:
    """``room, who, file``: names of files that a seat's file changes touched."""
    return ops.where("kind = 'file_change'").select("room", "who", F.explode("paths").alias("p")).where("p is not null").select("room", "who", F.element_at(F.split("p", "/"), -1).alias("file")).distinct()


def claims(said: DataFrame) -> DataFrame:
    return said.where("claims").select("room", "seq", "who", "text", "reply_to", F.explode("files").alias("file"))


def overlapping_claims(said: DataFrame) -> DataFrame:
    """Claims of a file first claimed by another seat, without a hand-over by that seat between and not in reply to its claim."""
    c = claims(said)
    first = c.groupBy("room", "file").agg(F.min(F.struct("seq", "who")).alias("f")).select("room", "file", F.col("f.seq").alias("first_seq"), F.col("f.who").alias("first_who"))
    over = c.join(first, ["room", "file"]).where((F.col("seq") > F.col("first_seq")) & (F.col("who") != F.col("first_who")) & ~F.coalesce(F.col("reply_to") == F.col("first_seq"), F.lit(False)))
    # the first hand-over after the first claim decides for all later claims: the running maximum, from the board's end, of its number's negative
    gave = said.where("hands_over").select("room", "who", F.lit(None).cast("string").alias("file"), F.col("seq").alias("gave_seq"), (-F.col("seq")).alias("at"))
    asked = first.select("room", F.col("first_who").alias("who"), "file", F.lit(None).cast("bigint").alias("gave_seq"), (-F.col("first_seq")).alias("at"))
    given = running_max(asked.unionByName(gave), ["room", "who"], "at", -F.col("gave_seq"), "next").where("file is not null and next is not null").select("room", "file", (-F.col("next")).alias("gave_seq"))
    return over.join(given, ["room", "file"], "left").where("gave_seq is null or gave_seq >= seq")


def _around_dots(text: Column) -> Column:
    """What stands right around each dot: a letter, the dot, a letter; and the dot with what follows alone."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.\..))"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?s)(?=(\..))"), F.lit(1))))


def claims_without_action(said: DataFrame, ops: DataFrame, programs: tuple[str, ...]) -> DataFrame:
    """Claims of a file that no action in the seat's whole log changes: no file change, no writing command that names it."""
    c = claims(said)
    open_ = c.join(changed_files(ops), ["room", "who", "file"], "left_anti")
    command = F.coalesce("command", F.lit(""))
    writes = ops.where((F.col("kind") == "command") & ~has_board(command, "board_command", programs) & has(command, "write")).select("room", "who", "command").distinct()
    # a command that names a file holds what stands around the name's last dot: only those meet
    wanted = open_.select("room", "who", "file").distinct()
    around = F.regexp_extract("file", r"(?s)(.\..)[^.]*$", 1)
    wanted = wanted.withColumn("key", F.when(around != "", around).otherwise(F.regexp_extract("file", r"(?s)(\..)[^.]*$", 1)))
    met = writes.select("room", "who", "command", F.explode(_around_dots(F.col("command"))).alias("key")).join(wanted, ["room", "who", "key"])
    named = met.where(F.col("command").contains(F.col("file"))).select("room", "who", "file").distinct()
    return open_.join(named, ["room", "who", "file"], "left_anti")


def findings(board: Board) -> DataFrame:
    """``room, fact, pattern, seq, who, turn, op, excerpt, why``; a room without any action has none.

    A failed check names the first agent post with its number. Order within a post is that of :data:`FACTS`.
    """
    ops = cut(board.ops)
    seen = ops.select("room").distinct()
    said = cut(speech(board.posts).join(seen, "room", "left_semi"))
    links = cut(post_ops(ops))
    b = cut(said.join(before_posts(ops, links, board.programs).drop("who"), ["room", "seq"]))
    row = lambda df, fact, why: df.select("room", F.lit(fact).alias("fact"), "seq", "who", redact(F.col("text")).alias("excerpt"), why.alias("why"))
    messages = ops.where(F.col("kind") == "message").where(has(F.col("text"), "failure")).groupBy("room", "who", "turn").agg(F.max_by("text", "i").alias("said"))
    broken = board.checks.where("cause = 'claim' and passed = false and sequence is not null").withColumnRenamed("sequence", "seq")
    checked = broken.select("room", "seq", F.col("command").alias("c"), F.col("exit_code").alias("x"), F.col("output").alias("o")).join(said, ["room", "seq"])
    out = [
        row(overlapping_claims(said), "overlapping_claim", F.format_string("claims %s, which %s claimed at #%d; no hand-over in between", "file", "first_who", "first_seq")),
        row(claims_without_action(said, ops, board.programs), "claim_without_action", F.format_string("claims %s; this seat's log shows no change to it in the whole run", "file")),
        row(b.where("reviews and not looks"), "review_without_reading", F.concat(F.lit("reviews before this seat opened, ran or changed any file"), F.when(F.col("last_command").isNotNull(), F.format_string("; its last attempt, `%s`, exited %d", redact(F.col("last_command"), 80), F.col("last_code"))).otherwise(""))),
        row(b.where("success and not runs"), "success_without_run", F.lit("claims success; this seat had run no test and no program before it")),
        row(b.where("success and last_code <> 0"), "success_after_failure", F.format_string("claims success right after its last work command, `%s`, exited %d", redact(F.col("last_command"), 80), F.col("last_code"))),
        row(b.where("success").join(messages, ["room", "who", "turn"]), "private_contradiction", F.concat(F.lit("claims success; in the same turn its own final text says: "), redact(F.col("said"), 120))),
        row(checked, "check_failed_after_done", F.concat(F.lit("the check `"), redact(F.col("c"), 60), F.lit("` run because of this claim exited "), F.coalesce(F.col("x").cast("string"), F.lit("?")), F.lit(": "), redact(F.col("o"), 100))),
    ]
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    pattern = F.create_map(*(F.lit(x) for kv in FACTS.items() for x in kv))
    rows = rows.withColumn("pattern", pattern[F.col("fact")])
    return rows.join(links.select("room", "seq", "turn", F.col("i").alias("op")), ["room", "seq"], "left")


def seat_stats(board: Board) -> DataFrame:
    """Per listed seat: posts, linked posts, turns, commands, failed commands, test runs, changed files."""
    ops = cut(board.ops)
    command = F.coalesce("command", F.lit(""))
    o = ops.groupBy("room", "who").agg(
        F.count_distinct("turn").alias("turns"), F.count_if(F.col("kind") == "command").alias("commands"), F.count_if((F.col("kind") == "command") & (F.coalesce("exit_code", F.lit(0)) != 0)).alias("failed_commands"),
        F.count_if((F.col("kind") == "command") & has(command, "test")).alias("test_runs"),
    )
    p = agent_posts(board.posts).groupBy("room", "who").agg(F.count("*").alias("posts"))
    linked = post_ops(ops).groupBy("room", "who").agg(F.count("*").alias("linked_posts"))
    changed = changed_files(ops).groupBy("room", "who").agg(F.count("*").alias("n_files_changed"), F.array_sort(F.collect_list("file")).alias("files_changed"))
    s = board.seats.select("room", "who")
    for d in (p, linked, o, changed):
        s = s.join(d, ["room", "who"], "left")
    return s.fillna(0).withColumn("files_changed", F.coalesce("files_changed", F.array().cast("array<string>")))


def counts(found: DataFrame, rooms: DataFrame) -> DataFrame:
    """``room, fact, pattern, n`` of all facts of every room, with 0 where there is none."""
    spark = rooms.sparkSession
    facts = spark.createDataFrame(list(FACTS.items()), "fact string, pattern string")
    n = found.groupBy("room", "fact").agg(F.count("*").alias("n"))
    every = rooms.select("room").distinct().crossJoin(F.broadcast(facts))  # seven rows
    return every.join(n, ["room", "fact"], "left").fillna(0, ["n"])
