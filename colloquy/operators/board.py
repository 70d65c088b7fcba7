"""The relations of many boards at once: seats, posts, actions, checks, turns; and the small tools over them.

Every relation carries ``room``. Fields that a source doesn't show are null, never invented.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace  # noqa: F401

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.json_values import as_text, decoded, entries, field, strict_json, whole_number
from colloquy.functions.patterns import PROGRAMS, has_board
from colloquy.functions.text import posted_id, read_max
from colloquy.functions.times import epoch_ms
from colloquy.operators import nested
from colloquy.session import cut
from colloquy.sources import tables

EMPTY = {
    "rooms": "room string, name string, created_at string, latest_sequence bigint, state string, source_kind string, ended_by string",
    "seats": "room string, who string, ord int, label string, driver string, model string, joined_at string, principal string, member_id string",
    "posts": "room string, seq bigint, id string, who string, text string, created_at string, at_ms bigint, reply_to bigint, type string, role string",
    "artifacts": "room string, id string, who string, created_at string, name string, sha256 string",
    "ops": "room string, who string, turn bigint, i int, kind string, command string, exit_code bigint, output string, posted bigint, paths array<string>, query string, name string, text string, read_max bigint",
    "checks": "room string, at string, at_ms bigint, trigger string, command string, cause string, exit_code bigint, passed boolean, sequence bigint, output string",
    "wakes": "room string, who string, turn bigint, fired array<string>, from_sequence bigint, through_sequence bigint, messages bigint, start_ms bigint, end_ms bigint, exit_code bigint, failed boolean, tokens bigint, cut_by_end boolean",
}


@dataclass(frozen=True)
class Board:
    """The relations of a source, lazily; the columns are those of :data:`EMPTY`. ``programs``: the names of the board's command line.

    ``ops`` may be given as a function: they are planned when they are first read, as their plan takes the driver memory, whatever the rows.
    """

    rooms: DataFrame
    seats: DataFrame
    posts: DataFrame
    artifacts: DataFrame
    ops: DataFrame | Callable[[], DataFrame]
    checks: DataFrame
    wakes: DataFrame
    programs: tuple[str, ...] = PROGRAMS

    def __getattribute__(self, name: str):
        v = super().__getattribute__(name)
        if name == "ops" and callable(v):
            object.__setattr__(self, name, v := v())
        return v


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], EMPTY[name])


def shaped(df: DataFrame, name: str) -> DataFrame:
    """The relation's columns in order, missing ones null."""
    parts = [x.strip().split(" ", 1) for x in EMPTY[name].split(", ")]
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in parts))


# ---- seats and posts


def seats(episodes: DataFrame) -> DataFrame:
    """The seats that the runs of a room list, in the order of their first listing."""
    a = episodes.select(F.col("room_id").alias("room"), F.col("goal.started_at").alias("at"), F.posexplode("agents").alias("ord", "a"))
    a = a.select("room", "at", "ord", tables.seat_name(F.col("a.name")).alias("who"), F.col("a.driver").alias("driver"), F.col("a.model").alias("model"), F.col("a.member_id").alias("member_id"))
    first = F.struct(F.coalesce("at", F.lit("")), "ord", "member_id")
    return shaped(a.where("who is not null").groupBy("room", "who").agg(*(F.min_by(c, first).alias(c) for c in ("ord", "driver", "model", "member_id"))), "seats")


def posts(room: DataFrame, episodes: DataFrame, raw: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Posts with author, role and the number of the post they reply to.

    The author is the name that the run lists for the sender's instance, else the sender's own, else the instance, else ``?``. The
    role is ``goal`` for a run's goal, ``runner``, ``other`` for a person or an unlisted sender, else ``agent``; where a room
    lists no seats every other sender is an agent. ``raw``: the room's posts, where they are at hand already. ``written``: what the runs
    list is written before the posts are joined with it.
    """
    p = tables.posts(room) if raw is None else raw
    apart = cut if written else lambda df: df
    members = episodes.select(F.col("room_id").alias("m_room"), F.explode("agents").alias("a")).select("m_room", F.col("a.member_id").alias("m_id"), tables.seat_name(F.col("a.name")).alias("m_name"))
    by_member = apart(members.where("m_id is not null").groupBy("m_room", "m_id").agg(F.min("m_name").alias("m_name")))
    names = apart(members.where("m_name is not null").select(F.col("m_room").alias("n_room"), F.col("m_name").alias("n_name")).distinct().withColumn("is_listed", F.lit(True)))
    has_list = apart(names.select(F.col("n_room").alias("l_room")).distinct().withColumn("has_list", F.lit(True)))
    goals = apart(episodes.select(F.col("goal.message_id").alias("g_id")).distinct().withColumn("is_goal", F.lit(True)))
    mid = F.coalesce("sender_instance_id", "sender.member_id")
    p = p.withColumn("mid", mid).join(by_member, (F.col("room_id") == F.col("m_room")) & (F.col("mid") == F.col("m_id")), "left")
    p = p.withColumn("who", F.coalesce("m_name", "seat", "mid", F.lit("?")))
    p = p.join(names, (F.col("room_id") == F.col("n_room")) & (F.col("who") == F.col("n_name")), "left")
    p = p.join(has_list, F.col("room_id") == F.col("l_room"), "left").join(goals, F.col("id") == F.col("g_id"), "left")
    role = (
        F.when(F.col("is_goal"), "goal")
        .when((F.col("sender.kind") == "runner") | (F.col("who") == "runner"), "runner")
        .when(F.col("sender.kind") == "human", "other")
        .when(F.col("is_listed") | F.col("has_list").isNull(), "agent")
        .otherwise("other")
    )
    seq_of = tables.posts_numbers(room)
    p = p.withColumn("role", role).join(seq_of, (F.col("room_id") == F.col("r_room")) & (F.col("reply_to_message_id") == F.col("r_id")) & F.col("reply_to_sequence").isNull(), "left")
    return p.select(F.col("room_id").alias("room"), F.col("sequence").alias("seq"), "id", "who", F.coalesce("content", F.lit("")).alias("text"), "created_at", "at_ms", F.coalesce("reply_to_sequence", "r_seq").alias("reply_to"), F.coalesce("type", F.lit("message")).alias("type"), "role")


def principals(raw: DataFrame, listed: DataFrame) -> DataFrame:
    """Seats with the first principal that posted under their member id."""
    first = raw.where("sender_principal_id is not null").groupBy(F.col("room_id").alias("room"), F.coalesce("sender_instance_id", "sender.member_id").alias("member_id")).agg(F.min_by("sender_principal_id", "sequence").alias("p"))
    return shaped(listed.join(first, ["room", "member_id"], "left").withColumn("principal", F.coalesce("principal", "p")), "seats")


# ---- actions


def _item_op(v: Column) -> Column:
    """An action of the first harness dialect, or null."""
    item = decoded(field(v, "item"))
    kind, out = as_text(field(item, "type")), as_text(field(item, "aggregated_output"))
    error = decoded(field(v, "error"))
    paths = F.transform(F.filter(F.coalesce(entries(decoded(field(item, "changes"))), F.array().cast("array<variant>")), lambda c: F.schema_of_variant(c).startswith("OBJECT")), lambda c: as_text(field(c, "path")))
    text = lambda n: as_text(field(item, n))
    failed = F.coalesce(as_text(field(error, "message")), as_text(field(v, "message")))
    done = as_text(field(v, "type")) == "item.completed"
    row = lambda k, command=None, code=None, output=None, path=None, query=None, name=None, text=None: F.struct(
        F.lit(k).alias("kind"),
        *((x if x is not None else F.lit(None)).cast(t).alias(n) for n, x, t in (("command", command, "string"), ("exit_code", code, "bigint"), ("output", output, "string"), ("paths", path, "array<string>"), ("query", query, "string"), ("name", name, "string"), ("text", text, "string"), ("tool_id", None, "string"))),
    )
    return (
        F.when(done & (kind == "command_execution"), row("command", text("command"), whole_number(field(item, "exit_code")), F.coalesce(out, F.lit(""))))
        .when(done & (kind == "file_change"), row("file_change", path=paths))
        .when(done & (kind == "web_search"), row("web_search", query=text("query")))
        .when(done & (kind == "mcp_tool_call"), row("tool", name=F.concat_ws(".", text("server"), text("tool"))))
        .when(done & (kind == "agent_message"), row("message", text=text("text")))
        .when(done & (kind == "error"), row("error", text=text("message")))
        .when(as_text(field(v, "type")).isin("turn.failed", "error"), row("error", text=failed))
    )


def _content_op(c: Column) -> Column:
    """An action of the second dialect from one entry of a message's content, or null."""
    kind, name = as_text(field(c, "type")), as_text(field(c, "name"))
    arg = lambda n: as_text(field(field(c, "input"), n))
    null = F.lit(None).cast("string")
    row = lambda k, command=null, path=None, query=null, name=null, text=null, tool=null: F.struct(
        F.lit(k).alias("kind"), command.alias("command"), F.lit(None).cast("bigint").alias("exit_code"), null.alias("output"), (path if path is not None else F.lit(None)).cast("array<string>").alias("paths"), query.alias("query"), name.alias("name"), text.alias("text"), tool.alias("tool_id")
    )
    return F.when(kind == "text", row("message", text=as_text(field(c, "text")))).when(
        kind == "tool_use",
        F.when(name == "Bash", row("command", command=arg("command"), tool=as_text(field(c, "id"))))
        .when(name.isin("Edit", "Write", "MultiEdit", "NotebookEdit"), row("file_change", path=F.array(F.coalesce(arg("file_path"), arg("notebook_path")))))
        .when(name == "WebSearch", row("web_search", query=arg("query")))
        .otherwise(row("tool", name=name)),
    )


def board_programs(turn_lines: DataFrame, least: float = 0.01) -> tuple[str, ...]:
    """The names that the board's command line goes by in these logs: of the programs that are told to say something, those whose answer is a posted message.

    Names of fewer than the share ``least`` of these answers are taken for words in a message. One pass over the text, whose few names are collected.
    """
    said = turn_lines.where(F.col("line").rlike(r'message\\?"\s*:\s*\{') & F.col("line").rlike(r'id\\?"\s*:\s*\\?"msg_'))
    name = F.regexp_extract("line", r"""(?:[\s'"/;&|(])([A-Za-z][A-Za-z0-9_-]*)\s+(?:say|post)\b""", 1).alias("name")
    names = said.select(name).where("name <> ''").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(16).collect()
    total = sum(r.n for r in names)
    return tuple(sorted({*PROGRAMS, *(r.name for r in names if r.n >= least * total)}))


def actions(turn_lines: DataFrame, programs: tuple[str, ...] = PROGRAMS) -> DataFrame:
    """What each seat did, of both harness dialects: ``room, who, turn, i`` and the action, ``i`` counting from 0 within the turn.

    Lines that are no JSON and events of no known kind are skipped. A result's error flag is the exit code of the command it answers; the
    id of a posted message and the highest number a board read printed come from the whole output, of which the last 500 characters are kept.
    A turn is numbered in one task: it is what one harness run wrote.
    """
    at = turn_lines.where("line_id is not null").dropDuplicates(["line_id"]).select("line_id", F.col("room_id").alias("room"), tables.seat_name(F.col("seat")).alias("who"), "turn", "line_no", "line")
    ev = at.select("line_id", "room", "who", "turn", "line_no", F.posexplode(entries(strict_json(F.col("line")))).alias("event_pos", "value"))
    ev = ev.withColumn("value", decoded(F.col("value"))).withColumn("event_type", as_text(field(F.col("value"), "type")))
    place = ["room", "who", "turn", "line_no", "line_id", "event_pos"]
    first = ev.where(F.col("event_type").isin("item.completed", "turn.failed", "error")).select(*place, F.lit(0).alias("content_pos"), _item_op(F.col("value")).alias("op"))
    content = entries(field(field(F.col("value"), "message"), "content"))
    inside = ev.where(F.col("event_type").isin("assistant", "user")).select(*place, "event_type", F.posexplode(content).alias("content_pos", "c"))
    second = inside.where("event_type = 'assistant'").select(*place, "content_pos", _content_op(F.col("c")).alias("op"))
    results = inside.where((F.col("event_type") == "user") & (as_text(field(F.col("c"), "type")) == "tool_result"))
    results = results.groupBy("room", "who", "turn", as_text(field(F.col("c"), "tool_use_id")).alias("tool_id")).agg(F.max_by(F.coalesce(F.try_variant_get(field(F.col("c"), "is_error"), "$", "boolean"), F.lit(False)).cast("bigint"), F.struct("line_no", "event_pos", "content_pos")).alias("result"))
    ops = first.unionByName(second).where("op is not null").select(*place, "content_pos", "op.*")
    order = Window.partitionBy("room", "who", "turn").orderBy("line_no", "line_id", "event_pos", "content_pos")
    ops = ops.withColumn("i", F.row_number().over(order) - 1)
    ops = ops.join(results, ["room", "who", "turn", "tool_id"], "left")
    return ops.select(
        "room", "who", "turn", "i", "kind", "command",
        F.when(F.col("tool_id").isNotNull(), F.col("result")).otherwise(F.col("exit_code")).alias("exit_code"),
        F.substring("output", F.greatest(F.length("output") - 499, F.lit(1)), F.lit(500)).alias("output"),
        posted_id(F.col("command"), F.col("output"), programs).alias("posted_id"), read_max(F.col("command"), F.col("output"), programs).alias("read_max"), "paths", "query", "name", "text",
    )


def link_posts(ops: DataFrame, posts: DataFrame) -> DataFrame:
    """Actions with ``posted``: the number of the post that a say command made."""
    ids = posts.where("id is not null").select(F.col("room").alias("p_room"), F.col("id").alias("p_id"), F.col("seq").alias("posted"))
    # only say commands join, so null ids don't meet in one partition
    said = ops.where("posted_id is not null").join(ids, (F.col("room") == F.col("p_room")) & (F.col("posted_id") == F.col("p_id")), "left")
    return shaped(said.unionByName(ops.where("posted_id is null"), allowMissingColumns=True), "ops")


def from_relations(room: DataFrame, episodes: DataFrame, turn_lines: DataFrame, checks: DataFrame, wakes: DataFrame, programs: tuple[str, ...] | None = None, written: bool = False) -> Board:
    """A board of raw relations in the shape of the tables; where a room lists no seats, its senders are its seats.

    ``programs`` are the names of the board's command line; without any they are taken from the logs. ``written``: the posts are written
    once, for queries that read posts, seats and rooms, and so are the small tables that they are joined with; else each plans their joins anew.
    """
    programs = board_programs(turn_lines) if programs is None else programs
    nested.allow_repeated_keys(turn_lines)
    # one table of posts serves all relations
    raw = tables.posts(room, written=written)
    episodes = cut(episodes) if written else episodes
    p = posts(room, episodes, raw, written)
    p = cut(p) if written else p
    return Board(
        rooms=rooms(p, episodes),
        seats=all_seats(raw, episodes, p, written),
        posts=p,
        artifacts=empty(room.sparkSession, "artifacts"),
        ops=lambda: link_posts(actions(turn_lines, programs), p),
        checks=shaped(tables.checks(checks).withColumnRenamed("room_id", "room"), "checks"),
        wakes=shaped(tables.wakes(wakes).withColumnRenamed("room_id", "room").withColumnRenamed("seat", "who"), "wakes"),
        programs=programs,
    )


def all_seats(raw: DataFrame, episodes: DataFrame, posts: DataFrame, written: bool = False) -> DataFrame:
    """The listed seats; of a room without any, the agents that post there, joined with their first post; with their principals.

    ``written``: either kind of seats is written before the principals are joined.
    """
    apart = cut if written else lambda df: df
    listed = apart(seats(episodes))
    senders = agent_posts(posts).join(listed.select("room").distinct(), "room", "left_anti").groupBy("room", "who").agg(F.min_by("created_at", "seq").alias("joined_at"), F.min("seq").cast("int").alias("ord"))
    member = raw.groupBy(F.col("room_id").alias("room"), F.col("seat").alias("who")).agg(F.min(F.coalesce("sender_instance_id", "sender.member_id")).alias("member_id"))
    found = apart(shaped(senders.join(member, ["room", "who"], "left"), "seats"))
    return principals(raw, listed.unionByName(found))


def from_tables(spark, sf_dir: str, written: bool = False) -> Board:
    """The boards of the table source; ``written`` as in :func:`from_relations`."""
    t = lambda n: tables.table(spark, sf_dir, n)
    return from_relations(t("room"), tables.episodes(t("episodes")), t("turn_lines"), t("checks"), t("wakes"), written=written)


def rooms(posts: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row per room, of its latest run; the kind is ``goal-run`` where seats are listed."""
    last = F.struct(F.coalesce("goal.sequence", F.lit(0)), F.col("goal.message_id"))
    e = episodes.groupBy(F.col("room_id").alias("room")).agg(
        F.max_by("name", last).alias("name"), F.max_by("goal.started_at", last).alias("created_at"), F.max_by("state", last).alias("run_state"), F.max_by("ended_by.trigger", last).alias("ended_by"), F.max(F.coalesce(F.size("agents"), F.lit(0)) > 0).alias("seated")
    )
    p = posts.groupBy("room").agg(F.max("seq").alias("latest_sequence"))
    state = F.when(F.col("ended_by").isNotNull(), "closed").otherwise(F.col("run_state"))
    kind = F.when(F.col("seated"), "goal-run").otherwise("goal-export")
    return shaped(p.join(e, "room", "full").withColumn("state", state).withColumn("source_kind", kind), "rooms")


# ---- tools


def agent_posts(posts: DataFrame) -> DataFrame:
    """Posts of working seats: of unknown role or by an agent."""
    return posts.where("role is null or role = 'agent'")


def message_posts(posts: DataFrame) -> DataFrame:
    """Messages between seats: neither notices nor the goal nor the runner's reports."""
    return posts.where("type = 'message' and (role is null or role not in ('goal', 'runner'))")


def commands(ops: DataFrame) -> DataFrame:
    return ops.where("kind = 'command'")


def is_work(kind: Column, command: Column, programs: tuple[str, ...] = PROGRAMS) -> Column:
    """A command that is not talk on the board."""
    return (kind == "command") & ~has_board(command, "board_talk", programs)


def post_ops(ops: DataFrame) -> DataFrame:
    """For each post made by a command: ``room, seq, who, turn, i``; of several commands the last."""
    at = F.struct("who", "turn", "i")
    return ops.where("posted is not null").groupBy("room", F.col("posted").alias("seq")).agg(F.max(at).alias("x")).select("room", "seq", "x.*")


def view_at(board: Board, room: str, seq: int) -> Board:
    """The board as a seat could know it right after a post: posts, checks and artifacts up to it, and turns that had ended."""
    p = board.posts.where((F.col("room") == room) & (F.col("seq") <= seq))
    t = p.agg(F.max_by(F.struct("at_ms"), "seq")["at_ms"].alias("t"))  # one row
    ended = board.wakes.where(F.col("room") == room).join(F.broadcast(t), F.col("end_ms") <= F.col("t")).drop("t")
    done = ended.select("room", "who", "turn").distinct()
    made = board.artifacts.where(F.col("room") == room).withColumn("_ms", epoch_ms(F.col("created_at"))).join(F.broadcast(t), F.col("_ms") <= F.col("t")).drop("t", "_ms")
    return replace(
        board,
        rooms=board.rooms.where(F.col("room") == room).withColumn("latest_sequence", F.lit(seq).cast("bigint")),
        seats=board.seats.where(F.col("room") == room),
        posts=p,
        artifacts=made,
        wakes=ended,
        ops=board.ops.where(F.col("room") == room).join(done, ["room", "who", "turn"], "left_semi"),
        checks=board.checks.where((F.col("room") == room) & (F.coalesce("sequence", F.lit(0)) <= seq)),
    )


def summary(board: Board) -> DataFrame:
    """A few numbers per room: what its source holds."""
    p = board.posts.groupBy("room").agg(
        F.count("*").alias("posts"), F.count_if(F.col("role").isNull() | (F.col("role") == "agent")).alias("agent_posts"),
        F.min_by("at_ms", "seq").alias("_a"), F.max_by("at_ms", "seq").alias("_b"),
    )
    span = F.bround((F.col("_b") - F.col("_a")) / 3600000, 2)
    out = p.withColumn("span_hours", span).drop("_a", "_b")
    out = out.join(board.seats.groupBy("room").agg(F.count("*").alias("seats")), "room", "left")
    out = out.join(board.ops.groupBy("room").agg(F.count("*").alias("ops")), "room", "left")
    out = out.join(board.checks.groupBy("room").agg(F.count("*").alias("checks"), F.count_if("passed").alias("checks_passed")), "room", "left")
    out = out.join(board.wakes.groupBy("room").agg(F.count("*").alias("wakes")), "room", "left")
    out = out.join(board.artifacts.groupBy("room").agg(F.count("*").alias("artifacts")), "room", "left")
    out = out.fillna(0, ["seats", "ops", "checks", "checks_passed", "wakes", "artifacts"])
    return out.join(board.rooms.select("room", "source_kind", "ended_by"), "room", "left")
