"""File sources: record folders, room files, table exports, shares and chat logs, many at once by a glob, as boards.

Every reader states its schema; unknown fields are ignored and missing ones are null. A folder or file that a source may lack is an
empty relation. The room of a row is its folder's (or file's) name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.times import epoch_ms
from colloquy.operators import board as B

MESSAGE = "id string, room_id string, sequence bigint, sender_principal_id string, sender_instance_id string, content string, reply_to_message_id string, reply_to_sequence bigint, created_at string, type string, sender struct<member_id: string, name: string, kind: string>"
TABLE_ROW = "kind string, id string, name string, created_at string, state string, instance_id string, display_name string, runtime_kind string, joined_at string, principal_id string, sequence bigint, sender_instance_id string, content string, type string, uploaded_by_instance_id string, filename string, sha256 string"
EPISODE = "room_id string, name string, state string, goal struct<message_id: string, sequence: bigint, until: array<string>, started_at: string>, ended_by struct<trigger: string, at: string, detail: string>, runner struct<started_at: string, ended_at: string, workspace: string>, totals struct<messages: bigint, checks: bigint, snapshots: bigint, tokens: bigint, cached_tokens: bigint>, agents array<struct<name: string, driver: string, model: string, member_id: string, session_id: string, turns: bigint, failed_turns: bigint, tokens: bigint, usage: struct<input: bigint, cached: bigint, output: bigint>>>"
CHECK = "at string, trigger string, command string, cause string, exit_code bigint, passed boolean, sequence bigint, output string"
WAKE = "seat string, turn bigint, wake_id string, fired array<string>, `from` bigint, through bigint, messages bigint, started_at string, ended_at string, exit_code bigint, failed boolean, session_id string, tokens bigint, cut_by_end boolean"
SHARE = "room struct<name: string, created_at: string, latest_sequence: bigint, state: string>, members array<struct<handle: string, label: string, driver: string, joined_at: string, principal: string>>, messages array<struct<sequence: bigint, content: string, created_at: string, reply_to_sequence: bigint, type: string, sender: struct<handle: string>>>"
CHAT = "turn bigint, speaker string, model string, t string, text string"
OP = "seat string, turn bigint, i int, kind string, command string, exit_code bigint, output string, posted bigint, paths array<string>, query string, name string, text string"


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def text(spark: SparkSession, pattern: str, whole: bool = False) -> DataFrame:
    """``value, path`` of the lines (or whole files) that match; empty where nothing does."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "value string, path string")
    return spark.read.text(pattern, wholetext=whole).select("value", F.input_file_name().alias("path"))


def ndjson(spark: SparkSession, pattern: str, schema: str, lines: DataFrame | None = None) -> DataFrame:
    """``path`` and the schema's fields of every line (or of the given ``lines``); blank lines are skipped, a line that is no JSON is an error with its place."""
    rows = (text(spark, pattern) if lines is None else lines).where(F.trim("value") != "")
    parsed = rows.select("path", "value", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    bad = F.raise_error(F.concat(F.lit("no JSON in "), F.col("path"), F.lit(": "), F.substring("value", 1, 80)))
    return parsed.select("path", F.when(F.col("j._bad").isNotNull(), bad).otherwise(F.col("j")).alias("j")).select("path", "j.*").drop("_bad")


def _folder(up: int) -> Column:
    return F.element_at(F.split("path", "/"), -up)


def load_record(spark: SparkSession, path: str) -> B.Board:
    """Record folders: the board that a run left, with the seats' own logs where it has them. ``path`` may be a glob of many.

    A folder needs ``room.ndjson``; a table export inside is read as such, with the actions of ``ops.jsonl``.
    """
    if not exists(spark, f"{path}/room.ndjson"):
        raise ValueError(f"{path} is not a record folder: it has no room.ndjson")
    room = lambda up: _folder(up).alias("room_id")
    tagged, lines = exports(spark, f"{path}/room.ndjson"), None
    of_tables = None
    if not tagged.isEmpty():
        lines = text(spark, f"{path}/room.ndjson")
        board = load_table_export(spark, f"{path}/room.ndjson", _folder(2), "episode", lines.join(tagged, "path", "left_semi"))
        ops = ndjson(spark, f"{path}/ops.jsonl", OP).select(_folder(2).alias("room"), F.col("seat").alias("who"), "*")
        of_tables = B.replace(board, ops=B.shaped(ops.join(tagged.select(_folder(2).alias("room")), "room", "left_semi"), "ops"))
        lines = lines.join(tagged, "path", "left_anti")
        if lines.isEmpty():
            return of_tables
    messages = ndjson(spark, f"{path}/room.ndjson", MESSAGE, lines).drop("room_id").select(room(2), "*").withColumn("received_at", F.lit(None).cast("timestamp"))
    episodes = text(spark, f"{path}/episode.json", whole=True).select("path", F.from_json("value", EPISODE).alias("e")).select(room(2), *(F.col("e")[x].alias(x) for x in ("name", "state", "goal", "ended_by", "runner", "totals", "agents")))
    checks = ndjson(spark, f"{path}/checks.ndjson", CHECK).select(room(2), "*").drop("path")
    wakes = ndjson(spark, f"{path}/wakes.ndjson", WAKE).withColumnRenamed("from", "from_sequence").withColumnRenamed("through", "through_sequence").select(room(2), "*").drop("path")
    turns = text(spark, f"{path}/agents/*/turn-*.jsonl", whole=True)
    logs = turns.select(_folder(4).alias("room_id"), _folder(2).alias("seat"), F.regexp_extract("path", r"turn-(\d+)\.jsonl$", 1).cast("bigint").alias("turn"), "path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    logs = logs.where(F.trim("line") != "").select(F.xxhash64("path", "line_no").alias("line_id"), "room_id", "seat", "turn", F.col("line_no").cast("bigint").alias("line_no"), "line")
    board = B.from_relations(messages.drop("path"), episodes, logs, checks, wakes)
    return board if of_tables is None else union(of_tables, B.replace(board, ops=board.ops.join(tagged.select(_folder(2).alias("room")), "room", "left_anti")))


def load_room_ndjson(spark: SparkSession, path: str) -> B.Board:
    """Room files on their own, and table exports; a glob may hold both, each file is told by its own rows."""
    name = F.regexp_replace(_folder(1), r"\.[^.]*$", "")
    tagged = exports(spark, path)
    if tagged.isEmpty():
        return _load_messages(spark, path, name)
    lines = text(spark, path)
    of_tables = load_table_export(spark, path, name, "export", lines.join(tagged, "path", "left_semi"))
    rest = lines.join(tagged, "path", "left_anti")
    return of_tables if rest.isEmpty() else union(of_tables, _load_messages(spark, path, name, rest))


def union(a: B.Board, b: B.Board) -> B.Board:
    """The boards of two sources, whose rooms differ."""
    return B.Board(**{n: getattr(a, n).unionByName(getattr(b, n)) for n in B.EMPTY}, programs=tuple(sorted({*a.programs, *b.programs})))


def _load_messages(spark: SparkSession, path: str, name: Column, lines: DataFrame | None = None) -> B.Board:
    messages = ndjson(spark, path, MESSAGE, lines).drop("room_id").select(name.alias("room_id"), "*").drop("path").withColumn("received_at", F.lit(None).cast("timestamp"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    board = B.from_relations(messages, none(EPISODE), none("line_id bigint, room_id string, seat string, turn bigint, line_no bigint, line string"), none("room_id string, " + CHECK), none("room_id string, " + WAKE.replace("`from`", "from_sequence").replace("through ", "through_sequence ")))
    first = board.posts.groupBy("room").agg(F.min_by("created_at", "seq").alias("created_at"), F.max("seq").alias("latest_sequence"))
    return B.replace(board, rooms=B.shaped(first.withColumn("name", F.col("room")).withColumn("source_kind", F.lit("room-ndjson")), "rooms"))


def exports(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files whose rows are tagged by ``kind``: table exports, not messages."""
    return text(spark, path).where(F.trim("value") != "").where(F.get_json_object("value", "$.kind").isNotNull()).select("path").distinct()


def load_table_export(spark: SparkSession, path: str, room: Column, kind: str, lines: DataFrame | None = None) -> B.Board:
    """A table export: rows of rooms, members, messages and artifacts in one file, tagged by ``kind``."""
    rows = ndjson(spark, path, TABLE_ROW, lines).withColumnRenamed("kind", "tag").withColumn("room", room)
    of = lambda k: rows.where(F.col("tag") == k)
    posts = of("message").select("room", F.col("sequence").alias("seq"), "id", F.coalesce("sender_instance_id", F.lit("?")).alias("who"), F.coalesce("content", F.lit("")).alias("text"), "created_at", epoch_ms(F.col("created_at")).alias("at_ms"), F.coalesce("type", F.lit("message")).alias("type"))
    seats = of("member").select("room", F.col("instance_id").alias("who"), F.col("display_name").alias("label"), F.col("runtime_kind").alias("driver"), "joined_at", F.col("principal_id").alias("principal"), F.col("instance_id").alias("member_id"))
    seats = seats.withColumn("ord", F.row_number().over(Window.partitionBy("room").orderBy("joined_at", "who")) - 1)
    made = of("artifact").select("room", "id", F.col("uploaded_by_instance_id").alias("who"), "created_at", F.col("filename").alias("name"), "sha256")
    last = posts.groupBy("room").agg(F.max("seq").alias("latest_sequence"))
    rooms = last.join(of("room").select("room", F.col("name").alias("n"), "created_at", "state"), "room", "full").withColumn("name", F.coalesce("n", "room")).withColumn("source_kind", F.lit(kind))
    empty = lambda n: B.empty(spark, n)
    return B.Board(B.shaped(rooms, "rooms"), B.shaped(seats, "seats"), B.shaped(posts, "posts"), B.shaped(made, "artifacts"), empty("ops"), empty("checks"), empty("wakes"))


def load_share(spark: SparkSession, path: str) -> B.Board:
    """Saved shares: posts and seats, without roles, ids or actions."""
    d = text(spark, path, whole=True).select(F.regexp_replace(_folder(1), r"\.[^.]*$", "").alias("room"), F.from_json("value", SHARE).alias("d"))
    m = d.select("room", F.explode("d.messages").alias("m"))
    posts = m.select("room", F.col("m.sequence").alias("seq"), F.coalesce("m.sender.handle", F.lit("?")).alias("who"), F.coalesce("m.content", F.lit("")).alias("text"), F.col("m.created_at").alias("created_at"), epoch_ms(F.col("m.created_at")).alias("at_ms"), F.col("m.reply_to_sequence").alias("reply_to"), F.coalesce("m.type", F.lit("message")).alias("type"))
    seats = d.select("room", F.posexplode("d.members").alias("ord", "s")).select("room", "ord", F.col("s.handle").alias("who"), F.col("s.label").alias("label"), F.col("s.driver").alias("driver"), F.col("s.joined_at").alias("joined_at"), F.col("s.principal").alias("principal"))
    rooms = d.select("room", F.col("d.room.name").alias("name"), F.col("d.room.created_at").alias("created_at"), F.col("d.room.latest_sequence").alias("latest_sequence"), F.col("d.room.state").alias("state"), F.lit("share-file").alias("source_kind"))
    empty = lambda n: B.empty(spark, n)
    return B.Board(B.shaped(rooms, "rooms"), B.shaped(seats, "seats"), B.shaped(posts, "posts"), empty("artifacts"), empty("ops"), empty("checks"), empty("wakes"))


def load_chat_jsonl(spark: SparkSession, path: str) -> B.Board:
    """Chat logs: a turn per line; a missing turn is the line's number from 1, blank lines counted; a speaker's first model counts."""
    whole = text(spark, path, whole=True).select(F.regexp_replace(_folder(1), r"\.[^.]*$", "").alias("room"), F.posexplode(F.split("value", "\n")).alias("n", "line")).where(F.trim("line") != "")
    c = whole.select("room", "n", F.from_json("line", CHAT).alias("c")).select("room", (F.col("n") + 1).alias("n"), "c.*")
    posts = c.select("room", F.coalesce("turn", F.col("n").cast("bigint")).alias("seq"), F.coalesce("speaker", F.lit("?")).alias("who"), F.coalesce("text", F.lit("")).alias("text"), F.col("t").alias("created_at"), epoch_ms(F.col("t")).alias("at_ms"), F.lit("message").alias("type"))
    seats = c.groupBy("room", F.coalesce("speaker", F.lit("?")).alias("who")).agg(F.min_by("model", F.when(F.col("model").isNotNull(), F.col("n"))).alias("model"), F.min("n").alias("ord"))
    rooms = posts.groupBy("room").agg(F.max("seq").alias("latest_sequence"), F.min_by("created_at", "seq").alias("created_at")).withColumn("name", F.col("room")).withColumn("source_kind", F.lit("chat-jsonl"))
    empty = lambda n: B.empty(spark, n)
    return B.Board(B.shaped(rooms, "rooms"), B.shaped(seats, "seats"), B.shaped(posts, "posts"), empty("artifacts"), empty("ops"), empty("checks"), empty("wakes"))


def load(spark: SparkSession, src: str) -> B.Board:
    """The board of any source: a record folder, a saved share (``.json``), else a room file. Links are not fetched."""
    if src.startswith(("http://", "https://")):
        raise ValueError("links are not fetched: save the share and load the file")
    if exists(spark, f"{src}/room.ndjson"):
        return load_record(spark, src)
    return load_share(spark, src) if src.endswith(".json") else load_room_ndjson(spark, src)


def write_jsonl(df: DataFrame, path: str) -> None:
    """The rows as JSON lines, one file per task, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
