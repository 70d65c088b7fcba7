import json

import boards
import pytest
from pyspark.sql import functions as F

from colloquy import contract
from colloquy.cli import main
from colloquy.operators import audit
from colloquy.operators import board as B
from colloquy.sources import files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def lines(*rows):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


@pytest.fixture
def record(tmp_path):
    d = tmp_path / "run1"
    say = {"type": "item.completed", "item": {"type": "command_execution", "command": "boardnet say hello", "aggregated_output": '{"message": {"id": "msg_2"}}', "exit_code": 0}}
    put(d / "room.ndjson", lines({"id": "msg_1", "sequence": 1, "content": "goal", "sender": {"name": "kim", "kind": "human"}}, {"id": "msg_2", "sequence": 2, "content": "hello `a.py`", "reply_to_message_id": "msg_1", "sender_instance_id": "i1", "created_at": "2026-05-01T10:00:00Z", "sender": {"name": "other"}}) + "\n")
    put(d / "episode.json", json.dumps({"room_id": "rom", "name": "n", "goal": {"message_id": "msg_1", "sequence": 1}, "agents": [{"name": "Codex-1", "driver": "codex", "member_id": "i1"}], "unknown": 1}))
    put(d / "wakes.ndjson", lines({"seat": "codex-1", "turn": 1, "from": 1, "through": 1, "started_at": "2026-05-01T09:59:00Z", "ended_at": None}))
    put(d / "agents/codex-1/turn-001.jsonl", lines({"type": "thread.started"}) + "broken\n" + lines(say))
    return d


def test_record(spark, record):
    b = files.load(spark, str(record))
    assert [(p.room, p.seq, p.who, p.role, p.reply_to) for p in b.posts.orderBy("seq").collect()] == [("run1", 1, "kim", "goal", None), ("run1", 2, "codex-1", "agent", 1)]
    o = b.ops.first()
    assert (o.who, o.turn, o.i, o.posted) == ("codex-1", 1, 0, 2)
    assert b.wakes.first().through_sequence == 1 and b.checks.count() == 0
    assert b.rooms.first().source_kind == "goal-run"
    many = files.load_record(spark, str(record.parent / "*"))
    assert many.posts.count() == 2
    put(record.parent / "run2/room.ndjson", lines({"kind": "message", "sequence": 7, "sender_instance_id": "m1", "content": "b"}))
    put(record.parent / "run2/ops.jsonl", lines({"seat": "m1", "turn": 1, "i": 0, "kind": "command", "command": "ls"}))
    many = files.load_record(spark, str(record.parent / "*"))
    assert {(p.room, p.seq, p.role) for p in many.posts.collect()} == {("run1", 1, "goal"), ("run1", 2, "agent"), ("run2", 7, None)}
    assert {(o.room, o.command) for o in many.ops.collect()} >= {("run2", "ls")} and many.ops.where("room = 'run1'").count() == b.ops.count()
    with pytest.raises(ValueError):
        files.load_record(spark, str(record / "agents"))


def test_room_file_and_export(spark, tmp_path):
    put(tmp_path / "plain.ndjson", lines({"sequence": 1, "id": "a", "content": "x", "sender": {"name": "s"}, "created_at": "2026-05-01T10:00:00Z"}))
    b = files.load(spark, str(tmp_path / "plain.ndjson"))
    assert b.seats.first().who == "s" and b.rooms.first().source_kind == "room-ndjson"
    put(tmp_path / "export.ndjson", lines({"kind": "room", "id": "r", "name": "nice"}, {"kind": "member", "instance_id": "m1", "display_name": "M"}, {"kind": "message", "sequence": 2, "sender_instance_id": "m1", "content": "b"}, {"kind": "message", "sequence": 1, "content": None}, {"kind": "artifact", "id": "f", "uploaded_by_instance_id": "m1", "filename": "x.zip"}))
    b = files.load(spark, str(tmp_path / "export.ndjson"))
    assert [(p.seq, p.who, p.text, p.role) for p in b.posts.orderBy("seq").collect()] == [(1, "?", "", None), (2, "m1", "b", None)]
    assert (b.artifacts.first().who, b.rooms.first().name, b.rooms.first().source_kind) == ("m1", "nice", "export")
    # a glob of both: each file is told by its own rows
    b = files.load_room_ndjson(spark, str(tmp_path / "*.ndjson"))
    assert {(r.room, r.source_kind) for r in b.rooms.collect()} == {("plain", "room-ndjson"), ("export", "export")}
    assert {(p.room, p.seq, p.who) for p in b.posts.collect()} == {("plain", 1, "s"), ("export", 1, "?"), ("export", 2, "m1")}
    put(tmp_path / "bad.ndjson", '{"sequence": 1}\nnope\n')
    with pytest.raises(Exception, match="no JSON in"):
        files.ndjson(spark, str(tmp_path / "bad.ndjson"), files.MESSAGE).collect()


def test_share_and_chat(spark, tmp_path):
    put(tmp_path / "s.json", json.dumps({"room": {"name": "R"}, "members": [{"handle": "a"}], "messages": [{"sequence": 1, "content": "q?", "sender": {"handle": "a"}}, {"sequence": 2, "content": None, "reply_to_sequence": 1}]}))
    b = files.load(spark, str(tmp_path / "s.json"))
    assert [(p.seq, p.who, p.reply_to, p.role) for p in b.posts.orderBy("seq").collect()] == [(1, "a", None, None), (2, "?", 1, None)]
    put(tmp_path / "c.jsonl", lines({"speaker": "a", "text": "x", "model": None}) + "\n" + lines({"speaker": "a", "text": "y", "model": "m"}, {"turn": 9, "speaker": "b", "text": "z"}))
    b = files.load_chat_jsonl(spark, str(tmp_path / "c.jsonl"))
    assert [p.seq for p in b.posts.orderBy("seq").collect()] == [1, 3, 9]
    assert {s.who: s.model for s in b.seats.collect()} == {"a": "m", "b": None}
    with pytest.raises(ValueError):
        files.load(spark, "https://x.example/shr")


def test_contract(spark, record, tmp_path):
    b = files.load(spark, str(record))
    for name in contract.registry():
        a = contract.get_annotator(name)
        assert contract.check_annotator(a) == []
        out = contract.run(name, b)
        assert contract.validate_output(a, out) == [], name
        assert sorted(map(str, out.collect())) == sorted(map(str, contract.run(name, b).collect()))
    a = contract.get_annotator("modes_v1")
    files.write_jsonl(contract.records(a, b, contract.run("modes_v1", b)), str(tmp_path / "rec"))
    back = spark.read.json(str(tmp_path / "rec"))
    assert back.count() == 10 and contract.validate_records(back).count() == 0
    broken = back.withColumn("output", back.output.withField("count", F.lit("many")))
    assert [(r.problem, r.n) for r in contract.validate_records(broken).collect()] == [("output breaks its schema", 10)]
    assert contract.validate_records(back.withColumn("output", back.output.withField("more", F.lit(1)))).first().n == 10

    class Bad:
        name, version, schema, taxonomy = "9", "", "x y z", "none"

    assert len(contract.check_annotator(Bad)) == 5
    assert contract.validate_output(a, b.posts) != []
    assert contract.check_codebook(contract.codebook("ten_modes")) == contract.check_codebook(contract.codebook("state_gap", True)) == []
    assert len(contract.check_codebook({"id": "x", "labels": [{"id": "a"}, {"id": "a"}]})) == 2


def test_cli(spark, record, tmp_path, capsys):
    assert main(["annotators"]) == main(["sources"]) == main(["taxonomy", "state_gap"]) == main(["schema", "facts_v1"]) == 0
    assert main(["taxonomy", "nope"]) == 1 and main(["schema", "nope"]) == 1
    assert main(["new", "my_own", "-o", str(tmp_path)]) == 0 and main(["new", "No", "-o", str(tmp_path)]) == 1
    scope = {}
    exec((tmp_path / "my_own.py").read_text(), scope)
    assert contract.check_annotator(scope["Annotator"]) == []
    assert main(["analyse", str(record), "--markdown", "run1"]) == 0 and "| HB |" in capsys.readouterr().out
    assert main(["analyse", str(record), "--annotator", "facts_v1", "--markdown", "run1"]) == 0
    assert main(["analyse", str(record), "--annotator", "kickstart", "-o", str(tmp_path / "out")]) == 0
    assert main(["trace", str(record), "--full", str(tmp_path / "full")]) == 0
    assert spark.read.json(str(tmp_path / "full/posts")).count() == 2
    assert main(["export", str(record), "--salt", "s", "-o", str(tmp_path / "audit")]) == 0
    blind = spark.read.json(str(tmp_path / "audit/blind"))
    assert "room" not in blind.columns and blind.count() == spark.read.json(str(tmp_path / "audit/key")).count() == 1
    assert main(["analyse", str(tmp_path / "missing"), "--source", "record"]) == 1
    # two raters who differ, an adjudicator, and the labels back at their board
    files = {n: str(tmp_path / n) for n in ("a", "b", "judged", "broken")}
    label = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rated = spark.read.schema(audit.RATED).json(str(tmp_path / "audit/blind"))
    for n, x in (("a", label("R1")), ("b", label("B1")), ("judged", label("B1", "R1"))):
        rated.withColumn("labels", x).write.option("ignoreNullFields", "false").json(files[n])
    rated.withColumn("content", F.lit("edited")).write.json(files["broken"])
    assert main(["compare", files["a"], files["b"], "-o", str(tmp_path / "report")]) == 0
    assert spark.read.json(str(tmp_path / "report/adjudicate")).count() == 1 and spark.read.json(str(tmp_path / "report/summary")).first().exact_agreement == 0.0
    assert main(["compare", files["a"], files["broken"]]) == 1
    assert main(["finalize", files["a"], files["b"], files["judged"], str(tmp_path / "audit/key"), "-o", str(tmp_path / "gold")]) == 0
    gold = spark.read.json(str(tmp_path / "gold")).first()
    assert (gold.labels, gold.room, gold.adjudicated) == (["R1", "B1"], "run1", True)
    assert main(["codebook", "state_gap:groups"]) == 0
    capsys.readouterr()


def test_stream_equals_batch(spark, sf):
    from colloquy.streaming import board_stream as S

    batch = S.hourly_acts(S.timed(spark.read.parquet(f"{sf}/room.parquet").dropDuplicates(["id"])))
    out = S.run_available(S.hourly_acts(S.timed(S.read_posts(spark, sf), late="1 second")))
    last = batch.agg(F.max("hour")).first()[0]
    # the hour that the watermark hasn't passed is still open
    got = set(map(tuple, out.collect()))
    assert got <= set(map(tuple, batch.collect())) and got >= set(map(tuple, batch.where(F.col("hour") < last).collect()))
    assert S.run_available(S.sessions(S.timed(S.read_posts(spark, sf)))).count() > 0
    assert set(S.run_available(S.reclaims(S.timed(S.read_posts(spark, sf)))).columns) == {"room", "item", "seq", "who", "done_by", "done_seq"}


def test_registered_streams_are_whole(spark, sf):
    from colloquy.plans.stream_queries import QUERIES
    from colloquy.streaming import board_stream as S

    batch = S.timed(spark.read.parquet(f"{sf}/room.parquet"))
    for name, make in (("stream_hourly_acts", S.hourly_acts), ("stream_sessions", S.sessions)):
        rows = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
        want = make(batch).select(*(F.unix_millis(c).alias(c) if t == "timestamp" else F.col(c) for c, t in make(batch).dtypes))
        assert sorted(rows) == sorted(map(tuple, want.collect())) and rows


def test_stream_in_several_batches(spark, tmp_path):
    from colloquy.streaming import board_stream as S

    rows = [boards.message(n, "a", "I'll take `x.py`", at=f"2026-05-0{1 + n}T10:00:00Z") for n in range(4)]
    for r in rows:
        spark.createDataFrame([r], boards.ROOM).coalesce(1).write.mode("append").parquet(str(tmp_path / "room.parquet"))
    posts = spark.readStream.schema(boards.ROOM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "room.parquet"))
    assert S.run_available(S.hourly_acts(S.timed(posts, late="9 days"))).count() == 4
    assert S.run_available(S.timed(posts, late="9 days")).count() == 4


def test_stream_reclaims_equal_batch(spark, tmp_path):
    import random

    from colloquy.operators.ordered import running_max
    from colloquy.streaming import board_stream as S

    say = lambda n: f"`x.py` is done {n}" if n % 7 == 3 else f"I'll take `x.py` {n}"
    rows = [boards.message(n, "abc"[n % 3], say(n), at=str(1777629600000 + n * 1000)) for n in range(1, 1500)]
    random.Random(5).shuffle(rows)
    rows += [boards.message(1500, "a", "I'll take `x.py`", at="9999-12-31T23:59:59Z")]
    path = str(tmp_path / "room.parquet")
    for a in range(0, len(rows), 600):
        spark.createDataFrame(rows[a : a + 500], boards.ROOM).coalesce(1).write.mode("append").parquet(path)
    e = S.timed(spark.read.parquet(path)).select(F.lit("r1").alias("room"), F.lit("x.py").alias("item"), "seq", "who", F.col("text").contains("done").alias("done"))
    e = running_max(e, ["room", "item"], "seq", F.when(F.col("done"), F.struct("seq", "who")), "last")
    want = sorted(map(tuple, e.where("not done and last is not null").select("room", "item", "seq", "who", "last.who", "last.seq").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for files in (None, 1):
            r = spark.readStream.schema(boards.ROOM)
            posts = (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)
            assert sorted(map(tuple, S.run_available(S.reclaims(S.timed(posts))).collect())) == want and len(want) > 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_posts_of_no_type(spark):
    assert B.empty(spark, "posts").count() == 0
