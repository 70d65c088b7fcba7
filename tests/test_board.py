import json

import boards
from pyspark.sql import functions as F

from colloquy.operators import board as B

EPISODE = ("r1", "run", None, ("r1-m1", 1, ["after 45m"], "2026-05-01T10:00:00Z"), None, None, None, [("A-1", "codex", "m", "i-A-1", None, 1, 0, 5, None), ("b-2", "claude-code", "m", "i-b-2", None, 1, 0, 5, None)])


def test_roles_and_replies(spark):
    rows = [
        boards.message(1, "goal", "do it", kind="human"),
        boards.message(2, "A-1", "hi", reply=1),
        boards.message(3, " B-2 ", "yes", reply_id="r1-m2"),
        boards.message(4, "runner", "check", type_="notice"),
        boards.message(5, "kim", "hello", kind="human"),
        boards.message(6, "stranger", None, reply_id="nowhere"),
        boards.message(2, "A-1", "hi", reply=1, at="1777629720000"),
    ]
    p = {r.seq: r for r in B.posts(*boards.relations(spark, rows, [EPISODE])[:2]).collect()}
    assert len(p) == 6
    assert {s: r.role for s, r in p.items()} == {1: "goal", 2: "agent", 3: "agent", 4: "runner", 5: "other", 6: "other"}
    assert (p[2].reply_to, p[3].reply_to, p[6].reply_to) == (1, 2, None)
    assert (p[2].who, p[3].who, p[6].text) == ("a-1", "b-2", "")


def test_name_from_instance(spark):
    rows = [boards.message(1, "A-1", "x"), boards.message(2, "A-1", "y")]
    rows[1] = (*rows[1][:10], ("i-A-1", None, "guest"), None)
    p = B.posts(*boards.relations(spark, rows)[:2]).orderBy("seq").collect()
    assert [(r.who, r.role) for r in p] == [("a-1", "agent"), ("a-1", "agent")]


def lines(*events):
    return [(n, "r1", "A-1", 1, n, e if isinstance(e, str) else json.dumps(e)) for n, e in enumerate(events)]


def test_actions_of_both_dialects(spark):
    said = {"type": "item.completed", "item": {"type": "command_execution", "command": 'boardnet say "hi"', "aggregated_output": '{"message": {"id": "r1-m2"}}'.replace("r1-m2", "msg_2"), "exit_code": 0}}
    long = {"type": "item.completed", "item": {"type": "command_execution", "command": "boardnet read", "aggregated_output": '{"sequence": 41}' + "x" * 600, "exit_code": 0}}
    ev = lines(
        {"type": "thread.started"},
        said,
        long,
        "not json",
        {"type": "item.completed", "item": {"type": "file_change", "changes": [{"path": "a/b.py"}, None]}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "t"}, {"type": "tool_use", "id": "u1", "name": "Bash", "input": {"command": "pytest"}}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "c.py"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "is_error": True}]}},
        {"type": "turn.failed", "error": {"message": "limit"}},
    )
    room, _, raw, _, _ = boards.relations(spark, [boards.message(2, "A-1", "hi", mid="msg_2")], lines=ev)
    ops = B.link_posts(B.actions(raw, B.board_programs(raw)), B.posts(room, boards.relations(spark)[1])).orderBy("i").collect()
    assert [(o.i, o.kind) for o in ops] == [(0, "command"), (1, "command"), (2, "file_change"), (3, "message"), (4, "command"), (5, "file_change"), (6, "error")]
    assert ops[0].posted == 2 and ops[0].exit_code == 0
    assert ops[1].read_max == 41 and len(ops[1].output) == 500
    assert ops[2].paths == ["a/b.py"] and ops[5].paths == ["c.py"]
    assert ops[4].exit_code == 1 and ops[6].text == "limit"


def test_view_and_links(spark):
    ops = [boards.op("a", 1, 0, "command", "ls", 0), boards.op("a", 1, 1, "command", "say", 0, posted=2), boards.op("a", 2, 0, "command", "say", 0, posted=2)]
    b = boards.board(spark, [(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], ops)
    assert [tuple(r) for r in B.post_ops(b.ops).collect()] == [("r1", 2, "a", 2, 0)]
    wakes = spark.createDataFrame([("r1", "a", 1, None, None, None, None, 1777629600000, 1777629660000, None, None, None, None), ("r1", "a", 2, None, None, None, None, 1777629600000, 1777629999999999, None, None, None, None)], B.EMPTY["wakes"])
    v = B.view_at(B.replace(b, wakes=wakes), "r1", 2)
    assert v.posts.count() == 2 and {r.turn for r in v.ops.collect()} == {1}
    assert B.summary(b).first().posts == 3


def test_empty_board(spark):
    b = B.from_relations(*boards.relations(spark))
    assert b.posts.count() == b.ops.count() == b.seats.count() == B.summary(b).count() == 0


def test_clashing_extra_columns(spark):
    room, ep, *rest = boards.relations(spark, [boards.message(1, "A-1", "x")], [EPISODE])
    room = room.withColumn("seat", F.lit("q")).withColumn("value", F.lit(1)).withColumn("who", F.lit("z")).drop("seat")
    assert B.posts(room, ep).first().who == "a-1"
