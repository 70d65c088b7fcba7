import json

from colloquy.operators import nested as N

LINES = [
    (1, '{"type":"item.completed","item":{"type":"file_change","changes":[null,{"path":"a"},{"path":null},{"path":"b","hunks":[{"path":"no"}]}]},"usage":{"input_tokens":"12"}}'),
    (2, '[{"type":"t","item":"{\\"type\\":\\"error\\",\\"changes\\":{\\"path\\":\\"lone\\"}}"},{"usage":{"input_tokens":7.0}},{"usage":null}]'),
    (2, '[{"type":"t","item":"{\\"type\\":\\"error\\",\\"changes\\":{\\"path\\":\\"lone\\"}}"},{"usage":{"input_tokens":7.0}},{"usage":null}]'),
    (3, "no json"),
    (4, None),
    (5, ""),
    (6, '{"usage":{"input_tokens":1'),
    (7, '{"message":{"usage":{"input_tokens":99}},"a":1,"a":2}'),
    (8, "[]"),
    (9, '"text"'),
    (None, '{"item":{"type":"x"}}'),
]


def frame(spark, rows=LINES):
    return spark.createDataFrame([(i, "r", "s", 1, 1, x) for i, x in rows], "line_id bigint, room_id string, seat string, turn bigint, line_no bigint, line string")


def test_values(spark):
    got = sorted(tuple(r) for r in N.nested_values(frame(spark)).collect())
    assert got == sorted([(1, 0, "item", 0, "file_change"), (1, 0, "change", 1, "a"), (1, 0, "change", 3, "b"), (1, 0, "usage", 0, "12"), (2, 0, "item", 0, "error"), (2, 0, "change", 0, "lone"), (2, 1, "usage", 0, "7")])


def test_empty(spark):
    assert N.nested_values(frame(spark, [])).count() == 0
    assert {k: v.count() for k, v in N.flatten(frame(spark, []), "line_id", "line").items()} == {"$": 0}


def test_tables_keep_the_way_to_the_parent(spark):
    t = N.turn_tables(frame(spark))
    assert t.turns.first().n_lines == 10
    items = {(r.line_id, r.event_pos) for r in t.items.collect()}
    assert {(r.line_id, r.event_pos) for r in t.changes.collect()} <= items
    assert [(r.change_pos, r.path) for r in t.changes.where("line_id = 1").orderBy("change_pos").collect()] == [(1, "a"), (2, None), (3, "b")]


def test_schema_and_flatten_round_trip(spark):
    kinds = {r.path: r.kinds for r in N.infer_schema(frame(spark), "line_id", "line").collect()}
    assert kinds["$"] == ["ARRAY", "OBJECT", "STRING"]
    assert kinds["$[].usage.input_tokens"] == ["DECIMAL"] and kinds["$.usage.input_tokens"] == ["STRING"]
    tables = N.flatten(frame(spark), "line_id", "line")
    paths = {r["path"] for r in tables["$[].item.changes[]"].collect()}
    assert paths == {"a", "b", "lone", None}
    hunks = tables["$[].item.changes[].hunks[]"].collect()
    assert [(r.line_id, r.pos_1, r.pos_2, r.pos_3, r["path"], r.row_id, r.parent_id) for r in hunks] == [(1, 0, 3, 0, "no", "1/0/3/0", "1/0/3")]
    parents = {r.row_id for r in tables["$[].item.changes[]"].collect()}
    assert {r.parent_id for r in hunks} <= parents
    assert {r.parent_id for r in tables["$[].item.changes[]"].collect()} <= {r.row_id for r in tables["$[]"].collect()}


def test_any_depth(spark):
    deep = {"v": 1}
    for _ in range(20):
        deep = {"a": [deep, None]}
    tables = N.flatten(frame(spark, [(1, json.dumps(deep))]), "line_id", "line")
    last = "$" + ".a[]" * 20
    assert [(r["v"], r.row_id) for r in tables[last].collect()] == [("1", "1" + "/0" * 20)]


def test_keys_that_are_data(spark):
    rows = [(n, json.dumps({"by.id": {f"k{n}": {"x": n, "ys": [n, n]}}, "b": n})) for n in range(40)]
    tables = N.flatten(frame(spark, rows), "line_id", "line", map_keys=10)
    assert set(tables) == {"$", "$.by.id{}", "$.by.id{}.ys[]"}
    assert {(r.line_id, r.key_1, r["x"]) for r in tables["$.by.id{}"].collect()} == {(n, f"k{n}", str(n)) for n in range(40)}
    assert {(r.row_id, r.parent_id, r["value"]) for r in tables["$.by.id{}.ys[]"].collect()} == {(f"{n}/k{n}/{i}", f"{n}/k{n}", str(n)) for n in range(40) for i in range(2)}
    assert {r.path for r in N.infer_schema(frame(spark, rows), "line_id", "line", 10).collect()} == {"$", "$.b", "$.by.id", "$.by.id{}", "$.by.id{}.x", "$.by.id{}.ys", "$.by.id{}.ys[]"}


def test_brute_force_on_tables(spark, sf):
    lines = spark.read.parquet(f"{sf}/turn_lines.parquet")
    want = set()
    dec = lambda x: json.loads(x) if isinstance(x, str) and x.strip()[:1] in ("{", "[") else x
    for r in lines.select("line_id", "line").distinct().collect():
        try:
            d = json.loads(r.line)
        except ValueError:
            continue
        for i, e in enumerate(d if isinstance(d, list) else [d]):
            item = dec(e.get("item")) or {}
            if item.get("type") is not None:
                want.add((r.line_id, i, "item", 0, item["type"]))
            ch = dec(item.get("changes"))
            for k, c in enumerate([] if ch is None else ch if isinstance(ch, list) else [ch]):
                if c and c.get("path") is not None:
                    want.add((r.line_id, i, "change", k, c["path"]))
            n = (e.get("usage") or {}).get("input_tokens")
            if n is not None:
                want.add((r.line_id, i, "usage", 0, str(int(float(n)))))
    assert {tuple(r) for r in N.nested_values(lines).collect()} == want
