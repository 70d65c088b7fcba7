import datetime

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.json_values import strict_json, whole_number
from colloquy.functions.patterns import CASED, CASELESS, has, python
from colloquy.functions.times import epoch_ms
from colloquy.sources.tables import is_blank, seat_name


def values(spark, rows, f, ddl="s string"):
    return [r.v for r in spark.createDataFrame([(x,) for x in rows], ddl).select(f(F.col("s")).alias("v")).collect()]


def test_times(spark):
    t = int(datetime.datetime(2026, 3, 1, 0, 14, 32, 5000, datetime.UTC).timestamp() * 1000)
    same = ["2026-03-01T00:14:32.005Z", "2026-03-01 00:14:32.005", "2026-03-01T08:14:32.005+08:00", "2026-02-28T19:14:32.005-05:00", str(t), " 2026-03-01T00:14:32.005Z "]
    assert values(spark, same, epoch_ms) == [t] * len(same)
    assert values(spark, ["n/a", "", None, "0000-00-00T00:00:00Z", "2026-13-01T00:00:00Z", "12"], epoch_ms) == [None] * 6


def test_redact_and_scrub(spark):
    got = values(spark, ["see https://a.b/c?d and  me@x.example\nnow", "x" * 200, None, "key snk_abcdefghijkl"], T.redact)
    assert got == ["see <url> and <email> now", "x" * 160 + "…", "", "key <token>"]
    assert values(spark, ["a snk_abcdefghijkl me@x.example https://u.v/w"], T.scrub) == ["a <token> <email> https://u.v/w"]


def test_references(spark):
    assert values(spark, ["#3 and #12, &#5; a#6 #3", None], T.cites) == [[3, 12], []]
    assert values(spark, ["#3 a#6 #12345"], T.seqrefs) == [[3, 6]]
    assert values(spark, ["@a-1. hi @b.c. x@y @a-1"], T.mentions) == [["a-1", "b.c"]]
    assert values(spark, ["`Parser.py` and src/x.go, W12 or `a`"], T.items) == [["parser.py", "src/x.go", "w12"]]
    assert values(spark, ["`src/a.py` b.md v1.2.3 `https://x.y` `v2.0`"], T.files) == [["a.py", "b.md"]]


def test_shingles(spark):
    assert values(spark, ["A b, c d e", "a b c", None], T.shingles) == [["a b c d", "b c d e"], [], []]


def test_success(spark):
    yes = ["DONE with it", "all tests pass", "it is done", "I've finished the parser"]
    no = ["not DONE yet", "once it is done we go", "DONEness", "it is not done", None, "if all tests pass then"]
    assert values(spark, yes + no, lambda c: T.success(c)) == [True] * 4 + [False] * 6


def test_unicode_patterns_equal_python(spark):
    texts = ["在done了", "done。", "我来做这个", "由我 a\rb", "frozen？", "waiting on\nyou?", "ok?\nmore", "é done", "I'll take `a.py`", "Still waiting", "status: ok, no change", "", "已完成 `x.md`", "lgtm ship it", "@bob could you run it for me"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for name in [*CASELESS, *CASED]:
        got = {r.i: r.v for r in df.select("i", has(F.col("t"), name).alias("v")).collect()}
        assert got == {i: bool(python(name).search(t)) for i, t in enumerate(texts)}, name


def test_json_values(spark):
    assert values(spark, ['{"a":1}', '{"a":1} x', "1 2", "", "{'a':1}", "[1]"], lambda c: strict_json(c).isNotNull()) == [True, False, False, False, False, True]
    assert values(spark, ["12", '"34"', "5.0", "5.5", '"x"', "null", "true"], lambda c: whole_number(F.try_parse_json(c))) == [12, 34, 5, None, None, None, None]


def test_blank_and_seat(spark):
    assert values(spark, [None, "", " 　​﻿\n", "⠀", "a"], is_blank) == [True, True, True, True, False]
    assert values(spark, [" Tally-1 ", "﻿X　", " ", None], seat_name) == ["tally-1", "x", None, None]


@pytest.mark.parametrize("a,b,want", [([1, 2], [2, 3], 1 / 3), ([], [], 0.0), ([1], [1], 1.0)])
def test_jaccard(spark, a, b, want):
    r = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(T.jaccard(F.col("a"), F.col("b")).alias("v")).first()
    assert r.v == pytest.approx(want)


def test_parse_reply(spark):
    texts = ['{"a": 1}', 'Here:\n```json\n{"a": 1}\n```\nbye', 'so {"a": 1} it is', "none", None, '{"a": ']
    assert values(spark, texts, lambda c: F.try_variant_get(T.parse_reply(c), "$.a", "int")) == [1, 1, 1, None, None, None]
    assert values(spark, ["one\ntwo", None], lambda c: T.first_line(c)) == ["one", ""]
