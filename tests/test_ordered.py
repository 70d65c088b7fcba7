import random

from pyspark.sql import functions as F

from colloquy.operators.ordered import position, previous, running_max


def rows():
    r = random.Random(4)
    out = []
    for key in ("a", "b", None):
        for s in r.sample(range(-50, 400), 120):
            out.append((key, s, r.choice([None, *range(9)])))
    return out


def test_against_loops(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, s int, v int")
    place = {(r.k, r.s): r.position for r in position(df, ["k"], "s", width=16).collect()}
    prev = {(r.k, r.s): r.prev_v for r in previous(df, ["k"], "s", ["v"], width=16).collect()}
    high = {(r.k, r.s): r.m for r in running_max(df, ["k"], "s", F.col("v"), "m", width=16).collect()}
    incl = {(r.k, r.s): r.m for r in running_max(df, ["k"], "s", F.col("v"), "m", inclusive=True, width=16).collect()}
    for key in ("a", "b", None):
        mine = sorted((s, v) for k, s, v in data if k == key)
        for n, (s, v) in enumerate(mine):
            before = [x for _, x in mine[:n] if x is not None]
            assert place[key, s] == n + 1
            assert prev[key, s] == (mine[n - 1][1] if n else None)
            assert high[key, s] == (max(before) if before else None)
            assert incl[key, s] == (max([*before, *([v] if v is not None else [])]) if before or v is not None else None)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, s int, v int")
    assert position(df, ["k"], "s").count() == previous(df, ["k"], "s", ["v"]).count() == running_max(df, ["k"], "s", F.col("v"), "m").count() == 0
