"""Problem 2: each post with the turn nearest in time, through a learned index on the turns of a seat.

The turns of one seat on one board within one stretch of time are a shard: sorted arrays of starts and ends, and a
piecewise-linear model that predicts a time's place among the starts with a bounded error. A post is joined with its shard, the model
predicts its place, and a local search of a few entries around it gives the exact neighbours. Only the fitting
runs in Python, once per shard; posts never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.tables import posts, wakes

TOLERANCE_MS = 120_000
#: Width of a shard, and by how much each level of wider shards (for long turns) exceeds the one below.
WIDTH_MS, WIDER = 3_600_000, 8
LEVELS = 12
#: The model's predictions are off by at most so many places.
ERROR = 4

INDEX = "first array<bigint>, slope array<double>, base array<int>, starts array<bigint>, at_start array<bigint>, latest_end array<bigint>, at_latest array<bigint>"


def fit(starts: np.ndarray, error: int = ERROR) -> tuple[list[int], list[float], list[int]]:
    """Segments (first key, slope, base) of a piecewise-linear map from distinct sorted keys to their places, off by at most ``error``.

    A segment grows while one slope serves all of its keys (a cone of slopes that only shrinks), then the next begins.
    """
    first, slope, base = [], [], []
    i, n = 0, len(starts)
    while i < n:
        lo, hi, j = 0.0, np.inf, i + 1
        while j < n:
            dx, dy = float(starts[j] - starts[i]), j - i
            a, b = max(lo, (dy - error) / dx), min(hi, (dy + error) / dx)
            if a > b:
                break
            lo, hi, j = a, b, j + 1
        first.append(int(starts[i]))
        slope.append(0.0 if j == i + 1 else (lo + hi) / 2)
        base.append(i)
        i = j
    return first, slope, base


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for turns in pdf.pop("turns"):
            start = np.array([t["start_ms"] for t in turns], dtype=np.int64)
            end = np.array([t["end_ms"] for t in turns], dtype=np.int64)
            turn = np.array([t["turn"] for t in turns], dtype=np.int64)
            # the first i turns' latest end, and whose it is (the lowest turn among equals)
            order = np.lexsort((turn, start))
            start, end, turn = start[order], end[order], turn[order]
            latest, whose, best = [], [], None
            for e, t in zip(end.tolist(), turn.tolist(), strict=True):
                if best is None or e > best[0] or (e == best[0] and t < best[1]):
                    best = (e, t)
                latest.append(best[0])
                whose.append(best[1])
            last = np.append(start[1:] != start[:-1], True)
            lead = np.append(True, start[1:] != start[:-1])
            keys = start[lead]
            out.append((*fit(keys), keys.tolist(), turn[lead].tolist(), np.array(latest)[last].tolist(), np.array(whose)[last].tolist()))
        names = [x.split()[0] for x in INDEX.split(", ")]
        yield pdf.assign(**{n: [o[k] for o in out] for k, n in enumerate(names)})


def _timed(turns: DataFrame, tolerance_ms: int) -> DataFrame:
    start = F.coalesce("start_ms", "end_ms")
    end = F.when(F.col("end_ms") >= start, F.col("end_ms")).otherwise(start)
    t = turns.select("room_id", "seat", "turn", start.alias("start_ms"), end.alias("end_ms")).where("start_ms is not null")
    span = F.col("end_ms") - F.col("start_ms") + 2 * tolerance_ms
    return t.withColumn("level", F.coalesce(*(F.when(span <= 2 * WIDTH_MS * WIDER**k, F.lit(k)) for k in range(LEVELS)), F.lit(LEVELS)).cast("int"))


def turn_index(turns: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """One row per shard ``room_id, seat, level, shard`` with the arrays of :data:`INDEX`.

    A turn is in every shard that it overlaps, widened by the tolerance on both sides, so a post needs its own shard
    alone. The level is the lowest whose shards are wide enough for the turn, so a turn is in three shards at most.
    A turn with only one usable time, or one that ends before it starts, is its start (or end) alone; one without
    any is in no shard. A seat works one turn after another, which bounds a shard by its width over a turn's length.
    """
    t = _timed(turns, tolerance_ms)
    width = F.lit(WIDTH_MS) * F.pow(F.lit(WIDER), F.col("level")).cast("bigint")
    lo, hi = F.floor((F.col("start_ms") - tolerance_ms) / width), F.floor((F.col("end_ms") + tolerance_ms) / width)
    t = t.withColumn("shard", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    # of turns with the same start in a shard only the latest end and the lowest turn can be nearest
    t = t.groupBy("room_id", "seat", "level", "shard", "start_ms").agg(F.max(F.struct("end_ms", (-F.col("turn")).alias("t"))).alias("m"))
    t = t.select("room_id", "seat", "level", "shard", F.struct("start_ms", F.col("m.end_ms").alias("end_ms"), (-F.col("m.t")).alias("turn")).alias("x"))
    shards = t.groupBy("room_id", "seat", "level", "shard").agg(F.collect_list("x").alias("turns"))
    return shards.mapInPandas(_index, f"room_id string, seat string, level int, shard bigint, {INDEX}")


def _rank(t: Column) -> Column:
    """How many of a shard's starts are not after ``t``: predicted, then counted among the few entries around."""
    seg = F.size(F.filter("first", lambda x: x <= t))
    at = lambda a, i: F.get(F.col(a), i)
    nxt = F.coalesce(at("base", seg), F.size("starts"))
    guess = at("base", seg - 1) + F.floor(at("slope", seg - 1) * (t - at("first", seg - 1))).cast("int") + 1
    guess = F.least(F.greatest(guess, at("base", seg - 1) + 1), nxt)
    lo = F.greatest(guess - ERROR - 2, F.lit(0))
    near = F.slice("starts", lo + 1, F.lit(2 * ERROR + 5))
    return F.when(seg == 0, F.lit(0)).otherwise(lo + F.size(F.filter(near, lambda x: x <= t)))


def nearest_turns(room: DataFrame, raw_wakes: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """``message_id, room_id, seat, turn, distance_ms`` of every post with a turn of its seat within the tolerance.

    Posts without a usable time, a seat or a board match nothing. Of turns at the same distance the lowest counts.
    """
    p = posts(room, ["room_id"]).where("at_ms is not null and seat is not null and room_id is not null").select(F.col("id").alias("message_id"), "room_id", "seat", F.col("at_ms").alias("t"))
    turns = wakes(raw_wakes)
    index = turn_index(turns, tolerance_ms)
    # a post looks into one shard of every level; only long turns are above level 0
    widths = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(WIDTH_MS * WIDER**k).cast("bigint").alias("width")) for k in range(LEVELS + 1)))
    levels = [r.level for r in _timed(turns, tolerance_ms).select("level").distinct().collect()]  # a dozen at most
    p = p.withColumn("w", F.explode(F.filter(widths, lambda w: w["level"].isin(levels or [0]))))
    p = p.select("message_id", "room_id", "seat", "t", F.col("w.level").alias("level"), F.floor(F.col("t") / F.col("w.width")).cast("bigint").alias("shard"))
    j = p.join(index, ["room_id", "seat", "level", "shard"]).withColumn("rank", _rank(F.col("t")))
    before = F.when(F.col("rank") > 0, F.struct(F.greatest(F.lit(0), F.col("t") - F.get("latest_end", F.col("rank") - 1)).cast("bigint").alias("d"), F.get("at_latest", F.col("rank") - 1).alias("turn")))
    after = F.when(F.get("starts", F.col("rank")).isNotNull(), F.struct((F.get("starts", F.col("rank")) - F.col("t")).alias("d"), F.get("at_start", F.col("rank")).alias("turn")))
    best = j.select("message_id", "room_id", "seat", F.least(before, after).alias("b")).where(F.col("b.d") <= tolerance_ms)
    if len(levels) > 1:
        best = best.groupBy("message_id", "room_id", "seat").agg(F.min("b").alias("b"))
    return best.select("message_id", "room_id", "seat", "b.turn", F.col("b.d").alias("distance_ms"))
