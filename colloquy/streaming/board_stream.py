"""Streams of posts (an extension: the batch operators see whole boards, these see posts as they come).

What needs the whole board (unanswered asks, open items) can't be given out early and is not here.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.functions.patterns import has
from colloquy.functions.text import items
from colloquy.functions.times import event_time
from colloquy.session import checkpoint_dir
from colloquy.sources.files import exists
from colloquy.sources.tables import seat_name


#: Later than any time that can be written in four digits of year.
END_MS = 568_971_820_800_000


def read_posts(spark: SparkSession, sf_dir: str, name: str = "room") -> DataFrame:
    """A stream over the files of a table, in its schema."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    # a table is a folder of files, or one file among others
    if exists(spark, f"{sf_dir}/{name}.parquet/*"):
        return r.parquet(f"{sf_dir}/{name}.parquet")
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def timed(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Posts with a usable time as ``ts``, a watermark on it, and one row per id within it (of a batch: one row per id)."""
    p = stream.select(F.col("room_id").alias("room"), "id", F.col("sequence").alias("seq"), seat_name(F.col("sender.name")).alias("who"), F.coalesce("content", F.lit("")).alias("text"), event_time(F.col("created_at")).alias("ts"))
    p = p.where("ts is not null and id is not null")
    if not p.isStreaming:
        return p.dropDuplicates(["id"])
    return p.unionByName(_end(p)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"]).where(F.col("ts") < F.timestamp_millis(F.lit(END_MS)))


def _end(posts: DataFrame) -> DataFrame:
    """An empty stream beside ``posts``, over a folder of its own: a post at the end of time, put there by ``run_available``, moves the watermark past all others."""
    spark = posts.sparkSession
    path = f"{checkpoint_dir(spark)}/end-{uuid.uuid4().hex}"
    spark.createDataFrame([], posts.schema).write.parquet(path)
    return spark.readStream.schema(posts.schema).parquet(path)


def hourly_acts(posts: DataFrame) -> DataFrame:
    """Per room and hour: posts, asks, claims, done reports, heartbeats."""
    t = F.col("text")
    g = posts.groupBy(F.window("ts", "1 hour").alias("w"), "room").agg(F.count("*").alias("posts"), *(F.count_if(has(t, a)).alias(a) for a in ("ask", "accept", "done", "heartbeat")))
    return g.select("room", F.col("w.start").alias("hour"), "posts", "ask", "accept", "done", "heartbeat")


def sessions(posts: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches in which a seat posts with no longer gap than ``gap``."""
    g = posts.where("who is not null").groupBy(F.session_window("ts", gap).alias("w"), "room", "who").agg(F.count("*").alias("posts"))
    return g.select("room", "who", F.col("w.start").alias("first"), F.col("w.end").alias("closed"), "posts")


def _reclaims(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    dones, waiting = map(list, json.loads(state.get[0])) if state.exists else ([], [])
    # a group comes in several Arrow batches, in no order
    for pdf in batches:
        dones += pdf.loc[pdf["done"].astype(bool), ["seq", "who"]].values.tolist()
        waiting += pdf.loc[pdf["claims"].astype(bool), ["seq", "who", "at"]].values.tolist()
    dones.sort()
    seqs, mark, out, still = [d[0] for d in dones], state.getCurrentWatermarkMs(), [], []
    for seq, who, at in sorted(waiting):
        if at > mark:
            still.append((seq, who, at))
        elif n := bisect_left(seqs, seq):
            out.append((*key, seq, who, dones[n - 1][1], dones[n - 1][0]))
    if dones or still:
        state.update((json.dumps((dones, still)),))
    elif state.exists:
        state.remove()
    if still:
        state.setTimeoutTimestamp(min(at for _, _, at in still))
    yield pd.DataFrame(out, columns=["room", "item", "seq", "who", "done_by", "done_seq"])


def reclaims(posts: DataFrame) -> DataFrame:
    """Claims of items that were reported done in an earlier post, with the last such report.

    A claim waits until the watermark passes it, so reports before it may come after it. The state holds the numbers and authors of an item's done reports, and its waiting claims.
    """
    # pandas holds the years 1678 to 2261; the mark of the watermark's column is put on what is cut to them, the time itself is in at
    ts = F.greatest(F.least("ts", F.lit("2262-01-01").cast("timestamp")), F.lit("1700-01-01").cast("timestamp")).alias("ts", metadata={"spark.watermarkDelayMs": 0})
    e = posts.select("room", "seq", F.coalesce("who", F.lit("?")).alias("who"), ts, F.unix_millis("ts").alias("at"), has(F.col("text"), "accept").alias("claims"), has(F.col("text"), "done").alias("done"), F.explode(items(F.col("text"))).alias("item")).where("(claims or done) and seq is not null")
    return e.groupBy("room", "item").applyInPandasWithState(_reclaims, "room string, item string, seq bigint, who string, done_by string, done_seq bigint", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream has now, written to the shared folder and read back.

    The stream ends here: after its last post the watermark passes all of them, in a micro-batch of its own, so windows, sessions and claims still open are given out too.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def run() -> None:
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}-log").trigger(availableNow=True).start(base).awaitTermination()

    run()
    ends = set(re.findall(r"FileSource\[([^\]]*/end-[0-9a-f]{32})\]", stream._jdf.queryExecution().analyzed().toString()))
    for path in ends:
        schema = spark.read.parquet(path).schema
        last = {"id": F.lit(path), "ts": F.timestamp_millis(F.lit(END_MS))}
        spark.range(1).select(*(last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(path)
    if ends:
        run()
    return spark.read.schema(stream.schema).parquet(base)
