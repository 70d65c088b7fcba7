"""The board tables as clean relations: one row per post, turn, line and label, seats under one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.times import epoch_ms
from colloquy.session import cut

#: White space, and characters that show nothing: format and control characters, fillers, blank braille.
INVISIBLE = r"[\s\p{Z}\p{Cf}\p{Cc}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}\x{FE00}-\x{FE0F}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_blank(text: Column) -> Column:
    """True for null and for text of nothing but white space and invisible characters."""
    return text.isNull() | text.rlike(rf"^{INVISIBLE}*$")


def seat_name(name: Column) -> Column:
    """A seat's name in lower case without outer blanks; null where nothing is left."""
    t = F.lower(F.regexp_replace(name, rf"^{INVISIBLE}+|{INVISIBLE}+$", ""))
    return F.when(t != "", t)


def posts(room: DataFrame, keep: list[str] | None = None, written: bool = False) -> DataFrame:
    """One row per post ``id``, with ``seat`` and ``at_ms``; of the other columns those in ``keep`` (all, if none are named).

    What isn't kept isn't shuffled: name what a query needs. ``written``: the names of the instances are written before they are joined.

    Repeated deliveries become one row: the first received, with the first usable ``created_at`` among them. A missing
    sender name is the name under which the same ``sender_instance_id`` posts on that board most often (ties: the first
    in order); where it never shows one, the seat is null. Posts without an id are left out: nothing names them.
    """
    r = room.where("id is not null").select("*", epoch_ms(F.col("created_at")).alias("_ms"), seat_name(F.col("sender.name")).alias("_seat"))
    order = F.struct(F.col("received_at"), F.col("created_at"))
    kept = [c for c in room.columns if c != "id" and (keep is None or c in keep)]
    cols = kept + [c for c in ("room_id", "sender_instance_id") if c not in kept]
    one = r.groupBy("id").agg(F.min_by(F.struct(*cols), order).alias("_r"), F.min_by("_ms", F.when(F.col("_ms").isNotNull(), order)).alias("at_ms"), F.max("_seat").alias("_seat"))
    # kept, as it is read for the names and for the posts
    one = cut(one.select("id", *(F.col("_r")[c].alias(c) for c in cols), "at_ms", "_seat"))
    # names seen per instance: two counts, so a busy instance is pre-aggregated before the shuffle
    named = one.where("_seat is not null and sender_instance_id is not null").groupBy("room_id", "sender_instance_id", "_seat").agg(F.count("*").alias("n"))
    named = named.groupBy("room_id", "sender_instance_id").agg(F.max_by("_seat", F.struct("n", "_seat")).alias("_name"))
    named = cut(named) if written else named
    missing = one.where("_seat is null").join(named, ["room_id", "sender_instance_id"], "left").withColumn("_seat", F.col("_name"))
    out = one.where("_seat is not null").unionByName(missing.select(one.columns))
    return out.select("id", *kept, F.col("_seat").alias("seat"), "at_ms")


def posts_numbers(room: DataFrame) -> DataFrame:
    """``r_room, r_id, r_seq``: the number of every post, to resolve references by id."""
    return room.where("id is not null").groupBy(F.col("room_id").alias("r_room"), F.col("id").alias("r_id")).agg(F.min("sequence").alias("r_seq"))


def wakes(raw: DataFrame) -> DataFrame:
    """One row per ``(room_id, seat, turn)`` with ``start_ms`` and ``end_ms``; repeated rows give the known times of any of them."""
    w = raw.select("*", seat_name(F.col("seat")).alias("_seat"), epoch_ms(F.col("started_at")).alias("start_ms"), epoch_ms(F.col("ended_at")).alias("end_ms"))
    keys = ["room_id", "seat", "turn"]
    rest = [c for c in raw.columns if c not in keys]
    w = w.where("room_id is not null and _seat is not null and turn is not null").drop("seat").withColumnRenamed("_seat", "seat")
    agg = [F.first(c, ignorenulls=True).alias(c) if c == "fired" else F.min(c).alias(c) for c in rest]
    return w.groupBy(*keys).agg(*agg, F.min("start_ms").alias("start_ms"), F.min("end_ms").alias("end_ms"))


def checks(raw: DataFrame) -> DataFrame:
    return raw.dropDuplicates().withColumn("at_ms", epoch_ms(F.col("at")))


def episodes(raw: DataFrame) -> DataFrame:
    """One row per run; the key is the goal's message."""
    return raw.where("goal.message_id is not null").dropDuplicates(["room_id", "name", "goal"])


def labels(incidents: DataFrame) -> DataFrame:
    """The latest label of each annotator for each incident, classes in the codebook's spelling, unusable values null.

    Repeated rows count once; of two labels at the same time the higher ``annotation_id`` counts. Latest is by
    ``annotated_at``, null times first.
    """
    keys = ["incident_id", "annotator"]
    rest = [c for c in incidents.columns if c not in keys]
    one = incidents.where("incident_id is not null and annotator is not null").groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("annotated_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("annotation_id"))).alias("_r"))
    out = one.select(*keys, *(F.col("_r")[c].alias(c) for c in rest))
    name = F.regexp_replace(F.lower("class"), r"[^\p{L}]", "")
    return out.withColumn("class", F.when(name.isin("unsaid", "unreceived", "misread", "disagreement", "ungrounded", "stalled"), name)).withColumn("severity", F.when(F.col("severity").between(1, 5), F.col("severity")))
