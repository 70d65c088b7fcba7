"""Human labels: blind samples with digests, comparison of two raters, adjudication; and rater agreement over large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import mentions, scrub
from colloquy.operators.board import agent_posts
from colloquy.operators.ordered import position
from colloquy.session import cut

#: Fields that a digest covers, in order of their names; a rater must leave them as they are.
FIXED = ["actor", "addressed_to", "choices", "codebook", "content", "context_before", "episode_id", "sample_id", "schema", "seq"]
SCHEMA_TAG = "audit.label.v1"
#: The rows of a rater's file, and of the key that leads back to the boards.
RATED = "actor string, addressed_to array<string>, choices array<string>, codebook string, content string, context_before array<struct<seq: bigint, actor: string, content: string>>, episode_id string, sample_id string, schema string, seq bigint, digest string, labels array<string>, uncertain array<string>"
KEYED = "sample_id string, episode_id string, seq bigint, digest string, trace_digest string, room string"


def canonical(*columns: str) -> Column:
    """JSON of the columns by name, with nulls: the text that digests are taken of."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def digest(*columns: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical(*columns), 256))


def trace_digests(posts: DataFrame) -> DataFrame:
    """``room, trace_digest``: one digest per board over its posts in order, the same whatever the source.

    A digest of a whole board's text in one go would put the board into one task. Posts are hashed first, then the hashes of each stretch of 1,024 numbers, then those of the stretches: no task holds a board's text.
    """
    h = posts.select("room", "seq", F.floor(F.col("seq") / 1024).alias("part"), F.sha2(F.to_json(F.array(F.col("seq").cast("string"), F.col("who"), F.col("text"))), 256).alias("h"))
    join = lambda by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]), ""), 256).alias("h")
    return h.groupBy("room", "part").agg(join("seq")).groupBy("room").agg(join("part")).select("room", F.concat(F.lit("sha256:"), "h").alias("trace_digest"))


def export(posts: DataFrame, choices: list[str], salt: str, context: int | None = 8, codebook: str = "ten_modes") -> DataFrame:
    """Blind rows of all agent posts in an order that the salt decides, with the key columns beside them.

    ``context_before`` holds the ``context`` posts of any role before each, scrubbed (all of them, if it is None: each row then grows with its board); it comes from a join on places, so a board is not
    windowed in one task. The blind file is the row without ``KEY`` columns.
    """
    p = cut(position(posts.select("room", "seq", "who", "text", "role"), ["room"], "seq", "place"))
    base = agent_posts(p).join(trace_digests(posts), "room")
    base = base.select("room", "seq", "place", F.col("who").alias("actor"), mentions(F.col("text")).alias("addressed_to"), scrub(F.col("text")).alias("content"), "trace_digest")
    base = base.withColumn("sample_id", F.concat(F.lit("sample-"), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), "trace_digest", "seq"), 256), 1, 16))).withColumn("episode_id", F.concat(F.lit("episode-"), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), "trace_digest"), 256), 1, 12)))
    if context or context is None:
        last = p.groupBy("room").agg(F.max("place").alias("_last"))
        to = F.col("_last") if context is None else F.least("_last", F.col("place") + context)
        near = p.join(last, "room").where(F.col("place") < to).select("room", F.explode(F.sequence(F.col("place") + 1, to)).alias("place"), F.struct("seq", F.col("who").alias("actor"), scrub(F.col("text")).alias("content")).alias("c"))
        near = near.groupBy("room", "place").agg(F.array_sort(F.collect_list("c")).alias("context_before"))
        base = base.join(near, ["room", "place"], "left")
    none = F.array().cast("array<struct<seq:bigint,actor:string,content:string>>")
    base = base.withColumn("context_before", F.coalesce("context_before", none) if context or context is None else none)
    base = base.withColumn("schema", F.lit(SCHEMA_TAG)).withColumn("codebook", F.lit(codebook)).withColumn("choices", F.array(*map(F.lit, choices)))
    rows = base.withColumn("digest", digest(*FIXED))
    return rows.withColumn("sort_key", F.sha2(F.concat_ws(":", F.lit(salt), F.lit("order"), "sample_id"), 256)).drop("place")


KEY = ["room", "trace_digest", "sort_key"]


def check_labels(rows: DataFrame) -> DataFrame:
    """Problems of a rater's file: edited fixed fields, wrong schema, labels outside the choices, labels both given and uncertain, repeats."""
    twice = F.col("_n") > 1
    p = rows.withColumn("_n", F.count("*").over(Window.partitionBy("sample_id"))).select("sample_id", F.explode(F.array(
        F.when(F.coalesce(F.col("schema") != SCHEMA_TAG, F.lit(True)), "wrong schema"),
        F.when(F.coalesce(digest(*FIXED) != F.col("digest"), F.lit(True)), "a fixed field was edited"),
        F.when(F.col("labels").isNull() | F.col("uncertain").isNull(), "labels and uncertain must be lists"),
        F.when(F.size(F.array_except(F.array_union(F.coalesce("labels", F.array()), F.coalesce("uncertain", F.array())), "choices")) > 0, "unknown label"),
        F.when(F.size(F.array_intersect(F.coalesce("labels", F.array()), F.coalesce("uncertain", F.array()))) > 0, "label both given and uncertain"),
        F.when(twice, "sample twice"),
    )).alias("problem"))
    return p.where("problem is not null")


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("sample_id", F.col("digest").alias("da"), F.col("labels").alias("la"), F.col("uncertain").alias("ua"), "choices", "episode_id")
    y = b.select("sample_id", F.col("digest").alias("db"), F.col("labels").alias("lb"), F.col("uncertain").alias("ub"))
    return x.join(y, "sample_id", "full")


def _told(j: DataFrame) -> tuple[DataFrame, DataFrame]:
    problem = F.when(F.col("da").isNull(), "missing in the first file").when(F.col("db").isNull(), "missing in the second file").when(F.col("da") != F.col("db"), "fixed fields differ")
    return j.where("da = db"), j.select("sample_id", problem.alias("problem")).where("problem is not null")


def pair(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both raters' rows of each sample, and the problems: samples that one file lacks, fixed fields that differ."""
    return _told(_met(a, b))


def kappa(both: Column, only_a: Column, only_b: Column, n: Column) -> Column:
    """Cohen's kappa of a yes/no label from counts; null without decisions or when chance explains everything."""
    neither = n - both - only_a - only_b
    obs = (both + neither) / n
    a, b = (both + only_a) / n, (both + only_b) / n
    exp = a * b + (1 - a) * (1 - b)
    return F.when((n > 0) & (exp != 1), (obs - exp) / (1 - exp))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per label: kappa, decisions, positives of both raters, and decisions left out because either was uncertain."""
    pairs, _ = pair(a, b)
    x = pairs.select("*", F.explode("choices").alias("label"))
    in_ = lambda c: F.array_contains(c, F.col("label"))
    x = x.select("label", in_("la").alias("a"), in_("lb").alias("b"), (in_("ua") | in_("ub")).alias("unsure"))
    sure = ~F.col("unsure")
    g = x.groupBy("label").agg(F.count_if(sure).alias("decisions"), F.count_if("a").alias("positives_a"), F.count_if("b").alias("positives_b"), F.count_if("unsure").alias("uncertain_excluded"), F.count_if(sure & F.col("a") & F.col("b")).alias("_ab"), F.count_if(sure & F.col("a") & ~F.col("b")).alias("_a"), F.count_if(sure & ~F.col("a") & F.col("b")).alias("_b"))
    return g.withColumn("kappa", F.bround(kappa(F.col("_ab"), F.col("_a"), F.col("_b"), F.nullif("decisions", F.lit(0))), 4)).drop("_ab", "_a", "_b")


def compare_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: samples both raters have, their episodes, how many agree in full, and how many are to be adjudicated."""
    pairs, _ = pair(a, b)
    open_ = to_adjudicate(a, b).select("sample_id", F.lit(True).alias("open"))
    j = pairs.join(open_, "sample_id", "left")
    agreed = F.count_if(F.col("open").isNull())
    return j.agg(F.count("*").alias("samples"), F.count_distinct("episode_id").alias("episodes"), agreed.alias("agreed"), F.count_if("open").alias("to_adjudicate"), F.bround(agreed / F.nullif(F.count("*"), F.lit(0)), 4).alias("exact_agreement"))


def to_adjudicate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples on which the raters differ, or either is uncertain."""
    return _differing(pair(a, b)[0])


def _differing(pairs: DataFrame) -> DataFrame:
    differ = (F.array_sort("la") != F.array_sort("lb")) | (F.size("ua") > 0) | (F.size("ub") > 0)
    return pairs.where(differ).select("sample_id", "la", "lb", "ua", "ub")


def finalize(a: DataFrame, b: DataFrame, judged: DataFrame, key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold labels, and the problems: adjudications that are missing or not asked for, samples without a key, undecided labels.

    Agreed labels are kept; where the raters differ the adjudicated ones count; the source comes back from the key.
    """
    # both are written, as every problem has a join of its own with them
    pairs, problems = _told(cut(_met(a, b)))
    open_ = _differing(pairs).select("sample_id")
    j = cut(judged.select("sample_id", F.col("labels").alias("lj"), F.col("uncertain").alias("uj")))
    row = lambda df, p: df.select("sample_id", F.lit(p).alias("problem"))
    problems = problems.unionByName(row(open_.join(j, "sample_id", "left_anti"), "not adjudicated")).unionByName(row(j.join(open_, "sample_id", "left_anti"), "adjudicated without need")).unionByName(row(j.where(F.size("uj") > 0), "adjudicated, but uncertain")).unionByName(row(pairs.join(key, "sample_id", "left_anti"), "no key"))
    g = pairs.join(j, "sample_id", "left").join(key, "sample_id")
    ordered = F.filter("choices", lambda c: F.array_contains(F.coalesce("lj", "la"), c))
    return g.select("sample_id", "episode_id", "room", "trace_digest", "seq", ordered.alias("labels"), F.col("lj").isNotNull().alias("adjudicated")), problems


def class_kappa(labels: DataFrame, classes: list[str], a: str = "A", b: str = "B") -> DataFrame:
    """Per class: kappa of two passes over the incidents that both labelled usably (``incident_id, record, class``)."""
    x = labels.where(F.col("class").isNotNull())
    one = lambda r, n: x.where(F.col("record") == r).groupBy("incident_id").agg(F.min("class").alias(n))
    j = one(a, "ca").join(one(b, "cb"), "incident_id").select("ca", "cb", F.explode(F.array(*map(F.lit, classes))).alias("class"))
    ia, ib = F.col("ca") == F.col("class"), F.col("cb") == F.col("class")
    g = j.groupBy("class").agg(F.count("*").alias("decisions"), F.count_if(ia).alias("positives_a"), F.count_if(ib).alias("positives_b"), F.count_if(ia & ib).alias("_ab"))
    k = kappa(F.col("_ab"), F.col("positives_a") - F.col("_ab"), F.col("positives_b") - F.col("_ab"), F.col("decisions"))
    return g.withColumn("kappa", F.round(k, 4)).drop("_ab")
