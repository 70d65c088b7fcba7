"""Problem 4: consensus of disagreeing annotators by the triplet moment method.

Given the truth, annotators err apart from one another, so how often three of them give which labels to the same incident is a product
of their confusions, summed over the true values. The rates at which pairs agree beyond chance give, over triplets of annotators, each one's
strength without any truth; the rates of the triples of labels then give the confusions (which wrong value an annotator prefers, or
by how much they shift a severity). Votes are combined with log-odds weights of these confusions. Nothing is estimated from the consensus itself.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut
from colloquy.sources.tables import labels

#: The values a label may have, fixed by the codebook.
CLASSES = ["unsaid", "unreceived", "misread", "disagreement", "ungrounded", "stalled"]
SEVERITIES = ["1", "2", "3", "4", "5"]
DOMAIN = {"class": CLASSES, "severity": SEVERITIES}
#: Annotators whose confusions are solved together: the busiest ones. The table of their triples has at most PANEL^3 / 6 * labels^3 rows, a million for
#: 32 and six labels; all others are solved apart, each against pairs of these.
PANEL = 32
#: Weight of the pooled confusions when an annotator's own are estimated, in labels of one true value.
PRIOR = 4.0
STEPS = 60
#: A vote's code: annotator's place in the panel times this, plus the label's place.
_PLACES = 8


def votes(incidents: DataFrame, least: int = 3) -> DataFrame:
    """``incident_id, field, votes array<struct<annotator, label>>`` of the fields with usable labels of at least ``least`` annotators.

    Only an annotator's latest label counts, whether usable or not; unusable ones give no vote.
    """
    one = labels(incidents.select("annotation_id", "incident_id", "annotator", "class", "severity", "annotated_at"))
    known = lambda f: F.collect_list(F.when(F.col(f).isNotNull(), F.struct("annotator", F.col(f).cast("string").alias("label"))))
    per = one.groupBy("incident_id").agg(*(known(f).alias(f) for f in DOMAIN))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.array_sort(f).alias("votes")) for f in DOMAIN))
    return per.select("incident_id", F.explode(each).alias("x")).select("incident_id", "x.*").where(F.size("votes") >= least)


def _domain() -> Column:
    """The values of the row's field."""
    return F.create_map(*chain.from_iterable((F.lit(f), F.array(*map(F.lit, d))) for f, d in DOMAIN.items()))[F.col("field")]


def _code(vote: Column, domain: Column, panel: list[str]) -> Column:
    """A vote as a number; below 0 for annotators outside the panel."""
    at = F.array_position(F.array(*map(F.lit, panel)), vote["annotator"]) - 1
    return (at * _PLACES + F.when(at < 0, 0).otherwise(F.array_position(domain, vote["label"]) - 1)).cast("int")


def triples(v: DataFrame, panel: list[str]) -> DataFrame:
    """``field, x, y, z, n``: how often three of the panel gave which labels to the same incident, each triple once, codes rising.

    Triples of one incident are those of its panel votes; they are counted before they are shuffled.
    """
    domain = _domain()
    codes = F.array_sort(F.filter(F.transform("votes", lambda x: _code(x, domain, panel)), lambda c: c >= 0))
    after = lambda i, xs: F.slice(xs, i + 2, F.size(xs))
    t = v.select("field", codes.alias("cs")).select("field", "cs", F.posexplode("cs").alias("i", "x")).select("field", "x", after(F.col("i"), F.col("cs")).alias("cs"))
    t = t.select("field", "x", "cs", F.posexplode("cs").alias("i", "y")).select("field", "x", "y", F.explode(after(F.col("i"), F.col("cs"))).alias("z"))
    return t.groupBy("field", "x", "y", "z").agg(F.count("*").alias("n"))


def strengths(pairs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """By annotator and value: how much likelier a vote for the value is where it is true, from pairwise agreement corrected for chance.

    ``pairs[a, b, l, m]``: incidents that a gave l and b gave m. Two annotators' votes for a value covary by its variance times the product of their
    strengths, so three such covariances give each strength; over all triplets by least squares. Annotators without a triplet are of no strength.
    """
    n, k = pairs.shape[0], pairs.shape[2]
    both = pairs.sum((2, 3))
    share = lambda x: np.divide(x, both, out=np.zeros_like(both), where=both > 0)
    out = np.zeros((n, k))
    for q in range(k):
        cov = share(pairs[:, :, q, q]) - share(pairs[:, :, q, :].sum(2)) * share(pairs[:, :, :, q].sum(2))
        for a in range(n):
            own = np.delete(cov[a], a)
            rest = np.delete(np.delete(cov, a, 0), a, 1)
            m = np.delete(both[a], a)
            weight = np.triu(np.minimum(np.minimum(m[:, None], m[None]), np.delete(np.delete(both, a, 0), a, 1)), 1)
            square = (weight * np.outer(own, own) * rest).sum() / max((weight * rest * rest).sum(), 1e-12)
            out[a, q] = np.sqrt(max(square, 0.0) / (prior[q] * (1 - prior[q]) + 1e-12))
    return np.clip(out, 0.02, 0.95)


def _posterior(log_prior: np.ndarray, log_conf: np.ndarray, who: list[np.ndarray], what: list[np.ndarray]) -> np.ndarray:
    s = log_prior + sum(log_conf[a, :, l] for a, l in zip(who, what, strict=True))
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


def solve(codes: np.ndarray, n: np.ndarray, size: int, k: int, n_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prior of the values, the confusions ``[annotator, true value, label]``, and the strengths they start from, of a table of triples over ``n_labels`` labels.

    Starting from the strengths, confusions and prior are fitted to the rates of the triples by monotone steps of maximum likelihood.
    An annotator's rates are drawn towards those of all by ``PRIOR`` labels.
    """
    who, what = [c // _PLACES for c in codes.T], [c % _PLACES for c in codes.T]
    pairs, single = np.zeros((size, size, k, k)), np.zeros((size, k))
    for p in range(3):
        np.add.at(single, (who[p], what[p]), n)
        for q in range(3):
            if p != q:
                np.add.at(pairs, (who[p], who[q], what[p], what[q]), n)
    prior = (single.sum(0) + 1) / (single.sum() + k)
    start = strengths(pairs, prior)
    rate = (single + prior) / (single.sum(1, keepdims=True) + 1)
    conf = rate[:, None, :] * (1 - start[:, :, None]) + start[:, :, None] * np.eye(k)
    conf /= conf.sum(2, keepdims=True)
    # a label is in so many triples
    often = 3 * n.sum() / max(n_labels, 1)
    for _ in range(STEPS):
        post = _posterior(np.log(prior), np.log(conf), who, what) * n[:, None]
        got = np.zeros_like(conf)
        for a, l in zip(who, what, strict=True):
            np.add.at(got, (a, slice(None), l), post)
        conf = _drawn(got, _pool(got), often)
        prior = (post.sum(0) + 1e-3) / (post.sum() + 1e-3 * k)
    return prior, conf, start


def _pool(got: np.ndarray) -> np.ndarray:
    p = got.sum(0) + 1e-3
    return p / p.sum(1, keepdims=True)


def _drawn(got: np.ndarray, pool: np.ndarray, often: float) -> np.ndarray:
    c = got + PRIOR * often * pool + 1e-6
    return c / c.sum(-1, keepdims=True)


_SOLVED = "field string, annotator string, label string, w array<double>, log_prior array<double>, accuracy double, strength double"


def _rows(field: str, annotator: str, prior: np.ndarray, conf: np.ndarray, start: np.ndarray) -> list[tuple]:
    """An annotator's weights: a vote for a label speaks for each value by the logarithm of its rate where that value is true."""
    accuracy = float(prior @ np.diag(conf))
    return [(field, annotator, x, np.log(conf[:, i]).tolist(), np.log(prior).tolist(), accuracy, float(prior @ start)) for i, x in enumerate(DOMAIN[field])]


def weights(v: DataFrame, panel_size: int = PANEL) -> DataFrame:
    """``field, annotator, label, w, log_prior, accuracy, strength``: what each possible vote says of each value, and the annotator's reliability.

    ``accuracy``: how likely a vote is right, by the confusions; ``strength``: by pairwise agreement alone.
    """
    spark = v.sparkSession
    each = v.select("field", F.explode("votes").alias("x")).select("field", "x.*")
    busiest = each.groupBy("annotator").agg(F.count("*").alias("n"), *(F.count_if(F.col("field") == f).alias(f) for f in DOMAIN)).orderBy(F.desc("n"), "annotator").limit(panel_size + 1).collect()
    panel, more = busiest[:panel_size], len(busiest) > panel_size
    names, n_labels = [r["annotator"] for r in panel], {f: sum(r[f] for r in panel) for f in DOMAIN}
    if not names:
        return spark.createDataFrame([], _SOLVED)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["field"].iloc[0]
        pdf = pdf.sort_values(["x", "y", "z"])
        solved = solve(pdf[["x", "y", "z"]].to_numpy(), pdf["n"].to_numpy(dtype=float), len(names), len(DOMAIN[f]), n_labels[f])
        return pd.DataFrame([r for i, a in enumerate(names) for r in _rows(f, a, solved[0], solved[1][i], solved[2][i])], columns=[c.split()[0] for c in _SOLVED.split(", ")])

    # a table that annotators and labels bound, not the incidents
    solved = triples(v, names).groupBy("field").applyInPandas(fit, _SOLVED).collect()
    out = spark.createDataFrame(solved, _SOLVED)
    return out.unionByName(_others(v, names, solved)) if more else out


def _others(v: DataFrame, panel: list[str], solved: list) -> DataFrame:
    """The weights of annotators outside the panel, each from the rates at which it and pairs of the panel gave which labels."""
    prior = {f: np.exp(next(r["log_prior"] for r in solved if r["field"] == f)) for f in {r["field"] for r in solved}}
    conf = {f: np.exp([[r["w"] for r in solved if r["field"] == f and r["annotator"] == a] for a in panel]).transpose(0, 2, 1) for f in prior}
    domain = _domain()
    codes = F.array_sort(F.filter(F.transform("votes", lambda x: _code(x, domain, panel)), lambda c: c >= 0))
    mine = F.filter("votes", lambda x: _code(x, domain, panel) < 0)
    pairs = F.flatten(F.transform("cs", lambda x, i: F.transform(F.slice("cs", i + 2, F.size("cs")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    t = v.select("field", codes.alias("cs"), F.explode(mine).alias("m")).select("field", "m.*", F.explode_outer(pairs).alias("p"))
    t = t.groupBy("field", "annotator", "label", "p.x", "p.y").agg(F.count("*").alias("n"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, a = key
        pi, all_, k = prior[f], conf[f], len(DOMAIN[f])
        pool = np.average(all_, axis=0)
        n_labels = pdf["n"].sum()
        pdf = pdf.dropna(subset=["x", "y"])
        own, n = pool.copy(), pdf["n"].to_numpy(dtype=float)
        said = np.array([DOMAIN[f].index(x) for x in pdf["label"]], dtype=int)
        log = np.log(pi) + sum(np.log(all_[c // _PLACES, :, c % _PLACES]) for c in (pdf[s].to_numpy(dtype=int) for s in "xy")) if len(pdf) else np.zeros((0, k))
        for _ in range(STEPS if len(pdf) else 0):
            s = log + np.log(own[:, said]).T
            s = np.exp(s - s.max(1, keepdims=True))
            post = s / s.sum(1, keepdims=True) * n[:, None]
            got = np.zeros((k, k))
            np.add.at(got, (slice(None), said), post.T)
            own = _drawn(got, pool, max(1.0, n.sum() / max(n_labels, 1)))
        return pd.DataFrame(_rows(f, a, pi, own, np.full(k, np.nan)), columns=[c.split()[0] for c in _SOLVED.split(", ")])

    return cut(t.groupBy("field", "annotator").applyInPandas(fit, _SOLVED))


def consensus(incidents: DataFrame, panel_size: int = PANEL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The consensus (``incident_id, field, post`` as ``array<struct<k, p>>``), the votes it rests on, and the annotators' weights.

    Empty input, or incidents that fewer than three annotators labelled usably, give no row. Equal probabilities go to the
    value that is last in order.
    """
    v = cut(votes(incidents))
    w = weights(v, panel_size)
    size = max(map(len, DOMAIN.values()))
    sums = [F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(size)]
    each = v.select("incident_id", "field", F.explode("votes").alias("x")).select("incident_id", "field", "x.*").join(w, ["field", "annotator", "label"])
    per = each.groupBy("incident_id", "field").agg(*sums, F.first("log_prior").alias("l"))
    scores = F.zip_with(F.slice(F.array(*(f"s{i}" for i in range(size))), F.lit(1), F.size("l")), "l", lambda a, b: a + b)
    per = per.select("incident_id", "field", scores.alias("s")).withColumn("s", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    p = F.transform("s", lambda x: x / F.aggregate("s", F.lit(0.0), lambda acc, y: acc + y))
    return per.select("incident_id", "field", F.zip_with(_domain(), p, lambda k, q: F.struct(k.alias("k"), q.alias("p"))).alias("post")), v, w


def _best() -> Column:
    return F.array_max(F.transform("post", lambda x: F.struct(x["p"].alias("p"), x["k"].alias("k"))))


def found(incidents: DataFrame) -> DataFrame:
    """``incident_id, field_name, field_value``: the consensus value of each field of each incident."""
    post, _, _ = consensus(incidents)
    return post.select("incident_id", F.col("field").alias("field_name"), _best()["k"].alias("field_value"))


def agreement(incidents: DataFrame) -> DataFrame:
    """Per incident and field: ``n_votes``, the consensus, its probability and the share of votes that agree with it."""
    post, v, _ = consensus(incidents)
    j = v.join(post.select("incident_id", "field", _best().alias("b")), ["incident_id", "field"])
    with_ = F.size(F.filter("votes", lambda x: x["label"] == F.col("b.k")))
    return j.select("incident_id", F.col("field").alias("field_name"), F.col("b.k").alias("field_value"), F.round("b.p", 6).alias("probability"), F.size("votes").cast("bigint").alias("n_votes"), (with_ / F.size("votes")).alias("agreement"))


def reliability(incidents: DataFrame) -> DataFrame:
    """Per annotator and field: votes, accuracy by the triplet method (and by pairwise agreement alone, null outside the panel), and expected accuracy against the consensus."""
    post, v, w = consensus(incidents)
    own = w.groupBy("field", "annotator").agg(F.first("accuracy").alias("triplet_accuracy"), F.first(F.nanvl("strength", F.lit(None))).alias("pairwise_strength"))
    each = v.join(post, ["incident_id", "field"]).select("field", "post", F.explode("votes").alias("x")).select("field", "post", "x.*")
    hit = F.coalesce(F.get(F.filter("post", lambda x: x["k"] == F.col("label")), 0)["p"], F.lit(0.0))
    seen = each.groupBy("field", "annotator").agg(F.count("*").alias("n_votes"), F.avg(hit).alias("consensus_accuracy"))
    return seen.join(own, ["field", "annotator"]).withColumnRenamed("field", "field_name")
