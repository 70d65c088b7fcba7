"""Problem 6: runs of posts that say the same again, found by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.json_values import once
from colloquy.llm.pointers import jump
from colloquy.operators.ordered import previous
from colloquy.session import cut
from colloquy.sources.tables import is_blank, posts

#: A word is taken for a slip of another if the other is in at least so many times as many posts.
SLIP_RATIO = 4


def wording(text: Column) -> Column:
    """The words of a post without numbers, case, spacing, punctuation and symbols, with a blank between."""
    t = F.lower(text)
    # forms of width: full-width letters and digits
    t = F.translate(t, "".join(chr(c) for c in range(0xFF10, 0xFF5B)), "".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B)))
    t = F.regexp_replace(t, r"(?<=\d) ?[ap]\.?m\b\.?", " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}]+", " "))


def _swap(a: Column, b: Column) -> Column:
    same = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return same & (F.levenshtein(a, b) == 2)


def one_slip(a: Column, b: Column) -> Column:
    """A letter added, left out or replaced, or two swapped; in scripts whose words are written with letters."""
    letters = ~F.concat(a, b).rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    return letters & ((F.levenshtein(a, b) == 1) | _swap(a, b))


def _deletions(w: Column) -> Column:
    n = F.length(w)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    return F.array_distinct(F.concat(F.array(w), cuts))


def slips(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Of word pairs ``a, b`` those that are one word but for slips.

    ``words``: ``word, n`` posts of the whole corpus that hold it. One of the pair is far more common and one slip away; or both are one slip
    away from a word far more common than either (found through the deletions they share, not by comparing all words).
    """
    n_of = lambda side: words.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    known = cut(pairs.distinct().join(n_of("a"), "a").join(n_of("b"), "b"))
    rarer, commoner = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    direct = known.where(one_slip(F.col("a"), F.col("b")) & (commoner >= SLIP_RATIO * rarer)).select("a", "b")
    open_ = known.join(direct, ["a", "b"], "left_anti")
    rare = open_.select(F.col("a").alias("r"), F.col("n_a").alias("n_r")).union(open_.select("b", "n_b")).distinct()
    keys = rare.select("r", "n_r", F.explode(_deletions(F.col("r"))).alias("key"))
    common = words.where("n > 1").select(F.col("word").alias("c"), F.col("n").alias("n_c"), F.explode(_deletions(F.col("word"))).alias("key"))
    near = keys.join(common, "key").where(F.col("n_c") >= SLIP_RATIO * F.col("n_r")).where(one_slip(F.col("r"), F.col("c"))).select("r", "c").distinct()
    near = near.groupBy("r").agg(F.collect_set("c").alias("cs"))
    both = open_.join(near.select(F.col("r").alias("a"), F.col("cs").alias("ca")), "a").join(near.select(F.col("r").alias("b"), F.col("cs").alias("cb")), "b")
    return direct.union(both.where(F.arrays_overlap("ca", "cb")).select("a", "b"))


def matched(room: DataFrame) -> DataFrame:
    """Every post with ``prev_id`` and ``same``: whether it says the same as the post before of its seat on its board."""
    p = posts(room, ["room_id", "sequence", "content"]).where("room_id is not null and sequence is not null and seat is not null")
    # a post of numbers or symbols alone has no words: its own text is its wording; a blank one has none
    own = F.coalesce(F.nullif(wording(F.col("content")), F.lit("")), F.regexp_replace(F.lower("content"), r"\s+", ""))
    p = cut(p.select("id", "room_id", "seat", "sequence", "at_ms", F.when(~is_blank(F.col("content")), own).alias("said")))
    words = lambda c: F.split(c, " ")
    vocabulary = p.select(F.explode(F.array_distinct(words("said"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    q = previous(p, ["room_id", "seat"], "sequence", ["id", "said"])
    pair = F.filter(F.arrays_zip(words("prev_said").alias("a"), words("said").alias("b")), lambda x: x["a"] != x["b"])
    differ = F.when(F.col("said") == F.col("prev_said"), F.array().cast("array<struct<a:string,b:string>>")).when(F.size(words("said")) == F.size(words("prev_said")), pair)
    # two slips at most lie between any two words of a pair, so a post of another wording is out at once, however many words differ
    near = lambda x: F.levenshtein(x["a"], x["b"], 4) >= 0
    q = cut(q.select("id", "room_id", "seat", "sequence", "at_ms", "prev_id", once(differ, lambda x: F.when(F.forall(x, near), x)).alias("differ")))
    near = q.where("size(differ) > 0").select("id", F.explode("differ").alias("x")).select("id", "x.a", "x.b")
    fine = near.join(slips(near.select("a", "b"), vocabulary).withColumn("ok", F.lit(1)), ["a", "b"], "left")
    fine = fine.groupBy("id").agg(F.min(F.coalesce("ok", F.lit(0))).alias("ok")).where("ok = 1").select("id", F.lit(True).alias("slip"))
    out = q.join(fine, "id", "left")
    return out.select("id", "room_id", "seat", "sequence", "at_ms", "prev_id", (F.coalesce(F.size("differ") == 0, F.lit(False)) & F.col("differ").isNotNull() | F.coalesce("slip", F.lit(False))).alias("same"))


def runs(room: DataFrame) -> DataFrame:
    """``room_id, seat, first_sequence, last_sequence, n_posts, duration_ms``: each longest run of two or more posts.

    Matching posts point to their predecessor, and the pointers are doubled until all reach the run's start. Blank posts and posts
    of an unknown speaker are in no run; a blank post ends one. ``duration_ms`` is null where no two of a run's times are usable.
    """
    m = cut(matched(room))
    linked = m.where("same").select("id", F.col("prev_id").alias("ptr"))
    starts = linked.select(F.col("ptr").alias("id")).join(linked.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("ptr"))
    ends = jump(linked.unionByName(starts))
    # the same column from the same table: only rows in runs are read again
    return (
        ends.join(m, "id")
        .groupBy("end", "room_id", "seat")
        .agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("n_posts"), F.when(F.count("at_ms") > 1, F.max("at_ms") - F.min("at_ms")).alias("duration_ms"))
        .drop("end")
    )
