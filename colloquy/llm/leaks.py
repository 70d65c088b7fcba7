"""Problem 8: held-out items whose passages stand in documents, by latent semantic retrieval and alignment.

Documents become sequences of hashed words, once. Windows of them are passages; a randomised SVD of the TF-IDF matrix of all passages
(accumulated over the cluster, one small matrix per task) gives a latent space, in which each passage seeks the items'
passages by cosine. What it finds is aligned word by word: a common subsequence that is dense on both sides, that carries the
item's own answer (the words that the items' common phrasing doesn't foretell) and that no other item explains better, is a leak.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut

#: Passages: their length and step in tokens (a word, or one character of a script without spaces).
WINDOW, STEP, ITEM_STEP = 24, 12, 8
RANK, POWER_ROUNDS, SEED = 96, 1, 11
#: Least cosine of a passage and an item's passage.
COSINE = 0.5
#: A leak: so many words (or characters of a script without spaces) of the item, of which at most about this share is altered, missing or added.
WORDS, CHARS, ALTERED = 12, 24, 0.2
#: A passage holds at least so many of the item's terms; less can't make a leak within one window.
LEAST = 9
#: What the least leak scores in the alignment: twelve words, two of them altered.
LEAST_SCORE = 6.5
#: Least share of what the aligned span of the item says that must be matched: its words' surprise beside their neighbours.
ANSWER = 0.5
#: Items are sought in blocks of about so many: what the driver and each task hold of them at once. Results don't depend on it.
BLOCK = 2000
#: Pairs that are aligned at once.
PAIRS = 4096

# Cyrillic, Greek and small-capital letters that look like Latin ones.
LOOKALIKES = str.maketrans(
    "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u051b\u051d\u04bb\u0432\u043a\u043c\u043d\u0442\u03bf\u03b1\u03b5\u03b9\u03ba\u03bd\u03c1\u03c4\u03c5\u03c7\u0131\u0261",
    "aeopcyxijsdqwhbkmhtoaeikvptuxig",
)
#: Marks and invisible characters are dropped, look-alikes replaced.
_PLAIN = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) in ("Mn", "Cf")} | LOOKALIKES
_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrtbf])|%([0-9A-Fa-f]{2})(?=%|\b|\w)")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")


def tokens(text: str) -> list[str]:
    """Words in lower case and plain letters; escapes of JSON and HTML are read, marks, punctuation and invisible characters dropped."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPES.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if not text.isascii():
        # words that mix scripts, or stand among Latin ones, are Latin in disguise
        return _TOKEN.findall(unicodedata.normalize("NFKD", text).casefold().translate(_PLAIN))
    return _TOKEN.findall(text.lower())


def hashed(words: list[str], known: dict[str, int] | None = None) -> np.ndarray:
    """Words as numbers; ``known`` keeps those of words that came before."""
    known = {} if known is None else known
    if len(known) > 1 << 20:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = zlib.crc32(w.encode())
    return np.array([known[w] for w in words], dtype=np.uint32).view(np.int32)


def sentences(text: str | None) -> list[list[str]]:
    return [w for x in _SENTENCE.split(text or "") if (w := tokens(x))]


@dataclass
class Items:
    """A block of items' passages in a vocabulary of their own terms."""

    vocabulary: np.ndarray  # hashes, sorted
    wide: np.ndarray  # whether a term is a character of a script without spaces
    ids: list[int]  # item of each segment
    segments: list[np.ndarray]  # term numbers; standing sentences are cut out
    surprise: list[np.ndarray]  # of each word of the segments
    windows: np.ndarray  # padded term numbers of the passages, -1 for none
    owner: np.ndarray  # segment of each passage

    def numbers(self, seq: np.ndarray) -> np.ndarray:
        """Hashed words as term numbers, -1 for any word that no item has."""
        at = np.searchsorted(self.vocabulary, seq)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == seq, at, -1).astype(np.int32)


def item_block(segments: list[tuple[int, list[str], list[float]]]) -> Items:
    """``segments``: item, words and their surprise of each run of an item's own sentences."""
    words = sorted({w for _, ws, _ in segments for w in ws})
    vocabulary, first = np.unique(hashed(words), return_index=True)
    wide = np.array([len(w) == 1 and ord(w) > 0x2FFF for w in words], dtype=bool)[first]
    each = [np.searchsorted(vocabulary, hashed(ws)).astype(np.int32) for _, ws, _ in segments]
    windows, owner = [], []
    for k, seg in enumerate(each):
        for a in range(0, max(1, len(seg) - WINDOW + ITEM_STEP), ITEM_STEP):
            w = np.full(WINDOW, -1, dtype=np.int32)
            part = seg[a : a + WINDOW]
            w[: len(part)] = part
            windows.append(w)
            owner.append(k)
    return Items(vocabulary, wide, [i for i, _, _ in segments], each, [np.array(x) for _, _, x in segments], np.array(windows, dtype=np.int32).reshape(-1, WINDOW), np.array(owner, dtype=int))


def passages(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and padded windows of a document; every leak lies wholly in one, so one with few of the items' terms holds none."""
    n = max(1, -(-max(len(seq) - WINDOW, 0) // STEP) + 1)
    padded = np.full((n - 1) * STEP + WINDOW, -1, dtype=np.int32)
    padded[: len(seq)] = seq
    w = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
    keep = (w >= 0).sum(1) >= LEAST
    return (np.arange(n) * STEP)[keep], w[keep]


def batch_passages(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and window of all passages of a batch."""
    each = [passages(s) for s in seqs]
    owner = np.repeat(np.arange(len(seqs)), [len(a) for a, _ in each])
    empty = np.zeros((0, WINDOW), dtype=np.int32)
    return owner, np.concatenate([np.zeros(0, dtype=int), *(a for a, _ in each)]), np.concatenate([empty, *(w for _, w in each)])


def unit_weights(w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the windows' places, such that a window's vector has unit length; a term's places share its weight."""
    x = np.where(w >= 0, weight[w], 0.0).astype(np.float32)
    # a term that stands in k places of a window counts k times: its square is k times what its places give alone
    same = (w[:, :, None] == w[:, None, :]).sum(2, dtype=np.float32)
    return x / np.maximum(np.sqrt((x * x * same).sum(1, keepdims=True)), 1e-9)


def in_blocks(w: np.ndarray, weight: np.ndarray, rows: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for a in range(0, len(w), rows):
        yield a, w[a : a + rows], unit_weights(w[a : a + rows], weight)


def project(w: np.ndarray, x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The windows' vectors times ``basis``: sums of its rows, whatever the number of terms."""
    return np.einsum("np,npr->nr", x, basis[w], optimize=True)


def range_step(w: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The TF-IDF matrix, transposed, times itself, times ``basis``."""
    out = np.zeros(basis.shape, dtype=np.float32)
    for _, part, x in in_blocks(w, weight):
        y = project(part, x, basis)
        order = np.argsort(part, axis=None, kind="stable")
        terms, flat = part.ravel()[order], x.ravel()[order]
        known = np.searchsorted(terms, 0)
        if known < len(terms):
            first = known + np.flatnonzero(np.append(True, terms[known + 1 :] != terms[known:-1]))
            rows = y[order // part.shape[1]] * flat[:, None]
            out[terms[first]] += np.add.reduceat(rows, first, axis=0)
    return out


def _columns(parts: np.ndarray, segments: np.ndarray) -> Iterator[np.ndarray]:
    """Local alignment of many pairs at once (rows padded with -1 and -2), place by place of the segments: the scores, doubled, by place of the part and pair.

    A match is worth 1, a word altered, missing or added costs 1.5. The array is reused.
    """
    w, s = np.ascontiguousarray(parts.T), np.ascontiguousarray(segments.T)
    n, p = w.shape
    h, cell, spare = np.zeros((n + 1, p), dtype=np.int16), np.empty((n, p), dtype=np.int16), np.empty(p, dtype=np.int16)
    for row in s:
        np.multiply(w == row, np.int16(5), out=cell, casting="unsafe")
        cell -= 3
        cell += h[:-1]
        np.maximum(cell, h[1:] - np.int16(3), out=cell)
        np.maximum(cell, 0, out=cell)
        for i in range(1, n):
            np.subtract(cell[i - 1], 3, out=spare)
            np.maximum(cell[i], spare, out=cell[i])
        h[1:] = cell
        yield h


def scores(parts: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """The best local alignment of each pair, doubled."""
    top = np.zeros((parts.shape[1] + 1, len(parts)), dtype=np.int16)
    for h in _columns(parts, segments):
        np.maximum(top, h, out=top)
    return top.max(0)


@dataclass
class Alignment:
    """Matches (their places in the item), and the spans in the document's part and in the item (end exclusive)."""

    matched: list[int]
    i0: int
    i1: int
    j0: int
    j1: int

    def dense(self, chars: bool) -> bool:
        """Whether it is long and dense enough for a leak."""
        hits, span = len(self.matched), max(self.i1 - self.i0, self.j1 - self.j0)
        # a number is one token, but several characters
        least, spare = (CHARS, 4) if chars else (WORDS, 1)
        return span >= least - spare and hits >= (1 - ALTERED) * least and hits >= (1 - ALTERED - 0.05) * span

    def answers(self, surprise: np.ndarray) -> bool:
        """Whether it carries what tells the item from the others: at least so much of the surprise of its span's words."""
        return surprise[self.matched].sum() >= ANSWER * surprise[self.j0 : self.j1].sum()

    def score(self) -> float:
        return 2 * len(self.matched) - 0.5 * (self.i1 - self.i0 + self.j1 - self.j0)


def align(parts: np.ndarray, segments: np.ndarray) -> list[Alignment | None]:
    """The densest common subsequence of each pair; None where even the least leak scores more."""
    p, n = parts.shape
    m = segments.shape[1]
    all_ = np.zeros((m + 1, p, n + 1), dtype=np.int16)
    for j, h in enumerate(_columns(parts, segments)):
        all_[j + 1] = h.T
    out: list[Alignment | None] = []
    for g, part, segment in zip(all_.swapaxes(0, 1), parts, segments, strict=True):
        j, i = divmod(int(g.argmax()), n + 1)
        now = int(g[j, i])
        if now < 2 * LEAST_SCORE:
            out.append(None)
            continue
        doc, item = part.tolist(), segment.tolist()
        i1, j1, matched = i, j, []
        while i > 0 and j > 0 and now > 0:
            aslant = int(g[j - 1, i - 1])
            if doc[i - 1] == item[j - 1] and now == aslant + 2:
                i, j, now = i - 1, j - 1, aslant
                matched.append(j)
            elif now == aslant - 3:
                i, j, now = i - 1, j - 1, aslant
            elif now == int(g[j, i - 1]) - 3:
                i, now = i - 1, now + 3
            else:
                j, now = j - 1, now + 3
        out.append(Alignment(matched, i, i1, j, j1))
    return out


def widened(got: Alignment, doc: np.ndarray, item: np.ndarray) -> Alignment:
    """An alignment with what stands beyond an altered word near its ends, and with altered end words, as far as the whole stays within ``ALTERED``.

    Local alignment cuts off a lone word behind an altered one, as that one costs more than the word is worth.
    """
    hits, i0, i1, j0, j1 = len(got.matched), got.i0, got.i1, got.j0, got.j1
    # hits gained by so many steps to either side
    k, m = min(i0, j0), min(len(doc) - i1, len(item) - j1)
    before, behind = doc[i0 - k : i0] == item[j0 - k : j0], doc[i1 : i1 + m] == item[j1 : j1 + m]
    left, right = np.append(0, before[::-1].cumsum()), np.append(0, behind.cumsum())
    if hits + left[-1] + right[-1] < (1 - ALTERED) * WORDS:
        return got
    n, steps = hits + left[:, None] + right, np.arange(k + 1)[:, None] + np.arange(m + 1)
    # most hits, then the longest
    at = np.where(n >= (1 - ALTERED) * (max(i1 - i0, j1 - j0) + steps), 1000 * n + steps, 0)
    if not at.any():
        return got
    x, y = divmod(int(at.argmax()), m + 1)
    more = [j0 - 1 - d for d in range(x) if before[k - 1 - d]] + [j1 + d for d in range(y) if behind[d]]
    return Alignment([*got.matched, *more], i0 - x, i1 + y, j0 - x, j1 + y)


class Search:
    """What a task needs to seek leaks: bounded by the block of items, not by the documents."""

    def __init__(self, items: Items, weight: np.ndarray, basis: np.ndarray) -> None:
        self.items, self.weight, self.basis = items, weight, basis
        q = np.concatenate([project(w, x, basis) for _, w, x in in_blocks(items.windows, weight)])
        self.q = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).T.copy()
        self.first = np.flatnonzero(np.append(True, items.owner[1:] != items.owner[:-1]))
        self.has = np.zeros((len(items.segments), len(items.vocabulary) + 1), dtype=bool)
        for k, s in enumerate(items.segments):
            self.has[k, s] = True
        self.length = np.array([len(s) for s in items.segments])
        self.padded = np.full((len(items.segments), self.length.max()), -2, dtype=np.int32)
        for k, s in enumerate(items.segments):
            self.padded[k, : len(s)] = s

    def candidates(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and segments whose latent vectors are near enough, and which hold a leak's worth of common words in order."""
        rows, cols = [], []
        for a, part, x in in_blocks(w, self.weight):
            p = project(part, x, self.basis)
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
            best = np.maximum.reduceat(p @ self.q, self.first, axis=1)
            r, c = np.nonzero(best >= COSINE)
            # a leak within the passage needs so many of the segment's terms
            ok = self.has[c[:, None], part[r]].sum(1) >= LEAST
            rows.append(r[ok] + a)
            cols.append(c[ok])
        r, c = np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *cols])
        order = np.argsort(self.length[c], kind="stable")
        r, c = r[order], c[order]
        ok = np.zeros(len(r), dtype=bool)
        for a in range(0, len(r), PAIRS):
            at = slice(a, a + PAIRS)
            ok[at] = scores(w[r[at]], self.padded[c[at], : self.length[c[at]].max()]) >= 2 * LEAST_SCORE
        r, c = r[ok], c[ok]
        order = np.lexsort((r, c))
        return r[order], c[order]

    def explanations(self, seqs: list[np.ndarray]) -> dict[int, set[tuple]]:
        """By document number: ``score, item, start, end, matches, answers`` (in tokens) of every dense alignment."""
        owner, start, w = batch_passages(seqs)
        rows, segs = self.candidates(w)
        by_length = np.argsort(self.length[segs], kind="stable")
        rows, segs = rows[by_length], segs[by_length]
        found: dict[int, set[tuple]] = {}
        for x in range(0, len(rows), 512):
            pairs = list(zip(rows[x : x + 512].tolist(), segs[x : x + 512].tolist(), strict=True))
            parts = np.full((len(pairs), 2 * WINDOW), -1, dtype=np.int32)
            sides = self.padded[segs[x : x + 512], : self.length[segs[x : x + 512]].max()]
            lows = [max(0, int(start[r]) - WINDOW // 2) for r, _ in pairs]
            for y, (r, _) in enumerate(pairs):
                part = seqs[owner[r]][lows[y] : lows[y] + 2 * WINDOW]
                parts[y, : len(part)] = part
            for (r, k), lo, part, got in zip(pairs, lows, parts, align(parts, sides), strict=True):
                if got is None:
                    continue
                body, item = part[got.i0 : got.i1], self.items.segments[k]
                chars = bool(2 * self.items.wide[body[body >= 0]].sum() > (body >= 0).sum())
                if not got.dense(chars):
                    got = widened(got, part[: len(seqs[owner[r]]) - lo], item)
                if got.dense(chars):
                    found.setdefault(int(owner[r]), set()).add((got.score(), self.items.ids[k], lo + got.i0, lo + got.i1, len(got.matched), got.answers(self.items.surprise[k])))
        return found


def best(each: Iterable[tuple]) -> list[tuple[int, int, int, int]]:
    """``item, start, end, matches`` of what other items don't explain better, of one document's explanations; of these, what carries the item's answer."""
    taken: list[tuple[int, int, float, int]] = []
    out = []
    for score, item, a, b, hits, answers in sorted(each, key=lambda x: (-x[0], x[1])):
        # better explanations by others may be several, one after the other
        better = np.zeros(b - a, dtype=bool)
        for x, y, s, other in taken:
            if score < s and item != other:
                better[max(x - a, 0) : max(y - a, 0)] = True
        if better.sum() > 0.5 * (b - a):
            continue
        taken.append((a, b, score, item))
        if answers:
            out.append((item, a, b, hits))
    return out


# ---- the items, by joins over all of them


def own_segments(eval_items: DataFrame) -> DataFrame:
    """``item_id, segments``: runs of an item's sentences that no other item has, as words with their surprise.

    Standing sentences are counted over all items by their hash. A word is foretold as far as it follows the word before it, or comes before the word
    behind it, in all items' sentences; its surprise is the logarithm of that share's inverse. What all items phrase alike says nothing;
    where nothing is phrased alike all words weigh the same. None of this passes the driver.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, ws) for i, t in zip(pdf["item_id"], pdf["text"], strict=True) for n, ws in enumerate(sentences(t))]
            yield pd.DataFrame(rows, columns=["item_id", "no", "ws"])

    known = eval_items.where("item_id is not null").select("item_id", "text").distinct()
    each = cut(known.mapInPandas(read, "item_id bigint, no int, ws array<string>").withColumn("key", F.xxhash64("ws")))
    standing = each.groupBy("key").agg(F.count_distinct("item_id").alias("n")).where("n > 1").select("key", F.lit(True).alias("standing"))
    marked = each.join(standing, "key", "left").select("item_id", "no", "ws", F.coalesce("standing", F.lit(False)).alias("standing"))
    # every word with its neighbours; the ends of a sentence are neighbours too
    beside = lambda i: F.coalesce(F.try_element_at("ws", i), F.lit(""))
    at = marked.select("*", F.posexplode("ws").alias("at", "w"))
    at = at.select("item_id", "no", "standing", "at", "w", F.when(F.col("at") > 0, beside(F.col("at"))).otherwise(F.lit("")).alias("l"), beside(F.col("at") + 2).alias("r"))
    pairs = at.select(F.col("l").alias("p"), F.col("w").alias("q")).unionByName(at.where("r = ''").select(F.col("w").alias("p"), F.col("r").alias("q"))).groupBy("p", "q").agg(F.count("*").alias("both"))
    alone = at.groupBy("w").agg(F.count("*").alias("n")).unionByName(marked.agg(F.count("*").alias("n")).select(F.lit("").alias("w"), "n"))
    share = lambda mine, other, name: (
        pairs.select(F.col("p").alias("l" if mine == "q" else "w"), F.col("q").alias("w" if mine == "q" else "r"), "both")
        .join(alone.select(F.col("w").alias(other), "n"), other)
        .select("w", other, (F.col("both") / (F.col("n") + 2)).alias(name))
    )
    told = at.join(share("q", "l", "by_left"), ["w", "l"]).join(share("p", "r", "by_right"), ["w", "r"])
    word = F.struct("at", "w", (-F.log(F.greatest("by_left", "by_right"))).alias("s"))
    told = told.groupBy("item_id", "no", "standing").agg(F.array_sort(F.collect_list(word)).alias("x"))
    ws = F.transform("x", lambda x: F.struct(x["w"].alias("w"), x["s"].alias("s")))
    none = F.array().cast("array<struct<w:string,s:double>>")
    # an item is one text: its sentences fit a task
    runs = F.aggregate(
        F.array_sort(F.collect_list(F.struct("no", F.when(F.col("standing"), F.lit(None)).otherwise(ws).alias("ws")))), F.array(none),
        lambda acc, x: F.when(x["ws"].isNull(), F.concat(acc, F.array(none))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x["ws"])))),
    )
    return told.groupBy("item_id").agg(F.filter(runs, lambda x: F.size(x) > 0).alias("segments")).where(F.size("segments") > 0)


# ---- the documents


def _sequences(docs: DataFrame) -> DataFrame:
    """``doc_id, seq``: each text as its words' hashes, read once for all blocks of items; null texts have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "seq": [hashed(tokens(x), known) for x in pdf["text"]]})

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(read, "doc_id bigint, seq array<int>")


def _sum(parts: DataFrame, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """The sum of the arrays in ``m``, one for each task, in two steps."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [np.sum([np.frombuffer(x, dtype=dtype) for x in pdf["m"]], axis=0).astype(dtype).tobytes()]})

    sums = parts.groupBy("salt").applyInPandas(add, "m binary")
    return np.sum([np.frombuffer(r.m, dtype=dtype).reshape(shape) for r in sums.toLocalIterator()] or [np.zeros(shape, dtype)], axis=0)


def _salted(m: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"salt": [int(np.random.default_rng().integers(32))], "m": [m.tobytes()]})


def weights(seqs: DataFrame, items: Items) -> np.ndarray:
    """A term's weight: the logarithm of its rarity among the items' passages and among all documents."""
    v = len(items.vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(v + 1, dtype=np.int64)
        for pdf in batches:
            for s in pdf["seq"]:
                known = np.unique(items.numbers(np.asarray(s)))
                out[known[known >= 0]] += 1
            out[v] += len(pdf)
        yield _salted(out)

    df = _sum(seqs.select("seq").mapInPandas(count, "salt int, m binary"), (v + 1,), np.int64)
    own = np.zeros(v)
    for w in items.windows:
        own[np.unique(w[w >= 0])] += 1
    return (np.log((df[v] + 2) / (df[:v] + 1)) * np.log((len(items.windows) + 2) / (own + 1))).clip(0.01) ** 0.5


def _range(seqs: DataFrame, items: Items, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The TF-IDF matrix of all passages, transposed, times itself, times ``basis``: one partial sum per task."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(basis.shape, dtype=np.float32)
        for pdf in batches:
            _, _, w = batch_passages([items.numbers(np.asarray(s)) for s in pdf["seq"]])
            if len(w):
                out += range_step(w, weight, basis)
        yield _salted(out)

    return _sum(seqs.select("seq").mapInPandas(part, "salt int, m binary"), basis.shape, np.float32)


def latent_space(seqs: DataFrame, items: Items, weight: np.ndarray) -> np.ndarray:
    """Orthonormal basis (terms by rank) of the passages' dominant space, the items' own passages included."""
    rng = np.random.default_rng(SEED)
    rank = min(RANK, len(items.vocabulary))
    basis = rng.standard_normal((len(items.vocabulary), rank)).astype(np.float32)
    for _ in range(1 + POWER_ROUNDS):
        basis = np.linalg.qr(basis)[0].astype(np.float32)
        own = range_step(items.windows, weight, basis)
        # both sides weigh the same, however many documents there are
        docs = _range(seqs, items, weight, basis)
        basis = own / max(np.linalg.norm(own), 1e-9) + docs / max(np.linalg.norm(docs), 1e-9)
    return np.linalg.qr(basis)[0].astype(np.float32)


SCHEMA = "doc_id bigint, item_id bigint, token_start int, token_end int, n_words int"
_EXPLAINED = f"{SCHEMA}, answers boolean, score double"


def leaks(docs: DataFrame, eval_items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, token_start, token_end, n_words``: the stretches of documents that hold a passage of an item.

    The items are the stated query set, dealt by hash into blocks that are read against all documents; a document is never compared with another. What
    the blocks find is brought together by document, where a stretch belongs to the item that explains it best. Null and empty texts
    hold nothing; repeated documents are reported under each of their ids; empty tables give no rows.
    """
    spark = docs.sparkSession
    segments = cut(own_segments(eval_items))
    n_blocks = max(1, -(-segments.count() // block))
    dealt = segments.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    seqs, out = cut(_sequences(docs)), spark.createDataFrame([], _EXPLAINED)
    for k in range(n_blocks):
        own = sorted(dealt.where(F.col("block") == k).drop("block").toLocalIterator(), key=lambda r: r.item_id)
        rows = [(r.item_id, [x.w for x in seg], [x.s for x in seg]) for r in own for seg in r.segments]
        if rows:
            out = out.unionByName(_leaks_of_block(seqs, item_block(rows)))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(d, *x) for d, each in zip(pdf["doc_id"], pdf["each"], strict=True) for x in best([tuple(e[c] for c in order) for e in each])], columns=names)

    # one document's explanations are bounded by its length
    order = ("score", "item_id", "token_start", "token_end", "n_words", "answers")
    return out.groupBy("doc_id").agg(F.collect_set(F.struct(*order)).alias("each")).mapInPandas(choose, SCHEMA)


def _leaks_of_block(seqs: DataFrame, items: Items) -> DataFrame:
    """All explanations by the block's items, with their scores; the best are still to be chosen."""
    weight = weights(seqs, items)
    basis = latent_space(seqs, items, weight)

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(items, weight, basis)
        for pdf in batches:
            ids = pdf["doc_id"].tolist()
            found = search.explanations([items.numbers(np.asarray(s)) for s in pdf["seq"]])
            yield pd.DataFrame([(ids[d], *rest, float(score)) for d, each in found.items() for score, *rest in each], columns=[x.split()[0] for x in _EXPLAINED.split(", ")])

    return seqs.mapInPandas(seek, _EXPLAINED)


def found(docs: DataFrame, eval_items: DataFrame, block: int = BLOCK) -> DataFrame:
    return leaks(docs, eval_items, block).select("doc_id", "item_id").distinct()
