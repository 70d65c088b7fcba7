"""Problem 7: texts packed into containers of fixed capacity, by vector bin packing with the dot-product heuristic.

An item has three sizes: tokens, segments (one) and loss-bearing tokens (those outside fenced blocks, which are context in
instruction data). A container takes at each step the item that fits and whose direction has the largest dot product with what is
still free in it, dimensions weighing by what all items left still need of them, so that none runs out before the others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Items of one packing block: what a task holds, and packs in time proportional to its square.
BLOCK = 8192
#: How steeply a dimension gains weight with what is left to pack in it.
URGENCY = 4
#: A container filled less than this takes part in the second round.
FULL = 0.97


@dataclass(frozen=True)
class Limits:
    """What a container takes at most. The loss-bearing tokens have a limit of their own, so context and answers are mixed in each container."""

    tokens: int = 2048
    segments: int = 32
    loss_tokens: int = 2032


_FENCED = re.compile(r"(?m)^[ \t]*(```|~~~)[^\n]*\n(?s:.*?)(?:^[ \t]*\1[ \t]*$|\Z)")


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    import public_tokenizers

    return tiktoken.Encoding("colloquy", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def loss_mask(enc, text: str) -> np.ndarray:
    """For each token of a text whether it bears loss: it begins outside the fenced blocks."""
    ids = enc.encode_ordinary(text)
    out = np.ones(len(ids), dtype=bool)
    if "```" in text or "~~~" in text:
        starts = np.array(enc.decode_with_offsets(ids)[1])
        for m in _FENCED.finditer(text):
            out[np.searchsorted(starts, m.start()) : np.searchsorted(starts, m.end())] = False
    return out


def pieces(upto: np.ndarray, limits: Limits) -> list[tuple[int, int]]:
    """Token spans of a text's pieces, given its loss-bearing tokens up to each place: one if it fits a container, else each as long as the limits allow."""
    n, out, a = len(upto) - 1, [], 0
    while a < n or not out:
        b = min(n, a + limits.tokens, int(np.searchsorted(upto, upto[a] + limits.loss_tokens, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def items(docs: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, chunk_no, token_start, token_end, n_tokens, loss_tokens``: every text, or its pieces where it alone exceeds a container.

    Null texts give nothing; an empty text is an item without tokens. Pieces are whole containers but the last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                loss = loss_mask(enc, text)
                upto = np.append(0, loss.cumsum())
                at = pieces(upto, limits)
                rows += [(doc, k, a, b, b - a, upto[b] - upto[a]) for k, (a, b) in enumerate(at)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "token_start", "token_end", "n_tokens", "loss_tokens"])

    known = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    return known.mapInPandas(run, "doc_id bigint, chunk_no bigint, token_start bigint, token_end bigint, n_tokens bigint, loss_tokens bigint")


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container of each item (rows of ``sizes``, in the unit of ``limits``); every item fits an empty container."""
    unit = sizes / limits
    # large items first, so that candidates of a container are read from the front and ties fall to the larger
    order = np.lexsort((-unit.sum(1), -unit.max(1)))
    left, box, out = unit[order], 0, np.empty(len(sizes), dtype=np.int64)
    index = order
    length = np.sqrt((left * left).sum(1)) + 1e-9
    while len(index):
        free = np.ones(len(limits))
        need = left.sum(0)
        weight = (need / max(need.max(), 1e-9)) ** URGENCY
        taken = np.zeros(len(index), dtype=bool)
        pool, pool_at, long = left, np.arange(len(index)), length
        k = 0  # the largest item opens the container
        while True:
            taken[pool_at[k]] = True
            free = free - pool[k]
            fits = (pool <= free + 1e-9).all(1)
            fits[k] = False
            if not fits.any():
                break
            pool, pool_at, long = pool[fits], pool_at[fits], long[fits]
            k = int((pool @ (weight * free) / long).argmax())
        out[index[taken]] = box
        box += 1
        left, index, length = left[~taken], index[~taken], length[~taken]
    return out


def _round(rows: DataFrame, limits: Limits, blocks: int, label: str) -> DataFrame:
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a fixed order makes the result the same however the rows arrive
        pdf = pdf.sort_values(["doc_id", "chunk_no"], ignore_index=True)
        sizes = np.column_stack([pdf["n_tokens"], np.ones(len(pdf)), pdf["loss_tokens"]]).astype(float)
        pdf["container_id"] = [f"{label}-{b}-{k}" for b, k in zip(pdf["block"], pack(sizes, cap), strict=True)]
        return pdf.drop(columns="block")

    schema = "doc_id bigint, chunk_no bigint, token_start bigint, token_end bigint, n_tokens bigint, loss_tokens bigint, container_id string"
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(blocks)))
    # a block's work is far larger than its bytes: with a number of its own the partitioning isn't coalesced
    return dealt.repartition(2 * blocks, "block").groupBy("block").applyInPandas(run, schema)


def containers(docs: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """Each item with its ``container_id``, and the container's ``used_tokens`` and ``used_segments``.

    Items are dealt by hash into blocks of about ``block`` items, which are packed apart; what lies in containers that a block
    couldn't fill is packed again in fewer blocks. No key of the data decides the block, so no source or text can make one large.
    """
    rows = cut(items(docs, limits, tokenizer))
    whole = rows.where(F.col("n_tokens") == limits.tokens).withColumn("container_id", F.concat_ws("-", F.lit("w"), "doc_id", "chunk_no"))
    rest = rows.where(F.col("n_tokens") < limits.tokens)
    first = cut(_round(rest, limits, max(1, -(-rest.count() // block)), "a"))
    fill = first.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).where(F.col("used") < FULL * limits.tokens).select("container_id")
    again = cut(first.join(fill, "container_id", "left_semi").drop("container_id").select(rest.columns))
    second = _round(again, limits, max(1, -(-again.count() // block)), "b")
    done = first.join(fill, "container_id", "left_anti").select(second.columns).unionByName(second).unionByName(whole.select(second.columns))
    used = F.sum("n_tokens"), F.count("*")
    per = done.groupBy("container_id").agg(used[0].alias("used_tokens"), used[1].alias("used_segments"))
    return done.join(per, "container_id")


def summary(docs: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each dimension (tokens, segments, loss-bearing tokens): its sum, limit, containers, the share in use, containers that are full in it, and the least number of containers that it allows."""
    c = containers(docs, limits, tokenizer).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss_tokens"))
    caps = {"tokens": limits.tokens, "segments": limits.segments, "loss_tokens": limits.loss_tokens}
    each = c.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("used"), F.lit(m).cast("bigint").alias("limit")) for d, m in caps.items()))).alias("x")).select("x.*")
    n, used = F.count("*"), F.sum("used")
    return each.groupBy("dimension", "limit").agg(used.alias("total"), n.alias("n_containers"), F.round(used / (n * F.col("limit")), 6).alias("used_share"), F.count_if(F.col("used") == F.col("limit")).alias("full"), F.ceil(used / F.col("limit")).alias("least_containers"))
