"""Quality by importance resampling.

Two generative models of hashed token n-grams (1 and 2 tokens): one of the target text, the documents labelled good and
not toxic, and one of the raw text, all documents. Tokens are runs of word characters and runs of other signs, in their
own case; a token that follows itself makes the same 2-gram whatever it is. With an n-gram's count t in the target and
its count e expected there, the raw count scaled to the target's size, its log ratio is log((t + SMOOTH) / (e + SMOOTH)),
at most 0, and 0 where e is under LEAST. So n-grams that the target avoids count against a text; those that the target
holds all alike do not make up for them, and rare ones say nothing.

A document's log ratio is the mean over its n-grams times LENGTH, as if each had that many, else it would be a measure of
length; its key adds Gumbel noise drawn from a hash of the doc_id and the seed, so that taking the k greatest keys is
sampling without replacement in proportion to the ratio.

Raw counts cover all documents. The target model is fitted on at most about `target_docs` labelled documents, picked by
a hash of their ids; their ids are all that is broadcast, so no text is shuffled. The models have `cells(n)` cells for n
documents: the next power of two from 16 * n, between MIN_CELLS and MAX_CELLS, the bound of a worker's memory. Tasks send
their counts in compressed blocks of BLOCK cells.

Result for every document: doc_id, n_words (tokens), log_ratio, gumbel_key, kept: among the k greatest keys; ties by
doc_id as a double (nulls last), then by place in the stored scores, so exactly k rows are kept, repeated rows or not.
Documents without tokens (null or empty text) have ratio 0. Without labelled target documents all ratios are 0. Labels of
one document that differ count as the worse. Repeated labels count once; null labels are neither good nor toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, blocks, map_arrow, materialize, mix

MIN_CELLS, MAX_CELLS, BLOCK = 1 << 20, 1 << 22, 1 << 12
SMOOTH, LEAST, LENGTH = 0.5, 10.0, 1000.0
FEW = 50_000
TOKENS = re.compile(r"\w+|[^\w\s]+").findall
AGAIN = np.uint64(0x5851F42D4C957F2D)  # the 2-gram of a token with itself


def cells(n_docs: int) -> int:
    return min(MAX_CELLS, max(MIN_CELLS, 1 << max(0, 16 * n_docs - 1).bit_length()))


def _grams(hashes: np.ndarray, n_cells: int) -> np.ndarray:
    """Cells of the 1-grams, then of the 2-grams."""
    pairs = np.where(hashes[1:] == hashes[:-1], AGAIN, hashes[:-1] * np.uint64(3) + hashes[1:])
    return (mix(np.concatenate([hashes, pairs])) & np.uint64(n_cells - 1)).astype(np.int64)


def _add(counts: np.ndarray, grams: np.ndarray) -> None:
    at, n = np.unique(grams, return_counts=True)
    counts[at] += n


def ngram_counts(docs: DataFrame, n_cells: int) -> DataFrame:
    """(block, sums): target and raw n-gram counts over docs (text, is_target), longs for the cells of each block.

    Every partition sends its own sums only; a task that adds them up holds its share of the n_cells at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashed = WordHash()
        both = np.zeros((2, n_cells), np.int64)  # target, all others
        for batch in batches:
            texts, good = batch.column("text").to_pylist(), batch.column("is_target").to_pylist()
            texts = [t or "" for t in texts]
            for a, b in blocks(texts):
                found: tuple[list, list] = ([], [])
                for h, ok in zip(hashed.many([TOKENS(t) for t in texts[a:b]]), good[a:b], strict=True):
                    found[0 if ok else 1].append(_grams(h, n_cells))
                for counts, grams in zip(both, found, strict=True):
                    if grams:
                        _add(counts, np.concatenate(grams))
        both[1] += both[0]
        for i in range(n_cells // BLOCK):
            part = both[:, i * BLOCK : (i + 1) * BLOCK]
            if part.any():
                yield {"block": [i], "counts": [zlib.compress(part.tobytes(), 1)]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(counts), np.int64)
                sums[block] = sums[block] + part if block in sums else part
        for block, total in sums.items():
            yield {"block": [block], "sums": [total.tobytes()]}

    parts = map_arrow(docs.select("text", "is_target"), count, "block int, counts binary")
    return map_arrow(parts.repartition("block"), add, "block int, sums binary")


def log_ratios(counts: DataFrame, n_cells: int) -> np.ndarray:
    """The log ratio of each cell: n_cells pairs of longs come to the driver at most, as bytes."""
    table = counts.toArrow()
    both = np.zeros((2, n_cells))
    for block, sums in zip(table.column("block").to_pylist(), table.column("sums"), strict=True):
        both[:, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(sums.as_py(), np.int64).reshape(2, BLOCK)
    target, raw = both
    if not target.sum():
        return np.zeros(n_cells, np.float32)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.minimum(np.log(target + SMOOTH) - np.log(expected + SMOOTH), 0.0)
    return np.where(expected < LEAST, 0.0, ratio).astype(np.float32)


def score(docs: DataFrame, ratios: np.ndarray, seed: int = 0) -> DataFrame:
    """(doc_id, n_words, log_ratio, gumbel_key) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    # uniform in (0, 1) from the row's own hash
    keyed = docs.select("doc_id", "text", ((F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashed, table = WordHash(), shared.value
        for batch in batches:
            n, ratio = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in blocks(texts):
                for h in hashed.many([TOKENS(t) for t in texts[a:b]]):
                    n.append(len(h))
                    ratio.append(LENGTH * float(table[_grams(h, len(table))].mean(dtype=np.float64)) if len(h) else 0.0)
            gumbel = -np.log(-np.log(batch.column("u").to_numpy()))
            yield {"doc_id": batch.column("doc_id"), "n_words": n, "log_ratio": ratio, "gumbel_key": np.array(ratio, float) + gumbel}

    return map_arrow(keyed, run, "doc_id long, n_words long, log_ratio double, gumbel_key double")


def kth_least(values: DataFrame, k: int) -> tuple[float, int]:
    """The k-th least of the one double column v, and how many are less, by counts over ever finer bins; at most FEW come to the driver."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    before = 0
    while True:
        left = values.where(F.col("v").between(low, high))
        n = left.count()
        if low == high:
            return low, before
        if n <= FEW:
            found = sorted(r["v"] for r in left.collect())
            return found[k - before - 1], before + sum(v < found[k - before - 1] for v in found)
        width = (high - low) / 1000
        bins = left.groupBy(F.floor((F.col("v") - low) / width).alias("b")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        for r in sorted(bins.collect(), key=lambda r: r["b"]):  # about 1,000 rows
            if k <= before + r["n"]:
                low, high = r["low"], r["high"]
                break
            before += r["n"]


def among_least(rows: DataFrame, order: list[str], k: int):
    """A condition that k rows meet exactly: the first by the double columns of order, the last of them unique."""
    chosen, equal = F.lit(False), F.lit(True)
    for name in order:
        if k <= 0:
            break
        cut, less = kth_least(rows.where(equal).select(F.col(name).alias("v")), k)
        chosen = chosen | (equal & (F.col(name) < cut))
        equal = equal & (F.col(name) == cut)
        k -= less
    return chosen | equal if k > 0 else chosen


def importance_resampling(
    docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 0, target_docs: int = 200_000
) -> DataFrame:
    """Every document with its key and whether it is among the k greatest; keep: share kept, else the target's share of the labelled."""
    per_doc = labels.where("doc_id is not null").groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")
    )
    judged = materialize(per_doc.select("doc_id", F.coalesce(F.col("good") & ~F.col("toxic"), F.lit(False)).alias("is_target")), "judged")
    labelled, n_target = judged.agg(F.count("*"), F.count_if("is_target")).first()
    if keep is None:
        keep = n_target / labelled if labelled else 1.0
    picked = judged.where("is_target").where(
        F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1_000_003)) < 1_000_003 * min(1.0, target_docs / max(n_target, 1))
    )
    # about target_docs ids at most: the broadcast side is bounded
    joined = docs.select("doc_id", "text").join(
        F.broadcast(picked.select("doc_id", "is_target")), "doc_id", "left"
    ).select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    n = docs.count()
    n_cells = cells(n)
    scored = score(docs, log_ratios(ngram_counts(joined, n_cells), n_cells), seed)
    last = F.lit(float("inf"))
    scored = materialize(scored.withColumn("_place", F.monotonically_increasing_id().cast("double")), "quality")
    k = round(n * keep)
    ranked = scored.withColumn("_key", -F.col("gumbel_key")).withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), last))
    kept = F.lit(bool(n)) if k >= n else among_least(ranked, ["_key", "_id", "_place"], k)
    return ranked.withColumn("kept", kept).select("doc_id", "n_words", "log_ratio", "gumbel_key", "kept")
