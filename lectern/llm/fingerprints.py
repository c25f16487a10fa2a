"""Document fingerprints: improbable-feature digests.

Every byte window of WINDOW bytes gets a rarity rank from its entropy (in thousandths, exact in integers): the further
the entropy is from that of ordinary text, the rarer. In every run of WINDOW consecutive windows the rarest, leftmost on
ties, scores a point; windows of at least POPULAR points are the document's features. A text with fewer than FEW of
them takes each of its distinct windows, and one shorter than a window itself. Features go, in order, into chained Bloom filters of BITS bits, five bits a feature and
PER_FILTER features a filter. Digests are compared by the bits that their filters share, less those shared by chance, over
the most that they could share; a filter counts with its best partner in the longer digest.

Digests depend on the text alone, so equal texts have equal fingerprints. The empty text's is empty: 1 against itself,
0 against others. Very long texts are digested in blocks, so memory does not grow with a text's windows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix

WINDOW, POPULAR, FEW = 64, 16, 4
TYPICAL = 690  # the ordinary entropy that rarity is measured from, a fixed scale, so that a digest depends on its text alone
BITS, PER_FILTER, HASHES = 2048, 160, 5
BLOCK = 1 << 18
_C = np.arange(WINDOW + 1)
_CLOG = np.array([0] + [round(c * np.log2(c) * (1 << 16)) for c in range(1, WINDOW + 1)], np.int64)
_GAIN = np.diff(_CLOG, append=_CLOG[-1])
_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_UP = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * BLOCK, _BASE, np.uint64))])
_DOWN = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * BLOCK, pow(_BASE, -1, 1 << 64), np.uint64))])


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width (a power of two) values."""
    step = 1
    while step < width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values


def window_entropy(x: np.ndarray) -> np.ndarray:
    """Entropy of each WINDOW-byte window, in thousandths of its maximum."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    key = order + x[order].astype(np.int64) * (n + WINDOW)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        near = key[d:] - key[:-d] < WINDOW
        if not near.any():
            break
        before[d:] += near
        after[:-d] += near
    here_before, here_after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    here_before[order], here_after[order] = before, after
    first = int(_CLOG[np.bincount(x[:WINDOW], minlength=1)].sum())
    change = _GAIN[here_before[WINDOW:]] - _GAIN[here_after[: n - WINDOW]]
    total = first + np.concatenate([[0], np.cumsum(change)])
    top = int(np.log2(WINDOW) * WINDOW * (1 << 16))
    return (top - total) * 1000 // top


def _features(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the features of the texts that lie at starts..ends in block, each of WINDOW bytes or more."""
    rank = np.abs(window_entropy(block) - TYPICAL)
    windows = len(rank)
    key = ((1000 - rank) << 32) | np.arange(windows)
    points = np.zeros(windows, np.int64)
    if windows >= WINDOW:
        best = (_slide(key, WINDOW) & 0xFFFFFFFF).astype(np.int64)
        lengths = ends - starts - 2 * WINDOW + 2  # runs of WINDOW windows within each text
        runs = np.maximum(lengths, 0)
        at = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
        points += np.bincount(best[at], minlength=windows)
    popular = points >= POPULAR
    at = popular.nonzero()[0]
    return at, _hashes(block, at)


def _hashes(block: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at these positions."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_RANDOM[block] * _UP[: len(block)])])
    return mix((sums[at + WINDOW] - sums[at]) * _DOWN[at])


def _enough(h: np.ndarray, text: bytes) -> np.ndarray:
    """h, or the hashes of the text's distinct windows by first place where h are fewer than FEW."""
    if len(h) >= FEW:
        return h
    found = np.zeros(0, np.uint64)
    for s in range(0, len(text) - WINDOW + 1, BLOCK):
        block = np.frombuffer(text[s : s + BLOCK + WINDOW - 1], np.uint8)
        found = np.concatenate([found, _hashes(block, np.arange(len(block) - WINDOW + 1))])
        found = found[np.sort(np.unique(found, return_index=True)[1])]
    return found


class Digest:
    """Features' bits in chained filters."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.filters: list[int] = []
        self.bits: list[int] = []
        if not self.n:
            return
        rows = np.arange(self.n) // PER_FILTER
        field = np.zeros((int(rows[-1]) + 1, BITS), bool)
        for i in range(HASHES):
            field[rows, ((hashes >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(field, axis=1)
        self.filters = [int.from_bytes(p.tobytes(), "big") for p in packed]
        self.bits = [f.bit_count() for f in self.filters]

    def __str__(self) -> str:
        return f"{self.n}:" + base64.b64encode(b"".join(f.to_bytes(BITS // 8, "big") for f in self.filters)).decode()

    def likeness(self, other: Digest) -> float:
        a, b = (self, other) if len(self.filters) <= len(other.filters) else (other, self)
        if not a.n or not b.n:
            return float(a.n == b.n)
        score = weight = 0.0
        for f, n in zip(a.filters, a.bits, strict=True):
            best = 0.0
            for g, m in zip(b.filters, b.bits, strict=True):
                chance, most = n * m / BITS, min(n, m)
                if most > chance:
                    best = max(best, ((f & g).bit_count() - chance) / (most - chance))
                    if best >= 1.0:
                        break
            score += best * n
            weight += n
        return min(1.0, max(0.0, score / weight))


def digests(texts: list[bytes]) -> list[Digest]:
    """Digest of each text; texts are taken together in blocks, and a text longer than a block in overlapping blocks."""
    out: list[Digest | None] = [None] * len(texts)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            lengths = np.array([len(texts[i]) for i in held])
            ends = np.cumsum(lengths)
            at, h = _features(np.frombuffer(b"".join(texts[i] for i in held), np.uint8), ends - lengths, ends)
            cuts = np.searchsorted(at, np.concatenate([ends - lengths, ends[-1:]]))
            for k, i in enumerate(held):
                out[i] = Digest(_enough(h[cuts[k] : cuts[k + 1]], texts[i]))
        held.clear()
        size = 0

    for i, t in enumerate(texts):
        if len(t) < WINDOW:
            whole = int.from_bytes(hashlib.sha256(t).digest()[:8], "big")
            out[i] = Digest(np.array([whole] if t else [], np.uint64))
        elif len(t) <= BLOCK:
            if size + len(t) > BLOCK:
                flush()
            held.append(i)
            size += len(t)
        else:
            parts, margin = [], 2 * WINDOW
            for s in range(0, len(t), BLOCK):
                a, b = max(0, s - margin), min(len(t), s + BLOCK + margin)
                if b - a < WINDOW:
                    continue
                at, h = _features(np.frombuffer(t[a:b], np.uint8), np.array([0]), np.array([b - a]))
                parts.append(h[(at + a >= s) & (at + a < s + BLOCK)])
            out[i] = Digest(_enough(np.concatenate(parts), t))
    flush()
    return out  # type: ignore[return-value]


def fingerprints(texts: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {
                "doc_id": batch.column("doc_id"),
                "fingerprint": list(map(str, digests([(t or "").encode() for t in batch.column("text").to_pylist()]))),
            }

    return map_arrow(texts.select("doc_id", F.col(column).alias("text")), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, per_bucket: int = 2000, most: int = 20_000) -> DataFrame:
    """Documents dealt by ranges of doc_id, each range sorted downwards and followed by the first of the next range.

    Columns bucket, ahead (1: the row only follows the range), doc_id, text. Only the bounds of the ranges and the first
    id of each, `most` numbers at most, come to the driver; beyond most * per_bucket documents the ranges get longer, and
    as they are sorted on disk and read as streams, a task's memory does not. Each text is shuffled once.
    """
    from pyspark.ml.feature import Bucketizer

    least = -(1 << 63)
    keyed = docs.select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(least)).alias("place")
    )
    places = keyed.select("place")
    n = min(most, places.count() // per_bucket + 1)
    bounds = places.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    splits = [float("-inf"), *sorted(set(map(float, bounds or []))), float("inf")]

    def bucketed(df: DataFrame) -> DataFrame:
        at = df.withColumn("_place", F.col("place").cast("double"))
        return Bucketizer(
            splits=splits, inputCol="_place", outputCol="_bucket"
        ).transform(at).withColumn("bucket", -F.col("_bucket").cast("int")).drop("_place", "_bucket") if len(splits) > 2 else at.withColumn("bucket", F.lit(0)).drop("_place")

    firsts = {r["bucket"]: r["place"] for r in bucketed(places).groupBy("bucket").agg(F.max("place").alias("place")).collect()}
    order = sorted(firsts)  # downwards in doc_id
    follows = {firsts[b]: order[i - 1] for i, b in enumerate(order)}  # the first of b also follows the range before
    own = bucketed(keyed).withColumn("ahead", F.lit(0))
    if follows:
        spark = docs.sparkSession
        first = F.broadcast(spark.createDataFrame(list(follows.items()), "place long, follows int"))  # `most` rows at most
        ahead = own.join(first, "place").withColumn("bucket", F.col("follows")).withColumn("ahead", F.lit(1)).drop("follows")
        own = own.unionByName(ahead)
    return own.repartition(max(1, len(order)), "bucket").sortWithinPartitions(
        "bucket", "ahead", F.col("place").desc(), "text"
    ).select("bucket", "ahead", "doc_id", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, per_bucket: int = 2000) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document by descending doc_id (nulls last, ties by text).

    After the last document the next is the first; a single document follows itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting: tuple | None = None  # bucket, doc_id, text, digest
        for batch in batches:
            rows = list(
                zip(
                    batch.column("bucket").to_pylist(),
                    batch.column("ahead").to_pylist(),
                    batch.column("doc_id").to_pylist(),
                    batch.column("text").to_pylist(),
                    strict=True,
                )
            )
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                own = digests([r[3].encode() for r in part])
                pairs = []
                for (bucket, ahead, doc_id, text), digest in zip(part, own, strict=True):
                    if waiting and waiting[0] == bucket:
                        half = len(waiting[2]) // 2
                        pairs.append((waiting, digest, (waiting[2][: len(waiting[2]) - half] + text[:half]).encode()))
                    waiting = None if ahead else (bucket, doc_id, text, digest)
                edits = digests([p[2] for p in pairs])
                yield {
                    "doc_id": [p[0][1] for p in pairs], "n_chars": [len(p[0][2]) for p in pairs],
                    "edited_sha256": [hashlib.sha256(p[2]).hexdigest() for p in pairs],
                    "fingerprint": [str(p[0][3]) for p in pairs], "edited_fingerprint": [str(e) for e in edits],
                    "near_edited": [p[0][3].likeness(e) for p, e in zip(pairs, edits, strict=True)],
                    "near_next": [p[0][3].likeness(p[1]) for p in pairs],
                }

    return map_arrow(with_next(docs, per_bucket), run, EDITED)
