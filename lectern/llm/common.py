"""Shared helpers of the training-data operators: shared-folder tables, Arrow iteration, word hashing.

Row rules shared by all operators of this subpackage, unless one says otherwise:

* only the named columns are read, so extra columns with any names do not matter;
* a null text counts as the empty text; rows with a null ``doc_id`` are kept, as documents of their own text;
* repeated rows are documents of their own, each with its own output row;
* empty tables give empty results of the same schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import stored as materialize

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORD_CACHE = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents, null text as the empty text."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with fn yielding dicts of columns; schema is a DDL string whose types name Arrow's."""
    types = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "string": pa.string(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()),
    }
    fields = [tuple(part.split(" ", 1)) for part in schema.split(", ")]
    arrow = pa.schema([(name, types[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(name).type) for name, x in ((name, columns[name]) for name, _ in fields)], schema=arrow)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[str], chars: int = 2_000_000, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `rows` texts and about `chars` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > chars or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A cache that lives as long as the Python worker, across its tasks; its users bound it."""
    return _CACHES.setdefault(name, {})


class WordHash:
    """64-bit hashes of word lists through a bounded worker cache."""

    def __init__(self, bound: int = WORD_CACHE):
        import xxhash

        self.cache = worker_cache("word hashes")
        self.bound = bound
        self.digest = xxhash.xxh3_64_intdigest

    def many(self, lists: list[list]) -> list[np.ndarray]:
        """Hashes of several word lists, missing words learnt at once."""
        missing = set().union(*lists).difference(self.cache)
        if missing:
            if len(self.cache) + len(missing) > self.bound:
                self.cache.clear()
                missing = set().union(*lists)
            self.cache.update(zip(missing, map(self.digest, missing), strict=True))
        get = self.cache.__getitem__
        return [np.fromiter(map(get, words), np.uint64, len(words)) for words in lists]

    def __call__(self, words: list) -> np.ndarray:
        return self.many([words])[0]


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of a word-hash sequence; a shorter sequence counts as one shingle, an empty one has none."""
    n = min(n, len(hashes))
    if n == 0:
        return hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def sha256_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
