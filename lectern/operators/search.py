"""Exact vector search (TOP-01, TOP-02, JON-05, RAG-01) and index tables (SNK-06, AGG-20)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def add_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """EMB-02: an index of unit vectors (id, unit). Rows of one id count as one entry, the nearest of them, when searched."""
    return table.select(F.col(key).alias("id"), X.unit_vector(vector).alias("unit"))


def top_k(index: DataFrame, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """The k nearest by cosine, filtered first; ties by id. Vectors never move: (id, score) does, once for each id and task."""
    if keep is not None:
        index = index.where(keep)
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    rest = [c for c in index.columns if c not in ("id", "unit")]
    scored = index.select("id", *rest, (X.dot(F.col("unit"), q) / norm).alias("score"))
    best = scored.groupBy("id").agg(F.max("score").alias("score"), *[F.max_by(c, "score").alias(c) for c in rest])
    return best.orderBy(F.desc("score"), "id").limit(k)


PART = 8192  # vectors of the index in a cell of top_k_each


def _flat(vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, place, rows): 0 for a vector of numbers, whose place is its row, 1 with NaN in it, 2 without a product: null, of another width, or with a null."""
    a = vectors.combine_chunks()
    lengths, flat = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False), a.flatten()
    start = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    fits = np.flatnonzero((lengths == width) & (lengths >= 0))
    at = start[fits, None] + np.arange(width)
    values = flat.to_numpy(zero_copy_only=False).astype(float)[at]
    holes = flat.is_null().to_numpy(zero_copy_only=False)[at].any(1)
    kind = np.full(len(lengths), 2)
    kind[fits] = np.where(holes, 2, np.where(np.isnan(values).any(1), 1, 0))
    good = kind[fits] == 0
    place = np.full(len(lengths), -1)
    place[fits[good]] = np.arange(good.sum())
    return kind, place, np.ascontiguousarray(values[good])


def _best(units: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, ties by row.

    A matrix product leaves the rows that may be among them; their scores are summed in the order of `X.dot`, so equal vectors tie.
    """
    out, n = [], len(units)
    most = np.sqrt((units * units).sum(1).max()) if n else 0.0
    step = max(1, (1 << 22) // max(1, n))
    for at in range(0, len(queries) if n else 0, step):
        q = queries[at : at + step]
        rough = q @ units.T
        least = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        i, j = np.nonzero(rough >= (least - 1e-9 * most * np.sqrt((q * q).sum(1)))[:, None])
        score = np.zeros(len(i))
        for d in range(q.shape[1]):
            score = score + units[j, d] * q[i, d]
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[kept] + at, j[kept], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _cell(index: pa.Table, queries: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(query, row, score) of what can be among the k nearest of each query; rows of the index in the order of their ids."""
    found: list = []
    widths = pc.fill_null(pc.list_value_length(queries["unit"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        theirs, _, units = _flat(index["unit"], width)
        own, place, vectors = _flat(queries["unit"].take(mine), width)
        rows = np.flatnonzero(theirs == 0)
        i, j, score = _best(units, vectors, k)
        found.append((mine[np.flatnonzero(own == 0)][i], rows[j], score, np.zeros(len(i), bool)))
        # without a number, the first by id: NaN before all numbers, null behind them
        for nan in (True, False):
            for kind in range(3):
                fits = np.flatnonzero((np.maximum(theirs, kind) == 1) if nan else (np.maximum(theirs, kind) == 2))[:k]
                asked = mine[own == kind]
                i, j = np.repeat(asked, len(fits)), np.tile(fits, len(asked))
                found.append((i, j, np.full(len(i), np.nan), np.full(len(i), not nan)))
    i, j, score, none = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, pa.array(score, pa.float64(), mask=none)


def top_k_each(index: DataFrame, queries: DataFrame, k: int, most: int = 10_000, part: int = PART) -> DataFrame:
    """For each of a set of queries (query_id, unit) the k nearest, ties by id: (query_id, id, score, rank).

    Parts of the index meet blocks of at most about `most` queries, each pair in one task as a matrix product; of a pair only k rows
    for each query leave it, so a task holds a part and a block, and no row for each pair of vectors is ever made. Ids of the index are unique.
    """
    parts, blocks = max(1, -(-index.count() // part)), max(1, -(-queries.count() // most))
    dealt = lambda df, key, own, n, other, m: df.select(
        key, F.col("unit").cast("array<double>").alias("unit"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
    )
    left = dealt(index, "id", "_part", parts, "_block", blocks).groupBy("_part", "_block")
    right = dealt(queries, "query_id", "_block", blocks, "_part", parts).groupBy("_part", "_block")

    def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if rows.num_rows and asked.num_rows:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start"))
            i, j, score = _cell(rows, asked, k)
        else:
            i, j, score = [], [], pa.array([], pa.float64())
        take = lambda table, name, at: table[name].take(pa.array(at, pa.int64()))
        return pa.table({"query_id": take(asked, "query_id", i), "id": take(rows, "id", j), "score": score})

    kinds = {"query_id": queries.schema["query_id"], "id": index.schema["id"]}
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in kinds.items()) + ", score double"
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = left.cogroup(right).applyInArrow(nearest, schema)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def overfetched(index: DataFrame, query: list[float], k: int, keep: Column, factor: int = 4) -> DataFrame:
    """TOP-02 as a compatibility mode: filter after factor * k hits, so fewer than k may remain."""
    return top_k(index, query, factor * k).where(keep).orderBy(F.desc("score"), "id").limit(k)


def hits(found: DataFrame, segments: DataFrame, documents: DataFrame) -> DataFrame:
    """JON-05: hits with their rows; ids without a row drop out. The hits are k rows, so they are the broadcast side."""
    joined = segments.join(F.broadcast(found.select(F.col("id").alias("_id"), "score")), F.col("segment_id") == F.col("_id"))
    return joined.join(documents.withColumnRenamed("id", "doc_id"), "doc_id")


def spread(vectors: np.ndarray, number: int) -> np.ndarray:
    """The first vector and then, each time, the one that is farthest from those chosen."""
    if not len(vectors):
        return vectors
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < min(number, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


class CellIndex:
    """SNK-06, TOP-01, TOP-02: an index stored by cells, of which a search reads only those that can hold a hit.

    Centres are chosen from a bounded sample of the vectors, each the farthest from those before; a vector lies in the cell of its nearest centre, which is a folder, and a cell's
    radius is the distance of its farthest vector. By the triangle inequality nothing in a cell is nearer to a query than
    the centre is, less the radius. A search reads cells by that bound, twice as many each time, until the k-th hit so far is
    nearer than the bound of every cell left; so its hits are those of a scan. Only the sample, SAMPLE * MOST vectors at
    most, centres and radii, and k hits are ever on the driver. Vectors without a length (zero, null, or of another width than the centres) have no distance: they lie in a cell
    that is always read.
    """

    MOST = 1024
    SAMPLE = 16  # vectors for each centre
    PER_CELL = 10_000
    SLACK = 1e-9
    OPEN = -1  # the cell of what has no distance

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.read: list[int] = []  # cells of the last search

    def build(self, index: DataFrame, cells: int | None = None) -> CellIndex:
        """Writes an index (id, unit, ...) of unit vectors; cells defaults to one for each PER_CELL vectors."""
        whole = F.coalesce(F.exists("unit", lambda x: x != 0), F.lit(False)) & ~F.coalesce(F.exists("unit", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
        usable = index.where(whole)
        number = cells or usable.count() // self.PER_CELL
        number = max(1, min(self.MOST, number))
        sample = usable.orderBy(F.xxhash64("unit"), "id").limit(self.SAMPLE * number).select("unit").collect()
        centres = spread(np.array([r["unit"] for r in sample if len(r["unit"]) == len(sample[0]["unit"])], float), number)
        open_ = self.OPEN

        @F.pandas_udf("struct<cell:int,far:double>")
        def nearest(units: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"cell": np.full(len(units), open_, np.int32), "far": 0.0})
            fits = [
                i for i, u in enumerate(units)
                if len(centres) and u is not None and len(u) == centres.shape[1] and np.isfinite(u.astype(float)).all() and u.any()
            ]
            if fits:
                v = np.stack(units.iloc[fits].tolist()).astype(float)
                near = v @ centres.T
                out.loc[fits, "cell"] = near.argmax(1).astype(np.int32)
                out.loc[fits, "far"] = np.sqrt(((v - centres[near.argmax(1)]) ** 2).sum(1))
            return out

        placed = index.withColumn("_at", nearest("unit")).select(*index.columns, F.col("_at.cell").alias("cell"), F.col("_at.far").alias("far"))
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")
        placed.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")
        radii = self._rows().groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        middles = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        radii.join(F.broadcast(middles), "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        return self

    def _rows(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns).parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self._rows().drop("far")

    def search(self, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
        """As `top_k` over the whole index."""
        rows = self.vectors()
        q = np.array(query, float)
        q = q / (np.sqrt((q * q).sum()) or 1.0)
        bounds = {}
        for r in self.spark.read.parquet(f"{self.path}/cells").collect():
            distance = np.sqrt(((np.array(r["centre"]) - q) ** 2).sum()) if r["centre"] is not None and len(r["centre"]) == len(q) and q.any() else 0.0
            bounds[r["cell"]] = max(0.0, distance - r["radius"] - self.SLACK) if r["centre"] is not None else 0.0
        order = sorted(bounds, key=lambda c: (bounds[c], c))
        place = lambda r: (r["score"] is None, -(r["score"] or 0.0), r["id"])
        found: list = []
        self.read, step = [], 1
        schema = top_k(rows.drop("cell"), query, k, keep).schema
        while order:
            part, order = order[:step], order[step:]
            self.read += part
            best = top_k(rows.where(F.col("cell").isin(part)).drop("cell"), query, k, keep).collect()
            known: dict = {}
            for r in found + best:
                if r["id"] not in known or place(r) < place(known[r["id"]]):
                    known[r["id"]] = r
            found = sorted(known.values(), key=place)[:k]
            if len(found) == k and found[-1]["score"] is not None:
                # a distance of unit vectors from their cosine
                last = np.sqrt(max(0.0, 2 - 2 * found[-1]["score"])) + self.SLACK
                order = [c for c in order if bounds[c] <= last]
            step *= 2
        return self.spark.createDataFrame(found, schema)
