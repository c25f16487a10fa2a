"""Clustered layout of documents in four dimensions, and what its files' bounds are worth to range queries.

Documents are ordered by source, lang, length and date at once: each value's coordinate is its rank among all rows in eighths,
and the binary digits of the four coordinates, interleaved, give the place z along which rows are cut into files of a fixed
number of rows. Every row then asks for the rows of its own source and lang coordinates whose length and date
coordinates are at most one away. Queries depend on the cell z alone, and there are at most 4,096 cells.

* Coordinates. Values with their numbers of rows are sorted in ranges and summed up: in each range, and over the ranges'
  sums. Only the least value of each coordinate goes to the driver, at most 8 for each dimension; rows are placed by comparing
  with these.
* Positions. Rows are sorted in ranges by (z, doc_id); a row's position is its place in its range behind the sizes of the
  ranges before.
* files_touched, by complement counting: of the files that cover a source and a lang coordinate, those whose length range
  misses, less those whose date range misses, plus those of which both do. A range that misses lies wholly below or wholly above, so
  each number is one entry of a two-dimensional cumulative histogram of the files' corners (upper or lower length bound
  by upper or lower date bound): four of 64 entries for each (source, lang).
* files_matching, by cell-file intervals: rows of a cell are neighbours, so a cell lies in an interval of files, each of
  which holds a row of it. A query's files are the union of the intervals of at most 9 cells, which follow each other in z.

What depends on the number of rows is never in one task, on the driver or broadcast: the driver sees 32 values at most, the
broadcast tables hold a row for each cell or each range of a shuffle.

Row rules: null source and lang are the smallest values, a null text has length -1. A null doc_id has the date of the empty
text (0) and comes first in its cell. Rows of one cell and doc_id are placed in any order; all else of their results is alike.
Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS = ["source", "lang", "length", "date"]
BITS = 3
COORDINATES = 1 << BITS
ROUND = ["date", "length", "lang", "source"]  # the order of digits within a round
ROWS = 2000
LOCAL = 33  # bits of monotonically_increasing_id below the partition's number


def values(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, length, date) of every row."""
    date = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 365
    return docs.select("doc_id", "source", "lang", F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long").alias("length"), date.alias("date"))


def offsets(slices: DataFrame) -> DataFrame:
    """(slice, offset, total) of (slice, n), a row for each range of a shuffle: the sum of the slices before, and of all."""
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return slices.select(
        "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(every).alias("total")
    )


def least_values(rows: DataFrame) -> dict[str, list[tuple[int, object]]]:
    """For each dimension the coordinates that occur, each with its least value; at most 8 each."""
    each = rows.selectExpr(
        "stack(4, 0, source, cast(null as long), 1, lang, null, 2, null, length, 3, null, date) as (dim, s, v)"
    )
    counted = each.groupBy("dim", "s", "v").agg(F.count("*").alias("n"))
    ordered = counted.repartitionByRange("dim", "s", "v").withColumn("slice", F.spark_partition_id())
    ordered = materialize(ordered, "values")
    sums = offsets(ordered.groupBy("slice").agg(F.sum("n").alias("n")))
    inside = Window.partitionBy("slice").orderBy("dim", "s", "v").rowsBetween(Window.unboundedPreceding, -1)
    smaller = ordered.join(F.broadcast(sums), "slice").withColumn(
        "smaller", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("offset") - F.expr("dim * (total div 4)")
    )
    placed = smaller.withColumn("coordinate", F.expr(f"{COORDINATES} * smaller div (total div 4)"))
    found: dict[str, list] = {name: [] for name in DIMENSIONS}
    for r in placed.groupBy("dim", "coordinate").agg(F.min(F.struct("s", "v")).alias("low")).orderBy("dim", "coordinate").collect():
        found[DIMENSIONS[r["dim"]]].append((int(r["coordinate"]), r["low"]["s"] if r["dim"] < 2 else r["low"]["v"]))
    return found


def coordinate(name: str, least: list[tuple[int, object]]) -> Column:
    """The last coordinate whose least value is not above the value; the first one's may be null."""
    first, *others = least or [(0, None)]
    out = F.lit(first[0])
    for c, low in others:
        out = F.when(F.col(name) >= F.lit(low), c).otherwise(out)
    return out.cast("int")


def interleaved(names: list[str] = ROUND, bits: int = BITS) -> Column:
    z = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for name in names:
            z = z * 2 + F.shiftright(F.col(name), bit).bitwiseAND(1)
    return z


def touched(files: DataFrame) -> DataFrame:
    """(source, lang, length, date, touched) of all cells whose source and lang some file covers, at most 4,096.

    files: source_min, source_max, lang_min, ... for each file.
    """
    corner = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), F.col(f"length_{x}").alias("x"), F.col(f"date_{y}").alias("y"))
    corners = [corner(k, x, y) for k, (x, y) in enumerate((("max", "max"), ("max", "min"), ("min", "max"), ("min", "min")))]
    each = files.select(
        F.explode(F.sequence("source_min", "source_max")).alias("source"), "lang_min", "lang_max", F.array(*corners).alias("corners")
    ).select("source", F.explode(F.sequence("lang_min", "lang_max")).alias("lang"), "corners").select("source", "lang", F.explode("corners").alias("c"))
    counted = each.groupBy("source", "lang", "c.kind", "c.x", "c.y").agg(F.count("*").alias("n"))

    def complement(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((4, COORDINATES, COORDINATES), np.int64)
        np.add.at(n, (part["kind"], part["x"], part["y"]), part["n"])
        # below[k][x, y]: corners at or beyond (x, y) as seen from the side that the kind's bound lies on
        sums = []
        for kind in range(4):
            flip = (slice(None, None, -1) if kind > 1 else slice(None), slice(None, None, -1) if kind % 2 else slice(None))
            padded = np.zeros((COORDINATES + 2, COORDINATES + 2), np.int64)
            padded[2:, 2:] = n[kind][flip].cumsum(0).cumsum(1)
            sums.append(padded)  # entry [a, b]: bounds at most a - 2 and b - 2, counted from the flipped ends
        high = COORDINATES + 1
        length, date = np.meshgrid(np.arange(COORDINATES), np.arange(COORDINATES), indexing="ij")
        up, left = COORDINATES - 1 - length, COORDINATES - 1 - date
        below_l, above_l = sums[0][length, high], sums[2][up, high]
        below_d, above_d = sums[0][high, date], sums[1][high, left]
        both = sums[0][length, date] + sums[1][length, left] + sums[2][up, date] + sums[3][up, left]
        met = sums[0][high, high] - below_l - above_l - below_d - above_d + both
        return pd.DataFrame(
            {"source": key[0], "lang": key[1], "length": length.ravel(), "date": date.ravel(), "touched": met.ravel()}
        )

    return counted.groupBy("source", "lang").applyInPandas(complement, "source int, lang int, length int, date int, touched long")


def matching(cells: DataFrame) -> DataFrame:
    """(z, matching) of cells (z, the coordinates, first_file, last_file), at most 4,096 with 9 intervals each."""
    near = F.array(*[F.struct(F.lit(i).alias("l"), F.lit(j).alias("d")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = cells.select(F.col("z").alias("query"), "source", "lang", "length", "date", F.explode(near).alias("by")).select(
        "query", "source", "lang", (F.col("length") + F.col("by.l")).alias("length"), (F.col("date") + F.col("by.d")).alias("date")
    )
    found = asked.join(cells, ["source", "lang", "length", "date"])
    before = Window.partitionBy("query").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("last_file") - F.greatest("first_file", F.coalesce(F.max("last_file").over(before), F.lit(-1)) + 1) + 1
    return found.select("query", F.greatest(new, F.lit(0)).alias("new")).groupBy(F.col("query").alias("z")).agg(F.sum("new").alias("matching"))


def clustered_layout(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, z, position, file, files_touched, files_matching, file_bounds) of every row."""
    narrow = materialize(values(docs), "dimensions")
    least = least_values(narrow)
    placed = narrow.select("doc_id", *[coordinate(name, least[name]).alias(name) for name in DIMENSIONS]).withColumn("z", interleaved())
    ordered = placed.repartitionByRange("z", "doc_id").sortWithinPartitions("z", "doc_id").withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("slice", F.shiftright("at", LOCAL)), "ordered")
    sums = offsets(ordered.groupBy("slice").agg(F.count("*").alias("n"))).drop("total")
    position = F.col("offset") + F.col("at").bitwiseAND((1 << LOCAL) - 1)
    filed = ordered.join(F.broadcast(sums), "slice").withColumn("position", position).withColumn("file", F.expr(f"position div {rows}"))
    filed = filed.drop("at", "slice", "offset")
    bounds = [(name, end, getattr(F, end)) for name in DIMENSIONS for end in ("min", "max")]
    files = filed.groupBy("file").agg(*[f(name).alias(f"{name}_{end}") for name, end, f in bounds])
    cells = filed.groupBy("z", *DIMENSIONS).agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"))
    cells = materialize(cells, "cells")
    counts = cells.join(touched(files), DIMENSIONS).join(matching(cells), "z").select("z", "touched", "matching")
    one = Window.partitionBy("file")  # of a fixed number of rows
    named = filed.withColumn("file_bounds", F.concat_ws(",", *[f(name).over(one).cast("string") for name, _, f in bounds]))
    return named.join(F.broadcast(materialize(counts, "counts")), "z").select(
        "doc_id", "z", "position", "file", F.col("touched").alias("files_touched"), F.col("matching").alias("files_matching"), "file_bounds"
    )
