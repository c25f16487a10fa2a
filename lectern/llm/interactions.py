"""Audit of how filters interact, by an incidence-matrix product.

Five filters judge every document; which of them it fails is a mask of five bits. All that the order of the filters can do
to a part of the table follows from three histograms of masks: of its documents, of its good and of its toxic ones. They are
stacked as rows of 32 counts and multiplied by constant integer matrices of 32 rows and 600 columns, one column for each
step of each of the 120 orders: 1 where a mask is kept after the step, removed in it, redundant in it or failing its filter
alone. So the table is read once, whatever the number of orders.

Failing conditions, with words as maximal runs of other characters than space, tab, LF, VT, FF and CR:

* A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * [A-Z] > 5 * code points; D: any of #$%&*|;
* E: the text of a smaller doc_id anywhere in the table. Texts are compared by SHA-256. Only the smallest doc_id of a text
  passes, so what E needs of the rows of a text, in a part and with like labels, is their number and the smallest id with
  its rows; groups of copies are summed up before they are shuffled, and no row meets another.

Row rules: a null text is empty, a null source is the part ''. Rows with a null doc_id neither fail E nor make others fail,
and have no labels; rows that repeat a doc_id with the same text pass or fail E together. A document is good (toxic) if any
row of `labels` with its doc_id has quality (toxic) 1; labels of other ids, and null ones, do not count. Only the named
columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
SPACE = " \t\n\x0b\f\r"
PARTS = 64  # parts that a worker holds the 600 rows of at a time
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: 32 x 600 matrices of 0 and 1, columns by order, then step."""
    mask = np.arange(MASKS)[:, None]
    own = np.array([1 << FILTERS.index(f) for order in ORDERS for f in order])
    earlier = np.array([sum(1 << FILTERS.index(f) for f in order[:i]) for order in ORDERS for i in range(len(FILTERS))])
    fails, gone = mask & own > 0, mask & earlier > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == own}
    return {name: m.astype(np.int64) for name, m in found.items()}


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4, 8 of the filters A to D."""
    bare = F.btrim(text, F.lit(SPACE))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failing = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the numbers of documents with each mask of A to E."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text_mask(text).alias("mask")
    )
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    marks = labels.where("doc_id is not null").select("doc_id", F.col("quality").alias("good"), "toxic").groupBy("doc_id").agg(one("good"), one("toxic"))
    marked = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    like = ["key", "part", "mask", "good", "toxic"]
    ids = marked.groupBy("doc_id", *like).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = ids.groupBy(*like).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("low"),
    )
    # of one text there are at most as many groups as parts, four times
    first = F.min("low.doc_id").over(Window.partitionBy("key"))
    passing = F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    split = groups.withColumn("first", first).withColumn("copies", F.col("known") - passing)
    each = split.select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n"))
            )
        ).alias("x"),
    ).where("x.n > 0")
    n = F.col("x.n")
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, all counts within the part."""
    stacked = judged(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))  # at most 32 each

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = matrices()
        order = [o for o in ORDERS for _ in FILTERS]
        step = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        own = np.array([FILTERS.index(f) for o in ORDERS for f in o])
        for batch in (b.slice(i, PARTS) for b in batches for i in range(0, b.num_rows, PARTS)):
            parts = batch.column("part").to_pylist()
            rows = np.zeros((3, len(parts), MASKS), np.int64)
            lengths = np.array([len(x) for x in batch.column("mask").to_pylist()])
            at = np.repeat(np.arange(len(parts)), lengths)
            mask = batch.column("mask").flatten().to_numpy()
            for k, name in enumerate(("n", "good", "toxic")):
                rows[k, at, mask] = batch.column(name).flatten().to_numpy()
            removed = rows @ m["removed"]
            total = np.stack([removed[0][:, own == f].sum(1) for f in range(len(FILTERS))], 1)
            values = [rows[0] @ m["kept"], removed[0], rows[0] @ m["redundant"], rows[0] @ m["unique"], removed[1], removed[2], total[:, own]]
            yield {
                "part": [p for p in parts for _ in order],
                "filter_order": order * len(parts),
                "step": np.tile(step, len(parts)),
            } | {name: v.ravel() for name, v in zip(COUNTS, values, strict=True)}

    flat = stacked.select("part", "h.mask", "h.n", "h.good", "h.toxic")
    return map_arrow(flat, product, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
