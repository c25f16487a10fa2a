"""An index by cells finds what a scan finds, and reads few cells where vectors are clustered."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import search


@pytest.fixture(scope="module")
def index(spark):
    r = np.random.default_rng(3)
    middles = r.normal(size=(30, 16))
    rows = [(i, int(i % 5), [float(x) for x in middles[i % 30] + r.normal(size=16) * 0.15]) for i in range(1500)]
    rows += [(2000 + i, 1, rows[i][2]) for i in range(5)]  # ties
    rows += [(7, 2, rows[9][2]), (3000, 1, [0.0] * 16), (3001, 1, None), (3002, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "key long, label int, v array<double>")
    return search.add_vectors(df, "key", "v").join(df.select(F.col("key").alias("id"), "label").dropDuplicates(["id"]), "id")


def test_hits_are_those_of_a_scan(spark, index, tmp_path):
    cells = search.CellIndex(spark, str(tmp_path)).build(index, 40)
    assert cells.vectors().count() == index.count()
    r = random.Random(1)
    near = [x["unit"] for x in index.where("id < 300").collect()]
    few = 0
    for n in range(12):
        query = r.choice(near) if n % 3 else [r.gauss(0, 1) for _ in range(16)]
        keep = [None, F.col("label") == 1, F.col("label") > 7][n % 3]
        k = r.choice([1, 5, 30])
        usable = index.where(F.size("unit") == 16)
        want = [(x["id"], round(x["score"], 9)) for x in search.top_k(usable, query, k, keep).collect()]
        got = [(x["id"], round(x["score"], 9)) for x in cells.search(query, k, keep).orderBy(F.desc("score"), "id").collect() if x["score"] is not None]
        assert got[: len(want)] == want
        few += n % 3 == 1 and k < 30 and len(cells.read) < 20
    assert few


def test_empty_indexes_and_no_query(spark, tmp_path):
    none = spark.createDataFrame([], "id long, unit array<double>")
    cells = search.CellIndex(spark, str(tmp_path)).build(none)
    assert cells.search([1.0, 0.0], 3).count() == 0


def test_each_query_s_hits_are_those_of_all_pairs_without_their_rows(spark, index):
    odd = [(4000, None), (4001, [1.0, None] + [0.0] * 14), (4002, [float("nan")] * 16), (4003, [float("nan")] + [0.0] * 15), (4004, []), (4005, [2.0, 1.0])]
    rows = index.dropDuplicates(["id"]).select("id", "unit").unionByName(spark.createDataFrame(odd, "id long, unit array<double>")).coalesce(2).cache()
    queries = rows.where("id % 100 = 0 or id >= 3000").select(F.col("id").alias("query_id"), "unit")
    pairs = rows.join(queries.withColumnRenamed("unit", "q")).select("query_id", "id", X.dot(F.col("unit"), F.col("q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    order = lambda df: [(*r[:2], str(r[2]), r[3]) for r in df.orderBy("query_id", "rank").collect()]
    for k, most, part in ((5, 10_000, 8192), (3, 4, 100), (2000, 10, 700)):
        found = search.top_k_each(rows, queries, k, most, part)
        assert order(found) == order(pairs.withColumn("rank", rank).where(F.col("rank") <= k))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert search.top_k_each(rows.limit(0), queries, 5).count() == search.top_k_each(rows, queries.limit(0), 5).count() == 0
