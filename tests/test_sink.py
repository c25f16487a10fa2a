"""Files of a write are published together or not at all."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from lectern.plans import source_queries
from lectern.sources import sink


def write(df, path):
    sink.register(df.sparkSession)
    df.write.format("files").option("path", path).mode("append").save()


def test_a_write_is_published_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sink.published(spark, path).count() == 0
    rows = [(f"d{i}", None if i == 3 else f"text é {i}") for i in range(40)]
    write(spark.createDataFrame(rows, "name string, content string").repartition(4), path)
    got = {x["name"]: x for x in sink.published(spark, path).collect()}
    assert len(got) == 40 and got["d5"]["sha256"] == hashlib.sha256("text é 5".encode()).hexdigest() and got["d3"]["bytes"] == 0
    assert {x["name"]: bytes(x["content"]).decode() for x in sink.contents(spark, path).collect()} == {n: t or "" for n, t in rows}
    # a task that fails for good leaves nothing, and what was published stays
    folders = {f.name for f in (tmp_path / "out").iterdir()}
    broken = spark.range(20).repartition(4).select(
        F.col("id").cast("string").alias("name"), F.when(F.col("id") == 13, F.raise_error("broken")).otherwise("x").alias("content")
    )
    with pytest.raises(Exception, match="broken"):
        write(broken, path)
    assert sink.published(spark, path).count() == 40 and sink.contents(spark, path).count() == 40
    time.sleep(1)  # tasks that were still running
    sink.sweep(path)
    assert {f.name for f in (tmp_path / "out").iterdir()} == folders and sink.contents(spark, path).count() == 40
    write(spark.createDataFrame([("new", "n")], "name string, content string"), path)
    assert [x["name"] for x in sink.published(spark, path).collect()] == ["new"]
    write(spark.createDataFrame([], "name string, content string"), path)
    assert sink.published(spark, path).count() == 0


def test_pdf(spark):
    data = sink.pdf_bytes("\n".join(["A (b) \\ c é λ", "", "word " * 60] + [f"line {i}" for i in range(70)]))
    assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n") and b"/Count 2" in data and b"A \\(b\\) \\\\ c \xe9 ?" in data
    at = int(data.split(b"startxref\n")[1].split()[0])
    assert data[at : at + 4] == b"xref"
    for n, line in enumerate(data[at:].split(b"\n")[3:8], 1):
        assert data[int(line[:10]) :].startswith(b"%d 0 obj" % n)
    df = spark.createDataFrame([("a",), (None,)], "t string").select(sink.pdf(F.col("t")).alias("p"))
    assert [x["p"] is None for x in df.collect()] == [False, True]


def test_page_files_are_written_by_tasks(spark, tmp_path):
    """thousands of pages take folders by the thousand, not one each; equal numbers, null and empty pages keep their rows."""
    rows = [(i, f"<p>é {i}\n</p>\n") for i in range(2500)] + [(7, "again"), (3000, None), (3001, "")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = source_queries.src01_files(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, f"page{i}", t or "") for i, t in rows)
    folders = source_queries._page_files(spark.read.parquet(str(tmp_path / "pages.parquet")), str(tmp_path / "files"))
    assert len(folders) <= 4 and len([p for p in (tmp_path / "files").rglob("*") if p.is_dir()]) <= 2 * len(folders) + 4
