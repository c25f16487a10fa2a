"""SNK-08, SNK-09, SNK-11: a sink of one file for each document, which shows all of a write or nothing.

Rows are (name, content): reports and readers as text, PDFs and other renderings as bytes. Tasks write their files into a folder of
the write's own, and beside them a list of what they wrote. The driver's commit names the lists of the tasks that count in
one small file, which is moved into place as the last step; before that nothing is published. If a task fails for good, abort
removes the folder; what tasks still write that were running then is never shown. A later write to the same path takes the place of
the one before, once it is committed, and `sweep` deletes the folders that are not shown.

    sink.register(spark)
    pages.select("name", "content").write.format("files").option("path", path).mode("append").save()
    sink.published(spark, path)  # (name, file, bytes, sha256)

The path is one that pyarrow's file systems know: a folder that driver and executors share, or an object store.
"""

from __future__ import annotations

import hashlib
import json
import textwrap
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LISTED = "name string, file string, bytes long, sha256 string"
CURRENT = "_published.json"


class _Done(WriterCommitMessage):
    def __init__(self, listed: str | None, files: int):
        self.listed, self.files = listed, files


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.folder = path.rstrip("/"), f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = place(self.path)
        own = f"{root}/{self.folder}/{uuid.uuid4().hex}"  # attempts of one task do not meet
        listed = []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = content.encode() if isinstance(content, str) else content or b""
                if not listed:
                    files.create_dir(own, recursive=True)
                target = f"{own}/{len(listed):06d}"
                with files.open_output_stream(target) as out:
                    out.write(data)
                listed.append({"name": name, "file": target, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        if not listed:
            return _Done(None, 0)
        with files.open_output_stream(f"{own}/list.json") as out:
            out.write("".join(json.dumps(x) + "\n" for x in listed).encode())
        return _Done(f"{own}/list.json", len(listed))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = place(self.path)
        done = [m for m in messages if m is not None]
        files.create_dir(root, recursive=True)
        body = json.dumps({"lists": [m.listed for m in done if m.listed], "files": sum(m.files for m in done)})
        with files.open_output_stream(f"{root}/{self.folder}.json") as out:
            out.write(body.encode())
        files.move(f"{root}/{self.folder}.json", f"{root}/{CURRENT}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = place(self.path)
        if files.get_file_info(f"{root}/{self.folder}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.folder}")


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)


def published(spark: SparkSession, path: str) -> DataFrame:
    """What the last committed write to a path shows: a row for each file; none where nothing has been published."""
    files, root = place(path.rstrip("/"))
    if files.get_file_info(f"{root}/{CURRENT}").type == fs.FileType.NotFound:
        return spark.createDataFrame([], LISTED)
    with files.open_input_stream(f"{root}/{CURRENT}") as f:
        lists = json.loads(f.read())["lists"]  # one for each task
    return spark.read.schema(LISTED).json(lists) if lists else spark.createDataFrame([], LISTED)


def sweep(path: str) -> None:
    """Deletes what the current publication does not show; for times when no write is under way."""
    files, root = place(path.rstrip("/"))
    with files.open_input_stream(f"{root}/{CURRENT}") as f:
        shown = {name.rsplit("/", 3)[1] for name in json.loads(f.read())["lists"]}
    for info in files.get_file_info(fs.FileSelector(root)):
        if info.type == fs.FileType.Directory and info.base_name not in shown:
            files.delete_dir(info.path)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the published files, read where they lie."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                files, _ = place(path)
                with files.open_input_stream(batch.column("file")[i].as_py()) as f:
                    yield pa.record_batch([batch.column("name").slice(i, 1), pa.array([f.read()], pa.binary())], ["name", "content"])

    return published(spark, path).select("name", "file").mapInArrow(read, "name string, content binary")


PAGE_LINES, WIDTH = 54, 90


def pdf_bytes(text: str) -> bytes:
    """SNK-09: a text as a PDF in a standard font; letters that the font does not have become question marks."""
    lines = [piece for line in text.split("\n") for piece in (textwrap.wrap(line, WIDTH, break_long_words=True) or [""])]
    pages = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)]
    plain = lambda s: s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for page in pages:
        body = b"BT /F1 10 Tf 14 TL 60 780 Td " + b" ".join(b"(" + plain(line) + b") Tj T*" for line in page) + b" ET"
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        content = len(objects)
        objects.append(
            b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % content
        )
    kids = b" ".join(b"%d 0 R" % n for n in range(5, len(objects) + 1, 2))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages))
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (
        len(objects) + 1, table, len(objects) + 1, len(out),
    )


def pdf(text: Column) -> Column:
    """SNK-09: the PDF of each text, null for null."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else pdf_bytes(t)), "binary")(text)
