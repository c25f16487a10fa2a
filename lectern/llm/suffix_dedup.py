"""Suffix-array dedup: removes bytes covered by a string of `length` bytes that also starts anywhere else.

Only equality of suffixes to a depth of `length` bytes matters, so suffixes are ordered by a hash of their first `length`
bytes in place of the bytes themselves: any order that puts equal suffixes side by side gives the same matches. Two
independent 64-bit hashes must agree in the index (of the string and of the anchor in it elsewhere), so accidental matches
are not to be expected at any size of corpus.

1. Anchors: of each window of `length` bytes the GRAM-byte string with the least hash, leftmost on ties, is its anchor.
   It depends on the window's content alone, so equal windows have equal anchors at equal places; runs of windows share
   one anchor, about one for each 150 bytes of text. An anchor carries the hash of its string and of its whole context,
   all bytes of its windows.
2. Contexts that occur twice are long matches as a whole; strings that occur once hold no match. What is left are the
   anchors whose string occurs in different contexts: the ends of matches.
3. Their contexts, one of each kind, are dealt by the string's hash to partitions, and each partition keeps a
   logarithmic index: a batch of contexts gets its suffix array, which is merge-scanned against every level for long
   matches and becomes a level itself; levels of equal size merge, geometrically. A level holds each suffix once, with a
   mark for a long match, so n equal suffixes cost one entry.
4. The matched windows are joined to their documents, which drop the covered bytes.

`StoredIndex` keeps the anchors between runs, in levels that grow by merging, so that later batches meet earlier ones.

`shared_runs` is a report of its own on word runs, which the removal of bytes does not use.

An anchor string with more than `hot` different contexts is not dealt to one partition; its windows become rows instead,
counted with map-side combining and joined back, which gives the same matches.

Null and empty texts give zero counts and the hash of no bytes. Repeated rows are matches of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, blocks, doc_text, map_arrow, materialize, mix

GRAM = 100
BLOCK = 1 << 18
_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
SHARED_WORDS, SHARED_GRAM = 51, 26
_BASE = 0x9E6C63D0876A9A47
_UP = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * BLOCK, _BASE, np.uint64))])
_DOWN = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * BLOCK, pow(_BASE, -1, 1 << 64), np.uint64))])
_RANDOM2 = mix(_RANDOM + np.uint64(0x2545F4914F6CDD1D))
_BASE2 = 0xC2B2AE3D27D4EB4F
_UP2 = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * BLOCK, _BASE2, np.uint64))])
_DOWN2 = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * BLOCK, pow(_BASE2, -1, 1 << 64), np.uint64))])
BATCH = 1024


def prefix_sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(_RANDOM[x] * _UP[: len(x)])])


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges of the text behind sums."""
    return mix((sums[end] - sums[start]) * _DOWN[start])


def anchors(x: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """first window, number of windows, anchor position, hash of its string, hash of its context; len(x) >= length."""
    sums = prefix_sums(x)
    at = np.arange(len(x) - gram + 1)
    h = range_hash(sums, at, at + gram)
    key = (h & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
    width = length - gram + 1
    step, low = 1, key
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(x) - length + 1], low[width - step : width - step + len(x) - length + 1])
    place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.concatenate([[0], (place[1:] != place[:-1]).nonzero()[0] + 1])
    number = np.diff(first, append=len(place))
    place = place[first]
    context = mix(
        range_hash(
            sums, first, first + number - 1 + length
        ) + (place - first).astype(np.uint64) * np.uint64(0x10001) + number.astype(np.uint64)
    )
    return first, number, place, h[place], context


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, first, number, place, gram, context); doc_id and text_hash stand for the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("first", "number", "place", "gram", "context")
        for batch in batches:
            ids, hashes, parts = [], [], []
            size = 0

            def rows() -> dict:
                columns = [np.concatenate([p[i] for p in parts]) for i in range(5)]
                n = [len(p[0]) for p in parts]
                return {
                    "doc_id": pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))),
                    "text_hash": np.repeat(np.array(hashes, np.int64), n),
                } | {k: c.view(np.int64) for k, c in zip(names, columns, strict=True)}

            for doc_id, text_hash, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), strict=True
            ):
                x = np.frombuffer(text.as_buffer(), np.uint8)
                for s in range(0, len(x) - length + 1, BLOCK):
                    part = anchors(x[s : s + BLOCK + length - 1], length, gram)
                    parts.append((part[0] + s, part[1], part[2] + s, *part[3:]))
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    size += len(part[0])
                    if size > 50_000:
                        yield rows()
                        ids, hashes, parts, size = [], [], [], 0
            if parts:
                yield rows()

    return map_arrow(
        docs.select("doc_id", "text_hash", "text"),
        run,
        "doc_id long, text_hash long, first long, number long, place long, gram long, context long",
    )


class LogIndex:
    """Suffix arrays in levels of geometric sizes: per suffix its two hashes, its owner and a mark."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    @staticmethod
    def _equal(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places in a and b of the suffixes that both hold."""
        at = np.searchsorted(a[0], b[0])
        ok = at < len(a[0])
        ok[ok] = (a[0][at[ok]] == b[0][ok]) & (a[1][at[ok]] == b[1][ok])
        return at[ok], ok.nonzero()[0]

    def add(self, suffix: np.ndarray, second: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Adds a batch; returns the owners of its suffixes that have been seen before, in it or in a level."""
        order = np.argsort(suffix, kind="stable")  # equal first hashes of different strings are not to be expected in a batch
        s, t, o = suffix[order], second[order], owner[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])]) if len(s) else np.zeros(0, bool)
        start = new.nonzero()[0]
        again = np.diff(start, append=len(s)) > 1
        seen = [o[~new]]
        level = [s[start], t[start], o[start], again]
        for old in self.levels:
            there, here = self._equal(old, level)
            old[3][there] = True
            seen.append(level[2][here])
            level = [np.delete(c, here) for c in level]
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            old = self.levels.pop()
            at = np.searchsorted(old[0], level[0])
            level = [np.insert(a, at, b) for a, b in zip(old, level, strict=True)]
        self.levels.append(level)
        return np.concatenate(seen)

    def marked(self) -> np.ndarray:
        """Owners of the first occurrences that have been met again."""
        return np.concatenate([o[m] for _, _, o, m in self.levels] or [np.zeros(0, np.int64)])


def _suffixes(text: bytes, number: int, place: int, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window."""
    x = np.frombuffer(text, np.uint8)
    w = np.arange(number)
    # the anchor's string and its place in the window are part of what must be equal
    first = mix(range_hash(prefix_sums(x), w, w + length) + np.uint64(gram & ((1 << 64) - 1)) + (place - w).astype(np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_RANDOM2[x] * _UP2[: len(x)])])
    return first, mix((sums[w + length] - sums[w]) * _DOWN2[w])


def shared_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shared): how many word runs of a text other documents have too, for the texts that have any.

    Of each window of SHARED_WORDS words the string of SHARED_GRAM words with the least hash is kept, and those that two rows
    have are counted, each once. So any run of SHARED_WORDS words in two documents gives both at least one. Only hashes are
    shuffled.
    """
    keyed = doc_text(docs).withColumn("text_hash", F.xxhash64("text", F.length("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashed = WordHash()
        width = SHARED_WORDS - SHARED_GRAM + 1
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts):
                kept = []
                for h in hashed.many([t.split() for t in texts[a:b]]):
                    if len(h) < SHARED_WORDS:
                        kept.append(np.zeros(0, np.int64))
                        continue
                    g = h
                    for step in (1, 2, 4, 8):  # runs of 16 words, then two of them
                        g = mix(g[:-step] * np.uint64(0x9E3779B97F4A7C15) + g[step:])
                    rest = SHARED_GRAM - 16
                    g = mix(g[:-rest] * np.uint64(0x9E3779B97F4A7C15) + g[rest:])
                    low, step = g, 1
                    while 2 * step <= width:
                        low = np.minimum(low[:-step], low[step:])
                        step *= 2
                    n = len(h) - SHARED_WORDS + 1
                    low = np.minimum(low[:n], low[width - step : width - step + n])
                    kept.append(np.unique(low).view(np.int64))
                n = [len(k) for k in kept]
                rows = pa.array(np.repeat(np.arange(a, b), n))
                yield {
                    "doc_id": batch.column("doc_id").take(rows),
                    "text_hash": batch.column("text_hash").take(rows),
                    "run": np.concatenate(kept),
                }

    rows = materialize(map_arrow(keyed.select("doc_id", "text_hash", "text"), run, "doc_id long, text_hash long, run long"), "runs")
    common = rows.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    return rows.join(common, "run", "left_semi").groupBy("doc_id", "text_hash", "run").agg(F.lit(1).alias("one")).groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_shared")
    )


CONTEXT = "doc_id long, text_hash long, first long, number long, place long, gram long, only boolean, bytes binary"


def contexts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted anchor's windows."""
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "number", "place", "gram", "only")).alias("a"))
    on = [F.equal_null(docs["doc_id"], lists["doc_id"]), docs["text_hash"] == lists["text_hash"]]
    one = docs.join(lists, on).select(docs["doc_id"], docs["text_hash"], "a", "text")
    cut = one.select(
        "doc_id",
        "text_hash",
        F.col("text").cast("binary").alias("bytes"),
        "a.first",
        "a.number",
        "a.place",
        "a.gram",
        F.transform("a.only", lambda x: x.cast("int")).alias("only"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                raw = row["bytes"].as_buffer()
                first, number, place, gram, only = (
                    np.array(row[n].as_py(), np.int64)
                    for n in ("first", "number", "place", "gram", "only")
                )
                n = len(first)
                yield {
                    "doc_id": [row["doc_id"].as_py()] * n,
                    "text_hash": [row["text_hash"].as_py()] * n,
                    "first": first,
                    "number": number,
                    "place": place,
                    "gram": gram,
                    "only": only.astype(bool),
                    "bytes": [raw[int(a) : int(a + k - 1 + length)].to_pybytes() for a, k in zip(first, number, strict=True)],
                }

    return map_arrow(cut, run, CONTEXT)


MATCHED = "doc_id long, text_hash long, start long"


def index_matches(table: DataFrame, length: int) -> DataFrame:
    """Windows (doc_id, text_hash, start) of single contexts that match elsewhere, by the logarithmic index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = LogIndex()
        ids: list = []
        hashes: list[int] = []
        firsts: list[int] = []
        only: list[bool] = []

        def rows(owner: np.ndarray) -> dict:
            r = owner >> 20
            keep = np.array(only, bool)[r] if len(r) else np.zeros(0, bool)
            r, w = r[keep], (owner & ((1 << 20) - 1))[keep]
            return {
                "doc_id": [ids[i] for i in r],
                "text_hash": np.array(hashes, np.int64)[r] if len(r) else [],
                "start": np.array(firsts, np.int64)[r] + w if len(r) else [],
            }

        for batch in batches:
            for s in range(0, batch.num_rows, BATCH):
                part = batch.slice(s, BATCH)
                column = {
                    n: part.column(n).to_pylist()
                    for n in ("doc_id", "text_hash", "first", "number", "place", "gram", "only", "bytes")
                }
                base = len(ids)
                ids += column["doc_id"]
                hashes += column["text_hash"]
                firsts += column["first"]
                only += column["only"]
                columns = zip(column["bytes"], column["number"], column["place"], column["first"], column["gram"], strict=True)
                both = [_suffixes(b, n, p - f, g, length) for b, n, p, f, g in columns]
                owner = [(np.int64(base + i) << 20) + np.arange(len(x)) for i, (x, _) in enumerate(both)]
                if both:
                    yield rows(index.add(np.concatenate([x for x, _ in both]), np.concatenate([y for _, y in both]), np.concatenate(owner)))
        yield rows(index.marked())

    return map_arrow(table, run, MATCHED)


def row_matches(table: DataFrame, length: int) -> DataFrame:
    """The same for anchor strings of very many contexts: windows as rows, counted with map-side combining."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _suffixes(row["bytes"], row["number"], row["place"] - row["first"], row["gram"], length)[0].view(np.int64)
                n = len(s)
                yield {
                    "doc_id": [row["doc_id"]] * n,
                    "text_hash": [row["text_hash"]] * n,
                    "start": row["first"] + np.arange(n),
                    "gram": [row["gram"]] * n,
                    "suffix": s,
                    "only": [row["only"]] * n,
                }

    windows = map_arrow(table, run, MATCHED + ", gram long, suffix long, only boolean")
    twice = windows.groupBy("gram", "suffix").agg(F.count("*").alias("n")).where("n > 1").select("gram", "suffix")
    return windows.where("only").join(twice, ["gram", "suffix"], "left_semi").select("doc_id", "text_hash", "start")


def matches(rows: DataFrame, keyed: DataFrame, length: int, hot: int, per_partition: int) -> DataFrame:
    """(doc_id, text_hash, start, end) covered bytes of the documents whose anchor rows are new; keyed holds all their texts."""
    one = F.min(F.struct("doc_id", "text_hash", "first", "number", "place")).alias("one")
    kinds = rows.groupBy("gram", "context").agg(F.count("*").alias("n"), one, F.bool_or("new").alias("new"))
    strings = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = materialize(kinds.join(strings, "gram", "left").where("n > 1 or kinds > 1"), "kinds")
    whole = rows.where("new").join(kinds.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    spans = whole.select("doc_id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("number") - 1 + length).alias("end"))
    wanted = kinds.where("kinds > 1").select("one.*", "gram", (F.col("new") & (F.col("n") == 1)).alias("only"), "kinds")
    size = wanted.agg(F.count("*"), F.max("kinds")).first()
    if size[0]:
        few, many = wanted.where(f"kinds <= {hot}").drop("kinds"), wanted.where(f"kinds > {hot}").drop("kinds")
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size[0] // per_partition))
        found = index_matches(contexts(few, keyed, length).repartition(parts, "gram"), length)
        if size[1] > hot:
            found = found.unionByName(row_matches(contexts(many, keyed, length), length))
        spans = spans.unionByName(found.select("doc_id", "text_hash", "start", (F.col("start") + length).alias("end")))
    return spans


class StoredIndex:
    """The logarithmic family between runs: a folder in shared storage with levels of anchors, one for a range of batches each.

    A batch is matched against itself and all levels, becomes a level, and levels of at most twice the last one's size merge
    into it, so there are as many levels as the logarithm of the rows. A level that a merge has replaced is left out by
    its range, whether or not it has been deleted yet.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = 400, gram: int = GRAM):
        self.spark, self.path, self.length, self.gram = spark, path.rstrip("/"), length, gram

    def levels(self) -> list[tuple[int, int, int]]:
        """(first batch, last batch, rows) of the levels in force, in order."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [s.getPath() for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        found = sorted(tuple(map(int, p.getName().split("-"))) for p in done)
        return [x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found)]

    def _read(self, level: tuple[int, int, int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{'-'.join(map(str, level))}")

    def _write(self, rows: DataFrame, first: int, last: int, size: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{first}-{last}-{size}")

    def add(self, batch: DataFrame, earlier: DataFrame | None = None, hot: int = 5_000, per_partition: int = 12_000) -> DataFrame:
        """(doc_id, text_hash, start, end): bytes of a batch's documents covered by strings that also start elsewhere in it or
        in an earlier batch; overlapping ranges are not merged. earlier: the documents of the batches before."""
        keyed = doc_text(batch).withColumn("text_hash", F.xxhash64("text", F.length("text")))
        own = materialize(anchor_rows(keyed, self.length, self.gram), "anchors")
        levels = self.levels()
        rows, texts = own.withColumn("new", F.lit(True)), keyed
        if levels:
            strings = own.select("gram").distinct()
            for level in levels:
                rows = rows.unionByName(self._read(level).join(strings, "gram", "left_semi").select(*own.columns).withColumn("new", F.lit(False)))
            rows = materialize(rows, "met")
            old = doc_text(earlier).withColumn("text_hash", F.xxhash64("text", F.length("text")))
            texts = keyed.unionByName(old)
        found = materialize(matches(rows, texts, self.length, hot, per_partition).distinct(), "matches")
        self._add_level(own, levels)
        return found

    def _add_level(self, rows: DataFrame, levels: list[tuple[int, int, int]]) -> None:
        number = levels[-1][1] + 1 if levels else 0
        first, size = number, rows.count()
        while levels and levels[-1][2] <= 2 * size:
            level = levels.pop()
            rows, first, size = rows.unionByName(self._read(level)), level[0], size + level[2]
        self._write(rows, first, number, size)


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = GRAM, hot: int = 5_000, per_partition: int = 12_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are the removed runs as start:end."""
    keyed = doc_text(docs).withColumn("text_hash", F.xxhash64("text", F.length("text")))
    anchored = materialize(anchor_rows(keyed, length, gram), "anchors").withColumn("new", F.lit(True))
    spans = matches(anchored, keyed, length, hot, per_partition)
    merged = spans.groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))
    on = [F.equal_null(keyed["doc_id"], merged["doc_id"]), keyed["text_hash"] == merged["text_hash"]]
    joined = keyed.join(merged, on, "left").select(
        keyed["doc_id"],
        F.col("text").cast("binary").alias("bytes"),
        "start",
        "end",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            for raw, starts, ends in zip(*(batch.column(n) for n in ("bytes", "start", "end")), strict=True):
                text = raw.as_py()
                cuts: list[list[int]] = []
                if starts.as_py():
                    s, e = np.array(starts.as_py()), np.array(ends.as_py())
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    cuts = np.stack([s[new], e[np.concatenate([new[1:], [True]])]], 1).tolist()
                digest, at = hashlib.sha256(), 0
                for a, b in cuts:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(b - a for a, b in cuts))
                out["n_spans"].append(len(cuts))
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append(",".join(f"{a}:{b}" for a, b in cuts))
            yield {"doc_id": batch.column("doc_id")} | out

    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
