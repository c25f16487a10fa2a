"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a document is content-addressed by the SHA-256 of its bytes. Only (blob, rule, version) keys that the
ledger does not hold are scanned, each blob once however many paths carry it, and findings join back to all paths. What is
left to scan of a blob goes along with its text, so a rule's pattern never runs on a blob that the ledger holds for it, and
the texts of blobs with nothing left do not travel. `update_ledger` keeps a ledger as a Parquet table between runs.

Rules are regular expressions; matches are leftmost and not overlapping within a rule, then filtered by length. Offsets
are code points, end exclusive, summed from the lengths of the pieces between matches.

Null texts are empty blobs without findings. Repeated rows are paths of the same blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_text, materialize, sha256_hex


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    literal: str = ""  # a string that every match holds, to skip texts without it


# fixed values: the rules
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # the runs of 24 and more of [0-9a-f]+, as runs are maximal
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
)
RULES = BASE + MORE
LEDGER = "blob string, kind string, version int, found array<struct<start:long,end:long>>"


def _lengths(rule: Rule) -> Column:
    """Lengths of the pieces before the matches, the matches and their counted group, as an array of structs."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    length = lambda x: F.length(x).cast("long")
    zipped = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), length).alias("all"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), length).alias("own"),
    )
    possible = text.rlike(rule.pattern)
    if rule.literal:
        possible = text.contains(rule.literal) & possible
    return F.when(possible, zipped)


def name(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, text, todo): todo lists the names of the rules to run on each."""
    each = lambda r: F.when(
        F.array_contains("todo", name(r)),
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _lengths(r).alias("m")),
    )
    keys = blobs.select("blob", F.explode(F.array_compact(F.array(*map(each, rules)))).alias("r")).select("blob", "r.*")
    keys = materialize(keys.select("blob", "kind", "version", "least", "m"), "scanned")
    rows = keys.where("m is not null").select(
        "blob", "kind", "version", "least", F.posexplode("m").alias("i", "x")
    ).select("blob", "kind", "version", "least", "i", "x.*").where("`all` is not null")
    before = Window.partitionBy("blob", "kind", "version").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("all")).over(before)).where("own >= least")
    found = rows.groupBy("blob", "kind", "version").agg(
        F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("all")).alias("start"), "end"))).alias("found")
    )
    return keys.select("blob", "kind", "version").join(found, ["blob", "kind", "version"], "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<start:long,end:long>>"))
    )


def scan_versions(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """versions: doc_id, text, a row for each version of each path. Returns (new ledger rows, paths: doc_id, blob)."""
    texts = doc_text(versions).withColumn("text_hash", F.xxhash64("text", F.length("text")))
    paths = materialize(texts.select("doc_id", "text_hash", sha256_hex(F.col("text")).alias("blob")), "paths")
    # one row stands for each blob; its text is picked out by the row's cheap hash
    todo = paths.groupBy("blob").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row")
    ).select("blob", "row.*").withColumn("todo", F.array(*[F.lit(name(r)) for r in rules]))
    if ledger is not None:
        done = ledger.select(
            "blob", F.concat_ws(":", "kind", "version").alias("name")
        ).groupBy("blob").agg(F.collect_set("name").alias("done"))
        todo = todo.join(done, "blob", "left").withColumn(
            "todo", F.when(F.col("done").isNull(), F.col("todo")).otherwise(F.array_except("todo", "done"))
        ).drop("done").where("size(todo) > 0")
    on = [F.equal_null(texts["doc_id"], todo["doc_id"]), texts["text_hash"] == todo["text_hash"]]
    unseen = texts.join(todo, on).select("blob", "text", "todo")
    # the same version of the same path may be listed again: its keys are equal
    return materialize(scan(unseen, rules).dropDuplicates(["blob", "kind", "version"]), "ledger"), paths.select("doc_id", "blob")


def update_ledger(spark: SparkSession, path: str, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at path, a folder in shared storage, does not hold of versions, and appends it; returns the whole.

    Readers drop repeated keys, so a batch that is appended again after a failure does no harm.
    """
    empty = spark.createDataFrame([], LEDGER)
    empty.write.mode("append").parquet(path)
    known = spark.read.schema(empty.schema).parquet(path)
    scan_versions(versions, rules, known)[0].select("blob", "kind", "version", "found").write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path).dropDuplicates(["blob", "kind", "version"])


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; earlier ledger rows are used, not scanned again."""
    new, paths = scan_versions(docs, rules, ledger)
    wanted = F.concat_ws(":", "kind", "version").isin([name(r) for r in rules])
    rows = new if ledger is None else new.unionByName(
        ledger.where(wanted).select("blob", "kind", "version", "found")
    ).dropDuplicates(["blob", "kind", "version"])
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    base = [r.kind for r in BASE]
    flat = rows.where(F.size("found") > 0).select("blob", "kind", F.explode("found").alias("s")).select(
        "blob", "kind", F.struct(F.col("s.start"), order[F.col("kind")].alias("order"), F.col("kind"), F.col("s.end")).alias("s")
    )
    per_blob = flat.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base], F.array_sort(F.collect_list("s")).alias("s")
    )
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    spans = per_blob.select(
        "blob",
        *[f"n_{k}" for k in base],
        F.concat_ws(",", F.transform(F.filter("s", lambda s: s["order"] < len(base)), text)).alias("base"),
        F.concat_ws(",", F.transform("s", text)).alias("spans"),
    )
    joined = paths.join(spans, "blob", "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        sha256_hex(F.coalesce("base", F.lit(""))).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
