"""The library as stored tables: ingest, scans, patches, reports and renderings (SNK-*, LIB-01, SRC-38, FLT-03, EMB-03, ...).

A library is a folder with documents, sections, segments and vectors, each a Parquet table partitioned by bucket, a number of
low bits of a document's id which the ids of its sections, segments and vectors share. So whoever has an id knows its bucket:

* an ingest appends, and rewrites nothing;
* a patch reads and replaces the buckets of the ids that it changes, and no others (dynamic partition overwrite: the new files are
  staged and moved in when all tasks are done, so a job that fails leaves the old rows in force);
* a document is read from one bucket of each table.

One writer at a time: two that change the same bucket at once could lose the changes of one. Operators return rows or
patches; writing is a separate call (SNK-10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import enrich, styling
from . import library, mining, search
from .tables import stored

META = [
    "title",
    "author",
    "century",
    "genre",
    "language",
    "language_stage",
    "source",
    "shelfmark",
    "license",
    "has_existing_translation",
    "translation_status",
]
DEFAULTS = {"language": "la", "language_stage": "unknown", "translation_status": "unknown", "has_existing_translation": False}
# names of languages for readers, which callers can add to; a language without one shows its code
LANGUAGES = {"la": "Latin", "grc": "Greek"}
NEAR = 1 << 20  # sections that a patch sends to all tasks: 8 MB of ids; patches of more deal all rows of their buckets
# fixed values: the word for an unnamed author and notes on what is missing
ANONYMOUS = "Anon."
UNTRANSLATED = "— not yet translated —"
UNSTYLED = "— not yet stylized —"
FRAGMENT = "[untranslatable fragment in source]"


def documents_of(works: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK-01, FLT-07, WIN-01: (documents, sections, segments) of raw works: metadata columns, parts (label, text) and flags.

    Ids are hashes of the source and of places in it, so an ingest that runs again makes the same rows; they carry the document's place. Flags: verse (one
    segment a line) and pre_segmented (one segment a part). Blank texts give no segments, sections without any are kept.
    """
    full = library.with_defaults(works, {c: None for c in META if c not in DEFAULTS} | DEFAULTS)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in works.columns else F.lit(False)
    full = full.withColumn("id", F.xxhash64("source")).withColumn("verse", flag("verse")).withColumn("pre_segmented", flag("pre_segmented"))
    documents = full.select("id", *[F.col(c).cast(library.DOCUMENTS[c].dataType).alias(c) for c in META])
    parts = full.select(
        F.col("id").alias("doc_id"), "source", "language", "verse", "pre_segmented", F.posexplode("parts").alias("ord", "p")
    )
    parts = parts.withColumn("id", library.id_within("doc_id", "source", "ord"))
    whole = F.filter(F.array(X.strip("p.text")), lambda s: s != "")
    prose = F.when(F.col("language") == "grc", X.sentences("p.text", "grc")).otherwise(X.sentences("p.text"))
    cut = F.when(F.col("pre_segmented"), whole).when(F.col("verse"), X.verse_lines("p.text")).otherwise(prose)
    rows = parts.select(
        F.col("id").alias("section_id"), "source", F.col("ord").alias("part"), F.posexplode(cut).alias("ord", "source_text")
    )
    rows = rows.withColumn("id", library.id_within("section_id", "source", "part", "ord")).withColumn("embed_text", X.embedding_text("source_text"))
    segments = library.migrate(rows.select("id", "section_id", "ord", "source_text", "embed_text"), library.SEGMENTS)
    sections = parts.select("id", "doc_id", F.col("p.label").alias("label"), "ord")
    return documents, sections, segments.select(library.SEGMENTS.fieldNames())


def selected(
    documents: DataFrame,
    source_prefix: str | None = None,
    language: str | None = None,
    doc_id: int | None = None,
    skip_translated: bool = False,
    only_unknown: bool = False,
    skip_poetry: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """FLT-03: the documents that a job works on, as conditions that reach the scan; a limit takes the first by author and title."""
    if source_prefix:
        documents = documents.where(F.startswith("source", F.lit(source_prefix)))
    if language:
        documents = documents.where(F.col("language") == language)
    if doc_id is not None:
        documents = documents.where(F.col("id") == doc_id)
    if skip_translated:  # what can be bought in translation is still wanted
        documents = documents.where(~F.equal_null("translation_status", F.lit("translated")))
    if only_unknown:
        documents = documents.where(F.col("translation_status") == "unknown")
    if skip_poetry:
        documents = documents.where(~F.equal_null("genre", F.lit("poetry")))
    return documents if limit is None else listed(documents).limit(limit)


def listed(documents: DataFrame) -> DataFrame:
    """TOP-04, SRC-38: by author, nameless first, and title."""
    return documents.orderBy(F.asc_nulls_first("author"), "title", "id")


def missing_authors(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """FLT-17: the seeds (author, ...) whose author the library does not have."""
    return wanted.join(documents.select("author").distinct(), "author", "left_anti")


def expected_source(kind: Column | str, identifier: Column | str) -> Column:
    """STR-39: the source that a connector gives to a work; null for connectors and identifiers that have no rule."""
    k, i = X.col(kind), X.col(identifier)
    parts = X.cts_parts(i)
    volume = F.regexp_extract(i, r"(?i)PG(\d+(?:_\d+)?)", 1)
    head, tail = F.split_part(volume, F.lit("_"), F.lit(1)), F.split_part(volume, F.lit("_"), F.lit(2))
    number = F.regexp_replace(head, r"^0+(?=\d)", "")
    padded = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))
    bsb = F.nullif(F.lower(F.regexp_extract(i, r"(?i)(bsb\d+)", 1)), F.lit(""))
    named = lambda label, c: F.concat(F.lit(f"{label} ("), c, F.lit(")"))
    work = F.concat_ws(".", parts["textgroup"], parts["work"])
    return (
        F.when(k == "digiliblt", named("DigilibLT", i))
        .when(k == "pta", named("PTA", work))
        .when(k.isin("first1k_greek", "perseus", "perseus_greek"), named("Perseus", work))
        .when(k == "mgh", named("MGH", bsb))
        .when(
            (k == "pg_corpus") & (volume != ""),
            named("PG Corpus", F.concat(F.lit("PG"), padded, F.when(tail != "", F.concat(F.lit("_"), tail)).otherwise(""))),
        )
    )


def curated(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """JON-13: (pos, doc_id) of curated works (pos, kind, identifier) that are there; of equal sources the last document counts, a document once."""
    last = documents.where("source is not null").groupBy("source").agg(F.max("id").alias("doc_id"))
    found = wanted.withColumn("source", expected_source("kind", "identifier")).join(last, "source")
    return found.groupBy("doc_id").agg(F.min("pos").alias("pos")).select("pos", "doc_id")


def looked_up(keys: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """JON-18, JON-19: keys with the columns of their entry, null where there is none; of equal entries the first by pos."""
    first = library.first_per(entries, [key], ["pos"]).drop("pos") if "pos" in entries.columns else entries
    return keys.join(first, key, "left")


def document_label(language: str = "language", languages: dict[str, str] = LANGUAGES) -> Column:
    """STR-46: what a picker shows for a document."""
    names = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    stage = F.replace(F.coalesce("language_stage", F.lit("unknown")), F.lit("_"), F.lit(" "))
    tongue = F.when(F.col(language) != "la", F.concat(F.coalesce(names[F.col(language)], F.col(language)), F.lit(", "))).otherwise("")
    flag = F.when(F.coalesce("has_existing_translation", F.lit(False)), "").otherwise("  · untranslated")
    return F.concat(
        F.coalesce(F.nullif("author", F.lit("")), F.lit(ANONYMOUS)),
        F.lit(" — "),
        F.col("title"),
        F.lit(" ("),
        tongue,
        stage,
        flag,
        F.lit(")"),
    )


def listing_line(languages: dict[str, str] = LANGUAGES) -> Column:
    """STR-46: a document's line in a command's listing."""
    names = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    author = F.coalesce(F.nullif("author", F.lit("")), F.lit(ANONYMOUS))
    wide = lambda c, n: F.rpad(c, F.greatest(F.lit(n), F.length(c)), F.lit(" "))
    number = F.col("id").cast("string")
    stage = F.replace(F.coalesce(F.nullif("language_stage", F.lit("")), F.lit("unknown")), F.lit("_"), F.lit(" "))
    verse = F.when(F.col("genre") == "poetry", ", verse").otherwise("")
    number = F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit(" "))
    return F.concat(
        F.lit("  ["),
        number,
        F.lit("] "),
        wide(author, 22),
        F.lit(" "),
        F.col("title"),
        F.lit("  ("),
        F.coalesce(names[F.col("language")], F.col("language")),
        F.lit(", "),
        stage,
        verse,
        F.lit(")"),
    )


def export_text() -> tuple[Column, Column]:
    """SNK-09: (kind, text) of a segment in an export: styled, else plain, else the note for what cannot be translated."""
    styled, plain = (F.nullif(X.strip(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("english_styled", "english_text"))
    text = F.coalesce(styled, plain)
    missing = text.isNull() | (text == X.PLACEHOLDER)
    kind = F.when(missing, "missing").when(styled.isNotNull(), "styled").otherwise("plain")
    return kind, F.when(missing, F.lit(FRAGMENT)).otherwise(text)


def reader_row(view: str = "Literal") -> Column:
    """SNK-11: a segment as a row of the reader's table."""
    mark = F.when(
        X.is_filled("scansion"), F.concat(F.lit('<span class="scansion">'), X.escape_html("scansion"), F.lit("</span>"))
    ).otherwise("")
    literal = X.escape_html(F.coalesce("english_text", F.lit("")))
    cell = F.when(~X.is_filled("english_text"), F.lit(f'<td class="en"><span class="untranslated">{UNTRANSLATED}</span>'))
    if view == "Stylized":
        unstyled = F.concat(F.lit(f'<td class="en"><span class="unstyled">{UNSTYLED}</span><br>'), literal)
        styled = F.concat(F.lit('<td class="en styled">'), X.escape_html("english_styled"))
        cell = cell.when(X.is_filled("english_styled"), styled).otherwise(unstyled)
    else:
        cell = cell.otherwise(F.concat(F.lit('<td class="en">'), literal))
    return F.concat(F.lit('<tr><td class="la">'), X.escape_html("source_text"), mark, F.lit("</td>"), cell, F.lit("</td></tr>"))


def reader_pages(
    documents: DataFrame, sections: DataFrame, segments: DataFrame, view: str = "Literal", languages: dict[str, str] = LANGUAGES
) -> DataFrame:
    """SNK-11: (doc_id, html) of whole documents, rows in the order of sections and segments."""
    names = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    rows = segments.select("section_id", "ord", reader_row(view).alias("row")).join(
        sections.select(F.col("id").alias("section_id"), "doc_id", F.col("ord").alias("section_ord")), "section_id"
    )
    body = mining.in_order(rows, ["doc_id"], ["section_ord", "ord"], "row", "body", "")
    stage = F.replace(F.coalesce("language_stage", F.lit("unknown")), F.lit("_"), F.lit(" "))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    meta = F.concat_ws(
        " · ", F.coalesce(filled("author"), F.lit(ANONYMOUS)), stage, X.century_label("century"), filled("genre"), filled("source")
    )
    header = "English (stylized)" if view == "Stylized" else "English (AI)"
    table = F.concat(
        F.lit('<table class="reader"><thead><tr><th>'),
        X.escape_html(F.coalesce(names[F.col("language")], F.col("language"))),
        F.lit(f"</th><th>{header}</th></tr></thead><tbody>"),
        F.coalesce("body", F.lit("")),
        F.lit("</tbody></table>"),
    )
    html = F.concat(F.lit("<h2>"), X.escape_html("title"), F.lit('</h2><p class="reader-meta">'), X.escape_html(meta), F.lit("</p>"), table)
    return documents.join(body, documents["id"] == body["doc_id"], "left").select(documents["id"].alias("doc_id"), html.alias("html"))


def hit_blocks(hits: DataFrame) -> DataFrame:
    """SNK-11: (id, html) of search hits (id, score, author, title, source_loc, source_text, english_text)."""
    where = F.concat(
        F.coalesce(F.nullif("author", F.lit("")), F.lit(ANONYMOUS)),
        F.lit(" — "),
        F.col("title"),
        F.when(X.is_filled("source_loc"), F.concat(F.lit(" · "), F.col("source_loc"))).otherwise(""),
    )
    english = F.when(
        X.is_filled("english_text"), X.escape_html("english_text")
    ).otherwise(F.lit(f'<span class="untranslated">{UNTRANSLATED}</span>'))
    div = lambda kind, c: F.concat(F.lit(f'<div class="{kind}">'), c, F.lit("</div>"))
    score = F.concat(F.lit('<span class="score">'), F.format_string("%.3f", "score"), F.lit("</span>"))
    return hits.select(
        "id",
        div(
            "hit", F.concat(score, div("src", X.escape_html(where)), div("la", X.escape_html("source_text")), div("en", english))
        ).alias("html"),
    )


def report_lines(documents: DataFrame, segments: DataFrame, largest: int = 8) -> DataFrame:
    """SNK-09: (part, rank, line) of the library's report; order by part and rank. segments carry doc_id."""
    done, styled = (X.is_filled(c) for c in ("english_text", "english_styled"))
    counts = segments.agg(F.count("*").alias("n"), F.count_if(done).alias("t"), F.count_if(styled).alias("s"))
    span = documents.agg(F.count("*").alias("d"), F.min("century").alias("a"), F.max("century").alias("b"))
    both = counts.join(F.broadcast(span))  # one row each
    share = F.format_string("%.1f", 100 * F.col("t") / F.greatest("n", F.lit(1)))
    thousands = lambda c: F.format_string("%,d", c)
    head = both.select(F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit("Documents: "), F.col("d").cast("string")).alias("line")),
        F.struct(
            F.lit(1).alias("rank"),
            F.concat(
                F.lit("Segments: "),
                thousands("t"),
                F.lit(" / "),
                thousands("n"),
                F.lit(" translated ("),
                share,
                F.lit("%), "),
                thousands("s"),
                F.lit(" stylized"),
            ).alias("line"),
        ),
        F.struct(
            F.lit(2).alias("rank"),
            F.concat(
                F.lit("Era span: "),
                F.coalesce(F.col("a").cast("string"), F.lit("None")),
                F.lit("c to "),
                F.coalesce(F.col("b").cast("string"), F.lit("None")),
                F.lit("c"),
            ).alias("line"),
        ),
    )).alias("x")).select(F.lit(0).alias("part"), "x.*")
    groups = [(F.col("language"), "unknown"), (F.col("language_stage"), "unknown"), (F.col("genre"), "unclassified")]
    counted = [
        library.counts_by(documents, library.source_family("source"), "unknown", "key")
    ] + [library.counts_by(documents, c, blank, "key") for c, blank in groups]
    out = head
    for part, df in enumerate(counted, 1):
        width = F.greatest(F.lit(4), F.length(F.col("n").cast("string")))
        # few distinct names: one row each
        ranked = library.numbered_rows(df.withColumn("_minus", -F.col("n")), ["_minus", "key"], "rank")
        out = out.unionByName(
            ranked.select(
                F.lit(part).alias("part"),
                F.col("rank").cast("int").alias("rank"),
                F.concat(F.lit("  "), F.lpad(F.col("n").cast("string"), width, F.lit(" ")), F.lit("  "), "key").alias("line"),
            )
        )
    top = segments.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(largest)
    works = top.join(documents, top["doc_id"] == documents["id"]).select("n", "id", "title", "author", "source")
    ranked = library.numbered_rows(works.withColumn("_minus", -F.col("n")), ["_minus", "id"], "rank")
    width = F.greatest(F.lit(6), F.length(F.col("n").cast("string")))
    line = F.concat(
        F.lit("  "),
        F.lpad(F.col("n").cast("string"), width, F.lit(" ")),
        F.lit(" segs  "),
        "title",
        F.lit(" ("),
        F.coalesce(F.nullif("author", F.lit("")), F.lit("anon")),
        F.lit(") ["),
        F.coalesce("source", F.lit("None")),
        F.lit("]"),
    )
    return out.unionByName(
        ranked.select(F.lit(len(counted) + 1).alias("part"), F.col("rank").cast("int").alias("rank"), line.alias("line"))
    )


def backfilled(segments: DataFrame) -> DataFrame:
    """EMB-03: the patch (id, embed_text) of segments that lack their text for embedding and need one."""
    return segments.where("embed_text is null").select(
        "id", X.embedding_text("source_text").alias("embed_text")
    ).where("embed_text is not null")


def reindexed(segments: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """EMB-03: (id, unit) of all segments; embed takes (id, text) and returns (id, vector)."""
    texts = segments.select("id", F.coalesce("embed_text", "source_text").alias("text"))
    return search.add_vectors(embed(texts), "id", "vector")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """SNK-07: pair records as JSON lines."""
    mining.pair_json(pairs).write.mode("overwrite").text(path)


def prose_report(lines: list[str], generate: Callable[[str, str], str], system: str = "") -> str:
    """STY-04: a model's account of the report's lines, which follow it."""
    table = "\n".join(lines)
    return generate(
        system, f"Summarize the state of this library. Use no number that is not below.\n\n{table}"
    ).strip() + f"\n\n---\n\n{table}\n"


class Library:
    """LIB-01: a thin façade over the stored tables."""

    TABLES = {"documents": library.DOCUMENTS, "sections": library.SECTIONS, "segments": library.SEGMENTS}
    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """Opens or makes a library; buckets, a power of two up to 4,096, counts only for a new one."""
        self.spark, self.path = spark, path.rstrip("/")
        if buckets & (buckets - 1) or not 0 < buckets <= 1 << library.PLACE_BITS:
            raise ValueError("buckets must be a power of two up to 4,096")
        if not self._exists("layout"):
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("ignore").parquet(f"{self.path}/layout")
        self.buckets = spark.read.schema("buckets int").parquet(f"{self.path}/layout").first()["buckets"]

    def _exists(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def bucket(self, key: Column | str | int = "id") -> Column:
        """The bucket of an id, of whichever table."""
        c = F.lit(key).cast("long") if isinstance(key, int) else X.col(key)
        return c.bitwiseAND(self.buckets - 1).cast("int")

    def stored_rows(self, name: str, where: Column | None = None) -> DataFrame:
        """A table with its column bucket; a condition on it chooses the folders that are read."""
        fields = self.TABLES.get(name)
        schema = (f"{fields.simpleString()[7:-1].replace(':', ' ')}" if fields else "id bigint, unit array<double>") + ", bucket int"
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if where is None else rows.where(where)

    def table(self, name: str, doc_id: int | None = None) -> DataFrame:
        """SRC-38: a table, or the bucket in which a document's rows are; empty where nothing has been written."""
        return self.stored_rows(name, None if doc_id is None else F.col("bucket") == self.bucket(doc_id)).drop("bucket")

    def _write(self, name: str, df: DataFrame, mode: str, overwrite: str, lying: DataFrame | None = None) -> None:
        # AQE splits a bucket that is large and puts small ones together; rows that lie in their buckets already are written where they are read
        placed = lambda rows: rows.withColumn("bucket", self.bucket())
        rows = placed(df).hint("rebalance", "bucket")
        rows = rows if lying is None else rows.unionByName(placed(lying))
        out = rows.write.mode(mode).option("partitionOverwriteMode", overwrite).option("compression", "zstd")
        out.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def save(self, name: str, df: DataFrame) -> None:
        """SNK-06, SNK-10: replaces a whole table, which df must not read."""
        self._write(name, df, "overwrite", "static")

    def ingest(self, works: DataFrame) -> int:
        """SNK-01, JON-10, STM-04: appends the works whose source is not there yet; returns how many there are now.

        Rows that a run before has left without their document are not written twice.
        """
        new = works.where("source is not null")
        if not new.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # else whole texts need not be shuffled
            new = new.dropDuplicates(["source"])
        if self._exists("documents"):
            new = library.not_present(new, self.table("documents"), "source")
        tables = dict(zip(self.TABLES, documents_of(new), strict=True))
        for name in ("segments", "sections", "documents"):  # a run that dies leaves no document without its text
            rows = tables[name].select(self.TABLES[name].fieldNames())
            if self._exists(name):
                rows = rows.join(self.table(name).select("id"), "id", "left_anti")
            self._write(name, rows, "append", "static")
        return self.table("documents").count()

    def changed(self, name: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets of the ids of changes by apply(their rows, changes); returns them, as many as there are buckets at most.

        Changes of segments may say their section_id. Then, unless that names too many sections, only rows of those sections are
        dealt and given to apply.
        """
        changes = stored(changes, "changes")  # it may read the files that go
        hit = sorted(r[0] for r in changes.where("id is not null").select(self.bucket()).distinct().collect())
        if hit and self._exists(name):
            rows, lying = self.stored_rows(name, F.col("bucket").isin(hit)).drop("bucket"), None
            if "section_id" in changes.columns and "section_id" in rows.columns:
                near = stored(changes.select("section_id").distinct(), "near")
                if near.count() <= NEAR and near.where("section_id is null").isEmpty():
                    lying = rows.join(F.broadcast(near), "section_id", "left_anti").select(rows.columns)
                    rows = rows.join(F.broadcast(near), "section_id", "left_semi").select(rows.columns)
            self._write(name, apply(rows, changes), "overwrite", "dynamic", lying)
        return hit

    def patch(self, changes: DataFrame, columns: list[str], name: str = "segments") -> list[int]:
        """SNK-02: writes patched columns of the rows whose ids are in changes (see `changed`); returns the buckets written."""
        return self.changed(name, changes, lambda rows, c: library.patch(rows, c, columns))

    def patch_source(self, changes: DataFrame) -> list[int]:
        """SNK-03: new source_text of segments (id, source_text); what was derived from the old one is forgotten, vectors too."""
        changes = stored(changes.select("id", "source_text", *[c for c in changes.columns if c == "section_id"]), "changes")
        hit = self.changed("segments", changes, library.patch_source)
        self.changed("vectors", changes.select("id"), lambda rows, c: rows.join(c, "id", "left_anti"))
        return hit

    def set_status(self, changes: DataFrame) -> list[int]:
        """SNK-04: new translation_status of documents (id, translation_status), with the flag that follows from it."""
        columns = ["translation_status", "has_existing_translation"]
        return self.patch(library.with_status(changes, F.col("translation_status")).select("id", *columns), columns, "documents")

    def list_documents(self) -> DataFrame:
        return listed(self.table("documents"))

    def get_document(self, doc_id: int) -> DataFrame:
        """JON-02, JON-04: one nested document, or no row."""
        sections = self.table("sections", doc_id).where(F.col("doc_id") == doc_id)
        segments = self.table("segments", doc_id).join(sections.select(F.col("id").alias("section_id")), "section_id", "left_semi")
        return library.assemble(self.table("documents", doc_id).where(F.col("id") == doc_id), sections, segments)

    def segments(self, doc_id: int | None = None) -> DataFrame:
        """SRC-38, JON-01: all segments with their document, or those of one document."""
        sections = self.table("sections", doc_id).select(F.col("id").alias("section_id"), "doc_id")
        rows = self.table("segments", doc_id).join(sections, "section_id")
        return rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)

    def get_segment(self, segment_id: int) -> DataFrame:
        return self.table("segments", segment_id).where(F.col("id") == segment_id)

    def reindex(self, embed: Callable[[DataFrame], DataFrame]) -> int:
        """EMB-03: fills embed_text and rebuilds the vectors; returns their number."""
        self.patch(backfilled(self.table("segments")), ["embed_text"])
        self.save("vectors", reindexed(self.table("segments"), embed))
        return self.index_size()

    def index_size(self) -> int:
        """AGG-20."""
        return self.table("vectors").count()

    def search(self, query: list[float], k: int = 5, language_stage: str | None = None, only_untranslated: bool = False) -> DataFrame:
        """TOP-01, TOP-02, FLT-04, JON-05: the k best hits with their rows; an empty index has none."""
        index, documents = self.table("vectors"), self.table("documents")
        segments = self.segments()
        if language_stage or only_untranslated:
            if language_stage:
                documents = documents.where(F.col("language_stage") == language_stage)
            if only_untranslated:
                documents = documents.where(~F.coalesce("has_existing_translation", F.lit(False)))
            allowed = segments.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
            index = index.join(allowed.select("id"), "id", "left_semi")
        named = documents.select("id", "title", "author")
        return search.hits(search.top_k(index, query, k), segments.withColumnRenamed("id", "segment_id"), named)

    def translate(self, model: Callable[[DataFrame], DataFrame], doc_id: int | None = None) -> int:
        """LIB-02, MT-03: translates pending segments, of one document or all; model takes (id, text) to (id, english_text).

        Garbled ones get the placeholder; returns how many were pending.
        """
        rows = self.segments(doc_id).join(self.table("documents", doc_id).select(F.col("id").alias("doc_id"), "language"), "doc_id")
        todo = stored(enrich.translation_input(rows), "pending")
        garbled = todo.where("route = 'placeholder'").select("id", F.lit(X.PLACEHOLDER).alias("english_text"))
        texts = todo.where("route <> 'placeholder'").select("id", F.col("source_text").alias("text"))
        self.patch(model(texts).select("id", "english_text").unionByName(garbled), ["english_text"])
        return todo.count()

    def stylize(self, factory, preset: str, doc_id: int | None = None) -> None:
        """LIB-02, STY-02: styles what is translated, of one document or all."""
        rows = self.segments(doc_id)
        self.patch(styling.styled(rows, factory, preset), ["english_styled", "style_label"])

    def scan(self, factory, meter: str = "hexameter", doc_id: int | None = None) -> None:
        """LIB-02, SCN-01: writes the patterns that a scanner finds."""
        rows = self.segments(doc_id).join(self.table("documents", doc_id).select(F.col("id").alias("doc_id"), "language"), "doc_id")
        self.patch(styling.scanned(rows, factory, meter).where("scansion is not null").select("id", "scansion"), ["scansion"])

    def reader(self, doc_id: int, view: str = "Literal") -> str | None:
        """LIB-02, SNK-11: a document's page, or None."""
        documents = self.table("documents", doc_id).where(F.col("id") == doc_id)
        row = reader_pages(documents, self.table("sections", doc_id).where(F.col("doc_id") == doc_id), self.table("segments", doc_id), view).first()
        return row and row["html"]

    def report(self) -> list[str]:
        """SNK-09: the report's lines; few, one for each distinct source, language, stage and genre."""
        return [r["line"] for r in report_lines(self.table("documents"), self.segments()).orderBy("part", "rank").collect()]
