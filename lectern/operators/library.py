"""Library tables and the relational operators over them (JON-*, AGG-*, WIN-*, TOP-*, SET-*, SNK-*, FLT-*)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

KINDS = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def _schema(columns: str) -> T.StructType:
    """A struct from "name KIND, ..." that needs no session."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


DOCUMENTS = _schema(
    "id BIGINT, title STRING, author STRING, century INT, genre STRING, language STRING, language_stage STRING, source STRING, "
    "shelfmark STRING, license STRING, has_existing_translation BOOLEAN, translation_status STRING"
)
SECTIONS = _schema("id BIGINT, doc_id BIGINT, label STRING, ord INT")
SEGMENTS = _schema(
    "id BIGINT, section_id BIGINT, ord INT, source_text STRING, english_text STRING, english_styled STRING, style_label STRING, "
    "source_loc STRING, image_region STRING, embed_text STRING, scansion STRING"
)
PAIRS = _schema(
    "src STRING, tgt STRING, citation STRING, src_lang STRING, era STRING, source STRING, score DOUBLE, style STRING, form STRING"
)
STATUSES = ("translated", "translated_paywalled", "untranslated", "unknown")
DERIVED = ("english_text", "english_styled", "style_label", "embed_text", "scansion")
# fixed values: translator routing (language, stage, rank, model, source code, strip diacritics)
ROUTES = [
    ("la", None, 1, "models/nllb-la", "lat_Latn", False),
    ("grc", None, 1, "models/nllb-greek-v2", "ell_Grek", True),
    ("grc", None, 2, "models/nllb-greek", "ell_Grek", False),
    ("grc", "late_antique", 0, "models/nllb-greek-v3", "ell_Grek", True),
    ("grc", "archaic", 0, "models/nllb-greek-archaic", "ell_Grek", True),
]
# fixed values: source codes of the stock model
STOCK = {"la": "lat_Latn", "grc": "ell_Grek"}


PLACE_BITS = 12


def place(document: Column | str) -> Column:
    """The low bits of a document's id, which the ids of all its sections and segments share."""
    return X.col(document).bitwiseAND((1 << PLACE_BITS) - 1)


def id_within(document: Column | str, *natural: Column | str) -> Column:
    """An id hashed from a natural key, with its document's place in the low bits: whoever has it knows where the row is stored.

    Rows of one place are told apart by 52 bits, and all rows thus as well as by 64 bits of one hash.
    """
    return F.shiftleft(F.xxhash64(*natural), PLACE_BITS).bitwiseOR(place(document))


def with_defaults(meta: DataFrame, defaults: dict[str, object], overrides: dict[str, object] | None = None) -> DataFrame:
    """FLT-07: caller override, then connector, then default."""
    for name, default in defaults.items():
        given = F.col(name) if name in meta.columns else F.lit(None)
        meta = meta.withColumn(name, F.coalesce(F.lit((overrides or {}).get(name)), given, F.lit(default)))
    return meta


def sectioned(works: DataFrame, parts: str = "parts") -> DataFrame:
    """WIN-01: a row for each part (label, text) with its place."""
    keep = [c for c in works.columns if c != parts]
    return works.select(*keep, F.posexplode(parts).alias("ord", "p")).select(*keep, "ord", "p.*")


def assemble(documents: DataFrame, sections: DataFrame, segments: DataFrame) -> DataFrame:
    """JON-04: nested documents, sections and segments in order; one join each, no lookups."""
    inner = segments.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "source_text"))).alias("segments"))
    outer = sections.join(inner, sections.id == inner.section_id, "left").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "id", "label", "segments"))).alias("sections")
    )
    return documents.join(outer, documents.id == outer.doc_id, "left").drop("doc_id")


def patch(table: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """SNK-02: table with the columns of changed keys replaced, nulls included."""
    c = changes.select(F.col(key).alias("_key"), *[F.col(x).alias(f"_{x}") for x in columns])
    joined = table.join(c, F.col(key) == F.col("_key"), "left")
    return joined.select(
        *[
            F.when(F.col("_key").isNotNull(), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x)
            for x in table.columns
        ]
    )


def patch_source(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """SNK-03: new source_text; what was derived from the old one becomes null."""
    c = changes.select(F.col("id").alias("_key"), F.col("source_text").alias("_new"))
    joined = segments.join(c, F.col("id") == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col("_new")).otherwise(F.col(x)).alias(x) if x == "source_text" else F.when(~hit, F.col(x)).alias(x) if x in DERIVED else F.col(x)
            for x in segments.columns
        ]
    )


def with_status(documents: DataFrame, status: Column) -> DataFrame:
    """SNK-04."""
    return documents.withColumn("translation_status", status).withColumn(
        "has_existing_translation", X.has_translation("translation_status")
    )


def migrate(table: DataFrame, schema: T.StructType) -> DataFrame:
    """SNK-05: adds the columns that are missing."""
    return table.select(*table.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in table.columns])


def new_ids(rows: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """SNK-01: ids that do not depend on write order: a hash of the natural key; existing keys are left out (idempotent)."""
    keyed = rows.withColumn("id", F.xxhash64(*order))
    return keyed.join(existing.select("id"), "id", "left_anti")


def global_counts(segments: DataFrame) -> DataFrame:
    """AGG-01, AGG-05 in one pass."""
    done, styled = X.is_filled("english_text"), X.is_filled("english_styled")
    n = F.count("*")
    return segments.agg(
        F.count_distinct("doc_id").alias("documents"),
        n.alias("segments"),
        F.count_if(done).alias("translated"),
        F.count_if(styled).alias("styled"),
        F.round(100 * F.count_if(done) / F.greatest(n, F.lit(1)), 4).alias("percent"),
    )


def counts_by(df: DataFrame, key: Column, blank: str, name: str) -> DataFrame:
    """AGG-02, AGG-03: blanks are labelled before grouping."""
    label = F.coalesce(F.nullif(X.strip(key), F.lit("")), F.lit(blank))
    return df.groupBy(label.alias(name)).agg(F.count("*").alias("n"))


def source_family(c: Column | str) -> Column:
    return F.regexp_replace(X.col(c), r"(?U)\s*\(.*", "")


def is_untranslated(c: Column | str = "english_text") -> Column:
    """FLT-02: nothing written, not even white space; FLT-01 is the stricter predicate of the library."""
    return X.col(c).isNull() | (X.col(c) == "")


def sizes(segments: DataFrame) -> DataFrame:
    """AGG-17: (doc_id, chars, n) of works over their segments."""
    return segments.groupBy("doc_id").agg(F.sum(F.length("source_text")).alias("chars"), F.count("*").alias("n"))


def out_of_bounds(works: DataFrame, least_chars: int = 300, least_segments: int = 2, most_chars: int = 700_000) -> DataFrame:
    """FLT-06: works of sizes() that are stubs or too large."""
    return works.where((F.col("chars") < least_chars) | (F.col("n") < least_segments) | (F.col("chars") > most_chars))


def century_span(documents: DataFrame) -> DataFrame:
    """AGG-04."""
    return documents.agg(F.min("century").alias("first"), F.max("century").alias("last"))


def most_common(counted: DataFrame, order: list[str], k: int) -> DataFrame:
    """TOP-05: the k rows with the greatest n, ties by order."""
    return counted.orderBy(F.desc("n"), *order).limit(k)


def signature_sums(texts: DataFrame) -> DataFrame:
    """AGG-08: (doc_id, corrupted, clean) signature counts of works over all their texts (doc_id, text)."""
    bad, good = X.long_s_counts("text")
    return texts.groupBy("doc_id").agg(F.sum(bad).alias("corrupted"), F.sum(good).alias("clean"))


def corruption_report(texts: DataFrame, least: int = 5, ratio: float = 0.15, top: int = 40) -> DataFrame:
    """FLT-14: the works with the highest share of corrupted signatures, with `least` of them and more than `ratio`."""
    sums = signature_sums(texts).where(F.col("corrupted") >= least)
    share = F.col("corrupted") / F.greatest(F.col("corrupted") + F.col("clean"), F.lit(1))
    return sums.where(share > ratio).withColumn("ratio", share).orderBy(F.desc("ratio"), "doc_id").limit(top).withColumn(
        "ratio", F.round("ratio", 6)
    )


def largest_works(segments: DataFrame, documents: DataFrame, k: int = 8) -> DataFrame:
    """JON-03, TOP-03: counts before the join, ties by id."""
    sizes = segments.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(k)
    return sizes.join(documents, sizes.doc_id == documents.id).select("id", "title", "n")


def vocabulary(segments: DataFrame, exclude: DataFrame | None = None, column: str = "source_text") -> DataFrame:
    """AGG-06, FLT-05: folded words of two letters or more with their frequency."""
    if exclude is not None:
        segments = segments.join(exclude.select("doc_id"), "doc_id", "left_anti")
    words = segments.select(F.explode(F.split(X.col(column), "[^A-Za-z]+")).alias("w")).where(F.length("w") >= 2)
    # X.fold of ASCII letters; replacing what is seldom there costs less than translating each letter
    word = F.replace(F.replace(F.lower("w"), F.lit("v"), F.lit("u")), F.lit("j"), F.lit("i"))
    return words.groupBy(word.alias("word")).agg(F.count("*").alias("freq"))


def stems(vocab: DataFrame) -> DataFrame:
    """AGG-07."""
    return vocab.where(F.length("word") >= 6).select(F.explode(X.stem_cuts("word")).alias("stem")).distinct()


def best_fixes(words: DataFrame, vocab: DataFrame, stem_table: DataFrame) -> DataFrame:
    """STR-14, STR-15, JON-09: (word, exact, stem) of distinct words with f; joins instead of lookups.

    A word meets the known ones and the stems that are equal to it when every f is read as s; its variants are never listed. What a
    variant flips follows from the word it meets: each f that is an s there.
    """
    from .tables import stored

    words = stored(words.select("word"), "words")
    n = F.length("word") - F.length(F.translate("word", "fF", ""))
    own = words.where(n.between(1, 6)).select("word", X.fold("word").alias("key")).withColumn("plain", X.as_long_s("key"))

    def met(rows: DataFrame) -> DataFrame:
        """rows (word, key, target, ...) with flips and order (the lowest place first), where the target is a variant of the word."""
        flipped = F.transform(X.places("key", "f"), lambda i: F.substring(F.col("target"), i + 1, F.lit(1)) == "s")
        rows = rows.withColumn("flipped", flipped).withColumn("flips", F.size(F.filter("flipped", lambda x: x)))
        kept = F.length("target") - F.length(F.translate("target", "f", ""))
        order = F.rpad(F.array_join(F.transform("flipped", lambda x: F.when(x, "0").otherwise("1")), ""), 6, "1")
        return rows.where((F.col("flips") > 0) & (kept == F.size("flipped") - F.col("flips"))).withColumn("order", order)

    known = vocab.select(F.col("word").alias("target"), "freq", X.as_long_s("word").alias("plain"))
    exact = met(own.join(known, "plain")).groupBy("word").agg(
        F.min_by("target", F.struct((-F.col("flips")).alias("a"), (-F.col("freq")).alias("b"), F.col("order").alias("c"))).alias("exact")
    )
    stem = F.explode(X.stem_cuts("plain")).alias("plain_stem")
    cut = own.where(F.length("word") >= 6).select("word", "key", "plain", stem)
    ending = F.expr("substring(plain, length(plain_stem) + 1)")
    family = cut.join(stem_table.select("stem", X.as_long_s("stem").alias("plain_stem")), "plain_stem")
    family = met(family.select("word", "key", F.concat("stem", ending).alias("target")))
    family = family.groupBy("word").agg(F.min_by("target", F.struct("flips", "order")).alias("stem"))

    def spelt(target: str) -> Column:
        put = lambda c, i: F.when(c.isin("f", "F") & (F.substring(F.col(target), i + 1, F.lit(1)) == "s"), F.translate(c, "fF", "sS")).otherwise(c)
        return F.when(F.col(target).isNotNull(), F.array_join(F.transform(F.split("word", ""), put), "")).alias(target)

    return words.join(exact, "word", "left").join(family, "word", "left").select("word", spelt("exact"), spelt("stem"))


def not_present(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """JON-10, JON-11, SET-04."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def routed(documents: DataFrame, routes: DataFrame, complete: DataFrame) -> DataFrame:
    """JON-12, WIN-12, MT-02: the first complete model: stage-specific ones first, then the language's, then stock."""
    r = F.broadcast(routes.join(complete, "model", "left_semi"))  # a fixed, tiny table
    on = (documents.language == r.lang) & (r.stage.isNull() | (r.stage == documents.language_stage))
    best = documents.join(r, on, "left").groupBy(documents.id, documents.language).agg(
        F.min_by("model", F.struct(F.col("stage").isNull(), "rank")).alias("model")
    )
    stock = F.create_map(*[F.lit(x) for k, v in STOCK.items() for x in (k, v)])
    return best.select(
        "id", F.coalesce("model", F.concat(F.lit("stock:"), F.coalesce(stock[F.col("language")], F.lit(STOCK["la"])))).alias("model")
    )


def first_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """AGG-18, AGG-19, SET-01: the first row of each key, without a sort of the whole."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


# fixed values: a line of $key=value marks, the keys of volume, page and column
MARK = r"^\s*\$\d+="
VOLUME, PAGE, COLUMN = "0", "8", "9"


def marked_sections(lines: DataFrame, marker: str, label: Column, first: Column | None = None) -> DataFrame:
    """WIN-02: lines (doc_id, pos, line) cut at marker lines: (doc_id, part, label, text); what stands before the first marker
    is part 0 with the label `first`, or left out without one. Parts without text drop out."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    at = F.col("line").rlike(marker)
    own = F.last(F.when(at, label), ignorenulls=True).over(w)
    parts = lines.withColumn("part", F.sum(at.cast("int")).over(w)).withColumn("label", own if first is None else F.coalesce(own, first))
    parts = parts.where(~at) if first is not None else parts.where(~at & (F.col("part") > 0))
    listed = F.array_sort(F.collect_list(F.struct("pos", "line")))
    joined = parts.groupBy("doc_id", "part").agg(
        F.first("label").alias("label"), X.strip(F.array_join(F.transform(listed, lambda x: x["line"]), " ")).alias("text")
    )
    return joined.where("text <> ''")


def volume_sections(volumes: DataFrame) -> DataFrame:
    """SRC-21: (doc_id, part, label, text) of volumes (doc_id, volume, text) whose marker lines name volume, page and column."""
    value = lambda key: F.nullif(F.regexp_extract("line", rf"\${key}=(\S+)", 1), F.lit(""))
    named = lambda word, c: F.coalesce(F.concat(F.lit(f", {word}."), c), F.lit(""))
    label = F.concat(F.lit("PG "), F.coalesce(value(VOLUME), F.col("volume")), named("p", value(PAGE)), named("col", value(COLUMN)))
    lines = volumes.select("doc_id", "volume", F.posexplode(F.split("text", X.LINE_BREAK)).alias("pos", "line"))
    return marked_sections(lines, MARK, label, F.concat(F.lit("PG "), F.col("volume")))


def best_run(headers: DataFrame, ends: DataFrame) -> DataFrame:
    """WIN-03: of the ascending runs of header numbers (doc_id, pos, n), the one of the largest span, then length, then the first.

    ends: (doc_id, size); returns (doc_id, n, pos, until).
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    runs = headers.withColumn("run", F.sum(F.coalesce(F.col("n") <= F.lag("n").over(w), F.lit(True)).cast("int")).over(w))
    # a run spans from its first header to its last
    spans = runs.groupBy("doc_id", "run").agg((F.max("pos") - F.min("pos")).alias("span"), F.count("*").alias("len"))
    best = spans.groupBy("doc_id").agg(F.max_by("run", F.struct("span", "len", (-F.col("run")).alias("r"))).alias("run"))
    kept = runs.join(best, ["doc_id", "run"], "left_semi").join(ends, "doc_id")
    return kept.select("doc_id", "n", "pos", F.coalesce(F.lead("pos").over(w), F.col("size")).alias("until"))


def spread_sample(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """WIN-09: rows int(i * n / limit) of the ordered rows, numbered by range partitions rather than in one task."""
    n = df.count()
    if n <= limit:
        return df
    numbered = numbered_rows(df, order)
    i = F.ceil(F.col("_row") * limit / n)  # the only i whose place can be this row
    return numbered.where((F.floor(i * n / limit) == F.col("_row")) & (i < limit)).drop("_row")


def numbered_rows(df: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """Global 0-based row numbers in order: ranges are sorted and counted apart, then shifted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    from .tables import stored

    rows = stored(rows, "numbered")  # ranges must be the same for counts and rows
    sizes = sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect())
    shifts, at = [], 0
    for p, n in sizes:
        shifts += [F.lit(p), F.lit(at)]
        at += n
    shift = F.create_map(*shifts)[F.col("_p")] if shifts else F.lit(0)
    return rows.withColumn(name, (F.col("_i") + shift).cast("long")).drop("_p", "_i")


def first_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """WIN-10, FLT-18."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def split_by_hash(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """SMP-01, SMP-02: held_out for about `share` of the keys, the same wherever it runs."""
    return df.withColumn("held_out", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000))


def pair_reasons(
    pairs: DataFrame, least: int = 30, chrf: Callable[[Column, Column], Column] | None = None, low: float = 12.0, high: float = 62.0
) -> DataFrame:
    """FLT-11: pairs with the first reason to drop each, null to keep it; empty sides are left out.

    chrf makes a score of two columns. It decides last, so pairs that have a reason reach it as nulls.
    """
    p = pairs.withColumn("src", X.strip("src")).withColumn("tgt", X.strip("tgt")).where("src <> '' and tgt <> ''")
    reason = F.when(
        F.least(F.length("src"), F.length("tgt")) < least, "short"
    ).when(F.lower("src") == F.lower("tgt"), "identical").when(X.is_contaminated("src", "tgt"), "contaminated")
    p = p.withColumn("reason", reason)
    if chrf is None:
        return p
    score = chrf(*(F.when(F.isnull("reason"), F.col(c)) for c in ("src", "tgt")))
    by_score = F.when(score > high, "near_copy").when(score < low, "too_low")
    return p.withColumn("reason", F.coalesce("reason", by_score))


def graph_languages(triples: DataFrame, works: DataFrame) -> DataFrame:
    """GRF-01, SET-02: languages reachable from works by edition (P747, P629 reversed) and own language (P407)."""
    t = triples
    edition = t.where("pred = 'P747'").select(F.col("subj").alias("work"), F.col("obj").alias("e"))
    reverse = t.where("pred = 'P629'").select(F.col("obj").alias("work"), F.col("subj").alias("e"))
    own = works.select(F.col("id").alias("work"), F.col("id").alias("e"))
    nodes = edition.union(reverse).union(own).distinct()
    lang = t.where("pred = 'P407'").select(F.col("subj").alias("e"), F.col("obj").alias("language"))
    return nodes.join(works.select(F.col("id").alias("work")), "work", "left_semi").join(lang, "e").select("work", "language").distinct()


def tree_leaves(edges: DataFrame, root: str, limit: int, budget: int | None = None) -> DataFrame:
    """SRC-14: (child) the first `limit` texts below root in depth-first order; edges: parent, child, ord, is_text.

    A round opens the nodes whose paths come first, as many as texts are asked for, so it dives without asking one node at a time; it ends when
    no node waits before the last text. A node counts by its first path, so cycles end. The budget is how many nodes may be opened in
    depth-first order, max(8 * limit, 60) as for one request each; what a round opens beyond it does not count.
    """
    from .tables import stored

    budget = max(8 * limit, 60) if budget is None else budget
    edges = edges.select("parent", "child", F.col("ord").cast("long").alias("ord"), "is_text")
    waiting = stored(edges.sparkSession.createDataFrame([(root, [])], "node string, path array<bigint>"), "tree")
    opened, found = waiting.limit(0), None
    while True:
        here = stored(waiting.orderBy("path").limit(max(limit, 50)), "tree")
        below = edges.join(F.broadcast(here), edges["parent"] == here["node"]).select(
            F.col("child").alias("node"), "is_text", F.concat("path", F.array("ord")).alias("path")
        )
        below = stored(below, "tree")
        texts = below.where("is_text").select("node", "path")
        found = texts if found is None else found.unionByName(texts)
        opened = stored(opened.unionByName(here).groupBy("node").agg(F.min("path").alias("path")), "tree")
        more = waiting.join(here, "node", "left_anti").unionByName(below.where("not is_text").select("node", "path"))
        more = more.groupBy("node").agg(F.min("path").alias("path"))
        before = opened.withColumnRenamed("path", "earlier")
        more = more.join(before, "node", "left").where(F.col("earlier").isNull() | (F.col("path") < F.col("earlier"))).drop("earlier")
        first = found.groupBy("node").agg(F.min("path").alias("path")).orderBy("path").limit(limit)
        last = first.agg(F.when(F.count("*") == limit, F.max("path")).alias("last"))
        waiting = stored(more.crossJoin(F.broadcast(last)).where("last is null or path < last").drop("last"), "tree")
        ahead = waiting.agg(F.min("path").alias("ahead"))
        sure = opened.crossJoin(F.broadcast(ahead)).agg(F.count("*"), F.count_if(F.col("ahead").isNull()), F.count_if(F.col("path") < F.col("ahead"))).first()
        if sure[1] == sure[0] or sure[2] >= budget:  # none waits, or the budget ends before the first that does
            break
    counted = opened.orderBy("path").limit(budget).select(F.col("path").alias("above"))
    kept = found.withColumn("above", F.slice("path", F.lit(1), F.size("path") - 1)).join(counted, "above", "left_semi")
    return kept.groupBy("node").agg(F.min("path").alias("path")).orderBy("path").limit(limit).select(F.col("node").alias("child"))
