"""Queries of the library's tables, parallel mining, evaluation and styling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import verse
from ..operators import alignment, evaluation, library, mining, search, store
from ..operators.tables import fresh, stored
from ..sources import sink
from . import enrich, styling
from .queries import S, W, WS, _list, query, segments, table, works


def raw_works(spark, sf):
    """The documents as raw works of one or two parts, every fifth one verse, every seventh one cut already."""
    d = table(spark, sf, "documents")
    lines = F.split("text", "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    part = lambda label, c: F.struct(F.lit(label).alias("label"), c.alias("text"))
    two = F.array(
        part("I", F.array_join(F.slice(lines, F.lit(1), half), "\n")),
        part("II", F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n")),
    )
    parts = F.when(F.col("doc_id") % 2 == 0, two).otherwise(F.array(part("Text", F.col("text"))))
    return d.select(
        F.concat(F.lit("src "), "doc_id").alias("source"), F.concat(
            F.lit("Work "), "doc_id"
        ).alias("title"), F.lit(None).cast("string").alias("author"),
        (F.col("doc_id") % 5 == 0).alias("verse"), (F.col("doc_id") % 7 == 0).alias("pre_segmented"), parts.alias("parts"), "doc_id",
    )


_PARTS = """p AS (SELECT doc_id, 0 AS part, CASE WHEN doc_id % 2 = 0 THEN 'I' ELSE 'Text' END AS label, CASE WHEN doc_id % 2 = 0 THEN array_to_string(l[1:len(l) // 2], chr(10)) ELSE text END AS t FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)
UNION ALL SELECT doc_id, 1, 'II', array_to_string(l[len(l) // 2 + 1:], chr(10)) FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) WHERE doc_id % 2 = 0)"""


_ABBREVIATED = f"list_contains({_list(X.ABBREVIATIONS)}, lower(regexp_replace(list_extract(regexp_split_to_array(trim(piece), '[\\s(]'), -1), '[.;:?!]+$', '')))"


# verse by line, cut parts whole, prose by sentence: a piece that ends in an abbreviation goes on
_CUT = rf"""{_PARTS}, whole AS (SELECT doc_id, part, 0 AS i, regexp_replace(t, '^\s+|\s+$', '', 'g') AS line FROM p WHERE doc_id % 7 = 0),
verse AS (SELECT doc_id, part, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, part, list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))) AS l FROM p WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0)),
pieces AS (SELECT doc_id, part, unnest(range(0, len(ps))) AS i, unnest(ps) AS piece FROM (SELECT doc_id, part, string_split(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '([.;:?!])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM p WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0)),
joined AS (SELECT *, lag({_ABBREVIATED}) OVER (PARTITION BY doc_id, part ORDER BY i) AS on_ FROM pieces), grouped AS (SELECT *, sum(CASE WHEN i = 0 OR NOT on_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, part ORDER BY i) AS g FROM joined),
prose AS (SELECT doc_id, part, g AS i, trim(string_agg(piece, ' ' ORDER BY i)) AS line FROM grouped GROUP BY doc_id, part, g),
cut AS (SELECT * FROM (SELECT * FROM whole UNION ALL SELECT * FROM verse UNION ALL SELECT * FROM prose) WHERE line <> '')"""


@query(f"WITH {_CUT} SELECT doc_id, CAST(part AS INT) AS part, count(*) AS n, md5(string_agg(line, '|' ORDER BY i)) AS digest FROM cut GROUP BY doc_id, part")
def snk01_add_document(spark, sf):
    # ids are hashes, so places are found through the joins back to the works
    documents, sections, cut = store.documents_of(raw_works(spark, sf))
    named = documents.select(F.col("id").alias("doc"), F.substring("source", 5, 20).cast("long").alias("doc_id"))
    placed = cut.join(
        sections.select(F.col("id").alias("section_id"), F.col("doc_id").alias("doc"), F.col("ord").alias("part")), "section_id"
    ).join(named, "doc")
    listed = F.array_sort(F.collect_list(F.struct("ord", "source_text")))
    digest = F.md5(F.array_join(F.transform(listed, lambda x: x["source_text"]), "|").cast("binary"))
    return placed.groupBy("doc_id", "part").agg(F.count("*").alias("n"), digest.alias("digest"))


# the whole library is ingested, a fifth of it translated; then some works get a new text, whose translations are forgotten, and a status
@query(f"""WITH {_CUT}, t AS (SELECT *, doc_id % 50 = 7 AS new, doc_id % 5 = 2 AND doc_id % 50 <> 7 AS done FROM cut)
SELECT doc_id, CAST(part AS INT) AS part, count(*) AS n, CAST(count_if(done) AS BIGINT) AS translated, md5(string_agg(CASE WHEN new THEN 'new ' || line WHEN done THEN line || '/T ' || line ELSE line END, '|' ORDER BY i)) AS digest,
CASE WHEN doc_id % 50 = 7 THEN 'untranslated' ELSE 'unknown' END AS status FROM t GROUP BY doc_id, part""")
def snk03_library_patches(spark, sf):
    lib = store.Library(spark, fresh(spark, "library"), 16)
    lib.ingest(raw_works(spark, sf))
    number = F.substring("source", 5, 20).cast("long")

    def chosen(where):
        """The ids of works, and of their sections: stored, so that Spark knows how few they are before it deals texts to meet them."""
        works = stored(lib.table("documents").where(where).select(F.col("id").alias("doc_id")), "works")
        return works, stored(lib.table("sections").join(works, "doc_id", "left_semi").select(F.col("id").alias("section_id")), "chosen")

    segments = lambda ids: lib.table("segments").join(ids, "section_id", "left_semi")
    done = segments(chosen(number % 5 == 2)[1]).select("id", "section_id", F.concat(F.lit("T "), "source_text").alias("english_text"))
    lib.patch(done, ["english_text"])
    works, renewed = chosen(number % 50 == 7)
    lib.patch_source(segments(renewed).select("id", "section_id", F.concat(F.lit("new "), "source_text").alias("source_text")))
    lib.set_status(works.select(F.col("doc_id").alias("id"), F.lit("untranslated").alias("translation_status")))
    documents = lib.table("documents").select(F.col("id").alias("doc"), number.alias("doc_id"), F.col("translation_status").alias("status"))
    sections = lib.table("sections").select(F.col("id").alias("section_id"), F.col("doc_id").alias("doc"), F.col("ord").alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("/", "source_text", "english_text").alias("t"))))
    rows = lib.table("segments").groupBy("section_id").agg(  # texts are dealt once; their digests meet the rest
        F.count("*").alias("n"),
        F.count("english_text").alias("translated"),
        F.md5(F.array_join(F.transform(listed, lambda x: x["t"]), "|").cast("binary")).alias("digest"),
    )
    placed = rows.join(sections, "section_id").join(documents, "doc")
    return placed.select("doc_id", "part", "status", "n", "translated", "digest")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS sections, 'la' AS language, 'unknown' AS status FROM documents")
def flt07_metadata_defaults(spark, sf):
    documents, sections, _ = store.documents_of(raw_works(spark, sf))
    n = sections.groupBy("doc_id").agg(F.count("*").alias("sections"))
    joined = documents.join(n, documents["id"] == n["doc_id"])
    return joined.select(
        F.substring("source", 5, 20).cast("long").alias("doc_id"), "sections", "language", F.col("translation_status").alias("status")
    )


@query(
    W(
        "SELECT id FROM w WHERE starts_with(source, 'src1') AND language = 'la' AND translation_status <> 'translated' AND genre IS "
        "DISTINCT FROM 'poetry'"
    )
)
def flt03_metadata_filters(spark, sf):
    return store.selected(works(spark, sf), source_prefix="src1", language="la", skip_translated=True, skip_poetry=True).select("id")


@query(
    W(
        "SELECT DISTINCT 'Author ' || s.n_name AS author FROM nation s WHERE 'Author ' || s.n_name NOT IN (SELECT author FROM w WHERE "
        "author IS NOT NULL) UNION SELECT 'Author src' || 999"
    )
)
def flt17_missing_authors(spark, sf):
    seeds = table(spark, sf, "nation").select(F.concat(F.lit("Author "), "n_name").alias("author"))
    more = spark.createDataFrame([("Author src999",), ("Author src1",)], "author string")
    return store.missing_authors(seeds.unionByName(more).distinct(), works(spark, sf))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'DigilibLT (DLT' || doc_id || ')' WHEN 1 THEN 'PTA (pta' || doc_id || '.w1)' WHEN 2 THEN 'Perseus (phi' || doc_id || '.w2)' WHEN 3 THEN 'MGH (bsb' || doc_id || ')'
WHEN 4 THEN 'PG Corpus (PG' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INT), '0') || CASE WHEN doc_id % 4 = 0 THEN '_2' ELSE '' END || ')' END AS source FROM documents""")
def str39_expected_source(spark, sf):
    d, n = F.col("doc_id"), F.col("doc_id") % 6
    kinds = F.array(*map(F.lit, ["digiliblt", "pta", "perseus", "mgh", "pg_corpus", "edcs"]))
    ident = F.when(n == 0, F.concat(F.lit("DLT"), d)).when(
        n == 1, F.concat(F.lit("urn:cts:greekLit:pta"), d, F.lit(".w1.x"))
    ).when(n == 2, F.concat(F.lit("phi"), d, F.lit("/w2")))
    ident = ident.when(n == 3, F.concat(F.lit("https://x/BSB"), d, F.lit(".zip"))).when(
        n == 4, F.concat(F.lit("pg0"), d, F.when(d % 4 == 0, "_2").otherwise(""))
    ).otherwise("x")
    return table(spark, sf, "documents").select("doc_id", store.expected_source(F.get(kinds, n.cast("int")), ident).alias("source"))


@query(
    "SELECT min(l.doc_id) AS pos, d.last AS doc_id FROM labels l JOIN (SELECT 'DLT' || doc_id // 2 AS k, max(doc_id) AS last FROM "
    "documents GROUP BY 1) d ON d.k = 'DLT' || l.doc_id // 3 GROUP BY d.last"
)
def jon13_curated(spark, sf):
    ident = lambda n: F.concat(F.lit("DLT"), F.floor(F.col("doc_id") / n))
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.lit("digiliblt").alias("kind"), ident(3).alias("identifier"))
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("DigilibLT ("), ident(2), F.lit(")")).alias("source")
    )
    return store.curated(wanted, documents)


_STAGE = "replace(coalesce(language_stage, 'unknown'), '_', ' ')"


@query(W(f"""SELECT id, coalesce(author, 'Anon.') || ' — ' || title || ' (' || CASE WHEN language <> 'la' THEN 'Greek, ' ELSE '' END || {_STAGE} || CASE WHEN translation_status IN ('translated', 'translated_paywalled') THEN '' ELSE '  · untranslated' END || ')' AS label,
'  [' || lpad(CAST(id AS VARCHAR), CAST(greatest(4, length(CAST(id AS VARCHAR))) AS INT), ' ') || '] ' || rpad(coalesce(author, 'Anon.'), 22, ' ') || ' ' || title || '  (' || CASE WHEN language = 'la' THEN 'Latin' ELSE 'Greek' END || ', ' || {_STAGE} || CASE WHEN genre = 'poetry' THEN ', verse' ELSE '' END || ')' AS line FROM w"""))
def str46_labels(spark, sf):
    d = library.with_status(works(spark, sf), F.col("translation_status"))
    return d.select("id", store.document_label().alias("label"), store.listing_line().alias("line"))


_ENGLISH = "nullif(regexp_replace(coalesce(english_text, ''), '^\\s+|\\s+$', '', 'g'), '')"
_STYLED = "nullif(regexp_replace(coalesce(english_styled, ''), '^\\s+|\\s+$', '', 'g'), '')"


@query(
    S(
        f"SELECT id, CASE WHEN {_STYLED} IS NOT NULL THEN 'styled' WHEN {_ENGLISH} IS NOT NULL THEN 'plain' ELSE 'missing' END AS "
        f"kind, coalesce({_STYLED}, {_ENGLISH}, '{store.FRAGMENT}') AS text FROM s"
    )
)
def snk09_export_text(spark, sf):
    kind, text = store.export_text()
    return segments(spark, sf).select("id", kind.alias("kind"), text.alias("text"))


_ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_FILLED = lambda c: f"length(regexp_replace(coalesce({c}, ''), '\\s', '', 'g')) > 0"


@query(WS(f"""SELECT w.id AS doc_id, md5('<h2>' || {_ESC('any_value(w.title)')} || '</h2><p class="reader-meta">' || {_ESC(f"concat_ws(' · ', coalesce(any_value(author), 'Anon.'), any_value({_STAGE}), CASE WHEN any_value(century) < 0 THEN abs(any_value(century)) || 'c BCE' WHEN any_value(century) > 0 THEN any_value(century) || 'c CE' END, nullif(any_value(genre), ''), any_value(source))")} || '</p><table class="reader"><thead><tr><th>' || CASE WHEN any_value(language) = 'la' THEN 'Latin' ELSE 'Greek' END || '</th><th>English (stylized)</th></tr></thead><tbody>' ||
string_agg('<tr><td class="la">' || {_ESC('source_text')} || '</td>' || CASE WHEN NOT {_FILLED('english_text')} THEN '<td class="en"><span class="untranslated">— not yet translated —</span>' WHEN {_FILLED('english_styled')} THEN '<td class="en styled">' || {_ESC('english_styled')} ELSE '<td class="en"><span class="unstyled">— not yet stylized —</span><br>' || {_ESC("coalesce(english_text, '')")} END || '</td></tr>', '' ORDER BY ord) || '</tbody></table>') AS digest
FROM w JOIN s ON s.doc_id = w.id GROUP BY w.id"""))
def snk11_reader(spark, sf):
    s = segments(spark, sf).withColumn("scansion", F.lit(None).cast("string"))
    sections = s.groupBy("section_id", "doc_id").agg(F.min("ord").alias("ord")).withColumnRenamed("section_id", "id")
    pages = store.reader_pages(works(spark, sf), sections, s.drop("doc_id"), "Stylized")
    return pages.select("doc_id", F.md5(F.col("html").cast("binary")).alias("digest"))


# every document's export as a file of its own, written by the sink and read back
@query(
    S(
        f"SELECT doc_id || '.txt' AS name, sha256(string_agg(coalesce({_STYLED}, {_ENGLISH}, '{store.FRAGMENT}'), chr(10) ORDER BY ord)) AS sha256, "
        f"CAST(strlen(string_agg(coalesce({_STYLED}, {_ENGLISH}, '{store.FRAGMENT}'), chr(10) ORDER BY ord)) AS BIGINT) AS bytes FROM s GROUP BY doc_id"
    )
)
def snk09_export_files(spark, sf):
    sink.register(spark)
    _, text = store.export_text()
    rows = segments(spark, sf).select("doc_id", "ord", text.alias("text"))
    whole = mining.in_order(rows, ["doc_id"], ["ord"], "text", "content", "\n")
    path = fresh(spark, "exports").removeprefix("file:")
    whole.select(F.concat("doc_id", F.lit(".txt")).alias("name"), "content").write.format("files").option("path", path).mode("append").save()
    return sink.contents(spark, path).select("name", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


_GROUPED = "\nUNION ALL ".join(
    f"SELECT {part} AS part, CAST(row_number() OVER (ORDER BY n DESC, key) - 1 AS INT) AS rank, '  ' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n "
    f"AS VARCHAR))) AS INT), ' ') || '  ' || key AS line FROM (SELECT {key} AS key, count(*) AS n FROM w GROUP BY 1)"
    for part, key in (
        (1, "regexp_replace(source, '\\s*\\(.*', '')"), (2, "language"), (3, "coalesce(language_stage, 'unknown')"), (4, "coalesce(nullif(trim(genre), ''), 'unclassified')"),
    )
)
_COUNT = lambda c: f"count_if({_FILLED(c)})"


@query(WS(f"""{_GROUPED}
UNION ALL SELECT 0, 0, 'Documents: ' || count(*) FROM w UNION ALL SELECT 0, 2, 'Era span: ' || min(century) || 'c to ' || max(century) || 'c' FROM w
UNION ALL SELECT 0, 1, 'Segments: ' || format('{{:,}}', {_COUNT('english_text')}) || ' / ' || format('{{:,}}', count(*)) || ' translated (' || printf('%.1f', 100 * {_COUNT('english_text')} / count(*)) || '%), ' || format('{{:,}}', {_COUNT('english_styled')}) || ' stylized' FROM s
UNION ALL SELECT 5, CAST(row_number() OVER (ORDER BY n DESC, id) - 1 AS INT), '  ' || lpad(CAST(n AS VARCHAR), CAST(greatest(6, length(CAST(n AS VARCHAR))) AS INT), ' ') || ' segs  ' || title || ' (' || coalesce(author, 'anon') || ') [' || source || ']'
FROM (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 8) JOIN w ON w.id = doc_id"""))
def snk09_report(spark, sf):
    return store.report_lines(works(spark, sf), segments(spark, sf))


@query(
    "SELECT to_json({src: text, tgt: role, citation: conv_id || '.' || turn, source: CASE WHEN turn % 2 = 0 THEN 'a/b' || chr(9) END}) AS line, "
    "count(*) AS n FROM conversations WHERE turn % 2 = 0 GROUP BY 1 UNION ALL SELECT to_json({src: text, tgt: role, citation: conv_id || '.' || "
    "turn}), count(*) FROM conversations WHERE turn % 2 <> 0 GROUP BY 1"
)
def snk07_pair_lines(spark, sf):
    pairs = table(spark, sf, "conversations").select(
        F.col("text").alias("src"),
        F.col("role").alias("tgt"),
        F.concat_ws(".", "conv_id", "turn").alias("citation"),
        F.when(F.col("turn") % 2 == 0, F.lit("a/b\t")).alias("source"),
    )
    return mining.pair_json(pairs).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(source_text, '()[]<>{}', ''), '/+', ' ', "
    r"'g'), '-{2,}', ' ', 'g'), '\.{2,}', ' ', 'g'), '[+*=~^|]+', ' ', 'g'), '\s+', ' ', 'g'))"
)


@query(
    S(
        f"SELECT id, {_CLEAN} AS embed_text FROM s WHERE ord % 3 <> 0 AND {_CLEAN} <> '' AND {_CLEAN} <> regexp_replace(source_text, "
        f"'^\\s+|\\s+$', '', 'g')"
    )
)
def emb03_backfill(spark, sf):
    return store.backfilled(segments(spark, sf).withColumn("embed_text", F.when(F.col("ord") % 3 == 0, "done")))


@query("SELECT count(*) AS n, 0 AS none FROM embeddings")
def agg20_index_size(spark, sf):
    index = stored(search.add_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding"), "index")
    empty = search.top_k(index.limit(0), [1.0] * 64, 5)
    return index.agg(F.count("*").alias("n")).join(F.broadcast(empty.agg(F.count("*").alias("none"))))


# leaves: a section for each line of the source edition, a chapter for each two lines of the target
def leaves(spark, sf, chapters):
    s = segments(spark, sf)
    chain = [
        F.struct(F.lit("edition").alias("level"), F.lit("x").alias("n")),
        F.struct(F.lit("book").alias("level"), F.floor(F.col("ord") / 8).cast("string").alias("n")),
        F.struct(F.lit("chapter").alias("level"), F.floor(F.col("ord") / 2).cast("string").alias("n")),
    ]
    if not chapters:
        chain.append(F.struct(F.lit("section").alias("level"), (F.col("ord") % 2).cast("string").alias("n")))
        chain[0] = F.struct(F.lit("book").alias("level"), F.lit("outer").alias("n"))
    text = F.concat(F.lit("E "), "source_text") if chapters else F.col("source_text")
    rows = s.where("ord % 2 = 0") if chapters else s
    return rows.select(F.col("doc_id").alias("work"), F.col("ord").alias("pos"), F.array(*chain).alias("chain"), text.alias("text"))


@query(S(r"""SELECT a.src, b.tgt, a.book || '.' || a.chapter AS citation, 'Perseus ' || a.doc_id AS source FROM (SELECT doc_id, ord // 8 AS book, ord // 2 AS chapter, regexp_replace(string_agg(source_text, ' ' ORDER BY ord), '^\s+|\s+$', '', 'g') AS src FROM s GROUP BY ALL) a
JOIN (SELECT doc_id, ord // 2 AS chapter, regexp_replace('E ' || source_text, '^\s+|\s+$', '', 'g') AS tgt FROM s WHERE ord % 2 = 0) b USING (doc_id, chapter) WHERE a.src <> '' AND b.tgt <> ''"""))
def aln03_citation_pairs(spark, sf):
    return mining.citation_pairs(leaves(spark, sf, False), leaves(spark, sf, True)).select("src", "tgt", "citation", "source")


# wrappers, a level that only some leaves have, and names that depend on the work
@query(S("""SELECT work, string_agg(level, ',' ORDER BY pos, depth) AS levels FROM (SELECT work, level, min(pos) AS pos, arg_min(depth, pos) AS depth FROM (
SELECT doc_id AS work, ord AS pos, unnest(range(0, 4)) AS depth, unnest(['edition', CASE WHEN doc_id % 2 = 0 THEN 'book' ELSE 'letter' END, CASE WHEN ord % 5 = 3 THEN 'poem' WHEN doc_id % 3 = 0 THEN 'section' ELSE 'chapter' END, CASE WHEN ord % 4 = 2 THEN 'translation' ELSE 'section' END]) AS level FROM s)
WHERE level NOT IN ('edition', 'translation') GROUP BY work, level) GROUP BY work"""))
def agg12_levels(spark, sf):
    d, o = F.col("doc_id"), F.col("ord")
    names = [
        F.lit("edition"),
        F.when(d % 2 == 0, "book").otherwise("letter"),
        F.when(o % 5 == 3, "poem").when(d % 3 == 0, "section").otherwise("chapter"),
        F.when(o % 4 == 2, "translation").otherwise("section"),
    ]
    chain = F.array(*[F.struct(c.alias("level"), o.cast("string").alias("n")) for c in names])
    rows = segments(spark, sf).select(d.alias("work"), o.alias("pos"), chain.alias("chain"))
    return mining.levels(rows).select("work", F.array_join("levels", ",").alias("levels"))


@query(
    S(
        "SELECT doc_id, book AS n, src, 'x ' || src AS tgt FROM (SELECT doc_id, ord // 8 AS book, string_agg(source_text, ' ' ORDER BY "
        "ord) AS src FROM s GROUP BY ALL) WHERE book % 2 = 0"
    )
)
def jon07_common_books(spark, sf):
    source = mining.source_books(leaves(spark, sf, False))
    target = source.where(F.col("book").cast("int") % 2 == 0).withColumn("text", F.concat(F.lit("x "), "text"))
    return mining.common_books(source, target).select(F.col("work").alias("doc_id"), "n", "src", "tgt")


# all lines of a text in 24 books at most, as many as there are names; a list of contents comes first, close together
@query(
    "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \\t]*(BOOK|GEORGIC)')) AS l FROM documents), "
    "r AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line, len(l) AS n FROM l WHERE len(l) > 1) "
    "SELECT doc_id AS work, CAST(i * least(n, 24) // n + 1 AS VARCHAR) AS book, length('BOOK ' || (i * least(n, 24) // n + 1)) + 1 + "
    "length(string_agg(line, chr(10) ORDER BY i)) + 1 AS chars FROM r GROUP BY doc_id, n, i * least(n, 24) // n"
)
def aln05_target_books(spark, sf):
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^[ \t]*(BOOK|GEORGIC)"))
    names = F.array(*[F.lit(x) for x in X.ORDINALS])
    books = F.sequence(F.lit(0), F.col("k") - 1)
    start = lambda b: F.ceil(b * F.size("lines") / F.col("k")).cast("int")
    title = lambda b: F.concat(F.lit("BOOK THE "), F.upper(F.get(names, b)), F.lit("\n"))
    chapter = lambda b: F.array_join(F.slice("lines", start(b) + 1, start(b + 1) - start(b)), "\n")
    body = F.transform(books, lambda b: F.concat(title(b), chapter(b), F.lit("\n")))
    cut = table(spark, sf, "documents").select("doc_id", lines.alias("lines")).where("size(lines) > 1")
    cut = cut.withColumn("k", F.least(F.size("lines"), F.lit(len(X.ORDINALS))))
    texts = cut.select(
        F.col("doc_id").alias("work"),
        F.concat(F.array_join(F.transform(books, title), ""), F.lit("\n"), F.array_join(body, "")).alias("text"),
    )
    found = mining.target_books(texts)
    numeral = F.length(F.get(names, F.col("book").cast("int") - 1)) + F.length(F.lit("BOOK THE "))
    return found.select(
        "work", "book", (F.length("text") - numeral + F.length(F.concat(F.lit("BOOK "), "book"))).cast("long").alias("chars")
    )


_SIDES = (
    "WITH c AS (SELECT conv_id AS key, count(*) FILTER (role = 'user') AS n, count(*) FILTER (role <> 'user') AS m FROM conversations "
    "GROUP BY 1)"
)


@query(
    f"{_SIDES}, p AS (SELECT key, n, m, unnest(range(0, n)) AS i FROM c), q AS (SELECT *, unnest(range(0, m)) AS j FROM p) SELECT key, "
    f"CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM q WHERE abs(j - round_even(i * m / n, 0)) <= 1"
)
def jon17_band_candidates(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("key")).agg(
        F.count_if(F.col("role") == "user").cast("int").alias("n"), F.count_if(F.col("role") != "user").cast("int").alias("m")
    )
    return alignment.band_candidates(c, 1).select("key", "i", "j")


@query(S("SELECT doc_id, md5(string_agg(source_text, ' ' ORDER BY ord)) AS digest FROM s GROUP BY 1"))
def agg22_whole_texts(spark, sf):
    s = segments(spark, sf)
    sections = s.groupBy("section_id", "doc_id").agg(F.min("ord").alias("ord")).withColumnRenamed("section_id", "id")
    whole = mining.whole_texts(sections, s)
    return whole.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def aln04_refined(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))), lambda x: x["text"]), " ").alias(k) for r, k in (("user", "src"), ("assistant", "tgt"))])
    return alignment.refined(c.select(F.col("conv_id").cast("string").alias("citation"), "src", "tgt"), threshold=0.3)


@query()
def aln01_align_sentences(spark, sf):
    c = table(spark, sf, "conversations")
    side = lambda role, name: c.where(F.col("role") == role).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias(name)
    )
    return alignment.align_sentences(side("user", "src").join(side("assistant", "tgt"), "conv_id"), "conv_id")


# pairs of a line and itself with every fifth word left out
_HYP = "array_to_string(list_filter(string_split(source_text, ' '), lambda x, i: (i + doc_id) % 5 <> 0), ' ')"


def hypotheses(spark, sf):
    kept = F.filter(F.split("source_text", " "), lambda x, i: (i + 1 + F.col("doc_id")) % 5 != 0)
    era = F.when(F.col("doc_id") % 3 == 0, "classical").otherwise("medieval")
    # counting n-grams is all the work, so it is dealt to all cores whatever the number of files
    rows = segments(spark, sf).repartition(spark.sparkContext.defaultParallelism, "id")
    return rows.select(
        "id", era.alias("era"), F.col("source_text").alias("ref"), F.array_join(kept, " ").alias("hyp"), F.lower("source_text").alias("src")
    )


_GRAMS = f"""p AS (SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'classical' ELSE 'medieval' END AS era, regexp_replace({_HYP}, '\\s', '', 'g') AS h, regexp_replace(source_text, '\\s', '', 'g') AS r FROM s),
o AS (SELECT unnest(range(1, 7)) AS n),
hg AS (SELECT id, era, n, g, count(*) AS c FROM (SELECT id, era, n, unnest(list_transform(range(1, length(h) - n + 2), lambda i: substr(h, i, n))) AS g FROM p, o WHERE length(h) >= n) GROUP BY ALL),
rg AS (SELECT id, era, n, g, count(*) AS c FROM (SELECT id, era, n, unnest(list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n))) AS g FROM p, o WHERE length(r) >= n) GROUP BY ALL),
ht AS (SELECT era, n, sum(c) AS t FROM hg WHERE (id, n) IN (SELECT id, n FROM rg) GROUP BY ALL), rt AS (SELECT era, n, sum(c) AS t FROM rg GROUP BY ALL),
m AS (SELECT hg.era, hg.n, sum(least(hg.c, rg.c)) AS t FROM hg JOIN rg USING (id, n, g) GROUP BY ALL),
f AS (SELECT era, avg(coalesce(m.t, 0) / ht.t) AS p, avg(coalesce(m.t, 0) / rt.t) AS r FROM ht JOIN rt USING (era, n) LEFT JOIN m USING (era, n) GROUP BY era)"""


@query(S("SELECT 1").replace("SELECT 1", "").rstrip() + f", {_GRAMS} SELECT era, round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM f")
def agg14_chrf_by_era(spark, sf):
    return evaluation.corpus_scores(hypotheses(spark, sf), ["era"]).select("era", F.round("chrf", 6).alias("chrf"))


@query()
def mth05_bleu(spark, sf):
    return evaluation.corpus_scores(hypotheses(spark, sf), ["era"]).select("era", "n", F.round("bleu", 4).alias("bleu"))


@query()
def ml04_style_scores(spark, sf):
    return evaluation.style_scores(hypotheses(spark, sf), ["era"])


@query(
    "SELECT doc_id, 'M' || doc_id AS label, CASE doc_id % 3 WHEN 0 THEN 'stock/model' ELSE 'a=b/' || source END AS path, doc_id % 2 = "
    "0 AS norm FROM documents"
)
def str45_model_spec(spark, sf):
    path = F.when(F.col("doc_id") % 3 == 0, "stock").otherwise(F.concat(F.lit("a=b/"), "source"))
    spec = F.concat(F.lit("M"), "doc_id", F.lit("="), path, F.when(F.col("doc_id") % 2 == 0, ":norm").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", evaluation.model_spec(spec, "stock/model").alias("s")).select("doc_id", "s.*")


# a share of the shuffled rows, the last ones, and two stretches: how many, how many in both of two, and how many distinct
@query(
    "SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS held, least(100, count(*)) AS tail, CAST(0 AS BIGINT) AS held_in_tail, "
    "least(50, count(*)) + least(50, greatest(0, count(*) - 50)) AS stretches, least(100, count(*)) AS apart FROM documents"
)
def smp01_splits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    held = evaluation.evaluation_split(d, "doc_id", 0.1).where("evaluation").select("doc_id")
    tail = evaluation.held_out(d, "doc_id", 100)
    two = evaluation.held_out(d, "doc_id", 50, 1).unionByName(evaluation.held_out(d, "doc_id", 50, 51))
    count = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    out = d.agg(F.count("*").alias("n"))
    parts = [(held, "held"), (tail, "tail"), (held.join(tail, "doc_id"), "held_in_tail"), (two, "stretches"), (two.distinct(), "apart")]
    for df, name in parts:
        out = out.join(count(df, name))
    return out


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'la' ELSE lang END AS src_lang, count(*) AS n FROM documents GROUP BY 1")
def agg21_routed_examples(spark, sf):
    lang = F.when(F.col("doc_id") % 8 == 0, "").when(F.col("doc_id") % 4 != 0, F.col("lang"))
    return evaluation.routed_examples(table(spark, sf, "documents").select(lang.alias("src_lang")))


@query(
    "SELECT user_id, round(count(*) / (max(event_id) - min(event_id) + 1), 6) AS rate, round((10000 - count(*)) * (max(event_id) - "
    "min(event_id) + 1) / count(*), 4) AS eta FROM events GROUP BY 1"
)
def mth06_progress(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.max("event_id") - F.min("event_id") + 1).alias("s"))
    p = e.select("user_id", evaluation.progress(F.col("n"), F.lit(10000), F.col("s")).alias("p"))
    return p.select("user_id", F.round("p.rate", 6).alias("rate"), F.round("p.eta", 4).alias("eta"))


_PENDING = f"english_text IS NOT NULL AND {_FILLED('english_text')} AND NOT {_FILLED('english_styled')}"


@query(S(f"SELECT id, CAST((row_number() OVER (PARTITION BY section_id ORDER BY ord) - 1) // 2 AS INT) AS batch FROM s WHERE {_PENDING}"))
def sty02_batches(spark, sf):
    return styling.style_batches(segments(spark, sf), 2).select("id", "batch")


@query(
    S(
        f"SELECT id, replace(regexp_replace(english_text, '^\\s+|\\s+$', '', 'g'), 'e', '3') AS english_styled, 'victorian_prose' AS "
        f"style_label FROM s WHERE {_PENDING}"
    )
)
def sty01_styled(spark, sf):
    # the stub's model answers the numbered list, or the one text, with another letter
    def factory():
        return lambda system, user: user.split("\n\n")[-1].replace("e", "3")

    return styling.styled(segments(spark, sf), factory, "victorian_prose", size=3)


@query(
    S(
        f"SELECT doc_id, n, CAST((row_number() OVER (ORDER BY n DESC, doc_id) - 1) % 3 AS INT) AS shard FROM (SELECT doc_id, count(*) AS n FROM s WHERE "
        f"{_PENDING} GROUP BY 1)"
    )
)
def sty02_plan(spark, sf):
    return styling.style_plan(segments(spark, sf), 3)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 't5' ELSE 'llm' END AS backend FROM documents")
def sty03_backend(spark, sf):
    wanted = F.when(F.col("doc_id") % 2 == 0, "t5").otherwise("llm")
    complete = F.when(F.col("doc_id") % 3 == 0, F.lit(True)).when(F.col("doc_id") % 3 == 1, F.lit(False))
    return table(spark, sf, "documents").select("doc_id", styling.backend(wanted, complete).alias("backend"))


# a line for each document, whose first four feet follow the digits of a number, with an elision in every third and a foot too many in every seventh
_FOOT = lambda i, dactyl, spondee: f"CASE WHEN (n_chars + doc_id) // {2**i} % 2 = 1 THEN '{dactyl}' ELSE '{spondee}' END"
_LINE = (
    "concat(CASE WHEN doc_id % 3 = 0 THEN 'Ta ' ELSE '' END, " + ", ".join(_FOOT(i, f"{'ā' if i == 0 else 'tā'} tă tă ", f"{'ā' if i == 0 else 'tā'} tā ") for i in range(4))
    + ", 'tā tă tă tā ta', CASE WHEN doc_id % 7 = 3 THEN ' tă tă' ELSE '.' END)"
)


@query(
    "SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 3 THEN " + " || '|' || ".join(_FOOT(i, "-uu", "--") for i in range(4)) + " || '|-uu|-x' END AS scansion, "
    "CASE WHEN doc_id % 7 = 3 THEN 'no valid scan found' END AS note FROM documents"
)
def scn01_scansion(spark, sf):
    d = F.col("doc_id")
    lines = table(spark, sf, "documents").select(
        d.alias("id"), d.alias("section_id"), F.lit(0).alias("ord"), F.expr(_LINE.replace("//", "div")).alias("source_text"), F.lit("la").alias("language")
    )
    return styling.scanned(lines, lambda: verse.scan).select("id", "scansion", "note")


@query(WS("""SELECT s.id, CASE WHEN (row_number() OVER (PARTITION BY section_id ORDER BY ord)) % 2 = 1 THEN 'hexameter' ELSE 'pentameter' END AS meter, CASE WHEN w.language = 'la' AND regexp_replace(source_text, '\\s', '', 'g') <> '' AND length(source_text) % 2 = 0 THEN 'm' || length(regexp_replace(source_text, '^\\s+|\\s+$', '', 'g')) END AS scansion,
CASE WHEN regexp_replace(source_text, '\\s', '', 'g') = '' THEN 'empty line' WHEN w.language = 'grc' THEN 'Greek scansion not supported yet' WHEN length(source_text) % 2 = 1 THEN 'no valid scan found' END AS note FROM s JOIN w ON w.id = s.doc_id"""))
def scn01_scan(spark, sf):
    # the stub knows lines of even length
    w = works(spark, sf).select(F.col("id").alias("doc_id"), "language")
    lines = segments(spark, sf).join(w, "doc_id")
    lines = lines.withColumn("source_text", F.col("source_text"))

    def factory():
        return lambda line, meter: f"m{len(line)}" if len(line) % 2 == 0 else None

    found = styling.scanned(
        lines.withColumn(
            "source_text",
            F.when(F.length("source_text") == F.length(X.strip("source_text")), F.col("source_text")).otherwise(X.strip("source_text")),
        ),
        factory,
        "elegiac",
    )
    return found


@query(
    S(
        f"SELECT id, doc_id, english_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM s WHERE "
        f"{_FILLED('english_text')}) WHERE r <= 2"
    )
)
def flt18_preview(spark, sf):
    return styling.preview(segments(spark, sf), 2).select("id", "doc_id", "english_text")


@query(S("SELECT id FROM s WHERE " + _FILLED("source_text") + " AND ord % 3 <> 0"))
def flt15_distilled(spark, sf):
    s = segments(spark, sf).withColumn("tgt", F.replace("source_text", F.lit("ß"), F.lit("x")))
    src = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" "), F.upper("tgt"))).otherwise(F.concat("tgt", F.lit(".")))
    return styling.distilled(s.where(X.is_filled("tgt")).select("id", src.alias("src"), "tgt")).select("id")


_T = "regexp_replace(source_text, '^\\s+|\\s+$', '', 'g')"


@query(
    S(
        f"""SELECT min(id) AS pos, t AS tgt FROM (SELECT id, {_T} AS t FROM s) WHERE length(t) BETWEEN 40 AND 300 AND NOT regexp_matches(t, '[\\x{{0391}}-\\x{{03A9}}\\x{{03B1}}-\\x{{03C9}}\\x{{1F00}}-\\x{{1FFC}}]') AND NOT regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{4,}}($|[^\\p{{L}}\\p{{N}}_])') AND NOT regexp_matches(t, '(?i)\\(\\s*(?:Enter|Exit|Exeunt|Aside|to\\s+\\w+self|sings|aside)\\b') AND NOT regexp_matches(t, '(?i)\\b(?:mentul|cinaed|pathic|catamit)\\w*') AND len(regexp_extract_all(t, '[()]')) <= 1 AND len(regexp_extract_all(t, '\\p{{L}}')) >= 0.6 * length(t) GROUP BY t"""
    )
)
def flt16_gathered(spark, sf):
    return styling.gathered(segments(spark, sf).select(F.col("id").alias("pos"), F.col("source_text").alias("tgt")), None)


@query(S("SELECT id, upper(replace(source_text, 'ß', 'x')) AS output, false AS failed FROM s"))
def mt01_apply_model(spark, sf):
    rows = segments(spark, sf).select("id", F.replace("source_text", F.lit("ß"), F.lit("x")).alias("t"))
    return enrich.apply_model(rows, "id", "t", lambda: lambda texts: [t.upper() if t.strip() else "" for t in texts])



