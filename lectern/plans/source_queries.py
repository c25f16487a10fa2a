"""Queries of the connectors: payloads are put together from the driver's tables, so that twins can say the result directly."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import library
from ..operators.tables import fresh
from ..sources import catalogs, connector, parse, sink
from .queries import query, table

# directory listings: a folder for each source, an entry for each document, every third a file
ENTRIES = (
    "CASE doc_id % 3 WHEN 0 THEN 'work' || doc_id || '.xml' WHEN 1 THEN 'w' || doc_id ELSE 'PG' || doc_id || CASE WHEN doc_id % 2 = 0 THEN "
    "'_1' ELSE '' END END"
)
KIND = "CASE WHEN doc_id % 3 = 0 THEN 'file' ELSE 'dir' END"


# fixed values: names of collections
CAMENA = ["cera", "poemata", "thesaurus", "historicapolitica"]


def listings(spark, sf):
    return _listed(table(spark, sf, "documents"), "source")


def _listed(docs, key):
    d = docs.select(key, "doc_id", F.expr(ENTRIES).alias("name"), F.expr(KIND).alias("type"))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "name", "type")))
    return d.groupBy(F.col(key).alias("id")).agg(
        F.to_json(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))).alias("payload")
    )


_ROWS = (
    f"(SELECT source, doc_id, {ENTRIES} AS name, {KIND} AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM "
    f"documents)"
)


@query(f"SELECT source AS id, CAST(pos AS INT) AS pos, name FROM {_ROWS} WHERE kind = 'file'")
def jsn05_listing(spark, sf):
    return catalogs.listing(listings(spark, sf), "file")


@query(
    f"SELECT id, CAST(pos AS INT) AS pos, id || '.' || name AS identifier FROM (SELECT source AS id, pos, name, row_number() OVER "
    f"(PARTITION BY source ORDER BY pos) AS n FROM {_ROWS} WHERE kind = 'dir') WHERE n <= 50"
)
def src09_work_dirs(spark, sf):
    return catalogs.work_dirs(listings(spark, sf))


@query(
    f"SELECT id, name FROM (SELECT source AS id, name, row_number() OVER (PARTITION BY source ORDER BY name) AS n FROM {_ROWS} WHERE "
    f"kind = 'dir' AND regexp_full_match(name, 'PG\\d+(_\\d+)?') AND contains(lower(name), 'pg1')) WHERE n <= 200"
)
def src22_volumes(spark, sf):
    return catalogs.volumes(listings(spark, sf), "PG1")


@query(
    f"SELECT id, CAST(pos AS INT) AS pos, stem FROM (SELECT source AS id, pos, replace(name, '.xml', '') AS stem, row_number() OVER "
    f"(PARTITION BY source ORDER BY pos) AS n FROM {_ROWS} WHERE kind = 'file' AND contains(name, '3')) WHERE n <= 200"
)
def src25_xml_stems(spark, sf):
    return catalogs.xml_stems(listings(spark, sf), "3")


@query(
    f"SELECT c || '/' || replace(name, '.xml', '') AS identifier FROM (SELECT doc_id, {ENTRIES} AS name, {KIND} AS kind, (['cera', 'poemata', 'thesaurus', "
    f"'historicapolitica'])[doc_id % 4 + 1] AS c, ([1, 3, 4, 2])[doc_id % 4 + 1] AS r FROM documents) WHERE kind = 'file' ORDER BY r, doc_id LIMIT 200"
)
def src26_camena_ids(spark, sf):
    d = table(spark, sf, "documents").withColumn("source", F.get(F.array(*map(F.lit, CAMENA)), (F.col("doc_id") % 4).cast("int")))
    return catalogs.camena_ids(_listed(d, "source"))


@query(
    "SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INT) AS pos, text AS title FROM "
    "conversations"
)
def src07_wiki_titles(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    hits = F.transform("t", lambda x: F.struct(x["text"].alias("title")))
    inner = F.when(
        F.col("id") % 2 == 0, F.struct(hits.alias("categorymembers"), F.lit(None).cast("array<struct<title:string>>").alias("search"))
    ).otherwise(F.struct(F.lit(None).cast("array<struct<title:string>>").alias("categorymembers"), hits.alias("search")))
    return catalogs.wiki_titles(c.select("id", F.to_json(F.struct(inner.alias("query"))).alias("payload")))


# catalogue pages of 16 works each, every number twice
@query(
    "SELECT idno FROM (SELECT 'DLT' || lpad(CAST(doc_id // 2 AS VARCHAR), 6, '0') AS idno, min(doc_id) AS a0 FROM documents GROUP BY 1 "
    "ORDER BY a0 LIMIT 100000)"
)
def src11_dlt_ids(spark, sf):
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 16).alias("id"),
        "doc_id",
        F.concat(
            F.lit("<a href='/idno/DLT"), F.lpad(F.floor(F.col("doc_id") / 2).cast("string"), 6, "0"), F.lit("/format/xml'>x</a>")
        ).alias("a"),
    )
    pages = d.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "a"))), lambda x: x["a"]), "\n").alias("payload")
    )
    return catalogs.dlt_ids(pages, 100_000)


_BSB = "'bsb' || lpad(CAST(doc_id // 3 AS VARCHAR), 8, '0')"
_VOLUME = "CASE doc_id % 2 WHEN 0 THEN 'Scriptores <i>' ELSE 'Auct. ant.  <i>' END || source || '</i> (' || doc_id || ')'"


def _index_pages(spark, sf):
    link = (
        f"'<li><a class=v href=\"https://data.mgh.de/openmgh/' || "
        f"{_BSB.replace('doc_id // 3', 'CAST(floor(doc_id / 3) AS BIGINT)').replace('VARCHAR', 'STRING')} || '.zip\" title=z>' || "
        f"{_VOLUME} || '</a>'"
    )
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 50).alias("id"), "doc_id", F.expr(link).alias("a"))
    return d.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "a"))), lambda x: x["a"]), "\n").alias("payload")
    )


_TITLE = r"trim(regexp_replace(regexp_replace(" + _VOLUME + r", '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT {_BSB} AS bsb, arg_min({_TITLE}, doc_id) AS title FROM documents GROUP BY 1")
def src20_mgh_catalogue(spark, sf):
    return catalogs.mgh_catalogue(_index_pages(spark, sf)).select("bsb", "title")


@query(
    f"SELECT bsb FROM (SELECT {_BSB} AS bsb, arg_min({_TITLE}, doc_id) AS title, min(doc_id) AS a0 FROM documents GROUP BY 1) WHERE "
    f"contains(lower(title), 'auct. ant. src1') ORDER BY a0 LIMIT 200"
)
def src20_mgh_discover(spark, sf):
    return catalogs.mgh_discover(_index_pages(spark, sf), "Auct. ant. src1")


_MANIFEST = (
    "SELECT doc_id, 'w' || doc_id // 2 AS code, 'Author ' || source AS author, CAST(doc_id % 15 AS INT) AS century, 'Carmen ' || doc_id AS "
    "title FROM documents"
)


def _manifest(spark, sf):
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 100).alias("id"), "doc_id", F.concat(
            F.lit("w"), F.floor(F.col("doc_id") / 2)
        ).alias("code"), F.concat(F.lit("Author "), "source").alias("author"),
        (F.col("doc_id") % 15).alias("century"), F.concat(F.lit("Carmen "), "doc_id").alias("title"),
    )
    entry = F.struct("doc_id", "code", "author", "century", "title")
    return catalogs.manifest(d.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload")))


@query(
    f"SELECT code, arg_min(author, doc_id) AS author, arg_min(century, doc_id) AS century, arg_min(title, doc_id) AS title FROM "
    f"({_MANIFEST}) GROUP BY code"
)
def src24_manifest(spark, sf):
    return _manifest(spark, sf).select("code", "author", "century", "title")


@query(
    f"SELECT code FROM (SELECT code, arg_min(century, doc_id) AS century, min(doc_id) AS a0 FROM ({_MANIFEST}) GROUP BY code) WHERE "
    f"century = 9 ORDER BY a0 LIMIT 1000"
)
def flt08_century_filter(spark, sf):
    return catalogs.manifest_query(_manifest(spark, sf), "c9")


@query(
    f"SELECT l.doc_id, m.title, m.century FROM (SELECT doc_id, 'w' || doc_id AS code FROM labels) l LEFT JOIN (SELECT code, "
    f"arg_min(title, doc_id) AS title, arg_min(century, doc_id) AS century FROM ({_MANIFEST}) GROUP BY code) m USING (code)"
)
def jon18_manifest_lookup(spark, sf):
    from ..operators import store

    keys = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("w"), "doc_id").alias("code"))
    return store.looked_up(keys, _manifest(spark, sf), "code").select("doc_id", "title", "century")


@query(
    "SELECT code, arg_min(author, doc_id) AS author, arg_min(century, doc_id) AS century, arg_min(title, doc_id) AS title FROM (SELECT "
    "doc_id, 'c' || doc_id // 3 AS code, source AS author, CAST((600 + doc_id % 900) // 100 + 1 AS INT) AS century, CASE doc_id % 2 "
    "WHEN 0 THEN 'carmina' ELSE 'Opus ' || doc_id END AS title FROM documents) WHERE century <= 10 GROUP BY code"
)
def src35_crawled(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), F.concat(
            F.lit("https://x.org/codice/c"), F.floor(F.col("doc_id") / 3)
        ).alias("href"), F.col("source").alias("author"),
        F.concat(
            F.lit("† "), 600 + F.col("doc_id") % 900, F.lit("/45")
        ).alias("dates"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("Opus "), "doc_id")).alias("title"),
    )
    return catalogs.crawled(d, 1000).select("code", "author", "century", "title")


@query(
    "SELECT id, CAST(pos AS INT) AS pos, identifier FROM (SELECT conv_id AS id, 'item' || (turn // 2) AS identifier, min(n) AS pos "
    "FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS n FROM conversations) GROUP BY 1, 2)"
)
def src27_archive_ids(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    docs = F.transform("t", lambda x: F.struct(F.concat(F.lit("item"), F.floor(x["turn"] / 2)).alias("identifier")))
    return catalogs.archive_ids(c.select("id", F.to_json(F.struct(F.struct(docs.alias("docs")).alias("response"))).alias("payload")))


# index pages: links by number, some to other hosts, twice, relative and navigation
_HREF = (
    "CASE doc_id % 8 WHEN 0 THEN 'w' || doc_id || '.html' WHEN 1 THEN '/top' || doc_id || '.html' WHEN 2 THEN 'https://lib.org/a/../b' || "
    "doc_id || '.HTML' WHEN 3 THEN 'https://lib.org.evil.net/x.html' WHEN 4 THEN 'index.html' WHEN 5 THEN '../up' || doc_id || '.html' "
    "WHEN 6 THEN './cth' || doc_id || '.html' ELSE 'w' || doc_id || '.htm' END"
)
_LINK = (
    "CASE doc_id % 8 WHEN 0 THEN 'https://lib.org/dir/w' || doc_id || '.html' WHEN 1 THEN 'https://lib.org/top' || doc_id || '.html' WHEN "
    "2 THEN 'https://lib.org/b' || doc_id || '.HTML' WHEN 5 THEN 'https://lib.org/up' || doc_id || '.html' WHEN 6 THEN "
    "'https://lib.org/dir/cth' || doc_id || '.html' END"
)


def _indexes(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.concat(F.lit("<a HREF = '"), F.expr(_HREF), F.lit("'>x</a>")).alias("a"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "a"))), lambda x: x["a"]), "\n")
    return d.groupBy(F.col("source").alias("page_id")).agg(html.alias("html")).withColumn("url", F.lit("https://lib.org/dir/page.html"))


@query(
    f"SELECT page_id, link FROM (SELECT source AS page_id, {_LINK} AS link, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS "
    f"n FROM documents WHERE {_LINK} IS NOT NULL) WHERE n <= 50"
)
def src05_links(spark, sf):
    return catalogs.page_links(_indexes(spark, sf), "lib.org").select("page_id", "link")


@query(
    "SELECT page_id, link FROM (SELECT source AS page_id, 'https://lib.org/' || CASE doc_id % 8 WHEN 6 THEN 'cth' WHEN 1 THEN 'top' ELSE 'up' END || "
    "doc_id || '.html' AS link, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id % 8 IN (1, 5, 6)) WHERE n <= 50"
)
def src17_numbered_links(spark, sf):
    return catalogs.page_links(_indexes(spark, sf), "lib.org", "numbered").select("page_id", "link")


_PLAIN = r"trim(regexp_replace(replace(text, '/', ' / '), '\s+', ' ', 'g'))"


@query(
    f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY doc_id) - 1 AS INT) AS ord, label, text FROM (SELECT doc_id // 20 AS "
    f"id, doc_id, 'EDCS-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' · CIL ' || doc_id ELSE '' END || CASE doc_id % 3 WHEN 0 THEN ' "
    f"· Roma' WHEN 1 THEN ' · Ostia' ELSE '' END AS label, {_PLAIN} AS text FROM documents WHERE doc_id % 5 <> 4) WHERE text <> ''"
)
def src18_edcs_segments(spark, sf):
    d = F.col("doc_id")
    q = lambda c: F.to_json(F.array(c))  # noqa: E731  a JSON string in brackets
    bare = lambda c: F.regexp_replace(q(c), r"(?s)^\[|\]$", "")
    text = F.when(
        d % 5 == 0, F.concat(F.lit("["), q("text"), F.lit("]"))
    ).when(d % 5 == 1, q("text")).when(d % 5 == 4, "[]").otherwise(bare("text"))
    belege = F.when(d % 2 == 0, F.concat(F.lit('[["CIL", "'), d, F.lit('", ""]]'))).otherwise("[]")
    place = F.when(d % 3 == 0, ', "provinz": "Roma"').when(d % 3 == 1, ', "provinz": "", "ort": "Ostia"').otherwise("")
    row = F.concat(
        F.lit('{"obj": {"edcs-id": "EDCS-'), d, F.lit('", "inschriften": '), text, F.lit(', "belege": '), belege, place, F.lit("}}")
    )
    rows = table(spark, sf, "documents").select(F.floor(d / 20).alias("id"), "doc_id", row.alias("r"))
    payload = F.concat(
        F.lit('{"data": ['),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "r"))), lambda x: x["r"]), ", "),
        F.lit("]}"),
    )
    return catalogs.edcs_segments(rows.groupBy("id").agg(payload.alias("payload")))


@query(
    r"SELECT code, CAST(ord AS INT) AS ord, label, text FROM (SELECT code, ord, CASE WHEN ord % 2 = 0 THEN 'pars ' || ord ELSE 'Cap. & "
    r"' || ord END AS label, trim(regexp_replace(line, '\s+', ' ', 'g')) || chr(10) || 'finis' AS text FROM (SELECT 'w' || doc_id AS "
    r"code, unnest(range(0, len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents) "
    r"WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' AND NOT regexp_full_match(trim(line), '\d+'))"
)
def src23_verse_parts(spark, sf):
    lines = table(spark, sf, "documents").select(
        F.concat(F.lit("w"), "doc_id").alias("code"), F.posexplode(F.split("text", "\n")).alias("ord", "line")
    )
    section = F.concat("code", F.lit("/"), "ord")
    page = F.concat(
        F.lit('<p class="c_v">'), X.escape_html("line"), F.lit('</p><p class="c_v"><b>12</b></p><p class="c_v"> <i>finis</i></p>')
    )
    sections = lines.where(
        (X.collapse("line") != "") & ~F.trim("line").rlike(r"^\d+$")
    ).select(section.alias("section"), page.alias("html"))
    option = F.concat(
        F.lit('<option value="'),
        section,
        F.lit('"> '),
        F.when(F.col("ord") % 2 == 0, F.col("ord").cast("string")).otherwise(F.concat(F.lit("<i>Cap.</i> &amp; "), "ord")),
        F.lit(" </option>"),
    )
    works = lines.groupBy("code").agg(
        F.concat(
            F.lit('<select name="codice">'),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", option.alias("o")))), lambda x: x["o"]), "\n"),
            F.lit("</select>"),
        ).alias("html")
    )
    found = catalogs.verse_parts(works, sections)
    return found.where("label <> 'carmen'")


_LINES = "SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"""WITH l AS ({_LINES}), m AS (SELECT *, CASE WHEN pos % 4 = 2 THEN 1 ELSE 0 END AS mark FROM l), p AS (SELECT *, sum(mark) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM m)
SELECT doc_id, part, label, text FROM (SELECT doc_id, part, CASE WHEN part = 0 THEN 'PG ' || doc_id ELSE 'PG ' || CASE WHEN doc_id % 2 = 0 THEN doc_id + 1000 ELSE doc_id END || ', p.' || (4 * part - 2) || CASE WHEN part % 2 = 1 THEN ', col.' || part ELSE '' END END AS label,
regexp_replace(string_agg(line, ' ' ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS text FROM p WHERE mark = 0 GROUP BY ALL) WHERE text <> ''""")
def src21_volume_sections(spark, sf):
    # every fourth line becomes a marker line; volume and column are not on all of them
    d = F.col("doc_id")
    mark = lambda i: F.concat(
        F.when(d % 2 == 0, F.concat(F.lit("$0="), d + 1000, F.lit(" "))).otherwise(F.lit("$1=x ")),
        F.lit("$8="),
        i,
        F.when((i - 2) % 8 == 0, F.concat(F.lit(" $9="), F.floor((i - 2) / 4) + 1)).otherwise(""),
    )
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 2, mark(i)).otherwise(x))
    volumes = table(spark, sf, "documents").select("doc_id", d.cast("string").alias("volume"), F.array_join(lines, "\n").alias("text"))
    return library.volume_sections(volumes).select("doc_id", "part", "label", "text")


@query(
    "SELECT lang || '.' || doc_id // 12 AS work, 'x-lat2.xml' AS src, 'x-eng1.xml' AS tgt FROM documents GROUP BY 1 HAVING count(*) "
    "FILTER (doc_id % 4 = 0) > 0 AND count(*) FILTER (doc_id % 4 = 1) > 0"
)
def jon16_alignable(spark, sf):
    folder = F.concat(F.lit("data/"), "lang", F.lit("/"), F.floor(F.col("doc_id") / 12), F.lit("/"))
    n = F.col("doc_id") % 4
    others = F.array(F.lit("__cts__.xml"), F.lit("deep/x-eng1.xml"), F.lit("x-lat3.txt"))
    name = F.when(n == 0, F.array(F.lit("x-lat1.xml"), F.lit("x-lat2.xml"))).when(n == 1, F.array(F.lit("x-eng1.xml"))).otherwise(others)
    paths = table(spark, sf, "documents").select(F.explode(F.transform(name, lambda x: F.concat(folder, x))).alias("path"))
    return catalogs.editions(paths, "lat")


@query(
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a-lat10.xml' WHEN 1 THEN 'b-lat.xml' END AS pick, CASE doc_id % 3 WHEN 0 THEN "
    "'a-lat2.xml' WHEN 1 THEN 'b-lat.xml' END AS compat, doc_id % 2 = 0 AS english FROM documents"
)
def met01_edition(spark, sf):
    d = F.col("doc_id")
    names = F.when(
        d % 3 == 0, F.array(F.lit("a-lat2.xml"), F.lit("a-lat10.xml"), F.lit("a-lat9.txt"))
    ).when(d % 3 == 1, F.array(F.lit("b-lat.xml"))).otherwise(F.array(F.lit("c-grc1.xml")))
    names = F.when(d % 2 == 0, F.concat(names, F.array(F.lit("z-eng2.xml")))).otherwise(names)
    return table(spark, sf, "documents").select(
        "doc_id",
        catalogs.edition(names, "lat").alias("pick"),
        catalogs.edition(names, "lat", True).alias("compat"),
        catalogs.has_english(names).alias("english"),
    )


@query(
    "SELECT doc_id, CASE WHEN doc_id % 15 - 2 <= 6 AND doc_id % 15 <> 2 THEN 'late_antique' ELSE 'medieval' END AS stage, CASE doc_id "
    "% 3 WHEN 0 THEN 'late_antique' ELSE 'classical' END AS era FROM documents"
)
def met07_stage_and_era(spark, sf):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("data/Vulgate-"), "source")).when(F.col("doc_id") % 3 == 1, F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", catalogs.stage_of_century(F.col("doc_id") % 15 - 2).alias("stage"), catalogs.era_of_file(name).alias("era")
    )


@query(
    "WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS nxt FROM conversations) "
    "SELECT trim(text) AS src, trim(nxt) AS tgt, CAST(conv_id AS VARCHAR) AS citation, 'la' AS src_lang, CASE WHEN conv_id % 3 = 0 "
    "THEN 'late_antique' ELSE 'classical' END AS era, 'grosenthal:' || CASE WHEN conv_id % 3 = 0 THEN 'jerome' ELSE 'caesar' END || "
    "conv_id AS source FROM c WHERE turn % 2 = 0 AND trim(coalesce(nxt, '')) <> '' AND trim(text) <> ''"
)
def src30_external_pairs(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").withColumn("en", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    name = F.when(
        F.col("conv_id") % 3 == 0, F.concat(F.lit("data\\x/Jerome"), "conv_id", F.lit(".json"))
    ).otherwise(F.concat(F.lit("y\\caesar"), "conv_id", F.lit(".json")))
    rows = c.select(
        F.when(F.col("turn") % 2 == 0, "train").otherwise("valid").alias("split"),
        F.col("conv_id").alias("id"),
        name.alias("file"),
        F.concat(F.lit(" "), "text").alias("la"),
        "en",
    )
    return catalogs.external_pairs(rows, ["train"]).withColumn("source", F.lower("source"))


@query(
    "SELECT doc_id, 'https://digi.vatlib.it/iiif/MSS_Vat.lat.' || doc_id || '/manifest.json' AS vatican, "
    "'https://iiif.bodleian.ox.ac.uk/iiif/manifest/MS__Laud_Misc__' || doc_id || '%26x.json' AS bodleian, "
    "'https://gallica.bnf.fr/iiif/ark:/12148/b' || doc_id || '/manifest.json' AS bnf, "
    "'https://www.e-codices.unifr.ch/metadata/iiif/csg-' || doc_id || '/manifest.json' AS ecodices FROM documents"
)
def src34_manifest_urls(spark, sf):
    d = F.col("doc_id")
    own = {
        "vatican": (F.concat(F.lit(" Vat.lat "), d),),
        "bodleian": (F.concat(F.lit("MS. Laud Misc. "), d, F.lit("&x")),),
        "bnf": (F.concat(F.lit("ark:/12148/b"), d),),
        "ecodices": (F.lit("csg"), d.cast("string")),
    }
    return table(spark, sf, "documents").select("doc_id", *[catalogs.manifest_url(k, *v).alias(k) for k, v in own.items()])


# image manifests: version 2 for even sources, 3 for odd; an image for each document of the source
@query(
    "SELECT source AS id, CAST(n AS INT) AS index, CASE WHEN doc_id % 4 <> 1 THEN 'https://img.org/' || doc_id || "
    "'/full/full/0/default.jpg' ELSE 'https://img.org/direct/' || doc_id || '.jpg' END AS url, 'image/jpeg' AS format FROM (SELECT "
    "source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n >= 3 AND n < 30"
)
def jsn01_iiif_images(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    service = lambda x, key: F.when(x % 4 != 1, F.concat(F.lit(f'{{"{key}": "https://img.org/'), x, F.lit('/"}')))
    direct = lambda x: F.concat(F.lit("https://img.org/direct/"), x, F.lit(".jpg"))
    two = lambda x: F.concat(
        F.lit('{"images": [{"resource": {"@id": "'),
        direct(x),
        F.lit('", "format": "image/jpeg"'),
        F.coalesce(F.concat(F.lit(', "service": '), service(x, "@id")), F.lit("")),
        F.lit("}}]}"),
    )
    three = lambda x: F.concat(
        F.lit('{"items": [{"items": [{"body": {"id": "'),
        direct(x),
        F.lit('", "format": "image/jpeg"'),
        F.coalesce(F.concat(F.lit(', "service": ['), service(x, "id"), F.lit("]")), F.lit("")),
        F.lit("}}]}]}"),
    )
    v2 = F.concat(F.lit('{"sequences": [{"canvases": ['), F.array_join(F.transform("ids", two), ", "), F.lit("]}]}"))
    v3 = F.concat(F.lit('{"items": ['), F.array_join(F.transform("ids", three), ", "), F.lit("]}"))
    manifests = d.select("id", F.when(F.substring("id", 4, 9).cast("int") % 2 == 0, v2).otherwise(v3).alias("manifest"))
    return parse.iiif_urls(parse.iiif_images(manifests, start=3, most=27)).select("id", "index", "url", "format")


@query(
    "SELECT source AS id, CAST(n AS INT) AS pos, doc_id AS werk, 'Vita ' || doc_id AS title, 'vita ' || doc_id AS sort_title FROM "
    "(SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) FILTER (doc_id % 7 <> 0) OVER "
    "(PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE doc_id % 7 <> 0 AND k <= 25"
)
def jsn04_repertory_rows(spark, sf):
    d = table(spark, sf, "documents")
    link = F.when(
        F.col("doc_id") % 7 != 0,
        F.concat(F.lit("<a href='/werk/"), "doc_id", F.lit("'><cite> <b>Vita</b> "), "doc_id", F.lit("</cite></a>")),
    ).otherwise("none")
    cell = F.struct(
        F.struct(link.alias("_"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("VITA "), "doc_id")).otherwise("").alias("s")).alias("1")
    )
    rows = d.groupBy(F.col("source").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", cell.alias("c")))), lambda x: x["c"]).alias("data")
    )
    return catalogs.repertory_rows(rows.select("id", F.to_json(F.struct("data")).alias("payload")))


@query(
    "SELECT source AS id, CAST(n AS INT) AS pos, 'Q' || doc_id AS qid, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Label ' || doc_id END AS "
    "label, '' AS description FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM "
    "documents)"
)
def jsn04_entities(spark, sf):
    hit = F.struct(
        F.concat(F.lit("Q"), "doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Label "), "doc_id")).alias("label")
    )
    rows = table(spark, sf, "documents").groupBy(F.col("source").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", hit.alias("h")))), lambda x: x["h"]).alias("search")
    )
    return catalogs.entity_rows(rows.select("id", F.to_json(F.struct("search")).alias("payload")))


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Englisch (Auswahl),Deutsch' WHEN 2 THEN 'Deutsch' ELSE '' END AS "
    "languages, CASE WHEN doc_id % 4 = 1 THEN 'translated' ELSE 'untranslated' END AS status, CASE doc_id % 4 WHEN 1 THEN "
    "'untranslated' WHEN 2 THEN 'untranslated' ELSE 'unknown' END AS by_editions FROM documents"
)
def htm02_translations(spark, sf):
    n = F.col("doc_id") % 4
    body = F.when(
        n == 1, "<h2 id=u>Übersetzungen</h2><h3><i>Englisch</i> (Auswahl)</h3><p>x</p><h3> Deutsch </h3><h3></h3>"
    ).when(n == 2, "<h2>Uebersetzung</h2><h3>Deutsch</h3>").when(n == 3, "<h2>Übersetzungen</h2>").otherwise("")
    html = F.concat(F.lit("<h2>Editionen</h2><h3>Englisch</h3>"), body, F.lit("<h2>Literatur</h2><h3>Englisch</h3>"))
    d = table(spark, sf, "documents").select("doc_id", catalogs.translations_listed(html).alias("l"))
    return d.select(
        "doc_id",
        F.array_join("l", ",").alias("languages"),
        catalogs.repertory_status(F.col("l")).alias("status"),
        catalogs.edition_status(F.col("l")).alias("by_editions"),
    )


@query("SELECT doc_id AS page FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def src36_pages_to_read(spark, sf):
    return catalogs.pages_to_read(
        table(spark, sf, "documents").select(F.col("doc_id").alias("page")),
        table(spark, sf, "labels").select(F.col("doc_id").alias("page"), F.lit("x").alias("text")),
    )


@query(
    "SELECT doc_id, 'Author' AS author, 'T' AS title, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents WHERE "
    "trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"
)
def src12_corpus_text(spark, sf):
    # nested divisions must not repeat their text
    xml = F.concat(
        F.lit("<cc><author> Author </author><name>T</name><body><div><div>"), X.escape_html("text"), F.lit("</div></div></body></cc>")
    )
    d = table(spark, sf, "documents").select("doc_id", parse.corpus_parts(xml).alias("x")).select("doc_id", "x.*")
    return d.where("text <> ''").withColumn("text", F.col("text"))


@query(
    "SELECT source AS id, CAST(n AS INT) AS pos, CAST(doc_id AS VARCHAR) AS idno, CASE WHEN doc_id % 2 = 0 THEN 'Corpus ' || doc_id "
    "ELSE CAST(doc_id AS VARCHAR) END AS name FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 "
    "AS n FROM documents)"
)
def src13_corpora(spark, sf):
    one = F.concat(
        F.lit("<corpus><idno>"),
        "doc_id",
        F.lit("</idno>"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<name> Corpus "), "doc_id", F.lit(" </name>"))).otherwise(""),
        F.lit("</corpus>"),
    )
    xml = F.concat(
        F.lit("<r>"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("c")))), lambda x: x["c"]), ""),
        F.lit("<corpus><name>no number</name></corpus></r>"),
    )
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("id")).agg(xml.alias("xml"))
    return d.select("id", F.posexplode(parse.corpora_listed("xml")).alias("pos", "c")).select("id", "pos", "c.*")


@query(
    r"SELECT doc_id, 'W' || doc_id AS work, 'C' || ord AS chapter, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM (SELECT "
    r"doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents) "
    r"WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''"
)
def src28_thml_chapters(spark, sf):
    chapters = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(F.lit('<div3 title="C'), i, F.lit('"><p>'), X.escape_html(x), F.lit("<note>n</note></p></div3>")),
    )
    xml = F.concat(F.lit('<ThML><div1><div2 title="W'), "doc_id", F.lit('">'), F.array_join(chapters, ""), F.lit("</div2></div1></ThML>"))
    return table(spark, sf, "documents").select("doc_id", F.explode(parse.thml_parts(xml)).alias("c")).select("doc_id", "c.*")


def _page_files(pages, path):
    """Writes a file for each page (page_id, html) and returns the folders, one for each task; what failed attempts left is in none of them.

    Spark's own writer makes a folder for each value, and its driver moves every one of them, one after the other.
    """

    def run(batches):
        files, root = sink.place(path)
        own, names, folder = f"{root}/{uuid.uuid4().hex}", set(), -1
        for batch in batches:
            for number, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if folder < 0 or len(names) == 1000 or number in names:
                    folder, names = folder + 1, set()
                    files.create_dir(f"{own}/{folder}", recursive=True)
                names.add(number)
                with files.open_output_stream(f"{own}/{folder}/page{number}.txt") as out:
                    out.write((html or b"") + b"\n")  # Spark reads no empty files
        if folder >= 0:
            yield pa.record_batch([pa.array([own.removeprefix(root)])], ["folder"])

    written = pages.select("page_id", F.col("html").cast("binary")).mapInArrow(run, "folder string")
    return [f"{path}{r['folder']}" for r in written.collect()]


@query("SELECT page_id, 'page' || page_id AS title, html AS text FROM pages")
def src01_files(spark, sf):
    folders = _page_files(table(spark, sf, "pages"), fresh(spark, "files"))
    found = parse.files(spark, folders, limit=None)
    return found.select(
        F.substring("title", 5, 20).cast("long").alias("page_id"), "title", F.regexp_replace("text", r"\n\z", "").alias("text")
    )


# shards of 50 pages each, behind a service that fails every third call, is full every fifth, and has entries without an object
class _Shaky:
    def __init__(self, entries):
        self.entries, self.calls = entries, 0

    def __call__(self, request):
        self.calls += 1
        if self.calls % 3 == 0:
            raise ConnectionError("every third call")
        if self.calls % 5 == 0:
            return connector.Answer(429, None, {"Retry-After": "0"})
        start, size = request["start"], request["size"]
        return connector.Answer(200, {"data": self.entries[start : start + size], "recordsFiltered": len(self.entries)})


def _shard(row):
    entries = [{"obj": {"identifier": e["url"], "year": e["year"], "html": e["html"]}} if e["there"] else {} for e in row["entries"]]
    return connector.Pager(_Shaky(entries), connector.inscriptions_page, size=7, limit=40, delay=0, wait=0)


@query(
    "SELECT shard, CAST(pos AS INT) AS pos, url AS identifier, CAST(page_id % 700 AS INT) AS year, md5(html) AS digest FROM (SELECT *, page_id // 50 AS shard, "
    "row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS pos FROM pages WHERE page_id % 9 <> 4) WHERE pos < 40"
)
def src18_paged(spark, sf):
    n = F.col("page_id")
    entry = F.struct("page_id", "url", "html", (n % 700).cast("int").alias("year"), (n % 9 != 4).alias("there"))
    requests = table(spark, sf, "pages").groupBy(F.floor(n / 50).alias("shard")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    rows = connector.fetched(requests.withColumn("request", F.lit("{}")), "shard", _shard)
    html = F.get_json_object("payload", "$.html")
    return rows.select("shard", "pos", "identifier", "year", F.md5(html.cast("binary")).alias("digest"))
