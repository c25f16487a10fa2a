"""Discovery: listings, catalogues and search answers as DataFrame operators (SRC-*, MET-*, JSN-*, HTM-02).

Each takes fetched payloads (id, payload), in any number, and returns rows in the order of the payload; nothing here opens
a connection. Payloads that are null or do not parse give no rows. Limits are features of a discovery request, per payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .parse import unescape_each

# fixed values: names of collections, queries that mean everything, links that are no works
CAMENA = ["cera", "historicapolitica", "poemata", "thesaurus"]
EVERYTHING = ["all", "", "openmgh", "editions", "catalogue", "catalogo", "canone", "pg"]
NAVIGATION = r"(?i)(index|classics|medieval|christian|misc|imperial|neo|ecclesiastic)\.html$"
WORK_PAGE = r"(?i)^[a-z]{2,4}\d+[a-z]?\.html$"
CANON_PAGE = 16
ALIM = "14009"
ENGLISH = ["englisch"]
# fixed values: known manuscripts (shelfmark, title)
VATICAN = [
    ("Vat.lat.3225", "Vergilius Vaticanus (5th c.)"),
    ("Vat.lat.3867", "Vergilius Romanus (5th c.)"),
    ("Vat.lat.3773", "Opera Vergilii"),
    ("Pal.lat.1631", "Lorsch Gospels"),
    ("Reg.lat.316", "Gelasian Sacramentary"),
]
# fixed values: where a book's text may be
GUTENBERG = [
    "https://www.gutenberg.org/cache/epub/{n}/pg{n}.txt",
    "https://www.gutenberg.org/files/{n}/{n}-0.txt",
    "https://www.gutenberg.org/files/{n}/{n}.txt",
]
# fixed values: the columns that the inscription service asks for
EDCS_COLUMNS = ["obj.edcs-id", "", "obj.inschriften", "obj.material", "obj.datierung", "obj.anzahl_bilder"]
EDCS_PAGE = 100


def first_seen(rows: DataFrame, key: list[str], value: str, pos: str = "pos") -> DataFrame:
    """AGG-18: the distinct values of each key with the place where each was first seen."""
    return rows.groupBy(*key, value).agg(F.min(pos).alias(pos))


def limited(rows: DataFrame, key: list[str], limit: int | None, pos: str = "pos") -> DataFrame:
    """TOP-06: the first `limit` rows of each key by place; all of them without a limit."""
    if limit is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(pos))).where(F.col("_n") <= limit).drop("_n")


def listing(payloads: DataFrame, kind: str) -> DataFrame:
    """JSN-05: (id, pos, name) of the entries of one type in directory listings, JSON arrays of {name, type}."""
    entries = F.from_json("payload", "array<struct<name:string,type:string>>")
    return payloads.select(
        "id", F.posexplode(entries).alias("pos", "e")
    ).where(F.col("e.type") == kind).select("id", "pos", F.col("e.name").alias("name"))


def matches(column: str, query: str) -> Column:
    """A case-insensitive part of the column, or everything."""
    q = query.strip().lower()
    return F.lit(True) if q in EVERYTHING else F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(q))


def work_dirs(payloads: DataFrame, limit: int | None = 50) -> DataFrame:
    """SRC-09, MET-03: (id, pos, identifier) group.work of the work folders of text groups; id is the group."""
    found = listing(payloads, "dir").select("id", "pos", F.concat_ws(".", "id", "name").alias("identifier"))
    return limited(found, ["id"], limit)


def volumes(payloads: DataFrame, query: str = "all", limit: int | None = 200) -> DataFrame:
    """SRC-22: (id, name) of volume folders, sorted by name."""
    named = listing(payloads, "dir").where(F.col("name").rlike(r"^PG\d+(_\d+)?$") & matches("name", query))
    return limited(named.select("id", "name"), ["id"], limit, "name")


def xml_stems(payloads: DataFrame, query: str = "all", limit: int | None = 200) -> DataFrame:
    """SRC-25: (id, pos, stem) of the XML files of flat folders whose name has the query."""
    found = listing(payloads, "file").where(F.endswith("name", F.lit(".xml"))).withColumn("stem", F.regexp_replace("name", r"\.xml$", ""))
    return limited(found.where(matches("stem", query)).select("id", "pos", "stem"), ["id"], limit)


def camena_request(query: str) -> tuple[list[str], str]:
    """SRC-26: collections and part of the name that a query means: a collection, collection:part, or all."""
    name, _, part = query.strip().lower().partition(":")
    wanted = list(CAMENA) if name in ("all", "") else [name]
    if not set(wanted) <= set(CAMENA):
        raise ValueError(f"no such collection: {name}; one of {', '.join(CAMENA)}")
    return wanted, part


def camena_ids(payloads: DataFrame, query: str = "all", limit: int | None = 200) -> DataFrame:
    """SRC-26: (identifier) collection/stem in the order of the collections; payloads are listings by collection."""
    wanted, part = camena_request(query)
    found = xml_stems(payloads.where(F.col("id").isin(wanted)), part or "all", None)
    order = F.array_position(F.array(*map(F.lit, CAMENA)), F.col("id"))
    rows = found.select(F.concat_ws("/", "id", "stem").alias("identifier"), order.alias("rank"), "pos").orderBy("rank", "pos")
    return (rows if limit is None else rows.limit(limit)).select("identifier")


def edition(files: Column | str, tag: str, compat: bool = False) -> Column:
    """MET-01, WIN-11: the last edition -tagN.xml of an array of names, by number; compat: by name."""
    found = F.filter(X.col(files), lambda f: f.rlike(rf"-{tag}\d*\.xml$"))
    if compat:
        return F.array_max(found)
    number = lambda f: F.coalesce(F.nullif(F.regexp_extract(f, rf"-{tag}(\d*)\.xml$", 1), F.lit("")), F.lit("0")).cast("long")
    return F.array_max(F.transform(found, lambda f: F.struct(number(f).alias("n"), f.alias("name"))))["name"]


def has_english(files: Column | str) -> Column:
    """MET-02: an English edition stands beside."""
    return F.exists(X.col(files), lambda f: f.rlike(r"-eng\d*\.xml$"))


def editions(trees: DataFrame, source: str, target: str = "eng", compat: bool = False) -> DataFrame:
    """JON-16: (work, src, tgt) of works data/group/work/file.xml (path) that hold both editions."""
    parts = F.split("path", "/")
    files = trees.where(F.endswith("path", F.lit(".xml")) & (F.size(parts) == 4) & (parts[0] == "data"))
    by = files.groupBy(F.concat_ws(".", parts[1], parts[2]).alias("work")).agg(F.collect_set(parts[3]).alias("files"))
    both = by.select("work", edition("files", source, compat).alias("src"), edition("files", target, compat).alias("tgt"))
    return both.where("src is not null and tgt is not null")


def wiki_request(query: str, limit: int = 50) -> dict[str, str]:
    """SRC-07: the parameters of a listing of a category, or of a search."""
    size = str(min(limit, 500))
    if query.startswith(("Categoria:", "Category:")):
        own = {"list": "categorymembers", "cmtitle": query, "cmlimit": size, "cmtype": "page"}
    else:
        own = {"list": "search", "srsearch": query, "srlimit": size, "srnamespace": "0"}
    return {"action": "query", "format": "json"} | own


def wiki_titles(payloads: DataFrame) -> DataFrame:
    """SRC-07: (id, pos, title) of category members or search hits."""
    hit = "array<struct<title:string>>"
    q = F.from_json("payload", f"struct<query:struct<categorymembers:{hit},search:{hit}>>")["query"]
    return payloads.select(
        "id", F.posexplode(F.coalesce(q["categorymembers"], q["search"])).alias("pos", "h")
    ).select("id", "pos", F.col("h.title").alias("title"))


def canon_pages(base: str, limit: int) -> list[str]:
    """SRC-11: the addresses of the catalogue's pages for that many works."""
    return [f"{base}/canone?l={CANON_PAGE}&o={at}" for at in range(0, max(limit, CANON_PAGE) + CANON_PAGE, CANON_PAGE)]


def dlt_ids(payloads: DataFrame, limit: int | None = 50) -> DataFrame:
    """SRC-10, SRC-11: (idno) distinct work numbers in the order of pages (id: the page's number) and places."""
    found = payloads.select("id", F.posexplode(F.regexp_extract_all("payload", F.lit(r"/idno/(DLT\d+)"), F.lit(1))).alias("at", "idno"))
    first = found.groupBy("idno").agg(F.min(F.struct("id", "at")).alias("pos")).orderBy("pos")
    return (first if limit is None else first.limit(limit)).select("idno")


def dlt_id(c: Column | str) -> Column:
    """STR-38: the work number in an identifier or address, else null."""
    return F.nullif(F.upper(F.regexp_extract(X.col(c), r"(?i)(DLT\d+)", 1)), F.lit(""))


def mgh_catalogue(payloads: DataFrame) -> DataFrame:
    """SRC-20: (bsb, title, pos) of an index page's volumes; of equal numbers the first title."""
    link = r'(?s)<a[^>]+href="https://data\.mgh\.de/openmgh/bsb\d+\.zip"[^>]*>.*?</a>'
    rows = payloads.select("id", F.posexplode(F.regexp_extract_all("payload", F.lit(link), F.lit(0))).alias("at", "a"))
    title = X.collapse(F.regexp_replace(F.regexp_replace("a", "(?s)^<a[^>]*>", ""), "(?s)<[^>]+>", " "))
    named = rows.select(F.regexp_extract("a", r"(bsb\d+)\.zip", 1).alias("bsb"), title.alias("title"), F.struct("id", "at").alias("pos"))
    return named.groupBy("bsb").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))


def mgh_discover(payloads: DataFrame, query: str = "all", limit: int | None = 200) -> DataFrame:
    """SRC-20: (bsb) of the volumes whose title has the query."""
    found = mgh_catalogue(payloads).where(matches("title", query)).orderBy("pos")
    return (found if limit is None else found.limit(limit)).select("bsb")


def bsb_id(c: Column | str) -> Column:
    """STR-38: a volume number from an identifier, address or bare digits, else null."""
    s = X.strip(X.col(c))
    named = F.nullif(F.lower(F.regexp_extract(s, r"(?i)(bsb\d+)", 1)), F.lit(""))
    digits = F.regexp_replace(s, r"^0+(?=\d)", "")
    return F.coalesce(
        named, F.when(s.rlike(r"^\d+$"), F.concat(F.lit("bsb"), F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), F.lit("0"))))
    )


def manifest(payloads: DataFrame) -> DataFrame:
    """SRC-24: (code, author, dates, century, title, pos) of crawled manifests, the first entry of each code."""
    entry = "array<struct<code:string,author:string,dates:string,century:int,title:string>>"
    rows = payloads.select("id", F.posexplode(F.from_json("payload", entry)).alias("at", "e")).where("e.code is not null")
    first = rows.groupBy("e.code").agg(F.min_by("e", F.struct("id", "at")).alias("e"), F.min(F.struct("id", "at")).alias("pos"))
    return first.select("e.*", "pos")


def manifest_query(entries: DataFrame, query: str = "all", limit: int | None = 1000) -> DataFrame:
    """SRC-24, FLT-08: (code) of the entries of all, of a century cNN, or with the query in author or title."""
    q = query.strip().lower()
    if q.startswith("c") and q[1:].isdigit() and len(q) in (2, 3):
        entries = entries.where(F.col("century") == int(q[1:]))
    elif q not in EVERYTHING:
        entries = entries.where(
            F.contains(F.lower(F.concat(F.coalesce("author", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))), F.lit(q))
        )
    entries = entries.orderBy("pos")
    return (entries if limit is None else entries.limit(limit)).select("code")


def crawled(works: DataFrame, max_year: int) -> DataFrame:
    """SRC-35, FLT-08: (code, author, dates, century, title) of crawled links (pos, href, author, dates, title).

    Only authors whose earliest century is at most max_year // 100 stay, one work for each code; untitled works are carmina.
    """
    rows = works.withColumn("century", X.earliest_century("dates")).where(F.col("century") <= max_year // 100)
    rows = rows.withColumn("code", F.regexp_extract("href", r"codice/(.+)$", 1)).where("code <> ''")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("carmina"))
    return rows.groupBy("code").agg(
        F.min_by(F.struct("author", "dates", "century", title.alias("title")), "pos").alias("e")
    ).select("code", "e.*")


def archive_query(query: str) -> str:
    """SRC-27: a query without a field is a title."""
    q = query.strip()
    return q if ":" in q else f'title:"{q}"'


def archive_ids(payloads: DataFrame, limit: int | None = 100) -> DataFrame:
    """SRC-27: (id, pos, identifier) distinct identifiers of search answers."""
    docs = F.from_json("payload", "struct<response:struct<docs:array<struct<identifier:string>>>>")["response"]["docs"]
    rows = payloads.select("id", F.posexplode(docs).alias("pos", "d")).select("id", "pos", F.col("d.identifier").alias("identifier"))
    return limited(first_seen(rows.where("identifier <> ''"), ["id"], "identifier"), ["id"], limit)


def page_links(pages: DataFrame, host: str, kind: str = "works", limit: int | None = 50) -> DataFrame:
    """SRC-05, SRC-17: (page_id, pos, link) distinct links of index pages (page_id, url, html) to this host.

    kind "works": .html pages but navigation and the page itself. kind "numbered": pages named like work numbers, resolved
    against the host.
    """
    pattern = r"(?i)href\s*=\s*[\"']([^\"']+)[\"']" if kind == "works" else r"(?i)href\s*=\s*[\"']?([^\"' >]+)"
    rows = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("pos", "href"))
    base = F.col("url") if kind == "works" else F.lit(f"https://{host}/")
    rows = rows.withColumn("link", resolved(base, F.col("href"))).where(F.lower(F.parse_url("link", F.lit("HOST"))) == host.lower())
    if kind == "works":
        bare = lambda c: F.regexp_replace(c, "/+$", "")
        rows = rows.where(F.lower("href").endswith(".html") & ~F.col("link").rlike(NAVIGATION) & (bare("link") != bare("url")))
    else:
        rows = rows.where(F.regexp_extract("href", "([^/]*)$", 1).rlike(WORK_PAGE))
    return limited(first_seen(rows, ["page_id"], "link"), ["page_id"], limit)


def resolved(base: Column, href: Column) -> Column:
    """An address from a link of a page: absolute, from the scheme, from the root, or from the folder, without dot segments."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "[^/]*$", "")
    folder = F.when(F.length(folder) <= F.length(origin), F.concat(origin, F.lit("/"))).otherwise(folder)
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(folder, href))
    )
    whole = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)(/[^?#]*)(.*)$"
    step = F.split(F.substring(F.regexp_extract(joined, whole, 2), 2, 1 << 30), "/")
    last = F.element_at(step, -1)
    step = F.when(last.isin(".", ".."), F.array_append(step, "")).otherwise(step)  # a folder
    start = F.array().cast("array<string>")
    # a folder and the way back out of it; there is no way out of the root
    way = F.aggregate(
        step, start, lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    )
    plain = F.concat(F.regexp_extract(joined, whole, 1), F.lit("/"), F.array_join(way, "/"), F.regexp_extract(joined, whole, 3))
    return F.when(joined.rlike(whole), plain).otherwise(joined)


def edcs_filter(query: str) -> dict[str, str]:
    """SRC-18: field=value, else free text."""
    field, found, value = query.partition("=")
    return {field.strip(): value.strip()} if found else {"searchtext1": query}


def edcs_requests(query: str, limit: int, page: int = EDCS_PAGE) -> list[dict[str, str]]:
    """JSN-05: the parameters of each page of a request for `limit` inscriptions; a page is one partition of a source."""
    fixed = {"draw": "1", "order[0][column]": "0", "order[0][dir]": "asc", "search[value]": "", "search[regex]": "false"}
    for i, name in enumerate(EDCS_COLUMNS):
        fixed |= {f"columns[{i}][data]": name, f"columns[{i}][searchable]": "true", f"columns[{i}][orderable]": "true"}
    return [{"start": str(at), "length": str(min(page, limit - at))} | fixed | edcs_filter(query) for at in range(0, limit, page)]


def edcs_segments(payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-18, JSN-02, JSN-03: (id, ord, label, text) of service answers; id is the page's number, one segment each inscription.

    The text is the first of a string, a list or a list of lists, with spaces around slashes; blank ones drop out. The label
    joins number, first citation and place.
    """
    v = F.parse_json("payload")
    rows = payloads.select("id", F.posexplode(F.try_variant_get(v, "$.data", "array<variant>")).alias("at", "d"))
    get = lambda path, kind="string": F.try_variant_get("o", path, kind)
    rows = rows.select("id", "at", F.try_variant_get("d", "$.obj", "variant").alias("o")).where("o is not null")
    raw = F.coalesce(get("$.inschriften[0][0]"), get("$.inschriften[0]"), get("$.inschriften"))
    text = X.collapse(F.replace(raw, F.lit("/"), F.lit(" / ")))
    cite = F.array_join(
        F.filter(F.coalesce(get("$.belege[0]", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), " "
    )
    filled = lambda c: F.nullif(c, F.lit(""))
    place = F.coalesce(filled(get("$.provinz")), filled(get("$.ort")))
    label = F.concat_ws(" · ", F.coalesce(get("$.edcs-id"), F.lit("EDCS-?")), filled(cite), place)
    kept = rows.select("id", "at", label.alias("label"), text.alias("text")).where("text <> '' and text not in ('[]', '{}')")
    numbered = kept.withColumn("ord", F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1).select("id", "ord", "label", "text")
    return numbered if limit is None else numbered.orderBy("id", "ord").limit(limit)


def section_codes(pages: DataFrame) -> DataFrame:
    """SRC-23: (code, ord, section, label) of a work's page (code, html): the options of its section list, else the work itself."""
    listed = F.regexp_extract("html", r'(?s)<select[^>]*name="codice".*?</select>', 0)
    options = F.regexp_extract_all(listed, F.lit(r'(?s)<option[^>]*value="[^"]+"[^>]*>.*?</option>'), F.lit(0))
    values = unescape_each(F.transform(options, lambda o: F.regexp_extract(o, 'value="([^"]+)"', 1)))
    names = unescape_each(F.transform(options, lambda o: F.regexp_replace(o, "(?s)<[^>]+>", " ")))
    rows = pages.withColumn("_values", values).withColumn("_names", names)

    def label(name: Column) -> Column:
        flat = X.collapse(name)
        return F.when(flat.rlike(r"(?U)^\d+$"), F.concat(F.lit("pars "), flat)).when(flat == "", "carmen").otherwise(flat)

    listed = F.zip_with("_values", "_names", lambda v, n: F.struct(X.strip(v).alias("section"), label(n).alias("label")))
    found = F.when(F.size("_values") > 0, listed).otherwise(
        F.array(F.struct(F.col("code").alias("section"), F.lit("carmen").alias("label")))
    )
    return rows.select("code", F.posexplode(found).alias("ord", "s")).select("code", "ord", "s.*")


def verse_lines(html: Column | str) -> Column:
    """STR-24: the verse lines of a page, without tags, blank lines and line numbers."""
    raw = F.regexp_extract_all(X.col(html), F.lit(r'(?s)<p class="c_v">(.*?)</p>'), F.lit(1))
    lines = F.transform(unescape_each(F.transform(raw, lambda t: F.regexp_replace(t, "(?s)<[^>]+>", " "))), X.collapse)
    return F.filter(lines, lambda t: (t != "") & ~t.rlike(r"(?U)^\d+$"))


def verse_parts(works: DataFrame, sections: DataFrame) -> DataFrame:
    """SRC-23: (code, ord, label, text) of works' pages (code, html) and their sections' pages (section, html).

    Sections without lines drop out; a work without any has its own lines as its one part.
    """
    codes = section_codes(works)
    pages = sections.select(F.col("section").alias("_s"), F.col("html").alias("_h"))
    texts = codes.join(pages, codes["section"] == F.col("_s"), "left").join(
        works.select(F.col("code").alias("_c"), F.col("html").alias("_own")), F.col("code") == F.col("_c")
    )
    page = F.coalesce(F.when(F.col("section") == F.col("code"), F.col("_own")), F.col("_h"))
    parts = texts.select("code", "ord", "label", F.array_join(verse_lines(page), "\n").alias("text")).where("text <> ''")
    rest = works.join(parts.select("code").distinct(), "code", "left_anti").select(
        "code", F.lit(0).alias("ord"), F.lit("carmen").alias("label"), F.array_join(verse_lines("html"), "\n").alias("text")
    )
    return parts.unionByName(rest)


def stage_of_century(century: Column | str) -> Column:
    """MET-07."""
    c = X.col(century)
    return F.when((c != 0) & (c <= 6), "late_antique").otherwise("medieval")


def era_of_file(name: Column | str) -> Column:
    """MET-08."""
    return F.when(F.lower(F.coalesce(X.col(name), F.lit(""))).rlike("vulgate|biblia|jerome"), "late_antique").otherwise("classical")


def external_pairs(rows: DataFrame, splits: list[str], source: str = "la", target: str = "en", label: str = "grosenthal") -> DataFrame:
    """SRC-30: pair records of an external data set (split, id, file, source, target), both sides filled."""
    src, tgt = X.strip(F.coalesce(source, F.lit(""))), X.strip(F.coalesce(target, F.lit("")))
    stem = F.regexp_replace(F.regexp_extract(F.coalesce("file", F.lit("")), r"([^\\/]*)$", 1), r"\.json$", "")
    kept = rows.where(F.col("split").isin(splits)).withColumn("src", src).withColumn("tgt", tgt).where("src <> '' and tgt <> ''")
    return kept.select(
        "src", "tgt", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("citation"), F.lit(source).alias("src_lang"),
        era_of_file("file").alias("era"), F.concat(F.lit(f"{label}:"), stem).alias("source"),
    )


def manifest_url(kind: str, *parts: Column) -> Column:
    """SRC-34: addresses of image manifests by library: vatican, bodleian, bnf (one part) and ecodices (collection, manuscript)."""
    first = parts[0]
    if kind == "vatican":
        return F.concat(
            F.lit("https://digi.vatlib.it/iiif/MSS_"), F.replace(X.strip(first), F.lit(" "), F.lit(".")), F.lit("/manifest.json")
        )
    if kind == "bodleian":
        encoded = F.replace(F.replace(F.url_encode(F.translate(first, " .", "__")), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
        return F.concat(F.lit("https://iiif.bodleian.ox.ac.uk/iiif/manifest/"), encoded, F.lit(".json"))
    if kind == "bnf":
        return F.concat(F.lit("https://gallica.bnf.fr/iiif/"), first, F.lit("/manifest.json"))
    if kind == "ecodices":
        return F.concat(F.lit("https://www.e-codices.unifr.ch/metadata/iiif/"), first, F.lit("-"), parts[1], F.lit("/manifest.json"))
    raise KeyError(kind)


def manuscripts(spark, query: str) -> DataFrame:
    """SRC-34: (shelfmark, title) of known manuscripts with the query in either."""
    known = spark.createDataFrame(VATICAN, "shelfmark string, title string")
    low = F.lit(query.lower())
    return known.where(F.contains(F.lower("title"), low) | F.contains(F.lower("shelfmark"), low))


def repertory_rows(payloads: DataFrame, limit: int | None = 25) -> DataFrame:
    """JSN-04: (id, pos, werk, title, sort_title) of search answers whose cells hold a link to a work."""
    cells = F.from_json("payload", "struct<data:array<map<string,string>>>")["data"]
    rows = payloads.select("id", F.posexplode(cells).alias("pos", "r")).select(
        "id", "pos", F.from_json(F.col("r")["1"], "struct<_:string,s:string>").alias("c")
    )
    title = X.strip(F.regexp_replace(F.regexp_extract("c._", "(?s)<cite>(.*?)</cite>", 1), "(?s)<[^>]+>", ""))
    werk = F.regexp_extract("c._", r"/werk/(\d+)", 1)
    named = rows.select(
        "id", "pos", werk.alias("werk"), title.alias("title"), F.lower(F.coalesce(F.nullif("c.s", F.lit("")), title)).alias("sort_title")
    )
    return limited(named.where("werk <> ''").withColumn("werk", F.col("werk").cast("long")), ["id"], limit)


def translations_listed(html: Column | str) -> Column:
    """HTM-02: the languages under the translations heading of a work's page, up to the next heading of its rank."""
    block = F.regexp_extract(X.col(html), r"(?is)<h2[^>]*>[^<]*bersetzung(.*?)(?:<h2[^>]*>|\z)", 1)
    names = F.transform(
        F.regexp_extract_all(block, F.lit(r"(?s)<h3[^>]*>(.*?)</h3>"), F.lit(1)), lambda h: X.strip(F.regexp_replace(h, "(?s)<[^>]+>", ""))
    )
    return F.filter(names, lambda n: n != "")


def repertory_status(languages: Column) -> Column:
    """ENR-03: translated if English is listed, else untranslated, whether others are or none."""
    return F.when(F.exists(languages, lambda x: F.lower(x).rlike("|".join(ENGLISH))), "translated").otherwise("untranslated")


def edition_status(languages: Column) -> Column:
    """ENR-03: as repertory_status, but unknown where no edition is listed."""
    return F.when(
        F.exists(languages, lambda x: F.lower(x) == "english"), "translated"
    ).when(F.size(languages) > 0, "untranslated").otherwise("unknown")


def entity_rows(payloads: DataFrame) -> DataFrame:
    """JSN-04: (id, pos, qid, label, description) of entity search answers."""
    hits = F.from_json("payload", "struct<search:array<struct<id:string,label:string,description:string>>>")["search"]
    rows = payloads.select("id", F.posexplode(hits).alias("pos", "h"))
    return rows.select(
        "id",
        "pos",
        F.col("h.id").alias("qid"),
        F.coalesce("h.label", F.lit("")).alias("label"),
        F.coalesce("h.description", F.lit("")).alias("description"),
    )


def binding_labels(payloads: DataFrame) -> DataFrame:
    """JSN-04: (id, pos, language) of query answers' language labels."""
    b = F.from_json("payload", "struct<results:struct<bindings:array<struct<langLabel:struct<value:string>>>>>")["results"]["bindings"]
    return payloads.select("id", F.posexplode(b).alias("pos", "b")).where("b.langLabel.value is not null").select(
        "id", "pos", F.col("b.langLabel.value").alias("language")
    )


def loeb_rows(payloads: DataFrame, limit: int | None = 25) -> DataFrame:
    """SRC-37: (id, pos, author, title) of search pages."""
    pair = r'(?s)bibliographicAuthorName">.*?</span>.*?workTitle">.*?</span>'
    rows = payloads.select("id", F.posexplode(F.regexp_extract_all("payload", F.lit(pair), F.lit(0))).alias("pos", "x"))
    bare = lambda name: X.strip(F.regexp_replace(F.regexp_extract("x", rf'(?s){name}">(.*?)</span>', 1), "(?s)<[^>]+>", ""))
    return limited(
        rows.select("id", "pos", bare("bibliographicAuthorName").alias("author"), bare("workTitle").alias("title")), ["id"], limit
    )


def gutenberg_urls(number: int | str, tries: int = 3) -> list[str]:
    """SRC-29: the addresses to try for a book, each `tries` times."""
    return [t.format(n=number) for t in GUTENBERG for _ in range(tries)]


def pages_to_read(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """SRC-36, JON-11: the pages that the cache (page, text) does not hold; an OCR adapter reads them."""
    return pages.join(cache.select("page").distinct(), "page", "left_anti")
