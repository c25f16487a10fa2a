"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window's shingles are its runs of Q words (2 or 1 in windows of 2, 3 or 1 words). They are ordered by rarity, their
count over all documents, and each window joins on its rarest shingle only, its necessary prefix: a window that occurs
has all its shingles in the document, so one whose rarest shingle occurs nowhere is left out. The place of the prefix in
the window and the lengths bound the start; the window is then verified there word for word, on the words themselves.

So there are two narrow passes over the texts, whatever the items' lengths: one counts the benchmark's shingles, the
other finds the prefixes, each with as many words around it as its windows reach. Shingles stand in the plan as a hash
set while there are at most LITERALS of them. Beyond that documents' shingles are exploded and joined with them as
tables, and the windows are verified in the texts that have candidates.

Null or wordless texts have no words and are never contaminated; null or wordless items have no windows; a null item_id
counts as the empty string. Repeated rows get the same result each, repeated items count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sha256_hex

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what is between words, before A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, Q = 13, 4
LITERALS = 60_000


def words(text: str = "text") -> Column:
    """The words, A-Z not yet lower-cased."""
    return F.array_remove(F.split(F.col(text), BREAK, -1), "")


def lowered(word: Column) -> Column:
    """A word with A-Z lower-cased: lower() does no more to ASCII words and is much faster."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: the optimizer would repeat it wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pair(a: Column, shift: int) -> Column:
    """Hashes of the run at each place together with the run `shift` places on; the last `shift` places are no runs."""
    return F.zip_with(a, F.slice(a, F.lit(1 + shift), F.size(a)), lambda x, y: F.xxhash64(x, y))


def runs(w: Column, sizes: list[int]) -> Column:
    """A struct of arrays run_m, for each m of sizes, with the hash of the m words from each place of the word array."""

    def grow(h: dict[int, Column], p: int) -> Column:
        if 2 * p <= max(sizes):
            return let(_pair(h[p], p), lambda x: grow(h | {2 * p: x}, 2 * p))
        low = {m: 1 << (m.bit_length() - 1) for m in sizes}
        return F.struct(*[(h[m] if m in h else _pair(h[low[m]], m - low[m])).alias(f"run_{m}") for m in sizes])

    return let(F.transform(w, lambda x: F.xxhash64(lowered(x))), lambda h1: grow({1: h1}, 1))


def item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, q, size, win, shingles) of the distinct windows, and (wid, item_id)."""
    own = F.transform(words(), lowered)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), own.alias("words")
    ).where("size(words) > 0").distinct()
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))
    each = items.select("item_id", "words", "size", starts.alias("at")).select(
        "item_id", "size", F.slice("words", F.col("at") + 1, F.col("size")).alias("win")
    )
    each = materialize(each.distinct(), "item-windows")
    q = F.when(F.col("size") >= Q, Q).when(F.col("size") >= 2, 2).otherwise(1)
    r = runs(F.col("win"), [1, 2, Q])
    held = let(
        r,
        lambda r: F.slice(
            F.when(F.col("q") == Q, r[f"run_{Q}"]).when(F.col("q") == 2, r["run_2"]).otherwise(r["run_1"]),
            F.lit(1),
            F.col("size") - F.col("q") + 1,
        ),
    )
    distinct = each.select("size", "win").distinct().withColumn("q", q).select(
        F.monotonically_increasing_id().alias("wid"), "q", "size", "win", held.alias("shingles")
    )
    windows = materialize(distinct, "windows")
    return windows, materialize(each.join(windows.select("wid", "win"), "win").select("wid", "item_id"), "owners")


def _listed(shingles: DataFrame) -> dict[int, str]:
    """The shingles of each q as SQL literals; at most LITERALS come to the driver."""
    found: dict[int, list[str]] = {}
    for r in shingles.collect():
        found.setdefault(r["q"], []).append(f"{r['shingle']}L")
    return {q: ",".join(x) for q, x in sorted(found.items())}


def _prefixes(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """(wid, size, win, q, offset, shingle): the rarest shingle of each window, if all of its shingles occur."""
    kinds = windows.select("wid", "q", F.posexplode("shingles").alias("offset", "shingle")).join(rarity, ["q", "shingle"], "left")
    ranked = kinds.groupBy("wid", "q").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("p")
    ).where("p.n > 0")
    return materialize(ranked.select("wid", "q", "p.offset", "p.shingle").join(windows.select("wid", "size", "win"), "wid"), "prefixes")


def _counted(docs: DataFrame, listed: dict[int, str]) -> DataFrame:
    """(q, shingle, n): occurrences of the listed shingles over all documents."""

    def present(q: int, x: str) -> Column:
        here = F.expr(f"filter(slice(r.run_{q}, 1, greatest(size(r.run_{q}) - {q - 1}, 0)), x -> x in ({x}))")
        return F.transform(here, lambda s: F.struct(F.lit(q).alias("q"), s.alias("shingle")))

    hashed = docs.select(runs(words(), list(listed)).alias("r"))
    return materialize(
        hashed.select(
            F.explode(F.concat(*[present(q, x) for q, x in listed.items()])).alias("h")
        ).groupBy("h.q", "h.shingle").agg(F.count("*").alias("n")),
        "rarity",
    )


def _hits(docs: DataFrame, listed: dict[int, str], reach: dict[int, int]) -> DataFrame:
    """(doc_id, text_hash, n_words, hits): the places of listed shingles, with the words around them."""

    def places(q: int, x: str) -> Column:
        at = f"filter(transform(r.run_{q}, (x, i) -> if(x in ({x}), i, null)), i -> i is not null and i + {q} <= size(w))"
        first = f"greatest(i - {reach[q]}, 0)"
        context = f"slice(w, {first} + 1, {2 * reach[q] + q})"
        return F.expr(f"transform({at}, i -> struct({q} as q, i as pos, get(r.run_{q}, i) as shingle, {first} as from, {context} as context))")

    both = docs.select("doc_id", "text_hash", words().alias("w")).select("doc_id", "text_hash", "w", runs(F.col("w"), list(listed)).alias("r"))
    hits = F.concat(*[places(q, x) for q, x in listed.items()])
    lower = lambda h: F.struct(
        h["q"].alias("q"),
        h["pos"].alias("pos"),
        h["shingle"].alias("shingle"),
        h["from"].alias("from"),
        F.transform(h["context"], lowered).alias("context"),
    )
    return materialize(both.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.transform(hits, lower).alias("hits")), "hits")


def _found_in_place(docs: DataFrame, windows: DataFrame, listed: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_words) of every row, and (doc_id, text_hash, wid, start, size) of the windows in them."""
    reach = {r["q"]: r["most"] - r["q"] for r in windows.groupBy("q").agg(F.max("size").alias("most")).collect()}
    prefixes = _prefixes(windows, _counted(docs, listed))
    kept = _hits(docs, _listed(prefixes.select("q", "shingle").distinct()) or {1: "NULL"}, {1: 0} | reach)
    hits = kept.select("doc_id", "text_hash", "n_words", F.explode("hits").alias("h")).select("doc_id", "text_hash", "n_words", "h.*")
    side = F.broadcast(prefixes) if prefixes.count() <= LITERALS else prefixes
    placed = hits.join(side, ["q", "shingle"]).withColumn("start", F.col("pos") - F.col("offset")).where(
        "start >= 0 and start + size <= n_words"
    )
    found = placed.where("slice(context, start - from + 1, size) = win").select("doc_id", "text_hash", "wid", "start", "size").distinct()
    return kept.select("doc_id", "text_hash", "n_words"), found


def _found_by_tables(docs: DataFrame, windows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same by joins of all shingles."""
    sizes = [r["q"] for r in windows.select("q").distinct().collect()]
    hashed = docs.select(
        "doc_id", "text_hash", let(words(), lambda w: F.struct(F.size(w).alias("n_words"), runs(w, sizes).alias("r"))).alias("x")
    ).select("doc_id", "text_hash", "x.n_words", "x.r")
    hits = None
    for q in sizes:
        whole = F.slice(f"r.run_{q}", F.lit(1), F.greatest(F.col("n_words") - (q - 1), F.lit(0)))
        part = hashed.select(
            "doc_id", "text_hash", "n_words", F.lit(q).alias("q"), F.posexplode(whole).alias("pos", "shingle")
        ).join(known.where(F.col("q") == q).drop("q"), "shingle", "left_semi")
        hits = part if hits is None else hits.unionByName(part)
    hits = materialize(hits.distinct(), "hits")
    prefixes = _prefixes(windows, hits.groupBy("q", "shingle").agg(F.count("*").alias("n")))
    placed = hits.join(prefixes, ["q", "shingle"]).withColumn("start", F.col("pos") - F.col("offset")).where(
        "start >= 0 and start + size <= n_words"
    )
    listed = placed.select(
        "doc_id", "text_hash", F.struct("start", "size", "wid", "win").alias("c")
    ).distinct().groupBy("doc_id", "text_hash").agg(F.collect_list("c").alias("c"))
    on = [F.equal_null(docs["doc_id"], listed["doc_id"]), docs["text_hash"] == listed["text_hash"]]
    there = let(words(), lambda w: F.filter("c", lambda c: F.transform(F.slice(w, c["start"] + 1, c["size"]), lowered) == c["win"]))
    found = docs.join(listed, on).select(
        docs["doc_id"], docs["text_hash"], F.explode(there).alias("c")
    ).select("doc_id", "text_hash", "c.wid", "c.start", "c.size").distinct()
    return docs.select("doc_id", "text_hash", F.size(words()).alias("n_words")), found


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash), null text as empty; doc_id and text_hash stand for the row."""
    return docs.select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text", F.length("text")))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated) of every row."""
    docs = keyed(docs)
    windows, owners = item_windows(benchmark, window)
    known = materialize(windows.select("q", F.explode("shingles").alias("shingle")).distinct(), "shingles")
    n = known.count()
    base, found = _found_in_place(docs, windows, _listed(known)) if 0 < n <= LITERALS else _found_by_tables(docs, windows, known) if n else (
        docs.select("doc_id", "text_hash", F.size(words()).alias("n_words")), None
    )
    if found is None:
        return base.select(
            "doc_id",
            "text_hash",
            F.col("n_words").cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"),
            F.lit(0).cast("long").alias("n_items"),
            F.array().cast("array<string>").alias("items"),
            F.lit(False).alias("contaminated"),
        )
    found = materialize(found.join(owners, "wid").select("doc_id", "text_hash", "item_id", "start", "size"), "found")
    row = Window.partitionBy("doc_id", "text_hash")
    spans = found.groupBy("doc_id", "text_hash", "start").agg(F.max("size").alias("size"))
    before = F.coalesce(
        F.max(F.col("start") + F.col("size")).over(row.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    covered = spans.withColumn(
        "new", F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", before))
    ).groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"))
    listed = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    on = lambda a, b: [F.equal_null(a["doc_id"], b["doc_id"]), a["text_hash"] == b["text_hash"]]
    hit = covered.join(listed, on(covered, listed)).select(covered["doc_id"], covered["text_hash"], "n_hit", "items")
    out = base.join(hit, on(base, hit), "left").select(
        base["doc_id"],
        base["text_hash"],
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return out.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", bad.alias("contaminated")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    return judged(docs, benchmark, window, percent).select(
        "doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.concat_ws(",", "items")).alias("items_sha256"), "contaminated"
    )
