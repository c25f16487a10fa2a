"""Stored libraries, discovery, mining, evaluation and styling over goldens, nulls, empty tables and repeated rows."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import evaluation, library, mining, store, tables
from lectern.plans import styling
from lectern.sources import catalogs, parse

WORKS = (
    "source string, title string, author string, century int, language string, verse boolean, parts "
    "array<struct<label:string,text:string>>"
)


def works(spark, rows):
    return spark.createDataFrame(rows, WORKS)


def test_library_round_trip(spark, tmp_path):
    lib = store.Library(spark, str(tmp_path / "lib"))
    assert lib.list_documents().count() == 0 and lib.index_size() == 0 and lib.search([1.0, 0.0]).count() == 0
    first = works(spark, [
        ("a", "T", "Vergil", -1, "la", True, [("I", "arma virumque\n\ncano"), ("II", "")]),
        ("b", "U", None, None, None, False, [("Text", "Cn. Pompeius venit. Abiit (mox).")]),
        ("b", "again", None, None, None, False, [("Text", "x")]), (None, "no source", None, None, None, None, None),
    ])
    assert lib.ingest(first) == 2
    assert lib.ingest(first) == 2  # idempotent
    assert lib.table("sections").count() == 3
    texts = sorted(r["source_text"] for r in lib.table("segments").collect())
    assert texts == ["Abiit (mox).", "Cn. Pompeius venit.", "arma virumque", "cano"]
    assert [r["author"] for r in lib.list_documents().collect()] == [None, "Vergil"]
    doc = lib.list_documents().where("title = 'T'").first()
    nested = lib.get_document(doc["id"]).first()
    assert [(s["label"], len(s["segments"] or [])) for s in nested["sections"]] == [("I", 2), ("II", 0)]
    assert lib.get_document(12345).count() == 0
    cano = lib.table("segments").where("source_text = 'cano'").first()["id"]
    lib.patch(spark.createDataFrame([(cano, "I sing")], "id long, english_text string"), ["english_text"])
    assert lib.get_segment(cano).first()["english_text"] == "I sing"
    embed = lambda df: df.select("id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))
    assert lib.reindex(embed) == 4
    hits = lib.search([4.0, 1.0], 2).orderBy(F.desc("score")).collect()
    assert hits[0]["source_text"] == "cano" and len(hits) == 2 and hits[0]["title"] == "T"
    assert {r["title"] for r in lib.search([4.0, 1.0], 4, only_untranslated=True).collect()} == {"T", "U"}
    assert lib.search([1.0, 1.0], 4, language_stage="medieval").count() == 0


def test_patches_touch_their_buckets_only(spark, tmp_path):
    lib = store.Library(spark, str(tmp_path / "lib"), 8)
    lib.ingest(works(spark, [(f"s{i}", f"T{i}", None, None, "la", True, [("I", f"line {i}\nother {i}"), ("II", "end")]) for i in range(40)]))
    lib.patch(lib.table("segments").select("id", F.lit("done").alias("english_text")), ["english_text"])
    lib.reindex(lambda df: df.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector")))
    files = lambda name: {(f.parent.name, f.name) for f in (tmp_path / "lib" / name).rglob("*.parquet")}
    before = {name: files(name) for name in ("documents", "sections", "segments", "vectors")}
    assert len({b for b, _ in before["segments"]}) == 8
    doc = lib.list_documents().where("title = 'T7'").first()["id"]
    bucket = doc & 7
    for name in ("documents", "sections", "segments"):  # the scan's folders, chosen by the id alone
        plan = lib.table(name, doc)._jdf.queryExecution().executedPlan().toString()
        assert f"(bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and f"= {bucket})" in plan
    ids = [r["id"] for r in lib.segments(doc).collect()]
    assert len(ids) == 3 and {i & 7 for i in ids} == {bucket}
    change = spark.createDataFrame([(ids[0], "new")], "id long, source_text string")
    assert lib.patch_source(change) == [bucket]
    after = {name: files(name) for name in before}
    assert after["documents"] == before["documents"] and after["sections"] == before["sections"]
    for name in ("segments", "vectors"):
        assert {b for b, _ in before[name] ^ after[name]} == {f"bucket={bucket}"}
    row = lib.get_segment(ids[0]).first()
    assert row["source_text"] == "new" and row["english_text"] is None and lib.index_size() == 119
    assert lib.table("segments").where("english_text = 'done'").count() == 119 and lib.table("segments").count() == 120
    assert lib.set_status(spark.createDataFrame([(doc, "translated"), (None, "x")], "id long, translation_status string")) == [bucket]
    assert [r["id"] for r in lib.table("documents").where("has_existing_translation").collect()] == [doc]
    assert lib.patch(change.limit(0), ["source_text"]) == []
    assert lib.ingest(works(spark, [("new", "N", None, None, "la", True, [("I", "x")])])) == 41  # appends, rewrites nothing
    assert all(after[name] - files(name) == set() for name in ("sections", "segments"))
    with pytest.raises(ValueError):
        store.Library(spark, str(tmp_path / "other"), 12)


def test_patches_that_name_sections_deal_only_their_rows(spark, tmp_path):
    """F16: rows of other sections stay in their buckets; the table is the same as after a patch without section_id."""
    lib = store.Library(spark, str(tmp_path / "lib"), 2)
    lib.ingest(works(spark, [(f"s{i}", "T", None, None, "la", True, [("I", f"a {i}\nb"), ("II", "c")]) for i in range(20)]))
    first = lib.table("segments").groupBy("section_id").agg(F.min("id").alias("id")).orderBy("section_id").limit(10)
    first = tables.stored(first, "first")  # the files that it reads go
    changes = first.select("id", "section_id", F.lit("T").alias("english_text"))
    wanted = sorted(map(tuple, library.patch(lib.table("segments"), changes, ["english_text"]).collect()), key=str)
    dealt = []

    def apply(rows, c):
        dealt.append(rows.count())
        return library.patch(rows, c, ["english_text"])

    lib.changed("segments", changes, apply)
    assert dealt[0] < lib.table("segments").count() == 60
    assert sorted(map(tuple, lib.table("segments").collect()), key=str) == wanted
    lib.patch_source(changes.select("id", "section_id", F.lit("new").alias("source_text")))
    rows = lib.table("segments").where("source_text = 'new'").collect()
    assert len(rows) == 10 and all(r["english_text"] is None for r in rows) and lib.table("segments").count() == 60


def test_a_failed_patch_leaves_the_old_rows(spark, tmp_path):
    lib = store.Library(spark, str(tmp_path / "lib"), 4)
    lib.ingest(works(spark, [(f"s{i}", "T", None, None, "la", True, [("I", "a\nb")]) for i in range(10)]))
    want = sorted(r["id"] for r in lib.table("segments").collect())
    broken = lambda rows, c: rows.withColumn("source_text", F.raise_error("broken"))
    with pytest.raises(Exception, match="broken"):
        lib.changed("segments", lib.table("segments").select("id"), broken)
    assert sorted(r["id"] for r in lib.table("segments").where("source_text in ('a', 'b')").collect()) == want


def test_backfill_writes_only_what_differs(spark):
    rows = spark.createDataFrame(
        [(1, "a / b", None), (2, "Gallia est.", None), (3, "x / y", "done"), (4, None, None)],
        "id long, source_text string, embed_text string",
    )
    assert [(r["id"], r["embed_text"]) for r in store.backfilled(rows).collect()] == [(1, "a b")]


def test_renderings_escape(spark):
    docs = spark.createDataFrame(
        [(1, "A & B", None, -1, "", "grc", None, "s<1>", False)],
        "id long, title string, author string, century int, genre string, language string, language_stage string, source string, "
        "has_existing_translation boolean",
    )
    sections = spark.createDataFrame([(9, 1, 0)], "id long, doc_id long, ord int")
    segs = spark.createDataFrame(
        [(9, 0, "<x>", "y & z", None, None), (9, 1, "w", "  ", None, "-u")],
        "section_id long, ord int, source_text string, english_text string, english_styled string, scansion string",
    )
    html = store.reader_pages(docs, sections, segs).first()["html"]
    assert "<h2>A &amp; B</h2>" in html and "Anon. · unknown · 1c BCE · s&lt;1&gt;" in html and "<th>Greek</th>" in html
    assert '<td class="la">&lt;x&gt;</td><td class="en">y &amp; z</td>' in html and "not yet translated" in html and '<span class="scansion">-u</span>' in html
    assert "not yet stylized" in store.reader_pages(docs, sections, segs, "Stylized").first()["html"]
    assert store.reader_pages(docs, sections, segs.limit(0)).first()["html"].endswith("<tbody></tbody></table>")
    hit = spark.createDataFrame(
        [(1, 0.98765, None, "T", "p. 3", "<q>", None)],
        "id long, score double, author string, title string, source_loc string, source_text string, english_text string",
    )
    block = store.hit_blocks(hit).first()["html"]
    assert "0.988" in block and "Anon. — T · p. 3" in block and "&lt;q&gt;" in block
    assert docs.select(store.document_label().alias("l")).first()["l"] == "Anon. — A & B (Greek, unknown  · untranslated)"


def test_report_of_an_empty_library(spark):
    docs, segs = spark.createDataFrame([], library.DOCUMENTS), spark.createDataFrame([], library.SEGMENTS).withColumn(
        "doc_id", F.lit(1).cast("long")
    )
    lines = [r["line"] for r in store.report_lines(docs, segs).orderBy("part", "rank").collect()]
    assert lines == ["Documents: 0", "Segments: 0 / 0 translated (0.0%), 0 stylized", "Era span: Nonec to Nonec"]


def test_citation_mining(spark):
    leaf = "work string, pos int, chain array<struct<level:string,n:string>>, text string"
    src = [
        ("w", 0, [("edition", "x"), ("book", "1"), ("chapter", "1"), ("section", "1")], "a"),
        ("w", 1, [("book", "1"), ("chapter", "1"), ("section", "2")], "b"),
        ("w", 2, [("book", "1"), ("chapter", "2")], " "),
        ("w", 3, [("book", "9")], "c"),
        ("v", 0, [("line", "1")], "d"),
    ]
    tgt = [
        ("w", 0, [("book", "1"), ("chapter", "1")], "A"), ("w", 1, [("book", "1"), ("chapter", "2")], "B"), ("v", 0, [("card", "1")], "D")
    ]
    got = mining.citation_pairs(spark.createDataFrame(src, leaf), spark.createDataFrame(tgt, leaf)).collect()
    assert [(r["src"], r["tgt"], r["citation"], r["source"]) for r in got] == [("a b", "A", "1.1", "Perseus w")]
    xml = (
        "<TEI><text><body><div type='edition' n='e'><div subtype='Book' n='1'><p>alpha <note>x</note> "
        "beta</p></div><div><p>plain</p></div></div></body></text></TEI>"
    )
    assert parse.citation_leaves(xml) == [([("edition", "e"), ("book", "1")], "alpha beta"), ([("edition", "e")], "plain")]
    assert parse.citation_leaves("<x") == [] and parse.citation_leaves(None) == []


def test_books(spark):
    text = "BOOK I\nBOOK II\nBOOK III\n\nBOOK I\n" + "a" * 300 + "\nBOOK II\n" + "b" * 300 + "\nBook of\nBOOK III\nccc"
    got = {
        r["book"]: r["text"]
        for r in mining.target_books(
            spark.createDataFrame([("w", text), ("x", "no books"), ("y", None)], "work string, text string")
        ).collect()
    }
    assert set(got) == {"1", "2", "3"} and got["3"] == "BOOK III\nccc" and got["1"].count("a") == 300
    sides = spark.createDataFrame([("w", "2", "s"), ("w", "None", "t")], "work string, book string, text string")
    assert [
        (r["n"], r["src"])
        for r in mining.common_books(
            sides, spark.createDataFrame([("w", b, t) for b, t in got.items()], "work string, book string, text string")
        ).collect()
    ] == [(2, "s")]


@pytest.mark.parametrize("letters", ["ab ", "abcdefgh .,é", "".join(map(chr, range(0x4E00, 0x5E00)))])
def test_chrf_counts_against_counters(monkeypatch, letters):
    monkeypatch.setattr(evaluation, "ROWS", 7)
    r = random.Random(2)
    some = lambda: "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 6, 40, 200])))
    left, right = [some() for _ in range(40)], [some() for _ in range(40)]
    right = [a[3:] + b[:5] if i % 2 else b for i, (a, b) in enumerate(zip(left, right, strict=True))]
    for a, b, got in zip(left, right, evaluation.chrf_counts(left, right).tolist(), strict=True):
        a, b, want = "".join(a.split()), "".join(b.split()), []
        for n in range(1, 7):
            x, y = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (a, b))
            want += [x.total() if y else 0, y.total(), (x & y).total()]
        assert got == want
    assert evaluation.chrf_counts([], []).shape == (0, 18)


@pytest.mark.parametrize("letters", ["ab ", "ab.,-1 &;", "".join(map(chr, range(0x4E00, 0x5E00)))])
def test_counts_of_whole_batches_against_counters(monkeypatch, letters):
    monkeypatch.setattr(evaluation, "ROWS", 7)
    monkeypatch.setattr(evaluation, "LETTERS", 300)
    r = random.Random(4)
    some = lambda: "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 30, 2000])))
    sides = [[some() for _ in range(15)] for _ in range(2)]
    sides.append([a[2:] + b[:9] for a, b in zip(*sides, strict=True)])
    for pair, got in zip([(0, 2), (1, 2)], evaluation.chrf_sides([(0, 2), (1, 2)], *sides), strict=True):
        assert (got == evaluation.chrf_counts(*(sides[i] for i in pair))).all()
    for a, b, got in zip(sides[0], sides[2], evaluation.bleu_counts(sides[0], sides[2]).tolist(), strict=True):
        h, t, want = evaluation.bleu_tokens(a), evaluation.bleu_tokens(b), []
        for n in range(1, 5):
            x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (h, t))
            want += [(x & y).total(), x.total()]
        assert got == [*want, len(h), len(t)]


def test_only_pairs_without_a_reason_are_scored(spark):
    texts = ["x" * 5, "Same text, but for the letters' case", "a line of which half is 汉字 and more of it", "a line that has to be scored by its letters", " "]
    rows = [(t, t.upper(), i) for i, t in enumerate(texts)] + [(None, "b" * 40, 9)]

    @F.udf("double")
    def score(a, b):
        assert (a is None) == (b is None)
        if a is not None and a != texts[3]:
            raise ValueError(a)
        return 99.0 if a else 0.0

    rows[2], rows[3] = (texts[2], "b" * 40, 2), (texts[3], "c" * 40, 3)
    pairs = spark.createDataFrame(rows, "src string, tgt string, i int")
    got = {r["i"]: r["reason"] for r in library.pair_reasons(pairs, chrf=score).collect()}
    assert got == {0: "short", 1: "identical", 2: "contaminated", 3: "near_copy"}
    assert {r["i"]: r["reason"] for r in library.pair_reasons(pairs).collect()} == got | {3: None}


def test_white_space_at_the_ends_is_cut_in_linear_time(spark):
    inner = "a" + " " * 400_000 + "b"
    start = time.monotonic()
    assert spark.createDataFrame([(f"\n {inner}\u3000\r\n",)], "s string").select(X.strip("s")).first()[0] == inner
    assert time.monotonic() - start < 20
    # as the pattern has it, for every letter of the basic plane and mixed ends
    ends = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000] + ["", "\r\n", " \u2028\n", "\u180e \u200b", "é\x85"]
    rows = spark.createDataFrame([(f"{e}x{e} y{e}",) for e in ends] + [(e,) for e in ends] + [(None,)], "s string")
    assert rows.where(~F.equal_null(X.strip("s"), F.regexp_replace("s", r"(?U)^\s+|\s+$", ""))).collect() == []


def test_contaminated_by_letters_beyond_ascii(spark):
    r = random.Random(6)
    some = lambda: "".join(r.choice(["a", "b", "é", "ß", "汉", "한", "ｅ", "\u3000", "€", "😀", " "][: r.randint(1, 11)]) for _ in range(r.randint(0, 25)))
    sides = [(some(), some()) for _ in range(600)] + [("é" * 3 + "a" * 22, "b"), ("é" * 4 + "a" * 21, "b"), ("a", None), (None, "a"), (None, "汉")]
    got = [x[0] for x in spark.createDataFrame(sides, "a string, b string").coalesce(1).select(X.is_contaminated("a", "b")).collect()]
    cjk = re.compile(r"[\u3000-\u9fff\uac00-\ud7ff\uff00-\uffef]")
    for (a, b), is_so in zip(sides, got, strict=True):
        if a is not None and b is not None:
            assert is_so == bool(cjk.search(a) or cjk.search(b) or sum(c > "\x7f" for c in a) / max(1, len(a)) > 0.12), (a, b)
    assert got[-3:] == [None, None, True]


def test_style_scores_take_the_n_grams_of_a_side_once(spark):
    rows = spark.createDataFrame([("t", "abcdef", "abcdxf", "abcdef")], "m string, src string, hyp string, ref string")
    plan = evaluation.style_scores(rows, ["m"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"(?:chrf_score|chrf_stats|style_stats)\([^)]*\)#\d+", plan))) == 1


def test_a_styling_model_is_made_once_for_many_batches(spark):
    rows = spark.createDataFrame([(i, i, 0, f"text {i}", None) for i in range(6)], "id long, section_id long, ord int, english_text string, english_styled string")

    def factory():
        calls = []
        return lambda system, user: calls.append(user) or f"call {len(calls)} {user.strip()}"

    got = {r["id"]: r["english_styled"].split() for r in styling.styled(rows.coalesce(1), factory, "modernize").collect()}
    assert set(got) == set(range(6)) and all(x[-1] == str(i) for i, x in got.items())
    assert max(int(x[1]) for x in got.values()) > 1


def test_scores_against_plain_formulas(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc.,-1") for _ in range(r.randint(1, 6)))
    pairs = [
        (" ".join(word() for _ in range(r.randint(0, 9))), " ".join(word() for _ in range(r.randint(0, 9))))
        for _ in range(40)
    ] + [("same text here now", "same text here now"), ("", "x"), (None, None)]

    def chrf(rows):
        p = q = n = 0
        for k in range(1, 7):
            h = m = t = 0
            for a, b in rows:
                a, b = (re.sub(r"\s", "", x or "") for x in (a, b))
                x, y = (Counter(s[i : i + k] for i in range(len(s) - k + 1)) for s in (a, b))
                h, t, m = h + (x.total() if y else 0), t + y.total(), m + (x & y).total()
            if h and t:
                p, q, n = p + m / h, q + m / t, n + 1
        p, q = (p / n, q / n) if n else (0, 0)
        return 100 * 5 * p * q / (4 * p + q) if p + q else 0.0

    frame = spark.createDataFrame([("m", *x) for x in pairs], "model string, hyp string, ref string")
    whole = evaluation.corpus_scores(frame, ["model"]).first()
    assert whole["chrf"] == pytest.approx(chrf(pairs)) and whole["n"] == len(pairs)
    same = spark.createDataFrame([("m", "the cat sat on the mat .", "the cat sat on the mat .")], "model string, hyp string, ref string")
    assert evaluation.corpus_scores(same, ["model"]).first()["bleu"] == pytest.approx(100.0)
    short = spark.createDataFrame([("m", "the cat sat on", "the cat sat on the mat")], "model string, hyp string, ref string")
    assert evaluation.corpus_scores(short, ["model"]).first()["bleu"] == pytest.approx(100 * math.exp(1 - 6 / 4))
    smooth = spark.createDataFrame([("m", "the cat dog sat there", "the cat sat on mat")], "model string, hyp string, ref string")
    want = math.exp(sum(map(math.log, (3 / 5, 1 / 4, 1 / (2 * 3), 1 / (4 * 2)))) / 4) * 100
    assert evaluation.corpus_scores(smooth, ["model"]).first()["bleu"] == pytest.approx(want)
    assert evaluation.bleu_tokens("a,b 1,000-2 (c)") == ["a", ",", "b", "1,000", "-", "2", "(", "c", ")"]
    assert evaluation.corpus_scores(frame.limit(0), ["model"]).count() == 0


def test_style_scores_and_specs(spark):
    rows = spark.createDataFrame(
        [("t", "abcdef", "abcdef", "abcdef"), ("t", "", None, "x")], "m string, src string, hyp string, ref string"
    )
    got = evaluation.style_scores(rows.fillna(""), ["m"]).first()
    assert got["n"] == 2 and got["commit"] == 50.0
    specs = spark.createDataFrame(
        [("a=stock:norm",), ("b",), ("c=x=y",)], "s string"
    ).select(evaluation.model_spec("s", "S").alias("m")).collect()
    assert [tuple(x["m"]) for x in specs] == [("a", "S", True), ("b", "", False), ("c", "x=y", False)]


def test_restyling_keeps_counts():
    answer = lambda system, user: user.split("\n\n")[-1].upper()
    assert styling.restyled_units(["a b", "“c”"], answer, "", "") == ["A B", "C"]
    lost = lambda system, user: "1. only one" if "1 to" in user else f'"{user.split()[-1]}!"'
    assert styling.restyled_units(["a", " ", "c"], lost, "", "x") == ["a!", "", "c!"]
    assert styling.restyled_units([], answer, "", "") == []


def test_styling_plan(spark):
    seg = "id long, section_id long, ord int, english_text string, english_styled string"
    rows = spark.createDataFrame(
        [
            (1, 1, 0, "a", None),
            (2, 1, 1, X.PLACEHOLDER, ""),
            (3, 1, 2, "boom", None),
            (4, 1, 3, "d", "done"),
            (5, 1, 4, None, None),
            (6, 1, 5, "f", None),
        ],
        seg,
    )

    def factory():
        def generate(system, user):
            if "boom" in user:
                raise RuntimeError("too long")
            return user.split("\n\n")[-1] + "!"

        return generate

    got = {r["id"]: (r["english_styled"], r["style_label"]) for r in styling.styled(rows, factory, "verse_blank").collect()}
    assert got == {1: ("a!", "verse_blank"), 2: (X.PLACEHOLDER, "placeholder"), 6: ("f!", "verse_blank")}
    with pytest.raises(ValueError, match="preset"):
        styling.styled(rows, factory, "unknown")


def test_scansion_never_fails(spark):
    lines = spark.createDataFrame(
        [(1, 1, 0, "arma", "la"), (2, 1, 1, " ", "la"), (3, 1, 2, "menin", "grc"), (4, 1, 3, "bad", "la"), (5, 1, 4, None, "la")],
        "id long, section_id long, ord int, source_text string, language string",
    )

    def factory():
        return lambda line, meter: f"{meter[0]}-" if line == "arma" else 1 / 0

    got = {r["id"]: (r["scansion"], r["note"]) for r in styling.scanned(lines, factory).collect()}
    assert got[1] == ("h-", None) and got[2][1] == "empty line" and got[3][1].startswith("Greek") and "division" in got[4][1] and got[5][1] == "empty line"
    assert styling.scanned(lines, None).where("scansion is not null").count() == 0


def test_catalogues_survive_bad_payloads(spark):
    bad = spark.createDataFrame([("a", None), ("b", ""), ("c", "{broken"), ("d", "[]")], "id string, payload string")
    for f in (
        lambda p: catalogs.listing(p, "dir"),
        catalogs.wiki_titles,
        catalogs.archive_ids,
        catalogs.entity_rows,
        catalogs.binding_labels,
        catalogs.repertory_rows,
        catalogs.loeb_rows,
        catalogs.mgh_catalogue,
        catalogs.manifest,
        catalogs.dlt_ids,
    ):
        assert f(bad).count() == 0
        assert f(bad.limit(0)).count() == 0
    page = spark.createDataFrame(
        [("a", '<span class="bibliographicAuthorName"><i>Ovid</i></span> x <span class="workTitle"> Fasti </span>')],
        "id string, payload string",
    )
    assert [(r["author"], r["title"]) for r in catalogs.loeb_rows(page).collect()] == [("Ovid", "Fasti")]
    answer = spark.createDataFrame([("q", '{"results":{"bindings":[{"langLabel":{"value":"English"}},{}]}}')], "id string, payload string")
    assert [r["language"] for r in catalogs.binding_labels(answer).collect()] == ["English"]


def test_requests():
    assert catalogs.wiki_request("Categoria:X", 900)["cmlimit"] == "500" and catalogs.wiki_request("x")["list"] == "search"
    assert catalogs.canon_pages("b", 20) == ["b/canone?l=16&o=0", "b/canone?l=16&o=16", "b/canone?l=16&o=32"]
    assert catalogs.edcs_filter("provinz = Roma") == {"provinz": "Roma"} and catalogs.edcs_filter("x") == {"searchtext1": "x"}
    pages = catalogs.edcs_requests("x", 250)
    assert [(p["start"], p["length"]) for p in pages] == [("0", "100"), ("100", "100"), ("200", "50")]
    assert catalogs.camena_request("Cera:ab") == (["cera"], "ab") and len(catalogs.camena_request("all")[0]) == 4
    with pytest.raises(ValueError, match="collection"):
        catalogs.camena_request("other")
    assert catalogs.archive_query("a") == 'title:"a"' and catalogs.archive_query("x:y") == "x:y" and len(catalogs.gutenberg_urls(7)) == 9


def test_identifiers_and_missing_files(spark, tmp_path):
    rows = spark.createDataFrame([("785",), ("https://x/BSB00000001.zip",), ("idno/dlt000003",), ("none",), (None,)], "s string")
    got = rows.select(catalogs.bsb_id("s").alias("b"), catalogs.dlt_id("s").alias("d")).collect()
    assert [tuple(r) for r in got] == [("bsb00000785", None), ("bsb00000001", None), (None, "DLT000003"), (None, None), (None, None)]
    assert parse.catalogue(spark, str(tmp_path / "missing.json"), ["a", "b"]).collect() == []
    (tmp_path / "c.json").write_text('[["1","x"],["2",null]]')
    assert [
        (r["ord"], r["a"], r["b"])
        for r in parse.catalogue(spark, str(tmp_path / "c.json"), ["a", "b"]).collect()
    ] == [(0, "1", "x"), (1, "2", None)]


def test_zip_members(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("small.XML", "<a/>")
        z.writestr("bsb1.xml", "<b>xx</b>")
        z.writestr("large.xml", "<c>" + "y" * 50 + "</c>")
    rows = spark.createDataFrame(
        [(bytearray(buffer.getvalue()), "bsb1"), (bytearray(buffer.getvalue()), "other"), (None, "x")], "p binary, w string"
    )
    got = [r["x"] for r in rows.select(parse.unzipped("p", "w").alias("x")).collect()]
    assert bytes(got[0]) == b"<b>xx</b>" and bytes(got[1]).startswith(b"<c>") and got[2] is None


def test_tree_cycles_and_budget(spark):
    edges = spark.createDataFrame(
        [
            ("r", "a", 0, False),
            ("r", "t1", 1, True),
            ("a", "r", 0, False),
            ("a", "t2", 1, True),
            ("a", "b", 2, False),
            ("b", "a", 0, False),
            ("b", "t3", 1, True),
        ],
        "parent string, child string, ord int, is_text boolean",
    )
    assert [r["child"] for r in library.tree_leaves(edges, "r", 10).collect()] == ["t2", "t3", "t1"]
    assert [r["child"] for r in library.tree_leaves(edges, "r", 10, budget=1).collect()] == ["t1"]
    assert library.tree_leaves(edges, "nowhere", 5).count() == 0


def test_languages_have_their_names(spark):
    doc = spark.createDataFrame(
        [(7, "T", "A", -1, "", "la", None, "s", True)],
        "id long, title string, author string, century int, genre string, language string, language_stage string, source string, "
        "has_existing_translation boolean",
    )
    assert doc.select(store.listing_line().alias("l")).first()["l"].endswith(" T  (Latin, unknown)")
    sections = spark.createDataFrame([(9, 7, 0)], "id long, doc_id long, ord int")
    columns = "section_id long, ord int, source_text string, english_text string, english_styled string, scansion string"
    assert "<th>Latin</th>" in store.reader_pages(doc, sections, spark.createDataFrame([], columns)).first()["html"]


def test_tree_leaves_dives_below_more_nodes_than_the_budget(spark):
    # 1,100 folders in 7 levels: opened level by level, the budget of 60 would end before any text
    n = spark.range(1, 3280).withColumn("up", F.floor((F.col("id") - 1) / 3))
    edges = n.select(F.col("up").cast("string").alias("parent"), F.col("id").cast("string").alias("child"), F.col("id").alias("ord"), (F.col("id") >= 1093).alias("is_text"))
    assert [r["child"] for r in library.tree_leaves(edges, "0", 4).collect()] == ["1093", "1094", "1095", "1096"]
    # the budget counts in depth-first order: six folders on the way down and the first one that has texts
    assert [r["child"] for r in library.tree_leaves(edges, "0", 4, budget=7).collect()] == ["1093", "1094", "1095"]
    assert library.tree_leaves(edges, "0", 4, budget=6).count() == 0


def test_tables_need_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_corpus_xml():
    nested = "<r><author> A </author><name>N</name><body><div>one <div>two</div></div></body></r>"
    assert parse.corpus_text(nested) == ("A", "N", "one two")
    assert parse.corpus_text(nested, compat=True)[2] == "one two\ntwo"
    assert parse.corpus_text("<r><p>x</p><l>y</l></r>") == (None, None, "x\ny") and parse.corpus_text(None) == (None, None, "")


def test_raw_works(spark):
    from lectern.sources import works as W

    tei = (
        "<TEI><teiHeader><title>De re</title><author>Cato</author></teiHeader><text><body><div type='book' "
        "n='1'><p>alpha</p></div></body></text></TEI>"
    )
    rows = spark.createDataFrame(
        [
            ("urn:cts:greekLit:tlg1.tlg2", ["x-grc1.xml", "x-eng1.xml"], tei),
            ("a/b", ["x-grc2.xml"], tei),
            ("c.d", ["x-lat1.xml"], tei),
            ("e.f", ["x-grc1.xml"], "<bad"),
        ],
        "identifier string, files array<string>, xml string",
    )
    got = {r["source"]: r for r in W.edition_works(rows, "pta").collect()}
    assert set(got) == {"PTA (tlg1.tlg2)", "PTA (a.b)"} and got["PTA (a.b)"]["translation_status"] == "unknown"
    assert got["PTA (tlg1.tlg2)"][
        "has_existing_translation"
    ] and got["PTA (a.b)"]["language"] == "grc" and got["PTA (a.b)"]["author"] == "Cato"
    assert W.tei_works(rows.select(F.lit("DLT1").alias("identifier"), "xml"), "digiliblt", {"century": 5}).first()["century"] == 5
    answer = spark.createDataFrame([("7", "<r><name>N</name><div>prose</div></r>")], "identifier string, xml string")
    assert [
        r["source"]
        for n in ("corpuscorporum", "alim") for r in W.corpus_works(answer, n).collect()
    ] == ["Corpus Corporum (7)", "ALIM (7)"]
    assert W.plain_works(spark.createDataFrame([("i", "t")], "identifier string, text string")).first()["parts"][0]["text"] == "t"
    with pytest.raises(KeyError):
        W.plain_works(spark.createDataFrame([("i", "t")], "identifier string, text string"), "none")


def test_library_actions(spark, tmp_path, capsys):
    from lectern.__main__ import embed, main

    path = str(tmp_path / "lib")
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("Gallia est omnis divisa. In partes tres.")
    (folder / "b.txt").write_text("x«1«2«3 y")
    assert main([path, "ingest", str(folder)]) == 0 and main([path, "list"]) == 0 and main([path, "report"]) == 0
    assert "Documents: 2" in capsys.readouterr().out
    lib = store.Library(spark, path)
    assert lib.translate(lambda t: t.select("id", F.upper("text").alias("english_text"))) == 3
    lib.stylize(lambda: lambda system, user: user.split("\n\n")[-1] + "~", "verse_blank")
    lib.scan(lambda: lambda line, meter: "-u" if "tres" in line else None)
    rows = {r["source_text"]: (r["english_text"], r["english_styled"], r["scansion"]) for r in lib.segments().collect()}
    assert rows["In partes tres."][0] == "IN PARTES TRES." and rows["In partes tres."][2] == "-u" and rows["x«1«2«3 y"][:2] == (
        X.PLACEHOLDER, X.PLACEHOLDER
    )
    assert main([path, "reindex"]) == 0 and lib.index_size() == 3 and embed is not None
    doc = lib.list_documents().where("title = 'a'").first()["id"]
    assert main([path, "export", str(doc), str(tmp_path / "a.html")]) == 0 and "GALLIA" in (tmp_path / "a.html").read_text()
    assert main([path, "export", "1", "x"]) == 1 and main([path]) == 2 and lib.reader(1) is None
    assert store.prose_report(["a"], lambda s, u: " told ").startswith("told\n\n---")


def test_optional_tokenizer(spark):
    from lectern.operators import alignment

    df = spark.createDataFrame([("A b. C d.",), (None,)], "t string")

    def missing():
        raise ImportError

    assert [r["s"] for r in df.select(alignment.sentences_by(missing)("t").alias("s")).collect()] == [["A b.", "C d."], []]
    assert [
        r["s"]
        for r in df.select(alignment.sentences_by(lambda: lambda t: t.split(" "))("t").alias("s")).collect()
    ] == [["A", "b.", "C", "d."], []]


@pytest.fixture
def rocks(spark):
    from lectern.streaming import resume

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    resume.stateful(spark)
    yield resume
    spark.conf.set(key, before)


def test_page_pointer_as_a_stream(spark, tmp_path, rocks):
    """Several starts on one checkpoint give what the batch gives; pages travel with the state, not with the rows."""
    from lectern.operators import alignment

    r = random.Random(3)
    pages = {d: [" ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(20)) for _ in range(9)] for d in (1, 2)}
    segs = [(d, i, pages[d][min(8, i // 2)][(i % 2) * 30 :][:40] if i % 5 else "elsewhere altogether") for d in (1, 2) for i in range(16)]
    segs += [(1, 16, None), (1, 17, "ab"), (3, 0, "a document without pages")]
    right = spark.createDataFrame([(d, 10 * i, p) for d in pages for i, p in enumerate(pages[d])] + [(4, 1, "never asked for")], "doc_id long, page int, text string")
    schema = "doc_id long, pos int, text string"
    want = sorted(tuple(x) for x in alignment.align_pages(spark.createDataFrame(segs, schema), right).collect())
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (lambda x: x[1] < 5, lambda x: 5 <= x[1] < 12, lambda x: x[1] >= 12):
        spark.createDataFrame([x for x in segs if part(x)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = rocks.align_stream(spark.readStream.schema(schema).parquet(source), right)
        stream.writeStream.format("parquet").option("path", sink).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(x) for x in spark.read.parquet(sink).select("doc_id", "pos", "page", "confident").collect()) == want


def test_an_idle_document_ends():
    """A timer is put off with each arrival; when it goes off, pages and pointer are forgotten."""
    import pandas as pd

    from lectern.streaming import resume

    class State(dict):
        exists = lambda self: bool(self)
        getValue = dict.get  # noqa: N815
        containsKey = dict.__contains__  # noqa: N815
        updateValue = dict.__setitem__  # noqa: N815
        get = lambda self: self["value"]
        update = lambda self, v: self.__setitem__("value", v)

    class Handle:
        timers: list = []
        getMapState = getValueState = lambda self, *named: State()  # noqa: E731, N815
        listTimers = lambda self: iter(list(self.timers))  # noqa: E731, N815
        deleteTimer = lambda self, t: self.timers.remove(t)  # noqa: E731, N815
        registerTimer = lambda self, t: self.timers.append(t)  # noqa: E731, N815

    class Time:
        now = 100
        getCurrentProcessingTimeInMs = lambda self: self.now  # noqa: E731, N815

    pointer, time = resume.PagePointer(10, 6, 80, 50), Time()
    pointer.init(Handle())
    State.getValue = lambda self, k: dict.__getitem__(self, k)
    pointer.handleInitialState((1,), pd.DataFrame({"page": [0, 1], "plain": ["alphabetagamma", "deltaepsilonzeta"]}), time)
    rows = lambda: iter([pd.DataFrame({"pos": [0, 1], "key": ["alphabetag", "deltaepsil"]})])
    assert next(pointer.handleInputRows((1,), rows(), time)).to_numpy().tolist() == [[1, 0, 0, True], [1, 1, 1, True]]
    time.now = 120
    assert len(next(pointer.handleInputRows((1,), rows(), time))) == 2 and pointer.handle.timers == [170]
    next(pointer.handleExpiredTimer((1,), time, None))
    assert not pointer.pages and not pointer.pointer
    assert next(pointer.handleInputRows((1,), rows(), time)).empty


def test_progress_of_a_stream_and_of_a_write(spark, tmp_path):
    import time

    from lectern.streaming import resume

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = resume.Progress(60)
    assert listener.rate == 0 and listener.left is None
    spark.streams.addListener(listener)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    for _ in range(100):
        if listener.done == 30:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.done == 30 and listener.batches >= 1 and listener.left == pytest.approx(listener.seconds)
    rows, counts = resume.observed(spark.range(7), even=F.count_if(F.col("id") % 2 == 0))
    assert tables.stored(rows, "counted").count() == 7 and counts.get == {"rows": 7, "even": 4}


def test_training_records(spark):
    pairs = spark.createDataFrame([("a", "b", ""), ("c", "d", "grc"), (" ", "x", "la")], "src string, tgt string, src_lang string")
    rows = evaluation.training_records(pairs).collect()
    assert sorted(x["src_lang"] for x in rows) == ["grc", "la"] and sum(x["evaluation"] for x in rows) == 1
