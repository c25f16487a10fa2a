"""Golden examples and edge cases of the reference's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import alignment, library, repair, search
from lectern.plans import enrich
from lectern.sources import parse


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "expression", "expected"), [
    ("Cn. Pompeius venit. Kal. Mai. abiit.", lambda c: X.sentences(c), ["Cn. Pompeius venit.", "Kal. Mai.", "abiit."]),
    ("α; β· γ: δ. ε", lambda c: X.sentences(c, "grc"), ["α;", "β·", "γ: δ.", "ε"]),
    (None, lambda c: X.sentences(c), []),
    ("Imp(erator) Caes]ar [Aug]ustus", X.normalize_for_embedding, "Imperator Caesar Augustus"),
    ("Gallia est.", X.embedding_text, None),
    ("  ", X.embedding_text, None),
    ("a / b", X.embedding_text, "a b"),
    ("μῆνιν ἄειδε", lambda c: alignment.strip_diacritics(c), "μηνιν αειδε"),
    ("Vsurarum", X.fold, "usurarum"),
    ("eft fed est si ", lambda c: F.concat_ws(" ", *[x.cast("string") for x in X.long_s_counts(c)]), "2 2"),
    ("ab1 c« d", lambda c: F.round(X.garble_score(c), 2), 16.67),
    ("", X.garble_score, 0.0),
    ("Carmina (ed. X), II!", X.match_key, "carmina ii"),
    ("In L. Catilinam", X.search_title, "In Catilinam"),
    ("carmina ii", X.is_generic_title, True),
    ("de bello gallico", X.is_generic_title, False),
    ("", X.is_generic_title, True),
    ("940/45 - 1004", X.earliest_century, 10),
    ("saec. IX", X.earliest_century, 9),
    ("† 939/40", X.earliest_century, 10),
    ("716 - 757", X.earliest_century, 8),
    ("ignotum", X.earliest_century, None),
    ("XIV", X.book_number, 14),
    ("EIGHTH", X.book_number, 8),
    ("of", X.book_number, None),
    ("785", X.mgh_id, "bsb00000785"),
    ("3", X.pg_id, "PG003"),
    ("urn:cts:greekLit:phi0448.phi001", lambda c: X.cts_parts(c)["work"], "phi001"),
    ("phi0448/phi001", lambda c: X.cts_parts(c)["textgroup"], "phi0448"),
    ("esfe", lambda c: X.context_windows(c)[0], "^^^es@e$$$$"),
    ("dicit λόγος et λόγος.", X.mixed_translation, "dicit  et . [Greek in source: λόγος]"),
    ("a  b", X.collapse, "a b"),
    ("a b\r\nc\x85\n", lambda c: X.verse_lines(c), ["a", "b", "c"]),
])
def test_text(spark, value, expression, expected):
    assert one(spark, value, expression) == expected


@pytest.mark.parametrize("value, expected", [
    ("In L. A. Catilinam", "In A. Catilinam"), ("De C.D.E. f", "De D.f"), ("De épars II", "De é"), ("De rec. B", "De rec. B"), ("De lib.II", "De"),
])
def test_search_titles_as_the_twin_reads_them(spark, value, expected):
    assert one(spark, value, lambda c: X.search_title(c, ascii_words=True)) == expected
    assert one(spark, "In L. A. Catilinam, épars", X.search_title) == "In Catilinam, épars"


@pytest.mark.parametrize("value, expected", [
    ('"go. token = "9f"', '"go. token = "9f"'), (' "a "b" c" ', 'a "b" c'), ("'don't'", "don't"), ('"', '"'), ('""', ""),
])
def test_quotes_that_end_a_quotation_inside_stay(spark, value, expected):
    assert one(spark, value, X.unquote) == expected


def test_century_labels(spark):
    df = spark.createDataFrame([(-1,), (9,), (0,), (None,)], "c int").select(X.century_label("c").alias("r"))
    assert [r["r"] for r in df.collect()] == ["1c BCE", "9c CE", None, None]


def test_html():
    assert parse.html_paragraphs("<p>a<p>b</p>") == ["b"]
    assert parse.html_paragraphs("<p>a<p>b</p>", repair=True) == ["a", "b"]
    assert parse.html_paragraphs("<p>x<sup>1</sup>y<br>z</p>") == ["xy z"]
    assert parse.html_paragraphs(None) == []


def test_tei():
    xml = "<TEI><text><body><div subtype='book' n='1'><p>alpha <note>n</note> beta</p></div></body></text></TEI>"
    assert parse.tei_parts(xml)[2] == [("Book 1", "alpha beta")]
    assert parse.tei_parts(xml, compat=True)[2] == [("Book 1", "alpha")]
    assert parse.tei_parts("<broken")[2] == []


def test_chunks():
    assert [len(c) for c in alignment.chunks("x" * 950)] == [500, 500, 150]
    assert [len(c) for c in alignment.chunks("x" * 850)] == [500, 450, 50]
    with pytest.raises(ValueError):
        alignment.chunks("x", 150, 100)


def test_numbered():
    assert alignment.parse_numbered("1. a\nb\n2) c", 2) == ["a\nb", "c"]
    assert alignment.parse_numbered("1. a\nb\n2) c", 3) is None


def test_beads_merge():
    a = np.array([[1.0, 0], [0, 1.0]])
    b = np.array([[1.0, 1.0]]) / np.sqrt(2)
    assert alignment.beads(a, b) == [([0, 1], [0], 1.0)]
    assert alignment.beads(a[:0], b) == []


def test_spans_and_recovery():
    assert alignment.find_span("xx Arma, virumque cano", "arma virumque") == (3, 17)
    assert alignment.recover("arma virumque", "nota arma virumque cano", "nota armz virumque cano") == "armz virumque"
    assert alignment.recover("arma virumque", "nota arma virumque cano", "nota armz virumque cano", compat=True) == "armz virumque c"
    assert alignment.recover("arma", "nota arma virumque", "nota arma virumque") is None  # too short to trust
    assert alignment.recover("absens totaliter", "nota", "nota") is None
    assert alignment.chrf("abc", "abc") == 100.0 and alignment.chrf("", "abc") == 0.0


def test_best_fixes(spark):
    vocab = spark.createDataFrame([("esse", 5), ("usuram", 1)], "word string, freq long")
    words = spark.createDataFrame([("effe",), ("ufurarum",), ("xyz",)], "word string")
    got = {r["word"]: (r["exact"], r["stem"]) for r in library.best_fixes(words, vocab, library.stems(vocab)).collect()}
    assert got == {"effe": ("esse", None), "ufurarum": (None, "usurarum"), "xyz": (None, None)}


def test_correction():
    words = repair.Dictionary({"est"}, {"effe": ("esse", None), "ufurarum": ("usurarum", None)})
    assert repair.correct("effe est PR1FATIO", words)[0] == "esse est PR1FATIO"
    assert repair.correct("u fur arum", words)[0] == "usurarum"
    assert repair.correct(None, words)[0] == ""


def test_routing(spark):
    docs = spark.createDataFrame(
        [(1, "grc", "late_antique"), (2, "la", "medieval"), (3, "grc", None)], "id long, language string, language_stage string"
    )
    routes = spark.createDataFrame(library.ROUTES, "lang string, stage string, rank int, model string, code string, strip boolean")
    none = library.routed(docs, routes, routes.select("model").limit(0))
    assert {r["id"]: r["model"] for r in none.collect()} == {1: "stock:ell_Grek", 2: "stock:lat_Latn", 3: "stock:ell_Grek"}
    all_ = library.routed(docs, routes, routes.select("model"))
    assert {r["id"]: r["model"] for r in all_.collect()} == {1: "models/nllb-greek-v3", 2: "models/nllb-la", 3: "models/nllb-greek-v2"}


def test_best_run(spark):
    rows = [(1, p, n) for p, n in ((0, 1), (10, 2), (20, 3), (100, 1), (500, 2), (900, 3))]
    h = spark.createDataFrame(rows, "doc_id long, pos long, n long")
    got = sorted(tuple(r) for r in library.best_run(h, spark.createDataFrame([(1, 1000)], "doc_id long, size long")).collect())
    assert got == [(1, 1, 100, 500), (1, 2, 500, 900), (1, 3, 900, 1000)]


def test_marked_sections(spark):
    lines = ["$0=3 $8=71 $9=1", "α β", "γ", "$0=3 $8=71 $9=2", "δ"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    got = library.marked_sections(df, r"^\$\d", F.regexp_extract("line", r"\$9=(\d+)", 1)).orderBy("part").collect()
    assert [(r["label"], r["text"]) for r in got] == [("1", "α β γ"), ("2", "δ")]
    volume = spark.createDataFrame(
        [(1, "3", "\n".join(["front", *lines])), (2, "4", None), (3, "5", "")], "doc_id long, volume string, text string"
    )
    parts = [(r["label"], r["text"]) for r in library.volume_sections(volume).orderBy("doc_id", "part").collect()]
    assert parts == [("PG 3", "front"), ("PG 3, p.71, col.1", "α β γ"), ("PG 3, p.71, col.2", "δ")]


def test_search(spark):
    index = search.add_vectors(
        spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (1, [1.0, 0.0])], "id long, v array<float>"), "id", "v"
    )
    got = search.top_k(index, [2.0, 0.0], 5).collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(1, 1.0), (2, 0.0)]


def test_models_survive_failures(spark):
    def factory():
        def model(texts):
            if len(texts) > 1 or texts[0] == "bad":
                raise RuntimeError
            return [texts[0].upper()]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id long, t string")
    assert {r["id"]: r["output"] for r in enrich.apply_model(df, "id", "t", factory).collect()} == {1: "A", 2: "", 3: ""}
    assert {r["id"] for r in enrich.apply_model(df, "id", "t", factory).where("failed").collect()} == {2}
    broken = enrich.apply_model(df, "id", "t", lambda: lambda texts: texts.missing)
    with pytest.raises(Exception, match="missing"):
        broken.collect()


def test_iiif(spark):
    v2 = '{"sequences":[{"canvases":[{"images":[{"resource":{"@id":"d1","format":"image/jpeg","service":{"@id":"s1"}}}]}]}]}'
    v3 = '{"items":[{"items":[{"items":[{"body":{"id":"d2","format":"image/png","service":[{"id":"s2"}]}}]}]}]}'
    got = parse.iiif_images(spark.createDataFrame([(1, v2), (2, v3)], "id long, manifest string")).orderBy("id").collect()
    assert [(r["index"], r["service_url"], r["direct_url"]) for r in got] == [(1, "s1", "d1"), (1, "s2", "d2")]


def test_empty_library(spark):
    empty = spark.createDataFrame([], library.SEGMENTS).withColumn("doc_id", F.lit(1).cast("long"))
    assert library.global_counts(empty).first()["percent"] == 0.0
    assert library.vocabulary(empty).count() == 0


def test_stream_resume(spark, tmp_path):
    from lectern.streaming import resume

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a")], "id long, t string").write.parquet(src)
    for _ in range(2):
        resume.enrich_stream(
            spark, src, "id long, t string", lambda d: d.withColumn("u", F.upper("t")), str(tmp_path / "out"), str(tmp_path / "cp")
        ).awaitTermination()
    assert [r["u"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["A"]


def test_correct_with_own_entries(spark):
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("aeifstu"), r.integers(2, 8))) for _ in range(120)]
    rows = [
        (i if i % 9 else None, " ".join(r.choice(words, 40)))
        for i in range(40)
    ] + [(50, None), (51, ""), (52, "u fur arum 3effe"), (52, "u fur arum 3effe")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(
        [(w, 1) for w in sorted({repair.folded(w) for w in words if "f" not in w} | {"usurarum"})], "word string, freq long"
    )
    fixes = library.best_fixes(repair.candidates(texts), known, library.stems(known))
    whole = repair.Dictionary({x["word"] for x in known.collect()}, {x["word"]: (x["exact"], x["stem"]) for x in fixes.collect()})
    plan = repair.corrected(texts, known, fixes)
    got = sorted(((x["doc_id"], x["text"], x["n_changes"], x["n_suggestions"], x["n_unresolved"]) for x in plan.collect()), key=repr)
    want = sorted(((i, c[0], len(c[1]), len(c[2]), len(c[3])) for i, c in ((i, repair.correct(t, whole)) for i, t in rows)), key=repr)
    assert got == want and any(x[2] for x in got)
    many = spark.range(2_100_000).selectExpr(
        "concat('f', translate(cast(id as string), '0123456789', 'abcdeghikl')) as word", "'sum' as exact", "cast(null as string) as stem"
    )
    assert repair.corrected(spark.createDataFrame([(1, "fb est")], "doc_id long, text string"), known, many).first()["text"] == "sum est"


def test_results_of_a_model_leave_the_worker_in_slices(spark):
    rows = spark.range(1500).coalesce(1).select("id", F.repeat(F.lit("x"), (1500 - F.col("id")).cast("int")).alias("t"))

    def factory():
        calls = []
        return lambda texts: calls.append(0) or [[float(len(calls)), float(len(t))] for t in texts]

    got = {r["id"]: r["output"] for r in enrich.apply_model(rows, "id", "t", factory, "array<double>").collect()}
    assert all(got[i][1] == 1500 - i for i in range(1500))
    assert max(got[i][0] for i in range(512)) == 16


def test_functions_of_whole_texts_hold_few_of_them(spark):
    from pyspark.util import PythonEvalType

    texts = [None if i % 5 == 0 else f"&amp;{i} &lt;" for i in range(700)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    xml = F.concat(F.lit("<cc><author>A</author><div>"), "t", F.lit("</div></cc>"))
    got = rows.select("id", parse.unescape_each(F.when(F.col("t").isNotNull(), F.array("t"))).alias("u"), parse.corpus_parts(xml).alias("c"), alignment.chunked("t").alias("k"))
    for r in got.collect():
        t = texts[r["id"]]
        plain = t and t.replace("&amp;", "&").replace("&lt;", "<")
        assert (r["u"], r["k"]) == ((None, []) if t is None else ([plain], [t])) and tuple(r["c"]) == ((None, None, "") if t is None else ("A", None, plain))
    assert {f.evalType for f in (parse.unescape_each, parse.corpus_parts, alignment.chunked)} == {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}


def test_sentences_are_cut_once(spark, tmp_path):
    """the text is cut once a line, and every sentence comes as a plain walk over the pieces has it."""
    import random
    import re

    from lectern.plans import queries

    def plain(text):
        pieces, out = re.sub(r"([.;:?!])\s+", "\\1\x01", " ".join(text.split())).split("\x01"), []
        for i, piece in enumerate(pieces):
            last = re.split(r"[\s(]", pieces[i - 1])[-1]
            if i and re.sub(r"[.;:?!]+$", "", last).lower() in X.ABBREVIATIONS:
                out[-1] += f" {piece}"
            else:
                out.append(piece)
        return [s for s in out if s]

    pick = random.Random(3).choice
    bits = ["a.", "a. ", "Kal. ", "(cf. ", "i.e. ", "etc...", "Roma ", "x! ", "é", "? ", "\u00a0", "\t ", "  ", "\u3000", "no", "; "]
    rows = [(i, "".join(pick(bits) for _ in range(i % 23))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in df.select("text", X.sentences("text").alias("s")).collect():
        assert r["s"] == plain(r["text"]), r["text"]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.str04_segment_sentences(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("coss") == 1


def test_vocabulary_folds_without_lambdas(spark):
    """words are cut and folded by compiled expressions."""
    df = spark.createDataFrame([("Vivus JUVAT iv x\u212aab, vV uu Vj!",), (None,), ("",)], "text string")
    found = library.vocabulary(df, column="text")
    assert {tuple(r) for r in found.collect()} == {("uiuus", 1), ("iuuat", 1), ("iu", 1), ("ab", 1), ("uu", 2), ("ui", 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "translate(" not in plan
