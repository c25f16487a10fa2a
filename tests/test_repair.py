"""OCR repair tiers, classifier and page alignment against goldens and plain restatements of their rules."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import alignment, library, repair


def decided(spark, probabilities: dict, vocab: list):
    words = spark.createDataFrame([(w,) for w in probabilities], "word string")
    p = spark.createDataFrame([(w, i, x) for w, at in probabilities.items() for i, x in at.items()], "word string, pos int, p double")
    v = spark.createDataFrame([(w, 1) for w in vocab], "word string, freq long")
    rows = repair.decisions(words, p, v, library.stems(v)).collect()
    return {r["word"]: (r["single"], r["merged"], r["ct"]) for r in rows}, v


def test_tier_goldens(spark):
    cases = {
        "diftum": {2: 0.1}, "Leftor": {2: 0.05}, "contraftus": {6: 0.1}, "fcenore": {0: 0.9998}, "eft": {1: 0.95}, "unfure": {2: 0.5},
        "ufurarum": {1: 0.876}, "fuiftent": {0: 0.9995, 3: 0.9995}, "effe": {1: 0.99, 2: 0.99}, "ftftftftft": {
            0: 0.1, 2: 0.1, 4: 0.1, 6: 0.1, 8: 0.1
        },
    }
    got, _ = decided(spark, cases, ["dictum", "lector", "contractus", "usuram", "usuras", "esse", "est"])
    assert got["diftum"][2] == "dictum" and got["Leftor"][2] == "Lector" and got["contraftus"][2] == "contractus"
    assert "fcenore" not in got and "unfure" not in got and "ftftftftft" not in got
    assert got["eft"][:2] == ("est", "est") and got["effe"][:2] == ("esse", "esse")
    assert got["ufurarum"] == (None, "usurarum", None)  # 0.876 is enough only where the stem supports a merge
    assert "fuiftent" not in got  # several f's and no support


def test_tiers_against_the_rules(spark):
    """Every word of a small alphabet by the rules as stated, word by word."""
    r = random.Random(4)
    vocab = sorted({"".join(r.choice("aceist") for _ in range(r.randint(2, 9))) for _ in range(3000)})
    words = sorted({"".join(r.choice("aceisftF") for _ in range(r.randint(2, 9))) for _ in range(900)})
    words = [w for w in words if "f" in w.lower()]
    p = {w: {i: r.choice([0.02, 0.1, 0.15, 0.3, 0.75, 0.9, 0.97]) for i, c in enumerate(w) if c in "fF"} for w in words}
    got, _ = decided(spark, p, vocab)
    known = set(vocab)
    stems = {w[: len(w) - len(e)] for w in known if len(w) >= 6 for e in X.ENDINGS if w.endswith(e) and len(w) - len(e) >= 4}

    def put(w: str, at, letter: str) -> str:
        return "".join((letter if c.islower() else letter.upper()) if i in at else c for i, c in enumerate(w))

    def family(w: str) -> bool:
        low = repair.folded(w)
        return len(w) >= 6 and any(low.endswith(e) and len(low) - len(e) >= 4 and low[: len(low) - len(e)] in stems for e in X.ENDINGS)

    def flip(w: str, high: float, always: bool):
        at = [i for i, x in p[w].items() if x >= high]
        if w.lower().startswith("fc") or not at or any(0.1 < x < high for x in p[w].values()):
            return None
        new = put(w, at, "s")
        return new if repair.folded(new) in known or family(new) or not always and len(p[w]) == 1 else None

    def ct(w: str):
        places = [i for i in range(len(w) - 1) if w[i] in "fF" and w[i + 1] in "tT"]
        able = [i for i in places if p[w][i] <= 0.15]
        if not 1 <= len(places) <= 4 or not able:
            return None
        for k in range(len(able), 0, -1):
            for chosen in combinations(able, k):
                if repair.folded(put(w, chosen, "c")) in known:
                    return put(w, chosen, "c")
        return put(w, able, "c") if family(put(w, able, "c")) else None

    want = {w: (flip(w, 0.9, False), flip(w, 0.7, True), ct(w)) for w in words}
    assert got == {w: x for w, x in want.items() if any(x)}
    assert sum(x[0] is not None for x in want.values()) > 5 and sum(x[2] is not None for x in want.values()) > 0


def test_tiers_over_texts(spark):
    entries, v = decided(spark, {"ufurarum": {1: 0.876}, "eft": {1: 0.95}, "diftum": {2: 0.1}}, ["usuram", "usuras", "est", "dictum"])
    plan = spark.createDataFrame([(w, *e) for w, e in entries.items()], "word string, single string, merged string, ct string")
    rows = [(1, "u fur arum eft"), (2, "1eft dif-tum diftum"), (3, None), (3, ""), (None, "est modo fuit")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    model = {(r["doc_id"], r["text"]): (r["n_changes"], r["n_unresolved"]) for r in repair.apply_tier(texts, v, plan, "model").collect()}
    assert model == {(1, "usurarum est"): (2, 0), (2, "1est dif-tum diftum"): (1, 2), (3, ""): (0, 0), (None, "est modo fuit"): (0, 1)}
    ct = {r["text"] for r in repair.apply_tier(texts, v, plan, "ct").collect()}
    assert "1eft dif-tum dictum" in ct


def test_training_examples(spark):
    v = spark.createDataFrame([("sfas", 1), ("actfs", 1), ("f", 1), ("ct", 1)], "word string, freq long")
    got = sorted((r["word"], r["window"], r["label"], r["kind"]) for r in repair.training_examples(v).collect())
    assert got == sorted([
        ("sfas", "^^^^s@as$$$", 0, "genuine_f"), ("sfas", "^^^^^@fas$$", 1, "long_s"),
        ("actfs", "^^act@s$$$$", 0, "genuine_f"), ("actfs", "^^^^a@tfs$$", 0, "ct_adversarial"), ("ct", "^^^^^@t$$$$", 0, "ct_adversarial"),
    ])


def test_classifier_separates(spark):
    r = random.Random(2)
    vocab = ["".join(r.choice(["si", "sta", "os", "esse", "fu", "fra", "fe"]) for _ in range(3)) for _ in range(300)]
    examples = repair.training_examples(spark.createDataFrame([(w, 1) for w in set(vocab)], "word string, freq long"))
    model = repair.fit_classifier(examples.where("not held_out"))
    scored = repair.classified(model, examples.where("held_out")).select("label", "p").collect()
    right = sum((x["p"] > 0.5) == (x["label"] == 1) for x in scored) / len(scored)
    assert right > 0.9
    n = examples.where("not held_out").count()
    assert model.stages[-1].getRegParam() == pytest.approx(1 / (4 * n))


def test_page_alignment(spark):
    """Against a walk over the pages, segment by segment."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(5))
    pages = [" ".join(word() for _ in range(30)) for _ in range(120)]
    segments = []
    at = 0
    for _ in range(200):
        at = min(119, at + r.choice([0, 0, 0, 0, 0, 0, 1, 1, 2]))
        words = pages[at].split()
        k = r.randrange(25)
        segments.append(r.choice(["Gone missing from all pages", "short", None, "  " + " ".join(words[k : k + 5]).upper() + "!"]))
    page = missed = 0
    want = []
    for s in segments:
        key = "".join(c for c in (s or "").lower() if c.isalnum())[:20]
        hit = None
        if len(key) >= 10:
            for j in range(page, min(page + min(6 + 6 * missed, 80), 120)):
                if key in pages[j].replace(" ", ""):
                    hit = j
                    break
            missed = 0 if hit is not None else missed + 1
        page = page if hit is None else hit
        want.append((page, hit is not None))
    left = spark.createDataFrame([(1, i, s) for i, s in enumerate(segments)], "doc_id long, pos int, text string")
    right = spark.createDataFrame([(1, i, s) for i, s in enumerate(pages)] + [(2, 0, None)], "doc_id long, page int, text string")
    got = alignment.align_pages(left, right).orderBy("pos").collect()
    assert [(x["page"], x["confident"]) for x in got] == want and sum(x[1] for x in want) > 30


def test_recovery_join(spark):
    garbled = spark.createDataFrame([(1, "arm4 virumqve cano"), (2, "nowhere"), (3, "lost page")], "id long, text string")
    places = spark.createDataFrame([(1, 7), (2, 7), (3, 9)], "id long, page long")
    old = spark.createDataFrame([(7, "xx arm4 virumqve cano troiae qui")], "page long, text string")
    new = spark.createDataFrame([(7, "xx arma virumque cano, troiae qui"), (9, "y")], "page long, text string")
    got = alignment.recovered(garbled, places, old, new).collect()
    assert [(x["id"], x["text"]) for x in got] == [(1, "arma virumque cano")]


def test_best_match_is_exact(spark):
    from difflib import SequenceMatcher

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcde1") for _ in range(r.randint(1, 5)))
    some = lambda: " ".join(word() for _ in range(r.randint(0, 4)))
    entries = [(i, some(), some()) for i in range(60)]
    matcher = alignment.Matcher(entries, 0.1)
    for _ in range(150):
        want, author = some(), r.choice(["", word()])
        ratio = lambda t, c: min(1.0, SequenceMatcher(None, want, t).ratio() + (0.1 if author and author in c else 0))
        score, place = max((ratio(t, c), -i) for i, t, c in entries)
        got = matcher.best(want, author)
        assert got[3] <= 60 and (got[0], got[1]) == (-place, pytest.approx(score))
    wanted = spark.createDataFrame(
        [(1, "carmina", ""), (2, "vita antonii", "athanasius"), (3, None, None)], "id long, key string, author_key string"
    )
    shelf = spark.createDataFrame(
        [(5, "carmina", "x"), (6, "vita antoni", "athanasius"), (7, None, None)], "ord long, title_key string, context_key string"
    )
    got = {x["id"]: (x["ord"], x["confident"]) for x in alignment.best_matches(wanted, shelf).collect()}
    assert got == {1: (None, False), 2: (6, True), 3: (None, False)}  # generic titles need the author
    assert [tuple(x) for x in alignment.best_matches(wanted.where("id = 1"), shelf.limit(0)).collect()] == [(1, None, None, False, 0)]


@pytest.mark.parametrize("sizes", [(2000, 500), (7, 4)])
def test_best_matches_against_all_pairs(spark, monkeypatch, sizes):
    """Scores on both sides of every round's floor, ties, repeated and empty strings, authors; not all pairs are tried."""
    from difflib import SequenceMatcher

    monkeypatch.setattr(alignment, "ENTRIES", sizes[0])
    monkeypatch.setattr(alignment, "KEYS", sizes[1])
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghiklmnopqrst") for _ in range(r.randint(2, 9)))
    some = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    titles = [some() for _ in range(120)] + ["", "vita", "a"]
    entries = [(i, t, r.choice(["", "caesar", "plinius minor"])) for i, t in enumerate(titles + titles[:9])] + [(900, None, None)]
    changed = lambda t: t[: len(t) // 3] + r.choice(["", "x", "uvw", "uvwxyzuvw"]) + t[len(t) // 3 + r.randint(0, 4) :]
    wanted = [(i, changed(r.choice(titles)), r.choice(["", "caesar", "minor"])) for i in range(150)]
    wanted += [(200 + i, k, a) for i, (k, a) in enumerate([("", ""), ("", "caesar"), (None, None), ("zzzz", ""), ("zzzz", "caesar"), ("a", "")])]
    w = spark.createDataFrame(wanted, "id long, key string, author_key string")
    c = spark.createDataFrame(entries, "ord long, title_key string, context_key string")
    got = {x["id"]: x for x in alignment.best_matches(w, c).collect()}
    generic = dict(w.select("id", X.is_generic_title(F.coalesce("key", F.lit(""))).alias("g")).collect())
    for i, key, author in wanted:
        key, author = key or "", author or ""
        all_ = []
        for o, t, context in entries:
            named = bool(author) and author in (context or "")
            ratio = SequenceMatcher(None, key, t or "").ratio()
            all_.append((min(1.0, ratio + 0.1) if named else ratio, -o, named))
        score, place, named = max(all_)
        sure = score >= 0.62 and (named or not generic[i])
        assert (got[i]["ord"], got[i]["confident"]) == (-place if sure else None, sure), (key, author)
        assert got[i]["score"] == pytest.approx(score, abs=1e-6)
    assert sum(x["tried"] for x in got.values()) < 0.5 * len(wanted) * len(entries)


def test_good_matches_need_no_blocks(spark, monkeypatch):
    """Titles near enough are found by pieces that they share, as against all pairs; only what has none goes on to blocks of all entries."""
    from difflib import SequenceMatcher

    monkeypatch.setattr(alignment, "WORTH", 0)
    r = random.Random(5)
    some = lambda most: "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, most))).strip()
    titles = [some(r.choice([9, 40, 130])) for _ in range(150)] + ["", "anwhan " * 8, "anwhan " * 9]
    contexts = ["", "caesar", "plinius minor"]
    entries = [(1000 - i, t, r.choice(contexts)) for i, t in enumerate(titles + titles[:20])] + [(1, None, None)]

    def changed(t):
        for _ in range(r.randint(0, 1 + len(t) // 15)):
            at = r.randint(0, len(t))
            t = t[:at] + r.choice(["", "x", "ab"]) + t[at + r.randint(0, 1) :]
        return t

    wanted = [(i, changed(r.choice(titles)), r.choice(["", "", "caesar", "minor"])) for i in range(200)] + [(300, "", "caesar"), (301, None, None)]
    w = spark.createDataFrame(wanted, "id long, key string, author_key string")
    c = spark.createDataFrame(entries, "ord long, title_key string, context_key string")
    keys = w.selectExpr("id AS kid", "coalesce(key, '') AS key").coalesce(1)
    shelf = c.selectExpr("ord AS eid", "coalesce(title_key, '') AS title_key").coalesce(1)
    for floor in alignment.PIECES:
        got = {tuple(x) for x in alignment.by_pieces(keys, shelf, floor).collect()}
        want = {(i, o) for i, k, _ in wanted for o, t, _ in entries if SequenceMatcher(None, k or "", t or "").ratio() >= floor}
        assert want <= got and len(want) > 30

    met, by_blocks = [], alignment.by_blocks
    monkeypatch.setattr(alignment, "by_blocks", lambda todo, *rest: met.append({x["key"] for x in todo.collect()}) or by_blocks(todo, *rest))
    found, best = {x["id"]: x for x in alignment.best_matches(w, c).collect()}, {}
    for i, key, author in wanted:
        key, author = key or "", author or ""
        ratio = lambda t, context: min(1.0, SequenceMatcher(None, key, t).ratio() + (0.1 if author and author in context else 0))  # noqa: B023, E731
        best[i] = max((ratio(t or "", context or ""), -o) for o, t, context in entries)
        assert found[i]["score"] == pytest.approx(best[i][0], abs=1e-6) and (found[i]["ord"] is None or found[i]["ord"] == -best[i][1])
    sure = {k or "" for i, k, a in wanted if not a and best[i][0] >= alignment.PIECES[-1]}
    weak = {k or "" for i, k, a in wanted if best[i][0] < alignment.PIECES[-1]}
    asked = {k or "" for _, k, a in wanted if a}
    assert len(sure) > 50 and weak <= met[0] and not (sure - asked) & met[0]


def test_a_chain_looks_for_nothing_below_its_threshold(spark, monkeypatch):
    from lectern.plans import enrich

    floors, by_blocks = [], alignment.by_blocks
    monkeypatch.setattr(alignment, "by_blocks", lambda todo, blocks, floor, bonus: floors.append(floor) or by_blocks(todo, blocks, floor, bonus))
    wanted = spark.createDataFrame([(1, "troiae excidium", ""), (2, "zzzz", "")], "id long, key string, author_key string")
    shelf = spark.createDataFrame([(7, "troiae excidiu", ""), (8, "epodi", "")], "ord long, title_key string, context_key string")
    got = enrich.status_chain(wanted, [("free", shelf, "translated")], threshold=0.7)
    assert sorted(tuple(x) for x in got.collect()) == [(1, "translated", "free", 7), (2, "unknown", None, None)]
    assert floors == [0.85, 0.7]


def test_all_pairs_at_once_are_as_one_by_one(monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 4)
    r = random.Random(2)
    for asked in (0.0, 0.3, 0.62, 0.9):
        some = lambda: "".join(r.choice("abcd") for _ in range(r.choice([0, 1, 9, 40, 70])))
        a, b, kinds = alignment.Letters.both([some() for _ in range(9)], [some() for _ in range(150)])
        for i, row in enumerate(alignment.common_all(a, b, kinds, 2, 9, asked), 2):
            for j, got in enumerate(row):
                x, y = a.texts[i], b.texts[j]
                above = [0] * (len(y) + 1)
                for c in x:
                    here = [0]
                    for k, d in enumerate(y):
                        here.append(above[k] + 1 if c == d else max(above[k + 1], here[k]))
                    above = here
                assert got == above[-1] or got < above[-1] and 2 * above[-1] < asked * (len(x) + len(y))


def test_authors_are_found_by_pieces_where_the_bonus_is_enough(spark, monkeypatch):
    monkeypatch.setattr(alignment, "WORTH", 0)
    monkeypatch.setattr(alignment, "by_blocks", None)
    shelf = [(i, f"q{i * 7919:012d}", f"by author {i}.") for i in range(100, 200)] + [(300, "q000000870909x", "by none")]
    c = spark.createDataFrame(shelf, "ord long, title_key string, context_key string")
    w = spark.createDataFrame([(1, shelf[10][1][:-1], "author 110."), (2, shelf[20][1], "")], "id long, key string, author_key string")
    got = {x["id"]: (x["ord"], x["score"], x["confident"]) for x in alignment.best_matches(w, c).collect()}
    assert got == {1: (110, 1.0, True), 2: (120, 1.0, True)}


def test_greedy_alignment_and_band(spark):
    sides = spark.createDataFrame([("a", 5, 3), ("b", 0, 4), ("c", 2, 9)], "key string, n int, m int")
    got = {(x["key"], x["i"], x["j"]) for x in alignment.band_candidates(sides, 1).collect()}
    want = {(k, i, j) for k, n, m in (("a", 5, 3), ("c", 2, 9)) for i in range(n) for j in range(m) if abs(j - round(i * m / n)) <= 1}
    assert got == want
    pairs = spark.createDataFrame(
        [("k", ["alpha beta gamma delta epsilon", "x"], ["alpha beta gamma delta epsilon", "y"]), ("e", [], [])],
        "key string, src array<string>, tgt array<string>",
    )
    assert [(x["i"], x["j"]) for x in alignment.align_sentences(pairs, "key").collect()] == [(0, 0)]


def test_only_unknown_words_and_their_merges_are_looked_up(spark):
    texts = spark.createDataFrame([(1, "terra fama et fol fi lius terra"), (2, None), (3, "fama fol9 f")], "doc_id long, text string")
    known = spark.createDataFrame([("terra", 1), ("fama", 2), ("et", 3), ("sol", 4), ("filius", 5)], "word string, freq long")
    asked = []

    def fixes(words):
        asked.append({r["word"] for r in words.collect()})
        return library.best_fixes(words, known, library.stems(known)).unionByName(
            words.where("word = 'filius'").selectExpr("word", "'filius' AS exact", "CAST(NULL AS STRING) AS stem")
        )

    rows = {r["doc_id"]: r for r in repair.corrected(texts, known, fixes).collect()}
    assert asked == [{"fol", "fi"}, {"filius", "filiusterra"}]
    assert rows[1]["text"] == "terra fama et sol filius terra" and rows[1]["changes"] == ["fol\tsol", "fi lius\tfilius"]
    assert rows[2]["text"] == "" and rows[3]["text"] == "fama fol9 f" and rows[3]["n_unresolved"] == 1


def test_best_fixes_are_those_of_all_variants(spark):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 11)))
    known = {repair.folded(word("fsae") + rng.choice(["", "us", "is", "as"])): i for i, _ in enumerate(range(400))}
    words = sorted({word("fFsSae") + rng.choice(["", "uf", "if", "us", "af"]) for _ in range(600)})
    v = spark.createDataFrame(list(known.items()), "word string, freq long")
    stems = library.stems(v)
    stem_set = {r["stem"] for r in stems.collect()}
    rows = {r["word"]: (r["exact"], r["stem"]) for r in library.best_fixes(spark.createDataFrame([(w,) for w in words], "word string"), v, stems).collect()}
    for w in words:
        at = [i for i, c in enumerate(w) if c in "fF"]
        exact, family = [], []
        for n in range(1, len(at) + 1) if len(at) <= 6 else ():
            for chosen in combinations(at, n):
                form = "".join({"f": "s", "F": "S"}[c] if i in chosen else c for i, c in enumerate(w))
                key, order = repair.folded(form), [0 if i in chosen else 1 for i in at]
                if key in known:
                    exact.append(((-n, -known[key], order), form))
                if len(key) >= 6 and any(key.endswith(e) and key[: -len(e)] in stem_set for e in X.ENDINGS if len(key) - len(e) >= 4):
                    family.append(((n, order), form))
        assert rows[w] == tuple(min(x)[1] if x else None for x in (exact, family)), w
    assert any(a for a, _ in rows.values()) and any(b for _, b in rows.values())


def test_order_of_letters_bounds_the_entries_tried():
    """Texts of the same letters in other orders: letters alone would have all of them tried."""
    from difflib import SequenceMatcher

    rng = random.Random(3)
    mixed = lambda: "".join(rng.sample("0123456789abcdef" * 2, 32))
    entries = [(i, mixed(), "by author 7.") for i in range(200)] + [(200, "", ""), (201, "0f" * 600, "")]
    matcher = alignment.Matcher(entries, 0.1)
    for want in (entries[7][1][:-2], mixed(), mixed() + mixed() + mixed(), "", "éé"):
        for author in ("", "author 7."):
            ratios = [min(1.0, SequenceMatcher(None, want, t).ratio() + (0.1 if author and author in c else 0)) for _, t, c in entries]
            ord_, score, _, tried = matcher.best(want, author)
            assert (ord_, score) == (ratios.index(max(ratios)), max(ratios))
    assert matcher.best(entries[7][1][:-2], "", 0.62)[3] <= 2 and matcher.best("0123456789abcdef", "", 0.99) is None
