"""OCR repair over token arrays (STR-14..19, AGG-09, ML-01, ML-02, SNK-08).

All looking up is done by joins on distinct words; a text then travels with its own words' entries alone, so no dictionary
is ever held whole, on the driver or in a worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .tables import fresh, stored

TOKENS = re.compile(r"\s+|[A-Za-z]+|[^A-Za-z\s]+").findall
FOLDED = str.maketrans("vVUjJI", "uuuiii")
CANDIDATE = "word is not null and length(word) between 2 and 20 and lower(word) like '%f%'"
# fixed values: confidence bands of the classifier tiers
SINGLE_HIGH, MERGE_HIGH, LOW, CT_MOST, CT_PLACES = 0.9, 0.7, 0.1, 0.15, 4


def folded(w: str) -> str:
    return w.translate(FOLDED).lower()


def _word(token: str) -> bool:
    return token.isascii() and token.isalpha()


def _merges(tokens: list[str], i: int):
    """(tokens taken, as they stand, joined) for 2 and 3 words from i with white space between."""
    for pieces in (2, 3):
        span = tokens[i : i + 2 * pieces - 1]
        if len(span) == 2 * pieces - 1 and all(map(str.isspace, span[1::2])) and all(map(_word, span[::2])):
            whole = "".join(span[::2])
            if 5 <= len(whole) <= 20 and "f" in whole.lower():
                yield len(span), span, whole


class Dictionary:
    """Known words and the fixes of words with f, as computed by best_fixes()."""

    def __init__(self, known: set[str], fixes: dict[str, tuple[str | None, str | None]]):
        self.known, self.fixes = known, fixes


def correct(text: str, words: Dictionary, merge: bool = True) -> tuple[str, list, list, list]:
    """STR-16: known words and words beside digits stay; else a single fix, a merge of 2 or 3 pieces, or a suggestion."""
    tokens = TOKENS(text or "")
    out, changes, suggestions, unresolved = [], [], [], []
    i = 0
    while i < len(tokens):
        t, step, new = tokens[i], 1, None
        digit = (i and tokens[i - 1][-1:].isdigit()) or tokens[i + 1 : i + 2] and tokens[i + 1][:1].isdigit()
        if _word(t) and not digit and folded(t) not in words.known:
            exact, stem = words.fixes.get(t, (None, None))
            if exact:
                new = exact
                changes.append((t, exact))
            else:
                for taken, span, whole in _merges(tokens, i) if merge else ():
                    fix, near = words.fixes.get(whole, (None, None))
                    if fix:
                        step, new = taken, fix
                        changes.append(("".join(span), fix))
                        break
                    if near:
                        suggestions.append(("".join(span), near))
                if new is None and stem:
                    suggestions.append((t, stem))
                elif new is None and "f" in t.lower():
                    unresolved.append(t)
        out.append(t if new is None else new)
        i += step
    return "".join(out), changes, suggestions, unresolved


def pieces() -> Column:
    """The words of text and their merges of 2 and 3."""
    w = X.letter_words("text")
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, b))
    triples = F.zip_with(pairs, F.slice(w, F.lit(3), F.size(w)), lambda a, b: F.concat(a, b))
    return F.concat(w, pairs, triples)


def candidates(texts: DataFrame) -> DataFrame:
    """Distinct words and 2- or 3-piece merges with f in texts: what the tiers must look up."""
    return texts.select(F.explode(pieces()).alias("word")).where(CANDIDATE).distinct()


Tier = Callable[[str, set, dict], tuple[str, list, list, list]]
Lookup = Callable[[DataFrame], DataFrame]
RESULT = "doc_id long, text string, n_changes int, n_suggestions int, n_unresolved int, changes array<string>"


class Known:
    """The words of a text but for its unknown ones, which alone travel with it."""

    def __init__(self, unknown):
        self.unknown = {folded(w) for w in unknown}

    def __contains__(self, w: str) -> bool:
        return w not in self.unknown


def _merged(rows: DataFrame, fix: str) -> DataFrame:
    """(key, word): the merges of 2 and 3 pieces that start at an unknown word of a text without a fix of its own."""

    def run(batches):
        for batch in batches:
            out = set()
            for key, text, listed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                starts, tokens = {x["word"] for x in listed if not (x["entry"] or {}).get(fix)}, TOKENS(text)
                for i, t in enumerate(tokens):
                    if t in starts:
                        out.update((key, whole) for _, _, whole in _merges(tokens, i))
            kinds = [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["key", "word"])

    some = F.exists("listed", lambda x: x["entry"][fix].isNull())
    return rows.where(some).select("key", "text", "listed").mapInArrow(run, "key long, word string")


def _each_text(texts: DataFrame, known: DataFrame, lookup: Lookup, tier: Tier, fix: str | None) -> DataFrame:
    """RESULT of tier(text, known words, entries by word).

    lookup gives entries (word, entry) for distinct words. With fix it is asked for the unknown words that may be put right, then for the merges
    that start at unknown words whose entry has no such field; without, for all words that may be put right and no merges. A text meets
    only its own unknown words and entries.
    """
    keyed = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text", F.length("text")))
    each = keyed.select("key", "text").dropDuplicates(["key"])
    own = each.select("key", F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+"))).alias("word")).where("word <> ''")
    if fix:
        distinct = own.select("word").distinct().withColumn("folded", X.fold("word"))
        words = stored(distinct.join(known.select(F.col("word").alias("folded")).distinct(), "folded", "left_anti").select("word"), "unknown")
        own_entries = stored(words.join(lookup(words.where(CANDIDATE)), "word", "left"), "entries")
    else:
        own_entries = stored(lookup(own.select("word").where(CANDIDATE).distinct()), "entries")
    listed = own.join(own_entries, "word").groupBy("key").agg(F.collect_list(F.struct("word", "entry")).alias("listed"))
    rows = each.join(listed, "key", "left")
    if fix:
        rows = stored(rows, "rows")
        merges = stored(_merged(rows, fix), "merges")
        found = lookup(merges.select("word").distinct()).where("entry is not null")
        found = merges.join(found, "word").groupBy("key").agg(F.collect_list(F.struct("word", "entry")).alias("merged"))
        rows = rows.join(found, "key", "left")
    else:
        rows = rows.withColumn("merged", F.col("listed"))
    rows = keyed.select("doc_id", "key").join(rows, "key").select("doc_id", "text", "listed", "merged")
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
    names = [part.split()[0] for part in RESULT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                singles, merged = (x or () for x in found)
                entries = {x["word"]: x["entry"] for x in (*merged, *singles) if x["entry"]}
                t, *lists = tier(text, Known(x["word"] for x in singles), entries)
                rows.append((doc_id, t, *map(len, lists), [f"{a}\t{b}" for a, b in lists[0]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return rows.mapInArrow(run, RESULT)


def corrected(texts: DataFrame, known: DataFrame, fixes: DataFrame | Lookup) -> DataFrame:
    """STR-16 for texts (doc_id, text) with fixes (word, exact, stem), or what gives them for words. Null texts count as empty."""

    def tier(text: str, own: set, entries: dict):
        return correct(text, Dictionary(own, {w: (e["exact"], e["stem"]) for w, e in entries.items()}))

    def lookup(words: DataFrame) -> DataFrame:
        found = fixes(words) if callable(fixes) else words.join(fixes, "word")
        return found.where("exact is not null or stem is not null").select("word", F.struct("exact", "stem").alias("entry"))

    return _each_text(texts, known, lookup, tier, "exact")


def change_log(result: DataFrame) -> DataFrame:
    """AGG-09, SNK-08: (old, new, n)."""
    c = result.select(F.explode("changes").alias("c"))
    old, new = (F.split_part("c", F.lit("\t"), F.lit(i)) for i in (1, 2))
    return c.groupBy(old.alias("old"), new.alias("new")).agg(F.count("*").alias("n"))


def write_change_log(result: DataFrame, path: str) -> None:
    """SNK-08: the change log as tab-separated files, most frequent first."""
    change_log(result).orderBy(F.desc("n"), "old", "new").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def corroborated(cases: DataFrame, vocab: DataFrame, stem_table: DataFrame) -> DataFrame:
    """cases (..., candidate) with exact: a known word, and stem: an inflection of a known stem (STR-15)."""
    distinct = cases.select("candidate").where("candidate is not null").distinct().withColumn("key", X.fold("candidate"))
    exact = distinct.join(
        vocab.select(F.col("word").alias("key")).distinct(), "key", "left_semi"
    ).select("candidate", F.lit(True).alias("exact"))
    stems = distinct.where("length(candidate) >= 6").select("candidate", F.explode(X.stem_cuts("key")).alias("stem"))
    stems = stems.join(stem_table, "stem", "left_semi").select("candidate", F.lit(True).alias("stem")).distinct()
    joined = cases.join(exact, "candidate", "left").join(stems, "candidate", "left")
    return joined.withColumn("exact", F.coalesce("exact", F.lit(False))).withColumn("stem", F.coalesce("stem", F.lit(False)))


def _flipped(high: float) -> Column:
    """The word with its sure long s's put right; null where a place is unsure, none is sure, or an initial f stands before c."""
    sure = F.transform(F.filter("f", lambda x: x["p"] >= high), lambda x: x["pos"])
    unsure = F.exists("f", lambda x: (x["p"] < high) & (x["p"] > LOW))
    risky = F.lower("word").startswith("fc")
    return F.when(~unsure & ~risky & (F.size(sure) > 0), X.substituted("word", sure, "s"))


def decisions(words: DataFrame, probabilities: DataFrame, vocab: DataFrame, stem_table: DataFrame) -> DataFrame:
    """STR-18, STR-19: (word, single, merged, ct) of words by probabilities (word, pos, p) of a long s at each f.

    single: as a token of its own, with the vocabulary's support where it has several f's. merged: joined from pieces, with
    support always and a lower bar. ct: f's before t read as c, for at most CT_PLACES of them; the largest choice of places
    that gives a known word, the first of equal ones, else all places if that is an inflection of a known stem.
    """
    per = probabilities.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("f"))
    per = words.select("word").distinct().join(per, "word")
    tiers = [F.struct(F.lit(kind).alias("kind"), _flipped(high).alias("candidate")) for kind, high in (("single", SINGLE_HIGH), ("merged", MERGE_HIGH))]
    both = per.select("word", F.size("f").alias("n"), F.explode(F.array(*tiers)).alias("c"))
    both = corroborated(both.select("word", "n", "c.*").where("candidate is not null"), vocab, stem_table)
    both = both.where("exact or stem or (kind = 'single' and n = 1)")
    found = both.groupBy("word").agg(*[F.max(F.when(F.col("kind") == k, F.col("candidate"))).alias(k) for k in ("single", "merged")])
    before_t = F.filter("f", lambda x: F.lower(F.substring(F.col("word"), x["pos"] + 2, F.lit(1))) == "t")
    eligible = F.transform(F.filter(before_t, lambda x: x["p"] <= CT_MOST), lambda x: x["pos"])
    ct = per.where(F.size(before_t).between(1, CT_PLACES)).select("word", eligible.alias("at")).where("size(at) > 0")
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("at")) - 1)
    ct = ct.select("word", "at", F.explode(masks).alias("mask"))
    chosen = F.filter("at", lambda x, i: F.getbit(F.col("mask").cast("long"), i) == 1)
    ct = ct.select("word", chosen.alias("chosen"), (F.size(chosen) == F.size("at")).alias("all"))
    ct = corroborated(ct.withColumn("candidate", X.substituted("word", F.col("chosen"), "c")), vocab, stem_table)
    # places in order: the choice with the lowest first place comes first
    rank = F.struct((~F.col("exact")).alias("a"), (-F.size("chosen")).alias("b"), F.col("chosen").alias("c"))
    ct = ct.where("exact or (`all` and stem)").groupBy("word").agg(F.min_by("candidate", rank).alias("ct"))
    return words.select("word").distinct().join(found, "word", "left").join(ct, "word", "left").where(
        "single is not null or merged is not null or ct is not null"
    )


def model_pass(text: str, known: set, entries: dict) -> tuple[str, list, list, list]:
    """STR-18 over a text: known words stay; a sure single fix, else a supported merge of 2 or 3 pieces."""
    tokens = TOKENS(text)
    out, changes, unresolved = [], [], []
    i = 0
    while i < len(tokens):
        t, step, new = tokens[i], 1, None
        if _word(t) and folded(t) not in known:
            new = (entries.get(t) or {}).get("single")
            if new:
                changes.append((t, new))
            else:
                for taken, span, whole in _merges(tokens, i):
                    fix = (entries.get(whole) or {}).get("merged")
                    if fix:
                        step, new = taken, fix
                        changes.append((" ".join(span[::2]), fix))
                        break
            if not new and "f" in t.lower():
                unresolved.append(t)
        out.append(new or t)
        i += step
    return "".join(out), changes, [], unresolved


def ct_pass(text: str, known: set, entries: dict) -> tuple[str, list, list, list]:
    """STR-19 over a text: single tokens only."""
    out, changes = [], []
    for t in TOKENS(text):
        new = (entries.get(t) or {}).get("ct") if _word(t) else None
        if new:
            changes.append((t, new))
        out.append(new or t)
    return "".join(out), changes, [], []


def apply_tier(texts: DataFrame, vocab: DataFrame, decided: DataFrame | Lookup, tier: str) -> DataFrame:
    """RESULT of the "model" or "ct" tier for texts (doc_id, text); decided: the decisions, or what gives them for words."""

    def lookup(words: DataFrame) -> DataFrame:
        found = decided(words) if callable(decided) else words.join(decided, "word")
        return found.select("word", F.struct("single", "merged", "ct").alias("entry"))

    return _each_text(texts, vocab, lookup, *{"model": (model_pass, "single"), "ct": (ct_pass, None)}[tier])


def training_examples(vocab: DataFrame) -> DataFrame:
    """ML-02, SMP-02: (word, window, label, kind, held_out), split by word.

    genuine_f: each f of a word as it is, label 0. long_s: the word with every s but a final one written as f, label 1 at
    those places. ct_adversarial: the word with every c before t written as f, label 0 at those places.
    """
    w = vocab.where(F.length("word") >= 2).select("word").distinct()
    chars = F.split("word", "")
    pick = lambda test: F.filter(F.transform(chars, lambda c, i: F.when(test(c, i), i)), lambda i: i.isNotNull())
    long_s = pick(lambda c, i: (c == "s") & (i < F.length("word") - 1))
    before_t = pick(lambda c, i: (c == "c") & (F.get(chars, i + 1) == "t"))
    kinds = [
        ("genuine_f", 0, X.places("word", "f"), F.col("word")),
        ("long_s", 1, long_s, X.substituted("word", long_s, "f")),
        ("ct_adversarial", 0, before_t, X.substituted("word", before_t, "f")),
    ]
    parts = None
    for kind, label, at, form in kinds:
        part = w.select("word", F.explode(X.windows_at(form, at)).alias("window"), F.lit(label).alias("label"), F.lit(kind).alias("kind"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("held_out", F.pmod(F.xxhash64("word"), F.lit(10)) == 0)


def _grams(column: str) -> Column:
    """The 2- to 5-grams of characters."""
    return F.flatten(F.array(*[_runs(column, n) for n in range(2, 6)]))


def _runs(column: str, n: int) -> Column:
    starts = F.when(F.length(column) >= n, F.sequence(F.lit(1), F.length(column) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(n)))


def fit_classifier(examples: DataFrame, column: str = "window", c: float = 4.0):
    """ML-01: character n-grams (2 to 5, in two examples at least) and logistic regression with balanced classes.

    The penalty of one unit over c against the summed loss is 1 / (c * n) against the mean loss of weights that sum to n.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    weight = F.create_map(*[F.lit(x) for k, m in sizes.items() for x in (k, n / (2.0 * m))])[F.col("label")]
    rows = examples.withColumn("weight", weight)
    stages = [
        CountVectorizer(inputCol="grams", outputCol="features", minDF=2.0, vocabSize=1 << 22),
        LogisticRegression(weightCol="weight", regParam=1 / (c * max(n, 1)), maxIter=100, standardization=False),
    ]
    path = fresh(examples.sparkSession, "classifier")
    Pipeline(stages=stages).fit(rows.withColumn("grams", _grams(column))).write().save(path)
    return PipelineModel.load(path)  # without its training summary, whose session can't go to tasks once it observes a job


def classified(model, examples: DataFrame, column: str = "window") -> DataFrame:
    """examples with prediction and p, the probability of a long s."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(examples.withColumn("grams", _grams(column)))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("grams", "features", "rawPrediction", "probability")


def probabilities(model, words: DataFrame) -> DataFrame:
    """STR-17: (word, pos, p) for every f of distinct words; each distinct window is scored once."""
    at = F.arrays_zip(X.places("word", "f").alias("pos"), X.context_windows("word").alias("window"))
    each = words.select("word").distinct().select("word", F.explode(at).alias("x")).select("word", "x.*")
    return each.join(classified(model, each.select("window").distinct()).select("window", "p"), "window").select("word", "pos", "p")
