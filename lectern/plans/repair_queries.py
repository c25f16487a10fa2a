"""Queries of OCR repair, page recovery and their classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alignment, library, repair
from ..operators.tables import stored
from .queries import VOCAB, query, segments, table

_WINDOW = "substr('^^^^^' || f || '$$$$$', i, 5) || '@' || substr('^^^^^' || f || '$$$$$', i + 6, 5)"
_WORDS = "w AS (SELECT DISTINCT word FROM v WHERE length(word) >= 2)"
_EXAMPLES = f"""g AS (SELECT word, word AS f, unnest(range(1, length(word) + 1)) AS i, 0 AS label, 'genuine_f' AS kind FROM w),
l AS (SELECT word, replace(left(word, length(word) - 1), 's', 'f') || right(word, 1) AS f, unnest(range(1, length(word))) AS i, 1 AS label, 'long_s' AS kind FROM w),
a AS (SELECT word, replace(word, 'ct', 'ft') AS f, unnest(range(1, length(word))) AS i, 0 AS label, 'ct_adversarial' AS kind FROM w),
e AS (SELECT * FROM g WHERE substr(word, i, 1) = 'f' UNION ALL SELECT * FROM l WHERE substr(word, i, 1) = 's' UNION ALL SELECT * FROM a WHERE substr(word, i, 2) = 'ct')"""


def vocabulary(spark, sf):
    return stored(library.vocabulary(table(spark, sf, "documents"), column="text"), "vocabulary")


@query(f"WITH {VOCAB}, {_WORDS}, {_EXAMPLES} SELECT word, {_WINDOW} AS \"window\", label, kind FROM e")
def ml02_training_examples(spark, sf):
    return repair.training_examples(vocabulary(spark, sf)).drop("held_out")


@query(f"WITH {VOCAB}, {_WORDS}, {_EXAMPLES} SELECT kind, label, count(*) AS n FROM e GROUP BY 1, 2")
def agg15_example_counts(spark, sf):
    return repair.training_examples(vocabulary(spark, sf)).groupBy("kind", "label").agg(F.count("*").alias("n"))


def _model(spark, sf):
    examples = stored(repair.training_examples(vocabulary(spark, sf)), "examples")
    return repair.fit_classifier(examples.where("not held_out")), examples


@query()
def ml01_long_s_classifier(spark, sf):
    model, examples = _model(spark, sf)
    right = (F.col("prediction") == F.col("label")).cast("int")
    return repair.classified(model, examples.where("held_out")).groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.avg(right), 4).alias("accuracy")
    )


def spoilt(spark, sf):
    """The documents with every s but final ones written as f, every fourth one with its words' ct as ft."""
    text = F.regexp_replace("text", "s(?=[a-z])", "f")
    return table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("ct"), F.lit("ft"))).otherwise(text).alias("text")
    )


def _decided(spark, sf):
    """The vocabulary, and what decides on words."""
    v = vocabulary(spark, sf)
    known_stems, model = stored(library.stems(v), "stems"), _model(spark, sf)[0]

    def of(words):
        words = stored(words, "words")
        return repair.decisions(words, stored(repair.probabilities(model, words), "probabilities"), v, known_stems)

    return v, of


@query()
def str18_model_tier(spark, sf):
    v, decided = _decided(spark, sf)
    return repair.apply_tier(spoilt(spark, sf), v, decided, "model").select(
        "doc_id", "n_changes", "n_unresolved", F.md5(F.col("text").cast("binary")).alias("digest")
    )


@query()
def str19_ct_tier(spark, sf):
    v, decided = _decided(spark, sf)
    return repair.apply_tier(spoilt(spark, sf), v, decided, "ct").select(
        "doc_id", "n_changes", F.md5(F.col("text").cast("binary")).alias("digest")
    )


@query()
def agg09_change_log(spark, sf):
    v = vocabulary(spark, sf)
    known_stems = stored(library.stems(v), "stems")
    return repair.change_log(repair.corrected(spoilt(spark, sf), v, lambda words: library.best_fixes(words, v, known_stems)))


@query()
def jon14_recovered(spark, sf):
    # every line is a page; the garbled ones are read anew, their old reading has other letters
    s = segments(spark, sf).select(
        "id", F.col("id").alias("page"), F.col("source_text").alias("new"), F.translate("source_text", "aeou", "4306").alias("old")
    )
    garbled = s.where(X.garble_score("new") >= 10)
    pages = garbled.select("page", F.col("old").alias("text")), garbled.select("page", F.col("new").alias("text"))
    return alignment.recovered(garbled.select("id", F.col("old").alias("text")), s.select("id", "page"), *pages)
