"""Enrichment plans with pluggable models (EMB-01, MT-01..03, STY-01..02, SCN-01, WIN-05, ENR-03..06, RAG-01).

A model is a function from a list of strings to a list of results, made once in each worker by its factory.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X

SLICE = 512  # rows of a model's results held at once


def apply_model(
    rows: DataFrame, key: str, column: str, factory: Callable[[], Callable[[list[str]], list]], kind: str = "string", batch: int = 32
) -> DataFrame:
    """EMB-01, EMB-04, MT-01, MT-04, MT-05, SRT-01, JON-15: (key, output, failed), by key and never by place.

    A worker holds the results of SLICE rows at a time. The factory makes the model once for each worker, when its first text comes. Batches hold texts of similar lengths; one
    that the model cannot hold is halved, and a text that fails alone gives the empty string, or null for other kinds, and
    counts as failed, so a resumed job tries it again. Blank texts of string models give the empty string without a call.
    """
    nothing = "" if kind == "string" else None
    arrow = to_arrow_type(T.StructType.fromDDL(f"x {kind}")["x"].dataType)

    def run(batches):
        model = None

        def call(texts: list[str]) -> list[tuple]:
            nonlocal model
            model = model or factory()
            try:
                return [(x, False) for x in model(texts)]
            except (RuntimeError, MemoryError, ValueError):  # the model's own limits; anything else is a fault of the job
                if len(texts) == 1:
                    return [(nothing, True)]
                half = len(texts) // 2
                return call(texts[:half]) + call(texts[half:])

        for table in batches:
            for at in range(0, table.num_rows, SLICE):
                rows = table.slice(at, SLICE)
                texts = [t or "" for t in rows.column(column).to_pylist()]
                out: list = [(nothing, False)] * len(texts)
                todo = sorted((i for i, t in enumerate(texts) if t.strip() or kind != "string"), key=lambda i: len(texts[i]))
                for i in range(0, len(todo), batch):
                    part = todo[i : i + batch]
                    for place, got in zip(part, call([texts[j] for j in part]), strict=True):
                        out[place] = got
                yield pa.RecordBatch.from_arrays(
                    [rows.column(key), pa.array([o[0] for o in out], arrow), pa.array([o[1] for o in out], pa.bool_())], [key, "output", "failed"]
                )

    return rows.select(key, F.col(column).cast("string").alias(column)).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, output {kind}, failed boolean")


def translation_input(segments: DataFrame, language: str = "language") -> DataFrame:
    """MT-03: what to do with each pending segment: placeholder, mixed or plain, and the text to translate."""
    garbled = X.garble_score("source_text") >= 10
    mixed = (F.col(language) == "la") & F.col("source_text").rlike(X.GREEK)
    return segments.where(~X.is_filled("english_text")).withColumn(
        "route", F.when(garbled, "placeholder").when(mixed, "mixed").otherwise("plain")
    )


def translated(segments: DataFrame, translate: Callable[[Column], Column]) -> DataFrame:
    t = translation_input(segments)
    return t.withColumn(
        "english_text",
        F.when(F.col("route") == "placeholder", F.lit(X.PLACEHOLDER)).when(
            F.col("route") == "mixed", X.mixed_translation("source_text", translate)
        ).otherwise(translate(F.col("source_text"))),
    )


def mark_garbled(segments: DataFrame) -> DataFrame:
    """ENR-06: the patch for garbled segments that are not marked yet."""
    new = (X.garble_score("source_text") >= 10) & ~F.coalesce(F.col("english_text") == X.PLACEHOLDER, F.lit(False))
    return segments.where(new).select(
        "id",
        F.lit(X.PLACEHOLDER).alias("english_text"),
        F.lit(X.PLACEHOLDER).alias("english_styled"),
        F.lit("placeholder").alias("style_label"),
    )


def first_confident(*statuses: Column) -> Column:
    """ENR-03, ENR-04: the first status that is known."""
    return F.coalesce(*[F.when(s != "unknown", s) for s in statuses], F.lit("unknown"))


def status_chain(wanted: DataFrame, lookups: list[tuple[str, DataFrame, str]], **options) -> DataFrame:
    """ENR-03, ENR-04: (id, status, lookup, ord) of wanted (id, key, author_key): the first lookup with a confident match decides.

    lookups: (name, catalogue (ord, title_key, context_key), status) in order. Each is asked only for what those before did not
    know; what none knows is unknown, with no lookup.
    """
    from ..operators.alignment import best_matches
    from ..operators.tables import stored

    left, found = wanted.select("id", "key", "author_key"), None
    for name, catalogue, status in lookups:
        matched = stored(best_matches(left, catalogue, sure_only=True, **options).where("confident").select("id", "ord"), "matched")
        known = matched.select("id", F.lit(status).alias("status"), F.lit(name).alias("lookup"), "ord")
        found = known if found is None else found.unionByName(known)
        left = left.join(matched.select("id"), "id", "left_anti")
    rest = left.select("id", F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("lookup"), F.lit(None).cast("long").alias("ord"))
    return rest if found is None else found.unionByName(rest)


def status_changes(documents: DataFrame, found: DataFrame, only_unknown: bool = True) -> DataFrame:
    """ENR-05: (id, old, new) where the found status (id, status) differs."""
    joined = documents.select("id", F.col("translation_status").alias("old")).join(found.select("id", F.col("status").alias("new")), "id")
    changed = joined.where(~F.equal_null("old", "new"))
    return changed.where(F.coalesce(F.col("old"), F.lit("unknown")) == "unknown") if only_unknown else changed


def meters(lines: DataFrame, meter: str = "elegiac") -> DataFrame:
    """WIN-05: the meter of each line; elegiac alternates by parity within a section."""
    w = Window.partitionBy("section_id").orderBy("ord")
    place = F.row_number().over(w)
    return lines.withColumn("meter", F.when(place % 2 == 1, "hexameter").otherwise("pentameter") if meter == "elegiac" else F.lit(meter))


def prompt_meta(author: Column, era: Column, source: Column, language: Column) -> Column:
    """STR-36: the context lines of a restyling prompt."""
    who = F.concat_ws(" · ", F.nullif(author, F.lit("")), F.nullif(era, F.lit("")))
    lines = F.array_compact(
        F.array(
            F.when(who != "", F.concat(F.lit("Source work: "), who, F.lit("."))),
            F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.coalesce(language, F.lit("original")), F.lit(" text: "), source)),
        )
    )
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")
