"""Restyling and scansion (STY-01..03, SCN-01, FLT-15, FLT-16, FLT-18): plans around pluggable models.

A generator is a function from (system, user) to a text; a scanner one from a line and a meter to a pattern or None.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import library
from ..operators.alignment import parse_numbered
from .enrich import meters

BATCH = 20
PRESETS = ("victorian_prose", "verse_blank", "verse_couplet", "modernize")
QUOTES = "\"'“", "\"'”"


def cleaned(text: str | None) -> str:
    """STR-36: stripped, without wrapping quotes."""
    t = (text or "").strip()
    return t[1:-1].strip() if len(t) >= 2 and t[0] in QUOTES[0] and t[-1] in QUOTES[1] else t


def restyled_units(units: list[str], generate: Callable[[str, str], str], system: str, instruction: str) -> list[str]:
    """STY-01: exactly one text for each unit: a whole passage with numbered lines, else one by one; blank units stay blank."""
    if len(units) > 1:
        numbered = "\n".join(f"{i}. {u.strip()}" for i, u in enumerate(units, 1))
        got = parse_numbered(
            generate(system, f"{instruction}\n\nKeep the numbers 1 to {len(units)}, one entry each:\n\n{numbered}"), len(units)
        )
        if got is not None:
            return list(map(cleaned, got))
    return [cleaned(generate(system, f"{instruction}\n\n{u.strip()}")) if u.strip() else "" for u in units]


def pending_style(segments: DataFrame) -> DataFrame:
    """STY-02, STM-02: translated segments that are not styled, with route: placeholder (copied through) or model."""
    todo = segments.where(X.is_filled("english_text") & ~X.is_filled("english_styled"))
    return todo.withColumn("route", F.when(F.col("english_text") == X.PLACEHOLDER, "placeholder").otherwise("model"))


def style_batches(segments: DataFrame, size: int = BATCH) -> DataFrame:
    """STY-02: pending segments for the model with their batch: `size` neighbours of a section at a time."""
    w = Window.partitionBy("section_id").orderBy("ord")
    rows = pending_style(segments).where("route = 'model'")
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def styled(
    segments: DataFrame,
    factory: Callable[[], Callable[[str, str], str]],
    preset: str,
    system: str = "",
    instruction: str = "",
    size: int = BATCH,
) -> DataFrame:
    """STY-02: the patch (id, english_styled, style_label) of pending segments; a batch that fails is halved, one that fails alone is left pending."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset}; one of {', '.join(PRESETS)}")

    def run(batches):
        generate = None

        def call(units: list[str]) -> list:
            try:
                return restyled_units(units, generate, system, instruction)
            except (RuntimeError, MemoryError):  # the model's own limits; anything else is a fault of the job
                if len(units) == 1:
                    return [None]
                half = len(units) // 2
                return call(units[:half]) + call(units[half:])

        for pdf in batches:
            generate = generate or factory()
            # call() gives a text for each unit, in their order
            found = [(x["id"], t) for rows in pdf["rows"] for x, t in zip(rows, call([x["english_text"] for x in rows]), strict=True)]
            yield pd.DataFrame([x for x in found if x[1] is not None], columns=["id", "english_styled"])

    # a batch is a row, of `size` segments at most, so a task takes many at a time
    listed = F.array_sort(F.collect_list(F.struct("ord", "id", "english_text"))).alias("rows")
    batches = style_batches(segments, size).groupBy("section_id", "batch").agg(listed)
    done = batches.select("rows").mapInPandas(run, "id long, english_styled string")
    done = done.withColumn("style_label", F.lit(preset))
    copied = pending_style(segments).where("route = 'placeholder'").select(
        "id", F.lit(X.PLACEHOLDER).alias("english_styled"), F.lit("placeholder").alias("style_label")
    )
    return done.unionByName(copied)


def style_plan(segments: DataFrame, shards: int) -> DataFrame:
    """STY-02, WIN-08, AGG-16: (doc_id, n, shard) pending segments of each work, the largest first, dealt in turn."""
    n = style_batches(segments).groupBy("doc_id").agg(F.count("*").alias("n"))
    ranked = library.numbered_rows(n.withColumn("_minus", -F.col("n")), ["_minus", "doc_id"])
    return ranked.select("doc_id", "n", (F.col("_row") % shards).cast("int").alias("shard"))


def backend(wanted: Column, complete: Column) -> Column:
    """STY-03: the trained model where it is asked for and complete, else the prompted one."""
    return F.when((wanted == "t5") & F.coalesce(complete, F.lit(False)), "t5").otherwise("llm")


def preview(segments: DataFrame, n: int) -> DataFrame:
    """FLT-18: the first n translated segments of each work, nothing written."""
    return library.first_n(segments.where(X.is_filled("english_text")), "doc_id", ["ord"], n)


def scanned(lines: DataFrame, factory: Callable[[], Callable[[str, str], str | None]] | None, meter: str = "hexameter") -> DataFrame:
    """SCN-01: (id, meter, scansion, note) of lines (id, section_id, ord, source_text, language); a scanner never fails a job.

    Notes: empty line, no scanner for Greek, no scanner at all, no pattern found, or the scanner's error.
    """
    rows = meters(lines, meter).select("id", "meter", F.coalesce("source_text", F.lit("")).alias("line"), "language")
    note = F.when(X.strip("line") == "", "empty line").when(F.col("language") == "grc", "Greek scansion not supported yet")
    rows = rows.withColumn("note", note if factory else F.coalesce(note, F.lit("scanner unavailable")))
    if factory is None:
        return rows.select("id", "meter", F.lit(None).cast("string").alias("scansion"), "note")

    def run(batches):
        scan = factory()

        def one(line: str, kind: str) -> tuple[str | None, str | None]:
            try:
                found = (scan(line.strip(), kind) or "").strip()
            except Exception as e:  # reported with the line
                return None, f"scan error: {e}"
            return (found, None) if found else (None, "no valid scan found")

        for pdf in batches:
            got = [(None, n) if n is not None else one(t, m) for t, m, n in zip(pdf["line"], pdf["meter"], pdf["note"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "meter": pdf["meter"], "scansion": [g[0] for g in got], "note": [g[1] for g in got]})

    return rows.mapInPandas(run, "id long, meter string, scansion string, note string")


def gathered(pairs: DataFrame, limit: int | None = 4000, low: int = 40, high: int = 300) -> DataFrame:
    """FLT-16: (pos, tgt) clean prose of low to high characters, the first of equal ones by pos, spread over `limit` places."""
    t = X.strip("tgt")
    pool = pairs.select("pos", t.alias("tgt")).where(F.length("tgt").between(low, high) & X.is_clean_prose("tgt"))
    first = pool.groupBy("tgt").agg(F.min("pos").alias("pos")).select("pos", "tgt")
    return first if limit is None else library.spread_sample(first, ["pos"], limit)


def distilled(pairs: DataFrame) -> DataFrame:
    """FLT-15: pairs (src: modern, tgt) whose modern text is there and says it otherwise."""
    return pairs.where(X.is_filled("src") & (F.lower(X.strip("src")) != F.lower(X.strip("tgt"))))
