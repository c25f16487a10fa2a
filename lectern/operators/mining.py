"""Parallel mining from parsed citations and from books (ALN-03, ALN-05, ALN-07, AGG-10..12, AGG-22, JON-06, JON-07, MAP-01).

Leaves are rows (work, pos, chain, text): chain is an array of (level, n) from the outermost division on, pos the order.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import alignment, library

# fixed values: divisions that wrap an edition, and the heading of a book in capitals
WRAPPERS = ["edition", "translation"]
BOOK_HEADING = r"(?m)^[ \t]*(?:BOOK|GEORGIC)[ \t]+(?:THE[ \t]+)?([IVXLC]+|[A-Za-z]+(?:-[A-Za-z]+)?)\b"
MOST_BOOKS = 50


def in_order(rows: DataFrame, key: list[str], order: list[str], column: str, name: str, by: str = " ") -> DataFrame:
    """AGG-10, AGG-11, AGG-22: (key, name) the column's values of each key joined in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_t"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(listed, lambda x: x["_t"]), by).alias(name))


def levels(leaves: DataFrame) -> DataFrame:
    """AGG-12: (work, levels) the names of levels in the order in which they are first seen, wrappers left out."""
    each = leaves.select("work", "pos", F.posexplode("chain").alias("depth", "c")).where(~F.col("c.level").isin(WRAPPERS))
    first = each.groupBy("work", F.col("c.level").alias("level")).agg(F.min(F.struct("pos", "depth")).alias("at"))
    return first.groupBy("work").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "level"))), lambda x: x["level"]).alias("levels")
    )


def citation_key(chain: Column | str, common: Column | str) -> Column:
    """MAP-01: the n of each common level, the innermost of equal levels; null where a level is missing."""
    of = lambda level: F.try_element_at(F.filter(X.col(chain), lambda c: c["level"] == level), F.lit(-1))["n"]
    key = F.transform(X.col(common), of)
    return F.when(~F.exists(key, lambda n: n.isNull()), key)


def collapsed(leaves: DataFrame, common: DataFrame, name: str) -> DataFrame:
    """AGG-10: (work, key, pos, name) leaves' texts by their common citation (work, levels); leaves that do not reach it drop out."""
    keyed = leaves.join(common, "work").withColumn("key", citation_key("chain", "levels")).where("key is not null")
    listed = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return keyed.groupBy("work", "key").agg(
        F.min("pos").alias("pos"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias(name)
    )


def citation_pairs(source: DataFrame, target: DataFrame, language: str = "la", era: str = "classical", label: str = "Perseus") -> DataFrame:
    """ALN-03, JON-06, SET-03: pair records of the leaves of two editions, joined on their common citation levels.

    Works without a common level give nothing; blank sides drop out; order is the source's, as column pos.
    """
    both = levels(source).join(levels(target).select("work", F.col("levels").alias("other")), "work")
    common = both.select("work", F.array_intersect("levels", "other").alias("levels")).where("size(levels) > 0")
    pairs = collapsed(source, common, "src").join(collapsed(target, common, "tgt").drop("pos"), ["work", "key"])
    pairs = pairs.withColumn("src", X.strip("src")).withColumn("tgt", X.strip("tgt")).where("src <> '' and tgt <> ''")
    return pairs.select(
        "src", "tgt", F.array_join("key", ".").alias("citation"), F.lit(language).alias("src_lang"), F.lit(era).alias("era"),
        F.concat(F.lit(f"{label} "), "work").alias("source"), "work", "pos",
    )


def work_parts(identifier: Column | str) -> Column:
    """ALN-07: struct (group, work) of group.work, a path or an urn."""
    parts = X.cts_parts(identifier)
    return F.struct(parts["textgroup"].alias("group"), parts["work"].alias("work"))


def pair_json(pairs: DataFrame) -> DataFrame:
    """ALN-07, SNK-07: (value) pair records as JSON, the columns of a pair that are there."""
    from .library import PAIRS

    return pairs.select(F.to_json(F.struct(*[F.col(c) for c in PAIRS.fieldNames() if c in pairs.columns])).alias("value"))


def source_books(leaves: DataFrame) -> DataFrame:
    """ALN-05, AGG-11: (work, book, text): leaves by their innermost book level, else by the last of their chain."""
    named = F.try_element_at(F.filter("chain", lambda c: c["level"] == "book"), F.lit(-1))["n"]
    book = F.coalesce(named, F.try_element_at("chain", F.lit(-1))["n"], F.lit("None"))
    return in_order(leaves.withColumn("book", book), ["work", "book"], ["pos"], "text", "text")


HEADING = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType())]))


@F.pandas_udf(HEADING)
def headings(texts: pd.Series) -> pd.Series:
    """Places and words of the book headings of a text."""
    found = re.compile(BOOK_HEADING).finditer
    return texts.map(lambda t: [{"pos": m.start(), "token": m[1]} for m in found(t or "")])


def target_books(texts: DataFrame) -> DataFrame:
    """ALN-05, WIN-03: (work, book, text) of whole texts (work, text), cut at the best ascending run of book headings."""
    marks = texts.select(
        F.col("work").alias("doc_id"), F.explode(headings("text")).alias("h")
    ).select("doc_id", "h.pos", X.book_number("h.token").alias("n"))
    marks = marks.where(F.col("n").between(1, MOST_BOOKS))
    cuts = library.best_run(marks, texts.select(F.col("work").alias("doc_id"), F.length("text").alias("size")))
    joined = cuts.join(texts, cuts["doc_id"] == texts["work"])
    # a book goes from its heading to the next one of the run
    return joined.select(
        "work", F.col("n").cast("string").alias("book"), F.substring("text", F.col("pos") + 1, F.col("until") - F.col("pos")).alias("text")
    )


def common_books(source: DataFrame, target: DataFrame) -> DataFrame:
    """JON-07, SET-03: (work, n, src, tgt) of the books that both sides have; order by n."""
    joined = source.select("work", "book", F.col("text").alias("src")).join(
        target.select("work", "book", F.col("text").alias("tgt")), ["work", "book"]
    )
    return joined.select("work", F.col("book").try_cast("int").alias("n"), "src", "tgt").where("n is not null")


def mined_books(
    source: DataFrame,
    target: DataFrame,
    language: str = "la",
    era: str = "classical",
    style: str = "literal",
    form: str = "verse",
    label: str = "verse",
    **options,
) -> DataFrame:
    """ALN-05: sentence pairs of common books, citation the book's number."""
    books = common_books(source, target)
    cut = books.select(
        F.concat_ws("\t", "work", F.col("n").cast("string")).alias("key"),
        X.sentences("src", language).alias("src"),
        X.split_english("tgt").alias("tgt"),
    )
    pairs = alignment.align_texts(cut, "key", **options)
    return pairs.select(
        "src", "tgt", "score", F.split_part(
            "key", F.lit("\t"), F.lit(2)
        ).alias("citation"), F.lit(language).alias("src_lang"), F.lit(era).alias("era"),
        F.lit(style).alias("style"), F.lit(form).alias("form"), F.concat(
            F.lit(f"{label}:"), F.split_part("key", F.lit("\t"), F.lit(1))
        ).alias("source"), "n",
    )


def aligner(via: bool, embed=alignment.hashing_embedder, translate=None):
    """ALN-06: the alignment to use: across languages by a shared encoder, or through a translation of the source."""
    if not via:
        return lambda pairs, key, **options: alignment.align_texts(pairs, key, embed=embed, **options)
    if translate is None:
        raise ValueError("an alignment through translation needs a translator")
    return lambda pairs, key, **options: alignment.align_texts_via(pairs, key, translate, embed=embed, **options)


def whole_texts(sections: DataFrame, segments: DataFrame) -> DataFrame:
    """AGG-22, JON-01: (doc_id, text) of works, their segments joined in the order of sections and segments."""
    s = segments.select("section_id", "ord", "source_text").join(
        sections.select(F.col("id").alias("section_id"), "doc_id", F.col("ord").alias("section_ord")), "section_id"
    )
    return in_order(s, ["doc_id"], ["section_ord", "ord"], "source_text", "text")
