"""Scores of translations and restylings (MTH-05, AGG-13, AGG-14, ML-04, MTH-06, SMP-01), as published for chrF and BLEU.

A pair's counts come from one Arrow function; sums and formulas are DataFrame expressions, so corpora and groups of any
size aggregate map-side.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

ORDER, BETA = 6, 2.0
BLEU_ORDER = 4


ROWS, LETTERS = 128, 1 << 18  # pairs counted together, and their letters: arrays that stay in the cache


def common_grams(codes: np.ndarray, lengths: np.ndarray, order: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """For each pair of sides, row and order up to `order` the n-grams that both have, each as often as the one that has it less often.

    codes: the rows of all sides one after the other, as numbers from 1; lengths: (sides, rows). Places are sorted once by their row and their first
    `order` codes; those of equal shorter n-grams lie together too, so each order only asks where the sorted places begin to differ.
    """
    rows, out = lengths.shape[1], np.zeros((len(pairs), lengths.shape[1], order))
    if not len(codes):
        return out
    flat = lengths.ravel()
    bits, wide = int(codes.max()).bit_length(), (rows - 1).bit_length()
    fits = wide + order * bits + 2 <= 64
    if not fits and rows > 1:
        half, ends = rows // 2, np.split(codes, np.cumsum(flat)[:-1])
        for at in (slice(0, half), slice(half, rows)):
            own = np.concatenate([ends[i] for i in np.arange(flat.size).reshape(lengths.shape)[:, at].ravel()])
            out[:, at] = common_grams(own, lengths[:, at], order, pairs)
        return out
    n, place, each = len(codes), np.repeat(np.arange(flat.size), flat), np.arange(flat.size)
    # zeros after each row, so that no n-gram runs into the next
    spot = np.arange(n) + place * order
    spread = np.zeros(n + flat.size * order, np.uint64)
    spread[spot] = codes

    def packed(first: int, last: int) -> np.ndarray:
        key = np.zeros(len(spread) - order, np.uint64)
        for i in range(first, last):
            key <<= np.uint64(bits)
            key |= spread[i : i + len(key)]
        return key[spot]

    # keys of which each holds the codes from one order to another; a single row with very many codes needs more than one
    steps = [0, order] if fits else [*range(0, order, 62 // bits), order]
    keys = [packed(i, j) for i, j in zip(steps, steps[1:], strict=False)]
    if fits:
        both = keys[0] << np.uint64(2)
        both |= np.repeat((each % rows << order * bits + 2 | each // rows).astype(np.uint64), flat)
        both.sort()
        side, keys = both & np.uint64(3), [both >> np.uint64(2)]
    else:
        sort = np.lexsort(keys[::-1])
        side, keys = (place // rows)[sort], [k[sort] for k in keys]
    # places of a side up to each place; what no other side has is the last one's
    before = [np.concatenate([[0], np.cumsum(side == i, dtype=np.int32)]) for i in range(len(lengths) - 1)]
    changed = np.zeros(n, bool)
    changed[0] = True
    for key, first, last in zip(keys, steps, steps[1:], strict=False):
        change = np.concatenate([[np.uint64(0)], key[1:] ^ key[:-1]])
        for i in range(first + 1, last + 1):
            below = np.uint64((last - i) * bits)
            changed |= change >= np.uint64(1) << below
            at = np.flatnonzero(changed)
            counts = [np.diff(c[at], append=c[-1]) for c in before]
            counts.append(np.diff(at, append=n) - sum(counts))
            common = [np.minimum(counts[a], counts[b]) for a, b in pairs]
            met = np.flatnonzero(sum(common))  # only what two sides have is looked at further
            key_met = key[at[met]]
            whole = (key_met >> below) & np.uint64((1 << bits) - 1) != 0
            met, key_met = met[whole], key_met[whole]
            row = (key_met >> np.uint64(order * bits)).astype(np.int64) if fits else np.zeros(len(met), np.int64)
            for k, shared in enumerate(common):
                out[k, :, i - 1] = np.bincount(row, shared[met], rows)
    return out


def _counted(sides: list, order: int, pairs: list[tuple[int, int]], coded) -> tuple[np.ndarray, np.ndarray]:
    """(all, common): n-grams of each side and those common to pairs of sides, by row and order. `coded` makes numbers from 1 of the rows of all sides."""
    lengths = np.array([[len(x) for x in side] for side in sides], np.int64).reshape(len(sides), -1)
    total = np.maximum(0, lengths[:, :, None] - np.arange(order))
    common = np.zeros((len(pairs), lengths.shape[1], order))
    start, many = 0, lengths.sum(0).tolist()
    while start < len(many):
        end, size = start + 1, many[start]
        while end < min(start + ROWS, len(many)) and size + many[end] <= LETTERS:
            size, end = size + many[end], end + 1
        common[:, start:end] = common_grams(coded([x for side in sides for x in side[start:end]]), lengths[:, start:end], order, pairs)
        start = end
    return total, common.astype(np.int64)


def _letter_codes(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(points.max(initial=0) + 1, bool)
    there[points] = True
    return np.cumsum(there)[points]


def chrf_sides(pairs: list[tuple[int, int]], *sides: list[str]) -> list[np.ndarray]:
    """`chrf_counts` of several pairs of sides, the n-grams of each side taken once."""
    total, common = _counted([["".join(t.split()) for t in texts] for texts in sides], ORDER, pairs, _letter_codes)
    out = []
    for k, (a, b) in enumerate(pairs):
        counts = np.zeros((len(sides[0]), 3 * ORDER), np.int64)
        counts[:, 0::3], counts[:, 1::3], counts[:, 2::3] = total[a], total[b], common[k]
        counts[:, 0::3][counts[:, 1::3] == 0] = 0
        out.append(counts)
    return out


def chrf_counts(hypotheses: list[str], references: list[str]) -> np.ndarray:
    """A row for each pair, and in it for each order: n-grams of the hypothesis (0 where the reference has none), of the reference, and common ones."""
    return chrf_sides([(0, 1)], hypotheses, references)[0]


# fixed values: the tokenization of the published metric
ENTITIES = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
CUTS = [
    (re.compile(r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])"), r" \1 "),  # the published class has the space too, which only makes more of it
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def tokens_of(texts: list[str]) -> list[list[str]]:
    """The published tokens of each text. Texts are cut together as lines, which end in spaces on both sides, so that no cut sees two of them."""
    lines = []
    for text in texts:
        for old, new in ENTITIES:
            text = text.replace(old, new)
        lines.append(f" {text.strip()} ")
    whole = "\n".join(lines)
    for pattern, new in CUTS:
        whole = pattern.sub(new, whole)
    return [line.split() for line in whole.split("\n")] if lines else []


def bleu_tokens(text: str) -> list[str]:
    return tokens_of([text])[0]


def _token_codes(rows: list[list[str]]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.array([known.setdefault(t, len(known) + 1) for row in rows for t in row], np.int64)


def bleu_counts(hypotheses: list[str], references: list[str]) -> np.ndarray:
    """A row for each pair: common and all n-grams of the hypothesis for each order, and both lengths."""
    sides = [tokens_of(texts) for texts in (hypotheses, references)]
    total, common = _counted(sides, BLEU_ORDER, [(0, 1)], _token_codes)
    out = np.zeros((len(hypotheses), 2 * BLEU_ORDER + 2), np.int64)
    out[:, 0:-2:2], out[:, 1:-2:2], out[:, -2], out[:, -1] = common[0], total[0], total[0, :, 0], total[1, :, 0]
    return out


def pair_scores(c: np.ndarray) -> np.ndarray:
    """The score of each pair alone, by the formula of `chrf_of`."""
    own, other, common = (c[:, i::3].astype(float) for i in range(3))
    both = (own > 0) & (other > 0)
    orders = np.maximum(1, both.sum(1))
    p, r = ((np.where(both, common, 0) / np.maximum(side, 1)).sum(1) / orders for side in (own, other))
    return np.where(p + r > 0, 100 * (1 + BETA**2) * p * r / np.maximum(BETA**2 * p + r, 1e-300), 0.0)


@F.pandas_udf(T.ArrayType(T.LongType()))
def chrf_stats(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series(list(chrf_counts(hyp.fillna("").tolist(), ref.fillna("").tolist())))


@F.pandas_udf(T.ArrayType(T.LongType()))
def bleu_stats(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series(list(bleu_counts(hyp.fillna("").tolist(), ref.fillna("").tolist())))


@F.pandas_udf(T.DoubleType())
def chrf_score(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """The score of each pair alone."""
    return pd.Series(pair_scores(chrf_counts(hyp.fillna("").tolist(), ref.fillna("").tolist())))


STYLE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("kept", "near", "was")] + [T.StructField("hr", T.ArrayType(T.LongType()))])


@F.pandas_udf(STYLE)
def style_stats(hyp: pd.Series, src: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Scores of hyp against src, hyp against ref and src against ref, and the counts of hyp and ref."""
    kept, near, was = chrf_sides([(0, 1), (0, 2), (1, 2)], *[x.fillna("").tolist() for x in (hyp, src, ref)])
    return pd.DataFrame({"kept": pair_scores(kept), "near": pair_scores(near), "was": pair_scores(was), "hr": list(near)})


def chrf_of(stats: Column) -> Column:
    """The score of counts: F of mean precision and mean recall over the orders that both sides have; 0 without any."""
    at = lambda i: F.get(stats, F.lit(i)).cast("double")
    both = [(at(3 * n) > 0) & (at(3 * n + 1) > 0) for n in range(ORDER)]
    orders = sum((b.cast("int") for b in both), F.lit(0))
    mean = lambda k: sum(
        (F.when(b, at(3 * n + 2) / at(3 * n + k)).otherwise(0.0) for n, b in enumerate(both)), F.lit(0.0)
    ) / F.greatest(orders, F.lit(1))
    p, r = mean(0), mean(1)
    return F.when(p + r > 0, 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r)).otherwise(0.0)


def bleu_of(stats: Column) -> Column:
    """The score of counts, with exponential smoothing of orders without matches and the brevity penalty."""
    at = lambda i: F.get(stats, F.lit(i)).cast("double")
    logs, halvings = F.lit(0.0), F.lit(0)
    for n in range(BLEU_ORDER):
        hit, total = at(2 * n), at(2 * n + 1)
        halvings = halvings + (hit == 0).cast("int")
        logs = logs + F.when(hit > 0, F.log(100 * hit / total)).otherwise(
            F.log(F.lit(100.0) / (F.pow(F.lit(2.0), halvings) * F.greatest(total, F.lit(1.0))))
        )
    own, ref = at(2 * BLEU_ORDER), at(2 * BLEU_ORDER + 1)
    brevity = F.when(own >= ref, 1.0).when(own > 0, F.exp(1 - ref / F.greatest(own, F.lit(1.0)))).otherwise(0.0)
    complete = (own > 0) & (at(2 * BLEU_ORDER - 1) > 0) & (at(0) > 0)
    return F.when(complete, brevity * F.exp(logs / BLEU_ORDER)).otherwise(0.0)


def summed(stats: str, size: int) -> Column:
    """Sums of arrays place by place: an aggregate of columns, combined map-side."""
    return F.array(*[F.sum(F.get(stats, F.lit(i))) for i in range(size)])


def corpus_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """MTH-05, AGG-14, ML-04: (by, n, chrf, bleu) of pairs (hyp, ref) over each group, e.g. model and era; null sides are empty."""
    counted = pairs.select(*by, chrf_stats("hyp", "ref").alias("c"), bleu_stats("hyp", "ref").alias("b"))
    sums = counted.groupBy(*by).agg(F.count("*").alias("n"), summed("c", 3 * ORDER).alias("c"), summed("b", 2 * BLEU_ORDER + 2).alias("b"))
    return sums.select(*by, "n", chrf_of(F.col("c")).alias("chrf"), bleu_of(F.col("b")).alias("bleu"))


def style_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """AGG-13, ML-04: (by, n, commit, register_gap, chrf_vs_gold, len_ratio) of rewritings (src, hyp, ref).

    commit: how far the rewriting is from its source; register_gap: how much nearer the reference than the source is.
    """
    ratio = F.length("hyp") / F.greatest(F.lit(1), F.length("src"))
    counted = pairs.select(*by, style_stats("hyp", "src", "ref").alias("s"), ratio.alias("r")).select(*by, "s.*", "r")
    sums = counted.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(100 - F.col("kept")).alias("commit"),
        F.avg(F.col("near") - F.col("was")).alias("gap"),
        summed("hr", 3 * ORDER).alias("c"),
        F.avg("r").alias("len"),
    )
    return sums.select(
        *by,
        "n",
        F.bround("commit", 1).alias("commit"),
        F.bround("gap", 1).alias("register_gap"),
        F.bround(chrf_of(F.col("c")), 1).alias("chrf_vs_gold"),
        F.bround("len", 2).alias("len_ratio"),
    )


def model_spec(c: Column | str, stock: str) -> Column:
    """STR-45: struct (label, path, norm) of LABEL=PATH[:norm]; the path "stock" is the stock model's."""
    spec = X.col(c)
    at = F.instr(spec, "=")
    label = F.when(at > 0, F.left(spec, at - 1)).otherwise(spec)
    tail = F.when(at > 0, F.substr(spec, at + 1)).otherwise("")
    norm = F.endswith(tail, F.lit(":norm"))
    path = F.when(norm, F.left(tail, F.length(tail) - 5)).otherwise(tail)
    return F.struct(label.alias("label"), F.when(path == "stock", F.lit(stock)).otherwise(path).alias("path"), norm.alias("norm"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """SMP-01: df with its place in an order that the key's hash and the seed fix wherever it runs."""
    from .library import numbered_rows

    return numbered_rows(df.withColumn("_h", F.xxhash64(key, F.lit(seed))), ["_h", key], "place").drop("_h")


def held_out(df: DataFrame, key: str, size: int, start: int = 0, seed: int = 42) -> DataFrame:
    """SMP-01: `size` rows of the shuffled table from `start` on, or its last ones where start is 0."""
    rows = shuffled(df, key, seed)
    first = start or max(0, rows.count() - size)
    return rows.where(F.col("place").between(first, first + size - 1)).drop("place")


def evaluation_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """SMP-01: df with evaluation, true for the first max(1, int(n * share)) rows of the shuffled table."""
    rows = shuffled(df, key, seed)
    size = max(1, int(rows.count() * share))
    return rows.withColumn("evaluation", F.col("place") < size).drop("place")


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """MTH-06: struct (rate, eta) in rows a second and seconds to go; null before anything is done."""
    rate = F.when(seconds > 0, done / seconds)
    return F.struct(rate.alias("rate"), F.when(rate > 0, (total - done) / rate).alias("eta"))


def training_records(pairs: DataFrame, default: str = "la", most: int | None = None, seed: int = 42) -> DataFrame:
    """ML-03, AGG-21: (src_lang, src, tgt, evaluation) what a fine-tuning job reads; training itself is out of scope."""
    rows = pairs.where(X.is_filled("src") & X.is_filled("tgt")).withColumn(
        "src_lang", F.coalesce(F.nullif("src_lang", F.lit("")), F.lit(default))
    )
    rows = rows.withColumn("_k", F.xxhash64("src", "tgt"))
    split = evaluation_split(rows if most is None else held_out(rows, "_k", most, 0, seed), "_k", 0.02, seed)
    return split.select("src_lang", "src", "tgt", "evaluation")


def routed_examples(pairs: DataFrame, default: str = "la") -> DataFrame:
    """AGG-21: (src_lang, n) of training pairs by the language whose tokenizer they go to."""
    return pairs.groupBy(F.coalesce(F.nullif("src_lang", F.lit("")), F.lit(default)).alias("src_lang")).agg(F.count("*").alias("n"))
