"""Token counts by map-side two-tier lookup: no pre-token is ever shuffled.

The pieces of this tokenizer hold the word mark only at their start, so the encoding of a text is the
concatenation of the encodings of its pre-tokens: a run of word marks (spaces) with the characters up to the next.

Tier 1 is a broadcast hash table pre-token -> length. It holds the whole-word pieces of the tokenizer's own vocabulary and
the `keep` most frequent pre-tokens of a sample of about `sample` documents, picked by a hash whatever the size of the table; the
sampled documents' counts, one row for each task that has any, go to the driver, which adds them up. The sample decides what is fast, never
what is counted: a pre-token that it misses is a miss of tier 1, no more. Tier 2 encodes misses with the library and
keeps them in a bounded cache of the Python worker.

Null text: 0 bytes, 0 tokens. Very long texts are cut at pre-tokens, so no encoding of a whole text is ever held.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, worker_cache

MARK = "▁"
CACHE = 600_000
RUNS = re.compile(" *[^ ]+| +").findall
KEEP, SAMPLE = 100_000, 4096
LONGEST = 64  # characters of a pre-token of tier 1
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_lengths(model_file: str, corpus: list[str] | None = None) -> dict[str, int]:
    """Tier 1: lengths of the pre-tokens that are whole-word pieces of the vocabulary or frequent, keyed without their mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = map(sp.id_to_piece, range(sp.get_piece_size()))
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    words = list(dict.fromkeys([*words, *(corpus or [])]))
    return dict(zip(words, map(len, sp.encode(words, num_threads=1)), strict=True))


def units(text: str) -> list[str]:
    """Pre-tokens without their first mark: the library puts one before what it encodes."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in RUNS(" " + text)]
    return text.split(" ")


def sampled_counts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(units, counts) of the pre-tokens of about `sample` documents, a row for each task that has any of them: no shuffle."""
    share = min(1.0, sample / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int(share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                seen.update(u for u in units(t) if u and len(u) <= LONGEST)
        if seen:
            yield {"units": pa.array([list(seen)], pa.list_(pa.string())), "counts": [list(seen.values())]}

    return map_arrow(docs.where("text is not null").where(chosen).select("text"), count, "units array<string>, counts array<long>")


def frequent_units(docs: DataFrame, keep: int = KEEP, sample: int = SAMPLE) -> list[str]:
    """At most `keep` frequent pre-tokens of a sample of docs (doc_id, text), the most frequent first."""
    total: Counter = Counter()
    for row in sampled_counts(docs, sample).collect():  # as many pre-tokens as the sample has
        total.update(dict(zip(row["units"], row["counts"], strict=True)))
    return [u for u, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:keep]]


class TokenCounter:
    """Counts the tokens of texts exactly as encode() of the library would."""

    def __init__(self, model_file: str, table: dict[str, int], cache: int = CACHE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.table, self.cache, self.bound = table, worker_cache(f"token counts {model_file}"), cache

    def many(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        table, cache = self.table, self.cache
        for a, b in blocks(texts):
            lists = list(map(units, texts[a:b]))
            needed = set().union(*lists).difference(table)
            needed.discard("")
            missing = list(needed.difference(cache))
            if len(cache) + len(missing) > self.bound:
                cache.clear()
                missing = list(needed)
            for i in range(0, len(missing), 4096):
                part = missing[i : i + 4096]
                cache.update(zip(part, map(len, self.sp.encode(part, num_threads=1)), strict=True))
            first, second = table.get, cache.get
            out += [sum([first(u) or second(u) or 1 for u in units]) for units in lists]  # 1: a lone mark
        return out


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, cache: int = CACHE, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, null text as empty; repeated rows count alike."""
    spark: SparkSession = docs.sparkSession
    # at most the vocabulary and KEEP strings of at most LONGEST characters
    table = spark.sparkContext.broadcast(frequent_lengths(model_file, frequent_units(docs, sample=sample)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counter = TokenCounter(model_file, table.value, cache)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = counter.many(texts)
            yield {
                "doc_id": batch.column("doc_id"),
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

    return map_arrow(docs.select("doc_id", "text"), count, SCHEMA)
