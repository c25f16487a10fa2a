"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Training counts hashed character n-grams (1 to 4, with word ends) and whole words of labelled documents by language, on
at most about `train_docs` documents of each language, picked by a hash of their doc_id; this bound is the only sample,
prediction reads whole texts. A word's score in a language is the mean log probability of its n-grams times its number
of characters. The words of a script that only some languages were seen with are scored in those alone.

Viterbi finds the labelling of a document's words with the highest sum of scores less `penalty` for each switch. Nearly
all texts have one language; for those the labelling is proved without running it: a text's best single language is
optimal if no other language gains more than the penalty over any run of words.

The prediction is the language with the most letters in the labelled spans (ties: first by name), the score its share.
Null texts and texts without letters are `und` with score 0. Repeated rows get the same result each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_arrow, mix

BUCKETS = 1 << 15
CACHE = 200_000
UND = "und"
WORDS = re.compile(r"[^\W\d_]+").findall
# fixed values: first code points of the script ranges, and the script that starts there (0: the first and all others)
RANGES = [
    0,
    0x370,
    0x400,
    0x530,
    0x590,
    0x600,
    0x780,
    0x900,
    0x980,
    0xA00,
    0xE00,
    0xE80,
    0x10A0,
    0x1100,
    0x1200,
    0x1E00,
    0x1F00,
    0x2000,
    0x2E80,
    0x3040,
    0x3100,
    0x3130,
    0x3190,
    0xAC00,
    0xD7B0,
]
SCRIPT = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 0, 1, 0, 15, 16, 15, 13, 15, 13, 15]
SCRIPTS = 17


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of each word, and the number of the word it belongs to."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(text))
    buckets, owners = [], []
    h = np.zeros(len(text), np.uint64)
    for n in range(1, 5):
        h = h[: len(text) - n + 1]
        h = mix(h + text[n - 1 :] + np.uint64(n * 0x9E3779B9))
        ok = place[: len(h)] + n <= end[: len(h)]
        buckets.append((h[ok] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(word[: len(h)][ok])
    if len(words):  # whole words
        total = np.add.reduceat(
            mix(text + np.uint64(0xABCD) * (place - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint64)),
            np.cumsum(lengths) - lengths,
        )
        for salt in (1, 2):
            buckets.append((mix(total + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def scripts(words: list[str]) -> np.ndarray:
    return np.array(SCRIPT)[np.searchsorted(RANGES, [ord(w[0]) for w in words], side="right") - 1] if words else np.zeros(0, int)


def train(docs: DataFrame, train_docs: int = 5000, most: int = 512) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (language x bucket) and the scripts seen with each language. docs: doc_id, text, lang.

    The `most` most frequent labels are learned, so dirty ones do not make the model grow.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {
        r["lang"]: r["n"]
        for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    }
    if not sizes:
        return [], np.zeros((0, BUCKETS)), np.zeros((0, SCRIPTS), bool)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))])[F.col("lang")]
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) < share * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words = WORDS(text.lower())
                own = sums.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                for i in range(0, len(words), 50_000):
                    own[:BUCKETS] += np.bincount(features(words[i : i + 50_000])[0], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(scripts(words[i : i + 50_000]), minlength=SCRIPTS)
        for lang, own in sums.items():
            at = own.nonzero()[0]
            yield {"lang": [lang] * len(at), "bucket": at, "n": own[at]}

    langs = sorted(sizes)
    counts = np.zeros((len(langs), BUCKETS + SCRIPTS))
    for r in map_arrow(
        picked, count, "lang string, bucket long, n long"
    ).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[langs.index(r["lang"]), r["bucket"]] = r["n"]
    grams, seen = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    return langs, np.log(grams / grams.sum(1, keepdims=True)), seen > 0.001 * np.maximum(1, seen.sum(1, keepdims=True))


class Labeller:
    def __init__(self, langs: list[str], logp: np.ndarray, seen: np.ndarray, penalty: float):
        self.langs, self.logp, self.seen, self.penalty = langs, logp, seen, penalty
        self.cache: dict[str, int] = {}  # row of scores by word
        self.scores = np.zeros((1024, len(langs)))

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        buckets, owner = features(new)
        n = np.bincount(owner, minlength=len(new))
        sums = np.stack([np.bincount(owner, weights=p[buckets], minlength=len(new)) for p in self.logp], 1)
        score = sums / n[:, None] * np.fromiter(map(len, new), float, len(new))[:, None]
        allowed = self.seen[:, scripts(new)].T
        none = ~allowed.any(1)
        score = np.where(allowed, score, score.min(1, keepdims=True) - 20.0)
        score[none] = 0.0
        first = len(self.cache)
        while first + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[first : first + len(new)] = score
        self.cache.update(zip(new, range(first, first + len(new)), strict=True))

    def _viterbi(self, m: np.ndarray) -> np.ndarray:
        back = np.zeros(m.shape, np.int32)
        own = np.arange(m.shape[1])
        v = m[0].copy()
        for i in range(1, len(m)):
            top = int(v.argmax())
            stay = v >= v[top] - self.penalty
            back[i] = np.where(stay, own, top)
            v = np.where(stay, v, v[top] - self.penalty) + m[i]
        path = np.zeros(len(m), np.int32)
        path[-1] = v.argmax()
        for i in range(len(m) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def many(self, texts: list[str | None]) -> Iterator[tuple[str, float, str]]:
        """Results of texts, the missing words of each block learnt at once."""
        texts = [t or "" for t in texts]
        for a, b in blocks(texts):
            raws = [WORDS(t) for t in texts[a:b]]
            lowers = [WORDS(t.lower()) for t in texts[a:b]]
            lowers = [low if len(low) == len(raw) else [w.lower() for w in raw] for raw, low in zip(raws, lowers, strict=True)]  # lower-casing can make or cut words
            if self.langs:
                self._learn(set().union(*lowers))
            for raw, low in zip(raws, lowers, strict=True):
                yield self._result(raw, low)

    def spans(self, raw: list[str], words: list[str]) -> list[tuple[int, int, int]]:
        """(language, first word, end word) of each span."""
        if not raw or not self.langs or not any(map(str.isalpha, "".join(raw))):
            return []
        m = self.scores[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]
        best = int(m.sum(0).argmax())
        gain = np.cumsum(m - m[:, [best]], axis=0)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0), 0.0)
        if (gain - low).max() <= self.penalty:
            return [(best, 0, len(words))]
        path = self._viterbi(m)
        cuts = np.concatenate([[0], (path[1:] != path[:-1]).nonzero()[0] + 1, [len(path)]])
        return [(int(path[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _result(self, raw: list[str], words: list[str]) -> tuple[str, float, str]:
        spans = self.spans(raw, words)
        if not spans:
            return UND, 0.0, ""
        letters = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        weight = np.zeros(len(self.langs), np.int64)
        for lang, a, b in spans:
            weight[lang] += letters[b] - letters[a]
        best = int(weight.argmax())
        return self.langs[best], float(weight[best] / letters[-1]), ",".join(f"{self.langs[k]}:{a}:{b}" for k, a, b in spans)


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], penalty: float = 12.0, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, lang_pred, score, spans) and the columns to carry: spans as language:first word:end word, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        labeller = Labeller(*shared.value, penalty)
        for batch in batches:
            got = list(labeller.many(batch.column("text").to_pylist()))
            yield {
                "doc_id": batch.column("doc_id"),
                "lang_pred": [g[0] for g in got],
                "score": [g[1] for g in got],
                "spans": [g[2] for g in got],
            } | {c: batch.column(c) for c in carry}

    kinds = dict(docs.dtypes)
    schema = [
        "doc_id long", "lang_pred string", "score double", "spans string", *(f"{c} {kinds[c].replace('bigint', 'long')}" for c in carry)
    ]
    return map_arrow(docs.select("doc_id", *dict.fromkeys(("text", *carry))), label, ", ".join(schema))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0
