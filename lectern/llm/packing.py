"""Best-fit packing by bound-certified repacking.

Tokenizing is one map over the documents: a text is cut at white space into units whose encodings concatenate to the
encoding of the text (the tokenizer's pre-tokens never cross from other characters into white space), and units are
encoded by the library once and kept in a bounded worker cache. A document of more than `capacity` ids is cut into full
pieces, the first of which takes the remainder.

Packing: pieces are dealt by a hash into partitions of a bounded number of pieces. Each partition packs by best-fit
decreasing and computes dual-feasible-function lower bounds on its bin count. A partition that meets its bound is
certified and gives up only its emptiest sequence; a partition with a gap gives up all sequences with free room. The
documents given up are exchanged - dealt anew with another salt into as few partitions as their number allows - and
packed again, `rounds` times in all; the last round keeps everything.

Null and empty texts are the id 0 alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_arrow, materialize, worker_cache

# fixed values: the Unicode White_Space characters, as the tokenizer's pattern sees them
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# fixed value: the pattern of the vocabulary's pre-tokens
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, LONG_UNIT = 500_000, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, open boolean"


class UnitTokenizer:
    """Ids of texts as little-endian 32-bit bytes, equal to encode(text, add_special_tokens=False) of the tokenizers library.

    Units are a space with the characters up to the next one. New units of plain ASCII characters are encoded together by
    the same vocabulary's rank file, if given, which is several times faster and gives the same ids (the two libraries'
    character classes can only differ on characters that young versions of Unicode added); others by the library itself.
    """

    def __init__(self, tokenizer_file: str, rank_file: str | None = None, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.runs = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.odd_space = re.compile(f"[{SPACE.replace(' ', '', 1).replace(chr(10), '')}]").search
        self.odd = re.compile("[^\0-\u024f]").search
        self.cache = worker_cache(f"units {tokenizer_file}")
        self.bound = cache
        self.fast = None
        if rank_file:
            import tiktoken

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.widths[i] = len(token)

    def units(self, text: str) -> list[str]:
        """Strings whose encodings concatenate to that of a text without special tokens."""
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or self.odd_space(text):
            return self.runs(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def learn(self, units: list[str]) -> None:
        plain, rest = [], []
        for u in units:
            (
                plain if self.fast
                and u[0] == " "
                and not self.odd(u)
                and len(u) <= LONG_UNIT
                and len(u) > 1
                and u[1] > " "
                and u[-1] > " " else rest
            ).append(u)
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            ids = self.fast.encode_to_numpy("".join(part), disallowed_special=()).astype("<u4")
            ends = np.cumsum(self.widths[ids])
            cuts = np.searchsorted(ends, np.cumsum(np.fromiter((len(u.encode()) for u in part), np.int64, len(part)))) + 1
            raw, at = ids.tobytes(), 0
            for u, b in zip(part, (4 * cuts).tolist(), strict=True):
                self.cache[u] = raw[at:b]
                at = b
        for i in range(0, len(rest), 4096):
            for u, e in zip(rest[i : i + 4096], self.encode(rest[i : i + 4096], add_special_tokens=False), strict=True):
                self.cache[u] = np.array(e.ids, "<u4").tobytes()

    def many(self, texts: list[str]) -> Iterator[bytes]:
        for a, b in blocks(texts):
            parts = [[p for p in (self.cut(t) if self.special else [t]) if p] for t in texts[a:b]]
            lists = [[[p] if p in self.special else self.units(p) for p in ps] for ps in parts]
            needed = set().union(*(units for own in lists for units in own))
            missing = needed.difference(self.cache)
            if len(self.cache) + len(missing) > self.bound:
                self.cache.clear()
                missing = needed
            self.cache.update((u, self.special[u]) for u in missing & self.special.keys())
            self.learn(list(missing - self.special.keys()))
            get = self.cache.__getitem__
            for own in lists:
                yield b"".join([b"".join(map(get, units)) for units in own])


def pieces(docs: DataFrame, tokenizer_file: str, rank_file: str | None = None, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents, each ended by id 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tokenizer = UnitTokenizer(tokenizer_file, rank_file)
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.many(texts), strict=True):
                ids += b"\0\0\0\0"
                n, start, piece = len(ids) // 4, 0, 0
                end = n % capacity or capacity
                while start < n:
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True) if rows else [[]] * 5, strict=True))

    return map_arrow(docs.select("doc_id", "text"), cut, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of the total and two families of dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # threshold functions: sizes above capacity - a count as whole bins, those under a as nothing
    above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    weight = np.concatenate([np.cumsum((count * size)[::-1])[::-1], [0]])
    half = capacity // 2 + 1
    a = np.arange(1, capacity // 2 + 1)
    whole = above[capacity - a + 1]
    middle, middle_sum = above[half] - whole, weight[half] - weight[capacity - a + 1]
    small_sum = weight[a] - weight[half]
    over = small_sum - (middle * capacity - middle_sum)
    best = max(best, int((whole + middle + np.maximum(0, -(-over // capacity))).max(initial=0)))
    for k in range(1, 65):  # rounding functions: x stays if (k+1)x is whole, else floor((k+1)x)/k; in units of capacity*k
        y = (k + 1) * size
        f = np.where(y % capacity == 0, size * k, y // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    return best


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, taken in the order given (decreasing), and the bins' free room."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    bins, offsets, rooms = [], [], 0  # rooms: bit r is set if a bin with r free exists
    for s in sizes:
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins.append(b)
        offsets.append(capacity - room)
        free[b] = left = room - s
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return bins, offsets, free


def _round(table: DataFrame, parts: int, number: int, capacity: int, last: bool) -> DataFrame:
    dealt = table.repartition(parts, F.xxhash64("doc_id", "piece", F.lit(number)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = t.column("length").to_numpy()
        bins, offsets, free = best_fit(sizes.tolist(), capacity)
        b, room = np.array(bins, np.int64), np.array(free, np.int64)
        given = np.zeros(len(room), bool)
        if not last:
            if len(room) > lower_bound(sizes, capacity):
                given = room > 0
            elif room.max() > 0:
                given[room.argmax()] = True
        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        yield {
            n: t.column(n).combine_chunks()
            for n in ("doc_id", "piece", "start", "length", "ids_crc32")
        } | {"sequence_id": base + b, "offset": np.array(offsets, np.int64), "open": given[b]}

    return map_arrow(dealt, pack, PACKED)


def best_fit_packing(
    docs: DataFrame, tokenizer_file: str, rank_file: str | None = None, capacity: int = 2048, per_partition: int = 200_000, rounds: int = 3
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document, packed."""
    todo = materialize(pieces(docs, tokenizer_file, rank_file, capacity), "pieces")
    done: list[DataFrame] = []
    least = 1
    for number in range(1, rounds + 1):
        parts = max(least, -(-todo.count() // per_partition))
        packed = materialize(_round(todo, parts, number, capacity, number == rounds), "packed")
        done.append(packed.where("not open").drop("open"))
        todo = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out
