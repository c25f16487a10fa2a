"""Near-duplicate groups by SuperMinHash.

A document's set is its distinct 5-word shingles, as 64-bit hashes. SuperMinHash gives each of M registers to every
element once, in an order (a permutation drawn from the element's hash): in round j the element offers the value
j + random to its j-th register, so ranks are correlated and no register can be won by a late round once all have been
won by earlier ones, which is where it stops. The registers make BANDS band keys of M / BANDS registers.

Documents of equal sets are one class, a node with a number of its own, and only one of its texts goes on. Checks are on full
sets and come in rounds, each with the components of all links so far, and only between different components:

1. each node against the smallest of its buckets' smallest members, so that a group of n copies costs n checks;
2. each member of a bucket against the bucket's smallest;
3. an exact prefix join, for members of buckets that are still mixed, and for all sets of at most SMALL shingles, for which
   banding is weakest. Shingles are ordered by rarity among these sets. Similar sets share one of the
   n - ceil(percent * n / 100) + 1 rarest of their n shingles, and behind the first one that they share each must still
   have room for their least intersection; so only these prefixes are joined, and a set whose prefix occurs nowhere else
   has no partner. Each group of sets under one shingle is met by its next PIVOTS pivots, MORE times as many each round,
   until its members are of one component or have all been pivots; only pairs that pass both bounds leave the join, and a
   group that turns out to be one cluster costs a bounded number of comparisons for each member, never all its pairs.

A component's id is its smallest doc_id, taken once the components of nodes are known. So rows of one doc_id with different
sets are different nodes, not linked by their id: each has the id of its own text's component. Rows with a null doc_id belong
to the node of their set, take its component and count as kept only if that is null (it has no other id). Repeated rows are copies
of each other. Texts without words have the empty set, are linked with nothing and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, blocks, doc_text, map_arrow, materialize, mix, shingle_hashes
from .components import components

M, BANDS = 128, 32
SHINGLE = 5
SMALL, PIVOTS, MORE = 43, 256, 8  # a set of 32 shingles has partners of at most 42
PER_TASK = 256
SLICE = 512  # rows that a worker holds as Python objects at a time
LAST = np.uint64((1 << 64) - 1)


def shingle_sets(texts: list[str], hashed: WordHash, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; bytes.lower() and split() are the A-Z and white space of the word rule."""
    for a, b in blocks(texts):
        for words in hashed.many([t.encode().lower().split() for t in texts[a:b]]):
            yield np.unique(shingle_hashes(words, n))


def superminhash(elements: np.ndarray, m: int = M) -> np.ndarray:
    """Registers of a set of 64-bit hashes; m must be a power of two up to 256. The round is in the top byte."""
    registers = np.full(m, LAST, np.uint64)
    if not len(elements):
        return registers
    first = elements & np.uint64(m - 1)
    step = ((elements >> np.uint64(8)) | np.uint64(1)) & np.uint64(m - 1)
    rounds = max(1, min(m, -(-m // len(elements))))  # small sets need many rounds: take several at once
    for j in range(0, m, rounds):
        k = np.arange(j, min(m, j + rounds), dtype=np.uint64)[:, None]
        at = (first + k * step) & np.uint64(m - 1)
        value = (k << np.uint64(56)) | (mix(elements + (k + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8))
        np.minimum.at(registers, at.ravel().astype(np.intp), value.ravel())
        if (registers >> np.uint64(56)).max() < np.uint64(min(m, j + rounds)):
            break
    return registers


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = registers.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in rows.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32), flat)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set1, set2, bands, few): set1 and set2 are a 128-bit hash of the whole set, few a small set itself."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashed = WordHash()
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            n, one, two, bands, few = [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), hashed):
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                one.append((d >> 64) - (1 << 63))
                two.append((d & ((1 << 64) - 1)) - (1 << 63))
                bands.append(band_keys(superminhash(s)) if len(s) else np.zeros(0, np.int64))
                few.append(s.view(np.int64) if len(s) <= SMALL else np.zeros(0, np.int64))
            yield {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_shingles": n, "set1": one, "set2": two, "bands": _lists(bands), "few": _lists(few)}

    fields = "doc_id long, text_hash long, n_shingles long, set1 long, set2 long, bands array<long>, few array<long>"
    return map_arrow(hashed_text(docs), run, fields)


def hashed_text(docs: DataFrame) -> DataFrame:
    return doc_text(docs).withColumn("text_hash", F.xxhash64("text"))


def elements(texts: DataFrame) -> DataFrame:
    """(node, n_shingles, elements): the whole sets of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashed = WordHash()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sets = [s.view(np.int64) for s in shingle_sets(part.column("text").to_pylist(), hashed)]
                yield {"node": part.column("node"), "n_shingles": [len(s) for s in sets], "elements": _lists(sets)}

    return map_arrow(texts, run, "node long, n_shingles long, elements array<long>")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(element, node, n_shingles, after): the shingles of each set's prefix in order of rarity that other sets have too.

    after: how many shingles of the set follow the element in that order, itself included.
    """
    each = sets.select("node", "n_shingles", F.explode("elements").alias("element"))
    shared = each.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    held = each.join(shared, "element").groupBy("node", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("n", "element"))).alias("held")
    )
    # the shingles that no other set has come first in the order
    room = F.expr(f"cast(size(held) - ceil({percent} * n_shingles / 100) + 1 as int)")
    cut = held.withColumn("room", room).where("room > 0").select(
        "node", "n_shingles", F.size("held").alias("size"), F.posexplode(F.slice("held", F.lit(1), F.col("room"))).alias("i", "h")
    )
    return cut.select("h.element", "node", "n_shingles", (F.col("size") - F.col("i")).alias("after"))


def verify(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs of nodes (pivot, member) of texts (node, text) whose full sets have 100 * intersection >= percent * union, as (u, v).

    Members meet their pivot in groups of about PER_TASK, each with a copy of the pivot's text, read as one stream.
    """
    groups = pairs.groupBy("pivot").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / PER_TASK).cast("int"))
    members = pairs.join(groups, "pivot").select(
        "pivot",
        F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"),
        F.lit(1).alias("role"),
        F.col("member").alias("node"),
    )
    pivots = groups.select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("pivot").alias("node")
    )
    rows = members.unionByName(pivots).join(texts, "node").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashed = WordHash()
        at, pivot = None, np.zeros(0, np.uint64)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            u, v = [], []
            for p, salt, role, node, s in zip(
                *(batch.column(c).to_pylist() for c in ("pivot", "salt", "role", "node")),
                shingle_sets(batch.column("text").to_pylist(), hashed),
                strict=True,
            ):
                if role == 0:
                    at, pivot = (p, salt), s
                elif at == (p, salt):
                    both = len(np.intersect1d(pivot, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(pivot) + len(s) - both):
                        u.append(p)
                        v.append(node)
            yield {"u": u, "v": v}

    return map_arrow(rows.select("pivot", "salt", "role", "node", "text"), run, "u long, v long").distinct()


def _joined(found: DataFrame, links: DataFrame, parts: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The components of links and of those between the sets of shared prefixes found (element, node, n_shingles, after)."""
    found = materialize(found, "prefixes")
    shared = f"ceil({percent} * (n_shingles + p.n_shingles) / {100 + percent})"  # the least intersection
    able = f"least(after, p.after) >= {shared} and least(n_shingles, p.n_shingles) >= {shared}"
    checked, pivots = None, PIVOTS
    while True:
        placed = materialize(found.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        groups = placed.groupBy("element").agg(
            F.min("component").alias("a"), F.max("component").alias("b")
        ).where("a <> b").select("element")
        found = materialize(placed.join(groups, "element", "left_semi"), "prefixes")
        # the next pivots of each group; every task sends its own few
        row = F.struct("node", "n_shingles", "after", "component")
        task = F.spark_partition_id().alias("task")
        own = found.select(
            "element", row.alias("p"), F.row_number().over(Window.partitionBy("element", task).orderBy("node")).alias("k")
        ).where(f"k <= {pivots}")
        heads = own.select(
            "element", "p", F.row_number().over(Window.partitionBy("element").orderBy("p.node")).alias("k")
        ).where(f"k <= {pivots}").select("element", "p")
        heads = materialize(heads, "heads")
        if heads.isEmpty():
            return parts
        pairs = found.join(heads, "element").where(f"node > p.node and component <> p.component and {able}").select(
            F.col("p.node").alias("pivot"), F.col("node").alias("member")
        ).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["pivot", "member"], "left_anti")
        pairs = materialize(pairs, "pairs")
        checked = pairs if checked is None else checked.unionByName(pairs)
        if not pairs.isEmpty():
            more = materialize(verify(pairs, texts, percent), "links")
            if not more.isEmpty():
                links = links.unionByName(more)
                parts = components(links)
        # what has been a pivot of a group is done there
        last = heads.groupBy("element").agg(F.max("p.node").alias("last"))
        found = found.join(last, "element").where("node > last").drop("last", "component")
        pivots *= MORE


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sets = materialize(sketches(docs), "sketches")
    classes = sets.where("n_shingles > 0").groupBy("set1", "set2").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands", "few")).alias("rep")
    )
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes.select("node", "set1", "set2", "low", "rep.*"), "classes")
    bands = classes.select(F.explode("bands").alias("band"), "node", "n_shingles")
    buckets = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(bands.join(buckets, "band"), "members")
    # what is checked is a member or a small set: one text of each is picked out of all once
    small = classes.where(f"n_shingles <= {SMALL}")
    short = prefixes(small.select("node", "n_shingles", F.col("few").alias("elements")), percent)
    short = materialize(short, "short")
    wanted = members.select("node").unionByName(short.select("node")).distinct()
    rep = classes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    mine = F.equal_null("doc_id", "_id") & (F.col("text_hash") == F.col("_hash"))
    texts = materialize(hashed_text(docs).join(rep, mine).select("node", "text"), "texts")

    def placed(parts: DataFrame) -> DataFrame:
        """members with their components so far."""
        return members.join(parts, "node", "left").select(
            "band", "node", "pivot", "n_shingles", F.coalesce("component", "node").alias("component")
        )

    first = members.groupBy(
        F.col("node").alias("member")
    ).agg(F.min("pivot").alias("pivot")).where("member <> pivot").select("pivot", "member")
    links = materialize(verify(first, texts, percent), "links")
    # members and their bucket's smallest that are still apart
    parts = components(links)
    now = materialize(placed(parts), "placed")
    heads = now.where("node = pivot").select("band", F.col("component").alias("head"))
    apart = now.join(heads, "band").where("node <> pivot and component <> head").select(
        "pivot", F.col("node").alias("member")
    ).distinct()
    apart = materialize(apart.join(first, ["pivot", "member"], "left_anti"), "apart")
    if not apart.isEmpty():
        links = materialize(links.unionByName(verify(apart, texts, percent)), "links")
        parts = components(links)
        now = materialize(placed(parts), "placed")
    # all others: the sets of buckets that are still mixed, and small sets
    mixed = now.groupBy("band").agg(
        (F.min("component") != F.max("component")).alias("mixed"), F.count("*").alias("n")
    ).where("mixed and n > 2").select("band")
    left = now.where(f"n_shingles > {SMALL}").join(mixed, "band", "left_semi").select("node").distinct()
    large = prefixes(elements(texts.join(left, "node", "left_semi")).dropDuplicates(["node"]), percent)
    of = _joined(short.unionByName(large), links, parts, texts, percent)
    own = classes.join(of, "node", "left").select("set1", "set2", "low", F.coalesce("component", "node").alias("component"))
    own = materialize(own, "components")
    lows = own.groupBy("component").agg(F.min("low").alias("component_id"))
    own = own.join(lows, "component").select("set1", "set2", "component_id")
    joined = sets.drop("bands", "few", "text_hash").join(own, ["set1", "set2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.equal_null(F.col("doc_id"), component).alias("kept"))
