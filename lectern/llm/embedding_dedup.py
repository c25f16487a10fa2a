"""Near-duplicate vectors by tile products of int8 codes with rigorous error bounds.

Equal vectors are one class. A class's unit vector a is coded as a' = scale * q with components q from -127 to 127, and its error is
e = |a - a'|, measured in double precision. By Cauchy-Schwarz |a.b - a'.b'| <= e_a + (1 + e_a) * e_b, so a product of
codes says of most pairs that their cosine is below the threshold, or not below it; the pairs in between are recomputed from the
vectors themselves in double precision. Codes are multiplied as float32 matrices: their products are integers below 2^24 up
to 1,040 components, thus exact; wider vectors are multiplied in pieces of that width.

Which tiles meet:

* centres, a bounded sample of the vectors, divide the sphere into cells, one for each `rows` classes, MOST at most. A class is
  at home in its nearest centre's cell, and a guest in each cell before its own whose dividing plane is no farther than the
  distance of two unit vectors at the threshold; all others can hold no partner of it. So clustered vectors meet few cells;
  vectors without structure meet about half of them, as in any product of all tiles, and the work is quadratic;
* a cell's home rows and guests are dealt to slices of about `rows`, and each task multiplies two of a cell's slices, or one by itself. A cell
  with a third of all rows is many tasks.

No pair leaves a task: it sends for each of its classes the number of vectors linked and one vector of the same
component, so a group of n near copies costs O(n) rows for each tile. Components of these edges are found in distributed tables.

Row rules: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
different lengths. Repeated rows are vectors of their own, which link with each other. component_id is the smallest vec_id of the rows
of the component; a class is a node of its own, so rows of one vec_id with different vectors are not linked by it, and a null vec_id is
of its vector's component and kept only if the component has no other id. Labels and other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import map_arrow, materialize
from .components import components

THRESHOLD = 0.95
ROWS, NUMBERS = 4096, 1 << 22  # classes of a slice; components of a slice
MOST = 1024  # cells
BLOCK = 1024
EXACT = 1040
SLACK = 4e-6  # above the rounding of float32 factors of at most 1.1
CELL = "node long, copies long, dim int, cell int, guests array<int>, codes binary, scale double, error double, vector binary"
TILE = "node long, n long, root long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, whatever the magnitude of their components."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the lengths of what the codes miss."""
    scale = np.abs(units).max(1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    error = np.sqrt(((units - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of float32 matrices of whole numbers up to 127."""
    out = a[:, :EXACT] @ b[:, :EXACT].T
    for i in range(EXACT, a.shape[1], EXACT):
        out += a[:, i : i + EXACT] @ b[:, i : i + EXACT].T
    return out


def linked(one: dict, two: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of two blocks whose cosine is at least the threshold."""
    s = products(one["codes"], two["codes"]) * two["scale"].astype(np.float32)
    room = (1 + one["error"]) * two["error"].max() + one["error"] + SLACK
    i, j = np.nonzero(s >= ((threshold - room) / one["scale"]).astype(np.float32)[:, None])
    if not len(i):
        return i, j
    near = s[i, j] * one["scale"][i]
    room = one["error"][i] + (1 + one["error"][i]) * two["error"][j] + SLACK
    found, open_ = near - room >= threshold, near + room >= threshold
    open_ &= ~found
    at = np.flatnonzero(open_)
    for k in range(0, len(at), 1 << 14):
        part = at[k : k + (1 << 14)]
        found[part] = np.einsum("ij,ij->i", one["unit"][i[part]], two["unit"][j[part]]) >= threshold
    return i[found], j[found]


def merged(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots of rows, each the smallest of its component so far, with the links (u, v) added."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _tile(table: pa.Table, threshold: float, single: bool) -> dict:
    side = table.column("side").to_numpy()
    order = np.argsort(side, kind="stable")
    table, side = table.take(pa.array(order)), side[order]
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    stacked = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(len(node), -1)
    whole = {
        "codes": stacked("codes", np.int8).astype(np.float32),
        "scale": table.column("scale").to_numpy(),
        "error": table.column("error").to_numpy(),
        "unit": unit(stacked("vector", np.float32 if single else np.float64)),
    }
    split = int((side == 0).sum())
    itself = split == len(side)
    root, n = np.arange(len(node)), np.zeros(len(node), np.int64)
    block = lambda a, end: {k: v[a : min(end, a + BLOCK)] for k, v in whole.items()}
    for a in range(0, split, BLOCK):
        one = block(a, split)
        for b in range(a if itself else split, len(node), BLOCK):
            i, j = linked(one, block(b, len(node)), threshold)
            if a == b:
                i, j = i[i < j], j[i < j]
            i, j = i + a, j + b
            n += np.bincount(i, copies[j], len(n)).astype(np.int64) + np.bincount(j, copies[i], len(n)).astype(np.int64)
            root = merged(root, i, j)
    has = n > 0
    return {"node": node[has], "n": n[has], "root": node[root[has]]}


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): vec_id with a key that is null for vectors that link with nothing; the distinct vectors (node, k1, k2, low, copies, embedding)."""
    e, infinite = F.col("embedding"), F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < infinite))
    usable = F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    key = lambda *c: F.when(usable, F.xxhash64(*c))
    rows = vectors.select("vec_id", key(e).alias("k1"), key(F.lit(1), e).alias("k2"), F.when(usable, e).alias("embedding"))
    # two 64-bit hashes stand for a vector
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    return rows.drop("embedding"), materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def celled(classes: DataFrame, centres: list[np.ndarray], threshold: float) -> DataFrame:
    """The classes, coded, with their own cell and those where they are guests."""
    single = isinstance(classes.schema["embedding"].dataType.elementType, FloatType)
    far = np.sqrt(2 - 2 * threshold) + 1e-6
    of_width: dict[int, list[int]] = {}
    for c, v in enumerate(centres):
        of_width.setdefault(len(v), []).append(c)
    grids = {}
    for width, which in of_width.items():
        middle = unit(np.stack([centres[c] for c in which]))
        gap = np.sqrt(np.maximum(2 - 2 * middle @ middle.T, 0))
        grids[width] = (np.array(which), middle, np.maximum(gap, 1e-9))
    count = len(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            lists = batch.column("embedding")
            widths = lists.value_lengths().to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                v = part.column("embedding").flatten().to_numpy().reshape(-1, width).astype(np.float32 if single else np.float64)
                units = unit(v)
                codes, scale, error = quantised(units)
                if width in grids:
                    which, middle, gap = grids[width]
                    near = units @ middle.T
                    home = near.argmax(1)
                    plane = (near[np.arange(len(v)), home][:, None] - near) / gap[home]
                    guest = (plane <= far) & (np.arange(len(which)) < home[:, None])
                    cell, guests = which[home], [which[g] for g in guest]
                else:
                    cell, guests = np.full(len(v), count + width), [[]] * len(v)
                yield {
                    "node": part.column("node"), "copies": part.column("copies"), "dim": np.full(len(v), width),
                    "cell": cell, "guests": [list(map(int, g)) for g in guests], "codes": [c.tobytes() for c in codes],
                    "scale": scale, "error": error, "vector": [x.tobytes() for x in v],
                }

    return map_arrow(classes.select("node", "copies", "embedding"), place, CELL)


def tasks(cells: DataFrame, rows: int) -> DataFrame:
    """Every row once for each task (cell, a, b) that multiplies its slice: as side 0 in slice a, or as side 1 in slice b."""
    homes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    visits = cells.select(F.explode("guests").alias("cell")).groupBy("cell").agg(F.count("*").alias("visits"))
    slices = homes.join(visits, "cell", "left").select(
        "cell",
        F.ceil(F.col("n") / rows).cast("int").alias("own"),
        F.ceil(F.coalesce("visits", F.lit(0)) / rows).cast("int").alias("more"),
    )
    slices = F.broadcast(materialize(slices, "slices"))  # a row for each cell
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"))
    pair = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    packed = [c for c in cells.columns if c not in ("cell", "guests", "dim")]
    me, last = F.col("me"), F.col("own") + F.col("more")
    up = F.transform(F.sequence(me, last - 1), lambda b: pair(me, b, 0))
    down = F.when(me > 0, F.transform(F.sequence(F.lit(0), me - 1), lambda a: pair(a, me, 1))).otherwise(F.array().cast(f"array<{each_type()}>"))
    home = cells.join(slices, "cell").withColumn("me", at("own")).select("cell", *packed, F.explode(F.concat(up, down)).alias("t"))
    met = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda a: pair(a, me, 1))
    guest = cells.drop("cell").withColumn("cell", F.explode("guests")).join(slices, "cell").withColumn(
        "me", F.col("own") + at("more")
    ).select("cell", *packed, F.explode(met).alias("t"))
    return home.unionByName(guest).select("cell", "t.a", "t.b", "t.side", *packed)


def each_type() -> str:
    return "struct<a:int,b:int,side:int>"


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    keyed, classes = classes_of(vectors)
    single = isinstance(classes.schema["embedding"].dataType.elementType, FloatType)
    n, widest = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if n:
        rows = max(1, min(rows, NUMBERS // widest))
        sample = classes.orderBy(F.xxhash64(F.lit(2), "k1")).limit(min(most, n // rows)).select("embedding").collect() if n >= 2 * rows else []
        cells = materialize(celled(classes, [np.array(r[0], np.float64) for r in sample], threshold), "cells")

        def multiply(part: pa.Table) -> pa.Table:
            return pa.table(_tile(part, threshold, single), pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

        found = materialize(tasks(cells, rows).groupBy("cell", "a", "b").applyInArrow(multiply, TILE), "links")
    else:
        found = vectors.sparkSession.createDataFrame([], TILE)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    part = F.coalesce("component", "node")
    placed = classes.drop("embedding").join(parts, "node", "left").join(links, "node", "left").withColumn("component", part)
    placed = materialize(placed, "placed")
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    known = placed.join(lows, "component").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("usable")
    )
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return keyed.join(known, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.equal_null("vec_id", component).alias("kept")
    )
