"""Layout, embedding near-dedup and filter audit against brute force, with nulls, ties, repeated rows, odd columns and empty tables."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from lectern.llm import embedding_dedup, interactions, layout

DOCS = "doc_id long, text string, lang string, source string, z long, part string, file string"


def plain(df):
    return sorted((tuple((v is None, v if v is not None else 0) for v in r) for r in df.collect()), key=str)


def layout_by_hand(rows: list, size: int) -> list:
    """(doc_id, z, position, file, files_touched, files_matching, file_bounds), distinct ids."""
    byte = lambda v: (v is not None, (v or "").encode())
    of = [
        (byte(s), byte(g), -1 if t is None else len(t.encode()), zlib.crc32(b"" if d is None else str(d).encode()) % 365) for d, t, g, s in rows
    ]
    n = len(rows)
    at = [tuple(8 * sum(x[k] < row[k] for x in of) // n for k in range(4)) for row in of]
    z = [sum((c[k] >> b & 1) << (4 * b + 3 - i) for b in range(3) for i, k in enumerate((3, 2, 1, 0))) for c in at]
    order = sorted(range(n), key=lambda i: (z[i], rows[i][0] is not None, rows[i][0] or 0))
    place = {i: p for p, i in enumerate(order)}
    files: dict[int, list] = {}
    for i in order:
        files.setdefault(place[i] // size, []).append(at[i])
    bounds = {f: [(min(c[k] for c in cs), max(c[k] for c in cs)) for k in range(4)] for f, cs in files.items()}
    out = []
    for i in range(n):
        s, g, length, date = at[i]
        query = [(s, s), (g, g), (length - 1, length + 1), (date - 1, date + 1)]
        meets = sum(all(lo <= b and a <= hi for (lo, hi), (a, b) in zip(query, bounds[f], strict=True)) for f in files)
        holds = sum(any(all(lo <= x <= hi for (lo, hi), x in zip(query, c, strict=True)) for c in cs) for cs in files.values())
        f = place[i] // size
        out.append((rows[i][0], z[i], place[i], f, meets, holds, ",".join(str(x) for b in bounds[f] for x in b)))
    return out


@pytest.mark.parametrize("seed,n,size", [(1, 300, 7), (2, 90, 4), (3, 5, 2), (4, 260, 40)])
def test_clustered_layout(spark, seed, n, size):
    r = random.Random(seed)
    source = lambda: r.choice([None, "", "a", "a", "a", "b", "é", "\U0001f600", "z"])
    rows = [
        (i * 3, None if r.random() < 0.1 else "é" * r.choice([0, 1, 1, 5, 9, 30]), r.choice([None, "en", "en", "fr", "zh"]), source()) for i in range(n)
    ]
    rows[1] = (None, *rows[1][1:])
    docs = spark.createDataFrame([(*x, 1, "p", "f") for x in rows], DOCS)
    got = layout.clustered_layout(docs, size)
    assert got.columns == ["doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds"]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == sorted(layout_by_hand(rows, size), key=lambda x: x[2])


def test_clustered_layout_of_repeated_rows_and_no_rows(spark):
    rows = [(1, "x", "en", "s", 0, "", "")] * 5 + [(None, None, None, None, None, None, None)] * 3
    got = layout.clustered_layout(spark.createDataFrame(rows, DOCS), 3).orderBy("position").collect()
    assert [x["position"] for x in got] == list(range(8)) and [x["doc_id"] for x in got] == [None] * 3 + [1] * 5
    assert {(x["files_touched"], x["files_matching"]) for x in got if x["doc_id"]} == {(2, 2)}
    assert layout.clustered_layout(spark.createDataFrame([], DOCS)).count() == 0


def vectors_by_hand(rows: list, threshold: float = 0.95) -> list:
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [embedding_dedup.unit(np.array([v]))[0] if usable(v) else None for _, v in rows]
    n = len(rows)
    link = [
        [i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold for j in range(n)]
        for i in range(n)
    ]
    group = list(range(n))
    for _ in range(n):
        before = list(group)
        for i, j in itertools.product(range(n), repeat=2):
            if link[i][j]:
                group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    low = {g: min((rows[i][0] for i in range(n) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(rows[i][0], sum(link[i]), low[group[i]], rows[i][0] == low[group[i]]) for i in range(n)]


@pytest.mark.parametrize("kind,rows_a_slice,block", [("float", 4096, 1024), ("float", 16, 5), ("double", 40, 7)])
def test_near_duplicate_vectors(spark, monkeypatch, kind, rows_a_slice, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(5)
    base = r.normal(size=(20, 12))
    made = [b + r.normal(size=12) * s for b in base for s in (0, 0.1, 0.2, 0.25, 0.3, 0.4)]
    made += [3 * base[0], base[0], -base[1], base[2] * 1e-30]
    made = [[float(np.float32(x)) if kind == "float" else float(x) for x in v] for v in made]
    odd = [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [1.0]]
    rows = [(100 - i if i % 13 else None, v) for i, v in enumerate(made + odd)] + [(7, made[3]), (7, made[3]), (8, made[60])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, n int")
    got = embedding_dedup.near_duplicate_vectors(df, rows=rows_a_slice)
    want = vectors_by_hand(rows)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert 20 < sum(x[1] > 0 for x in want) < len(want) - 20
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicate_vectors(empty).collect() == []


def test_codes_never_miss_a_pair():
    """Thresholds right at the cosines of pairs: what the codes leave open is decided in double precision."""
    r = np.random.default_rng(1)
    for width in (3, 64, 1100):
        v = embedding_dedup.unit(r.normal(size=(60, width)))
        codes, scale, error = embedding_dedup.quantised(v)
        assert (np.abs(v @ v.T - (codes * scale[:, None]) @ (codes * scale[:, None]).T) <= error[:, None] + (1 + error[:, None]) * error + 1e-12).all()
        whole = {"codes": codes.astype(np.float32), "scale": scale, "error": error, "unit": v}
        for i, j in ((0, 1), (3, 9), (20, 40)):
            cosine = float(np.einsum("ij,ij->i", v[i : i + 1], v[j : j + 1])[0])
            for threshold, wanted in ((cosine, True), (np.nextafter(cosine, 2), False)):
                a, b = embedding_dedup.linked(whole, whole, threshold)
                assert ((i, j) in set(zip(a.tolist(), b.tolist(), strict=True))) == wanted


def audit_by_hand(docs: list, labels: list) -> list:
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    first: dict = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t],
        }
        rows.append((s or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = []
    for part in {x[0] for x in rows}:
        total = dict.fromkeys("ABCDE", 0)
        found = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in rows if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                failing = [x for x in rows if x[0] == part and f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                alone = sum(x[1] == {f} for x in failing)
                found.append((part, order, step, len(left), len(gone), len(failing) - len(gone), alone, sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out += [(*x, total[x[1][x[2] - 1]]) for x in found]
    return out


def test_interactions(spark):
    r = random.Random(3)
    words = ["a", "b\x1c", "Upper", "c\u3000d", "e#", "f", "g", "LOUD", "é"] + [f"w{i}" for i in range(90)]
    make = lambda n: r.choice([" ", "\t\n", "\x0b\x0c"]).join(r.choice(words) for _ in range(n))
    texts = [None, "", " \n", "X", *(make(r.choice([3, 49, 50, 51, 70, 200])) for _ in range(25)), " " + make(50) + " "]
    docs = [(r.choice([None, *range(30)]), r.choice(texts), r.choice([None, "", "s", "t"])) for _ in range(150)]
    labels = [(r.choice([None, *range(30)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(40)]
    d = spark.createDataFrame([(i, t, "en", s, 1, "x", "y") for i, t, s in docs], DOCS)
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.interactions(d, m)
    assert got.columns == ["part", "filter_order", "step", *interactions.COUNTS]
    assert sorted(map(tuple, got.collect())) == sorted(audit_by_hand(docs, labels))
    assert interactions.interactions(d.limit(0), m).count() == 0


def test_matrices():
    m = interactions.matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    assert (m["kept"] + m["removed"]).max() == 1 and (m["removed"] + m["redundant"]).max() == 1
    assert (m["unique"].sum(0) == 1).all() and (m["removed"].sum(0)[::5] == 16).all()
