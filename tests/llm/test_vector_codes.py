"""Vector codes against plain Lloyd rounds in Python integers, and the tree walk against all distances."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from breachlens.llm import vector_codes as vc
from breachlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """{(vec_id, code, error, label_error, digest)} of rows (vec_id, vector, label), as a sorted list."""
    kept = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    ints = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))[:256]
    d = width // 4
    part = [[tuple(v[p * d:(p + 1) * d]) for v in ints] for p in range(4)]
    books = [[part[p][k] for k in order] for p in range(4)]

    def nearest(p):
        known = {}
        for x in set(part[p]):
            known[x] = min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
        return [known[x] for x in part[p]]

    for _ in range(4):
        for p in range(4):
            groups = {}
            for x, (_, j) in zip(part[p], nearest(p)):
                groups.setdefault(j, []).append(x)
            for j, own in groups.items():
                books[p][j] = tuple(sum(c) // len(own) for c in zip(*own))
    found = [nearest(p) for p in range(4)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(f[k][0] for f in found) for k in range(len(kept))]
    label = {}
    for (_, _, lab), e in zip(kept, error):
        label[lab] = label.get(lab, 0) + e
    return sorted(((kept[k][0], "".join(f"{f[k][1]:02x}" for f in found), error[k], label[kept[k][2]], digest)
                   for k in range(len(kept))), key=str)


def got(df):
    made, books = vc.codes(df)
    digest = vc.books_sha256(books)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], digest) for r in made.collect()), key=str)


@pytest.mark.parametrize("d,spread,kind", [(2, 50, float), (16, 400, float), (3, 3, float), (4, 1 << 40, object)])
def test_tree_walk_is_exact(d, spread, kind, monkeypatch):
    monkeypatch.setattr(vc, "LEAF", 8)
    rng = np.random.default_rng(d)
    centres = rng.integers(-spread, spread, (20, d))
    points = (centres[rng.integers(0, 20, 900)] + rng.integers(-2, 3, (900, d)))
    entries = np.concatenate([points[rng.integers(0, 900, 60)], points[:3], points[:3]])      # ties between equal entries
    points, entries = (np.array(x.tolist(), kind) if kind is object else x.astype(float) for x in (points, entries))
    codes, sums, counts = vc.Codebook(entries).assign(points)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)) for e in entries] for x in points]
    want = [min(range(len(entries)), key=lambda j: (row[j], j)) for row in exact]
    assert codes.tolist() == want
    for j in range(len(entries)):
        own = points[np.array(want) == j]
        assert counts[j] == len(own) and (sums[j] == (own.sum(axis=0) if len(own) else 0)).all()


def test_whole_nodes_are_assigned(monkeypatch):
    """Far clusters are settled by bounds alone: no leaf compares distances."""
    monkeypatch.setattr(vc, "distances", lambda *_: pytest.fail("a leaf was compared"))
    entries = np.array([[0., 0.], [10_000., 0.], [0., 10_000.], [10_000., 10_000.]])
    points = np.repeat(entries, 500, axis=0) + np.random.default_rng(1).integers(-9, 9, (2000, 2))
    codes, _, counts = vc.Codebook(entries).assign(points)
    assert counts.tolist() == [500] * 4 and codes.tolist() == np.repeat(np.arange(4), 500).tolist()


def test_op13(spark):
    rows = duckdb.connect().sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    made = sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256"))
                   for r in QUERIES["op13_vector_codes"](spark, SF).collect()), key=str)
    assert made == plain(rows)


def odd_rows():
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), [rng.choice([-1.5, 0.25, 0.2504, 3.0]) for _ in range(8)], rng.choice([None, 1, 2]))
            for _ in range(700)]
    rows += [(1, None, 1), (2, [None] + [0.0] * 7, 1), (3, [float("nan")] * 8, 2), (4, [float("inf")] + [0.0] * 7, None)]
    return rows + [(5, [0.5] * 8, 7)] * 400


def test_odd_tables(spark):
    rows = odd_rows()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)
    clash = [r + (1, "x") for r in rows[:50]]
    assert got(spark.createDataFrame(clash, SCHEMA + ", code int, v string")) == plain(clash)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, 1)], SCHEMA)) == []
    ragged = [(1, [1.0, 2.0], 1), (2, [1.0] * 6, None), (3, [], 1)]
    assert got(spark.createDataFrame(ragged, SCHEMA)) == plain(ragged)


def test_values_beyond_doubles(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 1e9 for _ in range(4)], i % 3) for i in range(300)]
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), lab) for i, v, lab in rows]
    want = [(a, b, None if c >= 1 << 63 else c, e) for a, b, c, _, e in plain(rows)]
    assert [(a, b, c, e) for a, b, c, _, e in got(spark.createDataFrame(rows, SCHEMA))] == want
