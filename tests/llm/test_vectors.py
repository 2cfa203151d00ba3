"""Whitening and top-k products against exact brute force."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from casemill.llm import topk_search
from casemill.llm.eigen import largest_roots, leading, polynomial_modulo, primes_for, remainders_joined, roots_above, square_free
from casemill.llm.topk_search import top_products
from casemill.llm.whitening import Whitener, fit, whitened_vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, norm string, component int"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA.replace("float", kind))


def usable(rows, double=False):
    """(id, whole vector) of the rows that take part."""
    good = [(i, [c if double else float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in good)
    size = max(sizes, key=lambda n: (sizes[n], n)) if sizes else 0
    return [(i, [math.floor(Fraction(c) * 64) for c in v]) for i, v in good if len(v) == size]


def brute_top(rows, k=20, double=False):
    own = usable(rows, double)
    out = []
    for i, q in own:
        if i is not None and i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in own if j != i)[:k]
            out += [(i, rank, None if none else j, -s if -(2**63) <= -s < 2**63 else None) for rank, (s, none, j) in enumerate(found, 1)]
    return sorted(out, key=str)


def cluster_rows(seed, n, size, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    x = (centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, size))) * rng.lognormal(0, 0.7, (n, 1))
    return [(k, list(map(float, v))) for k, v in enumerate(x)]


@pytest.mark.parametrize("size,spread,scale,kind", [(8, 0.05, 1, "float"), (3, 0.02, 1, "float"), (16, 0.4, 1, "float"), (5, 0.1, 1e4, "float"), (5, 0.1, 4e7, "double"), (4, 0.1, 1e12, "double"), (1, 0.3, 1, "float")])
def test_top_products(spark, monkeypatch, size, spread, scale, kind):
    monkeypatch.setattr(topk_search, "BUCKET", 32)
    rows = [(i, [c * scale for c in v]) for i, v in cluster_rows(size, 420, size, spread)]
    rows[40] = (40, [0.0] * size)
    assert sorted(map(tuple, top_products(table(spark, rows, kind).repartition(3), block=9).collect()), key=str) == brute_top(rows, double=kind == "double")


def test_pruning_by_coordinate_is_used_and_exact(monkeypatch):
    rng = np.random.default_rng(5)
    used = Counter()
    for name in ("_by_coordinate", "_by_length"):
        old = getattr(topk_search.Queries, name)

        def wrapped(self, bucket, rows, floors, old=old, name=name):
            out = old(self, bucket, rows, floors)
            used[name] += len(rows) - (0 if out is None else len(out))
            return out

        monkeypatch.setattr(topk_search.Queries, name, wrapped)
    x = np.floor(64 * (rng.normal(size=(8, 6))[rng.integers(0, 8, 3000)] * 3 + 0.02 * rng.normal(size=(3000, 6))))
    q = topk_search.Queries(np.arange(100), x[:100], np.full(100, -np.inf), 5, "float64")
    order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
    for at in range(0, 3000, 100):
        q.meet(topk_search.Bucket(order[at : at + 100], x[order[at : at + 100]]))
    for i in range(100):
        s = x @ x[i]
        best = sorted((-s[j], j) for j in range(3000) if j != i)[:5]
        assert q.found[i].tolist() == [j for _, j in best] and q.scores[i].tolist() == [-v for v, _ in best]
    assert used["_by_coordinate"] > 100 and used["_by_length"] > 100


def odd_rows():
    rng = random.Random(4)
    rows = [(k, [rng.choice([0.0, 0.5, -1.25, 2.0]) for _ in range(4)]) for k in range(-40, 60)]
    rows += [(1000 + k, [0.5, 0.5, -1.25, 2.0]) for k in range(60)]  # a vector that a third of the rows share
    rows += [(None, None), (20, None), (21, []), (22, [1.0, None, 1.0, 1.0]), (40, [float("nan"), 1.0, 1.0, 1.0]), (60, [1.0, float("inf"), 0.0, 0.0]), (61, [1.0, 2.0]), (None, [2.0, 2.0, 2.0, 2.0]), (None, [2.0, 2.0, 2.0, 2.0]), (0, [9.0, 9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0, 9.0])]
    return rows


def test_nulls_ties_and_repeats(spark, monkeypatch):
    rows = odd_rows()
    for bucket in (1024, 7):
        monkeypatch.setattr(topk_search, "BUCKET", bucket)
        assert sorted(map(tuple, top_products(table(spark, rows)).collect()), key=str) == brute_top(rows)
    few = [(20, [1.0]), (5, [2.0]), (40, [-1.0])]
    assert sorted(map(tuple, top_products(table(spark, few)).collect()), key=str) == brute_top(few)
    for none in ([], [(1, [1.0]), (3, [2.0])], [(20, None)]):
        assert top_products(table(spark, none)).collect() == []


def exact_fit(rows):
    x = [tuple(v + 1_000_000 for v in v) for _, v in usable(rows)]
    distinct = sorted(set(x))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in distinct]).reshape(n, len(sums))
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], vectors.T[::-1]


@pytest.mark.parametrize("size,n", [(20, 300), (5, 40), (24, 12)])
def test_whitening(spark, size, n):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(n, size)) @ np.diag(1.3 ** -np.arange(size)) @ np.linalg.qr(rng.normal(size=(size, size)))[0] * 3
    rows = [(k, list(map(float, v))) for k, v in enumerate(x)] + [(500 + k, list(map(float, x[3]))) for k in range(n // 3)] + [(None, None), (7, [None] * size), (8, [float("inf")] * size), (9, [1.0]), (None, list(map(float, x[0])))]
    n_distinct, sums, values, vectors = exact_fit(rows)
    k = min(16, size, n_distinct - 1)
    got = whitening(table(spark, rows)).collect()
    own = usable(rows)
    assert len(got) == k * len(own) and {r.n for r in got} == {n_distinct}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    by = {}
    for r in got:
        by.setdefault(str(r.vec_id), []).append(r)
    for i, v in own:
        deviation = [n_distinct * (c + 1_000_000) - s for c, s in zip(v, sums)]
        for r in by[str(i)]:
            e = values[r.component - 1]
            assert r.deviation == sum(d * d for d in deviation)
            expected = float(np.dot(np.array(deviation) / n_distinct, vectors[r.component - 1])) / e**0.5
            assert abs(abs(r.whitened) - abs(expected)) < 1e-7
            assert abs(r.explained / (e / values.sum()) - 1) < 1e-9


def test_whitening_repeated_eigenvalues_and_odd_rows(spark):
    rows = [(k * 2 + s, [(1.0 if j == k else 0.0) * (1 - 2 * s) for j in range(6)]) for k in range(6) for s in (0, 1)]
    got = whitening(table(spark, rows)).collect()
    assert len(got) == 12 * 6 and max(r.identity_error for r in got) < 1e-12 and max(abs(r.explained - 1 / 6) for r in got) < 1e-12
    odd = whitening(table(spark, odd_rows())).collect()
    assert len(odd) == 4 * len(usable(odd_rows())) and max(r.identity_error for r in odd) < 1e-10
    assert whitening(table(spark, [])).collect() == []
    assert whitening(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []
    huge = whitening(table(spark, [(k, [3e38 * (-1) ** k, float(k)]) for k in range(6)])).collect()
    assert {r.deviation for r in huge} == {None} and len(huge) == 12 and max(r.identity_error for r in huge) < 1e-6


def test_sums_of_any_size():
    w = Whitener.__new__(Whitener)
    w.n, w.first = 10**9, [10**15 + 1, -(10**15)]
    x = np.array([[1.0, 3.0], [2.0**40, 0.0]])
    expected = [sum((10**9 * int(c) - s) ** 2 for c, s in zip(row, w.first)) for row in x]
    assert w.squares(w.deviations(x)) == [v if v < 2**63 else None for v in expected]


@pytest.mark.parametrize("seed", range(12))
def test_polynomial_and_roots(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 9))
    a = rng.integers(-3, 4, (d, max(1, d - seed % 3)))
    m = [[int(v) * 10 ** (seed % 4 * 5) for v in row] for row in a @ a.T]
    if seed % 2:  # blocks of equal matrices: every root at least twice
        m = [[m[i // 2][j // 2] if i % 2 == j % 2 else 0 for j in range(2 * d)] for i in range(2 * d)]
    poly = remainders_joined({p: polynomial_modulo(np.array([[v % p for v in row] for row in m]), p).tolist() for p in primes_for(m)})
    for at in range(-3, 4):  # the determinant of (at I - m) by fractions
        rows = [[Fraction((at if i == j else 0) - v) for j, v in enumerate(row)] for i, row in enumerate(m)]
        value = Fraction(1)
        for k in range(len(rows)):
            pivot = next((i for i in range(k, len(rows)) if rows[i][k]), None)
            if pivot is None:
                value = Fraction(0)
                break
            if pivot != k:
                rows[k], rows[pivot], value = rows[pivot], rows[k], -value
            value *= rows[k][k]
            for i in range(k + 1, len(rows)):
                f = rows[i][k] / rows[k][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
        assert value == sum(c * at**k for k, c in enumerate(poly))
    values = np.linalg.eigvalsh(np.array(m, float))[::-1]
    positive = [v for v in values if v > 1e-6 * max(1, values[0])]
    assert roots_above(poly, Fraction(0)) == len(positive)
    single = square_free(poly)
    assert roots_above(single, Fraction(0)) == len(largest_roots(poly, len(m)))
    found = leading(m, poly, 5)
    assert len(found) == min(5, len(positive))
    for (root, _), v in zip(found, positive):
        assert abs(float(root) / v - 1) < 1e-9
    vectors = np.array([[float(c) for c in v] for _, v in found]).reshape(len(found), len(m))
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max(initial=0) < 1e-14
    assert np.abs(np.array(m, float) @ vectors.T - vectors.T * [float(r) for r, _ in found]).max(initial=0) < 1e-12 * max(1, values[0])


def test_whitening_of_other_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(k, list(map(float, v))) for k, v in enumerate(rng.normal(size=(60, 7)) @ np.diag(range(1, 8)))]
    fitted = fit(table(spark, rows), 4)
    assert (fitted.size, fitted.components) == (7, 4) and fitted.error < 1e-9
    own = {r.vec_id: r.whitened for r in whitened_vectors(table(spark, rows), fitted).collect()}
    for r in whitening(table(spark, rows), 4).collect():
        assert abs(own[r.vec_id][r.component - 1] - r.whitened) < 1e-12
    middle = [float(np.mean(c)) for c in zip(*(v for _, v in rows))]
    new = whitened_vectors(table(spark, [(1, middle), (2, [1.0]), (3, None)]), fitted).collect()
    assert [r.vec_id for r in new] == [1] and max(map(abs, new[0].whitened)) < 0.1
    assert whitened_vectors(table(spark, []), fitted).count() == 0


def test_queries_of_another_table(spark):
    rows, asking = cluster_rows(3, 90, 4, 0.3), [(5, [1.0, -2.0, 0.5, 0.25]), (1000, [40.0, 0.0, 0.0, 1.0]), (1000, [0.0] * 4), (None, [1.0] * 4), (7, [1.0]), (8, None)]
    got = sorted(map(tuple, top_products(table(spark, rows), 6, asking=table(spark, asking)).collect()), key=str)
    expected = []
    for i, q in usable(asking)[:3]:
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable(rows) if j != i)[:6]
        expected += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert got == sorted(expected, key=str)
    assert top_products(table(spark, rows), asking=table(spark, [])).count() == 0 == top_products(table(spark, []), asking=table(spark, asking)).count()
