import math
from collections import Counter

import numpy as np
import pytest

from flowspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, k1 long, component int, weight string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "w") for i, v in rows], SCHEMA).repartition(5)


def brute(rows, counted=False, components=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    counts = Counter(tuple(x) for _, x in kept)
    weight = [n if counted else 1 for n in counts.values()]
    n, d = sum(weight), len(kept[0][1])
    sums = [sum(w * x[k] for x, w in zip(counts, weight)) for k in range(d)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in counts])
    cov = (y * np.array(weight)[:, None]).T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in kept:
        z = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(min(components, d)):
            out.append((i, k + 1, n, dev, z @ v[:, k] / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def compare(got, want):
    assert len(got) == len(want)
    signs = {}
    by = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4]))
    for g, w in zip(sorted(map(tuple, got), key=by), sorted(want, key=by), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert abs(abs(g[4]) - abs(w[4])) < 1e-8
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(g[1], g[4] * w[4] > 0) == (g[4] * w[4] > 0)
        assert g[6] < 1e-9


def vectors(n, d, seed, copies=3):
    rng = np.random.default_rng(seed)
    base = (rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 3, d))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    return rows + [(1000 + i, base[0].tolist()) for i in range(n * copies)] + [(7, base[1].tolist()), (7, base[1].tolist()), (None, base[2].tolist())]


@pytest.mark.parametrize("counted", [False, True])
def test_equals_brute_force(spark, monkeypatch, counted):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 50)
    rows = vectors(120, 20, 1)
    rows += [(5000, None), (5001, [1.0] * 19 + [None]), (5002, [float("nan")] * 20), (5003, [float("inf")] + [0.0] * 19), (5004, [1.0, 2.0])]
    got = whitening.whitening(frame(spark, rows), counted=counted)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), brute([r for r in rows if r[0] != 5004], counted))


def test_fewer_dimensions_than_components(spark):
    rows = vectors(40, 3, 2)
    compare(whitening.whitening(frame(spark, rows)).collect(), brute(rows))


def test_the_same_bits_however_rows_are_dealt(spark):
    rows = vectors(200, 8, 3)
    once = whitening.whitening(frame(spark, rows)).collect()
    again = whitening.whitening(frame(spark, rows[::-1]).repartition(3)).collect()
    strip = lambda rs: Counter(tuple(r)[:6] for r in rs)
    assert strip(once) == strip(again)


def test_vectors_that_do_not_differ(spark):
    got = whitening.whitening(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [tuple(r)[:6] for r in sorted(got)] == [(i, c, 1, 0, None, 0.0) for i in (1, 2) for c in (1, 2)]
    assert all(r.identity_error == 0 for r in got)


def test_huge_entries_and_exact_deviations(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whitening(frame(spark, rows)).collect()
    assert len(got) == 6 and all(r.deviation is None or r.deviation >= 0 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitening(frame(spark, rows)).count() == 0
