import datetime as dt

import numpy as np

from evidex.llm.neighbours import nearest, search

DIMS = 24


def _data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, DIMS))
    x = (np.repeat(centres, 15, axis=0) + 0.35 * rng.normal(size=(600, DIMS))).astype(np.float32)
    x[100:130] = x[100]  # a group of equal vectors
    return x


def _brute(x, names, k, minimum):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos, out = y @ y.T, {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and cos[i, j] >= minimum), key=lambda j: (-round(float(cos[i, j]), 5), names[j]))
        out[names[i]] = order[:k]
    return {(q, names[j]) for q, js in out.items() for j in js}


def test_factor_one_is_exact():
    x = _data()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    every = np.arange(len(x))
    q, p, _ = search(x, x, 5, 0.2, 1.0, every, every >= 0)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    for i in range(0, len(x), 50):
        want = np.sort(cos[i])[::-1][:5]
        assert np.allclose(np.sort(cos[i, p[q == i]])[::-1], want[want >= 0.2], atol=1e-6)


def test_nearest_with_dirty_rows(spark):
    x = _data()
    names = [f"p{i:04d}" for i in range(len(x))]
    at = dt.datetime(2024, 1, 1)
    rows = [(n, at, [float(e) for e in v], 1.5) for n, v in zip(names, x)]
    rows += [(names[3], at + dt.timedelta(1), rows[3][2], 1.5), (names[100], at, rows[100][2], 0.0)]
    rows += [("null", at, None, 0.0), ("zero", at, [0.0] * DIMS, 0.0), ("nan", at, [float("nan")] + [1.0] * (DIMS - 1), 0.0), ("short", at, [1.0], 0.0), (None, at, rows[0][2], 0.0)]
    rows += [("moved", at, rows[0][2], 0.0), ("moved", at + dt.timedelta(2), rows[300][2], 0.0)]
    df = spark.createDataFrame(rows, "id string, at timestamp_ntz, vec array<float>, cosine double")
    got = nearest(df, 10, 0.5, factor=1.0, dims=DIMS)
    assert got.columns == ["q", "x", "cosine"]
    names.append("moved")
    want = _brute(np.concatenate([x, x[300:301]]), names, 10, 0.5)
    found = {(r.q, r.x) for r in got.collect()}
    assert len(found & want) >= 0.995 * len(want) and len(found) == len(want)
    quick = {(r.q, r.x) for r in nearest(df, 10, 0.5, factor=0.3, dims=DIMS).collect()}
    assert len(quick & want) >= 0.9 * len(want)
    assert nearest(df.limit(0), 10, 0.5, dims=DIMS).count() == 0
