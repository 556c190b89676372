import numpy as np
import pytest

from spanlight.llm import eigen, whitening as W


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0], [9, 4, 1], [3], [2, 2], list(range(40, 0, -1)), [1e9, 1e9 - 1, 1, 1e-3, 1e-3]])
def test_leading_pairs(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, vectors = eigen.leading(a, min(d, 16))
    want = np.linalg.eigvalsh(a)[::-1][: len(got)]
    norm = max(map(abs, values))
    assert np.abs(got - want).max() < 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * norm


def test_sturm_counts_and_diagonal_matrices():
    assert eigen.sturm_counts(np.array([1.0, 2, 3]), np.zeros(2), np.array([0.5, 1.5, 2.5, 9])).tolist() == [0, 1, 2, 3]
    assert np.allclose(eigen.leading(np.diag([1.0, 7, 3]), 3)[0], [7, 3, 1])
    assert eigen.leading(np.zeros((2, 2)), 2)[0].tolist() == [0, 0]


def plain(rows, k=16):
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = [tuple(int(np.floor(64.0 * c)) + 1000000 for c in v) for _, v in good]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(a * n - s) / n for a, s in zip(r, sums)] for r in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = [j for j in np.argsort(-values)[:k] if values[j] > 1e-12 * values.sum()]
    out = {}
    for (i, _), r in zip(good, x):
        centre = np.array([float(a * n - s) / n for a, s in zip(r, sums)])
        out.setdefault(i, []).append((n, sum((a * n - s) ** 2 for a, s in zip(r, sums)), centre @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()))
    return out


def test_against_a_plain_version(spark):
    r = np.random.default_rng(1)
    mix = r.standard_normal((20, 20)) * np.arange(1, 21)
    rows = [(i, [float(c) for c in r.standard_normal(20) @ mix / 10]) for i in range(300)]
    rows += [(900, rows[0][1])] * 120 + [(901, None), (902, [1.0] * 19 + [None]), (903, [float("nan")] * 20), (904, [float("inf")] * 20), (905, []), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, whitened string, label int").repartition(5)
    out, model = W.whiten(df)
    want = plain(rows)
    got = {}
    for row in out.collect():
        got.setdefault(row["vec_id"], []).append(row)
    assert got.keys() == want.keys() and len(got[900]) == 120
    signs = np.sign(np.array(got[5][0]["whitened"]) * want[5][0][2])
    for key, found in got.items():
        for a, b in zip(found, want[key]):
            assert a["deviation"] == b[1] and model.n == b[0]
            assert np.abs(np.array(a["whitened"]) * signs - b[2]).max() < 1e-8
    assert np.allclose(model.values / model.trace, want[5][0][3], rtol=1e-9) and model.identity_error < 1e-9
    assert out.columns == ["vec_id", "embedding", "label", "deviation", "whitened"]


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        out, model = W.whiten(frame(rows))
        assert out.count() == 0 and model is None
    out, model = W.whiten(frame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0])]))  # one dimension varies, one row is of another length
    assert model.values.shape == (1,) and sorted(abs(r["whitened"][0]) for r in out.collect()) == [1.0, 1.0]
    out, model = W.whiten(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]))
    assert sorted(r["deviation"] is None for r in out.collect()) == [False, True, True]


def test_whole_table(spark):
    out = W.op11_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert set(out["component"]) == set(range(1, 17)) and out["identity_error"].max() < 1e-4
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want = plain(rows)
    assert len(out) == 16 * len(rows)
    for key in list(want)[:20]:
        mine = out[out["vec_id"] == key].sort_values("component")
        assert np.allclose(np.abs(mine["whitened"]), np.abs(want[key][0][2]), atol=1e-8) and set(mine["deviation"]) == {want[key][0][1]}
