"""Low-rank covariances against numpy, and functions of lists of names."""

import numpy as np
import pytest

from tidepanel.operators import datasets, prepare, risk


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=(60, 6))
    x -= x.mean(0)
    rows = [(f"i{j}", t, float(x[t, j])) for t in range(60) for j in range(6)]
    return x, spark.createDataFrame(rows, "instrument string, datetime int, x double")


def as_matrix(df):
    out = np.zeros((6, 6))
    for r in df.collect():
        out[int(r["inst_i"][1]), int(r["inst_j"][1])] = r["cov"]
    return out


def test_structured_covariance_equals_numpy(returns):
    x, df = returns
    _, _, v = np.linalg.svd(x, full_matrices=False)
    f = v[:2].T
    want = f @ np.cov((x @ f).T) @ f.T + np.diag((x - x @ f @ f.T).var(0))
    assert as_matrix(risk.structured_covariance(df, 2)) == pytest.approx(want)


@pytest.mark.parametrize("kind", ["soft", "hard", "scad"])
def test_thresholded_covariance_equals_numpy(returns, kind):
    x, df = returns
    n, p = x.shape
    _, _, v = np.linalg.svd(x, full_matrices=False)
    f = v[:2].T
    u = x - x @ f @ f.T
    cov = u.T @ u / n
    s = np.sqrt(np.diag(cov))
    r, at = cov / np.outer(s, s), 0.5 * (1 / np.sqrt(p) + np.sqrt(np.log(p) / n))
    soft = np.sign(r) * np.maximum(np.abs(r) - at, 0)
    cut = {"soft": soft, "hard": r * (np.abs(r) > at), "scad": np.where(np.abs(r) < 2 * at, soft, np.where(np.abs(r) < 3.7 * at, (2.7 * r - 3.7 * np.sign(r) * at) / 1.7, r))}[kind]
    np.fill_diagonal(cut, 1)
    want = (x @ f @ f.T).T @ (x @ f @ f.T) / n + cut * np.outer(s, s)
    assert as_matrix(risk.structured_covariance(df, 2, 0.5, kind)) == pytest.approx(want)


def test_names(spark):
    assert datasets.nearest_frequency(["1min", "30min", "day"], "60min") == "30min"
    with pytest.raises(ValueError):
        datasets.nearest_frequency(["day"], "1min")
    assert "volume" in prepare.absent_columns(spark.createDataFrame([], "instrument string, close double"))


@pytest.mark.parametrize(("kind", "alpha"), [("ols", 0.0), ("ridge", 3.0), ("lasso", 0.05)])
@pytest.mark.parametrize("intercept", [False, True])
def test_linear_fits_have_least_loss(spark, kind, alpha, intercept):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) + 2
    y = x @ [1.0, -0.5, 0.02] + 4 * intercept + 0.1 * rng.normal(size=80)
    w = rng.random(80) + 0.5
    rows = [("a", t, *map(float, x[t]), float(y[t]), float(w[t])) for t in range(80)]
    schema = "instrument string, datetime int, a double, b double, c double, y double, w double"
    df = spark.createDataFrame([*rows, ("a", 90, None, 1.0, 1.0, 5.0, 1.0), ("a", 91, 1.0, 1.0, 1.0, None, 1.0)], schema)
    got = risk.linear_score(df.where("datetime < 40 OR datetime > 80"), df, ["a", "b", "c"], "y", kind, alpha, intercept, "w", df.where("datetime >= 40 AND datetime <= 80"))
    score = {r["datetime"]: r["score"] for r in got.collect()}
    assert score[90] is None and score[91] is not None
    fitted = np.array([score[t] for t in range(80)])
    design = np.column_stack([x, np.ones(80)]) if intercept else x
    beta = np.linalg.lstsq(design, fitted, rcond=None)[0]

    def loss(b):
        r, c = y - design @ b, b[:3]
        squares = (w * r * r).sum()
        return squares + alpha * c @ c if kind == "ridge" else squares / (2 * w.sum()) + alpha * np.abs(c).sum()

    for step in rng.normal(size=(200, len(beta))) * 1e-3:
        assert loss(beta) <= loss(beta + step) + 1e-12
    with pytest.raises(ValueError):
        risk.linear_score(df.limit(0), df, ["a"], "y")
