"""Model queries that SQL can't state, against numpy over all rows of the smallest tables."""

import numpy as np
import pytest

from arealis.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def data(spark, small):
    rows = sorted(spark.read.parquet(f"{small}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), np.array([str(r.label) for r in rows])


def target(ids, x):
    weights = np.array([(i * 7) % 11 - 5 for i in range(x.shape[1])]) / 5
    return x @ weights + 2 + (ids * 7919 % 1000 / 1000 - 0.5) * 0.1


def ridge(x, y, alpha, sd=None, block=0, k=0):
    """Coefficients and intercept; the first `block` features as their k principal components."""
    mean = x.mean(0)
    sd = x.std(0) if sd is None else sd
    z = (x - mean) / sd
    basis = np.eye(x.shape[1])
    if block:
        top = np.linalg.svd(z[:, :block], full_matrices=False)[2][:k].T
        basis = np.block([[top, np.zeros((block, x.shape[1] - block))], [np.zeros((x.shape[1] - block, k)), np.eye(x.shape[1] - block)]])
    s = z @ basis
    beta = basis @ np.linalg.solve(s.T @ s + alpha * np.eye(s.shape[1]), s.T @ (y - y.mean())) / sd
    return beta, y.mean() - beta @ mean


def left_out(x, y, fold, alpha, **more):
    out = np.zeros(len(y))
    for f in set(fold):
        beta, base = ridge(x[fold != f], y[fold != f], alpha, sd=x.std(0), **more)
        out[fold == f] = x[fold == f] @ beta + base
    return out


def test_pca_block(spark, small, data):
    ids, x, fold = data
    y = target(ids, x)
    oof = left_out(x, y, fold, 0.1, block=48, k=10)
    got = {r.fold: r for r in QUERIES["ml_pca_block"](spark, small).collect()}
    assert set(got) == set(fold)
    for f, r in got.items():
        e = (y - oof)[fold == f]
        assert r.n == len(e) and r.mae == pytest.approx(np.abs(e).mean()) and r.r2 == pytest.approx(1 - (e**2).mean() / y[fold == f].var())


def best_nonnegative(x, y):
    """Least squares without negative weights: the best over all supports."""
    c, best = x - x.mean(0), (np.inf, None)
    for some in range(1, 1 << x.shape[1]):
        at = [i for i in range(x.shape[1]) if some >> i & 1]
        w = np.zeros(x.shape[1])
        w[at] = np.linalg.lstsq(c[:, at], y - y.mean(), rcond=None)[0]
        e = ((y - y.mean() - c @ w) ** 2).sum()
        if (w >= 0).all() and e < best[0]:
            best = e, w
    return best[1]


def test_stack_blend(spark, small, data):
    """Nested: weights for a fold come from rows of other folds, whose predictions come from models without their fold and without it."""
    ids, x, fold = data
    y = target(ids, x)
    parts, folds = ((0, 24), (24, 48), (48, 64)), sorted(set(fold))

    def predict(train, at):
        return np.column_stack([(lambda m: x[at, a:b] @ m[0] + m[1])(ridge(x[train, a:b], y[train], 0.1)) for a, b in parts])

    out = {k: np.zeros(len(y)) for k in ("m0", "m1", "m2", "mean", "nonnegative", "ridge")}
    for f in folds:
        base = np.zeros((len(y), 3))
        for k in folds:
            if k != f:
                base[fold == k] = predict((fold != f) & (fold != k), fold == k)
        rest, own = fold != f, predict(fold != f, fold == f)
        m, t = base[rest], y[rest]
        line = lambda a, x, y: (lambda c: np.linalg.solve(c.T @ c + a * np.eye(3), c.T @ (y - y.mean())))(x - x.mean(0))
        errors = {}
        for a in np.logspace(-4, 4, 20):
            errors[a] = 0
            for k in folds:
                if k != f:
                    mine, others = fold[rest] == k, fold[rest] != k
                    w = line(a, m[others], t[others])
                    errors[a] += ((t[mine] - t[others].mean() - (m[mine] - m[others].mean(0)) @ w) ** 2).sum()
        weights = {"nonnegative": best_nonnegative(m, t), "ridge": line(min(errors, key=errors.get), m, t)}
        for i in range(3):
            out[f"m{i}"][fold == f] = own[:, i]
        out["mean"][fold == f] = own.mean(1)
        for k, w in weights.items():
            out[k][fold == f] = t.mean() + (own - m.mean(0)) @ w
    got = {r.method: r for r in QUERIES["ml_stack_blend"](spark, small).collect()}
    assert set(got) == set(out)
    for k, p in out.items():
        assert got[k].rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()), rel=1e-5), k
    assert got["nonnegative"].rmse < got["mean"].rmse


def test_elastic_net_cv(spark, small, data):
    """Penalty and ratio by inner folds, against proximal gradient steps over all rows."""
    ids, x, _ = data
    x, fold = x[:, :16], ids % 5
    y = target(ids, x)
    ratios = np.array([0.1, 0.5, 0.7, 0.9, 0.95, 0.99])

    def nets(x, y, sd, penalties, shares):
        c, t = (x - x.mean(0)) / sd, y - y.mean()
        cov, xy = c.T @ c / len(y), c.T @ t / len(y)
        b, step = np.zeros((len(penalties), x.shape[1])), 1 / (np.linalg.eigvalsh(cov)[-1] + penalties * (1 - shares))[:, None]
        z, pace = b, 1.0
        for _ in range(4000):
            g = z @ cov - xy + (penalties * (1 - shares))[:, None] * z
            u = z - step * g
            new = np.sign(u) * np.maximum(np.abs(u) - step * (penalties * shares)[:, None], 0)
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            z, b, pace = new + (pace - 1) / faster * (new - b), new, faster
        return b / sd, y.mean() - (b / sd) @ x.mean(0)

    want = np.zeros(len(y))
    for f in range(5):
        train = fold != f
        sd = x[train].std(0)
        top = np.abs(((x[train] - x[train].mean(0)) / sd).T @ (y[train] - y[train].mean())).max() / train.sum()
        penalties = (np.geomspace(1, 1e-3, 50)[:, None] * (top / ratios)).ravel()
        shares, errors = np.tile(ratios, 50), np.zeros(300)
        for k in range(5):
            if k != f:
                some, mine = train & (fold != k), fold == k
                b, c = nets(x[some], y[some], sd, penalties, shares)
                errors += ((y[mine][None] - b @ x[mine].T - c[:, None]) ** 2).mean(1)
        best = int(np.argmin(errors))
        b, c = nets(x[train], y[train], sd, penalties[[best]], shares[[best]])
        want[fold == f] = x[fold == f] @ b[0] + c[0]
    got = {r.vec_id: r.prediction for r in QUERIES["ml_elastic_net_cv"](spark, small).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=2e-4)


def bayes(x, y, rounds=300):
    """The evidence loop by whole matrices: coefficients, their covariance, the variance of the noise."""
    c, t, noise, weight, w = x - x.mean(0), y - y.mean(), 1 / y.var(), 1.0, np.zeros(x.shape[1])
    for _ in range(rounds):
        cov = np.linalg.inv(noise * c.T @ c + weight * np.eye(x.shape[1]))
        before, w = w, noise * cov @ c.T @ t
        used = x.shape[1] - weight * np.trace(cov)
        weight, noise = used / (w @ w), (len(y) - used) / ((t - c @ w) ** 2).sum()
        if np.abs(w - before).sum() < 1e-5:
            break
    return w, np.linalg.inv(noise * c.T @ c + weight * np.eye(x.shape[1])), 1 / noise


def test_kernel_residual(spark, small, data):
    from pyspark.sql import functions as F

    ids, x, fold = data
    x = x[:, :8]
    y = target(ids, x)
    oof = left_out(x, y, fold, 1.0)
    order = [r.vec_id for r in spark.read.parquet(f"{small}/embeddings.parquet").orderBy(F.xxhash64("vec_id"), "vec_id").limit(100).collect()]
    points = x[[int(np.flatnonzero(ids == i)[0]) for i in order]]
    near = lambda a: np.exp(-((a[:, None] - points[None]) ** 2).sum(2) / 8)
    values, vectors = np.linalg.eigh(near(points))
    z = near(x) @ (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
    want, sd = oof.copy(), np.zeros(len(y))
    for f in set(fold):
        at = fold == f
        w, cov, noise = bayes(z[~at], (y - oof)[~at])
        c = z[at] - z[~at].mean(0)
        want[at] += (y - oof)[~at].mean() + c @ w
        sd[at] = np.sqrt(noise + (c @ cov * c).sum(1))
    got = {r.vec_id: r for r in QUERIES["ml_kernel_residual"](spark, small).collect()}
    assert np.allclose([got[i].fitted for i in ids], want, atol=1e-4)
    assert np.allclose([got[i].deviation for i in ids], sd, rtol=1e-3)
    r = QUERIES["ml_kernel_calibration"](spark, small).first()
    assert r.n == len(ids) and r.factor == pytest.approx(np.quantile(np.abs((y - want) / sd), 0.9) / 1.645, rel=1e-2)


def test_kernel_features_hold_few_rows(spark):
    """A batch needs little more memory than its features, and gives the kernel of all landmarks."""
    import tracemalloc

    import pyarrow as pa

    from arealis.operators import linear as L

    class Rows:  # the function that tasks run, by itself
        dtypes = [("id", "bigint")]
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    rng = np.random.default_rng(3)
    x, points = rng.normal(size=(4000, 8)), rng.normal(size=(100, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), *[pa.array(c) for c in x.T]], ["id", *[f"x{i}" for i in range(8)]])
    run = L.kernel_features(Rows(), [f"x{i}" for i in range(8)], points, 1 / 8, ["id"])
    tracemalloc.start()
    found = next(run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = lambda a: np.exp(-((a[:, None] - points[None]) ** 2).sum(2) / 8)
    values, vectors = np.linalg.eigh(near(points))
    want = near(x) @ (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
    assert np.allclose(np.column_stack([found.column(1 + i).to_numpy() for i in range(100)]), want, atol=1e-8)
    assert most < 4 * want.nbytes


def test_bootstrap_band(spark, small):
    """The band holds each parent's own slope, or nearly, and every parent has one."""
    from pyspark.sql import functions as F

    from arealis.operators.panel import ratio
    from arealis.plans.catalog import Tables
    from arealis.plans.model_queries import moves

    m = moves(Tables(spark, small)).where("dx is not null")
    own = {r.parent: r.g for r in m.groupBy("parent").agg(ratio(F.sum(F.col("dx") * F.col("dy")), F.sum(F.col("dx") ** 2)).alias("g")).collect()}
    band = {r.parent: (r.low, r.high) for r in QUERIES["st_bootstrap_band"](spark, small).collect()}
    assert set(band) == set(own) and all(low <= own[p] <= high for p, (low, high) in band.items())
