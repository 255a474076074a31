"""Linear models over folds from one pass of second moments.

A Gram is the matrix of sums of products of (1, x, y) per fold. Tasks add up their rows with numpy and send one matrix
per fold and task; Spark adds these. Fits for any penalty, any feature subset and any left-out fold come from the same
Gram: only matrices whose side is the number of features reach the driver. Rows with a null or non-finite feature or
target are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _matrix(b: pa.RecordBatch, start: int) -> np.ndarray:
    return np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(start, b.num_columns)])


def moments(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: str | None = None, weight: str | None = None) -> DataFrame:
    """Rows (fold, gram): the flattened matrix of sums of w * z * z', z = (1, features, targets), per fold. Tasks send one
    matrix for each fold; these are added in two steps, so no task adds up more than a share of them."""
    columns = [*features, *targets]
    side = len(columns) + 1

    def packed(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())], ["fold", "gram"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in rows:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode()
            w = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            z = np.column_stack([np.ones(b.num_rows), _matrix(b, 2)])
            # incomplete rows go here: a filter over many columns makes the optimiser infer constraints without end
            ok = np.isfinite(z).all(axis=1) & np.isfinite(w)
            number = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)[ok]
            names = [*code.dictionary.to_pylist(), None]  # the last one is number -1
            order = np.argsort(number, kind="stable")
            number, z, w = number[order], z[ok][order], w[ok][order]
            begin = np.flatnonzero(np.diff(number, prepend=-2))
            for lo, hi in zip(begin, np.append(begin, len(number))[1:], strict=True):
                name, part = names[number[lo]], (z[lo:hi] * w[lo:hi, None]).T @ z[lo:hi]
                sums[name] = sums[name] + part if name in sums else part
        yield packed(sums)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in rows:
            for name, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(blob, "<f8")
                sums[name] = sums[name] + part if name in sums else part
        yield packed(sums)

    rows = df.select((F.col(fold).cast("string") if fold else F.lit("all")).alias("fold"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *[F.col(c).cast("double").alias(c) for c in columns])
    parts = rows.mapInArrow(run, "fold string, gram binary")
    return parts.repartition(max(1, int(rows.rdd.getNumPartitions() ** 0.5))).mapInArrow(add, "fold string, gram binary").where(F.length("gram") == 8 * side * side)


@dataclass
class Grams:
    """Grams by fold on the driver; side: 1 + features + targets."""

    features: list[str]
    targets: list[str]
    by_fold: dict[str, np.ndarray]

    @property
    def total(self) -> np.ndarray:
        return sum(self.by_fold.values())

    def without(self, fold: str) -> np.ndarray:
        return self.total - self.by_fold[fold]

    def subset(self, features: Sequence[str]) -> Grams:
        """The Grams of some features, without another pass."""
        at = [0, *[1 + self.features.index(f) for f in features], *range(1 + len(self.features), 1 + len(self.features) + len(self.targets))]
        return Grams(list(features), self.targets, {k: g[np.ix_(at, at)] for k, g in self.by_fold.items()})


def grams(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: str | None = None, weight: str | None = None, most: int = 1 << 26) -> Grams:
    side = 1 + len(features) + len(targets)
    out: dict[str, np.ndarray] = {}
    # a matrix for each fold is held here; group_fits() solves for any number of groups inside the tasks
    for r in moments(df, features, targets, fold, weight).toLocalIterator():
        out[r.fold] = out.get(r.fold, 0.0) + np.frombuffer(r.gram, "<f8")
        if len(out) * side * side > most:
            raise ValueError(f"the folds' Grams have more than {most} numbers; solve per group with group_fits()")
    return Grams(list(features), list(targets), {k: v.reshape(side, side) for k, v in sorted(out.items(), key=lambda kv: str(kv[0]))})


@dataclass
class Fit:
    """A linear model on original features: prediction = intercept + coefficients * x; mean: of the training features."""

    features: list[str]
    intercept: float
    coefficients: np.ndarray
    mean: np.ndarray

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.coefficients.tolist(), strict=True):
            out = out + F.lit(b) * F.col(c)
        return out

    def contributions(self) -> list[Column]:
        """coefficient * (x - mean) of each feature; with base() they add up to the prediction."""
        return [F.lit(float(b)) * (F.col(c) - F.lit(float(m))) for c, b, m in zip(self.features, self.coefficients, self.mean, strict=True)]

    def base(self) -> float:
        return float(self.intercept + self.coefficients @ self.mean)


def solve(gram: np.ndarray, features: Sequence[str], target: int, alpha: float, scale: np.ndarray | None = None, pca: tuple[int, int] | None = None) -> Fit:
    """Ridge on standardised features (population deviation). target: number of the target. pca: (block size, k): the
    first `block size` features are replaced by their k principal components before the ridge."""
    p = len(features)
    n, mean = gram[0, 0], gram[0, 1 : p + 1] / gram[0, 0]
    cov = gram[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean)
    y = gram[0, 1 + p + target] / n
    xy = gram[1 : p + 1, 1 + p + target] - n * mean * y
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0)) if scale is None else scale
    inv = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
    cov, xy = cov * np.outer(inv, inv), xy * inv
    basis = np.eye(p)
    if pca:
        size, k = pca
        _, vectors = np.linalg.eigh(cov[:size, :size])
        basis = np.zeros((p, k + p - size))
        basis[:size, :k] = vectors[:, ::-1][:, :k]
        basis[size:, k:] = np.eye(p - size)
    z = basis.T @ cov @ basis
    beta = basis @ np.linalg.solve(z + alpha * np.eye(len(z)), basis.T @ xy) * inv
    return Fit(list(features), float(y - beta @ mean), beta, mean)


def component_shares(gram: np.ndarray, k: int) -> np.ndarray:
    """Shares of variance of the first k principal components of the standardised features."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    inv = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
    values = np.linalg.eigvalsh(cov * np.outer(inv, inv))[::-1]
    return values[:k] / values.sum()


def fold_r2(g: Grams, target: int, alpha: float) -> float:
    """R2 of left-out-fold predictions, from the Grams alone: a fold's squared errors are a quadratic form of its Gram."""
    p, total, left = len(g.features), g.total, 0.0
    sd = np.sqrt(np.maximum(np.diag(total)[1 : p + 1] / total[0, 0] - (total[0, 1 : p + 1] / total[0, 0]) ** 2, 0))
    at = [*range(p + 1), p + 1 + target]
    for f, own in g.by_fold.items():
        fit = solve(g.without(f), g.features, target, alpha, sd)
        w = np.concatenate([[fit.intercept], fit.coefficients, [-1.0]])
        left += float(w @ own[np.ix_(at, at)] @ w)
    y = total[0, p + 1 + target] / total[0, 0]
    return 1 - left / float(total[p + 1 + target, p + 1 + target] - total[0, 0] * y * y)


def press(df: DataFrame, g: Grams, target: int, alphas: Sequence[float]) -> dict[float, float]:
    """Mean squared leave-one-row-out error of the ridge for each penalty, in one scan: e / (1 - leverage) per row."""
    p = len(g.features)
    total = g.total
    n, mean = total[0, 0], total[0, 1 : p + 1] / total[0, 0]
    cov = total[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    inv = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
    z = cov * np.outer(inv, inv)
    inverses = [np.linalg.inv(z + a * np.eye(p)) for a in alphas]
    fits = [solve(total, g.features, target, a) for a in alphas]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(alphas))
        for b in rows:
            if b.num_rows:
                x, y = _matrix(b, 1), b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                ok = np.isfinite(x).all(axis=1) & np.isfinite(y)
                x, y = x[ok], y[ok]
                s = (x - mean) * inv
                for i, (q, f) in enumerate(zip(inverses, fits, strict=True)):
                    h = 1 / n + np.einsum("ij,jk,ik->i", s, q, s)
                    sums[i] += (((y - f.intercept - x @ f.coefficients) / (1 - h)) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(alphas)), pa.int32()), pa.array(sums)], ["i", "s"])

    columns = [g.targets[target], *g.features]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found = rows.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return {alphas[r.i]: r.s / n for r in found}


def out_of_fold(df: DataFrame, g: Grams, fold: str, target: int, alpha: float, out: str = "oof", pca: tuple[int, int] | None = None, rescale: bool = False) -> DataFrame:
    """Predictions of each row by the model of all other folds: one projection, coefficients looked up by fold.
    Scales come from all rows, unless `rescale`."""
    p, total = len(g.features), g.total
    sd = np.sqrt(np.maximum(np.diag(total)[1 : p + 1] / total[0, 0] - (total[0, 1 : p + 1] / total[0, 0]) ** 2, 0))
    fits = {f: {out: solve(g.without(f), g.features, target, alpha, None if rescale else sd, pca)} for f in g.by_fold}
    return by_fold(df, fold, fits)


def metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, r2, r2_unbiased (mean error taken off), r2_affine (squared correlation), mae, rmse."""
    e, n = F.col(actual) - F.col(predicted), F.count("*")
    spread = F.nullif(F.var_pop(actual), F.lit(0.0))
    return df.groupBy(*keys).agg(n.alias("n"), (1 - F.try_divide(F.avg(e * e), spread)).alias("r2"), (1 - F.try_divide(F.var_pop(e), spread)).alias("r2_unbiased"), (F.corr(actual, predicted) ** 2).alias("r2_affine"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def nonnegative(gram: np.ndarray, xy: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares on a small Gram by coordinate descent."""
    w = np.zeros(len(xy))
    for _ in range(rounds):
        before = w.copy()
        for i in range(len(w)):
            if gram[i, i] > 0:
                w[i] = max(0.0, w[i] + (xy[i] - gram[i] @ w) / gram[i, i])
        if np.abs(w - before).max() < 1e-12:
            break
    return w


def evidence(gram: np.ndarray, p: int, rounds: int = 300, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Bayesian linear model whose two precisions maximise the evidence, from a Gram of (1, p features, target): coefficients,
    covariance of the coefficients, means of the features, mean of the target, variance of the noise. Each round costs one
    pass over the eigenvalues of the centred Gram."""
    n, mean, y = gram[0, 0], gram[0, 1 : p + 1] / gram[0, 0], gram[0, p + 1] / gram[0, 0]
    values, vectors = np.linalg.eigh(gram[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean))
    values = np.maximum(values, 0)
    v = vectors.T @ (gram[1 : p + 1, p + 1] - n * mean * y)
    yy = gram[p + 1, p + 1] - n * y * y
    noise, weight, w = n / max(yy, 1e-12), 1.0, np.zeros(p)
    for _ in range(rounds):
        before, w = w, v * noise / (noise * values + weight)
        used = float((noise * values / (noise * values + weight)).sum())
        left = max(float(yy - 2 * w @ v + (values * w) @ w), 1e-12)
        weight, noise = used / max(float(w @ w), 1e-12), max(n - used, 1e-12) / left
        if np.abs(w - before).sum() < tol:
            break
    return vectors @ w, (vectors / (noise * values + weight)) @ vectors.T, mean, float(y), 1 / noise


def kernel_features(df: DataFrame, names: Sequence[str], points: np.ndarray, gamma: float, keep: Sequence[str]) -> DataFrame:
    """Columns `keep`, and k0.. for landmark rows `points`: exp(-gamma * squared distance) times the inverse root of the landmarks'
    own kernel. Rows with a null or non-finite feature are left out."""

    def pair(a: np.ndarray, some: int = 256) -> np.ndarray:
        out = np.empty((len(a), len(points)))
        for i in range(0, len(a), some):  # some rows at a time, as their differences to all landmarks are held
            out[i : i + some] = np.exp(-gamma * ((a[i : i + some, None, :] - points[None]) ** 2).sum(2))
        return out

    u, size, vt = np.linalg.svd(pair(points))
    root = (u / np.sqrt(np.maximum(size, 1e-12))) @ vt

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            x = _matrix(b, len(keep))
            ok = np.isfinite(x).all(axis=1)
            if ok.any():
                k = pair(x[ok]) @ root.T
                kept = [b.column(i).filter(pa.array(ok)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(k[:, i]) for i in range(k.shape[1])]], [*keep, *[f"k{i}" for i in range(k.shape[1])]])

    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in names])
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"k{i} double" for i in range(len(points))]))


def evidence_out_of_fold(df: DataFrame, g: Grams, fold: str, keep: Sequence[str], out: str, deviation: str) -> DataFrame:
    """Columns `keep`, and the left-out-fold prediction and its predictive deviation by `evidence`. A matrix per fold goes to the tasks."""
    fits = {f: evidence(g.without(f), len(g.features)) for f in g.by_fold}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if b.num_rows:
                folds, x = np.array(b.column(0).to_pylist(), object), _matrix(b, 1 + len(keep))
                value, sd = np.full(len(x), np.nan), np.full(len(x), np.nan)
                for f in set(folds):
                    if f in fits:
                        w, cov, mean, y, noise = fits[f]
                        at = folds == f
                        z = x[at] - mean
                        value[at], sd[at] = y + z @ w, np.sqrt(noise + np.einsum("ij,jk,ik->i", z, cov, z))
                yield pa.RecordBatch.from_arrays([*[b.column(1 + i) for i in range(len(keep))], pa.array(value), pa.array(sd)], [*keep, out, deviation])

    rows = df.select(F.col(fold).cast("string").alias("_fold"), *keep, *g.features)
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{out} double, {deviation} double"]))


def gram_entries(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """keys, place, v: the Gram of (1, features, target) of each group of rows, an entry a row, so that Spark can add Grams
    over keys. Null keys are left out."""
    schema, names = dict(df.dtypes), list(keys)
    rows = df.dropna(subset=names).withColumn("_fold", F.to_json(F.struct(*names)))
    parts = moments(rows, features, [target], "_fold", weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [np.frombuffer(x, "<f8") for x in b.column(1).to_pylist()]
            fold = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(fold)), pa.array(place.astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *grams]))], ["fold", "place", "v"])

    entries = parts.mapInArrow(run, "fold string, place int, v double").groupBy("fold", "place").agg(F.sum("v").alias("v"))
    back = F.from_json("fold", ", ".join(f"`{k}` {schema[k]}" for k in names))
    return entries.select(back.alias("_k"), "place", "v").select(*[F.col("_k")[k].alias(k) for k in names], "place", "v")


def earlier_entries(entries: DataFrame, event: str) -> DataFrame:
    """Entries summed over all earlier events, for every event but the first: a window holds a row for each event."""
    w = Window.partitionBy("place").orderBy(event).rowsBetween(Window.unboundedPreceding, -1)
    whole = entries.groupBy(event, "place").agg(F.sum("v").alias("v"))
    return whole.select(event, "place", F.sum("v").over(w).alias("v")).where("v is not null")


def group_fits(entries: DataFrame, features: Sequence[str], keys: Sequence[str], alpha: float) -> DataFrame:
    """keys, n (weight), intercept, coefficients: a ridge on the features as they are for each group of entries, solved in the
    tasks. A matrix of a side for each feature is all that comes together."""
    names, types, p = list(keys), dict(entries.dtypes), len(features)
    wide = entries.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("_gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [np.array(g).reshape(p + 2, p + 2) for g in b.column(len(names)).to_pylist()]
            fits = [solve(g, features, 0, alpha, np.ones(p)) for g in grams]
            numbers = [pa.array([g[0, 0] for g in grams], pa.float64()), pa.array([f.intercept for f in fits], pa.float64()), pa.array([f.coefficients.tolist() for f in fits], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *numbers], [*names, "n", "intercept", "coefficients"])

    return wide.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in names], "n double, intercept double, coefficients array<double>"]))


def projected(features: Sequence[str], intercept: str = "intercept", coefficients: str = "coefficients") -> Column:
    """The prediction of a row that has a fit beside it."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    return F.aggregate(F.zip_with(x, coefficients, lambda a, b: a * b), F.col(intercept), lambda s, v: s + v)


def elastic_path(cov: np.ndarray, xy: np.ndarray, ratios: np.ndarray, penalties: np.ndarray, rounds: int = 1000, tol: float = 1e-9) -> np.ndarray:
    """Elastic nets from a covariance: coefficients by (penalty, ratio, feature), minimising half the mean squared error plus
    penalty * (ratio * |b| + (1 - ratio) / 2 * b * b), by coordinate descent with soft thresholds. penalties: (steps, ratios),
    from the largest down, as each step starts from the one before. All ratios descend together."""
    b, out = np.zeros((len(ratios), len(xy))), []
    for step in penalties:
        cut, shrink = step * ratios, step * (1 - ratios)
        for _ in range(rounds):
            before = b.copy()
            for j in range(len(xy)):
                if cov[j, j] > 1e-12:
                    pull = xy[j] - b @ cov[j] + cov[j, j] * b[:, j]
                    b[:, j] = np.sign(pull) * np.maximum(np.abs(pull) - cut, 0) / (cov[j, j] + shrink)
            if np.abs(b - before).max() < tol:
                break
        out.append(b.copy())
    return np.array(out)


def _centred(gram: np.ndarray, p: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Covariance, covariance with the target, means, mean of the target."""
    n, mean, y = gram[0, 0], gram[0, 1 : p + 1] / gram[0, 0], gram[0, 1 + p + target] / gram[0, 0]
    return gram[1 : p + 1, 1 : p + 1] / n - np.outer(mean, mean), gram[1 : p + 1, 1 + p + target] / n - mean * y, mean, float(y)


def elastic_net_cv(g: Grams, target: int, ratios: Sequence[float], steps: int = 50, depth: float = 1e-3) -> dict[str, tuple[Fit, float, float]]:
    """For each fold an elastic net of the other folds, with its penalty and ratio: the pair with the least mean error over the
    other folds, each left out in turn. Features are scaled by their deviation over the training folds. Everything comes from the
    folds' Grams: a whole path of penalties costs no pass over the rows."""
    p, share, out = len(g.features), np.array(ratios, float), {}
    at = [*range(p + 1), p + 1 + target]
    for f in g.by_fold:
        train = g.without(f)
        cov, xy, mean, y = _centred(train, p, target)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        inv = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
        top = np.abs(xy * inv).max(initial=1e-12) / share
        penalties = np.geomspace(1, depth, steps)[:, None] * top
        errors = np.zeros(penalties.shape)
        inner = [k for k in g.by_fold if k != f]
        for k in inner:
            c, v, m, ym = _centred(train - g.by_fold[k], p, target)
            b = elastic_path(c * np.outer(inv, inv), v * inv, share, penalties) * inv
            own = g.by_fold[k][np.ix_(at, at)]
            w = np.concatenate([(ym - b @ m)[..., None], b, -np.ones((*b.shape[:2], 1))], axis=2)
            errors += np.einsum("sri,ij,srj->sr", w, own, w) / own[0, 0]
        s, r = np.unravel_index(int(np.argmin(errors)), errors.shape) if inner else (0, 0)
        beta = elastic_path(cov * np.outer(inv, inv), xy * inv, share[[r]], penalties[: s + 1, [r]])[-1, 0] * inv
        out[f] = Fit(g.features, float(y - beta @ mean), beta, mean), float(penalties[s, r]), float(share[r])
    return out


def by_fold(df: DataFrame, fold: str, fits: dict[str, dict[str, Fit]], most: int = 10_000) -> DataFrame:
    """Predictions by the models of each row's fold, a column for each name. fits: fold to name to model. Models for more than
    `most` folds aren't sent to all tasks."""
    names = list(next(iter(fits.values()))) if fits else []
    rows = [(f, *[[m[k].intercept, *m[k].coefficients.tolist()] for k in names]) for f, m in fits.items()]
    table = df.sparkSession.createDataFrame(rows, ", ".join(["_fold string", *[f"_m{i} array<double>" for i in range(len(names))]]))
    joined = df.join(F.broadcast(table) if len(rows) <= most else table, df[fold].cast("string") == F.col("_fold"))
    features = fits[next(iter(fits))][names[0]].features
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    dot = lambda m: F.aggregate(F.zip_with(x, m, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.withColumns({k: dot(f"_m{i}") for i, k in enumerate(names)}).drop("_fold", *[f"_m{i}" for i in range(len(names))])


def nested_blends(g: Grams, parts: dict[str, Sequence[str]], target: int, alpha: float, metas: Sequence[float]) -> dict[str, dict[str, Fit]]:
    """For each fold, models of the other folds: those of the parts, and their blends: mean, nonnegative weights, and a ridge whose
    penalty has the least error with each of the other folds left out. The blends' weights come from predictions that each of the
    other folds got from models without it and without the fold that is scored. All from Grams: a part's predictions are linear in
    the features, so their Gram over a fold's rows is a product of small matrices."""
    p, m, at = len(g.features), len(parts), {n: i for i, n in enumerate(g.features)}

    def maps(gram: np.ndarray) -> np.ndarray:
        """(1, x, y) to (1, predictions, y)."""
        b = np.zeros((p + 2, m + 2))
        b[0, 0] = b[p + 1, m + 1] = 1
        for k, some in enumerate(parts.values()):
            i = [1 + at[c] for c in some]
            fit = solve(gram[np.ix_([0, *i, p + 1], [0, *i, p + 1])], some, 0, alpha)
            b[0, k + 1], b[i, k + 1] = fit.intercept, fit.coefficients
        return b

    keep = [*range(p + 1), p + 1 + target]
    grams = {f: x[np.ix_(keep, keep)] for f, x in g.by_fold.items()}
    total, out = sum(grams.values()), {}
    for f, own in grams.items():
        train = total - own
        seen = {}
        for k, other in grams.items():
            if k != f and (train - other)[0, 0] > 0:
                b = maps(train - other)
                seen[k] = b.T @ other @ b
        meta = sum(seen.values())
        cov, xy, mean, y = _centred(meta, m, 0)

        def error(a: float, seen=seen, meta=meta) -> float:
            left = 0.0
            for other in seen.values():
                fit = solve(meta - other, list(parts), 0, a, np.ones(m))
                w = np.concatenate([[fit.intercept], fit.coefficients, [-1.0]])
                left += float(w @ other @ w)
            return left

        best = min(metas, key=lambda a: (error(a), a)) if len(seen) > 1 else metas[0]
        weights = {k: np.eye(m)[i] for i, k in enumerate(parts)} | {"mean": np.full(m, 1 / m), "nonnegative": nonnegative(cov, xy), "ridge": solve(meta, list(parts), 0, best, np.ones(m)).coefficients}
        b = maps(train)
        out[f] = {}
        for name, w in weights.items():
            shift = float(y - w @ mean) if name in ("nonnegative", "ridge") else 0.0
            out[f][name] = Fit(g.features, shift + float(b[0, 1 : m + 1] @ w), b[1 : p + 1, 1 : m + 1] @ w, train[0, 1 : p + 1] / train[0, 0])
    return out
