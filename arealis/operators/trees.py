"""Boosted regression trees for many models at a time, by histograms.

Features are cut into equal-count bins once, and rows are stored as bytes with the models' current predictions. One pass
over the rows gives, for every model and every node of a level, the sums of weights and gradients by feature and bin; the
best splits of all models follow from these sums. So a round of depth 3 costs three passes for all folds and capacities
together, and what a pass sends is a histogram for each task, added in two steps. Predictions are written back every few
rounds, so that a pass evaluates few trees.

Leaves are weighted means of the gradient, shrunk by `l2`, times the step. Splits maximise the gain in squared gradient
sums; ties go to the first feature and the lowest cut. Null or non-finite features lie in a bin of their own, below all
others. Rows with a null target or weight teach nothing and are predicted all the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.operators.panel import quantiles
from arealis.sources.io import stored


@dataclass
class Model:
    """What one model learns from and how. trains: rows that teach; judges: rows on which rounds are judged, if `patience` rounds
    without progress end it; leaf: share of the teaching rows that a leaf has at least; offset: what is known of the target
    already, so that the model learns the rest."""

    name: str
    trains: Column
    judges: Column | None = None
    offset: Column | None = None
    depth: int = 3
    rounds: int = 100
    step: float = 0.05
    leaf: float = 0.0
    l2: float = 0.0
    patience: int = 10
    base: float = 0.0
    least: float = 0.0
    trees: list = field(default_factory=list)
    errors: list = field(default_factory=list)
    done: bool = False


def tree_values(trees: Sequence[dict], columns: np.ndarray) -> np.ndarray:
    """Sum of the trees' leaves; columns: the rows' bins, a row of the array for each feature. A tree: feature and cut of each inner
    node in heap order (feature -1: a leaf already), value of each node."""
    out = np.zeros(columns.shape[1])
    for i in range(0, len(trees), 8):  # some trees at a time, as their rows' places stay in the cache
        some = trees[i : i + 8]
        for ends, place in zip(_ends(some), places(some, columns), strict=True):
            out += ends.take(place)
    return out


def _stacked(trees: Sequence[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Features and cuts of the trees' inner nodes, all of the deepest one's number of levels."""
    inner = max(len(t["feature"]) for t in trees)
    padded = lambda key, fill: np.array([[*t[key], *[fill] * (inner - len(t[key]))] for t in trees], np.int64).reshape(len(trees), inner)
    return padded("feature", -1), padded("cut", 0)


def _ends(trees: Sequence[dict]) -> np.ndarray:
    """The values of the nodes in which the trees' rows end, by their places."""
    feature, _ = _stacked(trees)
    levels = int(np.log2(feature.shape[1] + 1))
    at, each = np.zeros((len(trees), 2**levels), np.int64), np.arange(len(trees))[:, None]
    for level in reversed(range(levels)):
        at = np.where(feature[each, at] >= 0, 2 * at + 1 + (np.arange(2**levels) >> level & 1), at)
    return np.array([np.asarray(t["value"])[a] for t, a in zip(trees, at, strict=True)])


def places(trees: Sequence[dict], columns: np.ndarray) -> np.ndarray:
    """For each tree, the rows' places among the nodes of the deepest tree's next level; below a leaf rows go left. A node costs a
    comparison of bytes, as all rows are compared by one feature and cut."""
    feature, cut = _stacked(trees)
    cut = np.where(feature >= 0, cut, 255).astype(np.uint8)  # no bin is above that
    levels = int(np.log2(feature.shape[1] + 1))
    place = np.zeros((len(trees), columns.shape[1]), np.uint8 if levels <= 8 else np.int64)
    for level in range(levels):
        right, first = np.zeros(place.shape, bool), 2**level - 1
        for node in range(first, 2 * first + 1):
            goes = columns[np.maximum(feature[:, node], 0)] > cut[:, node, None]
            right |= goes & (place == node - first) if level else goes
        place = place << 1 | right
    return place


def histogram(columns: np.ndarray, place: np.ndarray, teach: np.ndarray, gradient: np.ndarray, weight: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """(nodes, features, bins, 3): weighted gradients, weights and rows of the nodes of a level, of the rows that teach."""
    out = np.zeros((nodes, len(columns), size, 3))
    first, pull = np.where(teach, place.astype(np.int64), nodes) * size, gradient * weight  # rows that don't teach go to a node of their own
    plain = bool((weight == 1).all())
    for f, column in enumerate(columns):
        key = first + column
        for k, v in enumerate((pull, weight, None)):
            if k != 1 or not plain:
                out[:, f, :, k] = np.bincount(key, v, (nodes + 1) * size)[: nodes * size].reshape(nodes, size)
    if plain:
        out[..., 1] = out[..., 2]
    return out


def best_splits(h: np.ndarray, least: float, l2: float) -> list[tuple[int, int, float, float] | None]:
    """For each node (feature, cut, value left, value right), or None: rows of a bin up to the cut go left."""
    out = []
    for node in h:
        total = node[0].sum(axis=0)
        left = np.cumsum(node, axis=1)[:, :-1]
        right = total - left
        ok = (left[..., 2] >= max(1.0, least)) & (right[..., 2] >= max(1.0, least)) & (left[..., 1] > 0) & (right[..., 1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2) - total[0] ** 2 / (total[1] + l2), -np.inf)
        gain = np.round(gain, 9)  # sums depend on the order of their terms; equal gains stay equal
        f, c = np.unravel_index(int(np.argmax(gain)), gain.shape) if gain.size else (0, 0)
        if not gain.size or gain[f, c] <= 1e-9:
            out.append(None)
        else:
            out.append((int(f), int(c), float(left[f, c, 0] / (left[f, c, 1] + l2)), float(right[f, c, 0] / (right[f, c, 1] + l2))))
    return out


def boost(df: DataFrame, features: Sequence[str], target: str, models: Sequence[Model], weight: str | None = None, keep: Sequence[str] = (), bins: int = 32, every: int = 25, rows_per_task: int = 500_000, least_per_task: int = 10_000) -> DataFrame:
    """Columns `keep`, and a prediction for each model by its name, without its offset. The models' trees stay in them.

    Rows are dealt to all cores, unless a task would have fewer than `least_per_task` of them, and to more tasks where one would have
    more than `rows_per_task`."""
    size, m = bins + 1, len(models)
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    wide = df.select(*keep, *[finite(c).alias(f"_x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), *[F.coalesce(x.trains, F.lit(False)).alias(f"_t{k}") for k, x in enumerate(models)], *[F.coalesce(x.judges, F.lit(False)).alias(f"_j{k}") if x.judges is not None else F.lit(False).alias(f"_j{k}") for k, x in enumerate(models)], *[(x.offset if x.offset is not None else F.lit(0.0)).cast("double").alias(f"_o{k}") for k, x in enumerate(models)])
    wide = stored(wide, "boosting")
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_x{i}").alias("x")) for i in range(len(features))])).alias("v")).select("v.*")
    edges = {r.f: sorted(set(r.quantiles)) for r in quantiles(long, "x", lambda n: [F.lit(i / bins) for i in range(1, bins)], ["f"]).collect()}  # some numbers for each feature
    names, kinds = [*keep, "_bins", "_y", "_w", "_roles", "_margin"], dict(wide.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "_bins binary, _y double, _w double, _roles binary, _margin binary"])
    at = len(keep)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda i: b.column(at + i).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            x = np.column_stack([np.where(np.isnan(v := column(i).astype(np.float64)), 0, 1 + np.searchsorted(edges.get(i, []), v)) for i in range(len(features))]).astype(np.uint8)
            roles = np.column_stack([column(len(features) + 2 + k).astype(np.uint8) | column(len(features) + 2 + m + k).astype(np.uint8) << 1 for k in range(m)])
            ok = np.isfinite(column(len(features)).astype(np.float64)) & np.isfinite(column(len(features) + 1).astype(np.float64))
            margin = np.column_stack([column(len(features) + 2 + 2 * m + k).astype(np.float64) for k in range(m)])
            roles[~ok] = 0
            roles[~np.isfinite(margin)] = 0
            margin = np.nan_to_num(margin)
            blob = lambda z: pa.array([r.tobytes() for r in z], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], blob(x), b.column(at + len(features)), b.column(at + len(features) + 1), blob(roles), blob(margin)], names)

    rows = wide.count()
    tasks = max(rows // rows_per_task + 1, min(df.sparkSession.sparkContext.defaultParallelism, rows // least_per_task + 1))
    parts = wide.rdd.getNumPartitions()
    dealt = wide.coalesce(tasks) if parts > tasks else wide.repartition(tasks) if parts < tasks else wide
    table = stored(dealt.mapInArrow(binned, schema), "boosting")

    def arrays(b: pa.RecordBatch, at: int = 0) -> tuple:
        """Bins, targets, weights, roles and margins; of bins, roles and margins a row of the array for each feature or model."""

        def blob(i: int, t: type, n: int) -> np.ndarray:
            width = n * np.dtype(t).itemsize
            c = b.column(at + i).cast(pa.binary(width))
            return np.ascontiguousarray(np.frombuffer(c.buffers()[1], np.uint8)[c.offset * width : (c.offset + len(c)) * width].view(t).reshape(-1, n).T)

        y, w = (b.column(at + i).fill_null(0.0).to_numpy(zero_copy_only=False) for i in (1, 2))
        return blob(0, np.uint8, len(features)), y, w, blob(3, np.uint8, m), blob(4, np.float64, m)

    def swept(work, length: int) -> np.ndarray:
        """The sum over all rows of work(bins, y, w, roles, margins), an array of `length` numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for b in batches:
                if b.num_rows:
                    total += work(*arrays(b))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for b in batches:
                for x in b.column(0).to_pylist():
                    total += np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        parts = table.select("_bins", "_y", "_w", "_roles", "_margin").mapInArrow(run, "sums binary")
        if tasks > 64:  # in two steps, so that the driver adds up few
            parts = parts.repartition(int(tasks**0.5)).mapInArrow(add, "sums binary")
        return sum((np.frombuffer(r.sums) for r in parts.collect()), np.zeros(length))

    fresh: list[list[dict]] = [[] for _ in models]  # trees that the stored margins don't have yet

    def start(x, y, w, roles, margin) -> np.ndarray:
        teach = (roles & 1) > 0
        return np.concatenate([np.where(teach, w * (y - margin), 0.0).sum(1), np.where(teach, w, 0.0).sum(1), teach.sum(1)])

    sums = swept(start, 3 * m)
    for k, model in enumerate(models):
        model.base = float(sums[k] / sums[m + k]) if sums[m + k] > 0 else 0.0
        model.least = model.leaf * sums[2 * m + k]
        model.done = not sums[m + k] > 0
    deepest = max((x.depth for x in models), default=0)
    while any(not x.done and len(x.trees) < x.rounds for x in models):
        growing = [k for k, x in enumerate(models) if not x.done and len(x.trees) < x.rounds]
        trees = {k: {"feature": [], "cut": [], "value": [0.0]} for k in growing}
        for level in range(deepest):
            some = [k for k in growing if models[k].depth > level and (level == 0 or any(f >= 0 for f in trees[k]["feature"][2 ** (level - 1) - 1 :]))]
            if not some:
                break
            first, nodes = 2**level - 1, 2**level
            each = nodes * len(features) * size * 3
            bases, known = [x.base for x in models], [list(f) for f in fresh]

            def work(x, y, w, roles, margin, some=some, nodes=nodes, trees=trees, bases=bases, known=known, each=each) -> np.ndarray:
                out = np.zeros(each * len(some) + 2 * len(some))
                for i, k in enumerate(some):
                    left = y - bases[k] - margin[k] - tree_values(known[k], x)
                    out[i * each : (i + 1) * each] = histogram(x, places([trees[k]], x)[0], (roles[k] & 1) > 0, left, w, nodes, size).ravel()
                    judge = (roles[k] & 2) > 0
                    if judge.any():
                        out[each * len(some) + 2 * i] = (w[judge] * left[judge] ** 2).sum()
                        out[each * len(some) + 2 * i + 1] = w[judge].sum()
                return out

            found = swept(work, each * len(some) + 2 * len(some))
            for i, k in enumerate(some):
                model, t = models[k], trees[k]
                if level == 0:  # the error before this round
                    e, n = found[each * len(some) + 2 * i : each * len(some) + 2 * i + 2]
                    if model.judges is not None and n > 0:
                        model.errors.append(float(e / n))
                        best = int(np.argmin(model.errors))
                        if len(model.errors) - 1 - best >= model.patience:
                            model.done = True
                            continue
                h = found[i * each : (i + 1) * each].reshape(nodes, len(features), size, 3)
                t["value"] += [0.0] * (2 * nodes)
                for j, split in enumerate(best_splits(h, model.least, model.l2)):
                    node, is_open = first + j, level == 0 or t["feature"][(first + j - 1) // 2] >= 0
                    t["feature"].append(split[0] if split and is_open else -1)
                    t["cut"].append(split[1] if split and is_open else 0)
                    if split and is_open:
                        t["value"][2 * node + 1], t["value"][2 * node + 2] = model.step * split[2], model.step * split[3]
        for k in growing:
            if models[k].done:
                continue
            if not any(f >= 0 for f in trees[k]["feature"]):
                models[k].done = True  # no split gains anything any more
                continue
            models[k].trees.append(trees[k])
            fresh[k].append(trees[k])
        if max(len(f) for f in fresh) >= every:
            table, fresh = stored(_advanced(table, arrays, fresh, names, schema, at), "boosting"), [[] for _ in models]
    for x in models:  # rounds after the best one don't count
        if x.judges is not None and x.errors:
            x.trees = x.trees[: int(np.argmin(x.errors))]
    plain, outputs = json.dumps([{"base": x.base, "trees": x.trees} for x in models]), [*keep, *[x.name for x in models]]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = json.loads(plain)
        for b in batches:
            if b.num_rows:
                x = np.ascontiguousarray(np.frombuffer(b"".join(b.column(at).to_pylist()), np.uint8).reshape(-1, len(features)).T)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *[pa.array(k["base"] + tree_values(k["trees"], x)) for k in known]], outputs)

    return table.select(*keep, "_bins").mapInArrow(predict, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"`{x.name}` double" for x in models]]))


def _advanced(table: DataFrame, arrays, fresh: list[list[dict]], names: list[str], schema: str, at: int) -> DataFrame:
    """The rows with the fresh trees added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, _, _, _, margin = arrays(b, at)
                new = np.column_stack([margin[k] + tree_values(f, x) for k, f in enumerate(fresh)])
                yield pa.RecordBatch.from_arrays([*b.columns[: at + 4], pa.array([r.tobytes() for r in new], pa.binary())], names)

    return table.mapInArrow(run, schema)
