"""Operators over a panel: units at dated events, with a measured total split into blocks.

Every function takes DataFrames and column names and returns a DataFrame. Groups that a window needs together are
units or events, never the whole table; totals are window sums, so nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str, scale: float = 1.0) -> Column:
    """a / b * scale; null where b is 0 or either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))) * scale


def share(df: DataFrame, within: Sequence[str], value: str, out: str = "share", scale: float = 100.0) -> DataFrame:
    """value as a percentage of its total within the keys; rows with a null key are dropped."""
    df = df.dropna(subset=list(within))
    return df.withColumn(out, ratio(F.col(value), F.sum(value).over(Window.partitionBy(*within)), scale))


def contested(df: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows of groups with more than one row."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*within))).where("_n > 1").drop("_n")


def block_pivot(df: DataFrame, keys: Sequence[str], block: str, blocks: Sequence[str], value: str) -> DataFrame:
    """One row per key, one column per block; an absent block is 0."""
    return df.groupBy(*keys).pivot(block, list(blocks)).agg(F.sum(value)).fillna(0.0, subset=list(blocks))


def presence(df: DataFrame, keys: Sequence[str], block: str, blocks: Sequence[str]) -> DataFrame:
    """Whether each block occurs, per key: has_<block>."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.bool_or(F.col(block) == b), F.lit(False)).alias(f"has_{b}") for b in blocks])


def event_means(df: DataFrame, event: Sequence[str], columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Mean of each column over the units of an event, unweighted unless a weight is given: mean_<column>."""
    if weight is None:
        return df.groupBy(*event).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    return df.groupBy(*event).agg(*[ratio(F.sum(F.col(weight) * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(f"mean_{c}") for c in columns])


def with_means(df: DataFrame, event: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Each row with its event's means: new name to column. Rows with a null key have none.

    Units are averaged in part before the shuffle, and the few events go back by a join, so no task holds a whole event."""
    means = df.groupBy(*event).agg(*[F.avg(c).alias(name) for name, c in columns.items()])
    return df.join(means, list(event), "left")


def deviations(df: DataFrame, event: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each column less its event mean: dev_<column>."""
    out = with_means(df, event, {f"_mean_{c}": c for c in columns})
    return out.withColumns({f"dev_{c}": F.col(c) - F.col(f"_mean_{c}") for c in columns}).drop(*[f"_mean_{c}" for c in columns])


def condition_rows(df: DataFrame, kinds: Sequence[str], kind: str, unit: str, order: Sequence[str], columns: Sequence[str], indicators: Sequence[str], depth: int = 2) -> DataFrame:
    """The training table of a set of event kinds: deviations from the mean of kind and event, lags of columns and
    deviations over the unit's rows of these kinds, and only rows in which all of these and the indicators are known."""
    rows = deviations(df.where(F.col(kind).isin(list(kinds))), list(dict.fromkeys([kind, *order])), columns)
    both = [*columns, *[f"dev_{c}" for c in columns]]
    return lags(rows, [unit], order, both, depth).dropna(subset=[*indicators, *[f"{c}_lag{k}" for c in both for k in range(1, depth + 1)]])


def restrict_rows(df: DataFrame, where: Column, keep: DataFrame, key: str) -> DataFrame:
    """All rows but those of `where` whose key isn't in `keep`."""
    marked = keep.select(F.col(key).alias("_key")).distinct().withColumn("_kept", F.lit(True))
    return df.join(marked, F.col(key) == F.col("_key"), "left").where(~where | F.col("_kept").isNotNull()).drop("_key", "_kept")


def lags(df: DataFrame, unit: Sequence[str], order: Sequence[str], columns: Sequence[str], depth: int = 1) -> DataFrame:
    """Earlier values within the unit: <column>_lag<k>. Put the event type in `unit` to stay within a type."""
    w = Window.partitionBy(*unit).orderBy(*order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, depth + 1)})


def first_difference(df: DataFrame, unit: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*unit).orderBy(*order)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def parent_means(df: DataFrame, parent: Sequence[str], event: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*parent, *event).agg(*[F.avg(c).alias(c) for c in columns])


def repaired_lags(df: DataFrame, unit: str, parent: str, order: Sequence[str], columns: Sequence[str], size: str, most: float = 3.0) -> DataFrame:
    """Lag 1 per unit, dropped where the unit's size changed by more than `most` times, then filled from the parent's
    mean at the parent's previous event: <column>_lag, lag_fallback."""
    w = Window.partitionBy(unit).orderBy(*order)
    change = ratio(F.col(size), F.lag(size).over(w))
    out = df.withColumns({f"{c}_own": F.lag(c).over(w) for c in columns} | {"_change": change})
    means = lags(parent_means(df, [parent], order, columns), [parent], order, columns)
    out = out.join(means.select(parent, *order, *[F.col(f"{c}_lag1").alias(f"{c}_parent") for c in columns]), [parent, *order], "left")
    broken = F.coalesce((F.col("_change") > most) | (F.col("_change") < 1 / most), F.lit(False))
    own = {c: F.when(~broken, F.col(f"{c}_own")) for c in columns}
    out = out.withColumns({f"{c}_lag": F.coalesce(own[c], F.col(f"{c}_parent")) for c in columns} | {"lag_fallback": own[columns[0]].isNull()})
    return out.drop("_change", *[f"{c}_{x}" for c in columns for x in ("own", "parent")])


def lag_across(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], suffix: str = "_lag") -> DataFrame:
    """Each column's value in the key's previous row, for keys with so many rows that no window may hold one: <column>_lag.

    Rows are dealt into ranges of key and order, and stored, so that the ranges stay as they are; windows hold a range. A
    range's first row takes its value from the last row of the range before, by a join of a row for each range."""
    from arealis.sources.io import stored

    by = [*keys, *order]
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(df.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_range").orderBy(*by)
    value = F.struct(*keys, *columns)
    rows = rows.withColumns({"_before": F.lag(value).over(w), "_place": F.row_number().over(w)})
    last = rows.groupBy("_range").agg(F.max_by(value, F.struct(*by, "_place")).alias("_last"))
    carried = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    joined = rows.join(carried, "_range").withColumn("_v", F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_before")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_v.{k}").eqNullSafe(F.col(k))
    return joined.withColumns({f"{c}{suffix}": F.when(F.col("_v").isNotNull() & same, F.col(f"_v.{c}")) for c in columns}).drop("_range", "_before", "_place", "_carried", "_v")


def event_gap(df: DataFrame, series: Sequence[str], when: str, out: str = "gap") -> DataFrame:
    """Time since the previous event of the series."""
    return df.withColumn(out, F.col(when) - F.lag(when).over(Window.partitionBy(*series).orderBy(when)))


def leader(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """lead, runner_up and margin; ties fall to the block that is named first."""
    ranked = F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(b), F.lit(0.0))).alias("v"), F.lit(i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(blocks)]))
    df = df.withColumn("_r", ranked)
    return df.withColumns({"lead": F.col("_r")[0]["b"], "runner_up": F.col("_r")[1]["b"], "margin": F.col("_r")[1]["v"] - F.col("_r")[0]["v"]}).drop("_r")


def tipping_point(df: DataFrame, block: str, others: Sequence[str], weights: dict[str, float] | None = None, out: str = "tip") -> DataFrame:
    """The swing to `block` at which it takes the lead, when the others lose in proportion to their weights."""
    weights = weights or {b: 1 / len(others) for b in others}
    need = [(F.col(b) - F.col(block)) / (1 + weights[b]) for b in others]
    return df.withColumn(out, F.greatest(F.lit(0.0), *need))


def conserved_swing(df: DataFrame, deltas: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """Shares after a swing whose sum is 0: what the named blocks gain is taken from the others by weight: new_<block>."""
    rest = {b: w for b, w in weights.items() if b not in deltas}
    total, gain = sum(rest.values()) or 1.0, sum(deltas.values())
    change = deltas | {b: -gain * w / total for b, w in rest.items()}
    return df.withColumns({f"new_{b}": F.col(b) + F.lit(change[b]) for b in weights})


def swing_weights(df: DataFrame, blocks: Sequence[str], weight: str) -> DataFrame:
    """Weighted mean share of each block: one row."""
    return df.agg(*[ratio(F.sum(F.col(b) * F.col(weight)), F.sum(weight)).alias(b) for b in blocks])


def distinct_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Stored rows: keys, _v (a value that isn't null), _c (how often the key has it). What all of a column's quantiles come from."""
    from arealis.sources.io import stored

    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    return stored(counted, "values")


def quantiles(df: DataFrame, value: str, levels: Callable[[Column], Sequence[Column]], keys: Sequence[str] = (), cells: int = 100) -> DataFrame:
    """Exact quantiles per key, linearly interpolated, at the levels that `levels` gives for a group's size: n, quantiles (an array).
    Null values are left out; a key without any value, or a null one, gives no row. The input is read once."""
    return value_quantiles(distinct_values(df, value, keys), levels, keys, cells)


def value_quantiles(values: DataFrame, levels: Callable[[Column], Sequence[Column]], keys: Sequence[str] = (), cells: int = 100) -> DataFrame:
    """quantiles() of distinct_values(), by its keys or some of them.

    A sketch cuts each group's values into `cells` cells of about equal size; the counts of the cells tell in which ones the
    wanted ranks lie, and only these are sorted, each by itself. So no task sorts a whole group."""
    keys = list(keys)
    join = lambda a, b, on: a.join(b, on) if on else a.crossJoin(F.broadcast(b))  # noqa: E731  without keys b has one row
    if set(values.columns) != {*keys, "_v", "_c"}:
        values = values.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    whole = values.groupBy(*keys).agg(F.sum("_c").alias("n"), F.percentile_approx("_v", [i / cells for i in range(1, cells)], 100 * cells).alias("_edges"))
    whole = whole.where("n > 0").withColumn("_at", F.array(*[x * (F.col("n") - 1) for x in levels(F.col("n"))]))
    whole = whole.withColumn("_ranks", F.array_distinct(F.concat(F.transform("_at", lambda t: F.floor(t)), F.transform("_at", lambda t: F.ceil(t)))))
    celled = join(values, whole.select(*keys, "_edges"), keys).select(*keys, "_v", "_c", F.size(F.filter("_edges", lambda e: e < F.col("_v"))).alias("_cell"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = celled.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(upto(Window.partitionBy(*keys).orderBy("_cell"))) - F.col("_n"))  # at most `cells` rows a key
    holds = lambda low, size: F.exists("_ranks", lambda k: (k >= low) & (k < low + size))
    hit = join(counts, whole.select(*keys, "_ranks"), keys).where(holds(F.col("_before"), F.col("_n"))).drop("_n")
    ranked = celled.join(hit, [*keys, "_cell"]).withColumn("_low", F.col("_before") + F.sum("_c").over(upto(Window.partitionBy(*keys, "_cell").orderBy("_v"))) - F.col("_c"))
    found = ranked.where(holds(F.col("_low"), F.col("_c"))).groupBy(*keys).agg(F.collect_list(F.struct("_low", "_c", "_v")).alias("_found"))
    at = lambda k: F.filter("_found", lambda x: (x["_low"] <= k) & (k < x["_low"] + x["_c"]))[0]["_v"]
    between = lambda t: at(F.floor(t)) + (at(F.ceil(t)) - at(F.floor(t))) * (t - F.floor(t))
    return join(whole.select(*keys, "n", "_at"), found, keys).select(*keys, "n", F.transform("_at", between).alias("quantiles"))


def quantile_edges(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Interior edges of equal-count bins as an array, equal edges merged, per key."""
    found = quantiles(df, value, lambda n: [F.lit(i / bins) for i in range(1, bins)], keys)
    return found.select(*keys, F.array_distinct("quantiles").alias("edges"))


def in_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Number of the equal-count bin, from 0; a value on an edge belongs to the lower bin, a null value to none."""
    edges = quantile_edges(df, value, bins)
    return df.join(F.broadcast(edges), F.lit(True), "left").withColumn(out, F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "weighted_median") -> DataFrame:
    """Interpolated weighted median per key: where the cumulative weight, less half a row's own, crosses one half."""
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = df.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    p = merged.withColumn("_p", (F.sum("_w").over(w) - F.col("_w") / 2) / F.sum("_w").over(Window.partitionBy(*keys)))
    low, high = F.col("_p") <= 0.5, F.col("_p") >= 0.5
    ends = p.groupBy(*keys).agg(
        F.max_by(F.struct(value, "_p"), F.when(low, F.col("_p"))).alias("lo"),
        F.min_by(F.struct(value, "_p"), F.when(high, F.col("_p"))).alias("hi"),
    )
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    between = lo[value] + (hi[value] - lo[value]) * F.coalesce(ratio(0.5 - lo["_p"], hi["_p"] - lo["_p"]), F.lit(0.0))
    return ends.select(*keys, between.alias(out))


def rollup(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str) -> DataFrame:
    """Weighted means per key, plain means where all weights are 0, the total weight and the number of rows."""
    total = F.sum(weight)
    means = [F.coalesce(ratio(F.sum(F.col(c) * F.col(weight)), total), F.avg(c)).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*means, total.alias("weight"), F.count("*").alias("n_units"))
