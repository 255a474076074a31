"""Backtests with rolling origins: what was known before each event, tried on that event.

Rows are summed per key and event first; prefix sums over a key's events then give every event the sums of all earlier
ones. So a fit for each event costs one aggregation and one window over events, and no row is fitted on its own event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.operators.linear import earlier_entries, gram_entries, group_fits, projected
from arealis.operators.panel import ratio
from arealis.operators.slopes import shrink
from arealis.sources.io import stored


def earlier(df: DataFrame, keys: Sequence[str], event: str, sums: dict[str, Column]) -> DataFrame:
    """keys, event and, for each name, the sum of its column over the key's rows of earlier events (null at the first).

    A window holds a row for each event of a key; rows of an event are summed in part before the shuffle."""
    per = df.groupBy(*keys, event).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy(event).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, event, *[F.sum(name).over(w).alias(name) for name in sums])


def rolling_slopes(df: DataFrame, keys: Sequence[str], event: str, x: str, y: str, least: int = 3) -> DataFrame:
    """keys, event, n, slope, se: least squares with an intercept of y on x over the key's rows of earlier events. Keys with
    fewer such rows than `least`, or constant x, have none. Rows with a null value are left out."""
    a, b, ok = F.col(x), F.col(y), df.dropna(subset=[x, y])
    s = earlier(ok, keys, event, {"n": F.lit(1.0), "_x": a, "_y": b, "_xx": a * a, "_xy": a * b, "_yy": b * b})
    n = F.col("n")
    s = s.where(n >= least).withColumns({k: F.col(f"_{k}") / n - F.col(f"_{k[0]}") * F.col(f"_{k[1]}") / (n * n) for k in ("xx", "xy", "yy")})
    slope = F.col("xy") / F.col("xx")
    rest = F.greatest(F.lit(0.0), F.col("yy") - slope * F.col("xy"))
    return s.where("xx > 1e-9").select(*keys, event, n.cast("long").alias("n"), slope.alias("slope"), F.sqrt(rest / F.greatest(n - 2, F.lit(1.0)) / F.col("xx")).alias("se"))


def correlation(a: Column, b: Column) -> Column:
    """Null where either side doesn't vary."""
    return F.when((F.var_pop(a) > 1e-9) & (F.var_pop(b) > 1e-9), ratio(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


def scores(df: DataFrame, keys: Sequence[str], actual: Column, base: Column, methods: dict[str, Column], against: dict[str, Column] | None = None) -> DataFrame:
    """keys, method, n, rmse, het_corr: error of each method's prediction, and the correlation of what it adds to `base` with
    what base leaves over (null where it adds nothing). With `against`, a base of its own for some methods, also extra_corr.
    Rows without any of the values are left out of a method."""
    none = F.lit(None).cast("double")
    made = F.array(*[F.struct(F.lit(m).alias("method"), actual.alias("y"), base.alias("b"), p.cast("double").alias("p"), (against or {}).get(m, none).cast("double").alias("c")) for m, p in methods.items()])
    ok = df.select(*keys, F.explode(made).alias("_s")).select(*keys, "_s.*").dropna(subset=["y", "b", "p"])
    y, b, p, c = (F.col(x) for x in "ybpc")
    extra = [] if against is None else [correlation(p - c, F.when(c.isNotNull(), y - c)).alias("extra_corr")]
    return ok.groupBy(*keys, "method").agg(F.count("*").alias("n"), F.sqrt(F.avg((y - p) ** 2)).alias("rmse"), correlation(p - b, y - b).alias("het_corr"), *extra)


def level_cells(df: DataFrame, event: str, level: str, dx: str, dy: str, width: float) -> DataFrame:
    """Sums per event and cell of the level, `width` wide: what binned curves are made from."""
    x, y = F.col(dx), F.col(dy)
    sums = {"n": F.lit(1.0), "level": F.col(level), "xy": x * y, "xx": x * x}
    return df.dropna(subset=[level, dx, dy]).groupBy(event, F.floor(F.col(level) / width).alias("cell")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def earlier_cells(cells: DataFrame, event: str) -> DataFrame:
    """The sums of each cell over all earlier events, for every event. Every cell gets a row for every event first."""
    names = [c for c in cells.columns if c not in (event, "cell")]
    events = cells.agg(F.collect_set(event).alias("_events"))  # one row
    every = cells.select("cell").distinct().crossJoin(F.broadcast(events)).select("cell", F.explode("_events").alias(event))
    filled = every.join(cells, [event, "cell"], "left").fillna(0.0, subset=names)
    w = Window.partitionBy("cell").orderBy(event).rowsBetween(Window.unboundedPreceding, -1)
    return filled.select(event, "cell", *[F.sum(c).over(w).alias(c) for c in names]).where("n > 0")


def curves(cells: DataFrame, event: str, bins: int) -> DataFrame:
    """event, points: for each event at most `bins` points (level, gamma) in order of level. Cells are joined into bins of about
    equal count, a cell going where its middle lies; gamma is the slope through the origin. A row holds a point for each bin."""
    w = Window.partitionBy(event)  # the cells of an event: as many as the level's range has
    middle = F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n") / 2
    binned = cells.withColumn("bin", F.floor(bins * middle / F.sum("n").over(w)))
    points = binned.groupBy(event, "bin").agg((F.sum("level") / F.sum("n")).alias("level"), ratio(F.sum("xy"), F.sum("xx")).alias("gamma")).where("gamma is not null")
    return points.groupBy(event).agg(F.array_sort(F.collect_list(F.struct("level", "gamma"))).alias("points"))


def interpolated(points: str, x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value of a curve at x: linear between its points, flat outside, clipped; null without points or x. One walk over the points."""
    state = lambda level, gamma, value, done: F.struct(level.cast("double").alias("l"), gamma.cast("double").alias("g"), value.cast("double").alias("v"), done.alias("done"))
    none, open_, closed = F.lit(None), F.lit(False), F.lit(True)

    def step(s: Column, p: Column) -> Column:
        between = s["g"] + (p["gamma"] - s["g"]) * ratio(x - s["l"], p["level"] - s["l"])
        return F.when(s["done"], s).when(p["level"] <= x, state(p["level"], p["gamma"], p["gamma"], open_)).otherwise(state(s["l"], s["g"], F.coalesce(between, p["gamma"]), closed))

    return F.when(x.isNotNull(), F.aggregate(points, state(none, none, none, open_), step, lambda s: F.least(F.greatest(s["v"], F.lit(low)), F.lit(high))))


def unit_responses(df: DataFrame, unit: str, event: str, level: str, dx: str, dy: str, curve: DataFrame) -> DataFrame:
    """unit, event, extra: how far a unit's own response over earlier events lies from the curve known then at its mean level,
    shrunk by the variance between units that is left beyond the sampling error at that event. 0 below two earlier rows."""
    x, y = F.col(dx), F.col(dy)
    s = earlier(df.dropna(subset=[level, dx, dy]), [unit], event, {"n": F.lit(1.0), "_level": F.col(level), "_xx": x * x, "_xy": x * y, "_yy": y * y}).where("n >= 2 and _xx > 0")
    s = s.join(curve, event)
    raw = F.col("_xy") / F.col("_xx")
    rest = F.greatest(F.col("_yy") - raw * F.col("_xy"), F.lit(1e-9))
    s = s.select(unit, event, (raw - interpolated("points", F.col("_level") / F.col("n"))).alias("dev"), (rest / (F.col("n") - 1) / F.col("_xx")).alias("se2"))
    w = 1 / F.greatest(F.col("se2"), F.lit(1e-9))
    tau2 = s.groupBy(event).agg(F.greatest(F.lit(0.0), ratio(F.sum(w * F.col("dev") ** 2), F.sum(w)) - F.avg("se2")).alias("tau2"))
    return s.join(tau2, event).select(unit, event, (ratio("tau2", F.col("tau2") + F.col("se2")) * F.col("dev")).alias("extra"))


def response_backtest(df: DataFrame, unit: str, event: str, level: str, dx: str, dy: str, bins: int = 20, width: float = 1.0) -> DataFrame:
    """event, method, n, rmse, het_corr: three responses of dy to dx, each learnt from earlier events only, on each event that has
    any: one number (flat), a curve over the level, and the curve with each unit's shrunk departure (unit)."""
    ok = stored(df.select(unit, event, level, dx, dy).dropna(subset=[level, dx, dy]), "moves")
    cells = stored(earlier_cells(level_cells(ok, event, level, dx, dy, width), event), "cells")
    curve = curves(cells, event, bins)
    flat = cells.groupBy(event).agg(ratio(F.sum("xy"), F.sum("xx")).alias("flat"))
    extra = unit_responses(ok, unit, event, level, dx, dy, curve)
    rows = ok.join(flat.join(curve, event), event).join(extra, [unit, event], "left")
    x, on = F.col(dx), interpolated("points", F.col(level))
    own = F.least(F.greatest(on + F.coalesce("extra", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return scores(rows, [event], F.col(dy), F.col("flat") * x, {"flat": F.col("flat") * x, "curve": on * x, "unit": own * x})


def slope_backtest(df: DataFrame, unit: str, group: str, event: str, dx: str, dy: str) -> DataFrame:
    """event, method, n, rmse, het_corr: the change dy of each unit predicted by the tide dx itself (uniform), by dx times the
    unit's slope over earlier events, shrunk with the variance between units known at that event (unit), and by dx times its
    group's pooled slope (group). All methods are tried on the rows that have both slopes."""
    df = stored(df.select(unit, group, event, dx, dy), "moves")
    own = shrink(rolling_slopes(df, [unit], event, dx, dy), keys=[event]).select(unit, event, F.col("shrunk").alias("_own"))
    pooled = rolling_slopes(df, [group], event, dx, dy).select(group, event, F.col("slope").alias("_pooled"))
    rows = df.join(own, [unit, event]).join(pooled, [group, event])
    x = F.col(dx)
    return scores(rows, [event], F.col(dy), x, {"uniform": x, "unit": F.col("_own") * x, "group": F.col("_pooled") * x})


def standardised(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """New columns with mean 0 and population deviation 1 over all rows: new name to column."""
    df = stored(df, "features")
    one = df.agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate(columns.values()) for k, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    wide = df.crossJoin(F.broadcast(one))
    z = {name: F.coalesce(ratio(F.col(c) - F.col(f"_m{i}"), f"_s{i}"), F.lit(0.0)) for i, (name, c) in enumerate(columns.items())}
    return wide.withColumns(z).drop(*one.columns)


def within_across(df: DataFrame, event: str, half: str, features: Sequence[str], level: str, dx: str, dy: str, alpha: float, bins: int = 20, width: float = 1.0) -> DataFrame:
    """event, method, n, rmse, het_corr, extra_corr on the rows of half `b` of each event that has earlier ones: the response of dy
    to dx by the curve of earlier events (level), by a weighted ridge on the features fitted on half `a` of the same event (within),
    and by one fitted on all earlier events (across). extra_corr: what the features add to the curve of the same rows.

    One scan gives Grams by event and half; which rows a fit may see is a choice of Grams."""
    x = F.col(dx)
    known = df.select(event, half, *dict.fromkeys([*features, level, dx, dy])).dropna(subset=[level, dx, dy, *features])
    rows = stored(known.where(x != 0).withColumns({"_r": F.col(dy) / x, "_w": x * x}), "moves")
    entries = stored(gram_entries(rows, features, "_r", [event, half], "_w"), "grams")
    fitted = lambda e, name: group_fits(e, features, [event], alpha).select(event, F.struct("intercept", "coefficients").alias(name))
    within, across = fitted(entries.where(F.col(half) == "a").select(event, "place", "v"), "_within"), fitted(earlier_entries(entries, event), "_across")
    before = stored(earlier_cells(level_cells(rows, event, level, dx, dy, width), event), "cells")
    flat = before.groupBy(event).agg(ratio(F.sum("xy"), F.sum("xx")).alias("_flat"))
    own = curves(level_cells(rows.where(F.col(half) == "a"), event, level, dx, dy, width), event, bins).withColumnRenamed("points", "_own")
    known = within.join(across, event).join(flat, event).join(own, event).join(curves(before, event, bins).withColumnRenamed("points", "_before"), event)
    tried = rows.where(F.col(half) == "b").join(known, event)
    clipped = lambda c: F.least(F.greatest(projected(features, f"{c}.intercept", f"{c}.coefficients"), F.lit(0.0)), F.lit(1.0))
    tried = tried.withColumns({"_pw": clipped("_within"), "_pa": clipped("_across"), "_cw": interpolated("_own", F.col(level)), "_ca": interpolated("_before", F.col(level))})
    methods = {"level": F.col("_ca") * x, "within": F.col("_pw") * x, "across": F.col("_pa") * x}
    return scores(tried, [event], F.col(dy), F.col("_flat") * x, methods, {"within": F.col("_cw") * x, "across": F.col("_ca") * x})


def coefficient_stability(df: DataFrame, event: str, features: Sequence[str], dx: str, dy: str, alpha: float, least: int = 2) -> DataFrame:
    """event_a, event_b, r, same_direction: for each pair of events, the correlation of the coefficients of a weighted ridge of the
    response on the features, fitted on each event alone. Events with fewer rows than `least` are left out."""
    x = F.col(dx)
    known = df.select(event, *dict.fromkeys([*features, dx, dy])).dropna(subset=[dx, dy, *features])
    rows = stored(known.where(x != 0).withColumns({"_r": F.col(dy) / x, "_w": x * x}), "moves")
    sizes = rows.groupBy(event).agg(F.count("*").alias("_n"), F.avg(dx).alias("_tide"))
    fits = group_fits(gram_entries(rows, features, "_r", [event], "_w"), features, [event], alpha).join(sizes.where(F.col("_n") >= least), event)
    long = fits.select(F.col(event).alias("event"), "_tide", F.posexplode("coefficients").alias("_i", "_c"))
    a, b = (long.select("_i", *[F.col(c).alias(f"{c}_{k}") for c in ("event", "_tide", "_c")]) for k in "ab")
    met = a.join(b, "_i").where("event_a < event_b")  # a row for each pair of events and feature
    pair = met.groupBy("event_a", "event_b").agg(ratio(F.covar_pop("_c_a", "_c_b"), F.sqrt(F.var_pop("_c_a") * F.var_pop("_c_b"))).alias("r"), (F.max("_tide_a") > 0).alias("_up"), (F.max("_tide_b") > 0).alias("_also"))
    return pair.select("event_a", "event_b", "r", (F.col("_up") == F.col("_also")).alias("same_direction"))
