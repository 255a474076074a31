"""Distribution-free prediction intervals and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.sources.io import stored
from arealis.operators.panel import distinct_values, in_bins, quantile_edges, quantiles, ratio, value_quantiles


def level(n: Column, alpha: float) -> Column:
    """The quantile level with the finite-sample correction, at most 1."""
    return F.least(F.lit(1.0), (1 - alpha) * (1 + 1 / F.greatest(n, F.lit(1))))


def half_widths(df: DataFrame, residual: str, alpha: float, keys: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Quantile of the absolute residuals per key, linearly interpolated: half_width, n_calibration."""
    found = quantiles(df.withColumn("_r", F.abs(residual)), "_r", lambda size: [level(F.lit(n) if n else size, alpha)], keys)
    return found.select(*keys, F.col("n").alias("n_calibration"), F.col("quantiles")[0].alias("half_width"))


def by_class(df: DataFrame, residual: str, alpha: float, key: str, least: int = 50) -> DataFrame:
    """half_width per class; classes with fewer than `least` rows take the global one. Both come from one reading."""
    values = distinct_values(df.withColumn("_r", F.abs(residual)), "_r", [key])
    at = lambda n: [level(n, alpha)]
    own = value_quantiles(values, at, [key]).select(key, F.col("n").alias("n_calibration"), F.col("quantiles")[0].alias("half_width"))
    whole = value_quantiles(values, at).select(F.col("quantiles")[0].alias("_all"))
    return own.crossJoin(F.broadcast(whole)).select(key, "n_calibration", F.when(F.col("n_calibration") >= least, F.col("half_width")).otherwise(F.col("_all")).alias("half_width"))


def adaptive(df: DataFrame, residual: str, alpha: float, size: str, bins: int = 5) -> DataFrame:
    """half_width per bin of the absolute size; the correction uses the number of all rows."""
    binned = in_bins(df.withColumn("_s", F.abs(size)), "_s", bins)
    return half_widths(binned, residual, alpha, ["bin"], n=df.where(F.col(residual).isNotNull()).count())


def coverage(df: DataFrame, actual: str, low: str, high: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per key: n, coverage (share of rows, or of weight, inside), width and median_width. Rows with a null bound or value, or a null key, are left out."""
    ok = df.dropna(subset=[actual, low, high, *keys]).withColumn("_width", F.col(high) - F.col(low))
    w = F.col(weight) if weight else F.lit(1.0)
    inside = F.when((F.col(actual) >= F.col(low)) & (F.col(actual) <= F.col(high)), w).otherwise(0.0)
    found = ok.groupBy(*keys).agg(F.count("*").alias("n"), ratio(F.sum(inside), F.sum(w)).alias("coverage"), F.avg("_width").alias("width"))
    middle = quantiles(ok, "_width", lambda n: [F.lit(0.5)], keys).select(*keys, F.col("quantiles")[0].alias("median_width"))
    return found.join(middle, list(keys)) if keys else found.crossJoin(F.broadcast(middle))  # without keys a row each


def run_methods(df: DataFrame, actual: str, predicted: str, calibration: Column, alphas: Sequence[float], weight: str, territory: str, size: str, present: str, bins: int = 5, least: int = 30, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """method, alpha, class, n, coverage, weighted, width, median_width of the rows outside `calibration`, with widths from the rows inside.

    Methods: standard, one width; territory, one for each territory with `least` rows; adaptive, one for each equal-count bin of the
    absolute size, corrected by the number of all rows; masked, one width with predictions that are 0 where the block isn't present.
    Classes without a width of their own take the standard one. Bounds are clipped to [low, high].

    Every row is exploded by method, so that one pass of quantiles gives the widths of all methods, classes and levels."""
    rows = df.dropna(subset=[actual, predicted]).withColumns({"_cal": F.coalesce(calibration, F.lit(False)), "_size": F.abs(size)})
    edges = quantile_edges(rows.where("_cal"), "_size", bins)
    rows = rows.join(F.broadcast(edges), F.lit(True), "left").withColumn("_bin", F.size(F.filter("edges", lambda e: e < F.col("_size"))))  # one row
    of = lambda name, kind, centre: F.struct(F.lit(name).alias("method"), F.coalesce(kind.cast("string"), F.lit("none")).alias("class"), centre.cast("double").alias("centre"))
    p = F.col(predicted)
    methods = F.array(of("standard", F.lit("all"), p), of("territory", F.col(territory), p), of("adaptive", F.col("_bin"), p), of("masked", F.lit("all"), F.when(F.col(present), p).otherwise(0.0)))
    each = rows.select(F.col(actual).alias("_y"), F.col(weight).alias("_w"), "_cal", F.explode(methods).alias("_m")).select("_y", "_w", "_cal", "_m.*").withColumn("_r", F.abs(F.col("_y") - F.col("centre")))
    each = stored(each, "methods")
    n = each.where("_cal and method = 'standard'").count()
    corrected = lambda size: F.when(F.col("method") == "adaptive", F.lit(n)).otherwise(size)
    widths = quantiles(each.where("_cal"), "_r", lambda size: [level(corrected(size), a) for a in alphas], ["method", "class"])
    standard = widths.where("method = 'standard'").select(F.col("quantiles").alias("_standard"))
    own = widths.where((F.col("method") != "territory") | (F.col("n") >= least)).select("method", "class", F.col("quantiles").alias("_own"))
    tried = each.where("not _cal").join(own, ["method", "class"], "left").join(F.broadcast(standard), F.lit(True), "left")  # one row
    tried = tried.select("*", F.posexplode(F.coalesce("_own", "_standard")).alias("_i", "_h"))
    clip = lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    tried = tried.withColumns({"alpha": F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("_i") + 1), "_low": clip(F.col("centre") - F.col("_h")), "_high": clip(F.col("centre") + F.col("_h"))})
    keys = ["method", "alpha", "class"]
    weighed = ratio(F.sum(F.when((F.col("_y") >= F.col("_low")) & (F.col("_y") <= F.col("_high")), F.col("_w")).otherwise(0.0)), F.sum("_w"))
    return coverage(tried, "_y", "_low", "_high", keys).join(tried.groupBy(*keys).agg(weighed.alias("weighted")), keys)


def masked(df: DataFrame, present: dict[str, str], rate: float = 0.0) -> DataFrame:
    """Predictions of blocks that aren't on a unit's slate become 0; `rate` of that mass goes to the others in proportion."""
    blocks = list(present)
    gone = sum((F.when(F.col(present[b]), 0.0).otherwise(F.greatest(F.col(b), F.lit(0.0))) for b in blocks), F.lit(0.0))
    left = sum((F.when(F.col(present[b]), F.greatest(F.col(b), F.lit(0.0))).otherwise(0.0) for b in blocks), F.lit(0.0))
    return df.withColumns({b: F.when(F.col(present[b]), F.col(b) + F.coalesce(rate * gone * ratio(F.greatest(F.col(b), F.lit(0.0)), left), F.lit(0.0))).otherwise(0.0) for b in blocks})
