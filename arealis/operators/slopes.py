"""Response slopes: per unit, shrunk, per level bin, interpolated, and with a bootstrap band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators.panel import in_bins, ratio


def ols(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """slope, se and n of y on x with an intercept, per key; keys with fewer rows than `least` or constant x are left out."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*").cast("double")
    s = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("_xy"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"))
    s = s.where((F.col("n") >= least) & (F.col("_xx") > 1e-12))
    slope, n = F.col("_xy") / F.col("_xx"), F.col("n")
    rest = F.greatest(F.lit(0.0), F.col("_yy") - slope * F.col("_xy"))
    return s.select(*keys, "n", slope.alias("slope"), F.sqrt(rest / F.greatest(n - 2, F.lit(1)) / F.col("_xx")).alias("se"))


def left_out_pair(df: DataFrame, keys: Sequence[str], a: str, b: str, y: str, out: str = "left_out") -> DataFrame:
    """Prediction of each row's y from a and b by the least-squares plane of the other rows of its group: from the plane of all
    rows and the row's leverage. Null where the others don't determine a plane. Rows with a null value are left out."""
    ok = df.dropna(subset=[a, b, y])
    mean = [F.avg(c).alias(f"_m{i}") for i, c in enumerate((a, b, y))]
    pairs = {"_aa": (a, a), "_bb": (b, b), "_ab": (a, b), "_ay": (a, y), "_by": (b, y)}
    sums = ok.groupBy(*keys).agg(F.count("*").alias("_n"), *mean, *[F.covar_pop(x, z).alias(k) for k, (x, z) in pairs.items()])
    x, z = F.col(a) - F.col("_m0"), F.col(b) - F.col("_m1")
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") ** 2
    fit = F.col("_m2") + ratio((F.col("_ay") * F.col("_bb") - F.col("_by") * F.col("_ab")) * x + (F.col("_by") * F.col("_aa") - F.col("_ay") * F.col("_ab")) * z, det)
    leverage = (1 + ratio(x * x * F.col("_bb") - 2 * x * z * F.col("_ab") + z * z * F.col("_aa"), det)) / F.col("_n")
    joined = ok.join(sums, list(keys))
    left = F.when(leverage < 1 - 1e-9, F.col(y) - (F.col(y) - fit) / (1 - leverage))
    return joined.withColumn(out, left).drop("_n", "_m0", "_m1", "_m2", *pairs)


def shrink(slopes: DataFrame, slope: str = "slope", se: str = "se", keys: Sequence[str] = ()) -> DataFrame:
    """Empirical Bayes: slopes drawn to their precision-weighted mean; tau2 is the variance beyond the sampling error: shrunk.
    Mean and tau2 are those of all slopes, or of each key."""
    w = 1 / F.greatest(F.col(se) ** 2, F.lit(1e-12))
    one = slopes.groupBy(*keys).agg(ratio(F.sum(w * F.col(slope)), F.sum(w)).alias("_mean"), F.greatest(F.lit(0.0), F.var_pop(slope) - F.avg(F.col(se) ** 2)).alias("_tau2"))
    joined = slopes.join(one, list(keys)) if keys else slopes.crossJoin(F.broadcast(one))
    b = F.coalesce(ratio(F.col("_tau2"), F.col("_tau2") + F.col(se) ** 2), F.lit(0.0))
    return joined.withColumn("shrunk", F.col("_mean") + b * (F.col(slope) - F.col("_mean"))).drop("_mean", "_tau2")


def curve(df: DataFrame, level: str, dx: str, dy: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per level bin the slope through the origin and the mean level: bin, level, gamma, n."""
    ok = in_bins(df.where(F.col(dx).isNotNull() & F.col(dy).isNotNull()), level, bins)
    return ok.groupBy(*keys, "bin").agg(F.avg(level).alias("level"), ratio(F.sum(F.col(dx) * F.col(dy)), F.sum(F.col(dx) * F.col(dx))).alias("gamma"), F.count("*").alias("n"))


def apply_curve(df: DataFrame, points: Sequence[tuple[float, float]], level: str, out: str = "gamma", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Piecewise-linear interpolation between the points of a curve (a row for each bin), flat outside, clipped."""
    points = sorted(points)
    x = F.col(level)
    value = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points[:-1], points[1:], strict=True))):
        value = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(value)
    value = F.when(x <= points[0][0], points[0][1]).otherwise(value)
    return df.withColumn(out, F.when(x.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high))))


def bootstrap_band(df: DataFrame, key: str, dx: str, dy: str, draws: int = 200, alpha: float = 0.1, row: Sequence[str] = ()) -> DataFrame:
    """Band of the slope per key from Poisson(1) weights drawn by a hash of the row and the replicate: low, high.

    Rows are first summed within 64 hashed groups per key, so replicates multiply groups and not rows."""
    cell = F.pmod(F.xxhash64(*row), F.lit(64))
    sums = df.groupBy(key, cell.alias("_cell")).agg(F.sum(F.col(dx) * F.col(dy)).alias("_xy"), F.sum(F.col(dx) * F.col(dx)).alias("_xx"))
    each = sums.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(key, "_cell", "_draw"), F.lit(1 << 40)) / float(1 << 40)
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        weight = weight + F.when(u >= total, 1).otherwise(0)
        term /= k + 1
    gamma = ratio(F.sum(weight * F.col("_xy")), F.sum(weight * F.col("_xx")))
    return each.groupBy(key, "_draw").agg(gamma.alias("g")).groupBy(key).agg(F.percentile("g", alpha / 2).alias("low"), F.percentile("g", 1 - alpha / 2).alias("high"))
