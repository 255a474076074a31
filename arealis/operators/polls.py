"""Survey readings: shares, averages, house effects and recency weighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.operators.panel import ratio


def shares(df: DataFrame, reading: Sequence[str], block: str, value: str, blocks: int | None = None) -> DataFrame:
    """Percentages of a reading's blocks; readings without all of `blocks` blocks are left out."""
    sums = df.groupBy(*reading, block).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*reading)
    out = sums.withColumns({"share": ratio(F.col("_v"), F.sum("_v").over(w), 100.0), "_k": F.count("*").over(w)})
    return (out.where(F.col("_k") == blocks) if blocks else out).drop("_v", "_k")


def average(df: DataFrame, event: Sequence[str], institute: str, block: str) -> DataFrame:
    """Mean over institutes of each institute's mean."""
    return df.groupBy(*event, institute, block).agg(F.avg("share").alias("share")).groupBy(*event, block).agg(F.avg("share").alias("share"))


def house_effects(df: DataFrame, truth: DataFrame, on: Sequence[str], institute: str, block: str, prior: float = 2.0, without: str | None = None) -> DataFrame:
    """Mean bias of an institute per block, shrunk by n / (n + prior). `without`: an event column; each event then gets effects that don't use it."""
    bias = df.join(truth, list(on)).withColumn("_b", F.col("share") - F.col("truth"))
    if without is None:
        n = F.count("*")
        return bias.groupBy(institute, block).agg(n.alias("n"), (F.avg("_b") * n / (n + prior)).alias("effect"))
    own = bias.groupBy(institute, block, without).agg(F.sum("_b").alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy(institute, block)
    n, s = F.sum("_n").over(w) - F.col("_n"), F.sum("_s").over(w) - F.col("_s")
    return own.select(institute, block, without, n.alias("n"), F.when(n > 0, s / (n + prior)).otherwise(0.0).alias("effect"))


def recent(df: DataFrame, event: str, day: str, block: str, rate: float) -> DataFrame:
    """Mean weighted by exp(-rate * days before the event), with each event's blocks brought to 100."""
    weight = F.exp(-rate * F.datediff(event, day))
    level = df.groupBy(event, block).agg(ratio(F.sum(weight * F.col("share")), F.sum(weight)).alias("_s"))
    return level.select(event, block, ratio(F.col("_s"), F.sum("_s").over(Window.partitionBy(event)), 100.0).alias("share"))


def rate_errors(df: DataFrame, truth: DataFrame, event: str, day: str, block: str, rates: Sequence[float]) -> DataFrame:
    """Root mean squared error of the weighted level for each decay rate, all in one pass over the readings."""
    grid = F.explode(F.array(*[F.lit(float(r)) for r in rates]))
    daily = df.groupBy(event, block, day).agg(F.sum("share").alias("_s"), F.count("*").alias("_n")).withColumn("rate", grid)
    weight = F.exp(-F.col("rate") * F.datediff(event, day))
    level = daily.groupBy("rate", event, block).agg(ratio(F.sum(weight * F.col("_s")), F.sum(weight * F.col("_n"))).alias("_e"))
    return level.join(truth, [event, block]).groupBy("rate").agg(F.sqrt(F.avg((F.col("_e") - F.col("truth")) ** 2)).alias("rmse"))
