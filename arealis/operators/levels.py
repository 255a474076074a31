"""Rules that guess a series' next level from its history, judged with each event left out in turn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.operators.panel import ratio

#: The rules, in the order in which ties are settled.
RULES = ("gap", "last_same", "same_mean", "mean", "last")


def _line(n: Column, x: Column, y: Column, xx: Column, xy: Column, at: Column) -> Column:
    """The least-squares line of some sums at a place; their mean where x has no spread; null without rows."""
    slope = F.coalesce(F.when(F.abs(n * xx - x * x) > 1e-9, ratio(n * xy - x * y, n * xx - x * x)), F.lit(0.0))
    return ratio(y - slope * x, n) + slope * at


def left_out_levels(df: DataFrame, series: str, kind: str, when: str, level: str) -> DataFrame:
    """Each event with its level as each rule guesses it without the event: columns of RULES. gap: a line of the level on the time
    since the event before, over the series' other events; last_same and last: the level before, of the same kind or any;
    same_mean and mean: the mean of the other events, of the same kind or all. Windows hold a series: its events."""
    every, same = Window.partitionBy(series), Window.partitionBy(series, kind)
    rows = df.withColumn("_gap", F.col(when) - F.lag(when).over(every.orderBy(when, kind)))
    x, y, has = F.col("_gap"), F.col(level), F.col("_gap").isNotNull()
    rest = lambda c: F.sum(F.when(has, c)).over(every) - c
    one = F.lit(1.0)
    gap = F.when(has, _line(rest(one), rest(x), rest(y), rest(x * x), rest(x * y), x))
    others = lambda w: ratio(F.sum(y).over(w) - y, F.count(y).over(w) - 1)
    guesses = {"gap": gap, "last_same": F.lag(level).over(same.orderBy(when)), "same_mean": others(same), "mean": others(every), "last": F.lag(level).over(every.orderBy(when, kind))}
    return rows.withColumns(guesses)


def choose_rule(df: DataFrame, series: str, kind: str, when: str, level: str, target_when: float, target_kind: str, surveys: DataFrame | None = None) -> DataFrame:
    """series, rmse_<rule> for each of RULES, best, predicted: the rule with the least left-out error and its guess for an event of
    target_kind at target_when. A series with a level in `surveys` (series, survey) takes that, as rule `survey`."""
    rows = left_out_levels(df, series, kind, when, level)
    y, x, is_kind = F.col(level), F.col("_gap"), F.col(kind) == target_kind
    has = x.isNotNull()
    total = lambda c: F.sum(F.when(has, c))
    ahead = F.lit(float(target_when)) - F.max(when)
    mean = F.avg(y)
    guess = {
        "gap": F.coalesce(_line(total(F.lit(1.0)), total(x), total(y), total(x * x), total(x * y), ahead), mean),
        "last_same": F.coalesce(F.max_by(level, F.when(is_kind, F.col(when))), mean),
        "same_mean": F.coalesce(F.avg(F.when(is_kind, y)), mean),
        "mean": mean,
        "last": F.max_by(level, F.struct(when, kind)),
    }
    found = rows.groupBy(series).agg(*[F.sqrt(F.avg((y - F.col(r)) ** 2)).alias(f"rmse_{r}") for r in RULES], *[g.alias(f"_{r}") for r, g in guess.items()])
    options: Sequence[Column] = [F.struct(F.round(f"rmse_{r}", 9).alias("e"), F.lit(i).alias("i"), F.lit(r).alias("rule"), F.col(f"_{r}").alias("value")) for i, r in enumerate(RULES)]
    found = found.withColumn("_best", F.array_min(F.filter(F.array(*options), lambda o: o["e"].isNotNull())))
    best, value = F.col("_best.rule"), F.col("_best.value")
    if surveys is not None:
        found = found.join(surveys.select(series, "survey"), series, "left")
        best, value = F.when(F.col("survey").isNotNull(), "survey").otherwise(best), F.coalesce("survey", value)
    return found.select(series, *[f"rmse_{r}" for r in RULES], best.alias("best"), value.alias("predicted"))
