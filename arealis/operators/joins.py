"""Joins that a panel needs: as-of, interval, cascade, override and crosswalk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """left with, for each column, the last non-null value of right at or before left's time (strictly before, if strict).

    Both sides are united and read in one window per key, so all columns travel together and no pair of rows is ever
    formed. Rows of left with a null key or time get nulls."""
    a = left.withColumns({"_row": F.struct(*left.columns), "_time": F.col(left_time), "_event": F.lit(1)}).select(*keys, "_row", "_time", "_event", *[F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in columns])
    b = right.where(F.col(right_time).isNotNull()).select(*keys, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(right_time).alias("_time"), F.lit(0).alias("_event"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    tie = F.lit(0) - F.col("_event") if strict else F.col("_event")
    w = Window.partitionBy(*keys).orderBy("_time", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("_time").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    both = a.unionByName(b).withColumns({f"_v_{c}": F.when(known, F.last(f"_r_{c}", ignorenulls=True).over(w)) for c in columns})
    return both.where("_event = 1").select("_row.*", *[F.col(f"_v_{c}").alias(c) for c in columns])


def rare_to_unknown(df: DataFrame, keys: Sequence[str], name: str, least: int, unknown: str = "unknown") -> DataFrame:
    """The name as text, `unknown` where its keys have fewer rows than `least`. Rows with null keys form groups of their own and stay.

    Rows are counted in part and the counts joined back, so that no window holds a frequent key."""
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_rows"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = df.join(counts, same)
    return joined.withColumn(name, F.when(F.col("_rows") < least, unknown).otherwise(F.col(name).cast("string"))).drop("_rows", *[f"_{k}" for k in keys])


def interval(left: DataFrame, events: DataFrame, time: str, at: str, days: int, most_events: int = 100_000) -> DataFrame:
    """Rows of left that lie in the `days` days up to and including an event's date, once for each such event.

    Each event is dealt to the days it covers, and rows meet it by day: an equi-join whatever the number of events."""
    day = F.to_date(F.col(time))
    dealt = events.withColumn("_day", F.explode(F.sequence(F.date_sub(F.to_date(at), days), F.to_date(at))))
    if events.count() * (days + 1) <= most_events:
        dealt = F.broadcast(dealt)
    return left.withColumn("_day", day).join(dealt, "_day").drop("_day")


def cascade(base: DataFrame, sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str], value: str, keep_missing: bool = False) -> DataFrame:
    """The first non-null value of several sources, with the source's name: value, source."""
    out, values, names = base, [], []
    for i, (name, df) in enumerate(sources):
        out = out.join(df.select(*keys, F.col(value).alias(f"_v{i}")).dropDuplicates(list(keys)), list(keys), "left")
        values.append(F.col(f"_v{i}"))
        names.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(name)))
    out = out.withColumns({value: F.coalesce(*values), "source": F.coalesce(*names)}).drop(*[f"_v{i}" for i in range(len(sources))])
    return out if keep_missing else out.where(F.col(value).isNotNull())


def override(fine: DataFrame, coarse: DataFrame, fine_key: str, parent_key: str, value: str) -> DataFrame:
    """The finer value where present, else the parent's, and whether it is the finer one: value, is_fine."""
    parent = coarse.select(parent_key, F.col(value).alias("_parent"))
    out = fine.join(parent, parent_key, "left")
    return out.select(fine_key, parent_key, F.coalesce(value, "_parent").alias(value), F.col(value).isNotNull().alias("is_fine"))


def crosswalk(values: DataFrame, weights: DataFrame, source: str, target: str, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of source values per target and key, in one pass over all keys."""
    joined = values.join(weights.select(source, target, weight), source).where(F.col(value).isNotNull())
    total = F.sum(weight)
    return joined.groupBy(target, *keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(total, F.lit(0.0))).alias(value))


def rule_chain(column: Column, rules: Sequence[tuple[str, dict[str, str] | Sequence[tuple[str, str]]]], otherwise: str) -> Column:
    """The first matching rule decides. Kinds: `exact` (value to result), `prefix` and `substring` (pattern, result) in order."""
    tried = []
    for kind, table in rules:
        if kind == "exact":
            pairs = [x for k, v in dict(table).items() for x in (F.lit(k), F.lit(v))]
            tried.append(F.try_element_at(F.create_map(*pairs), column))
        else:
            found = F.lit(None).cast("string")
            for pattern, result in reversed(list(table.items() if isinstance(table, dict) else table)):
                fits = column.startswith(pattern) if kind == "prefix" else column.contains(pattern)
                found = F.when(fits, F.lit(result)).otherwise(found)
            tried.append(found)
    return F.coalesce(*tried, F.lit(otherwise))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
