"""Queries of composed runs: training tables per set of event kinds, interval runs, boosted slopes and calibrations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from arealis.operators import intervals as I  # noqa: E741
from arealis.operators import linear as L
from arealis.operators import panel as P
from arealis.operators import slopes as S
from arealis.plans.catalog import Tables, query, rounded
from arealis.plans.model_queries import RES, STEP, moves, residuals
from arealis.plans.ridge_sql import solved

TYPED = """typed AS (SELECT CAST(c_nationkey AS BIGINT) AS unit, o_orderpriority AS kind, CAST(year(o_orderdate) AS BIGINT) AS event, 100 * sum(l_quantity) FILTER (l_returnflag = 'N') / sum(l_quantity) AS share, 100 * sum(l_quantity) FILTER (l_linestatus = 'F') / sum(l_quantity) AS rate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def typed(t: Tables):
    """unit (nation), kind (order priority), event (year), share of the block N, rate of lines with status F."""
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").cast("long").alias("event"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    part = lambda c: P.ratio(F.sum(F.when(c, F.col("l_quantity"))), F.sum("l_quantity"), 100.0)
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("unit"), F.col("o_orderpriority").alias("kind"), "event").agg(part(F.col("l_returnflag") == "N").alias("share"), part(F.col("l_linestatus") == "F").alias("rate"))


def lagged_sql(kinds: str) -> str:
    return f"s AS (SELECT *, share - avg(share) OVER (PARTITION BY kind, event) AS dev FROM typed WHERE kind IN ({kinds})), l AS (SELECT *, lag(share) OVER w AS share_lag1, lag(share, 2) OVER w AS share_lag2, lag(dev) OVER w AS dev_lag1, lag(dev, 2) OVER w AS dev_lag2 FROM s WINDOW w AS (PARTITION BY unit ORDER BY event, kind))"


ROUND = "unit, kind, event, round(dev, 5) AS dev, round(share_lag1, 5) AS share_lag1, round(share_lag2, 5) AS share_lag2, round(dev_lag1, 5) AS dev_lag1, round(dev_lag2, 5) AS dev_lag2"


@query("ml_condition_rows", f"WITH {TYPED}, {lagged_sql(chr(39) + '1-URGENT' + chr(39) + ', ' + chr(39) + '2-HIGH' + chr(39))} SELECT {ROUND}, round(rate, 5) AS rate FROM l WHERE rate IS NOT NULL AND share_lag1 IS NOT NULL AND share_lag2 IS NOT NULL AND dev_lag1 IS NOT NULL AND dev_lag2 IS NOT NULL AND (event <> 2000 OR kind <> '1-URGENT' OR unit % 2 = 0)")
def ml_condition_rows(spark, d):
    """Two kinds of events; complete rows; of the validation event only the units that another condition also has."""
    t = typed(Tables(spark, d))
    rows = P.condition_rows(t, ["1-URGENT", "2-HIGH"], "kind", "unit", ["event", "kind"], ["share"], ["rate"])
    held = rows.where("event = 2000 and kind = '1-URGENT' and unit % 2 = 0").select("unit").distinct()
    kept = P.restrict_rows(rows, (F.col("event") == 2000) & (F.col("kind") == "1-URGENT"), held, "unit")
    return rounded(kept.select("unit", "kind", "event", "dev_share", "share_lag1", "share_lag2", "dev_share_lag1", "dev_share_lag2", "rate").withColumnsRenamed({"dev_share": "dev", "dev_share_lag1": "dev_lag1", "dev_share_lag2": "dev_lag2"}), 5)


@query("ml_extended_training", f"WITH {TYPED}, {lagged_sql('SELECT DISTINCT kind FROM typed')} SELECT {ROUND}, CASE WHEN kind = '1-URGENT' THEN 1.0 ELSE 0.5 END AS weight FROM l WHERE share_lag1 IS NOT NULL AND share_lag2 IS NOT NULL AND dev_lag1 IS NOT NULL AND dev_lag2 IS NOT NULL")
def ml_extended_training(spark, d):
    """The training table over all kinds of events, other kinds than the target's at half weight."""
    t = typed(Tables(spark, d))
    kinds = [r.kind for r in t.select("kind").distinct().collect()]  # a handful
    rows = P.condition_rows(t, kinds, "kind", "unit", ["event", "kind"], ["share"], [])
    rows = rows.withColumn("weight", F.when(F.col("kind") == "1-URGENT", 1.0).otherwise(0.5))
    return rounded(rows.select("unit", "kind", "event", "dev_share", "share_lag1", "share_lag2", "dev_share_lag1", "dev_share_lag2", "weight").withColumnsRenamed({"dev_share": "dev", "dev_share_lag1": "dev_lag1", "dev_share_lag2": "dev_lag2"}), 5)


def design_sql(name: str, where: str, part: str) -> str:
    return f"SELECT * FROM (SELECT '{name}' AS design, unit, kind, event, dev, lag(share) OVER w AS s1, lag(dev) OVER w AS d1 FROM (SELECT *, share - avg(share) OVER (PARTITION BY kind, event) AS dev FROM typed {where}) WINDOW w AS (PARTITION BY {part} ORDER BY event, kind)) WHERE s1 IS NOT NULL AND d1 IS NOT NULL AND dev IS NOT NULL"


DESIGNS = f"""WITH RECURSIVE {TYPED}, d AS ({design_sql("own", "WHERE kind = '1-URGENT'", "unit")} UNION ALL {design_sql("all", "", "unit")} UNION ALL {design_sql("isolated", "", "unit, kind")}),
g AS (SELECT design AS key, i, j, sum(z[i] * z[j]) AS g FROM (SELECT design, [1.0, s1, d1, dev] AS z FROM d WHERE event < 2000), unnest(range(1, 5)) AS a(i), unnest(range(1, 5)) AS b(j) GROUP BY 1, 2, 3), {solved("g", "f", 2, 1.0)},
h AS (SELECT * FROM d WHERE event >= 2000 AND kind = '1-URGENT'), c AS (SELECT unit, event FROM h GROUP BY 1, 2 HAVING count(*) = 3),
p AS (SELECT design, dev AS y, intercept + list_dot_product(beta, [s1, d1]) AS p FROM h JOIN c USING (unit, event) JOIN f ON key = design) SELECT design, count(*) AS n, round(1 - avg((y - p) ** 2) / var_pop(y), 5) AS r2, round(sqrt(avg((y - p) ** 2)), 5) AS rmse FROM p GROUP BY 1"""


@query("ml_design_compare", DESIGNS)
def ml_design_compare(spark, d):
    """Three designs of the training rows, scored on the same later rows of one kind: that kind's rows alone; rows and lags of all
    kinds; rows of all kinds with lags that stay within a kind. One scan gives the Grams of all designs."""
    t = typed(Tables(spark, d)).withColumn("series", F.concat_ws("|", "unit", "kind"))
    kinds = [r.kind for r in t.select("kind").distinct().collect()]  # a handful
    designs = {"own": (["1-URGENT"], "unit"), "all": (kinds, "unit"), "isolated": (kinds, "series")}
    rows = None
    for name, (some, series) in designs.items():
        one = P.condition_rows(t, some, "kind", series, ["event", "kind"], ["share"], [], depth=1).where("dev_share is not null").select(F.lit(name).alias("design"), "unit", "kind", "event", "dev_share", "share_lag1", "dev_share_lag1")
        rows = one if rows is None else rows.unionByName(one)
    features = ["share_lag1", "dev_share_lag1"]
    fits = L.group_fits(L.gram_entries(rows.where("event < 2000"), features, "dev_share", ["design"]), features, ["design"], 1.0)
    held = rows.where("event >= 2000 and kind = '1-URGENT'")
    common = held.groupBy("unit", "event").agg(F.count("*").alias("_n")).where(F.col("_n") == len(designs)).select("unit", "event")
    scored = held.join(common, ["unit", "event"], "left_semi").join(fits, "design").withColumn("p", L.projected(features))
    return rounded(L.metrics(scored, "dev_share", "p", ["design"]).select("design", "n", "r2", "rmse"), 5)


CALIBRATED = """x AS (SELECT parent, unit, event, p AS a, CAST(event % 2 AS DOUBLE) AS b, A AS y FROM step WHERE p IS NOT NULL), g AS (SELECT *, count(*) OVER w - 1 AS n, sum(a) OVER w - a AS sa, sum(b) OVER w - b AS sb, sum(y) OVER w - y AS sy, sum(a * a) OVER w - a * a AS saa, sum(b * b) OVER w - b * b AS sbb, sum(a * b) OVER w - a * b AS sab, sum(a * y) OVER w - a * y AS say, sum(b * y) OVER w - b * y AS sby FROM x WINDOW w AS (PARTITION BY parent)),
c AS (SELECT *, saa - sa * sa / n AS aa, sbb - sb * sb / n AS bb, sab - sa * sb / n AS ab, say - sa * sy / n AS ay, sby - sb * sy / n AS by_ FROM g)"""


@query("st_intention_calibration", f"WITH {STEP}, {CALIBRATED} SELECT unit, event, round(y, 4) AS y, round(sy / n + (ay * bb - by_ * ab) / (aa * bb - ab * ab) * (a - sa / n) + (by_ * aa - ay * ab) / (aa * bb - ab * ab) * (b - sb / n), 4) AS left_out FROM c")
def st_intention_calibration(spark, d):
    """A level on a stated level and the instrument that took it, each row predicted by the others of its area."""
    m = moves(Tables(spark, d)).where("p is not null").withColumn("instrument", (F.col("event") % 2).cast("double"))
    return rounded(S.left_out_pair(m, ["parent"], "p", "instrument", "A").select("unit", "event", F.col("A").alias("y"), "left_out"), 4)


METHODS = f"""WITH {RES}, ed AS (SELECT list_distinct([quantile_cont(size, 0.2), quantile_cont(size, 0.4), quantile_cont(size, 0.6), quantile_cont(size, 0.8)]) AS edges FROM res WHERE event <= 1998),
x AS (SELECT event, A, weight, unnest(['standard', 'territory', 'adaptive', 'masked']) AS method, unnest(['all', CAST(parent AS VARCHAR), CAST(len(list_filter(edges, lambda e: e < size)) AS VARCHAR), 'all']) AS class, unnest([p, p, p, CASE WHEN unit % 5 <> 1 THEN p ELSE 0 END]) AS c FROM res, ed),
al AS (SELECT unnest([0.2, 0.1, 0.05]::DOUBLE[]) AS alpha), o AS (SELECT method, class, abs(A - c) AS r, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY method, class) AS n FROM x WHERE event <= 1998 WINDOW w AS (PARTITION BY method, class ORDER BY abs(A - c))),
h AS (SELECT o.*, alpha, least(1.0, (1 - alpha) * (1 + 1.0 / CASE WHEN method = 'adaptive' THEN (SELECT count(*) FROM res WHERE event <= 1998) ELSE n END)) * (n - 1) AS t FROM o, al),
q AS (SELECT method, class, alpha, any_value(n) AS n, max(r) FILTER (k = floor(t)) + (max(r) FILTER (k = ceil(t)) - max(r) FILTER (k = floor(t))) * (any_value(t) - floor(any_value(t))) AS w FROM h GROUP BY 1, 2, 3),
b AS (SELECT x.method, x.class, s.alpha, A, weight, greatest(0, c - coalesce(q.w, s.w)) AS low, least(100, c + coalesce(q.w, s.w)) AS high FROM x JOIN q s ON s.method = 'standard' LEFT JOIN q ON q.method = x.method AND q.class = x.class AND q.alpha = s.alpha AND (q.method <> 'territory' OR q.n >= 10) WHERE event > 1998)
SELECT method, alpha, class, count(*) AS n, round(avg(CASE WHEN A >= low AND A <= high THEN 1.0 ELSE 0.0 END), 5) AS coverage, round(sum(CASE WHEN A >= low AND A <= high THEN weight ELSE 0 END) / sum(weight), 5) AS weighted, round(avg(high - low), 5) AS width, round(median(high - low), 5) AS median_width FROM b GROUP BY 1, 2, 3"""


@query("cf_run_block", METHODS)
def cf_run_block(spark, d):
    """One block's run: widths from the earlier events by four methods, for each class and level; coverage and widths on the later ones."""
    r = residuals(Tables(spark, d)).withColumn("present", F.col("unit") % 5 != 1)
    return rounded(I.run_methods(r, "A", "p", F.col("event") <= 1998, [0.2, 0.1, 0.05], "weight", "parent", "size", "present", least=10), 5)


def changes(t: Tables, n: int):
    """Changes of the first n embedding components from each label's previous row."""
    e = F.col("embedding")
    rows = t.embeddings.select("vec_id", "label", *[e[i].cast("double").alias(f"x{i}") for i in range(n)])
    lagged = P.lag_across(rows, ["label"], ["vec_id"], [f"x{i}" for i in range(n)])
    return lagged.select("vec_id", "label", *[(F.col(f"x{i}") - F.col(f"x{i}_lag")).alias(f"d{i}") for i in range(n)])


@query("ml_delta_pca")
def ml_delta_pca(spark, d):
    """Principal components of the changes of all 64 embedding components along each label's rows: component, share of variance."""
    shares = L.component_shares(L.grams(changes(Tables(spark, d), 64), [f"d{i}" for i in range(64)], []).total, 5)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "component int, share double")


DELTAS = """b AS (SELECT embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
p AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(embedding[i + 1] AS DOUBLE) - CAST(before[i + 1] AS DOUBLE) AS a, CAST(embedding[j + 1] AS DOUBLE) - CAST(before[j + 1] AS DOUBLE) AS b FROM b, unnest(range(64)) AS x(i), unnest(range(64)) AS y(j) WHERE i <= j AND before IS NOT NULL)"""


@query("ml_delta_covariance", f"WITH {DELTAS} SELECT i, j, count(*) AS n, round(covar_pop(a, b), 6) AS covariance FROM p GROUP BY 1, 2")
def ml_delta_covariance(spark, d):
    """What the components come from: the covariance of every two changes, and over how many rows."""
    g = L.grams(changes(Tables(spark, d), 64), [f"d{i}" for i in range(64)], []).total
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    return spark.createDataFrame([(i, j, int(n), round(float(cov[i, j]), 6) + 0.0) for i in range(64) for j in range(i, 64)], "i int, j int, n long, covariance double")


#: Rounds at most. A round is three small jobs, so a few hundred take a minute on small tables.
ROUNDS = 100


@query("ml_boosted_slopes")
def ml_boosted_slopes(spark, d):
    """Response slopes by boosted trees of three capacities, and by a curve over the level with boosted trees on what it leaves over;
    learnt on earlier events with early stopping, scored on later ones: error of the change. All models grow together."""
    from arealis.operators import backtests as B
    from arealis.operators import trees as T
    from arealis.sources.io import stored

    m = moves(Tables(spark, d)).where("dx is not null and abs(dx) > 0.01")
    m = stored(m.select("unit", "event", "p", "weight", "dx", "dy", (F.col("dy") / F.col("dx")).alias("slope"), (F.col("dx") ** 2).alias("w"), F.lit(0).alias("all")), "moves")
    early = F.col("event") <= 1999
    judges = F.pmod(F.xxhash64("unit", "event"), F.lit(100)) < 15
    curve = B.curves(B.level_cells(m.where(early), "all", "p", "dx", "dy", 1.0), "all", 20)
    flat = m.where(early).groupBy("all").agg(P.ratio(F.sum(F.col("dx") * F.col("dy")), F.sum(F.col("dx") ** 2)).alias("flat"))
    rows = stored(m.join(F.broadcast(curve.join(flat, "all")), "all", "left").withColumn("curve", B.interpolated("points", F.col("p"))).drop("points"), "moves")  # one row
    model = lambda name, offset=None, **more: T.Model(name, early & ~judges, early & judges, offset, **more)
    models = [model("medium", depth=3, rounds=ROUNDS, step=0.05, leaf=0.0015, l2=1.0), model("strong", depth=2, rounds=ROUNDS, step=0.03, leaf=0.015, l2=10.0), model("strongest", depth=2, rounds=ROUNDS, step=0.02, leaf=0.06, l2=30.0), model("rest", F.col("curve"), depth=2, rounds=ROUNDS, step=0.02, leaf=0.04, l2=20.0)]
    done = T.boost(rows, ["p", "weight"], "slope", models, "w", ["event", "dx", "dy", "flat", "curve"]).where("event > 1999")
    guesses = {"flat": F.col("flat"), "curve": F.col("curve"), **{k: F.col(k) for k in ("medium", "strong", "strongest")}, "curve_rest": F.col("curve") + F.col("rest")}
    clipped = lambda g: F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))
    return done.agg(F.count("*").alias("n"), *[F.sqrt(F.avg((F.col("dy") - (g if k == "flat" else clipped(g)) * F.col("dx")) ** 2)).alias(k) for k, g in guesses.items()])
