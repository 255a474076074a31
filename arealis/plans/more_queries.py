"""Further queries: level rules, masks over a grid, kernel features, slope checks, feature sets and the remaining scalars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from arealis.functions import text as X
from arealis.operators import intervals as I  # noqa: E741
from arealis.operators import joins as J
from arealis.operators import linear as L
from arealis.operators import panel as P
from arealis.operators import polls as S
from arealis.operators import slopes as R
from arealis.plans.catalog import PANEL, Tables, query, rounded
from arealis.plans.join_queries import SURVEY, TRUTH, surveys
from arealis.plans.model_queries import RES, STEP, WIDTH, features, moves, quantile_sql, residuals
from arealis.plans.ridge_sql import METRICS, models


@query("st_gap_model_loo", f"WITH {PANEL}, s AS (SELECT unit, event, A, event - 1998.0 AS x FROM panel), t AS (SELECT *, count(*) OVER u - 1 AS n, sum(x) OVER u - x AS sx, sum(A) OVER u - A AS sy, sum(x * x) OVER u - x * x AS sxx, sum(x * A) OVER u - x * A AS sxy FROM s WINDOW u AS (PARTITION BY unit)), b AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM t) SELECT unit, event, round((sy - slope * sx) / n + slope * x, 5) AS loo FROM b WHERE n >= 2")
def st_gap_model_loo(spark, d):
    """A line over time per unit, fitted without each row in turn, from delete-one sums."""
    u = Window.partitionBy("unit")
    s = Tables(spark, d).panel().select("unit", "event", "A", (F.col("event") - F.lit(1998.0)).alias("x"))
    rest = lambda c: F.sum(c).over(u) - c
    x, y = F.col("x"), F.col("A")
    t = s.select("unit", "event", "x", (F.count("*").over(u) - 1).alias("n"), rest(x).alias("sx"), rest(y).alias("sy"), rest(x * x).alias("sxx"), rest(x * y).alias("sxy"))
    t = t.where("n >= 2").withColumn("slope", P.ratio(F.expr("n * sxy - sx * sy"), F.expr("n * sxx - sx * sx")))
    return rounded(t.select("unit", "event", F.expr("(sy - slope * sx) / n + slope * x").alias("loo")), 5)


FLOORS = f"""WITH {PANEL}, m AS (SELECT *, A - avg(A) OVER (PARTITION BY event) AS dev, avg(A) OVER (PARTITION BY event) AS mean FROM panel), k AS (SELECT event, lag(mean) OVER (ORDER BY event) AS anchor FROM (SELECT event, any_value(mean) AS mean FROM m GROUP BY 1)),
x AS (SELECT unit, event, A, weight, lag(A) OVER u AS before, min(A) OVER (PARTITION BY unit) AS every, min(A) OVER p AS past, min(A) OVER (PARTITION BY unit ORDER BY event ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS recent, anchor + min(dev) OVER p AS level
FROM m JOIN k USING (event) WINDOW u AS (PARTITION BY unit ORDER BY event), p AS (PARTITION BY unit ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT event, A, weight, before, unnest(['every', 'past', 'recent', 'level']) AS floor, unnest([every, past, recent, level]) AS f FROM x WHERE past IS NOT NULL), g AS (SELECT *, greatest(before - least(f, before), 0) AS room, greatest(before - A, 0) AS real FROM f)
SELECT event, floor, count(*) AS n, round(100 * avg(CASE WHEN abs(A - f) <= 1e-9 THEN 1.0 ELSE 0.0 END), 5) AS leak, round(min(f), 5) AS lowest, round(avg(room), 5) AS room, round(max(room), 5) AS largest, round(sum(room * weight) / 100, 3) AS stock, round(CASE WHEN var_pop(room) > 1e-12 AND var_pop(real) > 1e-12 THEN corr(room, real) END, 4) AS r FROM g GROUP BY 1, 2"""


@query("st_floor_sensitivity", FLOORS)
def st_floor_sensitivity(spark, d):
    """Four floors of a unit's level: of all events, of past ones, of the last two, and of past deviations on the level known before.
    For each event: how often the target itself is the floor, the room down to it, and how well that foretells the fall."""
    m = P.deviations(Tables(spark, d).panel(), ["event"], ["A"])
    means = m.groupBy("event").agg(F.avg("A").alias("mean"))
    anchor = means.select("event", F.lag("mean").over(Window.orderBy("event")).alias("anchor"))  # a row for each event
    w = Window.partitionBy("unit").orderBy("event")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    floors = {"every": F.min("A").over(Window.partitionBy("unit")), "past": F.min("A").over(past), "recent": F.min("A").over(w.rowsBetween(-2, -1)), "level": F.col("anchor") + F.min("dev_A").over(past)}
    x = m.join(anchor, "event").select("event", "A", "weight", F.lag("A").over(w).alias("before"), *[c.alias(k) for k, c in floors.items()]).where("past is not null")
    long = x.unpivot(["event", "A", "weight", "before"], list(floors), "floor", "f")
    long = long.withColumns({"room": F.greatest(F.col("before") - F.least("f", "before"), F.lit(0.0)), "real": F.greatest(F.col("before") - F.col("A"), F.lit(0.0))})
    r = F.when((F.var_pop("room") > 1e-12) & (F.var_pop("real") > 1e-12), P.ratio(F.covar_pop("room", "real"), F.sqrt(F.var_pop("room") * F.var_pop("real"))))
    found = long.groupBy("event", "floor").agg(F.count("*").alias("n"), (100 * F.avg(F.when(F.abs(F.col("A") - F.col("f")) <= 1e-9, 1.0).otherwise(0.0))).alias("leak"), F.min("f").alias("lowest"), F.avg("room").alias("room"), F.max("room").alias("largest"), (F.sum(F.col("room") * F.col("weight")) / 100).alias("stock"), r.alias("r"))
    return found.withColumns({c: F.round(c, k) + F.lit(0.0) for c, k in (("leak", 5), ("lowest", 5), ("room", 5), ("largest", 5), ("stock", 3), ("r", 4))})


RATES = [0.0, 0.25, 0.5, 0.75, 1.0]


@query("cf_mask_sweep", f"WITH {STEP}, s AS (SELECT event, A, p, unit % 5 <> 1 AS has FROM step WHERE p IS NOT NULL), g AS (SELECT unnest(CAST({RATES} AS DOUBLE[])) AS rate), m AS (SELECT rate, A, CASE WHEN has THEN p ELSE p + rate * (100 - p) END AS q FROM s, g) SELECT rate, round(sqrt(avg((A - q) * (A - q))), 5) AS rmse FROM m GROUP BY 1")
def cf_mask_sweep(spark, d):
    """Error of the previous share where the others are off the slate at some units and a growing part of their mass moves over."""
    s = moves(Tables(spark, d)).where("p is not null").select("A", "p", (100 - F.col("p")).alias("rest"), F.lit(True).alias("stays"), (F.col("unit") % 5 != 1).alias("has"))
    grid = s.withColumns({"rate": F.explode(F.array(*[F.lit(r) for r in RATES])), "q": F.col("p")})
    m = I.masked(grid, {"q": "stays", "rest": "has"}, F.col("rate"))
    return rounded(m.groupBy("rate").agg(F.sqrt(F.avg((F.col("A") - F.col("q")) ** 2)).alias("rmse")), 5)


@query("cf_realistic_calibration", f"WITH {RES}, pair AS (SELECT 'known level' AS level, r - avg(r) OVER (PARTITION BY event) AS r FROM res UNION ALL SELECT 'last level', r FROM res), {quantile_sql('pair', 'level, ', 'PARTITION BY level')} SELECT level, count(*) AS n_calibration, round({WIDTH}, 5) AS half_width FROM h GROUP BY 1")
def cf_realistic_calibration(spark, d):
    """Half widths where each event's level is known, and where it is the last one."""
    r = residuals(Tables(spark, d))
    known = P.with_means(r, ["event"], {"_mean": "r"}).select(F.lit("known level").alias("level"), (F.col("r") - F.col("_mean")).alias("r"))
    return rounded(I.half_widths(known.unionByName(r.select(F.lit("last level").alias("level"), "r")), "r", 0.1, ["level"]), 5)


@query("st_gamma_slope", f"WITH {STEP} SELECT parent, round(regr_slope(dy / dx, p), 4) AS slope FROM move WHERE abs(dx) > 0.05 GROUP BY 1")
def st_gamma_slope(spark, d):
    """A straight line through the responses over the level, per parent."""
    m = moves(Tables(spark, d)).where("abs(dx) > 0.05").withColumn("gamma", F.col("dy") / F.col("dx"))
    return rounded(R.ols(m, ["parent"], "p", "gamma").select("parent", "slope"), 4)


@query("st_gamma_per_unit", f"WITH {STEP}, u AS (SELECT unit, parent, sum(dx * dy) / sum(dx * dx) AS g, count(*) AS n FROM move WHERE dx IS NOT NULL GROUP BY 1, 2), c AS (SELECT parent, sum(dx * dy) / sum(dx * dx) AS base FROM move WHERE dx IS NOT NULL GROUP BY 1) SELECT unit, round(base + (g - base) * n / (n + 4), 5) AS gamma FROM u JOIN c USING (parent)")
def st_gamma_per_unit(spark, d):
    """Each unit's own response, drawn to its parent's by n / (n + 4)."""
    m = moves(Tables(spark, d)).where("dx is not null")
    g = P.ratio(F.sum(F.col("dx") * F.col("dy")), F.sum(F.col("dx") ** 2))
    own, base = m.groupBy("unit", "parent").agg(g.alias("g"), F.count("*").alias("n")), m.groupBy("parent").agg(g.alias("base"))
    return rounded(own.join(base, "parent").select("unit", F.expr("base + (g - base) * n / (n + 4)").alias("gamma")), 5)


@query("st_observed_turnout", "WITH k AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS k, avg(CASE WHEN l_linestatus = 'F' THEN 100.0 ELSE 0.0 END) AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT CAST(k AS INTEGER) AS event_key, round(rate, 6) AS rate FROM k WHERE k IN (199606, 199706, 199806)")
def st_observed_turnout(spark, d):
    t = Tables(spark, d)
    key = X.event_key(F.year("o_orderdate") + F.month("o_orderdate") / 100)
    listed = t.orders.select("o_orderkey", key.alias("event_key")).where(F.col("event_key").isin(199606, 199706, 199806))
    rows = t.lineitem.select("l_orderkey", "l_linestatus").join(listed, F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(rows.groupBy("event_key").agg(P.ratio(F.count_if(F.col("l_linestatus") == "F"), F.count("*"), 100.0).alias("rate")))


@query("st_loo_levels", f"WITH {SURVEY}, {TRUTH}, own AS (SELECT institute, block, poll_date, sum(share - truth) AS s, count(*) AS n FROM c JOIN truth USING (poll_date, block) GROUP BY 1, 2, 3), h AS (SELECT institute, block, poll_date, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s FROM own WINDOW w AS (PARTITION BY institute, block)), x AS (SELECT poll_date, block, exp(-0.1 * date_diff('day', day, poll_date)) AS w, share - CASE WHEN n > 0 THEN s / (n + 2) ELSE 0.0 END AS share FROM c JOIN h USING (institute, block, poll_date)), r AS (SELECT poll_date, block, sum(w * share) / sum(w) AS share FROM x GROUP BY 1, 2) SELECT poll_date, block, round(100 * share / sum(share) OVER (PARTITION BY poll_date), 6) AS share FROM r")
def st_loo_levels(spark, d):
    """Level per event from readings corrected by institute effects that the event itself has no part in."""
    s = surveys(Tables(spark, d))
    truth = s.groupBy("poll_date", "block").agg(F.avg("share").alias("truth"))
    effects = S.house_effects(s, truth, ["poll_date", "block"], "institute", "block", without="poll_date").select("institute", "block", "poll_date", "effect")
    fixed = s.join(effects, ["institute", "block", "poll_date"]).withColumn("share", F.col("share") - F.col("effect"))
    return rounded(S.recent(fixed, "poll_date", "day", "block", 0.1))


@query("agg_district_rollup", f"WITH {PANEL} SELECT parent, event, round(sum(A * weight) / sum(weight), 5) AS A, round(sum(N * weight) / sum(weight), 5) AS N, round(sum(R * weight) / sum(weight), 5) AS R, arg_max(unit, struct_pack(w := weight, u := unit)) AS anchor, sum(A * weight) + 3 * sum(weight) > sum(N * weight) AS flips FROM panel GROUP BY 1, 2")
def agg_district_rollup(spark, d):
    """Weighted shares per parent, its largest unit, and whether A passes N after a swing of three points."""
    mean = lambda c: P.ratio(F.sum(F.col(c) * F.col("weight")), F.sum("weight"))
    out = Tables(spark, d).panel().groupBy("parent", "event").agg(*[mean(c).alias(c) for c in "ANR"], F.max_by("unit", F.struct("weight", "unit")).alias("anchor"))
    return rounded(out.withColumn("flips", F.col("A") + 3 > F.col("N")), 5)


@query("ml_fold_table", f"WITH {PANEL} SELECT parent, event, count(*) AS n, round(avg(A), 6) AS level, round(lag(avg(A)) OVER (PARTITION BY parent ORDER BY event), 6) AS before FROM panel GROUP BY 1, 2")
def ml_fold_table(spark, d):
    """Folds with their level and the level before."""
    f = Tables(spark, d).panel().groupBy("parent", "event").agg(F.count("*").alias("n"), F.avg("A").alias("level"))
    return rounded(f.withColumn("before", F.lag("level").over(Window.partitionBy("parent").orderBy("event"))))


@query("fn_result_tokens", f"WITH {PANEL} SELECT unit, event, 'A' AS party, round(A, 6) AS value FROM panel UNION ALL SELECT unit, event, 'N', round(N, 6) FROM panel UNION ALL SELECT unit, event, 'R', round(R, 6) FROM panel")
def fn_result_tokens(spark, d):
    return rounded(Tables(spark, d).panel().unpivot(["unit", "event"], ["A", "N", "R"], "party", "value"))


@query("fn_poll_header", "SELECT p_partkey, upper(p_brand) AS header FROM part")
def fn_poll_header(spark, d):
    return Tables(spark, d).part.select("p_partkey", X.poll_header(F.concat(F.lit(" "), "p_brand", F.lit("[a]"))).alias("header"))


@query("fn_poll_value_inline", "SELECT p_partkey, p_size + 0.5 AS v FROM part")
def fn_poll_value_inline(spark, d):
    return Tables(spark, d).part.select("p_partkey", X.poll_value_inline(F.concat(F.lit("<"), F.col("p_size").cast("string"), F.lit(",5 %[b]"))).alias("v"))


@query("fn_expand_code_group", "SELECT p_partkey, unnest(CASE WHEN p_type = 'PROMO' THEN ['ECONOMY', 'PROMO'] ELSE [p_type] END) AS code FROM part")
def fn_expand_code_group(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.explode(X.expand_group(F.col("p_type"), {"PROMO": ["ECONOMY"]})).alias("code"))


def scores(spark, d, sets: dict[str, list[str]], x, names):
    """Left-out-fold scores of some feature sets from one Gram."""
    g = L.grams(x, names, ["y"], "fold")
    for name, some in sets.items():
        x = L.out_of_fold(x, g.subset(some), "fold", 0, 1.0, out=name)
    parts = [L.metrics(x, "y", name).withColumn("features", F.lit(name)) for name in sets]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 5)


SCORES = f" SELECT features, {METRICS} FROM oof GROUP BY 1"


@query("ml_feature_set_compare", models(64, {"first": "x[1:16]", "half": "x[1:32]", "all": "x"}, [1.0]) + SCORES)
def ml_feature_set_compare(spark, d):
    x, names = features(Tables(spark, d))
    return scores(spark, d, {"first": names[:16], "half": names[:32], "all": names}, x, names)


@query("ml_add_features_test", models(8, {"base": "x", "extra": "list_concat(x, list_transform(x, lambda v: v * v))"}, [1.0]) + SCORES)
def ml_add_features_test(spark, d):
    """Base features against base and squares, on the same rows."""
    x, names = features(Tables(spark, d), 8)
    more = {f"{c}_squared": F.col(c) ** 2 for c in names}
    return scores(spark, d, {"base": names, "extra": [*names, *more]}, x.withColumns(more), [*names, *more])


@query("ml_slate_features", models(8, {"base": "x", "slate": "list_concat(x, [CASE WHEN vec_id % 3 <> 0 THEN 1.0 ELSE 0.0 END, CASE WHEN vec_id % 5 <> 0 THEN 1.0 ELSE 0.0 END])"}, [1.0]) + SCORES)
def ml_slate_features(spark, d):
    """Presence flags beside the features."""
    x, names = features(Tables(spark, d), 8)
    flags = {f"has_{k}": (F.col("vec_id") % k != 0).cast("double") for k in (3, 5)}
    return scores(spark, d, {"base": names, "slate": [*names, *flags]}, x.withColumns(flags), [*names, *flags])


@query("ml_tide_interactions", models(8, {"base": "x", "tide": "list_concat(x, [tide], list_transform(x, lambda v: v * tide))"}, [1.0]) + SCORES)
def ml_tide_interactions(spark, d):
    """Features, a tide and their products."""
    x, names = features(Tables(spark, d), 8)
    x = P.with_means(x, ["fold"], {"tide": "y"})
    products = {f"{c}_tide": F.col(c) * F.col("tide") for c in names}
    return scores(spark, d, {"base": names, "tide": [*names, "tide", *products]}, x.withColumns(products), [*names, "tide", *products])


@query("ml_ridge_event_cv", models(16, {"all": "x"}, [0.1, 1.0, 10.0, 100.0]) + " SELECT CASE alpha WHEN 0.1 THEN 'a0' WHEN 1.0 THEN 'a1' WHEN 10.0 THEN 'a2' ELSE 'a3' END AS alpha, round(sqrt(avg((y - oof) * (y - oof))), 5) AS rmse FROM oof GROUP BY 1")
def ml_ridge_event_cv(spark, d):
    """Left-out-fold error for each penalty."""
    x, names = features(Tables(spark, d), 16)
    g, alphas = L.grams(x, names, ["y"], "fold"), {"a0": 0.1, "a1": 1.0, "a2": 10.0, "a3": 100.0}
    for name, a in alphas.items():
        x = L.out_of_fold(x, g, "fold", 0, a, out=name)
    return rounded(x.agg(*[F.sqrt(F.avg((F.col("y") - F.col(c)) ** 2)).alias(c) for c in alphas]).unpivot([], list(alphas), "alpha", "rmse"), 5)


@query("ml_elastic_net_cv")
def ml_elastic_net_cv(spark, d):
    """Each fold predicted by an elastic net of the others, its penalty and ratio chosen among 300 by leaving each of those out in turn."""
    x, names = features(Tables(spark, d), 16)
    x = x.withColumn("fold", F.pmod(F.col("vec_id"), F.lit(5)).cast("string"))
    found = L.elastic_net_cv(L.grams(x, names, ["y"], "fold"), 0, [0.1, 0.5, 0.7, 0.9, 0.95, 0.99])
    return L.by_fold(x, "fold", {f: {"prediction": fit} for f, (fit, _, _) in found.items()}).select("vec_id", "fold", "y", "prediction")


NETS = """b AS (SELECT vec_id % 5 AS fold, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS z, 0.7 * embedding[1]::DOUBLE - 0.2 * embedding[2]::DOUBLE + 0.5 * embedding[3]::DOUBLE AS y FROM embeddings),
g AS (SELECT f.fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM (SELECT DISTINCT fold FROM b) f JOIN b ON b.fold <> f.fold GROUP BY 1),
s AS (SELECT *, xz / sqrt(xx * zz) AS c, xy / sqrt(xx) AS u, zy / sqrt(zz) AS v FROM g), p AS (SELECT s.*, a.penalty, r.ratio, a.penalty * r.ratio AS l1, 1 + a.penalty * (1 - r.ratio) AS d FROM s, (SELECT unnest([0.003, 0.01, 0.03]::DOUBLE[]) AS penalty) a, (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS ratio) r),
k AS (SELECT *, CASE WHEN i <> 0 AND j <> 0 THEN ((u - l1 * i) * d - c * (v - l1 * j)) / (d * d - c * c) WHEN i <> 0 THEN (u - l1 * i) / d ELSE 0 END AS a1, CASE WHEN i <> 0 AND j <> 0 THEN ((v - l1 * j) * d - c * (u - l1 * i)) / (d * d - c * c) WHEN j <> 0 THEN (v - l1 * j) / d ELSE 0 END AS a2 FROM p, unnest([-1, 0, 1]) AS m(i), unnest([-1, 0, 1]) AS n(j)),
ok AS (SELECT * FROM k WHERE sign(a1) = i AND sign(a2) = j AND (i <> 0 OR abs(u - c * a2) <= l1) AND (j <> 0 OR abs(v - c * a1) <= l1)),
e AS (SELECT ok.*, b.y - my - a1 / sqrt(xx) * (b.x - mx) - a2 / sqrt(zz) * (b.z - mz) AS e FROM ok JOIN b ON b.fold = ok.fold)"""


@query("ml_elastic_net_path", f"WITH {NETS} SELECT CAST(fold AS VARCHAR) AS fold, penalty, ratio, round(any_value(a1 / sqrt(xx)), 5) AS b0, round(any_value(a2 / sqrt(zz)), 5) AS b1, round(avg(e * e), 6) AS mse FROM e GROUP BY 1, 2, 3")
def ml_elastic_net_path(spark, d):
    """Two features, nine pairs of penalty and ratio: coefficients of the other folds and error on the fold, from one scan."""
    x, names = features(Tables(spark, d), 3)
    x = x.withColumns({"fold": F.pmod(F.col("vec_id"), F.lit(5)).cast("string"), "y": F.expr("0.7D * x0 - 0.2D * x1 + 0.5D * x2")})
    g, ratios, penalties = L.grams(x, names[:2], ["y"], "fold"), np.array([0.1, 0.5, 0.9]), [0.03, 0.01, 0.003]
    rows = []
    for f, own in g.by_fold.items():
        t = g.without(f)
        mean = t[0, 1:] / t[0, 0]
        cov = t[1:, 1:] / t[0, 0] - np.outer(mean, mean)
        sd = np.sqrt(np.diag(cov)[:2])
        path = L.elastic_path(cov[:2, :2] / np.outer(sd, sd), cov[:2, 2] / sd, ratios, np.repeat(np.array(penalties)[:, None], 3, axis=1)) / sd
        for i, a in enumerate(penalties):
            for j, r in enumerate(ratios.tolist()):
                b = path[i, j]
                w = np.array([mean[2] - b @ mean[:2], *b, -1.0])
                rows.append((f, a, r, float(b[0]), float(b[1]), float(w @ own @ w / own[0, 0])))
    found = spark.createDataFrame(rows, "fold string, penalty double, ratio double, b0 double, b1 double, mse double")
    return found.select("fold", "penalty", "ratio", *[(F.round(c, k) + F.lit(0.0)).alias(c) for c, k in (("b0", 5), ("b1", 5), ("mse", 6))])


@query("map_poll_block", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'low' WHEN p_brand LIKE 'Brand#2%' THEN 'two' WHEN p_brand LIKE '%3%' THEN 'three' WHEN p_brand LIKE '%4%' THEN 'four' ELSE 'other' END AS block FROM part")
def map_poll_block(spark, d):
    """An ordered chain: exact codes, then prefixes, then substrings; the first rule that fits wins."""
    part = Tables(spark, d).part
    exact = J.rule_chain(F.col("p_type"), [("exact", {"ECONOMY": "low"})], "")
    rest = J.rule_chain(F.col("p_brand"), [("prefix", [("Brand#2", "two")]), ("substring", [("3", "three"), ("4", "four")])], "other")
    return part.select("p_partkey", F.coalesce(F.nullif(exact, F.lit("")), rest).alias("block"))


@query("map_party_block_basic", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'low' WHEN 'STANDARD' THEN 'mid' ELSE 'other' END AS block FROM part")
def map_party_block_basic(spark, d):
    """The plain table of codes."""
    codes = {"ECONOMY": "low", "PROMO": "low", "STANDARD": "mid"}
    return Tables(spark, d).part.select("p_partkey", J.rule_chain(F.col("p_type"), [("exact", codes)], "other").alias("block"))


def kernel_residual(spark, d, landmarks: int = 100):
    """Left-out-fold residuals fitted on kernel features: distances to `landmarks` rows, chosen by hash (a fixed, documented
    number, as in any landmark method), by a model whose penalty maximises the evidence."""
    x, names = features(Tables(spark, d), 8)
    x = L.out_of_fold(x, L.grams(x, names, ["y"], "fold"), "fold", 0, 1.0).withColumn("left", F.col("y") - F.col("oof"))
    complete = x.where(" and ".join(f"{c} is not null" for c in names))
    points = np.array(complete.orderBy(F.xxhash64("vec_id"), "vec_id").select(*names).limit(landmarks).collect(), float)
    rows = L.kernel_features(x, names, points, 1 / len(names), ["vec_id", "fold", "y", "oof", "left"])
    g = L.grams(rows, [f"k{i}" for i in range(len(points))], ["left"], "fold")
    more = L.evidence_out_of_fold(rows, g, "fold", ["vec_id", "fold", "y", "oof"], "more", "deviation")
    return more.select("vec_id", "fold", "y", "oof", (F.col("oof") + F.col("more")).alias("fitted"), "deviation")


@query("ml_kernel_residual")
def ml_kernel_residual(spark, d):
    return kernel_residual(spark, d)


@query("ml_kernel_calibration")
def ml_kernel_calibration(spark, d):
    """The factor that brings the 90th percentile of the errors, scaled by their predictive deviations, to that of a normal distribution."""
    scaled = kernel_residual(spark, d).select(F.abs(P.ratio(F.col("y") - F.col("fitted"), "deviation")).alias("z"))
    return scaled.agg((F.percentile("z", 0.9) / 1.645).alias("factor"), F.count("*").alias("n"))
