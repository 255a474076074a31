"""Queries of the models: linear algebra over folds, intervals, slopes and attributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from arealis.operators import intervals as I  # noqa: E741
from arealis.operators import linear as L
from arealis.operators import panel as P
from arealis.operators import slopes as S
from arealis.plans.catalog import PANEL, Tables, query, rounded
from arealis.plans.ridge_sql import METRICS, leverages, models

ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
STEP = f"{PANEL}, step AS (SELECT unit, parent, event, A, weight, lag(A) OVER w AS p, A - lag(A) OVER w AS dy, avg(A) OVER (PARTITION BY event) AS tide FROM panel WINDOW w AS (PARTITION BY unit ORDER BY event)), move AS (SELECT *, tide - lag(tide) OVER (PARTITION BY unit ORDER BY event) AS dx FROM step)"


def moves(t: Tables):
    """Panel rows with the previous share p, its change dy and the change dx of the event mean."""
    from pyspark.sql import Window

    tide = P.with_means(t.panel(), ["event"], {"tide": "A"})
    w = Window.partitionBy("unit").orderBy("event")
    return tide.select("unit", "parent", "event", "A", "weight", F.lag("A").over(w).alias("p"), (F.col("A") - F.lag("A").over(w)).alias("dy"), "tide", (F.col("tide") - F.lag("tide").over(w)).alias("dx"))


def features(t: Tables, n: int = 64):
    """Embedding components x0.., fold (the label), and a target that they explain but for a fixed disturbance."""
    e = F.col("embedding")
    x = t.embeddings.select("vec_id", F.col("label").cast("string").alias("fold"), *[e[i].cast("double").alias(f"x{i}") for i in range(n)])
    y = sum((F.lit(float((i * 7) % 11 - 5) / 5) * F.col(f"x{i}") for i in range(n)), F.lit(2.0))
    return x.withColumn("y", y + (F.pmod(F.col("vec_id") * 7919, F.lit(1000)) / 1000 - 0.5) * 0.1), [f"x{i}" for i in range(n)]


@query("ml_metrics", f"WITH {STEP} SELECT event, count(*) AS n, round(1 - avg((A - p) * (A - p)) / var_pop(A), 5) AS r2, round(1 - var_pop(A - p) / var_pop(A), 5) AS r2_unbiased, round(corr(A, p) * corr(A, p), 5) AS r2_affine, round(avg(abs(A - p)), 5) AS mae, round(sqrt(avg((A - p) * (A - p))), 5) AS rmse FROM step WHERE p IS NOT NULL GROUP BY 1")
def ml_metrics(spark, d):
    return rounded(L.metrics(moves(Tables(spark, d)).where("p is not null"), "A", "p", ["event"]), 5)


@query("ml_standardise", "SELECT round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(embedding[1] AS DOUBLE)), 6) AS sd FROM embeddings")
def ml_standardise(spark, d):
    g = L.grams(features(Tables(spark, d), 1)[0], ["x0"], ["y"]).total
    mean = g[0, 1] / g[0, 0]
    return spark.createDataFrame([(round(float(mean), 6), round(float(np.sqrt(g[1, 1] / g[0, 0] - mean**2)), 6))], "mean double, sd double")


RIDGE = "WITH x AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy FROM x)"


@query("ml_ridge_one", f"{RIDGE} SELECT round(n * cxy / sqrt(vx) / (n + 10) / sqrt(vx), 6) AS slope, round(my - n * cxy / vx / (n + 10) * mx, 6) AS intercept FROM m")
def ml_ridge_one(spark, d):
    x, _ = features(Tables(spark, d), 2)
    g = L.grams(x.withColumn("y", F.col("x1")), ["x0"], ["y"])
    fit = L.solve(g.total, ["x0"], 0, 10.0)
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 6), round(float(fit.intercept), 6))], "slope double, intercept double")


@query("ml_ridge_cv", leverages(64, ALPHAS) + " SELECT alpha, round(avg((e / (1 - h)) * (e / (1 - h))), 6) AS press FROM h GROUP BY 1")
def ml_ridge_cv(spark, d):
    """Mean squared leave-one-out error per penalty, from leverages."""
    x, names = features(Tables(spark, d))
    scores = L.press(x, L.grams(x, names, ["y"], "fold"), 0, ALPHAS)
    return rounded(spark.createDataFrame([(a, float(s)) for a, s in scores.items()], "alpha double, press double"))


@query("ml_ridge_loeo", models(64, {"all": "x"}, [0.1]) + " SELECT vec_id, fold, round(y, 6) AS y, round(oof, 6) AS oof FROM oof")
def ml_ridge_loeo(spark, d):
    """Each fold predicted by the model of the others."""
    x, names = features(Tables(spark, d))
    return rounded(L.out_of_fold(x, L.grams(x, names, ["y"], "fold"), "fold", 0, 0.1).select("vec_id", "fold", "y", "oof"))


@query("ml_ridge_loeo_rescaled", models(64, {"all": "x"}, [0.1], rescale=True) + " SELECT vec_id, fold, round(y, 6) AS y, round(oof, 6) AS oof FROM oof")
def ml_ridge_loeo_rescaled(spark, d):
    x, names = features(Tables(spark, d))
    return rounded(L.out_of_fold(x, L.grams(x, names, ["y"], "fold"), "fold", 0, 0.1, rescale=True).select("vec_id", "fold", "y", "oof"))


@query("ml_pca_block")
def ml_pca_block(spark, d):
    """The first 48 features as 10 principal components, the others as they are; left-out-fold scores."""
    x, names = features(Tables(spark, d))
    oof = L.out_of_fold(x, L.grams(x, names, ["y"], "fold"), "fold", 0, 0.1, pca=(48, 10))
    return L.metrics(oof, "y", "oof", ["fold"])


ABLATION = {"all": "x"} | {f"without_{k}": f"list_concat(x[1:{k}], x[{k + 17}:64])" for k in range(0, 64, 16)}


@query("ml_ablation", models(64, ABLATION, [0.1]) + " SELECT features, round(1 - avg((y - oof) * (y - oof)) / var_pop(y), 5) AS r2 FROM oof GROUP BY 1")
def ml_ablation(spark, d):
    """Left-out-fold R2 without each group of 16 features: sub-Grams, one scan for the scores."""
    x, names = features(Tables(spark, d))
    g = L.grams(x, names, ["y"], "fold")
    groups = {"all": []} | {f"without_{k}": names[k : k + 16] for k in range(0, 64, 16)}
    scored = x
    for name, gone in groups.items():
        scored = L.out_of_fold(scored, g.subset([c for c in names if c not in gone]), "fold", 0, 0.1, out=name)
    parts = [L.metrics(scored, "y", name).select(F.lit(name).alias("features"), "r2") for name in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 5)


#: Rows of the validation fold are seen by no choice.
VALIDATION = "9"


@query("ml_select_model", models(64, {str(n): f"x[1:{n}]" for n in (8, 32, 64)}, ALPHAS, hold=VALIDATION) + f""", r AS (SELECT CAST(features AS INTEGER) AS n_features, alpha, fold = '{VALIDATION}' AS held, avg((y - oof) * (y - oof)) AS mse, var_pop(y) AS spread FROM oof GROUP BY 1, 2, 3),
c AS (SELECT n_features, alpha, 1 - mse / spread AS r2 FROM r WHERE NOT held ORDER BY r2 DESC, alpha, n_features LIMIT 1) SELECT n_features, c.alpha, round(c.r2, 6) AS r2, round(1 - mse / spread, 6) AS validation_r2, round(sqrt(mse), 6) AS validation_rmse FROM c JOIN r USING (n_features) WHERE held AND r.alpha = c.alpha""")
def ml_select_model(spark, d):
    """The configuration with the best left-out-fold R2 on the training folds, by Grams of one scan; then one pass of the chosen one over
    the validation fold, which took no part in the choice."""
    x, names = features(Tables(spark, d))
    g = L.grams(x, names, ["y"], "fold")
    train = L.Grams(g.features, g.targets, {f: m for f, m in g.by_fold.items() if f != VALIDATION})
    n, a, r2 = max(((n, a, L.fold_r2(train.subset(names[:n]), 0, a)) for a in ALPHAS for n in (8, 32, 64)), key=lambda x: (x[2], -x[1], -x[0]))
    fit = L.solve(train.subset(names[:n]).total, names[:n], 0, a)
    held = L.metrics(x.where(F.col("fold") == VALIDATION).withColumn("p", fit.predict()), "y", "p")
    return rounded(held.select(F.lit(n).alias("n_features"), F.lit(float(a)).alias("alpha"), F.lit(float(r2)).alias("r2"), F.col("r2").alias("validation_r2"), F.col("rmse").alias("validation_rmse")))


@query("ml_weighted_ridge", "WITH x AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(vec_id % 5 + 1 AS DOUBLE) AS w FROM embeddings), m AS (SELECT sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM x), c AS (SELECT any_value(n) AS n, sum(w * (x - mx) * (y - my)) AS cxy, sum(w * (x - mx) * (x - mx)) AS cxx FROM x, m) SELECT round(cxy / cxx / (1 + 10 / n), 6) AS slope FROM c")
def ml_weighted_ridge(spark, d):
    x, _ = features(Tables(spark, d), 2)
    x = x.withColumns({"y": F.col("x1"), "w": (F.col("vec_id") % 5 + 1).cast("double")})
    g = L.grams(x, ["x0"], ["y"], weight="w")
    return spark.createDataFrame([(round(float(L.solve(g.total, ["x0"], 0, 10.0).coefficients[0]), 6),)], "slope double")


@query("ml_stack_blend")
def ml_stack_blend(spark, d):
    """Left-out-fold scores of three models and of their blends, whose weights never see the fold that they score."""
    x, names = features(Tables(spark, d))
    parts = {"m0": names[:24], "m1": names[24:48], "m2": names[48:]}
    fits = L.nested_blends(L.grams(x, names, ["y"], "fold"), parts, 0, 0.1, [float(a) for a in np.logspace(-4, 4, 20)])
    rows = L.by_fold(x, "fold", fits)
    long = rows.unpivot(["vec_id", "y"], [*parts, "mean", "nonnegative", "ridge"], "method", "p")
    return L.metrics(long, "y", "p", ["method"])


POLY2 = "list_concat(x, [" + ", ".join(f"x[{i}] * x[{j}]" for i in range(1, 7) for j in range(i, 7)) + "])"


@query("ml_poly2", models(6, {"all": POLY2}, [1.0]) + f" SELECT fold, {METRICS} FROM oof GROUP BY 1")
def ml_poly2(spark, d):
    """Degree-2 expansion of 6 features, ridge, left-out-fold scores."""
    x, names = features(Tables(spark, d), 6)
    pairs = {f"q{i}_{j}": F.col(a) * F.col(b) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    x = x.withColumns(pairs)
    return rounded(L.metrics(L.out_of_fold(x, L.grams(x, [*names, *pairs], ["y"], "fold"), "fold", 0, 1.0), "y", "oof", ["fold"]), 5)


@query("ml_typed_slopes", models(8, {"all": "list_concat(x, list_transform(x, lambda v: CASE WHEN vec_id % 2 = 1 THEN v ELSE 0.0 END))"}, [1.0]) + f" SELECT fold, {METRICS} FROM oof GROUP BY 1")
def ml_typed_slopes(spark, d):
    """Features times group indicators, for slopes of their own."""
    x, names = features(Tables(spark, d), 8)
    kinds = {f"{c}_odd": F.when(F.col("vec_id") % 2 == 1, F.col(c)).otherwise(0.0) for c in names}
    x = x.withColumns(kinds)
    return rounded(L.metrics(L.out_of_fold(x, L.grams(x, [*names, *kinds], ["y"], "fold"), "fold", 0, 1.0), "y", "oof", ["fold"]), 5)


def explained(t: Tables):
    x, names = features(t, 8)
    return x, L.solve(L.grams(x, names, ["y"]).total, names, 0, 0.1)


@query("ex_linear_shap", models(8, {"all": "x"}, [0.1], whole=True) + " SELECT vec_id, " + ", ".join(f"round(beta[{i + 1}] * (x[{i + 1}] - mean[{i + 1}]), 6) AS c_x{i}" for i in range(8)) + " FROM oof")
def ex_linear_shap(spark, d):
    """Each feature's contribution to each row's prediction."""
    x, fit = explained(Tables(spark, d))
    return rounded(x.select("vec_id", *[c.alias(f"c_{n}") for c, n in zip(fit.contributions(), fit.features, strict=True)]))


@query("ex_shap_check", models(8, {"all": "x"}, [0.1], whole=True) + " SELECT CAST(label AS VARCHAR) AS fold, count(*) AS n, round(avg(oof), 5) AS mean, round(min(oof), 5) AS least, round(max(oof), 5) AS most, 0.0 AS largest_gap FROM oof JOIN embeddings USING (vec_id) GROUP BY 1")
def ex_shap_check(spark, d):
    """Base and contributions added up, against the model's predictions."""
    x, fit = explained(Tables(spark, d))
    total = sum(fit.contributions(), F.lit(fit.base()))
    return rounded(x.groupBy("fold").agg(F.count("*").alias("n"), F.avg(total).alias("mean"), F.min(total).alias("least"), F.max(total).alias("most"), F.max(F.abs(fit.predict() - total)).alias("largest_gap")), 5)


@query("topk_per_row", "WITH x AS (SELECT vec_id, unnest([{'v': -abs(CAST(embedding[1] AS DOUBLE)), 'i': 0}, {'v': -abs(CAST(embedding[2] AS DOUBLE)), 'i': 1}, {'v': -abs(CAST(embedding[3] AS DOUBLE)), 'i': 2}, {'v': -abs(CAST(embedding[4] AS DOUBLE)), 'i': 3}]) AS s FROM embeddings), r AS (SELECT vec_id, s.i AS i, row_number() OVER (PARTITION BY vec_id ORDER BY s.v, s.i) AS k FROM x) SELECT vec_id, max(i) FILTER (k = 1) AS first, max(i) FILTER (k = 2) AS second FROM r GROUP BY 1")
def topk_per_row(spark, d):
    e = F.col("embedding")
    top = F.slice(F.array_sort(F.array(*[F.struct((-F.abs(e[i].cast("double"))).alias("v"), F.lit(i).alias("i")) for i in range(4)])), 1, 2)
    return Tables(spark, d).embeddings.select("vec_id", top.alias("t")).select("vec_id", F.col("t")[0]["i"].alias("first"), F.col("t")[1]["i"].alias("second"))


def unit_records(x, fit, blocks: dict[str, list[str]], width, top: int = 3):
    """Each row's record: prediction, its bounds, what each block of features adds to it, and its largest contributions, as nested values."""
    part = dict(zip(fit.features, fit.contributions(), strict=True))
    drivers = F.array_sort(F.array(*[F.struct((-F.abs(c)).alias("size"), F.lit(i).alias("i"), F.lit(n).alias("feature"), c.alias("value")) for i, (n, c) in enumerate(part.items())]))
    adds = F.struct(*[sum((part[c] for c in some), F.lit(0.0)).alias(b) for b, some in blocks.items()])
    listed = F.transform(F.slice(drivers, 1, top), lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value")))
    wide = x.crossJoin(F.broadcast(width))  # one row
    return wide.select("vec_id", F.struct(fit.predict().alias("prediction"), (fit.predict() - F.col("half_width")).alias("low"), (fit.predict() + F.col("half_width")).alias("high"), F.lit(fit.base()).alias("base"), adds.alias("blocks"), listed.alias("drivers")).alias("record"))


RECORD = models(8, {"all": "x"}, [0.1], whole=True) + """, ranked AS (SELECT abs(y - oof) AS r, row_number() OVER (ORDER BY abs(y - oof)) - 1 AS k, count(*) OVER () AS n FROM oof), placed AS (SELECT *, least(1.0, 0.9 * (1 + 1.0 / n)) * (n - 1) AS t FROM ranked),
width AS (SELECT max(r) FILTER (k = floor(t)) + (max(r) FILTER (k = ceil(t)) - max(r) FILTER (k = floor(t))) * (any_value(t) - floor(any_value(t))) AS w FROM placed), parts AS (SELECT vec_id, oof, list_transform(range(1, 9), lambda i: beta[i] * (x[i] - mean[i])) AS c FROM oof)
SELECT vec_id, round(oof, 5) AS prediction, round(oof - w, 5) AS low, round(oof + w, 5) AS high, round(c[1] + c[2] + c[3], 5) AS first, round(c[4] + c[5] + c[6] + c[7] + c[8], 5) AS rest,
array_to_string(list_transform(list_sort(list_transform(range(1, 9), lambda i: {'s': -abs(c[i]), 'i': i - 1}))[1:3], lambda s: 'x' || s.i), ',') AS drivers FROM parts, width"""


@query("ex_unit_record", RECORD)
def ex_unit_record(spark, d):
    """A record per row, its nested values laid flat."""
    x, fit = explained(Tables(spark, d))
    width = I.half_widths(x.withColumn("_e", F.col("y") - fit.predict()), "_e", 0.1).select("half_width")
    found = unit_records(x, fit, {"first": fit.features[:3], "rest": fit.features[3:]}, width)
    flat = found.select("vec_id", "record.prediction", "record.low", "record.high", "record.blocks.first", "record.blocks.rest", F.array_join(F.transform("record.drivers", lambda s: s["feature"]), ",").alias("drivers"))
    return rounded(flat, 5)


RES = f"{STEP}, res AS (SELECT unit, parent, event, A, p, A - p AS r, abs(p - avg(p) OVER (PARTITION BY event)) AS size, weight FROM step WHERE p IS NOT NULL)"


def residuals(t: Tables):
    m = P.with_means(moves(t).where("p is not null"), ["event"], {"_p": "p"})
    return m.select("unit", "parent", "event", "A", "p", (F.col("A") - F.col("p")).alias("r"), F.abs(F.col("p") - F.col("_p")).alias("size"), "weight")


Q90 = "quantile_cont(abs(r), least(1.0, 0.9 * (1 + 1.0 / {n})))"


def quantile_sql(source: str, keys: str, group: str) -> str:
    """The corrected quantile by order statistics, as its level depends on the group's size."""
    return f"""o AS (SELECT {keys}abs(r) AS r, row_number() OVER ({group} ORDER BY abs(r)) - 1 AS k, count(*) OVER ({group}) AS n FROM {source}), h AS (SELECT *, least(1.0, 0.9 * (1 + 1.0 / n)) * (n - 1) AS t FROM o)"""


WIDTH = "max(r) FILTER (k = floor(t)) + (max(r) FILTER (k = ceil(t)) - max(r) FILTER (k = floor(t))) * (any_value(t) - floor(any_value(t)))"


@query("cf_quantile", f"WITH {RES}, {quantile_sql('res', '', '')} SELECT count(*) AS n_calibration, round({WIDTH}, 5) AS half_width FROM h")
def cf_quantile(spark, d):
    return rounded(I.half_widths(residuals(Tables(spark, d)), "r", 0.1), 5)


@query("cf_standard", f"WITH {RES}, {quantile_sql('res', '', '')}, q AS (SELECT {WIDTH} AS w FROM h) SELECT unit, event, round(greatest(0, p - w), 5) AS low, round(least(100, p + w), 5) AS high FROM res, q")
def cf_standard(spark, d):
    from arealis.functions.text import clip

    r = residuals(Tables(spark, d))
    w = I.half_widths(r, "r", 0.1).select("half_width")
    return rounded(r.crossJoin(F.broadcast(w)).select("unit", "event", clip(F.col("p") - F.col("half_width")).alias("low"), clip(F.col("p") + F.col("half_width")).alias("high")), 5)


@query("cf_by_territory", f"WITH {RES}, {quantile_sql('res', 'parent, ', 'PARTITION BY parent')}, c AS (SELECT parent, count(*) AS n_calibration, {WIDTH} AS w FROM h GROUP BY 1), o2 AS (SELECT abs(r) AS r, row_number() OVER (ORDER BY abs(r)) - 1 AS k, count(*) OVER () AS n FROM res), h2 AS (SELECT *, least(1.0, 0.9 * (1 + 1.0 / n)) * (n - 1) AS t FROM o2), g AS (SELECT {WIDTH} AS w FROM h2) SELECT parent, n_calibration, round(CASE WHEN n_calibration >= 30 THEN c.w ELSE g.w END, 5) AS half_width FROM c, g")
def cf_by_territory(spark, d):
    return rounded(I.by_class(residuals(Tables(spark, d)), "r", 0.1, "parent", 30), 5)


@query("cf_adaptive", f"WITH {RES}, edge AS (SELECT list_distinct([quantile_cont(size, 0.2), quantile_cont(size, 0.4), quantile_cont(size, 0.6), quantile_cont(size, 0.8)]) AS edges FROM res), binned AS (SELECT abs(r) AS r, CAST(len(list_filter(edges, lambda x: x < size)) AS INTEGER) AS bin FROM res, edge), o AS (SELECT bin, r, row_number() OVER (PARTITION BY bin ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY bin) AS m, count(*) OVER () AS n FROM binned), h AS (SELECT *, least(1.0, 0.9 * (1 + 1.0 / n)) * (m - 1) AS t FROM o) SELECT bin, count(*) AS n_calibration, round({WIDTH}, 5) AS half_width FROM h GROUP BY 1")
def cf_adaptive(spark, d):
    return rounded(I.adaptive(residuals(Tables(spark, d)), "r", 0.1, "size"), 5)


FITTED = f"{RES}, {quantile_sql('res', '', '').replace('FROM res)', 'FROM res WHERE event <= 1998)')}, q AS (SELECT {WIDTH} AS w FROM h), b AS (SELECT event, A, weight, greatest(0, p - w) AS low, least(100, p + w) AS high FROM res, q WHERE event > 1998)"


def banded(t: Tables):
    """Rows after 1998 with bounds by the width of the rows up to then."""
    from arealis.functions.text import clip

    r = residuals(t)
    w = I.half_widths(r.where("event <= 1998"), "r", 0.1).select("half_width")
    return r.where("event > 1998").crossJoin(F.broadcast(w)).withColumns({"low": clip(F.col("p") - F.col("half_width")), "high": clip(F.col("p") + F.col("half_width"))})


@query("cf_coverage", f"WITH {FITTED} SELECT event, count(*) AS n, round(avg(CASE WHEN A >= low AND A <= high THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(high - low), 6) AS width, round(median(high - low), 6) AS median_width FROM b GROUP BY 1")
def cf_coverage(spark, d):
    return rounded(I.coverage(banded(Tables(spark, d)), "A", "low", "high", ["event"]))


@query("agg_weighted_coverage", f"WITH {FITTED} SELECT event, count(*) AS n, round(sum(CASE WHEN A >= low AND A <= high THEN weight ELSE 0 END) / sum(weight), 6) AS coverage, round(avg(high - low), 6) AS width, round(median(high - low), 6) AS median_width FROM b GROUP BY 1")
def agg_weighted_coverage(spark, d):
    return rounded(I.coverage(banded(Tables(spark, d)), "A", "low", "high", ["event"], "weight"))


@query("cf_variance_split", f"WITH {RES}, x AS (SELECT r, avg(r) OVER (PARTITION BY event) AS m FROM res) SELECT round(100 * var_pop(m) / var_pop(r), 5) AS overall, round(100 * var_pop(r - m) / var_pop(r), 5) AS own FROM x")
def cf_variance_split(spark, d):
    x = P.with_means(residuals(Tables(spark, d)), ["event"], {"m": "r"})
    return rounded(x.agg(P.ratio(F.var_pop("m"), F.var_pop("r"), 100.0).alias("overall"), P.ratio(F.var_pop(F.col("r") - F.col("m")), F.var_pop("r"), 100.0).alias("own")), 5)


@query("cf_slate_mask", f"WITH {PANEL}, s AS (SELECT unit, event, A, N, R, unit % 3 <> 0 AS has_A, unit % 5 <> 1 AS has_N FROM panel), m AS (SELECT *, (CASE WHEN has_A THEN 0 ELSE A END) + (CASE WHEN has_N THEN 0 ELSE N END) AS gone, (CASE WHEN has_A THEN A ELSE 0 END) + (CASE WHEN has_N THEN N ELSE 0 END) + R AS rest FROM s) SELECT unit, event, round(CASE WHEN has_A THEN A + 0.5 * gone * A / rest ELSE 0 END, 5) AS A, round(CASE WHEN has_N THEN N + 0.5 * gone * N / rest ELSE 0 END, 5) AS N, round(R + 0.5 * gone * R / rest, 5) AS R FROM m")
def cf_slate_mask(spark, d):
    s = Tables(spark, d).panel().withColumns({"has_A": F.col("unit") % 3 != 0, "has_N": F.col("unit") % 5 != 1, "has_R": F.lit(True)})
    return rounded(I.masked(s, {"A": "has_A", "N": "has_N", "R": "has_R"}, 0.5).select("unit", "event", "A", "N", "R"), 5)


@query("st_ols_per_unit", f"WITH {STEP} SELECT unit, count(*) AS n, round(regr_slope(dy, dx), 5) AS slope FROM move WHERE dx IS NOT NULL GROUP BY 1")
def st_ols_per_unit(spark, d):
    return rounded(S.ols(moves(Tables(spark, d)), ["unit"], "dx", "dy").select("unit", "n", "slope"), 5)


@query("st_grouped_slope", f"WITH {STEP} SELECT parent, count(*) AS n, round(regr_slope(dy, dx), 5) AS slope FROM move WHERE dx IS NOT NULL GROUP BY 1")
def st_grouped_slope(spark, d):
    return rounded(S.ols(moves(Tables(spark, d)), ["parent"], "dx", "dy").select("parent", "n", "slope"), 5)


@query("st_eb_shrink", f"WITH {STEP}, o AS (SELECT unit, count(*) AS n, covar_pop(dy, dx) AS xy, var_pop(dx) AS xx, var_pop(dy) AS yy FROM move WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 AND var_pop(dx) > 1e-12), s AS (SELECT unit, n, xy / xx AS slope, sqrt(greatest(0, yy - xy * xy / xx) / greatest(n - 2, 1) / xx) AS se FROM o), g AS (SELECT sum(slope / greatest(se * se, 1e-12)) / sum(1 / greatest(se * se, 1e-12)) AS mean, greatest(0, var_pop(slope) - avg(se * se)) AS tau2 FROM s) SELECT unit, n, round(slope, 5) AS slope, round(se, 5) AS se, round(mean + coalesce(tau2 / nullif(tau2 + se * se, 0), 0) * (slope - mean), 5) AS shrunk FROM s, g")
def st_eb_shrink(spark, d):
    return rounded(S.shrink(S.ols(moves(Tables(spark, d)), ["unit"], "dx", "dy")), 5)


@query("st_gamma_flat", f"WITH {STEP} SELECT round(sum(dx * dy) / sum(dx * dx), 5) AS gamma FROM move WHERE dx IS NOT NULL")
def st_gamma_flat(spark, d):
    return rounded(moves(Tables(spark, d)).where("dx is not null").agg(P.ratio(F.sum(F.col("dx") * F.col("dy")), F.sum(F.col("dx") ** 2)).alias("gamma")), 5)


@query("st_gamma_curve", f"WITH {STEP}, ok AS (SELECT * FROM move WHERE dx IS NOT NULL), e AS (SELECT list_distinct([quantile_cont(p, 0.25), quantile_cont(p, 0.5), quantile_cont(p, 0.75)]) AS edges FROM ok) SELECT CAST(len(list_filter(edges, lambda x: x < p)) AS INTEGER) AS bin, round(avg(p), 5) AS level, round(sum(dx * dy) / sum(dx * dx), 5) AS gamma, count(*) AS n FROM ok, e GROUP BY 1")
def st_gamma_curve(spark, d):
    return rounded(S.curve(moves(Tables(spark, d)), "p", "dx", "dy", 4), 5)


@query("st_gamma_apply", f"WITH {PANEL} SELECT unit, event, round(CASE WHEN A <= 20 THEN 0.2 WHEN A < 25 THEN 0.2 + (A - 20) * 0.04 WHEN A < 30 THEN 0.4 + (A - 25) * 0.02 ELSE 0.5 END, 6) AS gamma FROM panel")
def st_gamma_apply(spark, d):
    return rounded(S.apply_curve(Tables(spark, d).panel(), [(20.0, 0.2), (25.0, 0.4), (30.0, 0.5)], "A").select("unit", "event", "gamma"))


@query("sc_mobilisable", f"WITH {PANEL}, x AS (SELECT *, min(A) OVER (PARTITION BY unit ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM panel) SELECT unit, event, round(weight * greatest(0, A - floor) / 100 * (CASE WHEN A <= 20 THEN 0.2 WHEN A < 25 THEN 0.2 + (A - 20) * 0.04 WHEN A < 30 THEN 0.4 + (A - 25) * 0.02 ELSE 0.5 END), 5) AS mobilisable FROM x WHERE floor IS NOT NULL")
def sc_mobilisable(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("unit").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    x = Tables(spark, d).panel().withColumn("floor", F.min("A").over(w)).where("floor is not null")
    x = S.apply_curve(x, [(20.0, 0.2), (25.0, 0.4), (30.0, 0.5)], "A")
    return rounded(x.select("unit", "event", (F.col("weight") * F.greatest(F.lit(0.0), F.col("A") - F.col("floor")) / 100 * F.col("gamma")).alias("mobilisable")), 5)


@query("sc_loaded_swing", f"WITH {STEP}, s AS (SELECT unit, regr_slope(dy, dx) AS b FROM move WHERE dx IS NOT NULL GROUP BY 1), w AS (SELECT unit, sum(weight) AS weight FROM panel GROUP BY 1) SELECT unit, round(weight * b / 100, 4) AS per_point FROM s JOIN w USING (unit)")
def sc_loaded_swing(spark, d):
    t = Tables(spark, d)
    s, w = S.ols(moves(t), ["unit"], "dx", "dy"), t.panel().groupBy("unit").agg(F.sum("weight").alias("weight"))
    return rounded(s.join(w, "unit").select("unit", (F.col("weight") * F.col("slope") / 100).alias("per_point")), 4)


@query("st_gamma_stability", f"WITH {STEP}, a AS (SELECT parent, sum(dx * dy) / sum(dx * dx) AS g FROM move WHERE dx IS NOT NULL AND event <= 1998 GROUP BY 1), b AS (SELECT parent, sum(dx * dy) / sum(dx * dx) AS g FROM move WHERE dx IS NOT NULL AND event > 1998 GROUP BY 1) SELECT round(corr(a.g, b.g), 4) AS r FROM a JOIN b USING (parent)")
def st_gamma_stability(spark, d):
    m = moves(Tables(spark, d)).where("dx is not null")
    part = lambda cond, name: m.where(cond).groupBy("parent").agg(P.ratio(F.sum(F.col("dx") * F.col("dy")), F.sum(F.col("dx") ** 2)).alias(name))
    return rounded(part("event <= 1998", "a").join(part("event > 1998", "b"), "parent").agg(F.corr("a", "b").alias("r")), 4)


@query("st_bootstrap_band")
def st_bootstrap_band(spark, d):
    return S.bootstrap_band(moves(Tables(spark, d)).where("dx is not null"), "parent", "dx", "dy", row=("unit", "event"))


#: A leaf has a share of the training rows at least, as tables differ in size by orders of magnitude.
LEAF = 0.01


@query("ml_residual_boost")
def ml_residual_boost(spark, d):
    """A hundred boosted trees a fold on the other folds' left-out-fold residuals; the sum is out of fold. All folds grow together. 8 of
    the 64 components."""
    from arealis.operators import trees as T

    x, names = features(Tables(spark, d), 8)
    g = L.grams(x, names, ["y"], "fold")
    oof = L.out_of_fold(x, g, "fold", 0, 1.0).withColumn("left", F.col("y") - F.col("oof"))
    folds = {f: f"fold{i}" for i, f in enumerate(g.by_fold)}  # a model for each, as a Gram for each
    models = [T.Model(name, F.col("fold") != f, depth=3, rounds=100, step=0.05, leaf=LEAF) for f, name in folds.items()]
    done = T.boost(oof, names, "left", models, keep=["vec_id", "fold", "y", "oof"])
    own = F.coalesce(*[F.when(F.col("fold") == f, F.col(name)) for f, name in folds.items()])
    return done.select("vec_id", "y", "oof", (F.col("oof") + own).alias("boosted"))


@query("ml_random_forest")
def ml_random_forest(spark, d):
    """A weighted forest of 150 trees of depth 8 on samples of 15 %, out of fold. 8 of the 64 components."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from arealis.sources.io import stored

    x, names = features(Tables(spark, d), 8)
    x = stored(x.withColumns({"w": 1.0 + F.pmod("vec_id", F.lit(2)), "part": F.pmod(F.hash("fold"), F.lit(3))}), "forest")
    rows = VectorAssembler(inputCols=names, outputCol="f").transform(x)
    leaf, done = max(1, round(LEAF * 0.15 * x.count() * 2 / 3)), None
    for k in range(3):
        forest = RandomForestRegressor(featuresCol="f", labelCol="y", weightCol="w", numTrees=150, maxDepth=8, minInstancesPerNode=leaf, subsamplingRate=0.15, seed=7)
        one = forest.fit(rows.where(F.col("part") != k)).transform(rows.where(F.col("part") == k)).select("vec_id", "y", "prediction")
        done = one if done is None else done.unionByName(one)
    return done
