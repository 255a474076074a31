"""Queries of backtests with rolling origins, and of models that never see the rows they predict."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arealis.operators import backtests as B
from arealis.operators import levels as E
from arealis.plans.catalog import Tables, query, rounded
from arealis.plans.model_queries import STEP, moves
from arealis.plans.panel_queries import TYPED, typed
from arealis.plans.ridge_sql import solved

SCORED = "count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(CASE WHEN var_pop(p - b) > 1e-9 AND var_pop(y - b) > 1e-9 THEN corr(p - b, y - b) END, 4) AS het_corr"


def rolling_sql(key: str) -> str:
    """Slopes of dy on dx over earlier events, from the table ok."""
    return f"""SELECT {key}, event, xy / xx AS slope, sqrt(greatest(0, yy - xy * xy / xx) / greatest(n - 2, 1) / xx) AS se FROM (
SELECT {key}, event, n, sxx / n - sx * sx / (n * n) AS xx, sxy / n - sx * sy / (n * n) AS xy, syy / n - sy * sy / (n * n) AS yy FROM (
SELECT {key}, event, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy, sum(syy) OVER w AS syy FROM (
SELECT {key}, event, count(*)::DOUBLE AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy FROM ok GROUP BY 1, 2)
WINDOW w AS (PARTITION BY {key} ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 3) WHERE xx > 1e-9"""


@query("st_slope_backtest", f"""WITH {STEP}, ok AS (SELECT * FROM move WHERE dx IS NOT NULL AND dy IS NOT NULL), u AS ({rolling_sql("unit")}), g AS ({rolling_sql("parent")}),
t AS (SELECT event, sum(slope / greatest(se * se, 1e-12)) / sum(1 / greatest(se * se, 1e-12)) AS mean, greatest(0, var_pop(slope) - avg(se * se)) AS tau2 FROM u GROUP BY 1),
s AS (SELECT unit, event, mean + coalesce(tau2 / nullif(tau2 + se * se, 0), 0) * (slope - mean) AS own FROM u JOIN t USING (event)),
x AS (SELECT event, dx, dy, own, g.slope AS pooled FROM ok JOIN s USING (unit, event) JOIN g USING (parent, event)),
m AS (SELECT event, unnest(['uniform', 'unit', 'group']) AS method, dy AS y, dx AS b, unnest([dx, own * dx, pooled * dx]) AS p FROM x) SELECT event, method, {SCORED} FROM m GROUP BY 1, 2""")
def st_slope_backtest(spark, d):
    """Uniform, unit and group slopes, each from earlier events only, per event."""
    return rounded(B.slope_backtest(moves(Tables(spark, d)), "unit", "parent", "event", "dx", "dy"), 4)


def cells_sql(where: str = "") -> str:
    return f"SELECT event, floor(p / 1.0) AS cell, count(*)::DOUBLE AS n, sum(p) AS level, sum(dx * dy) AS xy, sum(dx * dx) AS xx FROM ok {where} GROUP BY 1, 2"


def curve_sql(cells: str, bins: int = 4) -> str:
    return f"""SELECT event, bin, sum(level) / sum(n) AS lv, sum(xy) / nullif(sum(xx), 0) AS g FROM (SELECT *, floor({bins} * (sum(n) OVER (PARTITION BY event ORDER BY cell) - n / 2) / sum(n) OVER (PARTITION BY event)) AS bin FROM {cells}) GROUP BY 1, 2 HAVING sum(xx) > 0"""


def at_sql(points: str, row: str, x: str) -> str:
    """The curve of row's event at x."""
    side = lambda what, op: f"(SELECT {what} FROM {points} q WHERE q.event = {row}.event AND q.lv {op} {x})"
    a, b = side("arg_max(q.g, q.lv)", "<="), side("arg_min(q.g, q.lv)", ">=")
    low, high = side("max(q.lv)", "<="), side("min(q.lv)", ">=")
    return f"least(1.0, greatest(0.0, coalesce({a} + ({b} - {a}) * coalesce(({x} - {low}) / nullif({high} - {low}, 0), 0.0), {a}, {b})))"


OK = "ok AS (SELECT * FROM move WHERE abs(dx) > 0.05)"
EARLIER = f"c AS ({cells_sql()}), k AS (SELECT e.event, c.cell, sum(n) AS n, sum(level) AS level, sum(xy) AS xy, sum(xx) AS xx FROM (SELECT DISTINCT event FROM c) e JOIN c ON c.event < e.event GROUP BY 1, 2), f AS (SELECT event, sum(xy) / nullif(sum(xx), 0) AS flat FROM k GROUP BY 1), pt AS ({curve_sql('k')})"


@query("st_gamma_backtest", f"""WITH {STEP}, {OK}, {EARLIER},
h AS (SELECT unit, event, count(*) OVER w AS n, sum(p) OVER w AS sl, sum(dx * dx) OVER w AS xx, sum(dx * dy) OVER w AS xy, sum(dy * dy) OVER w AS yy FROM ok WINDOW w AS (PARTITION BY unit ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT unit, event, xy / xx - {at_sql("pt", "h", "(h.sl / h.n)")} AS dev, greatest(yy - xy * xy / xx, 1e-9) / (n - 1) / xx AS se2 FROM h WHERE n >= 2),
t AS (SELECT event, greatest(0, sum(dev * dev / greatest(se2, 1e-9)) / sum(1 / greatest(se2, 1e-9)) - avg(se2)) AS tau2 FROM v GROUP BY 1),
r AS (SELECT o.unit, o.event, o.dx, o.dy, f.flat, {at_sql("pt", "o", "o.p")} AS cv FROM ok o JOIN f ON f.event = o.event),
x AS (SELECT r.*, coalesce(tau2 / (tau2 + se2) * dev, 0) AS extra FROM r LEFT JOIN v USING (unit, event) LEFT JOIN t USING (event)),
m AS (SELECT event, unnest(['flat', 'curve', 'unit']) AS method, dy AS y, flat * dx AS b, unnest([flat * dx, cv * dx, least(1.0, greatest(0.0, cv + extra)) * dx]) AS p FROM x) SELECT event, method, {SCORED} FROM m GROUP BY 1, 2""")
def st_gamma_backtest(spark, d):
    """One response, a curve over the level, and the curve with each unit's own departure, from earlier events only, per event."""
    m = moves(Tables(spark, d)).where("abs(dx) > 0.05")
    return rounded(B.response_backtest(m, "unit", "event", "p", "dx", "dy", bins=4), 4)


FEATURES = ["z0", "z1", "z2", "z3"]
NAMED = {"z0": "p", "z1": "other", "z2": "size", "z3": "momentum"}
PAST = """past AS (SELECT unit, event, lag(N) OVER w AS other, ln(lag(weight) OVER w) AS size, lag(A) OVER w - lag(A, 2) OVER w AS momentum FROM panel WINDOW w AS (PARTITION BY unit ORDER BY event)),
known AS (SELECT m.*, other, size, momentum FROM move m JOIN past USING (unit, event) WHERE abs(dx) > 0.05 AND momentum IS NOT NULL),
ok AS (SELECT *, dy / dx AS r, dx * dx AS w, CASE WHEN (unit + event) % 2 = 0 THEN 'a' ELSE 'b' END AS half, """ + ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {z}" for z, c in NAMED.items()) + " FROM known)"


def transitions(t: Tables):
    """Moves with standardised features known before the event, and a half of each event's units."""
    w = Window.partitionBy("unit").orderBy("event")
    past = t.panel().select("unit", "event", F.lag("N").over(w).alias("other"), F.log(F.lag("weight").over(w)).alias("size"), (F.lag("A").over(w) - F.lag("A", 2).over(w)).alias("momentum"))
    known = moves(t).join(past, ["unit", "event"]).where("abs(dx) > 0.05 and momentum is not null")
    return B.standardised(known, NAMED).withColumn("half", F.when((F.col("unit") + F.col("event")) % 2 == 0, "a").otherwise("b"))


def entries_sql(where: str) -> str:
    return f"SELECT CAST(event AS VARCHAR) AS key, i, j, sum(w * z[i] * z[j]) AS g FROM (SELECT event, w, [1.0, z0, z1, z2, z3, r] AS z FROM ok {where}), unnest(range(1, 7)) AS a(i), unnest(range(1, 7)) AS b(j) GROUP BY 1, 2, 3"


def line_sql(fit: str) -> str:
    return f"least(1.0, greatest(0.0, {fit}.intercept + list_dot_product({fit}.beta, [o.z0, o.z1, o.z2, o.z3])))"


@query("st_gamma_within_across", f"""WITH RECURSIVE {STEP}, {PAST}, {EARLIER}, own AS ({curve_sql('(' + cells_sql("WHERE half = 'a'") + ')')}),
gw AS ({entries_sql("WHERE half = 'a'")}), ge AS ({entries_sql("")}), ga AS (SELECT e.key, ge.i, ge.j, sum(ge.g) AS g FROM (SELECT DISTINCT key FROM ge) e JOIN ge ON ge.key < e.key GROUP BY 1, 2, 3),
{solved("gw", "fw", 4, 10.0)}, {solved("ga", "fa", 4, 10.0)},
x AS (SELECT o.event, o.dx, o.dy, f.flat, {line_sql("fw")} AS pw, {line_sql("fa")} AS pa, {at_sql("own", "o", "o.p")} AS cw, {at_sql("pt", "o", "o.p")} AS ca FROM ok o JOIN f ON f.event = o.event JOIN fw ON fw.key = CAST(o.event AS VARCHAR) JOIN fa ON fa.key = CAST(o.event AS VARCHAR) WHERE half = 'b'),
m AS (SELECT event, unnest(['level', 'within', 'across']) AS method, dy AS y, flat * dx AS b, unnest([ca * dx, pw * dx, pa * dx]) AS p, unnest([NULL, cw * dx, ca * dx]) AS c FROM x)
SELECT event, method, {SCORED}, round(CASE WHEN var_pop(p - c) > 1e-9 AND var_pop(y - c) > 1e-9 THEN corr(p - c, y - c) END, 4) AS extra_corr FROM m GROUP BY 1, 2""")
def st_gamma_within_across(spark, d):
    """Half of an event's units scored by the other half, and by all earlier events."""
    return rounded(B.within_across(transitions(Tables(spark, d)), "event", "half", FEATURES, "p", "dx", "dy", 10.0, bins=4), 4)


@query("st_coef_stability", f"""WITH RECURSIVE {STEP}, {PAST}, ge AS ({entries_sql("")}), {solved("ge", "fe", 4, 10.0)}, tide AS (SELECT event, avg(dx) AS t FROM ok GROUP BY 1 HAVING count(*) >= 2),
l AS (SELECT event, t, unnest(beta) AS c, unnest(range(4)) AS i FROM fe JOIN tide ON CAST(event AS VARCHAR) = key)
SELECT a.event AS event_a, b.event AS event_b, round(corr(a.c, b.c), 4) AS r, any_value((a.t > 0) = (b.t > 0)) AS same_direction FROM l a JOIN l b ON a.i = b.i AND a.event < b.event GROUP BY 1, 2""")
def st_coef_stability(spark, d):
    """How alike the coefficients of two transitions are, for every pair."""
    return rounded(B.coefficient_stability(transitions(Tables(spark, d)), "event", FEATURES, "dx", "dy", 10.0), 4)


#: Levels of irregular events of several kinds: some rows of the typed panel, a fifth of a year apart by kind.
IRREGULAR = f"{TYPED}, s AS (SELECT unit, kind, event + (CAST(left(kind, 1) AS INTEGER) - 1) / 5 AS day, level FROM typed WHERE (unit * 3 + event * 5 + CAST(left(kind, 1) AS INTEGER) * 7) % 4 <> 0), v AS (SELECT CAST(c_nationkey AS BIGINT) AS unit, avg(c_acctbal) AS survey FROM customer WHERE c_nationkey % 7 = 0 GROUP BY 1)"
TARGET, KIND = 2003.0, "1-URGENT"


def line_of(n: str, x: str, y: str, xx: str, xy: str, at: str) -> str:
    slope = f"coalesce(CASE WHEN abs({n} * {xx} - {x} * {x}) > 1e-9 THEN ({n} * {xy} - {x} * {y}) / ({n} * {xx} - {x} * {x}) END, 0)"
    return f"(({y} - {slope} * {x}) / nullif({n}, 0) + {slope} * {at})"


@query("st_level_estimators", f"""WITH {IRREGULAR}, g AS (SELECT *, day - lag(day) OVER o AS x, lag(level) OVER o AS last, lag(level) OVER (PARTITION BY unit, kind ORDER BY day) AS last_same, (sum(level) OVER k - level) / nullif(count(*) OVER k - 1, 0) AS same_mean, (sum(level) OVER a - level) / nullif(count(*) OVER a - 1, 0) AS mean
FROM s WINDOW o AS (PARTITION BY unit ORDER BY day, kind), k AS (PARTITION BY unit, kind), a AS (PARTITION BY unit)),
h AS (SELECT *, count(x) OVER a - 1 AS n1, sum(x) OVER a - x AS x1, sum(CASE WHEN x IS NOT NULL THEN level END) OVER a - level AS y1, sum(x * x) OVER a - x * x AS xx1, sum(x * level) OVER a - x * level AS xy1 FROM g WINDOW a AS (PARTITION BY unit)),
r AS (SELECT *, CASE WHEN x IS NOT NULL THEN {line_of("n1", "x1", "y1", "xx1", "xy1", "x")} END AS gap FROM h),
t AS (SELECT unit, sqrt(avg((level - gap) ** 2)) AS rmse_gap, sqrt(avg((level - last_same) ** 2)) AS rmse_last_same, sqrt(avg((level - same_mean) ** 2)) AS rmse_same_mean, sqrt(avg((level - mean) ** 2)) AS rmse_mean, sqrt(avg((level - last) ** 2)) AS rmse_last,
count(x) AS n, sum(x) AS x, sum(level) FILTER (x IS NOT NULL) AS y, sum(x * x) AS xx, sum(x * level) AS xy, {TARGET} - max(day) AS ahead, avg(level) AS m, coalesce(arg_max(level, day) FILTER (kind = '{KIND}'), avg(level)) AS ls, coalesce(avg(level) FILTER (kind = '{KIND}'), avg(level)) AS sm, arg_max(level, struct_pack(a := day, k := kind)) AS la FROM r GROUP BY 1),
c AS (SELECT *, coalesce({line_of("n", "x", "y", "xx", "xy", "ahead")}, m) AS gp FROM t),
b AS (SELECT *, list_sort(list_filter([{{'e': round(rmse_gap, 9), 'i': 0, 'rule': 'gap', 'v': gp}}, {{'e': round(rmse_last_same, 9), 'i': 1, 'rule': 'last_same', 'v': ls}}, {{'e': round(rmse_same_mean, 9), 'i': 2, 'rule': 'same_mean', 'v': sm}}, {{'e': round(rmse_mean, 9), 'i': 3, 'rule': 'mean', 'v': m}}, {{'e': round(rmse_last, 9), 'i': 4, 'rule': 'last', 'v': la}}], lambda o: o.e IS NOT NULL))[1] AS best FROM c)
SELECT unit, round(rmse_gap, 2) AS rmse_gap, round(rmse_last_same, 2) AS rmse_last_same, round(rmse_same_mean, 2) AS rmse_same_mean, round(rmse_mean, 2) AS rmse_mean, round(rmse_last, 2) AS rmse_last, CASE WHEN survey IS NOT NULL THEN 'survey' ELSE best.rule END AS best, round(coalesce(survey, best.v), 2) AS predicted FROM b LEFT JOIN v USING (unit)""")
def st_level_estimators(spark, d):
    """Five history rules per unit by left-out error, the best one's guess for an event to come, and surveys where there are any."""
    t, number = Tables(spark, d), F.left("kind", F.lit(1)).cast("int")
    s = typed(t).where((F.col("unit") * 3 + F.col("event") * 5 + number * 7) % 4 != 0).select("unit", "kind", (F.col("event") + (number - 1) / 5).alias("day"), "level")
    surveys = t.customer.where("c_nationkey % 7 = 0").groupBy(F.col("c_nationkey").cast("long").alias("unit")).agg(F.avg("c_acctbal").alias("survey"))
    return rounded(E.choose_rule(s, "unit", "kind", "day", "level", TARGET, KIND, surveys), 2)
