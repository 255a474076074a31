"""DuckDB SQL of the ridge models: Grams by fold, then Gauss elimination in a recursive table, one row per matrix row.

The feature sets are lists; everything is computed from the rows again, independently of the operators' numpy code."""

from __future__ import annotations

from collections.abc import Sequence

METRICS = "count(*) AS n, round(1 - avg((y - oof) * (y - oof)) / var_pop(y), 5) AS r2, round(1 - var_pop(y - oof) / var_pop(y), 5) AS r2_unbiased, round(corr(y, oof) * corr(y, oof), 5) AS r2_affine, round(avg(abs(y - oof)), 5) AS mae, round(sqrt(avg((y - oof) * (y - oof))), 5) AS rmse"


def rows(n: int) -> str:
    """f: vec_id, fold, the first n embedding components as x, the target y and the mean target of the fold as tide."""
    return f"""b AS (SELECT vec_id, CAST(label AS VARCHAR) AS fold, list_transform(embedding[1:{n}], lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
t AS (SELECT *, 2.0 + list_dot_product(x, list_transform(range({n}), lambda i: CAST(i * 7 % 11 - 5 AS DOUBLE) / 5)) + (vec_id * 7919 % 1000 / 1000 - 0.5) * 0.1 AS y FROM b),
f AS (SELECT *, avg(y) OVER (PARTITION BY fold) AS tide FROM t)"""


def models(n: int, sets: dict[str, str], alphas: Sequence[float], rescale: bool = False, whole: bool = False, hold: str | None = None) -> str:
    """The tables `fit` (features, fold, alpha, intercept, beta, mean) and `oof` (features, alpha, vec_id, fold, y, x, oof): each
    fold predicted by the model of the others, or all rows by one model if `whole`. sets: name to a list over a row of f.
    Scales are deviations over all rows, unless `rescale`. The fold `hold` trains no model; the model of all others predicts it."""
    fold = "'all'" if whole else "fold"
    some = " UNION ALL ".join(f"SELECT '{name}' AS features, vec_id, {fold} AS fold, y, {x} AS x FROM f" for name, x in sets.items())
    left = "t.g" if whole else "t.g - o.g" if hold is None else f"t.g - CASE WHEN o.fold = '{hold}' THEN 0 ELSE o.g END"
    trains = "" if hold is None else f"WHERE fold <> '{hold}' "
    variance = "sq / n - (sum_j / n) ** 2" if rescale else "all_sq / all_n - (all_j / all_n) ** 2"
    return f"""WITH RECURSIVE {rows(n)},
s AS ({some}),
alphas AS (SELECT unnest({[float(a) for a in alphas]}::DOUBLE[]) AS alpha),
z AS (SELECT features, fold, list_concat([1.0], x, [y]) AS z FROM s),
own AS (SELECT features, fold, i, j, sum(z[i] * z[j]) AS g FROM z, unnest(range(1, len(z) + 1)) AS a(i), unnest(range(1, len(z) + 1)) AS b(j) GROUP BY ALL),
tot AS (SELECT features, i, j, sum(g) AS g FROM own {trains}GROUP BY ALL),
gram AS (SELECT o.features, o.fold, o.i, o.j, {left} AS g, t.g AS t FROM own o JOIN tot t ON t.features = o.features AND t.i = o.i AND t.j = o.j),
side AS (SELECT s.features, s.fold, s.j, s.g AS sum_j, s.t AS all_j, d.g AS sq, d.t AS all_sq, max(CASE WHEN s.j = 1 THEN s.g END) OVER w AS n, max(CASE WHEN s.j = 1 THEN s.t END) OVER w AS all_n, max(s.j) OVER w AS last
  FROM gram s JOIN gram d ON d.features = s.features AND d.fold = s.fold AND d.i = s.j AND d.j = s.j WHERE s.i = 1 WINDOW w AS (PARTITION BY s.features, s.fold)),
scaled AS (SELECT features, fold, j, sum_j / n AS mean, n, last, CASE WHEN j = last OR j = 1 THEN 1.0 ELSE 1 / sqrt({variance}) END AS inv FROM side),
mat AS (SELECT g.features, g.fold, al.alpha, g.i - 1 AS i, list((g.g - a.n * a.mean * b.mean) * a.inv * b.inv + CASE WHEN g.i = g.j THEN al.alpha ELSE 0 END ORDER BY g.j) AS r
  FROM gram g JOIN scaled a ON a.features = g.features AND a.fold = g.fold AND a.j = g.i JOIN scaled b ON b.features = g.features AND b.fold = g.fold AND b.j = g.j, alphas al WHERE g.i > 1 AND g.i < a.last AND g.j > 1 GROUP BY ALL),
e AS (SELECT 1 AS k, * FROM mat UNION ALL SELECT e.k + 1, e.features, e.fold, e.alpha, e.i, CASE WHEN e.i = e.k THEN list_transform(e.r, lambda v: v / e.r[e.k]) ELSE list_transform(list_zip(e.r, p.r), lambda v: v[1] - e.r[e.k] / p.r[e.k] * v[2]) END
  FROM e JOIN e AS p ON p.features = e.features AND p.fold = e.fold AND p.alpha = e.alpha AND p.i = e.k WHERE e.k < len(e.r)),
fit AS (SELECT e.features, e.fold, e.alpha, any_value(y.mean) - sum(e.r[len(e.r)] * d.inv * d.mean) AS intercept, list(e.r[len(e.r)] * d.inv ORDER BY e.i) AS beta, list(d.mean ORDER BY e.i) AS mean
  FROM e JOIN scaled d ON d.features = e.features AND d.fold = e.fold AND d.j = e.i + 1 JOIN scaled y ON y.features = e.features AND y.fold = e.fold AND y.j = y.last WHERE e.k = len(e.r) GROUP BY ALL),
oof AS (SELECT s.features, alpha, vec_id, s.fold, y, x, beta, mean, intercept + list_dot_product(beta, x) AS oof FROM s JOIN fit ON fit.features = s.features AND fit.fold = s.fold)"""


def leverages(n: int, alphas: Sequence[float]) -> str:
    """models() of one model over all n features, and `h` (alpha, vec_id, e, h): each row's error and leverage, from the inverse."""
    return f"""{models(n, {"all": "x"}, alphas, whole=True)},
q AS (SELECT 1 AS k, alpha, i, list_concat(r[1:{n}], list_transform(range(1, {n + 1}), lambda j: CASE WHEN j = i THEN 1.0 ELSE 0.0 END)) AS r FROM mat UNION ALL SELECT q.k + 1, q.alpha, q.i, CASE WHEN q.i = q.k THEN list_transform(q.r, lambda v: v / q.r[q.k]) ELSE list_transform(list_zip(q.r, p.r), lambda v: v[1] - q.r[q.k] / p.r[q.k] * v[2]) END
  FROM q JOIN q AS p ON p.alpha = q.alpha AND p.i = q.k WHERE q.k <= {n}),
u AS (SELECT alpha, vec_id, y - oof AS e, c.n, list_transform(list_zip(x, mean, c.inv), lambda v: (v[1] - v[2]) * v[3]) AS u FROM oof, (SELECT any_value(n) AS n, list(inv ORDER BY j) AS inv FROM scaled WHERE j > 1 AND j < last) AS c),
h AS (SELECT u.alpha, vec_id, any_value(e) AS e, any_value(1 / n) + sum(u[i] * list_dot_product(r[{n + 1}:{2 * n}], u)) AS h FROM u JOIN q ON q.alpha = u.alpha WHERE q.k = {n + 1} GROUP BY 1, 2)"""


def solved(grams: str, name: str, p: int, alpha: float) -> str:
    """The table `name` (key, intercept, beta): ridge on p features as they are, from a table of Gram entries (key, i, j, g) over (1, features, target)."""
    pick = lambda alias, of, i: f"JOIN {grams} {alias} ON {alias}.key = {of}.key AND {alias}.i = {i} AND {alias}.j = 1"
    return f"""{name}_m AS (SELECT g.key, g.i - 1 AS i, list(g.g - a.g * b.g / n.g + CASE WHEN g.i = g.j THEN {alpha} ELSE 0 END ORDER BY g.j) AS r FROM {grams} g {pick("a", "g", "g.i")} {pick("b", "g", "g.j")} {pick("n", "g", 1)} WHERE g.i > 1 AND g.i < {p + 2} AND g.j > 1 GROUP BY ALL),
{name}_e AS (SELECT 1 AS k, * FROM {name}_m UNION ALL SELECT e.k + 1, e.key, e.i, CASE WHEN e.i = e.k THEN list_transform(e.r, lambda v: v / e.r[e.k]) ELSE list_transform(list_zip(e.r, q.r), lambda v: v[1] - e.r[e.k] / q.r[e.k] * v[2]) END FROM {name}_e e JOIN {name}_e q ON q.key = e.key AND q.i = e.k WHERE e.k <= {p}),
{name} AS (SELECT e.key, any_value(y.g / n.g) - sum(e.r[{p + 1}] * a.g / n.g) AS intercept, list(e.r[{p + 1}] ORDER BY e.i) AS beta FROM {name}_e e {pick("a", "e", "e.i + 1")} {pick("n", "e", 1)} {pick("y", "e", p + 2)} WHERE e.k = {p + 1} GROUP BY e.key)"""
