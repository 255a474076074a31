"""Operators on tiny tables, with values worked by hand or by numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.functions import text as X
from arealis.operators import intervals as I  # noqa: E741
from arealis.operators import joins as J
from arealis.operators import linear as L
from arealis.operators import panel as P
from arealis.operators import slopes as S
from arealis.sources import io


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


@pytest.mark.parametrize(("cell", "value"), [("26[d]", 26.0), ("0,5", 0.5), ("<1", 1.0), ("—", None), ("32 Doucet", 32.0), ("12 %", 12.0), (None, None), ("", None)])
def test_poll_values(spark, cell, value):
    assert one(spark, X.poll_value, cell) == value


@pytest.mark.parametrize(("cell", "day"), [("5-10 mars 2026", dt.date(2026, 3, 10)), ("30 juin 2024", dt.date(2024, 6, 30)), ("mars 2026", dt.date(2026, 3, 15)), ("28 février - 2 mars 2026", dt.date(2026, 3, 2)), ("nan", None), (None, None), ("31 février 2024", None)])
def test_french_dates(spark, cell, day):
    assert one(spark, X.french_date, cell) == day


@pytest.mark.parametrize(("cell", "day"), [("2024-06-20", dt.date(2024, 6, 20)), ("2024-06", dt.date(2024, 6, 15)), ("2024", dt.date(2024, 6, 15)), ("nan", None), (None, None)])
def test_iso_dates(spark, cell, day):
    assert one(spark, X.iso_date, cell) == day


def test_codes(spark):
    assert one(spark, X.department, "97411_1") == "974" and one(spark, X.department, "01001_1") == "01"
    assert one(spark, X.rekey_padded, "01001_1") == "01001_0001"
    assert one(spark, X.territory, "2A004_1") == "corsica" and one(spark, X.territory, "98735_2") == "polynesia"
    assert one(spark, X.normalised_name, " Éric-O'Neil  ÇA ") == "eric o neil ca"
    assert one(spark, lambda c: X.city_from_file(c, "sondages_"), "/a/sondages_saint_denis.csv") == "Saint Denis"
    assert one(spark, lambda c: X.expand_group(c, {"UG": ["SOC", "COM"]}), "UG") == ["COM", "SOC", "UG"]
    heads = spark.createDataFrame([(["A-B", "C+D", "E"],), (["A", "B"],)], "h array<string>")
    assert [r[0] for r in heads.select(X.round_from_columns(F.col("h"))).collect()] == [2, 1]


def test_shares_and_contested(spark):
    df = spark.createDataFrame([("u", 1, "G", 30.0), ("u", 1, "D", 10.0), ("v", 1, "G", 0.0), ("v", 1, "D", 0.0), ("w", 1, "G", 5.0), (None, 1, "G", 5.0)], "unit string, event int, block string, votes double")
    got = {(r.unit, r.block): r.share for r in P.share(df, ["unit", "event"], "votes").collect()}
    assert got == {("u", "G"): 75.0, ("u", "D"): 25.0, ("v", "G"): None, ("v", "D"): None, ("w", "G"): 100.0}
    assert {r.unit for r in P.contested(df.dropna(), ["unit", "event"]).collect()} == {"u", "v"}


def test_lag_repair(spark):
    """A unit whose size quadruples and a new unit take their parent's mean."""
    rows = [("a", "p", 1, 10.0, 300.0), ("a", "p", 2, 20.0, 1200.0), ("b", "p", 1, 30.0, 100.0), ("b", "p", 2, 40.0, 120.0), ("c", "p", 2, 50.0, 100.0)]
    df = spark.createDataFrame(rows, "unit string, parent string, event int, x double, size double")
    got = {(r.unit, r.event): (r.x_lag, r.lag_fallback) for r in P.repaired_lags(df, "unit", "parent", ["event"], ["x"], "size").collect()}
    assert got == {("a", 1): (None, True), ("a", 2): (20.0, True), ("b", 1): (None, True), ("b", 2): (30.0, False), ("c", 2): (20.0, True)}


def test_leader_ties(spark):
    df = spark.createDataFrame([(40.0, 40.0, 20.0), (None, 1.0, 2.0)], "G double, CD double, ED double")
    assert [(r.lead, r.runner_up, r.margin) for r in P.leader(df, ["G", "CD", "ED"]).collect()] == [("G", "CD", 0.0), ("ED", "CD", 1.0)]


def test_rollup_with_zero_weights(spark):
    df = spark.createDataFrame([("p", 10.0, 0.0), ("p", 30.0, 0.0), ("q", 10.0, 1.0), ("q", 30.0, 3.0)], "parent string, x double, w double")
    assert {r.parent: r.x for r in P.rollup(df, ["parent"], ["x"], "w").collect()} == {"p": 20.0, "q": 25.0}


def test_asof(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, None, 9), (4, "k", None), (5, "j", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 5, 7.0), ("k", 4, 6.0), ("k", 3, None), ("j", 9, 1.0)], "k string, at int, v double")
    got = {r.id: r.v for r in J.asof(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {1: 7.0, 2: None, 3: None, 4: None, 5: 1.0}
    got = {r.id: r.v for r in J.asof(left, right, ["k"], "t", "at", ["v"], strict=True).collect()}
    assert got == {1: 6.0, 2: None, 3: None, 4: None, 5: None}


def test_asof_has_one_window_and_no_product(spark):
    left = spark.createDataFrame([(1, "k", 5)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 5, 7.0, 8.0)], "k string, at int, v double, w double")
    plan = J.asof(left, right, ["k"], "t", "at", ["v", "w"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Join" not in plan


def test_rules_in_order(spark):
    rules = [("exact", {"NC": "none"}), ("prefix", [("BC-U", "left"), ("BC-", "other joint")]), ("substring", [("RN", "right")])]
    got = [one(spark, lambda c: J.rule_chain(c, rules, "unknown"), x) for x in ("NC", "BC-UGE", "BC-RN", "xRNx", "zz", None)]
    assert got == ["none", "left", "other joint", "right", "unknown", "unknown"]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) * [1, 2, 3, 4, 5]
    y = x @ [1, -1, 0.5, 0, 2] + rng.normal(size=200) + 3
    fold = rng.integers(0, 4, 200)
    df = spark.createDataFrame([(int(f), *map(float, r), float(v)) for f, r, v in zip(fold, x, y)], "fold int, a double, b double, c double, d double, e double, y double").repartition(5)
    return df, x, y, fold


NAMES = list("abcde")


def ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / s
    return beta, y.mean() - beta @ m


def test_ridge_and_folds(spark, sample):
    df, x, y, fold = sample
    g = L.grams(df.union(df.limit(1).withColumn("a", F.lit(None).cast("double"))), NAMES, ["y"], "fold")
    assert np.allclose(g.total[1:6, 1:6], x.T @ x)
    beta, b0 = ridge(x, y, 3.0)
    fit = L.solve(g.total, NAMES, 0, 3.0)
    assert np.allclose(fit.coefficients, beta, atol=1e-8) and fit.intercept == pytest.approx(b0)
    oof = {(r.a, r.fold): r.oof for r in L.out_of_fold(df, g, "fold", 0, 3.0, rescale=True).collect()}
    for f in range(4):
        beta, b0 = ridge(x[fold != f], y[fold != f], 3.0)
        for r in x[fold == f][:5]:
            assert oof[(r[0], f)] == pytest.approx(r @ beta + b0)
    part = g.subset(["a", "c"])
    assert np.allclose(L.solve(part.total, ["a", "c"], 0, 1.0).coefficients, ridge(x[:, [0, 2]], y, 1.0)[0])


def test_press(spark, sample):
    df, x, y, _ = sample
    g = L.grams(df, NAMES, ["y"])
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    got = L.press(df, g, 0, [0.5, 20.0])
    for alpha, value in got.items():
        hat = z @ np.linalg.inv(z.T @ z + alpha * np.eye(5)) @ z.T + 1 / len(y)
        assert value == pytest.approx(np.mean(((y - hat @ y) / (1 - np.diag(hat))) ** 2))


def test_principal_components(spark, sample):
    df, x, y, _ = sample
    g = L.grams(df, NAMES, ["y"])
    assert np.allclose(L.solve(g.total, NAMES, 0, 2.0, pca=(3, 3)).coefficients, L.solve(g.total, NAMES, 0, 2.0).coefficients)
    assert not np.allclose(L.solve(g.total, NAMES, 0, 2.0, pca=(3, 1)).coefficients, L.solve(g.total, NAMES, 0, 2.0).coefficients)


def test_quantile_levels(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=150), 2)
    df = spark.createDataFrame([(float(x), int(i % 3 > 0)) for i, x in enumerate(v)], "r double, k int")
    for part, key in ((v, []), (v[np.arange(150) % 3 == 0], ["k"])):
        want = np.quantile(np.abs(part), min(1, 0.9 * (1 + 1 / len(part))))
        found = I.half_widths(df, "r", 0.1, key)
        assert (found.where("k = 0") if key else found).first().half_width == pytest.approx(want)
    widths = [I.half_widths(df, "r", a).first().half_width for a in (0.5, 0.2, 0.1, 0.0)]
    assert widths == sorted(widths) and widths[-1] == np.abs(v).max()
    few = {r.k: r.half_width for r in I.by_class(df, "r", 0.1, "k", least=60).collect()}
    assert few[0] == pytest.approx(I.half_widths(df, "r", 0.1).first().half_width)


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.round(rng.normal(size=900), 1), rng.normal(size=600), np.full(300, 0.25)])
    df = spark.createDataFrame([(float(x), int(i % 7 % 3)) for i, x in enumerate(v)] + [(None, 1), (None, 9)], "v double, k int")
    levels = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    for cells in (2, 10, 100):
        found = P.quantiles(df, "v", lambda n: [F.lit(x) for x in levels], cells=cells).collect()
        assert len(found) == 1 and found[0].n == len(v) and np.allclose(found[0].quantiles, np.quantile(v, levels))
    got = {r.k: r.quantiles for r in P.quantiles(df, "v", lambda n: [F.lit(x) for x in levels], ["k"], cells=5).collect()}
    assert sorted(got) == [0, 1, 2]
    for k, q in got.items():
        assert np.allclose(q, np.quantile(v[np.arange(len(v)) % 7 % 3 == k], levels))
    assert not P.quantiles(df.where("v is null"), "v", lambda n: [F.lit(0.5)]).collect()
    assert P.in_bins(df, "v", 4).where("k = 9").count() == 1
    assert P.in_bins(df.where("v is null"), "v", 4).count() == 2


def test_mask(spark):
    df = spark.createDataFrame([(50.0, 30.0, 20.0, True, False, True), (5.0, 5.0, 5.0, False, False, False)], "A double, B double, C double, has_a boolean, has_b boolean, has_c boolean")
    got = [tuple(r)[:3] for r in I.masked(df, {"A": "has_a", "B": "has_b", "C": "has_c"}, 1.0).collect()]
    assert got[0] == pytest.approx((50 + 30 * 5 / 7, 0, 20 + 30 * 2 / 7)) and got[1] == (0, 0, 0)


def test_slopes(spark):
    rng = np.random.default_rng(2)
    rows = [(u, float(x), float(2 * x + u + e)) for u in range(6) for x, e in zip(rng.normal(size=9), rng.normal(size=9) * 0.3)]
    df = spark.createDataFrame(rows, "u int, x double, y double")
    for r in S.ols(df, ["u"], "x", "y").collect():
        own = np.array([(x, y) for u, x, y in rows if u == r.u])
        assert r.slope == pytest.approx(np.polyfit(own[:, 0], own[:, 1], 1)[0])
    raw, drawn = (np.array([r[c] for r in S.shrink(S.ols(df, ["u"], "x", "y")).orderBy("u").collect()]) for c in ("slope", "shrunk"))
    assert drawn.std() <= raw.std()
    band = S.bootstrap_band(df, "u", "x", "y", row=("u", "x")).collect()
    assert len(band) == 6 and all(r.low <= r.high for r in band)
    curve = S.apply_curve(spark.createDataFrame([(0.0,), (1.5,), (9.0,), (None,)], "v double"), [(1.0, 0.2), (2.0, 0.4)], "v")
    assert [r.gamma for r in curve.collect()] == [0.2, pytest.approx(0.3), 0.4, None]


def test_weights_that_cannot_be_negative():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 3))
    y = x @ [0.7, 0.0, 0.3] - 0.5 * x[:, 1]
    w = L.nonnegative(x.T @ x, x.T @ y)
    assert (w >= 0).all() and w[1] == 0


def test_files(spark, tmp_path):
    (tmp_path / "t" / "pres" / "x").mkdir(parents=True)
    (tmp_path / "t" / "municipal").mkdir()
    (tmp_path / "t" / "pres" / "x" / "poll_t2.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t" / "municipal" / "c.csv").write_text("a\n1\n")
    got = {(r.kind, r.round) for r in io.polls_tree(spark, str(tmp_path / "t"), {"pres": "Presidentielles"}).collect()}
    assert got == {("Presidentielles", 2)}
    p = tmp_path / "long.csv"
    p.write_text("candidat,parti,intentions,nom_institut,fin_enquete,tour\nX,P,\"12,5\",I,2024-06-20,1\nY,P,—,I,2024-06-20,1\n")
    assert [(r.candidate, r.value, r.date) for r in io.polls_long(spark, str(p)).collect()] == [("X", 12.5, dt.date(2024, 6, 20))]
    (tmp_path / "census.csv").write_text("CODGEO;P21_POP;P21_MEN\n01001;10;4\n1002.0;20,5;\n")
    census = {r.CODGEO: r.P21_POP for r in io.census(spark, str(tmp_path / "census.csv"), "CODGEO", 5).collect()}
    assert census == {"01001": 10.0, "01002": 20.5}
    wide = spark.createDataFrame([("I", "5-10 mars 2026", "26[d]", "—"), ("J", "2026-03-11", "<1", "12 %")], "Sondeur string, Dates string, `LFI[a]` string, PS string")
    long = {(r.institute, r.party): (r.date, r.value) for r in io.wide_to_long(wide, [], "Sondeur", "Dates").collect()}
    assert long == {("I", "LFI"): (dt.date(2026, 3, 10), 26.0), ("J", "LFI"): (dt.date(2026, 3, 11), 1.0), ("J", "PS"): (dt.date(2026, 3, 11), 12.0)}
    assert io.survey_columns(["Source", "Fieldwork date", "Polling firm", "Candidate A", "PS", "Abs.", "Unnamed: 7", "date fin"]) == ("Fieldwork date", "Polling firm", ["Candidate A", "PS"])
    assert io.wide_to_long(wide.drop("Dates")).count() == 0 and {r.institute for r in io.wide_to_long(wide.drop("Sondeur")).collect()} == {"unknown"}
    assert io.wide_to_long(wide.select("Sondeur", "Dates")).count() == 0
    (tmp_path / "geo.json").write_text('{"type":"Feature","properties":{"codeBureauVote":"1","codeCommune":"c"},"geometry":{"type":"Polygon","coordinates":[[[0.0,0.0],[2.0,0.0],[2.0,2.0],[0.0,2.0]]]}}\n')
    r = io.boundaries(spark, str(tmp_path / "geo.json")).first()
    assert (r.unit, r.lon, r.lat) == ("1", 1.0, 1.0)


def test_materialise_and_sinks(spark, tmp_path, small):
    nation = spark.read.parquet(f"{small}/nation.parquet")
    path = f"{tmp_path}/kept"
    assert io.materialise(nation, path).count() == nation.count()
    assert io.materialise(nation.limit(1), path).count() == nation.count()
    io.write_json(nation, f"{tmp_path}/json", "n_regionkey")
    assert spark.read.json(f"{tmp_path}/json").count() == nation.count()
    io.write_csv(nation, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == nation.count()
    arrays = io.parallel_arrays(nation, ["n_regionkey"], "n_nationkey", ["n_name"]).collect()
    assert all(r.n_nationkey == sorted(r.n_nationkey) and len(r.n_name) == len(r.n_nationkey) for r in arrays)


def test_no_window_holds_a_whole_event(spark, small):
    """Event means are averaged in part and joined back; the model choice needs one scan."""
    from pyspark.sql import functions as F

    from arealis.operators import linear as L
    from arealis.plans.catalog import QUERIES, Tables
    from arealis.plans.model_queries import features

    for name in ("win_delta_from_event_mean", "cf_variance_split", "agg_weighted_coverage", "st_gamma_flat"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert not any("windowspecdefinition(event#" in x and "ASC" not in x for x in plan.splitlines()), name
    x, names = features(Tables(spark, small), 8)
    g = L.grams(x, names, ["y"], "fold")
    scored = L.metrics(L.out_of_fold(x, g, "fold", 0, 0.1), "y", "oof").first()
    assert abs(L.fold_r2(g, 0, 0.1) - scored.r2) < 1e-9
    z = x.withColumn("fold", F.when(F.col("vec_id") % 3 == 0, None).otherwise(F.col("fold")))  # a null fold is one of its own
    assert abs(L.grams(z, names, ["y"], "fold").total - g.total).max() < 1e-6


def test_large_tables_are_read_once(spark, small):
    """The panel and all that is joined to it come from stored sums, not from the lines and orders each time."""
    from arealis.plans.catalog import QUERIES, Tables
    from arealis.plans.model_queries import residuals

    tables = Tables(spark, small)
    for df in (tables.panel(), residuals(tables), QUERIES["cf_coverage"](spark, small), QUERIES["agg_weighted_coverage"](spark, small)):
        assert "l_quantity" not in df._jdf.queryExecution().optimizedPlan().toString()
    cells = tables.cells
    assert cells is not None and tables.panel().count() > 0 and tables.cells is cells


def test_component_shares(spark, small):
    import numpy as np

    from arealis.plans.catalog import QUERIES

    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r.vec_id):
        groups.setdefault(r.label, []).append(r.embedding)
    d = np.concatenate([np.diff(np.array(v, float), axis=0) for v in groups.values() if len(v) > 1])
    values = np.linalg.eigvalsh(np.corrcoef(d.T))[::-1]
    got = [r.share for r in QUERIES["ml_delta_pca"](spark, small).orderBy("component").collect()]
    assert np.allclose(got, (values / values.sum())[:5])


def test_lag_across(spark):
    """Equals a window's lag, whatever range a row falls into; null keys are a key, and ranges may be empty."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from arealis.operators import panel as P

    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, rng.random()])) for i in range(300)] + [("c", 1000, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    want = df.withColumn("v_lag", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    assert sorted(map(repr, P.lag_across(df.repartition(3), ["k"], ["t"], ["v"]).collect())) == sorted(map(repr, want.collect()))
    assert P.lag_across(df.limit(0), ["k"], ["t"], ["v"]).count() == 0


def moved(spark, seed=2):
    """Units in two groups over seven events, with nulls; unit slopes differ."""
    import random

    rng = random.Random(seed)
    tide = [rng.uniform(-3, 3) for _ in range(7)]
    rows = []
    for u in range(12):
        slope, level = 0.2 + 0.15 * u, 20.0
        for e, x in enumerate(tide):
            dy = slope * x + rng.gauss(0, 0.3)
            rows.append((u, u % 2, 2000 + e, level, x, dy if rng.random() > 0.05 else None))
            level += dy
    return rows, spark.createDataFrame(rows, "unit int, parent int, event int, p double, dx double, dy double")


def test_slope_backtest_sees_earlier_events_only(spark):
    import numpy as np

    from arealis.operators import backtests as B

    rows, df = moved(spark)
    own = {(r.unit, r.event): (r.n, r.slope, r.se) for r in B.rolling_slopes(df, ["unit"], "event", "dx", "dy").collect()}
    for (u, e), (n, slope, se) in own.items():
        x, y = (np.array([r[i] for r in rows if r[0] == u and r[2] < e and r[5] is not None]) for i in (4, 5))
        b, a = np.polyfit(x, y, 1)
        assert n == len(x) and abs(b - slope) < 1e-9
        assert abs(se - np.sqrt(((y - a - b * x) ** 2).mean() / max(n - 2, 1) / x.var())) < 1e-9
    got = {(r.event, r.method): r for r in B.slope_backtest(df, "unit", "parent", "event", "dx", "dy").collect()}
    last = max(e for e, _ in got)
    assert got[last, "unit"].rmse < got[last, "uniform"].rmse and got[last, "unit"].het_corr > 0.5 and got[last, "uniform"].het_corr is None
    # what comes later changes nothing
    again = {(r.event, r.method): r for r in B.slope_backtest(df.where(f"event < {last}"), "unit", "parent", "event", "dx", "dy").collect()}
    assert set(again) == {k for k in got if k[0] < last} and all(abs(r.rmse - got[k].rmse) < 1e-9 for k, r in again.items())
    assert B.slope_backtest(df.limit(0), "unit", "parent", "event", "dx", "dy").count() == 0


def test_response_backtest(spark):
    import numpy as np

    from arealis.operators import backtests as B

    rows, df = moved(spark, 3)
    got = {(r.event, r.method): r for r in B.response_backtest(df, "unit", "event", "p", "dx", "dy", bins=3, width=0.5).collect()}
    ok = [r for r in rows if r[5] is not None]
    for (e, method), r in got.items():
        past, now = [x for x in ok if x[2] < e], [x for x in ok if x[2] == e]
        flat = sum(x[4] * x[5] for x in past) / sum(x[4] ** 2 for x in past)
        assert r.n == len(now)
        if method == "flat":
            assert abs(r.rmse - np.sqrt(np.mean([(x[5] - flat * x[4]) ** 2 for x in now]))) < 1e-9 and r.het_corr is None
        if method == "curve":
            cells = {}
            for x in past:
                c = cells.setdefault(int(np.floor(x[3] / 0.5)), [0, 0.0, 0.0, 0.0])
                for i, v in enumerate((1, x[3], x[4] * x[5], x[4] ** 2)):
                    c[i] += v
            bins, done = {}, 0
            for c in sorted(cells):
                b = bins.setdefault(int(3 * (done + cells[c][0] / 2) / len(past)), [0, 0.0, 0.0, 0.0])
                bins[int(3 * (done + cells[c][0] / 2) / len(past))] = [p + q for p, q in zip(b, cells[c])]
                done += cells[c][0]
            points = sorted((b[1] / b[0], b[2] / b[3]) for b in bins.values())
            g = np.clip(np.interp([x[3] for x in now], *zip(*points)), 0, 1)
            assert abs(r.rmse - np.sqrt(np.mean([(x[5] - k * x[4]) ** 2 for k, x in zip(g, now)]))) < 1e-9
    assert {m for _, m in got} == {"flat", "curve", "unit"} and min(e for e, _ in got) == 2001
    assert B.response_backtest(df.limit(0), "unit", "event", "p", "dx", "dy").count() == 0


def test_within_across_and_stability(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from arealis.operators import backtests as B

    rng = np.random.default_rng(5)
    rows = []
    for e in range(4):
        for u in range(40):
            z = rng.normal(size=2)
            x = float(rng.uniform(0.5, 2))
            rows.append((u, e, "a" if u % 2 else "b", 10 + float(z[0]), float(z[0]), float(z[1]), x, float(x * (0.5 + 0.1 * z[0] * (1 if e % 2 else -1) + 0.02 * rng.normal()))))
    df = spark.createDataFrame([*rows, (99, 1, "a", None, 0.0, 0.0, 1.0, 1.0), (98, 1, "b", 1.0, 0.0, 0.0, 0.0, 1.0)], "unit int, event int, half string, p double, z0 double, z1 double, dx double, dy double")

    def fit(some):
        z, w = np.array([r[4:6] for r in some]), np.array([r[6] ** 2 for r in some])
        y = np.array([r[7] / r[6] for r in some])
        mz, my = w @ z / w.sum(), w @ y / w.sum()
        beta = np.linalg.solve((z - mz).T @ ((z - mz) * w[:, None]) + 2.0 * np.eye(2), (z - mz).T @ (w * (y - my)))
        return my - beta @ mz, beta

    got = {(r.event, r.method): r for r in B.within_across(df, "event", "half", ["z0", "z1"], "p", "dx", "dy", 2.0, bins=4).collect()}
    assert {e for e, _ in got} == {1, 2, 3}
    for e in (1, 2, 3):
        tried = [r for r in rows if r[1] == e and r[2] == "b"]
        for method, some in (("within", [r for r in rows if r[1] == e and r[2] == "a"]), ("across", [r for r in rows if r[1] < e])):
            a, b = fit(some)
            p = [np.clip(a + b @ np.array(r[4:6]), 0, 1) * r[6] for r in tried]
            assert abs(got[e, method].rmse - np.sqrt(np.mean([(r[7] - q) ** 2 for r, q in zip(tried, p)]))) < 1e-9
        assert got[e, "within"].rmse < got[e, "across"].rmse  # the pattern turns round at each event
    stable = {(r.event_a, r.event_b): r for r in B.coefficient_stability(df, "event", ["z0", "z1"], "dx", "dy", 2.0).collect()}
    assert set(stable) == {(a, b) for a in range(4) for b in range(a + 1, 4)} and all(r.same_direction for r in stable.values())
    beta = [fit([r for r in rows if r[1] == e])[1] for e in range(4)]
    assert abs(stable[0, 2].r - np.corrcoef(beta[0], beta[2])[0, 1]) < 1e-9
    assert B.within_across(df.limit(0), "event", "half", ["z0", "z1"], "p", "dx", "dy", 2.0).count() == 0
    assert B.coefficient_stability(df.where(F.lit(False)), "event", ["z0", "z1"], "dx", "dy", 2.0).count() == 0


def test_level_rules(spark):
    """Left-out guesses by brute force, with a series of one event, one kind and a survey."""
    import numpy as np

    from arealis.operators import levels as E

    rows = [("s", "x", 1.0, 10.0), ("s", "y", 2.5, 12.0), ("s", "x", 3.0, 11.0), ("s", "y", 6.0, 16.0), ("s", "x", 7.0, 15.0), ("one", "x", 1.0, 5.0), ("polled", "x", 1.0, 5.0), ("polled", "x", 2.0, 7.0)]
    df = spark.createDataFrame(rows, "series string, kind string, t double, level double")
    surveys = spark.createDataFrame([("polled", 6.5), ("nobody", 1.0)], "series string, survey double")
    got = {r.series: r for r in E.choose_rule(df, "series", "kind", "t", "level", 9.0, "x", surveys).collect()}
    t, y, kinds = np.array([1.0, 2.5, 3.0, 6.0, 7.0]), np.array([10.0, 12, 11, 16, 15]), "xyxyx"
    gap, guesses = np.diff(t), {r: {} for r in E.RULES}
    for i in range(5):
        others = [k for k in range(5) if k != i]
        if i:
            ok = [k for k in others if k]
            b, a = np.polyfit(gap[[k - 1 for k in ok]], y[ok], 1)
            guesses["gap"][i] = a + b * gap[i - 1]
            guesses["last"][i] = y[i - 1]
        same = [k for k in others if kinds[k] == kinds[i]]
        guesses["same_mean"][i], guesses["mean"][i] = y[same].mean(), y[others].mean()
        if [k for k in same if k < i]:
            guesses["last_same"][i] = y[max(k for k in same if k < i)]
    rmse = {r: np.sqrt(np.mean([(y[i] - v) ** 2 for i, v in g.items()])) for r, g in guesses.items()}
    for r, e in rmse.items():
        assert abs(got["s"][f"rmse_{r}"] - e) < 1e-9
    assert got["s"].best == min(rmse, key=rmse.get)
    assert (got["polled"].best, got["polled"].predicted) == ("survey", 6.5)
    assert got["one"].best is None and got["one"].predicted is None
    assert E.choose_rule(df.limit(0), "series", "kind", "t", "level", 9.0, "x").count() == 0


def test_interval_methods_on_odd_tables(spark):
    from pyspark.sql import functions as F

    from arealis.operators import intervals as I  # noqa: E741

    rows = [(i, f"t{i % 3}" if i % 7 else None, float(i % 11), float(i % 5), 1.0 + i % 2, i % 4 != 0, i < 60) for i in range(90)] + [(90, "new", 5.0, 4.0, 1.0, True, False), (91, "t1", None, 1.0, 1.0, True, True), (92, "t1", 1.0, None, 1.0, True, False)]
    df = spark.createDataFrame(rows, "id int, terr string, y double, p double, w double, here boolean, cal boolean")
    got = {(r.method, r.alpha, r["class"]): r for r in I.run_methods(df, "y", "p", F.col("cal"), [0.2, 0.5], "w", "terr", "p", "here", bins=2, least=5).collect()}
    assert {m for m, _, _ in got} == {"standard", "territory", "adaptive", "masked"}
    assert got["standard", 0.2, "all"].n == 31 and got["territory", 0.2, "new"].n == 1
    assert got["territory", 0.2, "none"].n == sum(i % 7 == 0 for i in range(60, 90))
    assert all(0 <= r.coverage <= 1 and r.width <= 100 and r.median_width <= 100 for r in got.values())
    assert sum(r.n for k, r in got.items() if k[:2] == ("adaptive", 0.5)) == 31
    assert I.run_methods(df.limit(0), "y", "p", F.col("cal"), [0.2], "w", "terr", "p", "here").count() == 0


def test_rare_names_keep_null_keys(spark):
    from arealis.operators import joins as J

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert {(r.v, r.k) for r in J.rare_to_unknown(df, ["k"], "k", 2).collect()} == {("a", "1"), ("b", "1"), ("c", "unknown"), ("d", None), ("e", None)}


def plain_boost(x, y, w, teach, judge, depth, rounds, step, least, l2, patience):
    """Boosted trees by loops over rows; x: bins."""
    base = sum(w[i] * y[i] for i in teach) / sum(w[i] for i in teach)
    value, trees, errors = [base] * len(y), [], []
    out = [list(value)]

    def grow(rows, left):
        best, total = None, (sum(w[i] * (y[i] - value[i]) for i in rows), sum(w[i] for i in rows))
        for f in range(len(x[0])):
            for c in range(int(x.max())):
                a, b = [i for i in rows if x[i][f] <= c], [i for i in rows if x[i][f] > c]
                if min(len(a), len(b)) < max(1, least):
                    continue
                g = [(sum(w[i] * (y[i] - value[i]) for i in z), sum(w[i] for i in z)) for z in (a, b)]
                gain = round(sum(s * s / (n + l2) for s, n in g) - total[0] ** 2 / (total[1] + l2), 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, f, c, [step * s / (n + l2) for s, n in g], a, b
        if best is None:
            return None
        deeper = [grow(z, left - 1) if left > 1 else None for z in best[4:]]
        return best[1], best[2], best[3], deeper

    def leaf(tree, row):
        side = int(row[tree[0]] > tree[1])
        return leaf(tree[3][side], row) if tree[3][side] else tree[2][side]

    for _ in range(rounds):
        if judge:
            errors.append(sum(w[i] * (y[i] - value[i]) ** 2 for i in judge) / sum(w[i] for i in judge))
            if len(errors) - 1 - errors.index(min(errors)) >= patience:
                break
        tree = grow(teach, depth)
        if tree is None:
            break
        trees.append(tree)
        value = [v + leaf(tree, r) for v, r in zip(value, x)]
        out.append(list(value))
    return out[errors.index(min(errors))] if errors else out[-1]


def test_boosting_against_loops(spark):
    """All models of a pass, with nulls, weights, leaf minima, early stopping and an offset, equal trees grown row by row."""
    import numpy as np
    from pyspark.sql import functions as F

    from arealis.operators import trees as T

    rng = np.random.default_rng(8)
    n = 200
    x = rng.normal(size=(n, 3)).round(1)
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + 0.2 * rng.normal(size=n)
    w = rng.integers(1, 4, n).astype(float)
    rows = [(i, float(x[i, 0]) if i % 17 else None, float(x[i, 1]), float(x[i, 2]), float(y[i]) if i % 23 else None, float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y double, w double").repartition(3)
    third, half = F.col("id") % 3, F.col("id") % 2
    made = lambda: [T.Model("deep", third != 0, depth=3, rounds=6, step=0.3, leaf=0.05), T.Model("flat", third != 1, depth=1, rounds=5, step=0.5, l2=3.0), T.Model("stops", half == 0, half == 1, depth=2, rounds=30, step=0.6, leaf=0.02, patience=3), T.Model("rest", third != 2, offset=F.col("b"), depth=2, rounds=4, step=0.5), T.Model("none", F.lit(False), rounds=3)]
    models = made()
    got = {r.id: r for r in T.boost(df, ["a", "b", "c"], "y", models, "w", ["id"], bins=8, every=4, rows_per_task=90).collect()}
    assert len(got) == n
    bins = np.zeros((n, 3), int)
    for f in range(3):
        known = np.array([r[1 + f] is not None for r in rows])
        v = np.array([r[1 + f] for r in rows if r[1 + f] is not None])
        edges = sorted(set(np.quantile(v, np.arange(1, 8) / 8).tolist()))
        bins[known, f] = 1 + np.searchsorted(edges, v)
    ok = [i for i in range(n) if i % 23]
    cases = {"deep": (lambda i: i % 3 != 0, None, y, 3, 6, 0.3, 0.05, 0.0, 10), "flat": (lambda i: i % 3 != 1, None, y, 1, 5, 0.5, 0.0, 3.0, 10), "stops": (lambda i: i % 2 == 0, lambda i: i % 2 == 1, y, 2, 30, 0.6, 0.02, 0.0, 3), "rest": (lambda i: i % 3 != 2, None, y - x[:, 1], 2, 4, 0.5, 0.0, 0.0, 10)}
    for name, (trains, judges, target, depth, rounds, step, leaf, l2, patience) in cases.items():
        teach, judge = [i for i in ok if trains(i)], [i for i in ok if judges and judges(i)]
        want = plain_boost(bins, target, w, teach, judge, depth, rounds, step, leaf * len(teach), l2, patience)
        assert np.allclose([got[i][name] for i in range(n)], want, atol=1e-9), name
    assert 0 < len(models[2].trees) < 30 and all(got[i]["none"] == 0 for i in range(n))
    assert T.boost(df.limit(0), ["a", "b", "c"], "y", made(), "w", ["id"]).count() == 0


def test_boosting_deals_rows_to_all_cores(spark):
    """A table in one part is dealt to all cores, and a pass adds up what a plain walk down the trees gives."""
    import numpy as np
    from pyspark.sql import functions as F

    from arealis.operators import trees as T

    df = spark.range(0, 50_000, 1, 1).select("id", F.sin(F.col("id")).alias("a"), (F.col("id") % 7).alias("b"), (F.sin(F.col("id")) * (F.col("id") % 7)).alias("y"))
    done = T.boost(df, ["a", "b"], "y", [T.Model("m", F.col("id") % 5 != 0, rounds=3)], keep=["id"])
    assert done.rdd.getNumPartitions() >= min(4, spark.sparkContext.defaultParallelism) and done.count() == 50_000
    assert T.boost(df.limit(300), ["a", "b"], "y", [T.Model("m", F.lit(True), rounds=1)], keep=["id"]).rdd.getNumPartitions() == 1

    rng = np.random.default_rng(5)
    x = rng.integers(0, 33, (400, 3)).astype(np.uint8)
    trees, want = [], np.zeros(400)
    for levels in (0, 1, 2, 3, 9):
        inner = 2**levels - 1
        feature = [-1 if i and rng.random() < 0.3 else int(rng.integers(0, 3)) for i in range(inner)]
        for i in range(1, inner):
            feature[i] = -1 if feature[(i - 1) // 2] < 0 else feature[i]
        trees.append({"feature": feature, "cut": rng.integers(0, 32, inner).tolist(), "value": rng.normal(size=2 * inner + 1).tolist()})
        for r in range(400):
            at = 0
            while at < inner and feature[at] >= 0:
                at = 2 * at + 1 + int(x[r, feature[at]] > trees[-1]["cut"][at])
            want[r] += trees[-1]["value"][at]
    assert np.array_equal(T.tree_values(trees, np.ascontiguousarray(x.T)), want)
