"""Queries of file sources and sinks: a given table is written in a source's shape below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealis.functions import text as X
from arealis.operators import joins as J
from arealis.operators import panel as P
from arealis.plans.catalog import PANEL, Tables, query, rounded
from arealis.sources import io

NUMBER = "floor(value) + floor((value - floor(value)) * 100) / 100"
FIRM = "CASE WHEN user_id % 10 = 9 THEN 'unknown' ELSE 'I' || (user_id % 10) END"


def cell():
    """A reading as survey tables write it: a decimal comma, and by turns a footnote, a percent sign, a less-than sign."""
    whole, cents = F.floor("value").cast("string"), F.floor((F.col("value") - F.floor("value")) * 100).cast("string")
    number = F.concat(whole, F.lit(","), F.lpad(cents, 2, "0"))
    k = F.col("event_id") % 4
    return F.when(k == 0, F.concat(number, F.lit("[d]"))).when(k == 1, F.concat(number, F.lit(" %"))).when(k == 2, F.concat(F.lit("<"), number)).otherwise(number)


@query("src_polls_long", f"SELECT CAST(ts AS DATE) AS date, {FIRM} AS institute, event_type AS candidate, upper(event_type) AS party, CAST(1 + event_id % 2 AS VARCHAR) AS round, round({NUMBER}, 2) AS value FROM events")
def src_polls_long(spark, d):
    path = io.scratch(spark, "polls")
    firm = F.when(F.col("user_id") % 10 != 9, F.concat(F.lit("I"), (F.col("user_id") % 10).cast("string")))
    rows = Tables(spark, d).events.select(F.col("event_type").alias("candidat"), F.upper("event_type").alias("parti"), cell().alias("intentions"), firm.alias("nom_institut"), F.date_format("ts", "yyyy-MM-dd").alias("fin_enquete"), (1 + F.col("event_id") % 2).cast("string").alias("tour"))
    rows.write.csv(path, header=True)
    return io.polls_long(spark, path)


@query("src_polls_recursive", "SELECT CASE user_id % 2 WHEN 0 THEN 'Legislative' ELSE 'Presidential' END AS kind, CAST(1 + event_id % 2 AS INT) AS round, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE user_id % 5 <> 0 GROUP BY 1, 2")
def src_polls_recursive(spark, d):
    path = io.scratch(spark, "tree")
    kind = F.when(F.col("user_id") % 5 == 0, "municipales").when(F.col("user_id") % 2 == 0, "legislatives").otherwise("presidentielle")
    rows = Tables(spark, d).events.select(F.col("event_id").cast("string").alias("value"), kind.alias("kind"), F.concat(F.lit("tour_"), (1 + F.col("event_id") % 2).cast("string")).alias("turn"))
    for name in ("municipales", "legislatives", "presidentielle"):
        for turn in ("tour_1", "tour_2"):
            rows.where((F.col("kind") == name) & (F.col("turn") == turn)).select("value").write.csv(f"{path}/{name}/{turn}")
    read = io.polls_tree(spark, path, {"legi": "Legislative", "pres": "Presidential"})
    return read.groupBy("kind", "round").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("ids"))


def wide(t: Tables, kinds):
    """The largest reading of each kind per firm and day, as text; the date in words."""
    best = t.events.groupBy((F.col("user_id") % 10).alias("firm"), F.to_date("ts").alias("day")).pivot("event_type", kinds).agg(F.max(F.floor("value")).cast("long").cast("string"))
    said = [F.concat(F.col(k), F.lit("[a] %")).alias(f"{k.title()}[1]") for k in kinds]
    return best.select(F.concat(F.lit("Firm "), F.col("firm").cast("string")).alias("Sondeur"), F.concat(F.dayofmonth("day").cast("string"), F.lit(" janvier 2024")).alias("Date"), F.lit("1000").alias("Sample size"), *said, (F.col("firm") % 3).alias("city"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("src_polls_wide", "SELECT CAST(ts AS DATE) AS date, 'Firm ' || (user_id % 10) AS institute, upper(event_type) AS party, max(floor(value)) AS value FROM events GROUP BY 1, 2, 3")
def src_polls_wide(spark, d):
    path = io.scratch(spark, "wide")
    table = wide(Tables(spark, d), KINDS).drop("city").withColumnRenamed("Date", "Fieldwork date").withColumns({"Source": F.lit("web"), "Abs.": F.lit("31")})
    table.write.csv(path, header=True)
    return io.wide_to_long(spark.read.csv(path, header=True))


@query("src_polls_municipal", "SELECT 'City ' || (user_id % 10 % 3) AS city, CASE WHEN user_id % 10 % 3 = 2 THEN 2 ELSE 1 END AS round, CAST(ts AS DATE) AS date, 'Firm ' || (user_id % 10) AS institute, upper(event_type) || CASE WHEN user_id % 10 % 3 = 2 THEN '-X' ELSE '' END AS party, max(floor(value)) AS value FROM events WHERE user_id % 10 % 3 <> 1 OR event_type <> 'view' GROUP BY 1, 2, 3, 4, 5")
def src_polls_municipal(spark, d):
    """Three cities' tables: one with more columns that are no party's, one without a column, one whose headers name coalitions."""
    path, table = io.scratch(spark, "cities"), wide(Tables(spark, d), KINDS)
    names = [f"{k.title()}[1]" for k in KINDS]
    for city in range(3):
        own = [F.col(f"`{c}`").alias(c.replace("[", "-X[") if city == 2 else c) for c in (names[:-1] if city == 1 else names)]
        more = [F.col("Date").alias("Fieldwork date"), F.lit("web").alias("Source"), F.lit("31").alias("Abs.")] if city == 0 else ["Date"]
        table.where(F.col("city") == city).select("Sondeur", *more, "Sample size", *own).write.csv(f"{path}/polls_city_{city}.csv", header=True)
    return io.polls_municipal(spark, path, "polls_")


def census_counts(t: Tables, yy: str, shift: int = 0):
    """Customers per nation and market segment as the columns of a census file."""
    kinds = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    counts = t.customer.groupBy(F.col("c_nationkey").cast("string").alias("CODGEO")).pivot("c_mktsegment", kinds).count().fillna(0)
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return counts.select("CODGEO", (total + shift).alias(f"P{yy}_RP"), *[(F.col(k) + shift).alias(f"P{yy}_RP_{k}") for k in kinds])


COUNTS = "SELECT CAST(c_nationkey AS VARCHAR) AS CODGEO, count(*) AS t, count(*) FILTER (c_mktsegment = 'BUILDING') AS b, count(*) FILTER (c_mktsegment = 'MACHINERY') AS m FROM customer GROUP BY 1"


@query("src_census_csv", f"WITH c AS ({COUNTS}) SELECT CODGEO, CAST(t AS DOUBLE) AS P21_RP, CAST(b AS DOUBLE) AS P21_RP_BUILDING FROM c")
def src_census_csv(spark, d):
    path = io.scratch(spark, "census")
    census_counts(Tables(spark, d), "21").write.option("sep", ";").csv(path, header=True)
    return io.census(spark, path, "CODGEO").select("CODGEO", "P21_RP", "P21_RP_BUILDING")


@query("src_iris_csv", "SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS IRIS, round(c_acctbal, 2) AS P21_VALUE FROM customer")
def src_iris_csv(spark, d):
    path = io.scratch(spark, "iris")
    value = F.translate(F.format_string("%.2f", "c_acctbal"), ".", ",")
    Tables(spark, d).customer.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("IRIS"), value.alias("P21_VALUE")).write.option("sep", "\t").csv(path, header=True)
    return rounded(io.census(spark, path, "IRIS", 9), 2)


def vintages(spark, d):
    """Two vintages of two themes, in folders named by their year; the second file of a theme must be ignored."""
    path, t = io.scratch(spark, "vintages"), Tables(spark, d)
    for year, shift in ((2016, 0), (2021, 3)):
        table = census_counts(t, str(year)[2:], shift)
        for theme, sep in (("logement", ";"), ("population", ",")):
            table.coalesce(1).write.option("sep", sep).csv(f"{path}/{year}/base-{theme}", header=True)
        table.coalesce(1).write.csv(f"{path}/{year}/z-base-logement", header=False)
    return io.census_vintages(spark, path, {"housing": "logement", "people": "population"})


VINTAGES = f"c AS ({COUNTS}), v AS (SELECT 2016 AS vintage, 0 AS k UNION ALL SELECT 2021, 3)"


@query("src_census_vintages", f"WITH {VINTAGES}, s AS (SELECT 'housing' AS theme UNION ALL SELECT 'people') SELECT vintage, theme, CODGEO, CAST(t + k AS DOUBLE) AS total, CAST(b + k AS DOUBLE) AS building FROM c, v, s")
def src_census_vintages(spark, d):
    out = None
    for (year, theme), df in vintages(spark, d).items():
        yy = io.vintage_prefixes(df.columns)[0]
        part = df.select(F.lit(year).alias("vintage"), F.lit(theme).alias("theme"), "CODGEO", io.find_column(df, f"p{yy}_rp").alias("total"), io.find_column(df, f"p{yy}_rp_building").alias("building"))
        out = part if out is None else out.unionByName(part)
    return out


@query("set_vintage_build", f"WITH {VINTAGES}, w AS (SELECT CAST(c_nationkey AS VARCHAR) AS CODGEO, n_regionkey AS area, sum(c_custkey % 7 + 1) AS w FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT area, vintage, indicator, round(sum(w * x) / sum(w), 6) AS value FROM (SELECT vintage, CODGEO, 'building' AS indicator, 100.0 * (b + k) / (t + k) AS x FROM c, v UNION ALL SELECT vintage, CODGEO, 'machinery', 100.0 * (m + k) / (t + k) FROM c, v) JOIN w USING (CODGEO) GROUP BY 1, 2, 3")
def set_vintage_build(spark, d):
    """Indicators of all vintages as tokens, then carried to areas by weights."""
    out, t = None, Tables(spark, d)
    for (year, theme), df in vintages(spark, d).items():
        if theme != "housing":
            continue
        yy = io.vintage_prefixes(df.columns)[0]
        spec = [("building", [f"P{yy}_RP_BUILDING"], [f"P{yy}_RP"]), ("machinery", [f"P{yy}_RP_MACHINERY"], [f"P{yy}_RP"])]
        tokens = io.indicators(df, ["CODGEO"], spec).unpivot("CODGEO", ["building", "machinery"], "indicator", "value").withColumn("vintage", F.lit(year))
        out = tokens if out is None else out.unionByName(tokens)
    weights = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").cast("string").alias("CODGEO"), F.col("n_regionkey").alias("area")).agg(F.sum(F.col("c_custkey") % 7 + 1).cast("double").alias("w"))
    return rounded(J.crosswalk(out, weights, "CODGEO", "area", ["vintage", "indicator"], "value", "w"))


@query("src_addresses", "SELECT CAST(c_nationkey AS VARCHAR) AS id_brut_bv_reu, CAST(c_custkey % 90 AS DOUBLE) AS latitude, CAST(c_custkey % 180 AS DOUBLE) AS longitude FROM customer WHERE c_custkey % 11 <> 0")
def src_addresses(spark, d):
    path = io.scratch(spark, "addresses")
    known = lambda c: F.when(F.col("c_custkey") % 11 != 0, c.cast("double"))
    Tables(spark, d).customer.select(F.col("c_nationkey").cast("string").alias("id_brut_bv_reu"), known(F.col("c_custkey") % 90).alias("latitude"), (F.col("c_custkey") % 180).cast("double").alias("longitude"), "c_name").write.parquet(path)
    return io.addresses(spark, path)


def features(spark, d) -> str:
    """A square for each customer, two for every third, a point for every seventh, as lines of GeoJSON."""
    x, y = (F.col("c_custkey") % 90).cast("double"), F.col("c_acctbal") / 100
    ring = lambda dx: F.array(*[F.array(x + a + dx, y + b) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))])
    one, two = F.to_json(F.array(ring(0.0))), F.to_json(F.array(F.array(ring(0.0)), F.array(ring(5.0))))
    kind = F.when(F.col("c_custkey") % 7 == 0, "Point").when(F.col("c_custkey") % 3 == 0, "MultiPolygon").otherwise("Polygon")
    shape = F.when(kind == "Point", F.to_json(F.array(x, y))).when(kind == "MultiPolygon", two).otherwise(one)
    line = F.concat(F.lit('{"type":"Feature","properties":{"codeBureauVote":"'), F.col("c_custkey").cast("string"), F.lit('","codeCommune":"'), F.col("c_nationkey").cast("string"), F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}}"))
    path = io.scratch(spark, "features")
    Tables(spark, d).customer.select(line.alias("value")).write.text(path)
    return path


@query("src_geojson_features", "SELECT CAST(c_custkey AS VARCHAR) AS unit, CAST(c_nationkey AS VARCHAR) AS parent, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n_rings FROM customer WHERE c_custkey % 7 <> 0")
def src_geojson_features(spark, d):
    return io.boundaries(spark, features(spark, d)).select("unit", "parent", F.size("rings").alias("n_rings"))


@query("agg_centroid_polygon", "SELECT CAST(c_custkey AS VARCHAR) AS unit, round(c_custkey % 90 + 0.5 + CASE WHEN c_custkey % 3 = 0 THEN 2.5 ELSE 0 END, 6) AS lon, round(c_acctbal / 100 + 0.25, 6) AS lat FROM customer WHERE c_custkey % 7 <> 0")
def agg_centroid_polygon(spark, d):
    return rounded(io.boundaries(spark, features(spark, d)).select("unit", "lon", "lat"))


@query("fn_round_coords", "SELECT CAST(c_custkey AS VARCHAR) AS unit, CAST(c_custkey % 90 AS DOUBLE) AS x, round(c_acctbal / 100, 5) AS y FROM customer WHERE c_custkey % 7 <> 0")
def fn_round_coords(spark, d):
    first = F.col("rings")[0][0]
    return io.boundaries(spark, features(spark, d)).select("unit", first[0].alias("x"), first[1].alias("y"))


@query("src_sales_gz", "SELECT CAST(l_suppkey AS VARCHAR) AS code_commune, count(*) AS n, round(sum(l_extendedprice / l_quantity), 2) AS price FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F' AND l_extendedprice / l_quantity BETWEEN 200 AND 30000 GROUP BY 1")
def src_sales_gz(spark, d):
    path = io.scratch(spark, "sales")
    rows = Tables(spark, d).lineitem.select(F.when(F.col("l_returnflag") == "R", "Echange").otherwise("Vente").alias("nature_mutation"), F.col("l_extendedprice").alias("valeur_fonciere"), F.col("l_suppkey").cast("string").alias("code_commune"), F.when(F.col("l_linestatus") == "F", "Maison").otherwise("Local").alias("type_local"), F.col("l_quantity").alias("surface_reelle_bati"))
    rows.write.option("compression", "gzip").csv(path, header=True)
    return rounded(io.sales(spark, path).groupBy("code_commune").agg(F.count("*").alias("n"), F.sum("price").alias("price")), 2)


@query("src_literal_tables", "SELECT code, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'A' WHEN 'purchase' THEN 'B' ELSE 'UNKNOWN' END AS code FROM events) GROUP BY 1")
def src_literal_tables(spark, d):
    codes = io.literal_table(spark, [("click", "A"), ("view", "A"), ("purchase", "B")], "event_type string, code string")
    joined = Tables(spark, d).events.join(codes, "event_type", "left")
    return rounded(joined.groupBy(F.coalesce("code", F.lit("UNKNOWN")).alias("code")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


ROUNDED = f"WITH {PANEL} SELECT unit, event, round(A, 4) AS A, round(weight, 4) AS weight FROM panel"


@query("src_read_through_cache", ROUNDED)
def src_read_through_cache(spark, d):
    """Written by the first call, read by the second."""
    path, panel = io.scratch(spark, "cache"), Tables(spark, d).panel().select("unit", "event", "A", "weight")
    io.materialise(panel.limit(1), path, by_plan=True)  # another plan, another folder
    io.materialise(panel, path, by_plan=True)
    return rounded(io.materialise(panel, path, by_plan=True), 4)


@query("sink_parquet", ROUNDED)
def sink_parquet(spark, d):
    path, panel = io.scratch(spark, "panel"), Tables(spark, d).panel().select("unit", "event", "A", "weight")
    panel.write.parquet(path)
    return rounded(spark.read.schema(panel.schema).parquet(path), 4)


@query("sink_csv", ROUNDED)
def sink_csv(spark, d):
    path, panel = io.scratch(spark, "csv"), Tables(spark, d).panel().select("unit", "event", "A", "weight")
    io.write_csv(panel, path)
    return spark.read.schema(panel.schema).csv(path, header=True)


@query("sink_json_partitioned", f"WITH {PANEL} SELECT unit, parent, event, round(A, 4) AS A FROM panel")
def sink_json_partitioned(spark, d):
    path, panel = io.scratch(spark, "json"), rounded(Tables(spark, d).panel().select("unit", "parent", "event", "A"), 4)
    io.write_json(panel, path, "parent")
    return spark.read.schema(panel.schema).json(path)


@query("fn_city_from_file", "SELECT o_orderkey, array_to_string(list_transform(string_split(replace(replace(CAST(o_orderkey % 13 AS VARCHAR) || o_orderpriority, '-', ' '), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS city FROM orders")
def fn_city_from_file(spark, d):
    path = F.concat(F.lit("/data/2026/polls_"), (F.col("o_orderkey") % 13).cast("string"), F.col("o_orderpriority"), F.lit(".csv"))
    return Tables(spark, d).orders.select("o_orderkey", X.city_from_file(path, "polls_").alias("city"))


@query("fn_round_from_columns", "WITH h AS (SELECT user_id, list(DISTINCT CASE WHEN user_id % 3 = 0 THEN event_type || '-x' WHEN user_id % 3 = 1 AND event_type < 'p' THEN event_type || '/y' ELSE event_type END) AS hs FROM events GROUP BY 1) SELECT user_id, CAST(CASE WHEN len(list_filter(hs, lambda x: regexp_matches(x, '[-+/]'))) > len(hs) / 2 AND len(hs) <= 8 THEN 2 ELSE 1 END AS INT) AS round FROM h")
def fn_round_from_columns(spark, d):
    k = F.col("user_id") % 3
    header = F.when(k == 0, F.concat("event_type", F.lit("-x"))).when((k == 1) & (F.col("event_type") < "p"), F.concat("event_type", F.lit("/y"))).otherwise(F.col("event_type"))
    return Tables(spark, d).events.groupBy("user_id").agg(F.collect_set(header).alias("headers")).select("user_id", X.round_from_columns(F.col("headers")).alias("round"))


@query("fn_coalition_to_code", "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'LA' WHEN '2' THEN 'LB' WHEN '5' THEN 'LC' ELSE 'UNKNOWN' END AS code FROM orders")
def fn_coalition_to_code(spark, d):
    text = F.when(F.col("o_orderpriority").startswith("5"), "GREENS 5 - X").otherwise(F.regexp_replace("o_orderpriority", "-", " - "))
    return Tables(spark, d).orders.select("o_orderkey", X.coalition_code(text, {"1": "LA", "2": "LB", "G": "LC"}, {"GREENS": "G"}).alias("code"))


@query("fn_vintage_prefix", f"WITH c AS ({COUNTS}) SELECT CODGEO, '21' AS prefix, CAST(b AS DOUBLE) AS building, CAST(NULL AS DOUBLE) AS missing FROM c")
def fn_vintage_prefix(spark, d):
    """Columns found by the vintage in their names, whatever their case, among alternatives."""
    df = census_counts(Tables(spark, d), "21")
    yy = io.vintage_prefixes(df.columns)[0]
    return df.select("CODGEO", F.lit(yy).alias("prefix"), io.find_column(df, f"P{yy}_RP_BUILT", f"p{yy}_rp_building").cast("double").alias("building"), io.find_column(df, f"P{yy}_NONE").alias("missing"))


@query("fn_embedded_vintage", f"WITH c AS ({COUNTS}) SELECT CODGEO, 2016 AS vintage, 'gas' AS indicator, round(100.0 * (b + 3) / (t + 3), 6) AS value FROM c UNION ALL SELECT CODGEO, 2016, 'wood', round(100.0 * (m + 3) / (t + 3), 6) FROM c")
def fn_embedded_vintage(spark, d):
    """A newer file that also holds columns of an older vintage."""
    t = Tables(spark, d)
    df = census_counts(t, "21").join(census_counts(t, "16", 3), "CODGEO")
    return rounded(io.embedded_vintages(df, "CODGEO", "RP", {"BUILDING": "gas", "MACHINERY": "wood", "OIL": "oil"}))


@query("fn_mobility_indicators", f"WITH c AS ({COUNTS}) SELECT CODGEO, 'recent_movers' AS indicator, round(100 - 100.0 * b / t, 6) AS value FROM c UNION ALL SELECT CODGEO, 'newcomers', round(100.0 * m / t, 6) FROM c")
def fn_mobility_indicators(spark, d):
    df = census_counts(Tables(spark, d), "21")
    return rounded(io.mobility(df, "CODGEO", "P21_RP", "P21_RP_BUILDING", ["P21_RP_MACHINERY", "P21_RP_NONE"]))
