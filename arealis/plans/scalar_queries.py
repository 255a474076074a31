"""Queries of scalar functions, filters, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealis.functions import text as X
from arealis.operators import panel as P
from arealis.plans.catalog import Tables, query, rounded
from arealis.sources import io

DATE = "strftime(o_orderdate, '%Y-%m-%d')"


@query("fn_iso_date", f"WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {DATE} WHEN 1 THEN left({DATE}, 7) WHEN 2 THEN left({DATE}, 4) ELSE 'nan' END AS s FROM orders) SELECT o_orderkey, CASE length(s) WHEN 10 THEN CAST(s AS DATE) WHEN 7 THEN CAST(s || '-15' AS DATE) WHEN 4 THEN CAST(s || '-06-15' AS DATE) END AS d FROM s")
def fn_iso_date(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, text).when(k == 1, F.substring(text, 1, 7)).when(k == 2, F.substring(text, 1, 4)).otherwise("nan")
    return Tables(spark, d).orders.select("o_orderkey", X.iso_date(s).alias("d"))


@query("fn_name_normalise", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(text, 'ß', ' '), 'œ', ' '))), '[^a-z0-9]+', ' ', 'g')) AS name FROM documents")
def fn_name_normalise(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.normalised_name(F.col("text")).alias("name"))


@query("fn_department", "WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 99999 AS VARCHAR), 5, '0') AS loc FROM customer) SELECT c_custkey, CASE WHEN left(loc, 2) IN ('97', '98') THEN left(loc, 3) ELSE left(loc, 2) END AS dep FROM c")
def fn_department(spark, d):
    return Tables(spark, d).customer.select("c_custkey", X.department(code()).alias("dep"))


def code():
    return F.lpad((F.col("c_custkey") * 7919 % 99999).cast("string"), 5, "0")


@query("fn_territory", "WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 99999 AS VARCHAR), 5, '0') AS loc FROM customer) SELECT c_custkey, CASE WHEN loc LIKE '99%' THEN 'abroad' WHEN left(loc, 3) IN ('986', '987', '988') THEN 'polynesia' WHEN left(loc, 2) = '20' THEN 'corsica' WHEN left(loc, 2) = '97' THEN 'dom' ELSE 'mainland' END AS kind FROM c")
def fn_territory(spark, d):
    return Tables(spark, d).customer.select("c_custkey", X.territory(code()).alias("kind"))


@query("fn_is_mainland", "WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 99999 AS VARCHAR), 5, '0') AS loc FROM customer) SELECT c_custkey, NOT regexp_matches(loc, '^9[789]') AS mainland FROM c")
def fn_is_mainland(spark, d):
    return Tables(spark, d).customer.select("c_custkey", X.is_mainland(code()).alias("mainland"))


@query("fn_make_location", "SELECT c_custkey, concat(c_nationkey, '_', c_custkey) AS location FROM customer")
def fn_make_location(spark, d):
    return Tables(spark, d).customer.select("c_custkey", X.location(F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("location"))


@query("fn_parent", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS parent FROM customer")
def fn_parent(spark, d):
    loc = X.location(F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return Tables(spark, d).customer.select("c_custkey", X.parent(loc).alias("parent"))


@query("fn_rekey_zero_pad", "SELECT c_custkey, concat(c_nationkey, '_', lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0')) AS key FROM customer")
def fn_rekey_zero_pad(spark, d):
    loc = X.location(F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 1000).cast("string"))
    return Tables(spark, d).customer.select("c_custkey", X.rekey_padded(loc).alias("key"))


@query("fn_region", "SELECT c_custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def fn_region(spark, d):
    t = Tables(spark, d)
    names = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    return t.customer.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "region")


@query("fn_safe_ratio", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END, 6) AS ratio FROM lineitem")
def fn_safe_ratio(spark, d):
    return rounded(Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", P.ratio("l_tax", "l_discount").alias("ratio")))


@query("fn_event_key", "SELECT o_orderkey, CAST(round((year(o_orderdate) + month(o_orderdate) / 100.0) * 100) AS INTEGER) AS key FROM orders")
def fn_event_key(spark, d):
    years = F.year("o_orderdate") + F.month("o_orderdate") / 100
    return Tables(spark, d).orders.select("o_orderkey", X.event_key(years).alias("key"))


@query("fn_near_date", "SELECT o_orderkey FROM orders WHERE CAST(round((year(o_orderdate) + month(o_orderdate) / 100.0) * 100) AS INTEGER) = 199606")
def fn_near_date(spark, d):
    return Tables(spark, d).orders.where(X.event_key(F.year("o_orderdate") + F.month("o_orderdate") / 100) == 199606).select("o_orderkey")


@query("fn_event_id", "SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS INTEGER), CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 4 END, 1) AS at, CASE WHEN o_orderkey % 2 = 0 THEN 'Legislatives_T1' ELSE 'Presidentielles_T2' END AS kind FROM orders")
def fn_event_id(spark, d):
    text = F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_legi_t1").otherwise("_pres_t2"))
    at, kind = X.event_id(text, {"legi_t1": 6, "pres_t2": 4}, {"legi": "Legislatives", "pres": "Presidentielles"})
    return Tables(spark, d).orders.select("o_orderkey", at.alias("at"), kind.alias("kind"))


@query("fn_vintage_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) - 1.5 AS centred, CAST(year(o_orderdate) AS DOUBLE) + 3.5 AS published FROM orders")
def fn_vintage_dates(spark, d):
    y = F.year("o_orderdate").cast("double")
    return Tables(spark, d).orders.select("o_orderkey", (y - 1.5).alias("centred"), (y + 3.5).alias("published"))


@query("fn_onehot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS DOUBLE) AS is_F, CAST(o_orderstatus = 'O' AS DOUBLE) AS is_O, CAST(o_orderstatus = 'P' AS DOUBLE) AS is_P FROM orders")
def fn_onehot(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", *[(F.col("o_orderstatus") == s).cast("double").alias(f"is_{s}") for s in "FOP"])


@query("fn_clip_box", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 100.0) AS v FROM customer")
def fn_clip_box(spark, d):
    return Tables(spark, d).customer.select("c_custkey", X.clip(F.col("c_acctbal")).alias("v"))


@query("fn_recency_weight", "SELECT l_orderkey, l_linenumber, round(exp(-0.3 * l_linenumber), 6) AS w FROM lineitem")
def fn_recency_weight(spark, d):
    return rounded(Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", X.recency(F.col("l_linenumber"), 0.3).alias("w")))


@query("fn_make_tokens", "SELECT c_custkey, 'acctbal' AS indicator, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(nullif(c_nationkey, 0) AS DOUBLE) FROM customer WHERE c_nationkey <> 0")
def fn_make_tokens(spark, d):
    wide = Tables(spark, d).customer.select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.nullif("c_nationkey", F.lit(0)).cast("double").alias("nation"))
    return wide.unpivot("c_custkey", ["acctbal", "nation"], "indicator", "value").where("value is not null and not isnan(value)")


@query("fn_census_indicators", "SELECT c_nationkey, round(100.0 * count(*) FILTER (c_mktsegment = 'BUILDING') / count(*), 6) AS building, round(100.0 * count(*) FILTER (c_mktsegment = 'MACHINERY') / nullif(count(*) FILTER (c_mktsegment <> 'BUILDING'), 0), 6) AS machinery FROM customer GROUP BY 1")
def fn_census_indicators(spark, d):
    """Percentages from a declarative spec: name, numerator columns, denominator columns."""
    counts = Tables(spark, d).customer.groupBy("c_nationkey").pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).count().fillna(0)
    rest = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    spec = [("building", ["BUILDING"], ["BUILDING", *rest]), ("machinery", ["MACHINERY"], rest)]
    return rounded(io.indicators(counts, ["c_nationkey"], spec))


@query("fn_context_tokens", "SELECT c_nationkey, 'low' AS kind, round(100.0 * count(*) FILTER (c_acctbal < 0) / count(*), 6) AS value FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'high', round(100.0 * count(*) FILTER (c_acctbal > 5000) / count(*), 6) FROM customer GROUP BY 1")
def fn_context_tokens(spark, d):
    rate = lambda c: P.ratio(F.count_if(c), F.count("*"), 100.0)
    rates = Tables(spark, d).customer.groupBy("c_nationkey").agg(rate(F.col("c_acctbal") < 0).alias("low"), rate(F.col("c_acctbal") > 5000).alias("high"))
    return rounded(rates.unpivot("c_nationkey", ["low", "high"], "kind", "value"))


@query("fn_price_features", "WITH m AS (SELECT l_suppkey, median(l_extendedprice / l_quantity) FILTER (year(l_shipdate) = 1996) AS a, median(l_extendedprice / l_quantity) FILTER (year(l_shipdate) = 1998) AS b, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, round(ln(b), 6) AS log_price, round(ln(b) - ln(a), 6) AS growth, round(ln(n), 6) AS log_n FROM m")
def fn_price_features(spark, d):
    price, year = F.col("l_extendedprice") / F.col("l_quantity"), F.year("l_shipdate")
    m = Tables(spark, d).lineitem.groupBy("l_suppkey").agg(F.median(F.when(year == 1996, price)).alias("a"), F.median(F.when(year == 1998, price)).alias("b"), F.count("*").alias("n"))
    return rounded(m.select("l_suppkey", F.ln("b").alias("log_price"), (F.ln("b") - F.ln("a")).alias("growth"), F.ln("n").alias("log_n")))


@query("flt_sales", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R') AND l_extendedprice / l_quantity BETWEEN 1000 AND 1500")
def flt_sales(spark, d):
    return Tables(spark, d).lineitem.where("l_linestatus = 'F' and l_returnflag in ('A', 'R') and l_extendedprice / l_quantity between 1000 and 1500").select("l_orderkey", "l_linenumber")


@query("flt_event_types", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def flt_event_types(spark, d):
    return Tables(spark, d).events.where(F.col("event_type").isin("click", "view")).select("event_id")


@query("flt_exclude_events", "SELECT event_id FROM events WHERE CAST(ts AS DATE) NOT IN (DATE '2024-01-05', DATE '2024-01-06')")
def flt_exclude_events(spark, d):
    gone = spark.createDataFrame([("2024-01-05",), ("2024-01-06",)], "day string").select(F.to_date("day").alias("day"))
    e = Tables(spark, d).events
    return e.withColumn("day", F.to_date("ts")).join(F.broadcast(gone), "day", "left_anti").select("event_id")


@query("flt_target_split", "SELECT o_orderkey, year(o_orderdate) = 2000 AND o_orderpriority = '1-URGENT' AS is_target FROM orders")
def flt_target_split(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", ((F.year("o_orderdate") == 2000) & (F.col("o_orderpriority") == "1-URGENT")).alias("is_target"))


@query("flt_min_move", "WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS move FROM orders) SELECT o_orderkey, round(move, 4) AS move FROM m WHERE abs(move) > 1000")
def flt_min_move(spark, d):
    m = P.first_difference(Tables(spark, d).orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    return rounded(m.where(F.abs("d_o_totalprice") > 1000).select("o_orderkey", F.col("d_o_totalprice").alias("move")), 4)


@query("flt_available_columns", "SELECT 'p_brand' AS name, count(p_brand) AS n FROM part UNION ALL SELECT 'p_size', count(p_size) FROM part")
def flt_available_columns(spark, d):
    part = Tables(spark, d).part.select("p_brand", "p_size", F.lit(None).cast("double").alias("nothing"))
    counts = part.agg(*[F.count(c).alias(c) for c in part.columns]).unpivot([], part.columns, "name", "n")
    return counts.where("n > 0")


@query("fn_french_date", "WITH s AS (SELECT o_orderkey, o_orderdate AS x, ['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'][month(o_orderdate)] AS m FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN make_date(CAST(year(x) AS INTEGER), CAST(month(x) AS INTEGER), 15) ELSE CAST(x AS DATE) END AS d FROM s")
def fn_french_date(spark, d):
    names = F.array(*[F.lit(m) for m in ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]])
    month = F.element_at(names, F.month("o_orderdate"))
    k, year, day = F.col("o_orderkey") % 3, F.year("o_orderdate"), F.day("o_orderdate")
    text = F.when(k == 0, F.concat_ws(" ", month, year)).when(k == 1, F.concat(F.lit("1-"), day, F.lit(" "), month, F.lit(" "), year)).otherwise(F.concat_ws(" ", day, F.initcap(month), year))
    return Tables(spark, d).orders.select("o_orderkey", X.french_date(text).alias("d"))


CELLS = "CASE o_orderkey % 5 WHEN 0 THEN v || '[d]' WHEN 1 THEN '<' || v WHEN 2 THEN replace(v, '.', ',') WHEN 3 THEN v || ' %' ELSE '—' END"


@query("fn_poll_value", "WITH s AS (SELECT o_orderkey, (o_orderkey % 97) || '.5' AS v FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(v AS DOUBLE) END AS v FROM s")
def fn_poll_value(spark, d):
    v = F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit(".5"))
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(v, F.lit("[d]"))).when(k == 1, F.concat(F.lit("<"), v)).when(k == 2, F.translate(v, ".", ",")).when(k == 3, F.concat(v, F.lit(" Doe"))).otherwise("—")
    return Tables(spark, d).orders.select("o_orderkey", X.poll_value(text).alias("v"))


@query("src_parquet_projected", "SELECT o_orderkey, o_totalprice FROM orders")
def src_parquet_projected(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", "o_totalprice")


@query("src_parquet_filtered", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01'")
def src_parquet_filtered(spark, d):
    at = F.col("l_shipdate")
    return Tables(spark, d).lineitem.where((at >= F.lit("1998-01-01").cast("timestamp_ntz")) & (at < F.lit("1998-02-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")


@query("sink_json_arrays", "SELECT n_regionkey, len(list(n_name)) AS n FROM nation GROUP BY 1")
def sink_json_arrays(spark, d):
    """Parallel arrays per parent key, in key order."""
    grouped = io.parallel_arrays(Tables(spark, d).nation, ["n_regionkey"], "n_nationkey", ["n_name"])
    return grouped.select("n_regionkey", F.size("n_name").cast("long").alias("n"))
