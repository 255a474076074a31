"""Sources and sinks: result, survey, census, sales and boundary files, and materialised tables."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.functions import text as X
from arealis.operators.panel import ratio

POLLS = "candidat string, parti string, intentions string, nom_institut string, fin_enquete string, tour string"
SALES = "nature_mutation string, valeur_fonciere double, code_commune string, type_local string, surface_reelle_bati double"
FEATURE = "type string, properties struct<codeBureauVote:string, codeCommune:string>, geometry struct<type:string, coordinates:string>"
RINGS = "array<array<array<double>>>"
#: Scratch folders made so far, each with its application.
MADE: list[tuple[str, str]] = []
RULES = [(";", 0), (",", 1), ("\t", 2)]


def parquet(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Some columns of a table, and only the rows that a filter keeps; both reach the scan."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def polls_long(spark: SparkSession, path: str, round_col: str = "tour") -> DataFrame:
    """Survey readings from long CSV files: date, institute, candidate, party, round, value; rows without date or value go."""
    df = spark.read.schema(POLLS).option("enforceSchema", False).csv(path, header=True)
    out = df.select(X.iso_date(F.col("fin_enquete")).alias("date"), F.coalesce("nom_institut", F.lit("unknown")).alias("institute"), F.col("candidat").alias("candidate"), F.col("parti").alias("party"), F.col(round_col).alias("round"), X.poll_value(F.col("intentions")).alias("value"))
    return out.where("date is not null and value is not null")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir; where that is unset, on one machine, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    MADE.append((spark.sparkContext.applicationId, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a scratch folder and read it again: its lineage ends there, and it survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch folders that this application has made so far. No table that still reads them may be used again."""
    mine = [x for x in MADE if x[0] == spark.sparkContext.applicationId]
    for x in mine:
        path = spark._jvm.org.apache.hadoop.fs.Path(x[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        MADE.remove(x)


def polls_tree(spark: SparkSession, path: str, kinds: dict[str, str], exclude: str = "municipal") -> DataFrame:
    """Lines of all CSV files of a tree with kind and round from the path below it; files under a folder named `exclude` have their own reader."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    below = F.lower(F.element_at(F.split("file", re.escape(f"/{path.rstrip('/').rsplit('/', 1)[-1]}/")), -1))
    kind = F.lit(None).cast("string")
    for part, label in kinds.items():
        kind = F.when(below.contains(part), label).otherwise(kind)
    return df.where(~F.concat(F.lit("/"), below).contains(f"/{exclude}")).select("file", kind.alias("kind"), F.when(below.rlike("t2|tour_?2"), 2).otherwise(1).alias("round"), "value")


#: First columns of a city's survey table, by which its header line is told.
HEADER = "(?i)^\"?(sondeur|polling firm)\"?,"
#: Columns of a survey table that aren't parties.
META = ("sondeur", "polling firm", "source", "date début", "date fin", "date", "fieldwork date", "échantillon", "sample size", "abs.")
#: The first column whose name has a word that begins like this tells the date.
DATED = r"(?i)(^|\s)(date|fieldwork|période)"
FIRMS = ("sondeur", "polling firm")


def is_party(header: Column) -> Column:
    """Whether a survey table's column, by its name, is a party's."""
    name = F.lower(F.trim(header))
    return ~(name.isin(*META) | name.rlike(DATED) | name.contains("unnamed") | (name == ""))


def survey_columns(names: Sequence[str]) -> tuple[str | None, str | None, list[str]]:
    """The date column, the institute's and the parties' of a survey table, by their names."""
    low = {c: c.lower().strip() for c in names}
    date = next((c for c in names if re.search(DATED, low[c])), None)
    firm = next((c for f in FIRMS for c in names if low[c] == f), None)
    parties = [c for c in names if low[c] and low[c] not in META and "unnamed" not in low[c] and not re.search(DATED, low[c])]
    return date, firm, parties


def polls_municipal(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Survey tables of cities, a file or folder of CSV for each, with columns of their own: city, round, date, institute, party, value.

    Each file's header line is joined to its cells by file and position. The city comes from the name, the round from the headers."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    cells = F.transform(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.trim(F.translate(x, '"', "")))
    name = F.regexp_replace("file", "/part-[^/]*$", "")
    lines = lines.select("file", X.city_from_file(name, prefix).alias("city"), F.col("value").rlike(HEADER).alias("first"), cells.alias("cells"))
    heads = lines.where("first").groupBy("file").agg(F.first("cells").alias("headers"))
    heads = heads.withColumn("round", X.round_from_columns(F.filter("headers", is_party)))
    rows = lines.where(~F.col("first")).join(heads, "file")
    at = lambda fits: F.try_element_at(F.transform(F.filter(F.arrays_zip("headers", "cells"), lambda c: fits(F.lower(c["headers"]))), lambda c: c["cells"]), F.lit(1))
    text = at(lambda h: h.rlike(DATED))
    rows = rows.select("city", "round", F.coalesce(X.french_date(text), X.iso_date(text)).alias("date"), at(lambda h: h.isin(*FIRMS)).alias("institute"), F.explode(F.filter(F.arrays_zip("headers", "cells"), lambda c: is_party(c["headers"]))).alias("c"))
    return rows.select("city", "round", "date", "institute", X.poll_header(F.col("c.headers")).alias("party"), X.poll_value(F.col("c.cells")).alias("value")).where("date is not null and value is not null")


def wide_to_long(df: DataFrame, meta: Sequence[str] = (), institute: str | None = None, date: str | None = None) -> DataFrame:
    """A wide survey table, one string column per party, as rows date, institute, party, value. Columns are told by their names where
    they aren't given: the first one with a date in its name, the institute's, and those that are no party's; `meta` names more of
    these. Without an institute's column it is `unknown`; without a date's there are no rows."""
    found_date, found_firm, parties = survey_columns(df.columns)
    date, institute = date or found_date, institute or found_firm
    parties = [c for c in parties if c not in (*meta, institute, date)]
    when = F.coalesce(X.french_date(F.col(f"`{date}`")), X.iso_date(F.col(f"`{date}`"))) if date else F.lit(None).cast("date")
    firm = F.col(f"`{institute}`") if institute else F.lit("unknown")
    keyed = df.select(when.alias("date"), firm.alias("institute"), *[F.col(f"`{c}`").cast("string").alias(c) for c in parties])
    if not parties:
        return keyed.select("date", "institute", F.lit(None).cast("string").alias("party"), F.lit(None).cast("double").alias("value")).where(F.lit(False))
    long = keyed.unpivot(["date", "institute"], [f"`{c}`" for c in parties], "party", "cell")
    return long.select("date", "institute", X.poll_header(F.col("party")).alias("party"), X.poll_value(F.col("cell")).alias("value")).where("date is not null and value is not null")


def sniffed_separator(spark: SparkSession, path: str) -> str:
    """The separator of a CSV file's first line that occurs most."""
    row = spark.read.text(path).limit(1).first()
    line = row[0] if row else ""
    return max(RULES, key=lambda r: (line.count(r[0]), -r[1]))[0]


def census(spark: SparkSession, path: str, key: str, width: int | None = None) -> DataFrame:
    """A census CSV with its separator sniffed; the key stays text, padded to `width` where given; counts are doubles."""
    df = spark.read.option("sep", sniffed_separator(spark, path)).option("header", True).csv(path)
    code = F.regexp_replace(F.col(key), r"\.0$", "")
    return df.select((F.lpad(code, width, "0") if width else code).alias(key), *[F.translate(F.col(f"`{c}`"), ",", ".").try_cast("double").alias(c) for c in df.columns if c != key])


def find_column(df: DataFrame, *names: str) -> Column:
    """The first of some columns that exists, whatever its case; null if none does."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def vintage_prefixes(columns: Sequence[str]) -> list[str]:
    """The two-digit vintages in column names such as P21_POP, in order of appearance; the first is the file's own."""
    found = [m[1] for c in columns if (m := re.match(r"^[PC](\d{2})_", c))]
    return list(dict.fromkeys(found))


def census_vintages(spark: SparkSession, path: str, themes: dict[str, str], key: str = "CODGEO", width: int | None = None) -> dict[tuple[int, str], DataFrame]:
    """The census table of each vintage and theme: folders named by their year, in each the first file whose path fits the theme's pattern.

    The driver lists paths alone, one for each file; tables stay lazy."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    below = F.element_at(F.split("path", re.escape(f"/{path.rstrip('/').rsplit('/', 1)[-1]}/")), -1)
    vintage = F.regexp_extract(below, r"((?:19|20)\d{2})", 1).try_cast("int")
    out = {}
    for theme, pattern in themes.items():
        first = files.where(F.lower(below).rlike(pattern)).groupBy(vintage.alias("vintage")).agg(F.min("path").alias("path")).where("vintage is not null")
        for r in first.collect():
            out[r.vintage, theme] = census(spark, r.path, key, width)
    return out


def indicators(df: DataFrame, keys: Sequence[str], spec: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Percentages from a spec of (name, numerator columns, denominator columns) in one projection."""
    total = lambda cols: sum((F.coalesce(find_column(df, c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return df.select(*keys, *[ratio(total(top), total(base), 100.0).alias(name) for name, top, base in spec])


def embedded_vintages(df: DataFrame, key: str, base: str, parts: dict[str, str]) -> DataFrame:
    """key, vintage, indicator, value: percentages of a base for each older vintage whose columns stand in a newer file."""
    out = None
    for yy in sorted(set(vintage_prefixes(df.columns)[1:])):
        have = {c.upper() for c in df.columns}
        spec = [(name, [f"P{yy}_{base}_{suffix}"], [f"P{yy}_{base}"]) for suffix, name in parts.items() if f"P{yy}_{base}_{suffix}".upper() in have]
        if f"P{yy}_{base}".upper() not in have or not spec:
            continue
        wide = indicators(df, [key], spec).withColumn("vintage", F.lit(2000 + int(yy)))
        long = wide.unpivot([key, "vintage"], [name for name, _, _ in spec], "indicator", "value").where("value is not null")
        out = long if out is None else out.unionByName(long)
    return out if out is not None else df.select(key, F.lit(0).alias("vintage"), F.lit("").alias("indicator"), F.lit(0.0).alias("value")).limit(0)


def mobility(df: DataFrame, key: str, total: str, stayed: str, arrived: Sequence[str]) -> DataFrame:
    """Churn of residents as tokens: the share that moved lately, and the share that came from outside; absent columns count 0."""
    all_, own = find_column(df, total).cast("double"), find_column(df, stayed).cast("double")
    came = sum((F.coalesce(find_column(df, c).cast("double"), F.lit(0.0)) for c in arrived), F.lit(0.0))
    wide = df.select(key, ((1 - ratio(own, all_)) * 100).alias("recent_movers"), ratio(came, all_, 100.0).alias("newcomers"))
    return wide.unpivot(key, ["recent_movers", "newcomers"], "indicator", "value").where("value is not null")


def addresses(spark: SparkSession, path: str, unit: str = "id_brut_bv_reu") -> DataFrame:
    """Unit, latitude and longitude of geocoded addresses; no other column is read."""
    return parquet(spark, path, [unit, "latitude", "longitude"], F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of fixed values from the program, small by nature: joins send it to all tasks."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def sales(spark: SparkSession, path: str) -> DataFrame:
    """Dwelling sales with a plausible price per square metre."""
    df = spark.read.schema(SALES).option("enforceSchema", False).csv(path, header=True)
    price = ratio("valeur_fonciere", "surface_reelle_bati")
    return df.where((F.col("nature_mutation") == "Vente") & F.col("type_local").isin("Maison", "Appartement")).withColumn("price", price).where("price between 200 and 30000")


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited GeoJSON polygons and multi-polygons: unit, parent, rings, and the mean of the outer rings' vertices."""
    df = spark.read.schema(FEATURE).json(path).where("geometry.type in ('Polygon', 'MultiPolygon')")
    text = F.col("geometry.coordinates")
    many = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json(text, RINGS))).otherwise(F.from_json(text, f"array<{RINGS}>"))
    df = df.select(F.col("properties.codeBureauVote").alias("unit"), F.col("properties.codeCommune").alias("parent"), many.alias("polygons"))
    outer = F.flatten(F.transform("polygons", lambda p: p[0]))
    mean = lambda i: ratio(F.aggregate(outer, F.lit(0.0), lambda a, p: a + p[i]), F.size(outer))
    return df.select("unit", "parent", F.flatten(F.transform("polygons", lambda p: X.rounded_rings(p))).alias("rings"), mean(0).alias("lon"), mean(1).alias("lat"))


def materialise(df: DataFrame, path: str, by_plan: bool = False) -> DataFrame:
    """The table at path if it is complete, else df, written there and read again.

    As a path alone says nothing of what was written there, `by_plan` gives each plan and schema a folder of its own below it."""
    spark = df.sparkSession
    if by_plan:
        path = f"{path.rstrip('/')}/{hashlib.sha256(f'{df.semanticHash()} {df.schema.json()}'.encode()).hexdigest()[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallel_arrays(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: arrays of the order column and of each column, all in the same order."""
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_r"))
    return grouped.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (order, *columns)])


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, by: str) -> None:
    """One folder of JSON lines per value of a column."""
    df.write.mode("overwrite").partitionBy(by).json(path)
