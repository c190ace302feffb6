"""Flat files: places, countries, rules, manifests. Schemas are declared; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Countries and territories that drive on the left.
LEFT_DRIVING = (
    "AG AI AU BB BD BM BN BS BT BW CC CK CX CY DM FJ FK GB GD GG GY HK ID IE IM IN JE JM JP KE KI KN KY LC LK LS MO MS MT MU "
    "MV MW MY MZ NA NF NP NR NU NZ PG PK PN SB SC SG SH SR SZ TC TH TK TL TO TT TV TZ UG VC VG VI WS ZA ZM ZW"
).split()


def _named_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _column(df: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("iso2 string, name string, continent string, drives_on string").option("header", True).csv(path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Places by column name; a missing region is '' and a missing population 0."""
    d = _named_csv(spark, path)
    return d.select(
        "name",
        "iso2",
        _column(d, "admin1", "").alias("admin1"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        F.coalesce(_column(d, "population", "0").try_cast("double"), F.lit(0.0)).alias("population"),
    )


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    return _named_csv(spark, path).select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, lat, lon) with each path resolved against the manifest's folder."""
    folder = path.rsplit("/", 1)[0]
    d = _named_csv(spark, path)
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(folder + "/"), F.col("path")))
    return d.select(full.alias("path"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def _tabs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").alias("c"), "value")


def with_admin1_name(cities: DataFrame, admin1: DataFrame) -> DataFrame:
    """Region name by 'country.code', '' when the dump has none."""
    return cities.withColumn("code", F.concat_ws(".", "iso2", "admin1_code")).join(F.broadcast(admin1), "code", "left").withColumn(
        "admin1", F.coalesce("admin1_name", F.lit(""))
    ).drop("code", "admin1_name")


def read_geonames(spark: SparkSession, cities: str, admin1: str, country_info: str) -> tuple[DataFrame, DataFrame]:
    """Raw tab-separated dumps → (places, countries)."""
    f = lambda i: F.get("c", F.lit(i))
    regions = _tabs(spark, admin1).select(f(0).alias("code"), f(1).alias("admin1_name"))
    c = _tabs(spark, cities).select(
        f(1).alias("name"), f(8).alias("iso2"), f(10).alias("admin1_code"), f(4).cast("double").alias("lat"), f(5).cast("double").alias("lon"),
        F.coalesce(f(14).try_cast("double"), F.lit(0.0)).alias("population"),
    )
    places = with_admin1_name(c, regions).select("name", "iso2", "admin1", "lat", "lon", "population")
    info = _tabs(spark, country_info).filter(~F.col("value").startswith("#"))
    countries = info.select(
        f(0).alias("iso2"), f(4).alias("name"), f(8).alias("continent"), F.when(f(0).isin(LEFT_DRIVING), "L").otherwise("R").alias("drives_on")
    )
    return places, countries


RULE_JSON = (
    "cues map<string, struct<label:string, kind:string, countries:map<string,double>, "
    "regions:array<struct<lat:double,lon:double,sigma_km:double,peak:double>>, drives_on:string, lr:double, "
    "lat_band:struct<min:double,max:double,abs:boolean,lr:double>, other:double>>"
)


def read_cue_rules(spark: SparkSession, path: str) -> DataFrame:
    """Nested rule file → one row per cue, in the layout of the evidence operators."""
    d = spark.read.schema(RULE_JSON).option("multiLine", True).json(path)
    e = d.select(F.explode("cues").alias("rule", "r"))
    return e.select(
        "rule", F.coalesce("r.label", "rule").alias("label"), "r.countries", "r.regions", "r.drives_on", "r.lr", "r.lat_band", F.coalesce("r.other", F.lit(0.2)).alias("other")
    )
