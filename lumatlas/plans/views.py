"""Photo-location views derived from the given tables, as SQL that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_runtime

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEW_SQL: dict[str, str] = {
    "places": """
select s_suppkey as place_id, s_name as name, concat('N', cast(s_nationkey as varchar(9))) as iso2,
 concat('A', cast(s_suppkey % 3 as varchar(9))) as admin1, r_name as continent,
 cast((n_nationkey*37) % 110 - 50 + ((s_suppkey*17) % 41 - 20)*0.1 as double) as lat,
 cast((n_nationkey*97) % 340 - 170 + ((s_suppkey*29) % 41 - 20)*0.1 as double) as lon,
 cast(1000 + (s_suppkey*7919) % 900000 as double) as population,
 case when s_nationkey % 4 = 0 then 'L' else 'R' end as drives_on
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "countries": """
select concat('N', cast(n_nationkey as varchar(9))) as iso2, n_name as name, r_name as continent,
 case when n_nationkey % 4 = 0 then 'L' else 'R' end as drives_on
from nation join region on n_regionkey = r_regionkey""",
    "cells": """
select place_id as leaf, name, iso2, concat(iso2, '/', admin1) as admin1, continent, lat, lon,
 cast(20 + place_id % 30 as double) as scale_km, ln(population / sum(population) over ()) as log_prior from places""",
    "photos": """
select event_id as photo_id, user_id as album_id, ts as taken_at, event_type as scene,
 cast(-50 + ((event_id*7919) % 11000)*0.01 as double) as lat,
 cast(-170 + ((event_id*104729) % 34000)*0.01 as double) as lon, value as val from events""",
    "detections": """
select cast(floor(event_id / 4) as bigint) as photo_id, event_id as det_id,
 case event_id % 6 when 0 then 'left_hand_traffic' when 1 then 'right_hand_traffic' when 2 then 'joshua_tree'
  when 3 then 'date_palm' when 4 then 'snow_ground' else 'person' end as cue,
 (cast(regexp_extract(props, '([0-9]+)', 1) as double) + 1) / 101 as score,
 cast((event_id % 50) / 100.0 as double) as x0, cast((event_id % 30) / 100.0 as double) as y0,
 cast((event_id % 50) / 100.0 + 0.1 + (event_id % 5)*0.1 as double) as x1,
 cast((event_id % 30) / 100.0 + 0.1 + (event_id % 7)*0.1 as double) as y1 from events""",
    "text_lines": """
select doc_id as photo_id, doc_id as line_id, cast((n_chars % 100) / 100.0 as double) as score,
 concat(case doc_id % 8 when 0 then 'Hauptstraße 5' when 1 then 'Kossuth Lajos utca' when 2 then 'Tel. +48 22 123 45 67'
  when 3 then 'www.padaria.com.br' when 4 then 'ラーメン 東京' when 5 then 'вулиця Хрещатик' when 6 then '+351 21 000 0000'
  else 'Departures via London' end, ' | ', lang) as text from documents""",
    "geo_index": """
select vec_id, embedding, label, cast(-50 + ((vec_id*37) % 110) as double) as lat,
 cast(-170 + ((vec_id*97) % 340) as double) as lon, vec_id % 10 = 0 as is_query from embeddings""",
    "street_images": """
select c_custkey as image_id, case when c_custkey % 3 = 0 then 'B' else 'A' end as source,
 cast(48.84 + ((c_custkey*37) % 200)*0.0001 as double) as lat, cast(2.33 + ((c_custkey*53) % 240)*0.0001 as double) as lon,
 cast((c_custkey*71) % 360 as double) as heading from customer""",
    "pois": """
select p_partkey as poi_id, p_name as street, p_size as housenumber,
 cast(48.84 + ((p_partkey*41) % 2000)*0.00001 as double) as lat, cast(2.33 + ((p_partkey*59) % 2400)*0.00001 as double) as lon
from part""",
    "street_matches": """
select l_orderkey as photo_id, l_linenumber as rn, l_partkey % 1500 as image_id,
 cast(l_discount as double) as similarity, cast(l_quantity as int) as inliers from lineitem""",
    "reports": """
select o_orderkey as photo_id, o_custkey as group_id, o_orderdate as taken_at,
 case substr(o_orderpriority, 1, 1) when '1' then 'exact' when '2' then 'street' when '3' then 'city' when '4' then 'region'
  else 'unknown' end as prec,
 cast(floor(o_totalprice) % 101 as double) as confidence,
 cast(-50 + ((o_orderkey*7919) % 11000)*0.01 as double) as lat, cast(-170 + ((o_orderkey*104729) % 34000)*0.01 as double) as lon
from orders""",
    "predictions": """
select photo_id, lat as true_lat, lon as true_lon,
 cast(lat + (photo_id % 7)*0.5*(photo_id % 3) as double) as lat, cast(lon + (photo_id % 5)*0.4 as double) as lon,
 cast(photo_id % 101 as double) as confidence, cast(1000*(1 + photo_id % 400) as double) as radius_m, val as latency_ms
from photos""",
    "answers": """
select event_id as photo_id, concat('{"scene":"urban","candidates":[{"country_code":"N', cast(event_id % 25 as varchar(9)),
 '","latitude":', cast(event_id % 60 as varchar(9)), ',"longitude":', cast(event_id % 170 as varchar(9)),
 ',"probability":0.', cast(1 + event_id % 9 as varchar(9)), ',"radius_km":', cast(5 + event_id % 900 as varchar(9)), '}]}') as body
from events""",
    "requests": """
select user_id as client, event_id as seq, ts,
 cast(case event_type when 'purchase' then 5 when 'signup' then 3 else 1 end as double) as cost from events""",
}

DEPENDS = {"cells": ("places",), "predictions": ("photos",)}

Query = Callable[["Views"], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
_SHARED: dict[tuple[str, str, str], object] = {}


class Views:
    """Lazy access to the given tables and the derived views of one data folder: ``v.photos``, ``v.events``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = ensure_runtime(spark)
        self.folder = folder.rstrip("/")

    def memo(self, key: str, make: Callable[[], object]):
        """Build a shared dimension (cell model, rule table) once per application and data folder."""
        full = (self.spark.sparkContext.applicationId, self.folder, key)
        if full not in _SHARED:
            _SHARED[full] = make()
        return _SHARED[full]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEW_SQL:
            return self.sql(VIEW_SQL[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        import re

        for name in [*TABLES, *VIEW_SQL]:
            if re.search(rf"\b(?:from|join)\s+{name}\b", text):
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def with_views(names: str, body: str) -> str:
    """Prefix DuckDB SQL with the named views (and what they depend on) as CTEs."""
    order: list[str] = []
    for n in names.split():
        for d in (*DEPENDS.get(n, ()), n):
            if d not in order:
                order.append(d)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n].strip()})" for n in order)
    return f"with {ctes},\n{body[4:].lstrip()}" if body.lower().startswith("with") else f"with {ctes}\n{body}"


def query(key: str, views: str = "", oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key`` together with the SQL that checks it."""

    def add(fn: Query) -> Query:
        assert key not in _QUERIES, key
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLE[key] = with_views(views, oracle)
        return fn

    return add


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    return _QUERIES, _ORACLE
