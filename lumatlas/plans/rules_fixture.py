"""Cue rules for the derived views' country codes, one of each kind, as plain data and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.evidence import RULE_SCHEMA, expand_drives_on

# The rules the checks below repeat in SQL.
RULES = [
    ("left_hand_traffic", "Vehicles driving on the left", None, None, "L", 6.0, None, 0.08),
    ("right_hand_traffic", "Vehicles driving on the right", None, None, "R", 1.4, None, 0.08),
    ("joshua_tree", "Joshua tree", None, [(34.9, -116.2, 160.0, 800.0)], None, None, None, 0.01),
    ("date_palm", "Date palms", {"N3": 10.0, "N7": 8.0, "N12": 5.0, "N18": 4.0}, None, None, None, None, 0.15),
    ("snow_ground", "Snow on the ground", None, None, None, None, (35.0, 90.0, True, 4.0), 0.1),
]


def rules(spark: SparkSession, countries: DataFrame) -> DataFrame:
    return expand_drives_on(spark.createDataFrame(RULES, RULE_SCHEMA), countries)


# Dense reading of the same rules over every observation and leaf.
DENSE = """
obs as (select photo_id, cue, score from (select *, row_number() over (partition by photo_id, cue order by score desc, det_id) as rn
  from detections where cue <> 'person') where rn = 1),
rc(cue, iso2, lr) as (select 'left_hand_traffic', iso2, 6.0e0 from countries where drives_on='L'
  union all select 'right_hand_traffic', iso2, 1.4e0 from countries where drives_on='R'
  union all select * from (values ('date_palm','N3',10.0e0),('date_palm','N7',8.0e0),('date_palm','N12',5.0e0),('date_palm','N18',4.0e0))),
oth(cue, o) as (values ('left_hand_traffic',0.08e0),('right_hand_traffic',0.08e0),('joshua_tree',0.01e0),('date_palm',0.15e0),('snow_ground',0.1e0)),
pr as (select *, exp(log_prior)/sum(exp(log_prior)) over () as p0 from cells),
ms as (select max(scale_km) as ms from cells),
geo as (select pr.*, 2*6371.0088*asin(sqrt(least(1.0,greatest(0.0,pow(sin(radians(lat-34.9)/2),2)+cos(radians(34.9))*cos(radians(lat))*pow(sin(radians(lon+116.2)/2),2))))) as dj from pr),
dense as (select obs.photo_id, obs.cue, geo.leaf, obs.score, oth.o,
  case obs.cue when 'joshua_tree' then oth.o + 800*exp(-0.5*pow(dj/sqrt(160.0*160.0+scale_km*scale_km),2))
    when 'snow_ground' then case when abs(geo.lat) between 35 and 90 then 4.0 else oth.o end
    else coalesce(rc.lr, oth.o) end as r,
  case obs.cue when 'joshua_tree' then dj <= 9*sqrt(160.0*160.0+ms*ms) when 'snow_ground' then abs(geo.lat) between 35 and 90
    else rc.lr is not null end as touched
  from obs join oth using (cue) cross join geo cross join ms left join rc on rc.cue=obs.cue and rc.iso2=geo.iso2),
tot as (select photo_id, leaf, sum(ln((1-score)+score*r)) as ll, sum(ln((1-score)+score*o)) as dd, bool_or(touched) as touched
  from dense group by photo_id, leaf),
post as (select t.*, g.continent, g.iso2, g.admin1, g.name, g.lat, g.lon, g.scale_km, g.p0, g.p0*exp(ll)/sum(g.p0*exp(ll)) over (partition by photo_id) as p,
  exp(dd)/sum(g.p0*exp(ll)) over (partition by photo_id) as u from tot t join geo g using (leaf))"""
