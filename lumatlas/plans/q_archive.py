"""Archive, leads, filters on answers, privacy projections and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, metadata, names, times
from ..operators import archive as A
from ..operators import changes as H
from ..operators import places as P
from ..operators import results as S
from .q_scalars import r6
from .sqlparts import hav
from .views import query

# Archive rows built on the reports: a result, a report for every third photo, some pins, street and skyline answers.
ARCH = """arch as (select photo_id, group_id, group_id%50 as album_id, taken_at, concat('p', cast(photo_id as varchar(20)), '.jpg') as filename,
  case when photo_id%17=0 then lat+0.5 end as user_lat, case when photo_id%17=0 then lon+0.5 end as user_lon,
  case cast(photo_id%6 as integer) when 0 then 'exact' when 1 then 'street' when 2 then 'city' when 3 then 'region' when 4 then 'world' else 'country' end as res,
  cast((photo_id*7)%101 as double) as res_conf, lat, lon, case when photo_id%3=0 then prec end as prec, confidence/100 as rep_conf,
  photo_id%19=0 as st_ok, photo_id%2=0 as in_view, photo_id%23=0 as sky_ok, case when photo_id%5=0 then 'beach' end as scene from reports)"""


def arch(v):
    a = v.sql(f"with {ARCH} select * from arch")
    when = F.when
    return a.select(
        "photo_id", "group_id", "album_id", "taken_at", "filename", "user_lat", "user_lon", F.lit("").alias("user_label"),
        F.struct("lat", "lon", F.concat(F.lit("R"), F.col("photo_id").cast("string")).alias("label"), F.col("res").alias("resolution"), F.col("res_conf").alias("confidence"), "scene", F.lit("").alias("era")).alias("result"),
        when(F.col("prec").isNotNull(), F.struct((F.col("lat") + 0.1).alias("lat"), (F.col("lon") + 0.1).alias("lon"), F.col("prec").alias("precision"), F.col("rep_conf").alias("confidence"), F.concat(F.lit("P"), F.col("photo_id").cast("string")).alias("place_name"))).alias("report"),
        when(F.col("st_ok"), F.struct(F.col("st_ok").alias("verified"), (F.col("lat") + 0.2).alias("lat"), F.col("lon").alias("lon"), F.lit("2024-01-01").alias("captured_at"), F.lit("1 Main").alias("address"), "in_view")).alias("street"),
        when(F.col("sky_ok"), F.struct(F.col("sky_ok").alias("pinned"), F.col("lat").alias("lat"), (F.col("lon") + 0.2).alias("lon"), F.lit(0.7).alias("confidence"))).alias("skyline"),
    )


OPTS = f"""{ARCH}, opts as (select photo_id, group_id, 0 as kind, user_lat as lat, user_lon as lon, 'Set by you' as label, 'you' as source, 100.0 as confidence, 'exact' as resolution from arch where user_lat is not null
 union all select photo_id, group_id, 1, lat, lon, concat('R', cast(photo_id as varchar)), 'photo', res_conf, res from arch where res <> 'world'
 union all select photo_id, group_id, 2, lat+0.1, lon+0.1, concat('P', cast(photo_id as varchar)), 'photo', round_even(100*rep_conf,1), prec from arch where prec in ('exact','street','city','region')
 union all select photo_id, group_id, 3, lat+0.2, lon, case when in_view then 'Facing 1 Main' else 'Matched street photo from 2024-01-01' end, 'photo', 95.0, 'exact' from arch where st_ok
 union all select photo_id, group_id, 4, lat, lon+0.2, 'Mountain skyline match', 'photo', 70.0, 'street' from arch where sky_ok),
rk as (select *, case resolution when 'exact' then 6 when 'street' then 5 when 'city' then 4 when 'region' then 3 when 'country' then 2 when 'continent' then 1 else 0 end + case when source='you' then 10 else 0 end as s from opts),
own as (select * from (select *, row_number() over (partition by photo_id order by s desc, confidence desc, kind) as rn from rk where resolution in ('exact','street')) where rn=1),
gb as (select * from (select *, row_number() over (partition by group_id order by s desc, confidence desc, photo_id) as gr from own) where gr=1),
loc as (select a.photo_id, a.group_id, a.album_id, a.taken_at, a.scene, a.res, a.prec, case when g.photo_id is not null and g.photo_id<>a.photo_id and (o.photo_id is null or g.s>o.s or (g.s=o.s and g.confidence>o.confidence)) then true else false end as inh,
  o.lat as olat, o.lon as olon, o.label as olabel, o.source as osource, o.confidence as oconf, o.s as os, g.lat as glat, g.lon as glon, g.label as glabel, g.confidence as gconf, g.photo_id as donor, o.resolution as ores, g.resolution as gres
  from arch a left join own o using (photo_id) left join gb g on g.group_id=a.group_id),
res as (select *, case when inh then glat else olat end as lat, case when inh then glon else olon end as lon, case when inh then glabel else olabel end as label,
  case when inh then 'group' else osource end as source, case when inh then donor end as via, case when inh then gconf else oconf end as conf from loc)"""


@query("set_locations_union", "reports", f"with {OPTS} select photo_id, kind, round(lat,6) as lat, round(lon,6) as lon, label, source, round(confidence,4) as confidence, resolution from opts")
def _(v):
    o = arch(v).select("photo_id", F.explode(A.location_options()).alias("o"))
    return o.select("photo_id", "o.kind", r6(F.col("o.lat")).alias("lat"), r6(F.col("o.lon")).alias("lon"), "o.label", "o.source", F.round("o.confidence", 4).alias("confidence"), "o.resolution")


@query("agg_location_strength", "reports", f"with {OPTS} select photo_id, kind, label, source, resolution, round(confidence,4) as confidence from own")
def _(v):
    o = A.with_own(arch(v)).filter("own is not null")
    return o.select("photo_id", "own.kind", "own.label", "own.source", "own.resolution", F.round("own.confidence", 4).alias("confidence"))


@query("flt_pinned", "reports", f"with {OPTS} select photo_id, kind, resolution from opts where resolution in ('exact','street')")
def _(v):
    o = arch(v).select("photo_id", F.explode(A.location_options()).alias("o")).select("photo_id", "o.kind", "o.resolution")
    return o.filter(F.col("resolution").isin(*names.PINNED))


@query("join_group_best", "reports", f"with {OPTS} select photo_id, source, via, label, round(lat,6) as lat, round(lon,6) as lon from res where source is not null")
def _(v):
    r = A.resolve(A.with_own(arch(v))).filter("location is not null")
    return r.select("photo_id", "location.source", "via", "location.label", r6(F.col("location.lat")).alias("lat"), r6(F.col("location.lon")).alias("lon"))


@query(
    "agg_group_summary",
    "reports",
    f"""with {OPTS}, r2 as (select *, case when inh then case gres when 'exact' then 6 else 5 end else os end as s from res),
      g as (select group_id, count(*) as photos from arch group by 1),
      b as (select * from (select group_id, label, row_number() over (partition by group_id order by s desc, conf desc, photo_id) as rn from r2 where source is not null) where rn=1)
    select group_id, concat('G', cast(group_id as varchar)) as name, photos, label from g left join b using (group_id)""",
)
def _(v):
    r = A.resolve(A.with_own(arch(v)))
    groups = v.reports.select("group_id").distinct().withColumn("name", F.concat(F.lit("G"), F.col("group_id").cast("string")))
    return A.group_summary(r, groups).select("group_id", "name", "photos", F.col("best.label").alias("label"))


@query(
    "agg_album_counts",
    "reports",
    f"with {OPTS} select album_id, count(*) filter (source is not null) as located, count(*) filter (source is null) as open, count(*) as photos from res group by 1",
)
def _(v):
    r = A.resolve(A.with_own(arch(v)))
    has = F.col("location").isNotNull()
    return r.groupBy("album_id").agg(F.count_if(has).alias("located"), F.count_if(~has).alias("open"), F.count("*").alias("photos"))


@query("flt_located", "reports", f"with {OPTS} select photo_id from res where source is null")
def _(v):
    return A.resolve(A.with_own(arch(v))).filter("location is null").select("photo_id")


SAME = """pin as (select photo_id, album_id, taken_at from photos where photo_id%5=0),
sd as (select p.photo_id, q.photo_id as near_id, abs(epoch_us(p.taken_at)-epoch_us(q.taken_at))/3.6e9 as h,
  row_number() over (partition by p.photo_id order by abs(epoch_us(p.taken_at)-epoch_us(q.taken_at)), q.photo_id) as rn
  from photos p join pin q on p.album_id=q.album_id and p.photo_id<>q.photo_id and abs(epoch_us(p.taken_at)-epoch_us(q.taken_at)) <= 12*3600000000)"""


def near_photos(v):
    p = v.photos.select("photo_id", "album_id", times.micros("taken_at").alias("micros"))
    return A.same_day(p, p.filter("photo_id % 5 = 0"))


@query("join_same_day", "photos", f"with {SAME} select photo_id, near_id, round(h,6)+0.0 as hours from sd where rn=1")
def _(v):
    return near_photos(v).select("photo_id", "near_id", r6(F.col("hours")).alias("hours"))


@query(
    "fn_lead_with_same_day",
    "photos",
    f"""with {SAME}, l as (select photo_id, case photo_id%3 when 0 then 9.0 when 1 then 25.0 end as km2, lat, lon from photos),
      j as (select l.*, sd.h, n.lat as nlat, n.lon as nlon from l left join sd on sd.photo_id=l.photo_id and rn=1 left join photos n on n.photo_id=sd.near_id),
      t as (select *, h is not null and (km2 is null or km2>9 or h<=3) as take from j)
    select photo_id, case when take then nlat else lat end as lat, case when take then nlon else lon end as lon,
      case when take then case when h<=3 then 9.0 else 25.0 end else km2 end as km2 from t where take or km2 is not null""",
)
def _(v):
    p = v.photos.select("photo_id", "lat", "lon")
    k = F.col("photo_id") % 3
    km2 = F.when(k == 0, 9.0).when(k == 1, 25.0)
    lead = F.when(km2.isNotNull(), F.struct("lat", "lon", km2.alias("km2")))
    j = p.withColumn("lead", lead).join(near_photos(v), "photo_id", "left")
    n = p.select(F.col("photo_id").alias("near_id"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    j = j.join(n, "near_id", "left")
    out = j.select("photo_id", names.lead_with_same_day("lead", "nlat", "nlon", "hours").alias("l")).filter("l is not null")
    return out.select("photo_id", "l.lat", "l.lon", "l.km2")


@query(
    "prj_album_summary",
    "reports",
    f"""with {OPTS}, sd as (select p.photo_id, q.photo_id as near_id, abs(epoch_us(p.taken_at)-epoch_us(q.taken_at))/3.6e9 as h,
       row_number() over (partition by p.photo_id order by abs(epoch_us(p.taken_at)-epoch_us(q.taken_at)), q.photo_id) as rn
       from res p join res q on p.album_id=q.album_id and p.photo_id<>q.photo_id and q.olabel is not null and abs(epoch_us(p.taken_at)-epoch_us(q.taken_at)) <= 12*3600000000 where p.source is null)
    select res.photo_id, res.scene, concat('G', cast(res.group_id as varchar)) as group_name, res.source, case when res.source is not null then null
      when sd.h is not null then concat('Same day as p', cast(near_id as varchar), '.jpg at ', n.olabel, ' (', case when h<1 then 'within the hour' else concat(cast(cast(round_even(h,0) as bigint) as varchar), ' h apart') end, ')')
      when res.prec in ('city','region') then concat('P', cast(res.photo_id as varchar), ' · ', res.prec)
      when res.res not in ('world','exact','street') then concat('R', cast(res.photo_id as varchar), ' · ', res.res) end as lead
    from res left join sd on sd.photo_id=res.photo_id and rn=1 left join res n on n.photo_id=sd.near_id""",
)
def _(v):
    groups = v.reports.select("group_id").distinct().withColumn("name", F.concat(F.lit("G"), F.col("group_id").cast("string")))
    s = A.album_summary(arch(v), groups)
    return s.select("photo_id", "scene", "group_name", F.col("location.source").alias("source"), "lead")


@query(
    "prj_lead_text",
    "reports",
    f"""with {ARCH} select photo_id, case when prec in ('city','region') then concat('P', cast(photo_id as varchar), ' · ', prec)
      when res not in ('world','exact','street') then concat('R', cast(photo_id as varchar), ' · ', res) end as lead from arch""",
)
def _(v):
    return arch(v).select("photo_id", A.lead_text().alias("lead"))


@query(
    "flt_already_searched",
    "reports",
    "select photo_id, lat, lon from reports where not (photo_id%4=0 and lat between 0 and 50 and lon between -100 and 100)",
)
def _(v):
    box = v.reports.filter("photo_id % 4 = 0").select("photo_id", F.lit(0.0).alias("south"), F.lit(-100.0).alias("west"), F.lit(50.0).alias("north"), F.lit(100.0).alias("east"))
    return A.already_searched(v.reports.select("photo_id", "lat", "lon"), box)


@query("flt_indoor", "photos", "select photo_id, scene from photos where scene not in ('home','bar_restaurant','other_indoor','view')")
def _(v):
    return v.photos.filter(~F.col("scene").isin(*A.INDOOR, "view")).select("photo_id", "scene")


# ---- fixes and boxes ---------------------------------------------------------------------------


@query(
    "flt_valid_fix",
    "photos",
    """with f as (select photo_id, case when photo_id%11=0 then 0.0 when photo_id%13=0 then null else lat*2 end as lat, case when photo_id%11=0 then 0.0 else lon*1.2 end as lon from photos)
    select photo_id, round(lat,6)+0.0 as lat, round(lon,6)+0.0 as lon from f where lat between -90 and 90 and lon between -180 and 180 and not (abs(lat)<1e-6 and abs(lon)<1e-6)""",
)
def _(v):
    k = F.col("photo_id")
    f = v.photos.select(
        "photo_id", F.when(k % 11 == 0, 0.0).when(k % 13 != 0, F.col("lat") * 2).alias("lat"), F.when(k % 11 == 0, 0.0).otherwise(F.col("lon") * 1.2).alias("lon")
    )
    return f.filter(geo.valid_fix("lat", "lon")).select("photo_id", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query(
    "flt_first_fix",
    "photos",
    """select photo_id, case when photo_id%2=0 then round_even(lat,7) when photo_id%3=0 then round_even(lat+1,7) else round_even(lat+2,7) end as lat,
      case when photo_id%2=0 then 'exif' when photo_id%3=0 then 'xmp' else 'client' end as source from photos where photo_id%2=0 or photo_id%3=0 or photo_id%5<>0""",
)
def _(v):
    k = F.col("photo_id")
    lat = lambda d: F.col("lat") + d
    e = metadata.fix(F.when(k % 2 == 0, lat(0)), "lon", "exif")
    x = metadata.fix(F.when(k % 3 == 0, lat(1)), "lon", "xmp")
    c = metadata.fix(F.when(k % 5 != 0, lat(2)), "lon", "client")
    f = v.photos.select("photo_id", metadata.first_fix(e, x, c).alias("f")).filter("f is not null")
    return f.select("photo_id", "f.lat", "f.source")


@query("flt_bbox", "photos", "select photo_id, lat, lon from photos where lat between 10 and 45.5 and lon between -20 and 60")
def _(v):
    return v.photos.filter(geo.inside_box("lat", "lon", 10, -20, 45.5, 60)).select("photo_id", "lat", "lon")


@query(
    "flt_bbox_covers",
    "photos places",
    """select place_id, count(*) as covered from places join photos on photos.lat-0.5>=places.lat-5 and photos.lon-0.5>=places.lon-5 and photos.lat+0.5<=places.lat+5 and photos.lon+0.5<=places.lon+5 group by 1""",
)
def _(v):
    from ..operators.spatial import box_join

    p = v.places.select("place_id", (F.col("lat") - 5).alias("s"), (F.col("lon") - 5).alias("w"), (F.col("lat") + 5).alias("n"), (F.col("lon") + 5).alias("e"))
    b = v.photos.select("photo_id", "lat", "lon")
    j = box_join(p, b, ("s", "w", "n", "e"), 5.0)
    inner = (F.col("lat") - 0.5 >= F.col("s")) & (F.col("lon") - 0.5 >= F.col("w")) & (F.col("lat") + 0.5 <= F.col("n")) & (F.col("lon") + 0.5 <= F.col("e"))
    return j.filter(inner).groupBy("place_id").agg(F.count("*").alias("covered"))


@query(
    "flt_bbox_valid",
    "photos",
    """with b as (select photo_id, lat*2 as s, lon as w, lat*2+(photo_id%3-1)*0.5 as n, lon*1.1+1 as e from photos)
    select photo_id from b where s>=-90 and s<n and n<=90 and w>=-180 and w<e and e<=180""",
)
def _(v):
    b = v.photos.select("photo_id", (F.col("lat") * 2).alias("s"), F.col("lon").alias("w"), (F.col("lat") * 2 + (F.col("photo_id") % 3 - 1) * 0.5).alias("n"), (F.col("lon") * 1.1 + 1).alias("e"))
    return b.filter(S.valid_box("s", "w", "n", "e")).select("photo_id")


@query(
    "flt_area_limit",
    "photos",
    """with b as (select photo_id, abs(0.01*(1+photo_id%9))*111.32*abs(0.05)*111.32*cos(radians((lat+lat+0.01*(1+photo_id%9))/2)) as a from photos)
    select photo_id, case when a > 6 then 'area_too_large' else 'ok' end as status from b""",
)
def _(v):
    n = F.col("lat") + F.lit(0.01) * (1 + F.col("photo_id") % 9)
    a = geo.bbox_area_km2("lat", "lon", n, F.col("lon") + 0.05)
    return v.photos.select("photo_id", S.area_status(a, 6.0).alias("status"))


# ---- reports -----------------------------------------------------------------------------------


@query("flt_report_pinned", "reports", "select photo_id from reports where prec in ('exact','street') and confidence/100 >= 0.5")
def _(v):
    return v.reports.filter(S.report_pinned("prec", "lat", "lon", F.col("confidence") / 100)).select("photo_id")


@query(
    "flt_report_coords",
    "reports",
    """select photo_id, case when lat*2 between -90 and 90 and lon*1.2 between -180 and 180 then round(lat*2,6)+0.0 end as lat,
      case when lat*2 between -90 and 90 and lon*1.2 between -180 and 180 then round(lon*1.2,6)+0.0 end as lon from reports""",
)
def _(v):
    lat, lon = S.report_coords(F.col("lat") * 2, F.col("lon") * 1.2)
    return v.reports.select("photo_id", r6(lat).alias("lat"), r6(lon).alias("lon"))


@query(
    "flt_skyline_pinned",
    "reports",
    "select photo_id, photo_id%3<>0 and confidence/100>=0.5 as pinned, case when photo_id%3<>0 then lat end as lat from reports",
)
def _(v):
    status = F.when(F.col("photo_id") % 3 != 0, "ok").otherwise("too_flat")
    s = S.skyline_answer(status, F.col("confidence") / 100, "lat", "lon")
    return v.reports.select("photo_id", s.alias("s")).select("photo_id", "s.pinned", "s.lat")


@query(
    "prj_coarsen",
    "reports",
    """select photo_id, case when photo_id%2=0 then round_even(lat,1) else lat end + 0.0 as lat, case when photo_id%2=0 then greatest(confidence,10.0) else confidence end as radius_km,
      case when photo_id%2=0 and prec='street' then 'city' else prec end as resolution, photo_id%2=0 as coarsened from reports""",
)
def _(v):
    r = v.reports.select("photo_id", "lat", "lon", F.col("confidence").alias("radius_km"), F.col("prec").alias("resolution"), (F.col("photo_id") % 2 == 0).alias("people_main"))
    c = S.coarsen(r)
    return c.select("photo_id", (F.col("lat") + F.lit(0.0)).alias("lat"), "radius_km", "resolution", "coarsened")


@query(
    "prj_coarsen_report",
    "reports",
    """with c as (select *, photo_id%2=0 and prec in ('exact','street') as c from reports)
    select photo_id, case when c then round_even(lat,1) else lat end + 0.0 as lat, case when c then 'city' else prec end as prec, case when c then '' else '1 Main' end as address,
      case when c then 'Town, Land' else 'Bar, Street, Town, Land' end as place_name, case when c then 0 else 2 end as links from c""",
)
def _(v):
    r = v.reports.select(
        "photo_id", "lat", "lon", F.col("prec").alias("precision"), F.lit("1 Main").alias("address"), F.lit("Bar, Street, Town, Land").alias("place_name"),
        F.lit("why").alias("summary"), F.array(F.lit("a"), F.lit("b")).alias("evidence_chain"), (F.col("photo_id") % 2 == 0).alias("people_main"),
    )
    c = S.coarsen_report(r)
    return c.select("photo_id", (F.col("lat") + F.lit(0.0)).alias("lat"), F.col("precision").alias("prec"), "address", "place_name", F.size("evidence_chain").alias("links"))


# ---- names -------------------------------------------------------------------------------------


def _named(v):
    d = (F.col("place_id") % 40).cast("double") + 0.5
    p = P.with_country(v.places.select("place_id", "name", "admin1", "iso2"), v.countries, "iso2")
    p = p.withColumn("admin1", F.when(F.col("place_id") % 7 == 0, "").when(F.col("place_id") % 5 == 0, F.col("name")).otherwise(F.col("admin1")))
    return p.withColumn("d", d).withColumn("display", names.display_name("name", "admin1", "country", "d"))


NAMED = """nm as (select place_id, p.name, case when place_id%7=0 then '' when place_id%5=0 then p.name else admin1 end as admin1, c.name as country, c.continent, place_id%40+0.5 as d from places p join countries c using (iso2)),
lb as (select *, case when admin1='' or admin1=name then concat(name, ', ', country) else concat(name, ', ', admin1, ', ', country) end as l from nm),
dn as (select *, case when d>25 then concat('~', cast(cast(round_even(d,0) as bigint) as varchar), ' km from ', l) when d>3 then concat('Near ', l) else l end as display from lb)"""


@query("prj_display_name", "places countries", f"with {NAMED} select place_id, display from dn")
def _(v):
    return _named(v).select("place_id", "display")


@query(
    "prj_name_at_resolution",
    "places countries",
    f"""with {NAMED}, r as (select *, case cast(place_id%6 as integer) when 0 then 'exact' when 1 then 'city' when 2 then 'region' when 3 then 'country' when 4 then 'continent' else 'world' end as res from dn)
    select place_id, case when res in ('exact','city') then display when res='region' then case when admin1<>'' then concat(admin1, ', ', country) else country end
      when res='country' then country when res='continent' then continent else 'Unknown location' end as label from r""",
)
def _(v):
    res = F.element_at(F.array(*[F.lit(x) for x in ("exact", "city", "region", "country", "continent", "world")]), (F.col("place_id") % 6 + 1).cast("int"))
    return _named(v).select("place_id", names.name_at_resolution(res, "display", "admin1", "country", "country_continent").alias("label"))


@query(
    "prj_level_labels",
    "places countries cells",
    """select distinct 'continent' as level, continent as key, continent as label from cells union all select distinct 'country', iso2, coalesce(countries.name, iso2) from cells left join countries using (iso2)
    union all select distinct 'admin1', admin1, split_part(admin1,'/',2) from cells union all select 'leaf', cast(leaf as varchar), name from cells""",
)
def _(v):
    from ..operators.cells import level_labels

    return level_labels(v.cells, v.countries)


@query(
    "prj_gps_result",
    "places countries photos",
    f"""with d as (select photo_id, photos.lat, photos.lon, p.name, p.admin1, p.iso2, {hav('photos.lat', 'photos.lon', 'p.lat', 'p.lon')} as km, population, place_id from photos, places p),
    r as (select *, row_number() over (partition by photo_id order by round(km-2*log10(greatest(population,10.0)),9), place_id) as rn from d)
    select photo_id, lat, lon, 15.0 as uncertainty_radius_m, 99.0 as confidence, 'exact' as resolution, c.name as country, c.continent as continent, iso2 as country_code, 0.99 as probability
    from r join countries c using (iso2) where rn=1""",
)
def _(v):
    g = S.gps_results(P.reverse_geocode(v.photos.select("photo_id", "lat", "lon"), v.places, v.countries))
    h = F.col("hierarchy")
    return g.select(
        "photo_id", "lat", "lon", "uncertainty_radius_m", "confidence", "resolution", h[1]["name"].alias("country"), h[0]["name"].alias("continent"), h[1]["code"].alias("country_code"), h[1]["probability"].alias("probability")
    )


@query("prj_explain")
def _(v):
    from .q_evidence import attributions

    a = attributions(v).withColumn("label", F.col("key"))
    head = F.lit("Best estimate.")
    return S.explain(a, head)


# ---- changes -----------------------------------------------------------------------------------

CHG = """chg as (select l_orderkey as photo_id, cast(l_linenumber*1000000 + l_partkey as bigint) as seq, case l_linenumber%4 when 0 then 'note' when 1 then 'user_label' when 2 then 'group_id' else 'status' end as field,
  case when l_suppkey%5=0 then null else cast(l_partkey as varchar(20)) end as value from lineitem)"""


@query(
    "set_patch_photos",
    "reports",
    f"""with {CHG}, l as (select *, row_number() over (partition by photo_id, field order by seq desc, value desc nulls last) as rn from chg where field <> 'status'),
      p as (select photo_id, max(case when field='note' then 1 end) as hn, max(case when field='note' then value end) as n, max(case when field='user_label' then 1 end) as hu, max(case when field='user_label' then value end) as u,
        max(case when field='group_id' then 1 end) as hg, max(case when field='group_id' then value end) as g from l where rn=1 group by 1)
    select photo_id, case when hn=1 then n else 'old' end as note, case when hu=1 then u end as user_label, case when hg=1 then cast(g as bigint) else group_id end as group_id from reports left join p using (photo_id)""",
)
def _(v):
    base = v.reports.select("photo_id", F.lit("old").alias("note"), F.lit(None).cast("string").alias("user_label"), "group_id")
    return H.patch_photos(base, v.sql(f"with {CHG} select * from chg"))


@query(
    "set_result_coalesce",
    "",
    """with g as (select l_orderkey as photo_id, l_linenumber*1000000+l_partkey as seq, case when l_suppkey%3=0 then null else l_partkey end as result, case when l_suppkey%3=0 then concat('e', cast(l_partkey as varchar)) end as error from lineitem),
      r as (select *, row_number() over (partition by photo_id order by seq desc, error desc nulls last) as rn, row_number() over (partition by photo_id, result is null order by seq desc, result desc) as rr from g)
    select photo_id, case when max(case when rn=1 then error end) is not null then 'error' else 'done' end as status, max(case when rr=1 and result is not null then result end) as result, max(case when rn=1 then error end) as error from r group by 1""",
)
def _(v):
    log = v.sql(
        """select l_orderkey as photo_id, cast(l_linenumber*1000000+l_partkey as bigint) as seq, case when l_suppkey%3=0 then null else l_partkey end as result,
        case when l_suppkey%3=0 then concat('e', cast(l_partkey as varchar(20))) end as error from lineitem"""
    )
    return H.latest_results(log)


@query(
    "set_group_changes",
    "reports",
    """with g as (select o_custkey as group_id, o_orderkey as seq, case when o_orderkey%7=0 then 'delete' when o_orderkey%2=0 then 'rename' else 'create' end as op, concat('n', cast(o_orderkey as varchar)) as name from orders),
      l as (select group_id, arg_max(op, seq) as op, arg_max(name, seq) filter (op<>'delete') as name from g group by 1)
    select photo_id, l.group_id, l.name as group_name from reports left join l on l.group_id=reports.group_id and l.op<>'delete'""",
)
def _(v):
    log = v.sql(
        """select o_custkey as group_id, o_orderkey as seq, case when o_orderkey%7=0 then 'delete' when o_orderkey%2=0 then 'rename' else 'create' end as op,
        concat('n', cast(o_orderkey as varchar(20))) as name from orders"""
    )
    live = H.replay_groups(log)
    p = H.detach_deleted(v.reports.select("photo_id", "group_id"), live)
    return p.join(live.withColumnRenamed("name", "group_name"), "group_id", "left").select("photo_id", "group_id", "group_name")


@query("set_delete_photos", "photos", "select photo_id from photos where photo_id not in (select l_orderkey from lineitem where l_linenumber=1)")
def _(v):
    dead = v.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("photo_id"))
    return H.delete_photos(v.photos.select("photo_id"), dead)


@query(
    "set_feedback_promote",
    "geo_index cells",
    f"""with f as (select vec_id as feedback_id, lat, lon, len(embedding) as dim from geo_index where vec_id%3=0),
      d as (select f.*, leaf, row_number() over (partition by feedback_id order by round({hav('f.lat','f.lon','c.lat','c.lon')}/scale_km,9), leaf) as rn from f, cells c)
    select feedback_id, lat, lon, leaf, dim from d where rn=1""",
)
def _(v):
    f = v.geo_index.select(F.col("vec_id").alias("feedback_id"), "embedding", "lat", "lon", F.when(F.col("vec_id") % 3 == 0, "approved").otherwise("pending_review").alias("status"))
    return H.promote_feedback(f, v.cells).select("feedback_id", "lat", "lon", "leaf", F.size("embedding").alias("dim"))


@query(
    "set_evidence_union",
    "detections text_lines",
    """with d as (select distinct photo_id, 'cue' as source, cue as key from detections where cue<>'person'),
      t as (select photo_id, 'text' as source, case photo_id%8 when 1 then 'word:hu_street' when 2 then 'phone:48' when 3 then 'tld:BR' when 5 then 'script:cyrillic' when 6 then 'phone:351' end as key from text_lines where score>=0.5)
    select * from d union all select * from t where key is not null union all select photo_id, 'text', k from text_lines, (select unnest(['letter:de','word:de_street']) as k) where score>=0.5 and photo_id%8=0
    union all select photo_id, 'text', 'script:kana' from text_lines where score>=0.5 and photo_id%8=4""",
)
def _(v):
    from ..operators import textcues as X
    from .q_evidence import observations

    cue = observations(v).select("photo_id", F.lit("cue").alias("source"), F.col("rule").alias("key"))
    text = X.analyse(v.text_lines).select("photo_id", F.lit("text").alias("source"), F.col("rule").alias("key"))
    return cue.unionByName(text)
