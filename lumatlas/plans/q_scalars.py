"""Scalar functions (fn_*) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, geo, metadata, names, times, vectors
from ..operators import street, vector_ops
from .sqlparts import hav, pmod
from .views import query


def r6(c, d: int = 6):
    return F.round(c, d) + F.lit(0.0)


def quick6(name: str):
    """``r6`` of a column, bit for bit: the decimal text that rounding goes through is only needed close to a half."""
    x = F.col(name)
    y = x * 1e6
    clear = (F.abs(F.abs(y - F.rint(y)) - 0.5) > 1e-4) & (F.abs(y) < 1e9)
    return F.when(clear, F.rint(y) / 1e6).otherwise(F.round(x, 6)) + F.lit(0.0)


# ---- geometry ---------------------------------------------------------------------------------


@query(
    "fn_haversine_km",
    "predictions",
    f"select photo_id, round({hav('true_lat', 'true_lon', 'lat', 'lon')}, 6) + 0.0 as km from predictions",
)
def _(v):
    return v.predictions.select("photo_id", r6(geo.haversine_km("true_lat", "true_lon", "lat", "lon")).alias("km"))


@query(
    "fn_unit_vector",
    "photos",
    """with u as (select photo_id, cos(radians(lat))*cos(radians(lon)) as x, cos(radians(lat))*sin(radians(lon)) as y,
      sin(radians(lat)) as z from photos)
    select photo_id, round(x,6)+0.0 as x, round(y,6)+0.0 as y, round(z,6)+0.0 as z,
      round(degrees(asin(z/(sqrt(x*x+y*y+z*z)+1e-12))),4)+0.0 as lat, round(degrees(atan2(y,x)),4)+0.0 as lon from u""",
)
def _(v):
    u = v.photos.select("photo_id", geo.unit_vector("lat", "lon").alias("u"))
    x, y, z = F.col("u.x"), F.col("u.y"), F.col("u.z")
    return u.select(
        "photo_id",
        r6(x).alias("x"),
        r6(y).alias("y"),
        r6(z).alias("z"),
        r6(geo.vector_lat(x, y, z), 4).alias("lat"),
        r6(geo.vector_lon(x, y), 4).alias("lon"),
    )


_DEST_LAT = "asin(sin(radians(lat))*cos(d)+cos(radians(lat))*sin(d)*cos(b))"


@query(
    "fn_destination",
    "photos",
    f"""with s as (select photo_id, lat, lon, (1 + photo_id % 3000)/6371.0088 as d,
        radians(cast(photo_id % 360 as double)) as b from photos),
      e as (select photo_id, {_DEST_LAT} as p2, radians(lon) + atan2(sin(b)*sin(d)*cos(radians(lat)),
        cos(d)-sin(radians(lat))*sin({_DEST_LAT})) as l2 from s)
    select photo_id, round({pmod('degrees(l2)+540', '360')}-180, 6)+0.0 as lon, round(degrees(p2), 6)+0.0 as lat from e""",
)
def _(v):
    d = geo.destination(
        "lat", "lon", (1 + F.col("photo_id") % 3000).cast("double"), (F.col("photo_id") % 360).cast("double")
    )
    p = v.photos.select("photo_id", d.alias("d"))
    return p.select("photo_id", r6(F.col("d.lon")).alias("lon"), r6(F.col("d.lat")).alias("lat"))


@query(
    "fn_circle_polygon",
    "places",
    f"""with s as (select place_id, lat, lon, i, least(population/40.0, 19000.0)/6371.0088 as d,
        radians(i/96.0*360) as b from places, (select unnest(range(0, 97)) as i)),
      e as (select place_id, i, {_DEST_LAT} as p2, radians(lon) + atan2(sin(b)*sin(d)*cos(radians(lat)),
        cos(d)-sin(radians(lat))*sin({_DEST_LAT})) as l2 from s)
    select place_id, cast(i as integer) as step, round({pmod('degrees(l2)+540', '360')}-180, 5)+0.0 as lon,
      round(degrees(p2), 5)+0.0 as lat from e""",
)
def _(v):
    ring = geo.circle_polygon("lat", "lon", F.col("population") / 40.0)
    p = v.places.select("place_id", F.posexplode(ring).alias("step", "pt"))
    return p.select("place_id", "step", r6(F.col("pt.lon"), 5).alias("lon"), r6(F.col("pt.lat"), 5).alias("lat"))


@query(
    "fn_bearing_distance",
    "predictions",
    """with d as (select photo_id, (lat-true_lat)*111320 as dy, (lon-true_lon)*111320*cos(radians(true_lat)) as dx from predictions),
      b as (select photo_id, degrees(atan2(dx,dy))+360 as a, sqrt(dx*dx+dy*dy) as m from d)
    select photo_id, round(((a % 360)+360) % 360, 6)+0.0 as bearing, round(m,4)+0.0 as meters from b""",
)
def _(v):
    a = ("true_lat", "true_lon", "lat", "lon")
    return v.predictions.select(
        "photo_id", r6(geo.flat_bearing(*a)).alias("bearing"), r6(geo.flat_distance_m(*a), 4).alias("meters")
    )


@query(
    "fn_heading_delta",
    "street_images",
    """select image_id, round(abs((((heading - (image_id*29) % 720 + 180) % 360 + 360) % 360) - 180), 6)+0.0 as delta
    from street_images""",
)
def _(v):
    h = ((F.col("image_id") * 29) % 720).cast("double")
    return v.street_images.select("image_id", r6(geo.heading_delta("heading", h)).alias("delta"))


@query(
    "fn_local_distance_m",
    "street_images",
    """select image_id, round(sqrt(pow((48.85-lat)*111320,2)+pow((2.34-lon)*111320*cos(radians(lat)),2)),4)+0.0 as meters
    from street_images""",
)
def _(v):
    return v.street_images.select("image_id", r6(geo.flat_distance_m("lat", "lon", 48.85, 2.34), 4).alias("meters"))


_BOX = "lat-0.01*(1+photo_id%9) as s, lon-0.02*(1+photo_id%7) as w, lat+0.03 as n, lon+0.05*(1+photo_id%3) as e"


def _boxes(v):
    k = F.col("photo_id")
    return v.photos.select(
        "photo_id",
        (F.col("lat") - F.lit(0.01) * (1 + k % 9)).alias("s"),
        (F.col("lon") - F.lit(0.02) * (1 + k % 7)).alias("w"),
        (F.col("lat") + 0.03).alias("n"),
        (F.col("lon") + F.lit(0.05) * (1 + k % 3)).alias("e"),
    )


@query(
    "fn_bbox_area_km2",
    "photos",
    f"""with b as (select photo_id, {_BOX} from photos)
    select photo_id, round(abs(n-s)*111.32*abs(e-w)*111.32*cos(radians((s+n)/2)),6)+0.0 as km2 from b""",
)
def _(v):
    return _boxes(v).select("photo_id", r6(geo.bbox_area_km2("s", "w", "n", "e")).alias("km2"))


@query(
    "fn_margin_box",
    "photos",
    f"""with b as (select photo_id, {_BOX}, cast(1 + photo_id % 40 as double) as km from photos)
    select photo_id, round(s-km/111.32,6)+0.0 as south, round(w-km/(111.32*cos(radians((s+n)/2))),6)+0.0 as west,
      round(n+km/111.32,6)+0.0 as north, round(e+km/(111.32*cos(radians((s+n)/2))),6)+0.0 as east from b""",
)
def _(v):
    m = geo.margin_box("s", "w", "n", "e", (1 + F.col("photo_id") % 40).cast("double"))
    b = _boxes(v).select("photo_id", m.alias("m"))
    return b.select("photo_id", *[r6(F.col(f"m.{c}")).alias(c) for c in ("south", "west", "north", "east")])


@query(
    "fn_tiles",
    "street_images",
    """with p as (select cast(floor((lat-48.84)/0.0005) as bigint) as i, cast(floor((lon-2.33)/0.0005) as bigint) as j
        from street_images where lat between 48.84 and 48.864 and lon between 2.33 and 2.354),
      c as (select i, j, count(*) as n from p group by i, j),
      t as (select i//8 as i0, j//8 as j0, i//4 as i1, j//4 as j1, i//2 as i2, j//2 as j2, i, j, n,
        sum(n) over (partition by i//8, j//8) as n0, sum(n) over (partition by i//4, j//4) as n1,
        sum(n) over (partition by i//2, j//2) as n2 from c),
      l as (select case when n0 < 20 then 0 when n1 < 20 then 1 when n2 < 20 then 2 else 3 end as lv, * from t),
      k as (select lv, case lv when 0 then i0 when 1 then i1 when 2 then i2 else i end as ti,
        case lv when 0 then j0 when 1 then j1 when 2 then j2 else j end as tj, n from l)
    select cast(lv as integer) as level, round(48.84+ti*(0.004/pow(2,lv)),6) as south, round(2.33+tj*(0.004/pow(2,lv)),6) as west,
      round(0.004/pow(2,lv),6) as step, cast(sum(n) as bigint) as images from k group by lv, ti, tj""",
)
def _(v):
    t = street.adaptive_tiles(v.street_images, 48.84, 2.33, 48.864, 2.354, limit=20)
    return t.select("level", r6(F.col("south")).alias("south"), r6(F.col("west")).alias("west"), r6(F.col("step")).alias("step"), "images")


@query(
    "fn_rings",
    "reports",
    """with l as (select photo_id, lat, lon, case when prec='city' then 25.0 else 9.0 end as km2 from reports where prec in ('exact','street','city')),
      n as (select *, greatest(0, cast(floor((sqrt(km2)-1)/2) as integer)) as k, 1.0/111.32 as dlat,
        1.0/(111.32*greatest(0.05, cos(radians(lat)))) as dlon from l),
      g as (select *, unnest(range(-k, k+1)) as i from n), h as (select *, unnest(range(-k, k+1)) as j from g)
    select photo_id, cast(greatest(abs(i),abs(j)) as integer) as ring, cast(i as integer) as i, cast(j as integer) as j,
      round(lat+(i-0.5)*dlat,6)+0.0 as south, round(lon+(j-0.5)*dlon,6)+0.0 as west,
      round(lat+(i-0.5)*dlat+dlat,6)+0.0 as north, round(lon+(j-0.5)*dlon+dlon,6)+0.0 as east from h""",
)
def _(v):
    r = v.reports.select("photo_id", "lat", "lon", names.precision_area_km2("prec").alias("km2")).filter("km2 is not null")
    r = r.select("photo_id", F.explode(geo.rings_around("lat", "lon", "km2")).alias("c"))
    return r.select(
        "photo_id", "c.ring", "c.i", "c.j", *[r6(F.col(f"c.{k}")).alias(k) for k in ("south", "west", "north", "east")]
    )


@query(
    "fn_view_grid",
    "places",
    """with b as (select place_id, lat-0.04 as s, lon-0.05 as w, lat+0.03 as n, lon+0.05 as e from places),
      p as (select *, greatest(0.5, sqrt(abs(n-s)*111.32*abs(e-w)*111.32*cos(radians((s+n)/2))/3000)) as sp from b),
      q as (select *, sp/111.32 as dlat, sp/(111.32*cos(radians((s+n)/2))) as dlon from p),
      g as (select *, unnest(range(0, greatest(1, cast(ceil((n+1e-9-s)/dlat) as integer)))) as i from q),
      h as (select *, unnest(range(0, greatest(1, cast(ceil((e+1e-9-w)/dlon) as integer)))) as j from g)
    select place_id, cast(i as integer) as i, cast(j as integer) as j, round(s+i*dlat,6)+0.0 as lat, round(w+j*dlon,6)+0.0 as lon from h""",
)
def _(v):
    b = v.places.select(
        "place_id",
        (F.col("lat") - 0.04).alias("s"),
        (F.col("lon") - 0.05).alias("w"),
        (F.col("lat") + 0.03).alias("n"),
        (F.col("lon") + 0.05).alias("e"),
    )
    sp = geo.view_spacing_km(geo.bbox_area_km2("s", "w", "n", "e"))
    g = b.select("place_id", F.explode(geo.view_grid("s", "w", "n", "e", sp)).alias("g"))
    return g.select("place_id", "g.i", "g.j", r6(F.col("g.lat")).alias("lat"), r6(F.col("g.lon")).alias("lon"))


@query(
    "fn_geomspace",
    "places",
    """select place_id, cast(i as integer) as i, round(0.5*pow((10+population/10000)/0.5, i/19.0),6)+0.0 as km
    from places, (select unnest(range(0,20)) as i)""",
)
def _(v):
    g = geo.geomspace(0.5, 10 + F.col("population") / 10000, 20)
    return v.places.select("place_id", F.posexplode(g).alias("i", "km")).select("place_id", "i", r6(F.col("km")).alias("km"))


@query(
    "fn_curvature_drop",
    "photos",
    """with d as (select photo_id, 500.0+(photo_id%400)*100 as d, (photo_id*13)%3000 as h from photos)
    select photo_id, round(d*d*0.87/(2*6371000.0),6)+0.0 as drop_m,
      round(degrees(atan2(h-401.7-d*d*0.87/(2*6371000.0), d)),6)+0.0 as angle from d""",
)
def _(v):
    d = F.lit(500.0) + (F.col("photo_id") % 400) * 100
    h = ((F.col("photo_id") * 13) % 3000).cast("double")
    return v.photos.select(
        "photo_id", r6(geo.curvature_drop_m(d)).alias("drop_m"), r6(geo.elevation_angle(h, 401.7, d)).alias("angle")
    )


@query(
    "fn_tile_name",
    "photos",
    """select photo_id, concat(case when floor(lat)>=0 then 'N' else 'S' end, lpad(cast(cast(abs(floor(lat)) as integer) as varchar),2,'0'),
      case when floor(lon)>=0 then 'E' else 'W' end, lpad(cast(cast(abs(floor(lon)) as integer) as varchar),3,'0')) as tile from photos""",
)
def _(v):
    return v.photos.select("photo_id", geo.tile_name("lat", "lon").alias("tile"))


# ---- camera metadata --------------------------------------------------------------------------


@query(
    "fn_dms_to_deg",
    "photos",
    """select photo_id, round((case when photo_id%4 in (1,3) then -1 else 1 end)
      *((photo_id%90)+(photo_id%60)/60.0+((photo_id*7)%60)/3600.0),6)+0.0 as deg from photos""",
)
def _(v):
    k = F.col("photo_id")
    ref = F.element_at(F.array(*[F.lit(x) for x in ("N", "s ", "E", "W")]), (k % 4 + 1).cast("int"))
    d = metadata.dms_to_deg((k % 90).cast("double"), (k % 60).cast("double"), ((k * 7) % 60).cast("double"), ref)
    return v.photos.select("photo_id", r6(d).alias("deg"))


@query(
    "fn_xmp_coord",
    "photos",
    """select photo_id, case photo_id%4
      when 0 then round((photo_id%90)+((photo_id%60)+0.494)/60.0,6)+0.0
      when 1 then round((photo_id%90)+0.77,6)+0.0
      when 2 then round(-((photo_id%90)+(photo_id%60)/60.0+(photo_id%50)/3600.0),6)+0.0 end as deg from photos""",
)
def _(v):
    raw = v.sql(
        """select photo_id, case photo_id%4
        when 0 then concat(cast(photo_id%90 as string), ',', cast(photo_id%60 as string), '.494N')
        when 1 then concat('+', cast(photo_id%90 as string), '.77')
        when 2 then concat(cast(photo_id%90 as string), ',', cast(photo_id%60 as string), ',', cast(photo_id%50 as string), 'S')
        else 'unknown,12' end as raw from photos"""
    )
    return raw.select("photo_id", r6(metadata.xmp_coord("raw")).alias("deg"))


@query(
    "fn_parse_taken",
    "photos",
    """select photo_id, case when photo_id%6=0 then null when photo_id%6=1 then null when photo_id%6=2 then null
      else strftime(taken_at, '%Y-%m-%dT%H:%M:%S') end as taken from photos""",
)
def _(v):
    t = F.col("taken_at")
    k = F.col("photo_id") % 6
    raw = (
        F.when(k == 0, F.lit("0000:00:00 00:00:00"))
        .when(k == 1, F.date_format(t, "yyyy:13:dd HH:mm:ss"))
        .when(k == 2, F.date_format(t, "1850:MM:dd HH:mm:ss"))
        .when(k == 3, F.concat(F.lit(" "), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z")))
        .otherwise(F.date_format(t, "yyyy:MM:dd HH:mm:ss"))
    )
    return v.photos.select("photo_id", F.date_format(times.parse_taken(raw), "yyyy-MM-dd'T'HH:mm:ss").alias("taken"))


@query(
    "fn_hours_apart",
    "photos",
    """select photo_id, case when photo_id%7=0 then 'infinity'::double
      else round(abs(epoch_us(taken_at)-epoch_us(timestamp '2024-01-15 00:00:00'))/3.6e9,6)+0.0 end as hours from photos""",
)
def _(v):
    other = F.when(F.col("photo_id") % 7 != 0, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    h = times.hours_apart("taken_at", other)
    return v.photos.select("photo_id", F.when(h == float("inf"), h).otherwise(r6(h)).alias("hours"))


@query(
    "fn_ms_to_date",
    "photos",
    """select photo_id, case when photo_id%9=0 then null else strftime(taken_at, '%Y-%m-%d') end as day from photos""",
)
def _(v):
    ms = F.floor(times.micros("taken_at") / 1000).cast("string")
    raw = F.when(F.col("photo_id") % 9 == 0, F.lit("soon")).otherwise(ms)
    return v.photos.select("photo_id", times.ms_to_date(raw).alias("day"))


@query(
    "fn_same_day_text",
    "photos",
    """select photo_id, concat('Same day as p', cast(photo_id as varchar), '.jpg at ', scene, ' (',
      case when (photo_id%480)/40.0 < 1 then 'within the hour'
      else concat(cast(cast(round_even((photo_id%480)/40.0, 0) as bigint) as varchar), ' h apart') end, ')') as note from photos""",
)
def _(v):
    k = F.col("photo_id")
    return v.photos.select(
        "photo_id",
        times.same_day_text(
            F.concat(F.lit("p"), k.cast("string"), F.lit(".jpg")), "scene", (k % 480).cast("double") / 40.0
        ).alias("note"),
    )


# ---- names, leads -----------------------------------------------------------------------------


@query(
    "fn_address",
    "pois",
    """select poi_id, concat(case when poi_id%3=0 then concat(street, ', ') else '' end,
      cast(housenumber as varchar), ' ', street, case when poi_id%2=0 then ', 75001 Paris' else '' end) as address from pois""",
)
def _(v):
    k, s = F.col("poi_id"), F.col("street")
    key = F.when(k % 5 == 0, F.lit("addr:place")).otherwise(F.lit("addr:street"))
    tags = F.map_from_arrays(
        F.array(F.lit("name"), F.lit("addr:housenumber"), key, F.lit("addr:postcode"), F.lit("addr:city")),
        F.array(
            F.when(k % 3 == 0, s),
            F.col("housenumber").cast("string"),
            s,
            F.when(k % 2 == 0, F.lit("75001")),
            F.when(k % 2 == 0, F.lit("Paris")),
        ),
    )
    return v.pois.select("poi_id", names.tag_address(tags).alias("address"))


@query(
    "fn_lead",
    "reports",
    """select photo_id, lat, lon, km2 from (select photo_id, photo_id%11=0 as people, case when prec in ('exact','street','city') then lat
        when photo_id%3=0 and confidence>=50 then lat+1 end as lat,
      case when prec in ('exact','street','city') then lon when photo_id%3=0 and confidence>=50 then lon+1 end as lon,
      case when prec in ('exact','street') then 9.0e0 when prec='city' then 25.0e0 when photo_id%3=0 and confidence>=50 then 25.0e0 end as km2
      from reports) where km2 is not null and not people""",
)
def _(v):
    k = F.col("photo_id")
    report = F.struct("lat", "lon", F.col("prec").alias("precision"))
    result = F.struct(
        (F.col("lat") + 1).alias("lat"),
        (F.col("lon") + 1).alias("lon"),
        F.when(k % 3 == 0, "city").otherwise("region").alias("resolution"),
        F.col("confidence").alias("confidence"),
    )
    lead = names.search_lead(report, result, k % 11 == 0)
    return v.reports.select("photo_id", lead.alias("l")).filter("l is not null").select("photo_id", "l.*")


@query(
    "fn_scene",
    "answers",
    """select photo_id, case when photo_id%5=0 then 'other' else 'urban' end as scene from answers""",
)
def _(v):
    body = F.when(F.col("photo_id") % 5 == 0, F.lit("{}")).otherwise(F.col("body"))
    parsed = F.from_json(body, "scene string")
    return v.answers.select("photo_id", F.coalesce(names.blank_to_null(parsed["scene"]), F.lit("other")).alias("scene"))


# ---- evidence, vectors, boxes -----------------------------------------------------------------


@query(
    "fn_obs_loglik",
    "detections",
    """with s as (select det_id, least(1.0, greatest(0.0, score*1.05)) as s, case det_id%3 when 0 then 12.0 when 1 then 0.08 else 800.0 end as r from detections)
    select det_id, round(ln(greatest((1-s)+s*r, 1e-300)),6)+0.0 as loglik from s""",
)
def _(v):
    from ..operators.evidence import obs_loglik

    r = F.element_at(F.array(F.lit(12.0), F.lit(0.08), F.lit(800.0)), (F.col("det_id") % 3 + 1).cast("int"))
    return v.detections.select("det_id", r6(obs_loglik(F.col("score") * 1.05, r)).alias("loglik"))


@query(
    "fn_l2_normalize",
    "",
    """with e as (select vec_id, embedding::double[] as e from embeddings),
      n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x*x)))+1e-12 as n from e),
      u as (select vec_id, n, unnest(e) as x, unnest(range(0, len(e))) as dim from n)
    select vec_id, cast(dim as integer) as dim, round(x/n,6)+0.0 as x from u""",
)
def _(v):
    e = v.embeddings.select("vec_id", F.posexplode(vectors.l2_normalize("embedding")).alias("dim", "x"))
    return e.select("vec_id", "dim", r6(F.col("x")).alias("x"))


@query(
    "fn_cosine",
    "",
    """select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]),6)+0.0 as cosine
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def _(v):
    a = v.embeddings.select("vec_id", "embedding")
    b = v.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", r6(vectors.cosine("embedding", "other")).alias("cosine"))


@query("fn_random_projection")
def _(v):
    return vector_ops.random_projection(v.embeddings.select("vec_id", "embedding"), "embedding", 64, 16, seed=7)


@query(
    "fn_box_area_iou",
    "detections",
    """with p as (select a.det_id, a.x0 as ax0,a.y0 as ay0,a.x1 as ax1,a.y1 as ay1,b.x0 as bx0,b.y0 as by0,b.x1 as bx1,b.y1 as by1
        from detections a join detections b on b.det_id=a.det_id+1),
      i as (select *, greatest(0,least(ax1,bx1)-greatest(ax0,bx0))*greatest(0,least(ay1,by1)-greatest(ay0,by0)) as inter,
        (ax1-ax0)*(ay1-ay0) as aa, (bx1-bx0)*(by1-by0) as ab from p)
    select det_id, round(aa,6)+0.0 as area, round(inter/(aa+ab-inter+1e-9),6)+0.0 as iou from i""",
)
def _(v):
    box = F.struct("x0", "y0", "x1", "y1")
    a = v.detections.select("det_id", box.alias("a"))
    b = v.detections.select((F.col("det_id") - 1).alias("det_id"), box.alias("b"))
    return a.join(b, "det_id").select(
        "det_id",
        r6(boxes.box_area("a.x0", "a.y0", "a.x1", "a.y1")).alias("area"),
        r6(boxes.box_iou(F.col("a"), F.col("b"))).alias("iou"),
    )
