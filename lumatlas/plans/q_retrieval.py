"""Neighbours, classifier, model answers, points and refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import evidence as E
from ..operators import fusion as U
from ..operators import places as P
from ..operators import retrieval as R
from ..operators import stats
from ..operators.leafgroups import LeafGroups
from ..sources import answers as A
from .q_evidence import DECIDE, DV, compact_leafs, decisions, groups, model, observations, posterior_rows, touched_compact
from .q_scalars import quick6, r6
from .rules_fixture import DENSE
from .sqlparts import hav
from .views import query


def split(v):
    g = v.geo_index
    q = g.filter("is_query").select(F.col("vec_id").alias("query_id"), "embedding")
    return q, g.filter("not is_query").select("vec_id", "embedding", "lat", "lon")


KNN = """knn as (select * from (select q.vec_id as query_id, x.vec_id, x.lat, x.lon, list_cosine_similarity(q.embedding::double[], x.embedding::double[]) as sim,
  row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], x.embedding::double[]),12) desc, x.vec_id) as rank
  from geo_index q join geo_index x on q.is_query and not x.is_query) where rank <= 64)"""


@query("join_knn", "geo_index", f"with {KNN} select query_id, vec_id, cast(rank as integer) as rank, round(sim,6)+0.0 as similarity from knn")
def _(v):
    q, ix = split(v)
    return R.knn(q, ix).select("query_id", "vec_id", "rank", r6(F.col("similarity")).alias("similarity"))


@query("join_knn_ivf")
def _(v):
    q, ix = split(v)
    return R.IvfIndex(ix).search(q, k=10).select("query_id", "vec_id", "rank", "similarity")


def neighbours(v):
    q, ix = split(v)
    hits = R.neighbour_weights(R.knn(q, ix))
    placed = P.nearest_leaf(ix.select("vec_id", "lat", "lon"), v.cells)
    return hits.join(placed.select("vec_id", "lat", "lon", "leaf"), "vec_id").join(F.broadcast(v.cells.select("leaf", "iso2")), "leaf")


NEIGH = f"""{KNN}, nl as (select vec_id, leaf from (select g.vec_id, c.leaf, row_number() over (partition by g.vec_id order by round({hav('g.lat','g.lon','c.lat','c.lon')}/c.scale_km,9), c.leaf) as rn
  from geo_index g, cells c) where rn=1),
nb as (select knn.*, leaf, iso2, max(sim) over (partition by query_id) as best, exp((sim - max(sim) over (partition by query_id))/0.05) as w
  from knn join nl using (vec_id) join cells using (leaf, ) )""".replace("(leaf, )", "(leaf)").replace("select knn.*, leaf, iso2", "select knn.query_id, knn.vec_id, knn.lat, knn.lon, knn.sim, knn.rank, leaf, iso2")


@query(
    "agg_retrieval_vote",
    "cells geo_index",
    f"""with {NEIGH}, t as (select query_id, sum(w) as t from nb group by 1), l as (select query_id, leaf, sum(w) as wl from nb group by 1,2),
      c as (select query_id, iso2, sum(w) as wc from nb group by 1,2), n as (select iso2, count(*) as nc from cells group by 1), k as (select count(*) as k from cells)
    select c.query_id, cells.leaf, round(ln((0.6*coalesce(wl,0)/t + 0.3*wc/t/nc + 0.1/k)*k),6)+0.0 as loglik
    from c join t using (query_id) join n using (iso2) join cells using (iso2) left join l on l.query_id=c.query_id and l.leaf=cells.leaf cross join k
    union all select query_id, -1, round(ln(0.1),6) from t""",
)
def _(v):
    return R.vote(neighbours(v), v.cells, model(v).leaves).select("query_id", "leaf", quick6("loglik").alias("loglik"))


@query(
    "agg_retrieval_trust",
    "cells geo_index",
    f"""with {NEIGH}, c as (select query_id, iso2, sum(w) as wc, count(*) as n, max(best) as best from nb group by 1,2),
      r as (select *, row_number() over (partition by query_id order by round(wc,12) desc, iso2) as rn, sum(wc) over (partition by query_id) as t from c)
    select query_id, iso2, n as n_top, round(best,6) as best, round(greatest(0.25,least(1.0,(best-0.35)/0.5)),6) as trust, round(wc/t,6) as share from r where rn=1""",
)
def _(v):
    t = R.trust(neighbours(v))
    return t.select(
        "query_id", "iso2", "n_top", r6(F.col("best")).alias("best"), r6(F.col("trust")).alias("trust"), r6(F.col("share")).alias("share")
    )


PROTO = """d as (select label, dim, avg(x) as x from (select label, unnest(embedding::double[]) as x, unnest(range(0,len(embedding))) as dim from embeddings) group by 1,2),
proto as (select label, dim, x/sqrt(sum(x*x) over (partition by label)) as x from d)"""


@query("agg_prototypes", "", f"with {PROTO} select label, cast(dim as integer) as dim, round(x,6)+0.0 as x from proto")
def _(v):
    return R.prototypes(v.embeddings, "label").select("label", "dim", r6(F.col("x")).alias("x"))


CLS = f"""{PROTO}, pv as (select label, list(x order by dim) as p from proto group by 1),
lg as (select e.vec_id as photo_id, cast(pv.label+1 as bigint) as leaf, 100*list_dot_product(e.embedding::double[], pv.p) as z from embeddings e, pv),
mm as (select photo_id, max(z) as m from lg group by 1),
lp as (select photo_id, leaf, z-m-ln(sum(exp(z-m)) over (partition by photo_id)) as logp from lg join mm using (photo_id))"""


def classified(v):
    protos = R.prototype_vectors(R.prototypes(v.embeddings, "label"), "label").select((F.col("label") + 1).cast("long").alias("leaf"), "embedding")
    return R.classifier_loglik(R.classify(v.embeddings.select(F.col("vec_id").alias("photo_id"), "embedding"), protos), v.cells)


@query(
    "join_classifier",
    "cells",
    f"with {CLS} select photo_id, leaf, round(logp-log_prior,6)+0.0 as loglik from lp join cells using (leaf)",
)
def _(v):
    return classified(v).select("photo_id", "leaf", r6(F.col("loglik")).alias("loglik"))


@query(
    "agg_classifier_country",
    "cells",
    f"""with {CLS}, c as (select photo_id, iso2, sum(exp(logp)) as p from lp join cells using (leaf) group by 1,2)
    select photo_id, iso2, round(p,6)+0.0 as p from (select *, row_number() over (partition by photo_id order by round(p,12) desc, iso2) as rn from c) where rn=1""",
)
def _(v):
    return R.classifier_country(classified(v)).select("photo_id", "iso2", r6(F.col("p")).alias("p"))


# ---- model answers -----------------------------------------------------------------------------

ANS = """ans as (select photo_id, json_extract_string(body,'$.candidates[0].country_code') as cc, cast(json_extract_string(body,'$.candidates[0].latitude') as double) as la,
 cast(json_extract_string(body,'$.candidates[0].longitude') as double) as lo, least(1.0,greatest(0.0,cast(json_extract_string(body,'$.candidates[0].probability') as double))) as p,
 least(5000.0,greatest(0.05,cast(json_extract_string(body,'$.candidates[0].radius_km') as double))) as rad from answers)"""


@query("flt_candidates", "answers", f"with {ANS} select photo_id, cc as country_code, round(p,6) as probability from ans where p > 0.01")
def _(v):
    return A.candidates(A.parse_answers(v.answers)).select("photo_id", "country_code", r6(F.col("probability")).alias("probability"))


@query(
    "src_vlm_answer",
    "answers",
    f"""with {ANS} select photo_id, case when photo_id%13=0 then null else 'urban' end as scene, case when photo_id%13=0 then null else cc end as country_code,
      case when photo_id%13=0 then null else la end as lat, case when photo_id%13=0 then null else lo end as lon,
      case when photo_id%13=0 then null else round(p,6) end as probability, case when photo_id%13=0 then null else rad end as radius_km from ans""",
)
def _(v):
    from ..sources.files import roundtrip_text

    broken = F.when(F.col("photo_id") % 13 == 0, F.lit("{not json")).otherwise(F.col("body"))
    landed = roundtrip_text(v.answers.select("photo_id", broken.alias("body")), "body")
    c = F.get("top", F.lit(0))
    p = A.parse_answers(landed).select("photo_id", F.col("answer.scene").alias("scene"), c.alias("c"))
    return p.select("photo_id", "scene", "c.country_code", "c.lat", "c.lon", r6(F.col("c.probability")).alias("probability"), "c.radius_km")


@query(
    "join_vlm_leaf",
    "cells answers",
    f"""with {ANS}, ms as (select max(scale_km) as ms from cells), x as (select photo_id, leaf, p, length(cc)=2 as has, iso2=cc as home, {hav('la','lo','lat','lon')} as d, rad*rad+scale_km*scale_km as s2 from ans, cells),
      y as (select *, (0.05+40*exp(-0.5*d*d/s2))*case when has then case when home then 6.0 else 0.3 end else 1 end as r, d <= 9*sqrt(s2) or (has and home) as t from x)
    select photo_id, leaf, round(ln((1-p)+p*r),6)+0.0 as loglik from y where t
    union all select photo_id, -1, round(ln((1-p)+p*0.05*case when length(cc)=2 then 0.3 else 1 end),6)+0.0 from ans""",
)
def _(v):
    e = E.answer_evidence(A.candidates(A.parse_answers(v.answers)), v.cells)
    return e.select("photo_id", "leaf", quick6("loglik").alias("loglik"))


# ---- points and refinement --------------------------------------------------------------------


def cue_points(v):
    """Points of the region cue and of the model's candidate, with the cell each lies in."""
    o = observations(v).filter(F.col("rule") == "joshua_tree").select(
        "photo_id", F.lit("cue").alias("key"), F.lit(34.9).alias("lat"), F.lit(-116.2).alias("lon"), (F.col("score") * 800).alias("weight"),
        F.lit(1.0).alias("ev_weight"), F.lit(160.0).alias("sigma_km"),
    )
    c = A.candidates(A.parse_answers(v.answers)).select(
        "photo_id", F.lit("vlm").alias("key"), "lat", "lon", F.col("probability").alias("weight"), F.lit(0.7).alias("ev_weight"), F.col("radius_km").alias("sigma_km")
    )
    # files are few and a point's search is much work: points are spread first, by the photo that brings them together again
    return P.nearest_leaf(o.unionByName(c).withColumn("pos", F.lit(0)).transform(E.by_photo), v.cells)


POINTS = f"""{ANS}, pts as (select photo_id, 'cue' as key, 34.9 as la, -116.2 as lo, 160.0 as sg, 1.0 as wt from obs where cue='joshua_tree'
  union all select photo_id, 'vlm', la, lo, rad, 0.7 from ans),
 pl as (select * from (select pts.*, leaf, row_number() over (partition by photo_id, key order by round({hav('la','lo','cells.lat','cells.lon')}/scale_km,9), leaf) as rn from pts, cells) where rn=1),
 acc as (select dec.photo_id, level, post.leaf, post.p, max(post.p) over (partition by dec.photo_id) as pm from dec join post on dec.photo_id=post.photo_id and
   case level when 'world' then true when 'continent' then post.continent=dec.continent when 'iso2' then post.iso2=dec.iso2 when 'admin1' then post.admin1=dec.admin1 else post.leaf=dec.leaf end)"""


@query(
    "agg_points_in",
    DV + " answers",
    f"with {DENSE}, {DECIDE}, {POINTS} select photo_id, la as lat, lo as lon, leaf, round(wt*p/pm,6)+0.0 as weight from pl join acc using (photo_id, leaf)",
)
def _(v):
    points = cue_points(v)
    d = decisions(v).join(R.photo_points(points), "photo_id")
    if "members" not in d.columns:
        d = U.leaves_at_points(d, points, observations(v), compact_leafs(v), model(v))
    p = U.points_inside(d).select("photo_id", F.explode("pts").alias("q"))
    return p.select("photo_id", "q.lat", "q.lon", "q.leaf", r6(F.col("q.weight")).alias("weight"))


def neighbour_points(v):
    """Each query's neighbours as one bounded array of weighted points."""
    q, ix = split(v)
    h = R.neighbour_weights(R.knn(q, ix)).join(ix.select("vec_id", "lat", "lon"), "vec_id")
    p = h.select(
        F.col("query_id").alias("photo_id"), F.lit("retrieval").alias("key"), F.col("rank").alias("pos"), "lat", "lon", F.col("w").alias("weight"),
        F.lit(1.0).alias("ev_weight"), F.lit(-1).cast("long").alias("leaf"), F.lit(0.0).alias("sigma_km"),
    )
    return R.photo_points(p)


@query(
    "agg_density_seed",
    "geo_index",
    f"""with {KNN}, w as (select *, exp((sim-max(sim) over (partition by query_id))/0.05) as w0 from knn), n as (select *, w0/sum(w0) over (partition by query_id) as w from w),
      d as (select a.query_id, a.rank, a.lat, a.lon, sum(b.w*exp(-0.5*pow({hav('a.lat','a.lon','b.lat','b.lon')}/500.0,2))) as dens from n a join n b using (query_id) group by 1,2,3,4)
    select query_id as photo_id, lat, lon from (select *, row_number() over (partition by query_id order by round(dens,12) desc, rank) as rn from d) where rn=1""",
)
def _(v):
    s = neighbour_points(v).select("photo_id", U.density_seed("points", "500D").alias("s"))
    return s.select("photo_id", "s.lat", "s.lon")


@query("agg_refine_mode")
def _(v):
    m = neighbour_points(v).select("photo_id", U.mean_shift("points", "500D").alias("m"))
    return m.select("photo_id", r6(F.col("m.lat")).alias("lat"), r6(F.col("m.lon")).alias("lon"))


@query(
    "agg_spherical_mean",
    "photos",
    """with s as (select album_id, sum((1+photo_id%3)*cos(radians(lat))*cos(radians(lon))) as x, sum((1+photo_id%3)*cos(radians(lat))*sin(radians(lon))) as y,
      sum((1+photo_id%3)*sin(radians(lat))) as z from photos group by 1)
    select album_id, round(degrees(asin(z/(sqrt(x*x+y*y+z*z)+1e-12))),6)+0.0 as lat, round(degrees(atan2(y,x)),6)+0.0 as lon from s""",
)
def _(v):
    lat, lon = geo.spherical_mean("lat", "lon", (1 + F.col("photo_id") % 3).cast("double"))
    return v.photos.groupBy("album_id").agg(r6(lat).alias("lat"), r6(lon).alias("lon"))


@query(
    "agg_weighted_quantile",
    "photos",
    """with c as (select album_id, val, sum(1+photo_id%5) over (partition by album_id order by val range between unbounded preceding and current row) as cw,
      sum(1+photo_id%5) over (partition by album_id) as t from photos)
    select album_id, min(val) as q68 from c where cw/t >= 0.68 - 1e-12 group by 1""",
)
def _(v):
    p = v.photos.withColumn("w", (1 + F.col("photo_id") % 5).cast("double"))
    return stats.weighted_quantile(p, ["album_id"], "val", "w", 0.68, "q68")


@query(
    "agg_radius",
    DV,
    f"""with {DENSE}, {DECIDE},
      acc as (select dec.photo_id, level, post.* exclude (photo_id, touched) from dec join post on dec.photo_id=post.photo_id and
        case level when 'world' then true when 'continent' then post.continent=dec.continent when 'iso2' then post.iso2=dec.iso2 when 'admin1' then post.admin1=dec.admin1 else post.leaf=dec.leaf end),
      best as (select photo_id, lat as bla, lon as blo, scale_km as bs, p as bp from (select *, row_number() over (partition by photo_id order by round(p,12) desc, leaf) as rn from acc) where rn=1),
      dd as (select photo_id, level, bla, blo, bs, bp, {hav('bla','blo','lat','lon')}+scale_km as d, p from acc join best using (photo_id)),
      cw as (select *, sum(p) over (partition by photo_id order by d range between unbounded preceding and current row) as c, sum(p) over (partition by photo_id) as t from dd),
      q as (select photo_id, any_value(level) as level, any_value(bla) as lat, any_value(blo) as lon, any_value(bs) as bs, any_value(bp) as bp, min(d) filter (c/t >= 0.68) as q, any_value(t) as t from cw group by 1)
    select photo_id, level, lat, lon, round(case level when 'leaf' then bs when 'admin1' then greatest(q,25) when 'iso2' then greatest(q,100) when 'continent' then greatest(q,1000) else greatest(q,5000) end,4)+0.0 as radius_km,
      round(100*case level when 'world' then bp else t end, 3) as percent from q""",
)
def _(v):
    m, _ = groups(v)
    # of more leaves than are broadcast no task holds all
    r = U.locate_rows(*posterior_rows(v, observations(v))) if isinstance(m, LeafGroups) and m.small else U.locate_rows(U.photo_rows(touched_compact(v)), model(v))
    mass = F.when(F.col("level") == "world", F.col("best_p")).otherwise(F.col("level_mass"))
    return r.select(
        "photo_id", "level", F.col("out_lat").alias("lat"), F.col("out_lon").alias("lon"), r6(F.col("radius_km"), 4).alias("radius_km"), F.round(100 * mass, 3).alias("percent")
    )
