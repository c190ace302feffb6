"""Observations, evidence and the fused posterior."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import evidence as E
from ..operators import fusion as U
from ..operators import stats
from ..operators.leafgroups import LeafGroups, fits
from .q_scalars import quick6, r6
from .rules_fixture import DENSE, rules
from .views import query

DV = "places countries cells detections"


def observations(v):
    """One row per photo and cue, brought together by photo: the only shuffle of the fusion below."""
    r = rules(v.spark, v.countries)
    best = E.best_detection(E.usable_detections(v.detections, r))
    return best.select("photo_id", F.col("cue").alias("rule"), "score", F.lit(1.0).alias("weight"), "x0", "y0", "x1", "y1").transform(E.by_photo)


def rule_leafs(v):
    """The sparse rule table: built once per cell table, then broadcast."""
    return v.memo("rule_leafs", lambda: E.rule_leaf(rules(v.spark, v.countries), v.cells).persist())


def model(v):
    return v.memo("model", lambda: C.CellModel(v.cells))


def compact_leafs(v):
    """The rule table with each rule's commonest ratio as default: what answers are computed from."""
    return v.memo("compact_leafs", lambda: E.compact_rules(rule_leafs(v), v.cells, model(v).leaves).persist())


def groups(v, table=compact_leafs):
    """The model and a rule table, over groups of leaves; leaf by leaf where leaves repeat or lack a value."""

    def make():
        m, leafs = model(v), table(v)
        if not fits(m):
            return m, leafs
        g = LeafGroups(m, leafs)
        return g, g.rules

    return v.memo(f"groups_{table.__name__}", make)


def touched_compact(v):
    return U.touched_posterior(E.sparse_evidence(observations(v), compact_leafs(v)), model(v))


def touched(v):
    """(rows, model): the posterior of what each rule itself singles out, over groups as the clues of each photo."""
    m, leafs = groups(v, rule_leafs)
    if isinstance(m, LeafGroups):
        return U.clue_rows(observations(v)), m
    return U.touched_posterior(E.sparse_evidence(observations(v), leafs), m), m


@query(
    "flt_detections",
    "detections",
    """select det_id, photo_id, cue from detections where cue in
    ('left_hand_traffic','right_hand_traffic','joshua_tree','date_palm','snow_ground')""",
)
def _(v):
    return E.usable_detections(v.detections, rules(v.spark, v.countries)).select("det_id", "photo_id", "cue")


@query(
    "flt_people_main",
    "detections",
    """select photo_id, bool_or(cue in ('person','face') and score>=0.5 and round(greatest(0,x1-x0)*greatest(0,y1-y0),9)>=0.08) as people_main
    from detections group by photo_id""",
)
def _(v):
    return E.people_main(v.detections)


@query(
    "agg_best_detection",
    "detections",
    """select photo_id, cue, det_id, round(score,6)+0.0 as score from (select *, row_number() over (partition by photo_id, cue order by score desc, det_id) as rn from detections
    where cue <> 'person') where rn=1""",
)
def _(v):
    b = E.best_detection(E.usable_detections(v.detections, rules(v.spark, v.countries)))
    return b.select("photo_id", "cue", "det_id", r6(F.col("score")).alias("score"))


@query(
    "join_country_default",
    "photos countries",
    """select photo_id, coalesce(name, code) as country, coalesce(continent,'') as continent, coalesce(drives_on,'R') as drives_on
    from (select photo_id, concat('N', cast(photo_id%30 as varchar)) as code from photos) left join countries on iso2=code""",
)
def _(v):
    from ..operators.places import with_country

    p = v.photos.select("photo_id", F.concat(F.lit("N"), (F.col("photo_id") % 30).cast("string")).alias("code"))
    return with_country(p, v.countries, "code").select(
        "photo_id", "country", F.col("country_continent").alias("continent"), F.col("country_drives_on").alias("drives_on")
    )


@query(
    "join_rule_drives_on",
    "countries",
    """select 'left_hand_traffic' as rule, iso2, 6.0e0 as lr from countries where drives_on='L'
    union all select 'right_hand_traffic', iso2, 1.4e0 from countries where drives_on='R'
    union all select 'date_palm', iso2, lr from (values ('N3',10.0e0),('N7',8.0e0),('N12',5.0e0),('N18',4.0e0)) as t(iso2, lr)""",
)
def _(v):
    return rules(v.spark, v.countries).select("rule", F.explode("countries").alias("iso2", "lr"))


def _obs_rows(v, names):
    leafs = rule_leafs(v)
    o = observations(v).filter(F.col("rule").isin(*names))
    return E.observation_loglik(o, leafs, r6).select("photo_id", F.col("rule").alias("cue"), "leaf", "loglik", "default_loglik")


def _obs_sql(names):
    lst = ",".join(f"'{n}'" for n in names)
    return f"""with {DENSE} select photo_id, cue, leaf, round(ln((1-score)+score*r),6)+0.0 as loglik,
      round(ln((1-score)+score*o),6)+0.0 as default_loglik from dense where touched and r <> o and cue in ({lst})"""


_COUNTRY = ("left_hand_traffic", "right_hand_traffic", "date_palm")


@query("join_obs_leaf", DV, _obs_sql(_COUNTRY))
def _(v):
    return _obs_rows(v, _COUNTRY)


@query("join_obs_region", DV, _obs_sql(("joshua_tree",)))
def _(v):
    return _obs_rows(v, ("joshua_tree",))


@query("join_obs_lat_band", DV, _obs_sql(("snow_ground",)))
def _(v):
    return _obs_rows(v, ("snow_ground",))


@query(
    "agg_fuse_posterior",
    DV,
    f"""with {DENSE} select photo_id, leaf, round(p,6)+0.0 as p from post where touched
    union all select photo_id, -1, round(any_value(u),6)+0.0 from post group by photo_id""",
)
def _(v):
    t, m = touched(v)
    by_leaf = F.row_number().over(E.W.partitionBy("photo_id").orderBy("leaf")).alias("rn")
    # one extra row per photo (leaf -1) carries the factor every untouched leaf's prior is multiplied with
    if isinstance(m, LeafGroups):
        return U.leaf_posterior(t, m).select("photo_id", "leaf", quick6("p").alias("p"))
    rows = F.when(F.col("rn") == 1, F.array(F.struct("leaf", "p"), F.struct(F.lit(-1).cast("long").alias("leaf"), F.col("u").alias("p")))).otherwise(
        F.array(F.struct("leaf", "p"))
    )
    t = t.select("photo_id", "leaf", "p", "u", by_leaf)
    return t.select("photo_id", F.explode(rows).alias("r")).select("photo_id", "r.leaf", r6(F.col("r.p")).alias("p"))


@query(
    "agg_logsumexp",
    "photos",
    """with m as (select album_id, max(val) as m from photos group by album_id)
    select album_id, round(any_value(m)+ln(sum(exp(val-m))),6)+0.0 as lse from photos join m using (album_id) group by album_id""",
)
def _(v):
    return stats.logsumexp(v.photos, ["album_id"], "val").select("album_id", r6(F.col("lse")).alias("lse"))


@query(
    "agg_level_marginal",
    DV,
    f"""with {DENSE}, n as (select photo_id, 'continent' as level, continent as key, sum(p) as mass, bool_or(touched) as t from post group by 1,2,3
      union all select photo_id, 'country', iso2, sum(p), bool_or(touched) from post group by 1,2,3
      union all select photo_id, 'admin1', admin1, sum(p), bool_or(touched) from post group by 1,2,3
      union all select photo_id, 'leaf', cast(leaf as varchar), sum(p), bool_or(touched) from post group by 1,2,3)
    select photo_id, level, key, round(mass,6)+0.0 as mass from n where t""",
)
def _(v):
    m = U.level_marginals(*touched(v))
    return m.select("photo_id", "level", "key", quick6("mass").alias("mass"))


# greedy descent written out for the second engine
DECIDE = """
c1 as (select photo_id, continent, sum(p) as m, sum(p0) as m0 from post group by 1,2),
b1 as (select * from (select *, row_number() over (partition by photo_id order by round(m,12) desc, continent) as rn from c1) where rn=1),
c2 as (select post.photo_id, post.continent, iso2, sum(p) as m, sum(p0) as m0 from post join b1 using (photo_id, continent) group by 1,2,3),
b2 as (select * from (select *, row_number() over (partition by photo_id order by round(m,12) desc, iso2) as rn from c2) where rn=1),
c3 as (select post.photo_id, post.iso2, admin1, sum(p) as m, sum(p0) as m0 from post join b2 using (photo_id, iso2) group by 1,2,3),
b3 as (select * from (select *, row_number() over (partition by photo_id order by round(m,12) desc, admin1) as rn from c3) where rn=1),
c4 as (select post.photo_id, post.admin1, leaf, p as m, p0 as m0 from post join b3 using (photo_id, admin1)),
b4 as (select * from (select *, row_number() over (partition by photo_id order by round(m,12) desc, leaf) as rn from c4) where rn=1),
dec as (select b1.photo_id, b1.continent, b1.m as m1, b2.iso2, b2.m as m2, b3.admin1, b3.m as m3, b4.leaf, b4.m as m4,
  case when b4.m>=0.3 and b4.m>=1.5*b4.m0 then 'leaf' when b3.m>=0.3 and b3.m>=1.5*b3.m0 then 'admin1'
    when b2.m>=0.3 and b2.m>=1.5*b2.m0 then 'iso2' when b1.m>=0.3 and b1.m>=1.5*b1.m0 then 'continent' else 'world' end as level
  from b1 join b2 using (photo_id) join b3 using (photo_id) join b4 using (photo_id))"""


@query(
    "agg_hierarchy_decision",
    DV,
    f"""with {DENSE}, {DECIDE}
    select photo_id, continent, round(m1,6)+0.0 as continent_mass, iso2, round(m2,6)+0.0 as country_mass, admin1, round(m3,6)+0.0 as admin1_mass,
      cast(leaf as varchar) as leaf, round(m4,6)+0.0 as leaf_mass, level from dec""",
)
def _(v):
    d = decisions(v)
    return d.select(
        "photo_id",
        F.col("h_continent_key").alias("continent"),
        r6(F.col("h_continent_mass")).alias("continent_mass"),
        F.col("h_iso2_key").alias("iso2"),
        r6(F.col("h_iso2_mass")).alias("country_mass"),
        F.col("h_admin1_key").alias("admin1"),
        r6(F.col("h_admin1_mass")).alias("admin1_mass"),
        F.col("h_leaf_key").alias("leaf"),
        r6(F.col("h_leaf_mass")).alias("leaf_mass"),
        "level",
    )


def posterior_rows(v, obs):
    """(rows, model): a row for each photo with the posterior of the groups that its clues touch."""
    m, leafs = groups(v)
    if isinstance(m, LeafGroups):
        return U.clue_rows(obs), m
    return U.photo_rows(U.touched_posterior(E.sparse_evidence(obs, leafs), m)), m


def decisions(v):
    return U.decide(*posterior_rows(v, observations(v)))


@query(
    "agg_candidates",
    DV,
    f"""with {DENSE}, r as (select *, row_number() over (partition by photo_id order by round(p,12) desc, leaf) as rank from post)
    select photo_id, rank, leaf, concat(r.name, ', ', c.name) as name, round(p,4)+0.0 as p from r join countries c using (iso2) where rank<=5""",
)
def _(v):
    top = U.top_candidates(*posterior_rows(v, observations(v)))
    lab = v.cells.join(F.broadcast(v.countries.select("iso2", F.col("name").alias("country"))), "iso2").select(
        "leaf", F.concat_ws(", ", "name", "country").alias("name")
    )
    return top.join(F.broadcast(lab), "leaf").select("photo_id", F.col("rank").cast("long").alias("rank"), "leaf", "name", r6(F.col("p"), 4).alias("p"))


ATTR = f"""with {DENSE}, {DECIDE},
  acc as (select dec.photo_id, level, post.leaf, case level when 'world' then true when 'continent' then post.continent=dec.continent when 'iso2' then post.iso2=dec.iso2
    when 'admin1' then post.admin1=dec.admin1 else post.leaf=dec.leaf end as isin from dec join post using (photo_id)),
  a as (select d.photo_id, d.cue, ln(avg((1-score)+score*r) filter (isin)) - ln(avg((1-score)+score*r)) as c from dense d join acc using (photo_id, leaf) group by 1,2)"""


@query(
    "agg_attribution",
    DV,
    ATTR + """ select photo_id, cue, round(exp(greatest(-50,least(50,c))),3)+0.0 as likelihood_ratio,
      case when c>0.05 then 'supports' when c<-0.05 then 'contradicts' else 'neutral' end as direction from a""",
)
def _(v):
    a = attributions(v)
    return a.select("photo_id", F.col("key").alias("cue"), r6(F.col("ratio"), 3).alias("likelihood_ratio"), "direction")


def attributions(v):
    m, leafs = model(v), compact_leafs(v)
    node = decisions(v).select("photo_id", "level", F.col("key").alias("node_key"), "n_in")
    if fits(m):
        return U.rule_attribution(observations(v), leafs, node, m)
    ev = observations(v).join(F.broadcast(leafs), "rule", "left").select(
        "photo_id",
        F.col("rule").alias("key"),
        "leaf",
        E.obs_loglik("score", "ratio").alias("loglik"),
        E.obs_loglik("score", "default").alias("base"),
        "weight",
    )
    return U.attribution(ev, node, m)


@query(
    "win_evidence_sort",
    DV,
    ATTR + """ select photo_id, cue, row_number() over (partition by photo_id order by round(abs(c),9) desc, cue) as rank from a""",
)
def _(v):
    a = attributions(v)
    rk = F.row_number().over(E.W.partitionBy("photo_id").orderBy(F.round(F.abs("log_ratio"), 9).desc(), "key"))
    return a.select("photo_id", F.col("key").alias("cue"), rk.cast("long").alias("rank"))
