"""Registered queries of the numbered operators: each maps the given tables to an operator's records and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as photo reports: doc_id is the photo, text the report's summary."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("photo_id"), F.col("text").alias("summary"))


def source_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as sampling weights of photos: trusted 2, distrusted 0.5."""
    labels = table(spark, folder, "labels").filter("quality is not null")
    return labels.select(F.col("doc_id").alias("photo_id"), F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("quality"))


@query("op8_document_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from .fingerprints import compare_with_next

    r = compare_with_next(reports(spark, folder))
    return r.select(
        F.col("photo_id").alias("doc_id"), "n_chars", F.sha2("summary_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query("op9_source_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mix_sources

    photos = table(spark, folder, "documents").select(F.col("doc_id").alias("photo_id"), "source", F.col("text").alias("summary"))
    r = mix_sources(photos, quality=source_quality(spark, folder))
    return r.select(F.col("photo_id").alias("doc_id"), "mix.size", "mix.source_size", "mix.target", "mix.taken", "source", "mix.copies")


@query("op4_token_files")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import uuid

    from ..session import checkpoint_dir
    from .tokens import token_starts, write_token_files

    path = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(reports(spark, folder), path)
    return token_starts(spark, path).withColumnRenamed("photo_id", "doc_id")


@query("op10_bpe_round_trip")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from .bpe import decode, encode_reports

    r = encode_reports(reports(spark, folder))
    return r.select(
        F.col("photo_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids")), 256).alias("decoded_sha256")
    )


@query(
    "op7_top_k_search",
    """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from .neighbours import nearest_photos

    index = table(spark, folder, "embeddings").select(F.col("vec_id").alias("photo_id"), "embedding")
    r = nearest_photos(index, index.filter("photo_id % 100 = 0"))
    return r.select("query_id", "rank", F.col("photo_id").alias("vec_id"), "score")


@query("op5_licence_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from .licences import scan_licences

    photos = table(spark, folder, "documents").select(F.col("doc_id").alias("photo_id"), F.col("text").alias("note"))
    r = scan_licences(photos)
    at = F.transform("base_places", lambda p: p["at"])
    return r.select(
        F.col("photo_id").alias("doc_id"),
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("base_places", lambda p: p["label"])))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("licences", lambda p: p["label"])))).alias("labels"),
        F.coalesce(F.array_max(F.transform("licences", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity_model(spark: SparkSession, folder: str):
    """Fitted on the documents of the given folder that are not held out."""
    from .toxicity import train

    feedback = table(spark, folder, "documents").select(F.col("doc_id").alias("feedback_id"), F.col("text").alias("comment"))
    labels = table(spark, folder, "labels").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("feedback_id"), "toxic")
    return train(feedback, labels)


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import score_comments

    feedback = table(spark, folder, "documents").select(F.col("doc_id").alias("feedback_id"), F.col("text").alias("comment"))
    r = score_comments(feedback, toxicity_model(spark, folder))
    doc = F.col("feedback_id")
    return r.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


@query(
    "op3_near_duplicates",
    r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w),
e as (select doc_id, unnest(sh) as g from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c join s x on a = x.doc_id join s y on b = y.doc_id where 100 * n >= 80 * (len(x.sh) + len(y.sh) - n)),
sym as (select a, b from l union all select b, a from l),
reach as (select doc_id, doc_id as r from s union select reach.doc_id, b from reach join sym on r = a)
select doc_id, cast(any_value(len(sh)) as bigint) as n_shingles, min(r) as component_id, min(r) = doc_id as kept
from reach join s using (doc_id) group by doc_id""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from .nearcopies import near_copies

    r = near_copies(reports(spark, folder), words=2)
    return r.withColumnRenamed("photo_id", "doc_id")


@query(
    "op1_suffix_array_dedup",
    """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as hx, octet_length(encode(coalesce(text, ''))) as n from documents),
p as (select doc_id, i, substr(hx, 2 * i + 1, 100) as s from (select doc_id, hx, unnest(range(0, n - 49)) as i from h)),
f as (select s, min(doc_id) as m from p group by s),
k as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from p join f using (s) where m < doc_id),
g as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as run from k),
runs as (select doc_id, run, min(i) as a, max(i) + 50 as b from g group by all),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from runs),
cut as (select doc_id, sum(b - a) as gone, count(*) as spans, max(b) as last, string_agg(substr(hx, 2 * since + 1, 2 * (a - since)), '' order by a) as kept
  from gaps join h using (doc_id) group by doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
 sha256(unhex(case when last is null then hx else kept || substr(hx, 2 * last + 1) end)) as kept_sha256
from h left join cut using (doc_id)""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from .passages import remove_repeats

    r = remove_repeats(reports(spark, folder))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return r.select(
        F.col("photo_id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from .quality import classify

    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("photo_id"), F.col("text").alias("summary"), "lang")
    trusted = table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").alias("photo_id"))
    return classify(texts, trusted).withColumnRenamed("photo_id", "doc_id")


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from .variants import read_words, spelling_variants

    def damaged(w: Column) -> Column:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), w).cast("binary"))
        at = (h % F.char_length(w)).cast("int")
        return F.when(h % 31 == 0, F.concat(F.substr(w, F.lit(1), at), F.substr(w, at + 2, F.char_length(w)))).otherwise(w)

    read = F.array_join(F.transform(read_words(F.col("text")), damaged), " ")
    return spelling_variants(table(spark, folder, "documents").select(F.col("doc_id").alias("photo_id"), read.alias("text")))


def op12_oracle() -> str:
    from .blobs import BASE, RULES

    parts = []
    for rank, (kind, _, pattern, group, least) in enumerate(RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""select doc_id, '{kind}' as kind, {rank} as rank, unnest(range(1, len(h) + 1)) as i, unnest(list_transform(h, lambda x: length(x))) as n,
 unnest(list_transform(g[1:len(h)], lambda x: length(x))) as gap, unnest(list_transform(c, lambda x: length(x) >= {least})) as ok
 from (select doc_id, regexp_extract_all(t, {p}, 0) as h, string_split_regex(t, {p}) as g, regexp_extract_all(t, {p}, {group}) as c from d where regexp_matches(t, {p}))"""
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    one = "kind || ':' || b - n || ':' || b"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
e as (select *, cast(sum(gap + n) over (partition by doc_id, kind order by i) as bigint) as b from m),
s as (select *, b - n as a from e where ok)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
 sha256(coalesce(string_agg({one}, ',' order by a, rank) filter (kind in ({base})), '')) as base_sha256,
 coalesce(string_agg({one}, ',' order by a, rank), '') as spans
from d left join s on d.doc_id = s.doc_id group by d.doc_id"""


@query("op12_secret_scan", op12_oracle())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from .blobs import BASE, scan_changes

    notes = table(spark, folder, "documents").select(
        F.col("doc_id").alias("photo_id"), F.lit(0).alias("seq"), F.lit("note").alias("field"), F.col("text").alias("value")
    )
    r = scan_changes(notes)

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def spans(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = F.filter("found", lambda f: f["kind"].isin(*BASE))
    return r.select(F.col("photo_id").alias("doc_id"), *[number(k) for k in BASE], F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from .loops import summary_loops

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looping(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    summary = F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, looping(w)))).otherwise(F.col("text"))
    r = summary_loops(table(spark, folder, "documents").select(F.col("doc_id").alias("photo_id"), summary.alias("summary")))
    best = F.array_max(F.transform("loops", lambda x: F.struct((x["length"] / x["period"]).alias("exponent"), (-x["start"]).alias("s"), (-x["period"]).alias("p"), x["length"].alias("n"))))
    lines = F.transform("loops", lambda x: F.concat(F.concat_ws(",", *[x[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    return r.withColumn("best", best).select(
        F.col("photo_id").alias("doc_id"),
        F.size("loops").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.n) div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
