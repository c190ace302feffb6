"""Scene text rules, over the OCR-like lines and over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import textcues as X
from .q_scalars import r6
from .views import query

BEGIN, END, WORD = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]"
SQL_SCRIPTS = {
    "script:cyrillic": r"\p{Cyrillic}", "script:greek": r"\p{Greek}", "script:hangul": r"\p{Hangul}",
    "script:kana": r"[\p{Hiragana}\p{Katakana}ー]", "script:han": r"\p{Han}", "script:thai": r"\p{Thai}", "script:khmer": r"\p{Khmer}",
    "script:devanagari": r"\p{Devanagari}", "script:bengali": r"\p{Bengali}", "script:tamil": r"\p{Tamil}",
    "script:sinhala": r"\p{Sinhala}", "script:arabic": r"\p{Arabic}", "script:hebrew": r"\p{Hebrew}",
    "script:ethiopic": r"\p{Ethiopic}", "script:mongolian": r"\p{Mongolian}",
}


def re2(p: str) -> str:
    """Word boundaries as plain character tests: the second engine's \\b knows ASCII only."""
    import re

    p = re.sub(r"(^|\|)\\b", lambda m: m.group(1) + BEGIN, p)
    return p.replace(r"\b", END).replace(r"\w", WORD)


ALL_LINES = """lines as (select line_id, text from text_lines union all select 1000000 + doc_id, text from documents)"""


def _lines(v):
    t = v.text_lines.select("line_id", "text")
    return t.unionByName(v.documents.select((F.col("doc_id") + 1000000).alias("line_id"), "text"))


def _family_sql(tests: dict[str, str]) -> str:
    pats = ",".join("('" + k + "','" + p.replace("'", "''") + "')" for k, p in tests.items())
    return f"with {ALL_LINES}, r(rule, p) as (values {pats}) select line_id, rule from lines, r where regexp_matches(text, p)"


def _family(v, name):
    return X.line_hits(_lines(v), (name,)).select("line_id", "rule")


@query("join_text_script", "text_lines", _family_sql(SQL_SCRIPTS))
def _(v):
    return _family(v, "script")


@query(
    "join_text_letters",
    "text_lines",
    _family_sql({k: f"[{s}]" for k, s, _, _ in X.LETTERS}).replace("regexp_matches(text, p)", "regexp_matches(lower(text), p)"),
)
def _(v):
    return _family(v, "letter")


@query(
    "join_text_words",
    "text_lines",
    _family_sql({k: ("" if case else "(?i)") + re2(p) for k, p, case, _, _ in X.WORDS}),
)
def _(v):
    return _family(v, "word")


_TLD_SQL = ",".join(f"('{k}','{c}')" for k, c in X.TLD.items())


@query(
    "join_text_tld",
    "text_lines",
    f"""with {ALL_LINES}, m(tld, cc) as (values {_TLD_SQL}),
      f as (select line_id, lower(unnest(regexp_extract_all(text, '(?i){X.TLD_PATTERN}', 1))) as tld from lines)
    select distinct line_id, concat('tld:', cc) as rule from f join m using (tld)""",
)
def _(v):
    return _family(v, "tld")


_PHONE_SQL = ",".join(f"('{p}')" for p in X.PHONE)


@query(
    "join_text_phone",
    "text_lines",
    f"""with {ALL_LINES}, m(code) as (values {_PHONE_SQL}),
      f as (select distinct line_id, unnest(regexp_extract_all(text, '{X.PHONE_PATTERN}', 1)) as digits from lines),
      g as (select line_id, digits, max(length(code)) as n from f join m on starts_with(digits, code) group by 1,2)
    select distinct line_id, concat('phone:', substr(digits,1,n)) as rule from g""",
)
def _(v):
    return _family(v, "phone")


@query(
    "flt_text_score",
    "text_lines",
    """select line_id, round(coalesce(case when line_id%10=0 then null else score end, 0.9),6)+0.0 as score from text_lines
    where coalesce(case when line_id%10=0 then null else score end, 0.9) >= 0.5""",
)
def _(v):
    t = v.text_lines.withColumn("score", F.when(F.col("line_id") % 10 != 0, F.col("score")))
    return X.usable_lines(t).select("line_id", r6(F.col("score")).alias("score"))


# Which rules each kind of derived line hits, written out by hand.
_HITS = """grouped as (select line_id//3 as photo_id, line_id, score, text from text_lines where score>=0.5),
hits as (select photo_id, line_id, score, unnest(case line_id%8
   when 0 then ['letter:de','word:de_street'] when 1 then ['word:hu_street'] when 2 then ['phone:48'] when 3 then ['tld:BR']
   when 4 then ['script:kana','script:han'] when 5 then ['script:cyrillic'] when 6 then ['phone:351'] else [] end) as rule from grouped)"""


def _grouped(v):
    return v.text_lines.select(F.floor(F.col("line_id") / 3).alias("photo_id"), "line_id", "score", "text")


@query(
    "agg_best_text_hit",
    "text_lines",
    f"""with {_HITS} select photo_id, rule, line_id, round(score,6)+0.0 as score from
    (select *, row_number() over (partition by photo_id, rule order by score desc, line_id) as rn from hits) where rn=1""",
)
def _(v):
    b = X.best_hits(X.line_hits(X.usable_lines(_grouped(v))))
    return b.select("photo_id", "rule", "line_id", r6(F.col("score")).alias("score"))


@query(
    "join_kana_han",
    "text_lines",
    f"""with {_HITS} select distinct photo_id, rule from hits h where not (rule='script:han' and exists
    (select 1 from hits k where k.photo_id=h.photo_id and k.rule='script:kana'))""",
)
def _(v):
    return X.analyse(_grouped(v)).select("photo_id", "rule")


@query(
    "join_text_not_seen",
    "text_lines",
    f"""with {_HITS}, vlm as (select distinct photo_id+1 as photo_id, rule from hits)
    select photo_id, rule, 0.7e0 as weight from vlm v where not exists (select 1 from hits h where h.photo_id=v.photo_id and h.rule=v.rule)""",
)
def _(v):
    ocr = X.best_hits(X.line_hits(X.usable_lines(_grouped(v))))
    vlm = ocr.select((F.col("photo_id") + 1).alias("photo_id"), "rule")
    return E.text_not_seen(vlm, ocr).select("photo_id", "rule", "weight")
