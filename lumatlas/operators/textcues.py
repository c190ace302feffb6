"""Scene text → country likelihood rules. Every rule is tested in one projection over the text; nothing is joined
until a line has been reduced to the keys it hits."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import col
from ..functions.names import lookup

SPANISH = ["ES", "MX", "AR", "CO", "PE", "CL", "VE", "EC", "BO", "UY"]
ARABIC = ["SA", "AE", "EG", "MA", "DZ", "TN", "IQ", "JO", "IR", "PK"]


def each(codes: list[str], lr: float) -> dict[str, float]:
    return dict.fromkeys(codes, lr)


# Fixed values: (key, letters of the script, country ratios, ratio elsewhere).
SCRIPTS = [
    ("script:cyrillic", r"\p{IsCyrillic}", each(["RU", "UA", "BY", "BG", "RS", "KZ", "MN", "UZ"], 10), 0.02),
    ("script:greek", r"\p{IsGreek}", {"GR": 40}, 0.02),
    ("script:hangul", r"\p{IsHangul}", {"KR": 60}, 0.01),
    ("script:kana", r"\p{InHiragana}\p{InKatakana}", {"JP": 80}, 0.01),
    ("script:han", r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}", {"CN": 12, "TW": 10, "HK": 10, "JP": 4, "SG": 3, "MY": 1.5}, 0.03),
    ("script:thai", r"\p{IsThai}", {"TH": 80}, 0.01),
    ("script:khmer", r"\p{IsKhmer}", {"KH": 80}, 0.01),
    ("script:devanagari", r"\p{IsDevanagari}", {"IN": 15, "NP": 20}, 0.02),
    ("script:bengali", r"\p{IsBengali}", {"BD": 20, "IN": 8}, 0.02),
    ("script:tamil", r"\p{IsTamil}", {"IN": 10, "LK": 12, "SG": 3, "MY": 2}, 0.02),
    ("script:sinhala", r"\p{IsSinhala}", {"LK": 80}, 0.01),
    ("script:arabic", r"\p{IsArabic}", each(ARABIC, 8), 0.03),
    ("script:hebrew", r"\p{IsHebrew}", {"IL": 80}, 0.01),
    ("script:ethiopic", r"\p{IsEthiopic}", {"ET": 80}, 0.01),
    ("script:mongolian", r"\p{IsMongolian}", {"MN": 30, "CN": 5}, 0.01),
]

# Letters that single out a language, tested on lower-cased text.
LETTERS = [
    ("letter:uk", "іїєґ", {"UA": 30}, 0.1),
    ("letter:be", "ў", {"BY": 40}, 0.1),
    ("letter:sr", "ђћљњџј", {"RS": 40}, 0.1),
    ("letter:kk", "қңәғұһ", {"KZ": 40}, 0.1),
    ("letter:mn", "өү", {"MN": 20, "KZ": 3}, 0.2),
    ("letter:ru", "ыэ", {"RU": 4, "BY": 3, "KZ": 2}, 0.3),
    ("letter:de", "ß", {"DE": 10, "AT": 8}, 0.1),
    ("letter:es", "ñ", each(SPANISH, 8), 0.1),
    ("letter:pt", "ãõ", {"PT": 12, "BR": 12}, 0.1),
    ("letter:no_da", "øæ", {"NO": 15, "DK": 15}, 0.05),
    ("letter:nordic", "å", {"NO": 8, "DK": 6, "SE": 10, "FI": 3}, 0.1),
    ("letter:hu", "őű", {"HU": 40}, 0.05),
    ("letter:pl", "ł", {"PL": 40}, 0.05),
    ("letter:cs", "řů", {"CZ": 40}, 0.05),
    ("letter:ro", "șțţ", {"RO": 40}, 0.05),
    ("letter:tr", "ğış", {"TR": 30}, 0.05),
    ("letter:lt", "ėųį", {"LT": 40}, 0.05),
    ("letter:lv", "ķļņ", {"LV": 40}, 0.05),
    ("letter:macron", "āēīū", {"LV": 6, "LT": 2, "NZ": 4}, 0.2),
    ("letter:is", "ðþ", {"IS": 60}, 0.02),
    ("letter:vi", "ơưđ", {"VN": 60}, 0.02),
    ("letter:fa", "پچژگ", {"IR": 15, "PK": 4}, 0.1),
    ("letter:ur", "ٹڈڑے", {"PK": 30}, 0.1),
]

# Fixed values: (key, pattern, case matters, country ratios, ratio elsewhere).
WORDS = [
    ("word:de_street", r"(?:stra(?:ss|ß)e|platz|gasse)\b|\bstr\.", False, {"DE": 8, "AT": 6, "CH": 5}, 0.2),
    ("word:fr_street", r"\b(?:rue|allée|impasse)\b", False, {"FR": 8, "BE": 4, "CH": 3, "CA": 2, "MA": 2, "SN": 2}, 0.3),
    ("word:es_street", r"\b(?:calle|avenida|carrera)\b", False, each(SPANISH, 6), 0.2),
    ("word:pt_street", r"\b(?:rua|travessa|largo)\b", False, {"PT": 10, "BR": 10}, 0.1),
    ("word:it_street", r"\b(?:Via|VIA|Viale|VIALE|Piazza|PIAZZA|Corso|CORSO)\s+[A-Z]", True, {"IT": 10, "CH": 2}, 0.2),
    ("word:pl_street", r"\b(?:ulica|ul\.|aleja)", False, {"PL": 20}, 0.1),
    ("word:hu_street", r"\butca\b", False, {"HU": 40}, 0.05),
    ("word:se_street", r"\w(?:gatan|vägen|gränd)\b", False, {"SE": 30}, 0.05),
    ("word:no_street", r"\w(?:veien|vegen)\b", False, {"NO": 20}, 0.1),
    ("word:fi_street", r"\w(?:katu|tie)\b", False, {"FI": 10}, 0.3),
    ("word:ms_street", r"\b(?:jalan|jl\.)", False, {"ID": 15, "MY": 15, "SG": 3}, 0.05),
    ("word:th_street", r"\b(?:soi|thanon)\b", False, {"TH": 30}, 0.1),
    ("word:ca_street", r"\bcarrer\b", False, {"ES": 20}, 0.05),
    ("word:nl_street", r"(?:straat|gracht)\b", False, {"NL": 12, "BE": 6}, 0.2),
    ("word:tr_street", r"(?:sokak|sokağı|caddesi)\b|\bcad\.", False, {"TR": 40}, 0.05),
    ("word:pare", r"\bPARE\b", True, {"BR": 20}, 0.05),
    ("word:alto", r"\bALTO\b", True, {"MX": 8, "AR": 6, "CL": 6, "PE": 6, "CO": 4, "BO": 6, "EC": 6, "VE": 6, "UY": 6}, 0.1),
    ("word:arret", r"\bARR[ÊE]T\b", True, {"CA": 20, "FR": 1}, 0.05),
]

# Web endings whose country code is the ending in capitals, and the one that differs.
TLD_CODES = (
    "de fr es it pt nl be ch at pl cz sk hu ro bg gr se no dk fi ee lv lt ie ru ua by tr jp kr cn tw hk th vn my sg id ph "
    "in pk au nz za ke ng eg ma br ar cl mx co pe ca is hr rs il ae sa ir kz"
).split()
TLD = {**{c: c.upper() for c in TLD_CODES}, "uk": "GB"}
TLD_PATTERN = r"\b[a-z0-9-]+\.(?:(?:com?|org|gov|net|ac|edu)\.)?([a-z]{2})\b"

# Calling codes.
PHONE = {
    "1": ["US", "CA"], "7": ["RU", "KZ"], "20": ["EG"], "27": ["ZA"], "30": ["GR"], "31": ["NL"], "32": ["BE"], "33": ["FR"],
    "34": ["ES"], "36": ["HU"], "39": ["IT"], "40": ["RO"], "41": ["CH"], "43": ["AT"], "44": ["GB"], "45": ["DK"], "46": ["SE"],
    "47": ["NO"], "48": ["PL"], "49": ["DE"], "51": ["PE"], "52": ["MX"], "54": ["AR"], "55": ["BR"], "56": ["CL"], "57": ["CO"],
    "60": ["MY"], "61": ["AU"], "62": ["ID"], "63": ["PH"], "64": ["NZ"], "65": ["SG"], "66": ["TH"], "81": ["JP"], "82": ["KR"],
    "84": ["VN"], "86": ["CN"], "90": ["TR"], "91": ["IN"], "92": ["PK"], "94": ["LK"], "98": ["IR"], "212": ["MA"], "234": ["NG"],
    "254": ["KE"], "351": ["PT"], "353": ["IE"], "354": ["IS"], "358": ["FI"], "380": ["UA"], "420": ["CZ"], "852": ["HK"],
    "886": ["TW"], "971": ["AE"], "972": ["IL"], "966": ["SA"],
}
PHONE_PATTERN = r"(?:\+|\b00)(\d{1,3})[\s.\-()]*\d"
MIN_SCORE = 0.5
PLAIN_SCORE = 0.9


def usable_lines(lines: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Lines read well enough; plain strings (no score) count as 0.9."""
    return lines.withColumn("score", F.coalesce("score", F.lit(PLAIN_SCORE))).filter(F.col("score") >= min_score)


def _hits(tests: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests]))


def script_keys(text) -> Column:
    return _hits([(k, col(text).rlike(f"[{cls}&&\\p{{L}}]")) for k, cls, _, _ in SCRIPTS])


def letter_keys(text) -> Column:
    low = F.lower(col(text))
    return _hits([(k, low.rlike(f"[{s}]")) for k, s, _, _ in LETTERS])


#: Parts of which every match of a word rule holds one, folded as :func:`_folded` does where the rule ignores case.
WORD_PARTS = {
    "word:de_street": ("strasse", "platz", "gasse", "str."), "word:fr_street": ("rue", "allée", "impasse"), "word:es_street": ("calle", "avenida", "carrera"),
    "word:pt_street": ("rua", "travessa", "largo"), "word:it_street": ("Via", "VIA", "Piazza", "PIAZZA", "Corso", "CORSO"), "word:pl_street": ("ulica", "ul.", "aleja"),
    "word:hu_street": ("utca",), "word:se_street": ("gatan", "vägen", "gränd"), "word:no_street": ("veien", "vegen"), "word:fi_street": ("katu", "tie"),
    "word:ms_street": ("jalan", "jl."), "word:th_street": ("soi", "thanon"), "word:ca_street": ("carrer",), "word:nl_street": ("straat", "gracht"),
    "word:tr_street": ("sokak", "sokaği", "caddesi", "cad."), "word:pare": ("PARE",), "word:alto": ("ALTO",), "word:arret": ("ARRET", "ARRÊT"),
}


def _folded(text: Column) -> Column:
    """Letters that a pattern without case takes for one another are one letter here, ``ß`` is ``ss``."""
    return F.lower(F.replace(F.translate(text, "ẞİıſ", "ßiis"), F.lit("ß"), F.lit("ss")))


def word_keys(text) -> Column:
    """A text is searched by those patterns only whose parts it holds."""
    plain = col(text)

    def found(folded: Column) -> Column:
        def hit(key: str, pattern: str, case: bool) -> Column:
            there = reduce(or_, [F.contains(plain if case else folded, F.lit(p)) for p in WORD_PARTS[key]])
            return F.when(there, plain.rlike(("(?U)" if case else "(?iU)") + pattern))

        return _hits([(k, hit(k, p, case)) for k, p, case, _, _ in WORDS])

    return F.transform(F.array(_folded(plain)), found)[0]  # folded once for all rules


def tld_keys(text) -> Column:
    found = F.regexp_extract_all(col(text), F.lit("(?iU)" + TLD_PATTERN), F.lit(1))
    codes = F.transform(F.array_distinct(F.transform(found, lambda t: F.lower(t))), lambda t: lookup(TLD, t))
    return F.transform(F.array_distinct(F.array_compact(codes)), lambda c: F.concat(F.lit("tld:"), c))


def phone_keys(text) -> Column:
    """Longest calling code of each number found."""
    found = F.array_distinct(F.regexp_extract_all(col(text), F.lit("(?U)" + PHONE_PATTERN), F.lit(1)))
    known = F.array(*[F.lit(p) for p in PHONE])

    def code(d: Column) -> Column:
        cut = [F.substring(d, 1, n) for n in (3, 2, 1)]
        return F.coalesce(*[F.when(F.array_contains(known, c), c) for c in cut])

    return F.transform(F.array_distinct(F.array_compact(F.transform(found, code))), lambda c: F.concat(F.lit("phone:"), c))


FAMILIES = {"script": script_keys, "letter": letter_keys, "word": word_keys, "tld": tld_keys, "phone": phone_keys}


def line_hits(lines: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """One row per line and rule it hits (columns of ``lines`` plus ``rule``)."""
    keys = F.concat(*[FAMILIES[f]("text") for f in families])
    return lines.withColumn("rule", F.explode(keys))


def best_hits(hits: DataFrame) -> DataFrame:
    """Best-scoring line per photo and rule, the earlier line on ties; combined before the shuffle."""
    pick = F.min(F.struct((-F.col("score")).alias("s"), "line_id", "score", F.substring("text", 1, 60).alias("detail")))
    return hits.groupBy("photo_id", "rule").agg(pick.alias("b")).select("photo_id", "rule", "b.line_id", "b.score", "b.detail")


def drop_han_with_kana(hits: DataFrame) -> DataFrame:
    """Kana means Japanese even where Chinese characters also matched."""
    kana = hits.filter(F.col("rule") == "script:kana").select("photo_id", F.lit("script:han").alias("rule"))
    return hits.join(kana, ["photo_id", "rule"], "left_anti")


def analyse(lines: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Text lines (photo_id, line_id, score, text) → one observation per photo and rule."""
    return drop_han_with_kana(best_hits(line_hits(usable_lines(lines, min_score))))


def text_rules(spark: SparkSession) -> DataFrame:
    """The fixed rule table in the layout the evidence operators read."""
    from .evidence import RULE_SCHEMA

    rows = [(k, m, o) for k, _, m, o in SCRIPTS] + [(k, m, o) for k, _, m, o in LETTERS] + [(k, m, o) for k, _, _, m, o in WORDS]
    rows += [(f"tld:{c}", {c: 25}, 0.2) for c in sorted(set(TLD.values()))]
    rows += [(f"phone:{p}", each(cc, 20), 0.2) for p, cc in PHONE.items()]
    data = [(k, k, {c: float(x) for c, x in m.items()}, None, None, None, None, float(o)) for k, m, o in rows]
    return spark.createDataFrame(data, RULE_SCHEMA)
