"""All registered queries, and the flagship plan on the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import answers
from . import (
    locate,
    q_archive,
    q_evidence,
    q_retrieval,
    q_scalars,
    q_skyline,
    q_sources,
    q_spatial,
    q_stream,
    q_street,
    q_text,
)
from .rules_fixture import rules
from .views import Views, registered

__all__ = [
    "q_archive", "q_evidence", "q_retrieval", "q_scalars", "q_skyline", "q_sources", "q_spatial", "q_stream", "q_street", "q_text",
]


def queries():
    return registered()[0]


def oracle_sql():
    return registered()[1]


def flagship(v: Views) -> DataFrame:
    """Every detected photo located from its cues, scene text and model answer."""
    know = locate.Knowledge(
        model=q_evidence.model(v), rule_leafs=q_evidence.compact_leafs(v), rules=rules(v.spark, v.countries), places=v.places, countries=v.countries
    )
    photos = v.detections.select("photo_id").distinct()
    candidates = answers.candidates(answers.parse_answers(v.answers)).join(photos, "photo_id", "left_semi")
    lines = v.text_lines.join(photos, "photo_id", "left_semi")
    return locate.locate(photos, know, v.detections, lines, candidates)
