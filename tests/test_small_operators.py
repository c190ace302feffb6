"""Explanations and the seeded projection by hand."""

import numpy as np
from pyspark.sql import functions as F

from lumatlas.operators.results import explain, fmt_ratio
from lumatlas.operators.vector_ops import random_projection


def test_explanation_names_the_strongest(spark):
    rows = [
        (1, "a", "Palms", 2.0, 7.4, "supports"), (1, "b", "Left traffic", 3.0, 20.1, "supports"), (1, "c", "Script", 1.0, 2.7, "supports"),
        (1, "d", "Snow", 0.5, 1.6, "supports"), (1, "e", "Web ending", -0.7, 0.5, "contradicts"), (1, "f", "Phone", -2.0, 0.14, "contradicts"),
        (2, "a", "Palms", 0.0, 1.0, "neutral"),
    ]
    df = spark.createDataFrame(rows, "photo_id int, key string, label string, log_ratio double, ratio double, direction string")
    texts = {r.key: r.t for r in df.filter("photo_id = 1").select("key", fmt_ratio("ratio").alias("t")).collect()}
    got = {r.photo_id: r.explanation for r in explain(df, F.lit("Best estimate.")).collect()}
    strongest = "; ".join(f"{label} ({texts[k]})" for k, label in (("b", "Left traffic"), ("a", "Palms"), ("c", "Script")))
    assert got == {1: f"Best estimate. Key evidence: {strongest}. Conflicting: Phone.", 2: "Best estimate."}


def test_projection_is_seeded_and_of_length_one(spark):
    x = np.random.default_rng(1).standard_normal((40, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "photo_id int, pixels array<double>").repartition(3)
    got = {r.photo_id: np.array(r.projected) for r in random_projection(df, "pixels", 12, 5, seed=3).collect()}
    want = x @ np.random.default_rng(3).standard_normal((12, 5))
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert len(got) == 40 and all(np.allclose(got[i], want[i]) for i in got)
