"""Streams over several micro-batches against folds of the whole, with state that ends and batches that run twice."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumatlas.streaming import io, ops
from lumatlas.streaming.known import KnownIds

START = datetime(2024, 5, 1)


def at(ms):
    return START + timedelta(milliseconds=ms)


def closing(spark, schema, values, ms):
    return spark.createDataFrame([(*values[:-1], at(ms)) if values[-1] is None else values], schema)


# ---- progressive answers ------------------------------------------------------------------------

CLUES = "request bigint, kind string, rule string, score double, weight double, at timestamp"


def clue_rows():
    r = random.Random(5)
    rows = []
    for q in range(60):
        t = q * 1500
        if q % 11 != 10:  # some requests never open
            rows.append((q, "open", None, None, None, t))
        for kind in ("visual", "fast", "fast", "vlm"):
            if r.random() < 0.7:
                after = r.choice([0, 200, 700, 750, 751, 900]) if kind != "vlm" else r.choice([300, 5000, 12_000, 12_001, 15_000])
                rows.append((q, kind, f"{kind}{r.randrange(100)}", 0.5, 1.0, t + after))
    return rows


def batch_fold(rows):
    """The last version of each answer, from all clues at once."""
    started = {r[0]: r[5] for r in rows if r[1] == "open"}
    out = {}
    for q, t in started.items():
        clues = [r for r in rows if r[0] == q and r[1] != "open" and r[5] <= t + (12_000 if r[1] == "vlm" else 750)]
        for name, kinds, needs in (("partial", {"visual"}, "visual"), ("result", {"visual", "fast"}, None), ("refined", {"visual", "fast", "vlm"}, "vlm")):
            if needs is None or any(c[1] == needs for c in clues):
                out[q, name] = sorted(c[2] for c in clues if c[1] in kinds) or [None]
    return out


def test_progressive_answers(spark, tmp_path):
    rows = clue_rows()
    shuffled = sorted(rows, key=lambda r: r[5] + random.Random(str(r)).randrange(-900, 900))  # out of order within the delay
    whole = spark.createDataFrame([(*r[:5], at(r[5])) for r in shuffled], CLUES)
    landing = io.Landing(whole, "clues", str(tmp_path / "landing"))
    cuts = [0, 40, 90, 150, len(shuffled)]
    parts = [spark.createDataFrame([(*r[:5], at(r[5])) for r in shuffled[a:b]], CLUES) for a, b in zip(cuts, cuts[1:], strict=False)]
    late = spark.createDataFrame([(1, "fast", "late", 0.5, 1.0, at(1500)), (-1, "tick", None, None, None, at(10**7))], CLUES)
    end = spark.createDataFrame([(-1, "tick", None, None, None, at(2 * 10**7))], CLUES)
    path = str(tmp_path / "answers")
    stages = ops.progressive_stages(landing.stream(), delay="2 seconds")
    reports = io.run_batches(stages, "answers", lambda b, i: io.write_batch(b, path, i), str(tmp_path / "state"), [(landing, [*parts, late, end])], "update")
    assert len(reports) >= 6
    held = io.state_rows(reports)
    assert max(held) > 10 and held[-1] == 0
    emitted = io.read_batches(spark, path, "request bigint, type string, rule string, score double, weight double")
    got = {}
    for r in ops.latest_answers(emitted).collect():
        got.setdefault((r.request, r.type), []).append(r.rule)
    assert {k: sorted(v, key=str) for k, v in got.items()} == batch_fold(rows)
    first = {(r.request, r.type): r.b for r in emitted.groupBy("request", "type").agg(F.min("batch").alias("b")).collect()}
    assert all(first[q, "partial"] <= first[q, "result"] for q, t in first if t == "partial")
    assert all(first[q, "result"] <= first[q, "refined"] for q, t in first if t == "refined")
    answered = emitted.filter("type = 'result'").groupBy("request").agg(F.countDistinct("batch").alias("n")).filter("n > 1").count()
    assert answered == 0, "a result is given once"


def test_progressive_answers_on_the_session_default_store(spark, tmp_path):
    key, hdfs = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, hdfs)
    try:
        rows = [(1, "open", None, None, None, at(0)), (1, "visual", "a", 0.5, 1.0, at(10)), (1, "vlm", "b", 0.5, 1.0, at(900)), (2, "open", None, None, None, at(5))]
        parts = [spark.createDataFrame(rows, CLUES), *[spark.createDataFrame([(-1, "tick", None, None, None, at(ms))], CLUES) for ms in (10**7, 2 * 10**7)]]
        landing = io.Landing(parts[0], "clues", str(tmp_path / "landing"))
        path = str(tmp_path / "answers")
        io.run_batches(ops.progressive_stages(landing.stream()), "answers", lambda b, i: io.write_batch(b, path, i), str(tmp_path / "state"), [(landing, parts)], "update")
    finally:
        spark.conf.set(key, before)
    got = io.read_batches(spark, path, "request bigint, type string, rule string, score double, weight double")
    assert sorted((r.request, r.type, r.rule or "") for r in got.collect()) == [(1, "partial", "a"), (1, "refined", "a"), (1, "refined", "b"), (1, "result", "a"), (2, "result", "")]


# ---- lifetimes ----------------------------------------------------------------------------------


def run_keyed(spark, tmp_path, rows, schema, closing_row, op, steps=5):
    whole = spark.createDataFrame(rows, schema)
    landing = io.Landing(whole, "keyed", str(tmp_path / "landing"))
    parts = [*io.in_steps(whole, "at", steps), spark.createDataFrame([closing_row], schema)]
    out, path = op(landing.stream()), str(tmp_path / "out")
    reports = []

    def start():
        w = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", path + "_state")
        return w.trigger(availableNow=True).start()

    reports = io.run_steps([(landing, parts)], start)
    return spark.read.schema(out.schema).parquet(path).collect(), io.state_rows(reports)


def test_results_expire(spark, tmp_path):
    r = random.Random(1)
    rows = sorted((f"c{r.randrange(30)}", i, at(r.randrange(40_000_000))) for i in range(400))
    rows = [(c, i, t) for i, (c, _, t) in enumerate(sorted(rows, key=lambda x: x[2]))]
    got, held = run_keyed(spark, tmp_path, rows, "content string, seq bigint, at timestamp", ("", -1, at(10**9)), lambda s: ops.dedupe_ttl(s, ttl_s=900))
    cached, expected = {}, {}
    for c, i, t in rows:
        if c not in cached or cached[c][1] < t:
            cached[c] = (i, t + timedelta(seconds=900))
            expected[i] = (c, i, False)
        else:
            expected[i] = (c, cached[c][0], True)
    assert {g.seq: (g.content, g.first_seq, g.cached) for g in got if g.content} == expected
    assert len([g for g in got if g.content]) == len(rows) and any(e[2] for e in expected.values())
    assert max(held) < 30 and held[-1] <= 1, "only results that still live, at the end the closing row's"


def test_buckets_are_forgotten_when_full(spark, tmp_path):
    r = random.Random(2)
    times = sorted(r.randrange(8_000_000) for _ in range(300))
    rows = [(r.randrange(8), i, r.choice([1.0, 3.0]), at(t)) for i, t in enumerate(times)]
    got, held = run_keyed(spark, tmp_path, rows, "client bigint, seq bigint, cost double, at timestamp", (-1, -1, 0.0, at(10**9)), lambda s: ops.token_bucket(s, per_minute=2.0, burst=5.0))
    tokens, last, expected = {}, {}, {}
    for c, i, cost, t in rows:
        have = min(5.0, tokens.get(c, 5.0) + (t - last.get(c, t)).total_seconds() * 2.0 / 60)
        ok = have >= cost
        expected[i] = 0.0 if ok else (cost - have) * 30
        tokens[c], last[c] = have - (cost if ok else 0), t
    assert {g.seq: g.wait_s for g in got if g.client >= 0} == pytest.approx(expected)
    assert any(w > 0 for w in expected.values()) and held[-1] <= 1 <= max(held) <= 9


# ---- two streams --------------------------------------------------------------------------------


def test_pins_wake_photos(spark, tmp_path):
    r = random.Random(3)
    hour = 3_600_000
    photos = [(i, i % 3, at(r.randrange(200 * hour))) for i in range(150)] + [(900, 1, at(50 * hour)), (901, 1, at(50 * hour))]
    pins = [(1000 + i, r.choice([0, 1, 2, 7]), at(r.randrange(200 * hour))) for i in range(40)] + [(2001, 1, at(38 * hour)), (2000, 1, at(62 * hour))]
    schema = "photo_id bigint, album_id bigint, taken_at timestamp"
    feeds, streams = [], []
    for name, rows, close in (("pins", pins, (-1, -1, at(10**9))), ("photos", photos, (-2, -2, at(10**9)))):
        whole = spark.createDataFrame(rows, schema)
        landing = io.Landing(whole, name, str(tmp_path / name))
        feeds.append((landing, [*io.in_steps(whole, "taken_at", 4), spark.createDataFrame([close], schema)]))
        streams.append(landing.stream())
    got = io.run_to_parquet(ops.wake_same_day(*streams), "wake", path=str(tmp_path / "out"), feeds=feeds).collect()
    expected = {}
    for i, album, t in photos:
        near = min(((abs(t - pt), p) for p, pa, pt in pins if pa == album and abs(t - pt) <= timedelta(hours=12)), default=None)
        if near:
            expected[i] = (near[1], near[0] // timedelta(microseconds=1))
    assert len(got) == len(expected) == len({g.photo_id for g in got})
    assert {g.photo_id: (g.near_id, g.micros_apart) for g in got} == expected


# ---- batches that run twice ---------------------------------------------------------------------


class Killed(Exception):
    pass


def killed_once(write, dies_at=1):
    """``write_batch`` that fails after its write the first time it sees batch ``dies_at``."""
    seen = []

    def run(rows, path, batch_id, *a):
        write(rows, path, batch_id, *a)
        if batch_id == dies_at and not seen:
            seen.append(batch_id)
            raise Killed(str(batch_id))

    return run


def with_a_kill(run, monkeypatch):
    monkeypatch.setattr(io, "write_batch", killed_once(io.write_batch))
    with pytest.raises(Exception, match="Killed|STREAM|1"):
        run()
    run()


def test_ingest_leaves_the_same_rows(spark, tmp_path, monkeypatch):
    whole = spark.createDataFrame([(i, None if i % 7 == 0 else float(i)) for i in range(100)], "photo_id bigint, lat double")
    landing = io.Landing(whole, "photos", str(tmp_path / "landing"))
    path = str(tmp_path / "out")
    for k in range(4):
        landing.land(whole.filter(f"photo_id % 4 = {k}").coalesce(1))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(landing.path)

    def run():
        ops.ingest(stream, lambda b: b.select("photo_id", (F.col("lat") * 2).alias("double")), F.col("lat").isNotNull(), path, state=str(tmp_path / "state"))

    with_a_kill(run, monkeypatch)
    rows = io.read_batches(spark, path, "photo_id bigint, double double, status string, error string").collect()
    assert sorted((r.photo_id, r.double, r.status) for r in rows) == [(i, None if i % 7 == 0 else 2.0 * i, "error" if i % 7 == 0 else "done") for i in range(100)]
    assert len({r.batch for r in rows}) >= 4


def test_embedding_leaves_the_same_rows(spark, tmp_path, monkeypatch):
    whole = spark.createDataFrame([(i % 60,) for i in range(100)], "image_id bigint")
    landing = io.Landing(whole, "images", str(tmp_path / "landing"))
    path = str(tmp_path / "store")
    known = KnownIds(spark, str(tmp_path / "known"), buckets=8, bits=1 << 10)
    old = spark.createDataFrame([(i, "stored") for i in range(0, 60, 3)], "image_id bigint, origin string")
    io.write_batch(old, path, -1)
    known.add(old, -1)
    for k in range(3):
        landing.land(spark.createDataFrame([(i % 60,) for i in range(100) if i * 3 // 100 == k], whole.schema).coalesce(1))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(landing.path)

    def run():
        ops.embed_new(stream, path, lambda b: b.withColumn("origin", F.lit("new")), known, state=str(tmp_path / "state"))

    with_a_kill(run, monkeypatch)
    rows = io.read_batches(spark, path, "image_id bigint, origin string").collect()
    assert sorted((r.image_id, r.origin) for r in rows) == [(i, "stored" if i % 3 == 0 else "new") for i in range(60)]


# ---- the index of known ids ---------------------------------------------------------------------


def test_known_ids_equal_the_anti_join(spark, tmp_path):
    known = KnownIds(spark, str(tmp_path / "known"), buckets=16, bits=1 << 9)
    rows = spark.range(500).select(F.col("id").alias("image_id")).unionByName(spark.createDataFrame([(None,), (3,)], "image_id bigint"))
    seen, fresh = known.split(rows)
    assert seen.count() == 0 and fresh.count() == 502
    known.add(spark.range(0, 500, 2).select(F.col("id").alias("image_id")), 0)
    known.add(spark.range(0, 500, 5).select(F.col("id").alias("image_id")), 1)
    stored = {i for i in range(500) if i % 2 == 0 or i % 5 == 0}
    seen, fresh = known.split(rows)
    assert sorted(r.image_id for r in seen.collect()) == sorted(stored)
    assert sorted(str(r.image_id) for r in fresh.collect()) == sorted([*[str(i) for i in range(500) if i not in stored], "None", "3"])
    seen, _ = known.split(rows, batch_id=1)
    assert {r.image_id for r in seen.collect()} == set(range(0, 500, 2)), "what the batch itself added doesn't count"


def test_reads_grow_with_the_batch(spark, tmp_path):
    known = KnownIds(spark, str(tmp_path / "known"), buckets=64)
    known.add(spark.range(5000).select((F.col("id") * 2).alias("image_id")), 0)

    def files(ids):
        rows = spark.createDataFrame([(i,) for i in ids], "image_id bigint")
        seen, _ = known.split(rows)
        asked = rows.withColumn("bucket", known._bucket())
        hit = [r.bucket for r in known._maybe(asked, None).select("bucket").distinct().collect()]
        return seen.count(), known.ids_in(hit).select(F.input_file_name()).distinct().count()

    assert files([1, 3, 5, 7]) == (0, 0), "new ids read no bucket"
    assert files([2]) == (1, 1)
    n, read = files([2, 4, 6, 8, 9, 11])
    assert n == 4 and read <= 4
    assert files(range(0, 4000, 2))[1] == 64
