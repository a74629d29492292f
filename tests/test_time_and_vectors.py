"""Joins over time, streams in batches and vector search against plain loops, with hot keys, nulls, ties and empty tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerloom.operators import maintenance, temporal, vectors
from offerloom.plans import analytics
from offerloom.streaming import due, retries, sessions

DAY = datetime(2024, 1, 1)


def test_asof_equals_a_plain_search(spark):
    rnd = random.Random(2)
    key = lambda: rnd.choice(["hot"] * 4 + [f"k{rnd.randint(0, 30)}", None])
    left = [(n, key(), rnd.choice([None, *range(200)] if rnd.random() < 0.1 else range(200)), "x") for n in range(900)]
    left += left[:5]
    right = [(key(), rnd.choice([None, *range(200)] if rnd.random() < 0.1 else range(200)), rnd.randint(0, 50), str(n)) for n in range(500)]
    l = spark.createDataFrame(left, "n int, k string, at int, value string").repartition(6)
    r = spark.createDataFrame(right, "k string, since int, price int, note string").repartition(6)

    def last(k, at):
        before = [x for x in right if k is not None and at is not None and x[0] == k and x[1] is not None and x[1] <= at]
        return max(((x[1], x[2]) for x in before), default=(None, None))

    got = temporal.asof_join(l, r, "k", "at", "since", ("since", "price"), tie="price")
    want = sorted(((*x, *last(x[1], x[2])) for x in left), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert temporal.asof_join(l.where("false"), r, "k", "at", "since", ("price",)).count() == 0
    assert temporal.asof_join(l, r.where("false"), "k", "at", "since", ("price",)).where("price is null").count() == len(left)


@pytest.mark.parametrize("by", ["k", None])
def test_interval_join_equals_all_pairs(spark, by):
    rnd = random.Random(3)
    spans = [(n, rnd.choice("aab"), s := rnd.choice([None, *range(100)] if rnd.random() < 0.1 else range(1000)), None if rnd.random() < 0.1 or s is None else s + rnd.choice([-3, 0, 1, 2, 7, 8, 9, 64, 500, 5000])) for n in range(200)]
    points = [(m, rnd.choice(["a", "b", None]), None if rnd.random() < 0.1 else rnd.randint(-5, 1500)) for m in range(300)]
    s = spark.createDataFrame(spans, "n int, k string, s int, e int")
    p = spark.createDataFrame(points, "m int, k string, at int")
    if by is None:
        p = p.drop("k")
    joined = temporal.interval_join(s, p, "s", "e", "at", by=by, width=8.0)
    want = sorted((m, n) for n, k, a, b in spans for m, j, t in points if a is not None and t is not None and (by is None or k == j) and a <= t and (b is None or t < b))
    assert sorted((r.m, r.n) for r in joined.select("m", "n").collect()) == want
    plan = joined._jdf.queryExecution().optimizedPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.interval_join(s.where("false"), p, "s", "e", "at", by=by).count() == 0 and temporal.interval_join(s, p.where("false"), "s", "e", "at", by=by).count() == 0


def test_long_intervals_fill_few_bins(spark):
    s = spark.createDataFrame([(k, 0, 2**k) for k in range(40)], "n int, s long, e long")
    p = spark.createDataFrame([(2**k,) for k in range(40)], "at long")
    joined = temporal.interval_join(s, p, "s", "e", "at", width=1.0)
    assert joined.count() == sum(1 for a in range(40) for b in range(40) if b < a)


def plain_best(rows, k):
    import numpy as np

    a = np.array([v for _, v in rows], float)
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    sims = np.round(a @ a.T, 6)
    return {rows[i][0]: [rows[j][0] for j in sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-sims[i, j], rows[j][0]))[:k]] for i in range(0, len(rows), 10)}


def test_neighbours_equal_all_pairs_in_small_blocks(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(160)]
    rows += [(i, rows[0][1]) for i in range(160, 240)] + [(240, [0.0] * 6)]  # a hot cell of equal vectors, and one without direction
    d = spark.createDataFrame([*rows, (None, [1.0] * 6), (999, None), (998, [])], "vec_id long, embedding array<float>").repartition(3)
    index = vectors.build(d, cells=5)
    assert index.rows.count() == len(rows)
    got = vectors.neighbours(index, index.rows.where("id % 10 = 0"), k=4, probes=5, block=16)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert found == plain_best(rows, 4)
    assert vectors.build(d.where("false")).rows.count() == 0


def test_recall_of_the_index(spark):
    sf = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.id) for r in analytics.vector_neighbours_exact(spark, sf).collect()}
    found = {(r.query_id, r.id) for r in analytics.vector_neighbours(spark, sf).collect()}
    assert len(exact) == 400 and len(exact & found) / len(exact) >= 0.9


def stream_of(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}")


def rows_of(out, folder, mode="append"):
    got = []
    out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).foreachBatch(lambda b, n: got.append([tuple(r) for r in b.collect()])).start().awaitTermination()
    return got


def attempts(n=160, seed=1):
    rnd = random.Random(seed)
    rows = sorted((DAY + timedelta(seconds=rnd.randint(0, 5 * 86400)), rnd.randint(1, 12)) for _ in range(n))
    return [(k, offer, at, rnd.random() < 0.7) for k, (at, offer) in enumerate(rows)]


def test_offers_fall_due_as_the_batch_form_says(spark, tmp_path):
    rows = attempts()
    schema = "attempt_id long, offer_id long, ts timestamp, ok boolean"
    cuts = [rows[:50], rows[50:90], rows[90:91], rows[91:]]
    stream = stream_of(spark, f"{tmp_path}/in", cuts, schema)
    with due.timers_allowed(spark):
        changes = [r for b in rows_of(due.freshness_changes(stream, late="0 seconds"), f"{tmp_path}/out") for r in b]
    d = spark.createDataFrame(changes, "offer_id long, at timestamp, change string").cache()
    for batch in cuts:
        now = batch[-1][2]
        seen = spark.createDataFrame([r for r in rows if r[2] <= now], schema)
        state = retries_of(seen)
        want = {r.offer_id: r.due for r in state.select("offer_id", maintenance.needs_refresh(F.lit(now)).alias("due")).collect()}
        got = {r.offer_id: r.due for r in due.due_at(d, F.lit(now)).collect()}
        assert got == want and len(set(want.values())) == 2
    assert {c for _, _, c in changes} == {"fetched", "failed", "expired"}


def retries_of(seen):
    return maintenance.retry_state(seen).withColumn("last_status_code", F.lit(None).cast("int"))


def test_retry_states_are_carried_over_batches(spark, tmp_path):
    rows = attempts(120, 9)
    schema = "attempt_id long, offer_id long, ts timestamp, ok boolean"
    stream = stream_of(spark, f"{tmp_path}/in", [rows[:30], rows[30:70], rows[70:75], rows[75:]], schema)
    last = {}
    batches = rows_of(retries.retry_states(stream), f"{tmp_path}/out", "update")
    for b in batches:
        last |= {r[0]: r for r in b}
    want = maintenance.retry_state(spark.createDataFrame(rows, schema)).collect()
    assert last == {r.offer_id: (r.offer_id, r.retry_count, r.last_error_at, r.fetched_at) for r in want} and len(batches) >= 4


def test_sessions_and_late_rows(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    schema = "event_id long, user_id long, ts timestamp, value double"
    first = [(1, 7, at(0), 1.0), (2, 7, at(20), 2.0), (2, 7, at(20), 2.0), (3, 8, at(300), 5.0)]
    late = [(4, 7, at(30), 4.0), (5, 8, at(310), 6.0), (6, None, at(320), 1.0), (7, 8, None, 1.0)]
    batches = [first, [(10, 9, at(305), 1.0)], late, [(11, 9, at(900), 1.0)]]
    side = sessions.LateRows(f"{tmp_path}/side")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_of(spark, f"{tmp_path}/in", batches, schema)
    got = [r for b in rows_of(sessions.sessions(stream()), f"{tmp_path}/out") for r in b]
    want = [(7, at(0), at(50), 2, 3.0, 2), (8, at(300), at(340), 2, 11.0, 5), (9, at(305), at(335), 1, 1.0, 10)]
    assert sorted(got) == want
    stream().writeStream.foreachBatch(side.step).option("checkpointLocation", f"{tmp_path}/side-state").trigger(availableNow=True).start().awaitTermination()
    assert [(r.event_id, r.batch) for r in side.read(spark).collect()] == [(4, 2)]
    table = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(map(tuple, sessions.sessions(table).collect()))[0] == (7, at(0), at(60), 3, 7.0, 4)


def test_pairs_within_an_hour_have_bounded_state(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    schema = "event_id long, user_id long, ts timestamp"
    a = [[(1, 7, at(0)), (2, 7, at(59)), (3, None, at(1))], [(4, 7, at(500))], [(5, 8, at(1500))]]
    b = [[(11, 7, at(60)), (12, 7, at(0)), (13, 8, at(0))], [(14, 7, at(561)), (15, 7, at(560))], [(16, 8, at(1499))]]
    first, then = (stream_of(spark, f"{tmp_path}/{n}", x, schema) for n, x in (("a", a), ("b", b)))
    out = sessions.followed_within(first, then)
    kept = []
    query = out.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda d, n: kept.extend((r.first_id, r.then_id) for r in d.collect())).start()
    query.awaitTermination()
    assert sorted(kept) == [(1, 11), (1, 12), (2, 11), (4, 15)]
    states = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] <= 4  # rows of the last hours alone
    tables = (spark.createDataFrame([r for x in t for r in x], schema) for t in (a, b))
    assert sorted((r.first_id, r.then_id) for r in sessions.followed_within(*tables).collect()) == sorted(kept)
