"""What keeps queries small on larger tables: work done once, rows that are not dealt again."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from offerloom.operators import matching


def test_offers_are_read_once_and_equal_queries_share_their_ranks(spark):
    q = spark.range(12).select(F.col("id").alias("query_id"), F.when(F.col("id") % 3 == 0, "s1").otherwise("s9").alias("store"), F.lit("EUR").alias("currency"), F.lit("Acme Phone X200 blue").alias("title"), F.lit("acme").alias("brand"), F.lit("X200").alias("model"))
    p = spark.createDataFrame([(1, "Acme Phone X200 blue", "acme", "X200", "0012345678"), (2, "Acme Phone X200 blue", "acme", "X200", "9")], "id long, title string, brand string, model string, ean string")
    rows = [(10, 1, "s1", "EUR", 5.0, "Acme Phone X200 blue", "12345678"), (11, None, "s2", "EUR", 4.0, "zzz", "1234 5678"), (12, 1, "s3", "SEK", 1.0, "Acme Phone X200 blue", ""), (13, 2, "s4", "EUR", 1.0, "Acme Phone X200 blue", ""), (14, 1, "s5", "", 6.0, "Acme Phone blue X200", "12345678")]
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    o = spark.createDataFrame(rows, "offer_id long, product_id long, store string, currency string, price double, title string, ean string").withColumns({"brand": F.lit("acme"), "shipping": F.lit(0.0)})
    o = o.mapInPandas(read, o.schema)
    got = {(r.query_id, r.product_id, r.offer_id, r.match_score, r.match_rank, r.store) for r in matching.compare_canonical(q, p, o, carry=("store",)).collect()}
    assert reads.value == len(rows)
    own = {k: [(x, s) for x, s in ((10, "s1"), (14, "s5")) if k % 3 or s != "s1"] for k in range(12)}
    assert got == {(k, 1, x, 80, n, s) for k, xs in own.items() for n, (x, s) in enumerate(xs, 1)}


def test_equal_queries_are_ranked_once_in_the_fallback(spark):
    q = spark.range(40).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "s1").alias("store"), F.lit("Acme Phone X200 blue").alias("title"), F.lit("acme").alias("brand"))
    o = spark.range(50).select(F.col("id").alias("offer_id"), F.when(F.col("id") % 5 == 0, "s1").when(F.col("id") % 5 == 1, "").otherwise("s2").alias("store"), F.lit("Phone Acme X200 blue").alias("title"), F.lit("").alias("brand"), (F.col("id") % 7).cast("double").alias("price"), F.lit(0.0).alias("shipping"))
    df = matching.compare_fallback(q, o)
    got = {(r.query_id, r.offer_id, r.match_score, r.match_reason, r.match_rank) for r in df.collect()}
    want = set()
    for k in range(40):
        fit = sorted((x % 7, x) for x in range(50) if (x % 5 != 0 if k % 2 == 0 else x % 5 != 1))
        want |= {(k, x, 80, "strong title overlap", n) for n, (_, x) in enumerate(fit, 1)}
    assert got == want
    # the window runs over the two kinds of queries, not over the forty queries
    assert "windowspecdefinition(q_kind" in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_a_block_of_queries_gets_its_offers_once_in_the_fallback(spark, monkeypatch, broadcast):
    monkeypatch.setattr(matching, "BLOCK", 7, raising=False)
    monkeypatch.setattr(matching, "TASK_ROWS", 30, raising=False)
    number, store = F.when(F.col("id") % 20 != 3, F.col("id")), lambda n: F.when(F.col("id") % n != 0, F.concat(F.lit("s"), (F.col("id") % n).cast("string")))
    q = spark.range(60).select(number.alias("query_id"), store(9).alias("store"), F.lit("Acme Phone X200 blue").alias("title"), F.lit("acme").alias("brand"))
    o = spark.range(30).select(F.col("id").alias("offer_id"), store(4).alias("store"), F.lit("Phone Acme X200 blue").alias("title"), F.lit("").alias("brand"), (F.col("id") % 7).cast("double").alias("price"), F.lit(0.0).alias("shipping"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = matching.compare_fallback(q, o)
        got = Counter((r.query_id, r.offer_id, r.match_rank) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = Counter()
    for k in range(60):
        fit = sorted((x % 7, x) for x in range(30) if x % 4 != k % 9)
        want.update((None if k % 20 == 3 else k, x, n) for n, (_, x) in enumerate(fit, 1))
    assert got == want
    assert "hashpartitioning(q_kind" not in plan  # rows of each store's ranks are not dealt
    # 1800 rows at most, 30 of each query; offers come as lists of 7 at most
    assert set(re.findall(r"hashpartitioning\(deal#\d+L?, (\d+)\), REPARTITION", plan)) == {"61"}


def test_pages_of_selectors_are_read_by_many_tasks(spark):
    from offerloom.plans import stored_offers

    for name in ("browser_selectors", "store_selectors"):
        assert getattr(stored_offers, name)(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 12


def test_product_pages_are_read_by_many_tasks_and_prices_are_parsed_once(spark):
    from offerloom.operators import extract
    from offerloom.plans import catalogue

    for json_ld in (True, False):
        assert catalogue.product_pages(spark, "/root/testdata/sf0.001", json_ld).rdd.getNumPartitions() >= 12
    pages = spark.createDataFrame([("jimms.fi", "u", "<h1>a</h1><p class=price>1 299,50 €</p>")], "store string, url string, html string")
    df = extract.product_records(pages)
    assert df.first().product.total == 1299.5
    plan = df.select("product.total", "product.price", "product.currency")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[.,\\s]\\d{3}") <= 2  # of the price and of the shipping


def test_intervals_of_few_a_key_need_no_bins(spark):
    from offerloom.operators import temporal

    i = spark.range(90).select(F.when(F.col("id") < 60, 1).when(F.col("id") < 88, F.col("id") % 7 + 2).alias("k"), (F.col("id") * 3 % 50).cast("double").alias("s"), F.when(F.col("id") % 4 > 0, F.col("id") * 3 % 50 + F.col("id") % 9).cast("double").alias("e"))
    p = spark.range(200).select((F.col("id") % 10).cast("int").alias("k"), F.col("id").alias("p"), F.when(F.col("id") != 11, F.col("id") % 60).cast("double").alias("t"))
    found = lambda df: sorted((r.k, r.p, r.t, r.s, -1 if r.e is None else r.e) for r in df.collect())
    want = found(p.join(i, "k").where("t >= s and (e is null or t < e)"))
    few, some, none = (temporal.interval_join(i, p, "s", "e", "t", by="k", width=1.0, few=n) for n in (128, 10, 0))
    assert found(few) == found(some) == found(none) == want and want
    assert "explode" not in few._jdf.queryExecution().optimizedPlan().toString()  # a row of points for each level before


def test_exact_quantiles_are_no_part_of_the_distinct_count(spark):
    from offerloom.plans import analytics

    plan = analytics.price_sketches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    together = [line for line in plan.splitlines() if "Aggregate" in line and "percentile(" in line and "distinct" in line.lower()]
    assert plan.count("percentile(") and not together
    assert "o_orderkey" not in plan and "c_custkey" not in plan  # the joined sales are read, not joined again


def test_batches_of_a_stream_are_written_by_many_tasks(spark):
    from offerloom.plans import events

    days = [1] * 100 + [9] * 3 + [17] * 41 + [25] * 90  # the second batch has fewer rows than the first has files
    e = spark.createDataFrame([(i, f"2024-01-{d:02d} 00:00:00") for i, d in enumerate(days)], "event_id long, at string").withColumn("ts", F.col("at").cast("timestamp")).repartition(3)
    for per_file in (10, 1000):
        root, stream = events.in_batches(spark, e, events.batch_of("ts"), per_file)
        assert len(spark.read.parquet(f"{root}/events").inputFiles()) == (events.BATCHES + 2) * max(1, 100 // per_file)
        got = {}
        stream().writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(lambda b, n: got.update({n: sorted(r.event_id for r in b.collect())})).start().awaitTermination()
        want = [[i for i, d in enumerate(days) if (d - 1) // 8 == k] for k in range(4)]
        assert [got[k] for k in sorted(got)] == [*want, [], []]


def test_freshness_asks_little_of_the_state(spark, tmp_path):
    from offerloom.streaming import due

    class Handle:
        def __init__(self):
            self.kept, self.timers, self.calls = None, set(), 0

        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            def call(*given):
                self.calls += 1
                if name == "get":
                    return self.kept
                if name in ("update", "clear"):
                    self.kept = given[0] if given else None
                else:
                    {"registerTimer": self.timers.add, "deleteTimer": self.timers.remove}[name](*given)

            return call

    handle, step = Handle(), due.Freshness(10_000)
    step.init(handle)
    tell = lambda *rows: [tuple(r)[1:] for r in step.handleInputRows((7,), iter([due.Row(us=us, attempt_id=k, ok=ok) for k, (us, ok) in enumerate(rows)]), None)]
    assert tell((2_500, True), (1_000, False)) == [(1_000, "failed"), (2_500, "fetched")] and handle.kept == (2_500,) and handle.timers == {13}
    assert handle.calls == 3
    assert tell((2_000, False)) == [(2_000, "failed")] and handle.calls == 4  # older than the success: nothing is written
    assert tell((None, True), (12_500, False)) == [(None, "fetched"), (12_500, "expired"), (12_500, "failed")] and handle.kept is None and not handle.timers
    assert tell((20_000, False)) == [(20_000, "failed")] and handle.calls == 8
    tell((30_000, True))
    assert [tuple(r)[1:] for r in step.handleExpiredTimer((7,), None, None)] == [(40_000, "expired")] and handle.kept is None


def test_only_pages_that_were_asked_for_are_told_apart(spark, monkeypatch):
    from offerloom.operators import refresh
    from offerloom.sources import snapshots

    url = lambda k: f"https://www.jimms.fi/fi/Product/Show/{k}/x"
    html = """<script type="application/ld+json">{"@type":"Product","name":"Acme X","offers":{"price":5}}</script>"""
    pages = spark.createDataFrame([(url(k), html, 200, "OK") for k in range(40)] * 2, "url string, html string, status int, status_text string")
    chosen = spark.createDataFrame([(None, "jimms.fi", url(k)) for k in (1, 2, 99)], "id long, store string, url string")
    plans = {}

    def stored(df, name, *a, **b):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name, *a, **b)

    kept = refresh.stored
    monkeypatch.setattr(refresh, "stored", stored)
    empty = [spark.createDataFrame([], s) for s in (snapshots.OFFERS, snapshots.RAW_PRODUCTS, snapshots.PRODUCTS)]
    done = refresh.refresh(*empty, chosen, pages, F.lit("2024-01-01").cast("timestamp"), unknown="insert")
    assert sorted((r.url, r.status) for r in done.results.collect()) == [(url(1), "refreshed"), (url(2), "refreshed"), (url(99), "failed")]
    assert "LeftSemi" in plans["refresh-judged"]


def test_a_refresh_stream_has_buckets_for_its_rows():
    from offerloom.plans import stored_offers

    assert [stored_offers.buckets_for(n) for n in (0, 20_000, 1_200_000, 7_200_000)] == [8, 8, 8, 36]


def test_pages_of_a_shop_are_read_by_many_tasks(spark):
    from offerloom.plans import catalogue

    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert catalogue.store_site(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= n
