import random

from tessera.llm import mixture

SIZES = "doc_id bigint, source string, tokens bigint"
TARGETS = "source string, target_share double, max_repeats int, tokens bigint"


def sizes(spark, rng, **n):
    rows, k = [], 0
    for source, count in n.items():
        for _ in range(count):
            rows.append((k, source, rng.choice([0, 5, rng.randrange(2000)])))
            k += 1
    return rows, spark.createDataFrame(rows, SIZES)


def test_flight_keeps_totals_and_settles_all_but_two():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400):
        units = [[0.37, float(rng.randrange(1000))] for _ in range(n)]
        count, tokens = 0.37 * n, sum(0.37 * u[1] for u in units)
        mixture.fly(units, rng, land=False)
        assert sum(0 < u[0] < 1 for u in units) <= 2
        assert abs(sum(u[0] for u in units) - count) < 1e-6 and abs(sum(u[0] * u[1] for u in units) - tokens) < 1e-3 * max(1, tokens)
        mixture.fly(units, rng, land=True)
        assert all(u[0] in (0.0, 1.0) for u in units)


def test_inclusion_is_unbiased():
    hits = [0] * 5
    for seed in range(4000):
        units = [[0.4, t, k] for k, t in enumerate((1.0, 100.0, 3.0, 40.0, 7.0))]
        mixture.fly(units, random.Random(seed), land=True)
        for u in units:
            hits[u[2]] += u[0]
    assert all(abs(h / 4000 - 0.4) < 0.04 for h in hits)


def test_equal_sizes_do_not_stall():
    units = [[0.5, 7.0] for _ in range(99)]
    mixture.fly(units, random.Random(0), land=True)
    assert 49 <= sum(u[0] for u in units) <= 50


def test_mixture_reaches_its_plan(spark):
    rng = random.Random(2)
    rows, df = sizes(spark, rng, a=900, b=300, c=40, other=100)
    df = df.unionByName(spark.createDataFrame([(10**6, None, 5000)], SIZES))
    targets = spark.createDataFrame([("a", 0.3, 2, 1), ("b", 0.4, 3, 1), ("c", 0.3, 2, 1), ("none", 0.1, 9, 1), (None, 0.5, 1, 1)], TARGETS)
    planned = mixture.plan(df, targets)
    mixed = mixture.mix(df, planned, seed=7, chunk_docs=50)
    again = mixture.mix(df, planned, seed=7, chunk_docs=50)
    got = {r.doc_id: r for r in mixed.collect()}
    assert {k: r.copies for k, r in got.items()} == {r.doc_id: r.copies for r in again.collect()}
    total = sum(t for *_, t in rows) + 5000
    by = {s: [t for _, x, t in rows if x == s] for s in "abc"}
    report = {r.source: r for r in mixture.report(planned, mixed).collect()}
    assert set(report) == {"a", "b", "c", "none"} and len(got) == 1240
    for s, share, most in (("a", 0.3, 2), ("b", 0.4, 3), ("c", 0.3, 2)):
        r, can = report[s], sum(by[s]) * most
        assert r.reachable == (can >= share * total) and r.most_used <= most
        want = min(share * total, can)
        assert abs(r.mixture_tokens - want) <= 2 * max(by[s])
        rate = want / sum(by[s])
        assert abs(r.mixture_copies - rate * len(by[s])) <= 2
        assert all(int(rate) <= x.copies <= int(rate) + 1 for x in got.values() if x.source == s)
    assert report["none"].reachable is False and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_empty_tables(spark):
    none, targets = spark.createDataFrame([], SIZES), spark.createDataFrame([("a", 0.5, 2, 1)], TARGETS)
    planned = mixture.plan(none, targets)
    r = mixture.report(planned, mixture.mix(none, planned)).first()
    assert (r.mixture_tokens, r.reachable, r.actual_share) == (0, True, 0.0)
    assert mixture.plan(none, targets.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "a"), (2, None, "a"), (3, "", None)], "doc_id bigint, text string, source string")
    mixed, report = mixture.mixture(docs, targets)
    assert report.first().available_tokens == 3 and mixed.count() == 2


def test_chunks_fly_together_before_they_land(spark, monkeypatch):
    monkeypatch.setattr(mixture, "CHUNKS_TOGETHER", 4)
    rng = random.Random(5)
    rows, df = sizes(spark, rng, a=1200, b=200)
    planned = mixture.plan(df, spark.createDataFrame([("a", 0.37, 1, 1), ("b", 0.2, 9, 1)], TARGETS))
    mixed = mixture.mix(df, planned, chunk_docs=20)
    assert mixed.count() == 1400
    report = {r.source: r for r in mixture.report(planned, mixed).collect()}
    for s in "ab":
        assert abs(report[s].mixture_tokens - report[s].target_tokens) <= 2 * 2000


def test_what_cannot_be_reached_is_read_off_the_mixture(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30), (4, "c", 0), (5, None, 40), (6, "d", 25)], SIZES)
    targets = [("a", 0.8, 3, 1), ("b", 0.6, 2, 1), ("c", 0.1, 5, 1), ("d", 0.4, 2, 1), ("none", 0.0, 1, 1), ("gone", 0.2, 1, 1)]  # of 125 tokens
    planned = mixture.plan(df, spark.createDataFrame(targets, TARGETS))
    got = {r.source: r.reachable for r in mixture.report(planned, mixture.mix(df, planned)).collect()}
    assert got == {"a": False, "b": False, "c": False, "d": True, "none": True, "gone": False}


def test_found_comes_from_the_report(spark, tmp_path):
    from tessera.llm import plans

    docs = spark.createDataFrame([(1, "a b c", "a"), (1, "a b c", "a"), (None, "d e", "b"), (2, None, "a"), (3, "", None)], "doc_id bigint, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 0.5, 2), ("b", 0.9, 2)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    found = plans.p9_found(spark, str(tmp_path))
    assert [r.source for r in found.collect()] == ["b"]  # 2 of 8 tokens, twice
    assert "flights" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.source: r.available_tokens for r in plans.p9_report(spark, str(tmp_path)).collect()} == {"a": 6, "b": 2}


def test_texts_take_no_direct_buffer_of_their_row_group(spark, tmp_path, monkeypatch):
    """Vectored reads hold a row group's column twice: as one array, and in a direct buffer that its thread keeps."""
    from pyspark.sql import functions as F

    from tessera.llm import plans

    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(32_000)), lambda i: F.sha2((F.col("id") * 100_000 + i).cast("string"), 256)))
    spark.range(0, 16, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("a").alias("source")).write.option("compression", "none").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 2.0, 1), ("b", 0.0, 1)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    monkeypatch.setattr(mixture, "sized", lambda d: d.select("doc_id", "source", F.length("text").cast("bigint").alias("tokens")))
    jvm = spark._jvm
    pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
    direct = next(p for p in pools if p.getName() == "direct")
    for query in (plans.p9_found, plans.p9_plan):
        before = direct.getMemoryUsed()
        assert [(r.source, r.asDict().get("available_tokens", 16 * 32_000 * 64)) for r in query(spark, str(tmp_path)).collect() if r.source == "a"] == [("a", 16 * 32_000 * 64)]
        assert direct.getMemoryUsed() - before < 16 << 20
