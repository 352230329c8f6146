import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscope.operators import ranking, taste
from folioscope.plans import bindings as b
from folioscope.streaming import streams


def test_posts_are_taken_once_over_batches(spark, tmp_path):
    landing, rows, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "url string, day date, landed timestamp"

    def land(urls, hour):
        spark.createDataFrame([(u, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1 + hour // 24, hour % 24)) for u in urls], schema).coalesce(1).write.mode("append").parquet(landing)

    land(["a", "b", "a"], 1)
    for batch, hour in ((["b", "c"], 2), (["a", "d"], 200)):
        streams.post_stream(spark.readStream.schema(schema).parquet(landing), rows, progress).awaitTermination()
        land(batch, hour)
    streams.post_stream(spark.readStream.schema(schema).parquet(landing), rows, progress).awaitTermination()
    got = streams.read_batches(spark, rows, spark.createDataFrame([], schema).schema)
    assert sorted(r.url for r in got.collect()) == ["a", "b", "c", "d"]


def test_engagement_stream_equals_batch(spark, sf, tmp_path):
    e = b.engagement(spark, sf)
    landing = str(tmp_path / "in")
    e.repartition(3).write.parquet(landing)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    rows = str(tmp_path / "out")
    streams.engagement_stream(stream, rows, str(tmp_path / "cp")).awaitTermination()
    batch = taste.engagement_rows(e)
    now = streams.engagement_now(spark, rows, batch.schema).select(*batch.columns)
    assert now.exceptAll(batch).isEmpty() and batch.exceptAll(now).isEmpty() and not batch.isEmpty()


def test_rolling_windows_stream_equals_batch(spark, tmp_path):
    items = spark.createDataFrame([("e", dt.datetime(2024, 1, d, h)) for d in (1, 2, 9) for h in (0, 5)], "edition string, published timestamp")
    landing, rows = str(tmp_path / "in"), str(tmp_path / "out")
    items.coalesce(1).write.parquet(landing)
    streams.news_stream(spark.readStream.schema(items.schema).parquet(landing), rows, str(tmp_path / "cp")).awaitTermination()
    batch = streams.rolling_news_windows(items)
    got = streams.latest_by(streams.read_batches(spark, rows, batch.schema), ["edition", "start"])
    assert {tuple(r) for r in got.select(*batch.columns).collect()} == {tuple(r) for r in batch.collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limits_run_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    assert plan_of(ranking.top_per_key(df, ["k"], [F.desc("id")], 5)).count("WindowGroupLimit") == 2


def test_sql_checked_queries_stay_in_the_jvm(spark, sf):
    queries = entry.queries()
    for name in ("words", "library_counts", "eligible_posts", "build_postings", "classify_titles", "key_sentences", "taste_profile", "merge_news", "apply_actions"):
        plan = plan_of(queries[name](spark, sf))
        assert "EvalPython" not in plan and "MapInPandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_only_what_is_used(spark, sf):
    plan = entry.queries()["library_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan
    filtered = plan_of(entry.queries()["day_range"](spark, sf))
    assert "html" not in filtered.split("ReadSchema", 1)[1]


def test_entry_and_registry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "rank", "post_id", "url", "score"] and rows.count() >= 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
