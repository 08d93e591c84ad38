"""What must not grow faster than the input: evaluations of a source, columns read again, length of tasks."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from catalog.views import news, spread
from sectorpulse.operators.rankings import hot_list
from sectorpulse.operators.score import analyse
from sectorpulse.schema import repair
from sectorpulse.session import cut_lineage


def test_hot_list_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(times: pd.Series) -> pd.Series:
        seen.add(len(times))
        return times

    rows = [(i, "银行", f"{chr(0x4E00 + 50 * i)}{chr(0x5E00 + 70 * i)}公司公告{i}", "2026-07-05 11:00:00") for i in range(40)]
    raw = repair(spark.createDataFrame(rows, "row_id long, sector string, title string, publish_time string"))
    found, fallback = hot_list(
        analyse(raw.withColumn("publish_time", counted.asNondeterministic()("publish_time"))), ["银行"], "2026-07-05 12:00:00"
    )
    assert found.count() == 5 and not fallback
    assert seen.value == len(rows)


def test_cut_lineage_reads_only_asked_columns(spark):
    held = cut_lineage(spark.range(10).select("id", F.repeat(F.lit("x"), 100).alias("text")))
    plan = held.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    assert held.count() == 10


def test_tasks_grow_in_number_with_the_files(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    spark.range(200_000).select("id", F.rand(1).alias("value")).coalesce(1).write.parquet(folder)
    df = spark.read.parquet(folder)
    few, many = spread(df).rdd.getNumPartitions(), spread(df, 50_000).rdd.getNumPartitions()
    assert few == spark.sparkContext.defaultParallelism < many
    assert spread(df, 50_000).agg(F.sum("id"), F.count("id")).first() == (199_999 * 100_000, 200_000)


def test_news_moves_texts_once(spark, tmp_path):
    """One shuffle carries the texts, whatever the joins; repeated and missing ids keep their rows."""
    base = str(tmp_path)
    docs = [(i, f"t{i}\nbody", "en", "src1") for i in range(20)] + [(3, "again", "en", "src0"), (None, "none", "fr", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, f"http://x/{i}") for i in (0, 1, 1)], "page_id long, url string").write.parquet(f"{base}/pages.parquet")
    spark.createDataFrame([(30, "click"), (50, "view")], "event_id long, event_type string").withColumn(
        "ts", F.timestamp_seconds("event_id")
    ).write.parquet(f"{base}/events.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = news(spark, base)
        plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
        got = sorted((r["row_id"] if r["row_id"] is not None else -1, r["title"], r["link"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    above = [line for line, below in zip(plan, plan[1:]) if "Exchange" in line and "text#" in below]
    assert len(above) == 1
    expected = [(-1, "none", ""), (3, "again", "http://x/0")]
    for i in range(20):
        link = "" if i // 4 > 1 or i == 5 else f"http://x/{i // 4}"
        expected += [(i, f"t{i}", link)] * (2 if i // 4 == 1 else 1)
    assert got == sorted(expected)
