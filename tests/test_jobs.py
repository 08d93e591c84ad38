"""Sources, sinks, refresh jobs and streaming."""

import tempfile

import pytest
from pyspark.sql import functions as F

from sectorpulse import schema
from sectorpulse.operators import aggregates, dedupe
from sectorpulse.operators.similar import SAME_STORY
from sectorpulse.plans import refresh
from sectorpulse.plans.display import display
from sectorpulse.sinks.snapshot import SnapshotFolder
from sectorpulse.sources import feeds, news as stored, search
from sectorpulse.streaming import ingest
from test_golden import NOW, event, news


def folder():
    return tempfile.mkdtemp(prefix="sectorpulse-test-")


def texts(df):
    return sorted((r["sector"], r["title"]) for r in df.collect())


def test_csv_round_trip(spark):
    path = folder() + "/t"
    df = news(spark, {"title": 'a "quoted", line\nbreak', "content": ""}, {"title": "x", "news_type": ""}).drop("row_id")
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    back = stored.read_csv(spark, path)
    assert sorted(r["title"] for r in back.collect()) == ['a "quoted", line\nbreak', "x"]
    assert {r["news_type"] for r in back.collect()} == {"sector_news"}
    with pytest.raises(Exception):
        stored.read_csv(spark, path + "-missing").count()


def test_search_frame_needs_title_and_link(spark):
    with pytest.raises(ValueError):
        search.search_rows(spark.createDataFrame([("t",)], "title string"), F.lit("k"))


def test_keywords_of_any_number(spark):
    rows = [("Apple 产业链", "GPU"), ("App", "le"), (None, "gpu")]
    df = spark.createDataFrame(rows, "title string, content string")
    few = sorted(map(str, feeds.match_keywords(df, ["apple", "gpu", "GPU", "链"]).collect()))
    many = feeds.match_keywords(df, ["apple", "gpu", "GPU", "链", *(f"none{k}" for k in range(700))])
    assert sorted(map(str, many.collect())) == few and len(few) == 4


def test_fingerprint_sees_every_column_and_equal_rows(spark):
    def sums(*rows):
        return aggregates.fingerprint(news(spark, *rows)).first()["content_hash"]

    base = sums({"title": "a"}, {"title": "b"})
    assert base == sums({"title": "b"}, {"title": "a"})
    assert len({base, sums({"title": "a", "reason": "r"}, {"title": "b"}), sums({"title": "a", "source": "s"}, {"title": "b"})}) == 3
    assert sums({"title": "a"}, {"title": "a"}) != sums({"title": "b"}, {"title": "b"})


def test_full_refresh_keeps_fragments(spark):
    rows = [{"title": f"第{k}条 快讯 {k}", "link": f"http://feed#{k}", "publish_time": "2026-07-05 10:00:00"} for k in range(3)]
    fetched = news(spark, *rows)
    for keep, n in ((True, 3), (False, 1)):
        kept = dedupe.dedupe_news(fetched, False, keep_fragment=keep)
        assert kept.count() == n


def test_snapshot_versions(spark):
    store = SnapshotFolder(spark, folder() + "/news")
    assert store.current() is None
    assert store.publish(news(spark, {"title": "a"}), "001")
    assert not store.publish(news(spark, {"title": "b"}), "001")
    assert store.current().first()["title"] == "a"
    store.clear("002", store.current())
    assert store.current().count() == 0 and store.current(before="002").count() == 1


def test_full_refresh_refuses_an_empty_fetch(spark):
    with pytest.raises(ValueError):
        refresh.full_refresh(news(spark, {}).limit(0), refresh.Config(), NOW)


def test_ingest_scopes_and_annotates(spark):
    raw = spark.createDataFrame(
        [(0, "英伟达 GPU 大模型", "s", "2026-07-05 10:00:00", "http://a/1", "大模型", ""),
         (1, "英伟达 GPU 大模型", "s", "2026-07-05 09:00:00", "http://a/2", "GPU", ""),
         (2, "与规则无关", "s", "", "http://a/3", "GPU", "")],
        "row_id long, title string, source string, publish_time string, link string, keyword string, content string",
    )
    rows = refresh.ingest(raw, refresh.Config(), "2026-07-05T00:00:00Z").collect()
    assert {(r["sector"], r["event_category"]) for r in rows} == {("人工智能", ""), ("", "AI产业链")}
    related = next(r for r in rows if r["event_category"])
    assert related["related_sectors"] == "人工智能、算力数据中心、半导体芯片" and "AI产业链" in related["reason"]


def test_display_plan(spark):
    table = news(spark, {"sector": "s", "title": "同一条新闻标题"}, {"sector": "s", "title": "同一条新闻标题！"}, event("x"))
    shown = display(table, refresh.Config())
    assert texts(shown.rows) == [("s", "同一条新闻标题")]
    assert shown.metadata.first()["total"] == 2


BATCHES = [
    [{"sector": "s", "title": "第一条新闻标题在此", "link": "http://e/1"}, {"sector": "s", "title": "第二条完全不同的消息", "link": "http://e/2"}],
    [{"sector": "s", "title": "第一条新闻标题在此", "link": "http://e/9"}, {"sector": "t", "title": "央行宣布新政策", "link": "http://e/3"}],
    [{"sector": "s", "title": "迟到的旧消息仍要收", "link": "http://e/4", "publish_time": "2026-07-01 08:00:00"},
     {"sector": "s", "title": "太旧", "link": "http://e/5", "publish_time": "2026-05-01 08:00:00"}],
]


def test_stream_equals_fold_of_batches(spark):
    base = folder()
    config = refresh.Config()
    expected = None
    for i, rows in enumerate(BATCHES):
        frame = news(spark, *rows)
        frame.select(*schema.NEWS_COLUMNS).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        held = frame.limit(0) if expected is None else expected
        expected = refresh.incremental_refresh(held, ingest.with_batch_ids(frame), config, NOW).table
    store = SnapshotFolder(spark, f"{base}/news")
    history, outbox = SnapshotFolder(spark, f"{base}/history"), SnapshotFolder(spark, f"{base}/outbox")
    after = ingest.alerts(history, outbox, lambda _: NOW)
    body = ingest.refresh_batch(store, config, lambda _: NOW, after=after)
    stream = ingest.landing_stream(spark, f"{base}/landing")
    ingest.start_refresh(stream, body, f"{base}/state").start().awaitTermination()
    assert len(store.versions()) == 3
    assert texts(store.current()) == texts(expected) and len(texts(expected)) == 4
    assert history.current().count() == 1
    # A replayed batch finds its version and changes nothing.
    body(news(spark, {"sector": "z", "title": "重放"}).drop("row_id"), 2)
    assert texts(store.current()) == texts(expected)


def test_bounded_link_stream(spark):
    base = folder()
    rows = news(spark, {"link": "http://e/1?a"}, {"link": "http://e/1/"}, {"link": "", "title": "x"}, {"link": "", "title": "y"})
    timed = rows.withColumn("ts", F.to_timestamp("publish_time")).drop("row_id")
    timed.coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(timed.schema).parquet(f"{base}/in")
    out = ingest.unseen_links(stream, "ts")
    query = out.writeStream.format("memory").queryName("links").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("links").count() == 3


def test_defaults_are_the_story_threshold():
    assert SAME_STORY.ratio == 0.88
