"""First start, failures of an ingest, verifiers of all kinds, counts with verdicts, reports in the history."""

import pytest
from pyspark.sql import functions as F

from sectorpulse.operators import classify, rankings, refilter, score, verdicts
from sectorpulse.plans import refresh
from sectorpulse.rules.tables import Sector
from sectorpulse.sources import news as stored
from test_golden import EVENTS, NOW, event, ids, news

RAW = "row_id long, title string, source string, publish_time string, link string, keyword string, content string"


def test_first_start_is_empty_and_a_broken_table_raises(spark, tmp_path):
    never = stored.read_or_start(spark, str(tmp_path / "never"))
    assert never.isEmpty() and never.columns == stored.read_or_start(spark, str(tmp_path / "n"), stored.read_csv).columns
    news(spark, {"title": "x"}).write.parquet(str(tmp_path / "t"))
    assert [r["title"] for r in stored.read_or_start(spark, str(tmp_path / "t")).collect()] == ["x"]
    (tmp_path / "empty").mkdir()
    assert stored.read_or_start(spark, str(tmp_path / "empty")).isEmpty()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_bytes(b"no parquet file at all")
    with pytest.raises(Exception):
        stored.read_or_start(spark, str(tmp_path / "broken")).count()


def test_ingest_reports_what_failed(spark):
    config = refresh.Config(sectors=[Sector("A", ["a", "b"]), Sector("B", ["b"]), Sector("C", ["c"])], events=EVENTS)
    raw = spark.createDataFrame([(0, "t", "s", "", "http://a/1", "a", "")], RAW)
    failed = spark.createDataFrame([("b",), ("b",)], "keyword string")
    done = refresh.ingest_checked(raw, failed, config, NOW)
    sectors = {r["name"]: (r["keywords"], r["failed"], r["outcome"]) for r in done.outcomes.collect() if r["scope"] == "sector"}
    assert sectors == {"A": (2, 1, "warning"), "B": (1, 1, "error"), "C": (1, 0, "ok")}
    assert [r["sector"] for r in done.rows.collect()] == ["A"]
    all_words = {k for s in config.sectors for k in s.keywords} | {k for ks in EVENTS.keywords().values() for k in ks}
    everything = spark.createDataFrame([(k,) for k in all_words], "keyword string")
    with pytest.raises(refresh.IngestError):
        refresh.ingest_checked(raw.limit(0), everything, config, NOW)


def versioned():
    class Versioned:
        """A class of a function travels to the workers by value."""

        provider, model, prompt_version, rule_version = "p", "m", "2", "3"

        def verify(self, item, category, evidence):
            return {"shouldKeep": True, "category": category, "confidence": 1, "reason": str(evidence["score"])}

    return Versioned()


def _judged(spark):
    df = news(
        spark, event("GPU 需求增长", event_category="AI产业链"), event("美元 利率走势分化", event_category="美联储/利率"),
        event("美联储降息", event_category="美联储/利率"), event("whatever", event_category="gone"),
    )
    return df, classify.classify(df, EVENTS, F.col("event_category"))


def test_verifiers_of_two_and_three_arguments_and_objects(spark):
    pending = verdicts.requests(_judged(spark)[1])

    def bare(item, category):
        return {"shouldKeep": "GPU" in item["title"], "category": category, "confidence": 1, "reason": ""}

    def full(item, category, evidence):
        return bare(item, category)

    def answers(verifier):
        return sorted(map(tuple, verdicts.run_verifier(pending, verifier).collect()))

    assert answers(bare) == answers(full) and all(r[2] is None for r in answers(bare))
    assert len(answers(versioned())) == pending.count() > 0


def test_versions_of_a_verifier_reach_the_key(spark):
    judged = _judged(spark)[1]
    versions = verdicts.versions_of(versioned())
    assert versions == {"provider": "p", "model": "m", "prompt_version": "2", "rule_version": "3"}
    assert verdicts.versions_of(lambda item, category: None) == {}
    plain, own = verdicts.requests(judged), verdicts.requests(judged, **versions)
    assert plain.join(own, "validation_key").isEmpty() and plain.count() == own.count()
    answered = verdicts.run_verifier(own, versioned())
    assert verdicts.requests(judged, answered, **versions).isEmpty()
    assert verdicts.requests(judged, answered).count() == plain.count()


@pytest.mark.parametrize("keep", [True, False])
def test_counts_agree_with_the_filter(spark, keep):
    df, judged = _judged(spark)
    df = df.unionByName(news(spark, {"sector": "x", "title": "t"}).withColumn("row_id", F.lit(9).cast("long")))

    def verify(item, category):
        return {"shouldKeep": keep, "category": category, "confidence": 1, "reason": ""}

    answers = verdicts.run_verifier(verdicts.requests(judged), verify)
    for given in (None, answers):
        kept = set(ids(refilter.refilter(df, EVENTS, verdicts=given)))
        counts = {r["name"]: (r["kept"], r["dropped"]) for r in refilter.refilter_counts(df, EVENTS, verdicts=given).collect()}
        names = {r["row_id"]: r["event_category"] or r["sector"] for r in df.collect()}
        wanted = {n: (sum(k in kept for k in names if names[k] == n), sum(k not in kept for k in names if names[k] == n)) for n in names.values()}
        assert counts == wanted


def test_a_reported_story_is_no_alert(spark):
    rows = score.analyse(news(
        spark, {"title": "央行发布新政策", "link": "http://a"}, {"title": "国务院印发规划", "link": "http://d"},
    ))
    empty = spark.createDataFrame([], "seq long, link_hash string")
    assert sorted(ids(rankings.alert_batch(rows, empty, NOW))) == [0, 1]
    report, history = rankings.report_and_history(rows, empty, NOW)
    assert sorted(ids(report)) == [0, 1] and history.count() == 2
    assert ids(rankings.alert_batch(rows, history, NOW)) == []
    assert len({r["seq"] for r in history.collect()}) == 2
