"""The stored table: date partitions, delta merge, replays; against the merge of everything."""

import random
import tempfile
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sectorpulse.functions.text import title_key
from sectorpulse.operators import filters, increments, rankings
from sectorpulse.operators.score import analyse
from sectorpulse.operators.similar import may_resemble
from sectorpulse.plans import refresh
from sectorpulse.plans.refresh import Config, delta_refresh, incremental_refresh, load_table
from sectorpulse.rules.defaults import TITLE_RATIO
from sectorpulse.schema import NEWS_COLUMNS, ROW_ID
from sectorpulse.sinks.table import NewsTable
from sectorpulse.streaming.ingest import HISTORY_SCHEMA

AS_OF = "2026-07-20 12:00:00"
SCHEMA = "row_id long, " + ", ".join(f"{c} string" for c in NEWS_COLUMNS)


def story(rng, row_id):
    """Rows that collide by link, content, title or a nearly equal title; some without a time or without any key."""
    day = rng.randrange(1, 31)
    when = rng.choice([f"2026-07-{day:02} {rng.randrange(24):02}:00:00"] * 5 + [f"2026/06/{day:02} 08:00:00", "", "昨天"])
    title = rng.choice(["", "芯片出口管制再度升级引发市场关注", "央行宣布下调存款准备金率零点五个百分点", "国际油价大幅上涨创年内新高"])
    if title and rng.random() < 0.7:
        at = rng.randrange(len(title))
        title = title[:at] + rng.choice("甲乙丙丁") + title[at + 1 :]
    event = rng.random() < 0.2
    return (
        row_id, "external_event" if event else "sector_news", "" if event else rng.choice(["A", "B"]), title, "s", when,
        rng.choice(["", f"http://x.com/{rng.randrange(12)}"]), "k", rng.choice(["", f"内容{rng.randrange(12)}", f"长篇 {row_id}"]),
        "", "", "", rng.choice(["", "2026-07-19T00:00:00Z", "2026-01-01T00:00:00Z"]),
    )


def config(fuzzy):
    return Config(sectors=[], fuzzy=fuzzy)


def rows_of(df):
    """Without row ids: a batch that is given again gets new ones."""
    return sorted(tuple(r) for r in df.select(*NEWS_COLUMNS).collect())


@pytest.fixture
def table(spark):
    return NewsTable(spark, tempfile.mkdtemp() + "/news")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("fuzzy", [False, True])
def test_chains_of_batches_give_the_merge_of_everything(spark, table, fuzzy, monkeypatch):
    rng = random.Random(11 + fuzzy)
    setup = config(fuzzy)
    # Rules of their own would drop most of these rows.
    monkeypatch.setattr(Config, "refilter", lambda self, df: df)
    first = frame(spark, [story(rng, k) for k in range(60)])
    load_table(table, first, setup)
    expected = refresh.dedupe_news(first, fuzzy)
    assert rows_of(table.read()) == rows_of(expected)
    for batch in range(2):
        fetched = frame(spark, [story(rng, k) for k in range(rng.randrange(1, 25))])
        want = incremental_refresh(refresh.cut_lineage(expected), fetched, setup, AS_OF, 15)
        counts = want.counts.first()
        expected = refresh.cut_lineage(want.table)
        got = delta_refresh(table, fetched, setup, AS_OF, 15, batch=batch)
        assert rows_of(table.read()) == rows_of(expected), batch
        assert (got.added, got.pruned, got.total) == tuple(counts), batch
        # The same batch again changes nothing.
        again = delta_refresh(table, fetched, setup, AS_OF, 15, batch=batch)
        assert again.total == got.total
        assert rows_of(table.read()) == rows_of(expected)


def test_only_changed_dates_are_written_and_empty_ones_go(spark, table, monkeypatch):
    monkeypatch.setattr(Config, "refilter", lambda self, df: df)

    def row(k, day, link="", fetched="2026-07-19T00:00:00Z"):
        when = f"2026-07-{day:02} 10:00:00" if day else ""
        return (k, "sector_news", "A", f"第{k}条", "s", when, link, "k", f"正文{k}", "", "", "", fetched)

    load_table(table, frame(spark, [row(1, 8, "http://x/1"), row(2, 9), row(3, 10), row(4, 0), row(5, 1)]), config(False))

    def files():
        return {p.parent.name: p.name for p in Path(table.rows).rglob("*.parquet")}

    before = files()
    assert len(before) == 5
    # A new row of day 12; a newer report of the link of day 8, which empties that day; day 1 runs out.
    fetched = [row(0, 12), row(1, 11, "http://x/1")]
    change = delta_refresh(table, frame(spark, fetched), config(False), AS_OF, 15)
    after = files()
    assert {str(d) for d in change.dates} == {"2026-07-12"}, "the stored link is known: its new report is dropped"
    assert "publish_date=2026-07-01" not in after and {k: before[k] for k in after if k in before} == {k: after[k] for k in after if k in before}
    # By content the newer row takes the older one's place.
    newer = row(9, 13)[:8] + ("正文1",) + row(9, 13)[9:]
    change = delta_refresh(table, frame(spark, [newer]), config(False), AS_OF, 15)
    assert {str(d) for d in change.dates} == {"2026-07-08", "2026-07-13"}
    assert "publish_date=2026-07-08" not in files() and files()["publish_date=2026-07-09"] == before["publish_date=2026-07-09"]


def test_other_rules_filter_the_whole_table(spark, table, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(Config, "refilter", lambda self, df: df)
    load_table(table, frame(spark, [story(rng, k) for k in range(20)]), config(False))
    monkeypatch.setattr(Config, "refilter", lambda self, df: df.filter("sector = 'A'"))
    delta_refresh(table, frame(spark, []), Config(sectors=[], fuzzy=False, mapping={}), AS_OF, 0)
    assert {r["sector"] for r in table.read().collect()} == {"A"}


def test_missing_table_and_empty_batches(spark, table):
    assert table.read().count() == 0
    change = delta_refresh(table, frame(spark, []), config(True), AS_OF)
    assert (change.added, change.pruned, change.total, change.dates) == (0, 0, 0, frozenset())
    load_table(table, frame(spark, []), config(True))
    assert table.read().count() == 0


def partition_filters(df):
    # ``explain`` has the filters that reach the scan's choice of folders.
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.replace("PartitionFilters", "\nPartitionFilters").split("\n") if line.startswith("PartitionFilters: [") and not line.startswith("PartitionFilters: []")]


def test_time_filters_choose_partitions(spark, table, monkeypatch):
    monkeypatch.setattr(Config, "refilter", lambda self, df: df)
    rng = random.Random(3)
    load_table(table, frame(spark, [story(rng, k) for k in range(60)]), config(False))
    stored = table.read()
    scored = analyse(stored)
    history = spark.createDataFrame([], HISTORY_SCHEMA)
    plans = {
        "range": filters.in_time_range(stored, filters.THREE_DAYS, AS_OF),
        "retention": filters.prune(stored, 10, AS_OF),
        "today": filters.of_today(stored, AS_OF),
        "push": filters.push_worthy(scored, AS_OF),
        "hot": rankings.hot_candidates(scored, ["A"], AS_OF),
        "alerts": rankings.alert_batch(scored, history, AS_OF),
        "report": filters.last_day(scored, AS_OF).filter(filters.in_last_hours(AS_OF)),
        "digest": rankings.digest_input(scored, ["A", "B"], AS_OF),
    }
    for name, df in plans.items():
        assert partition_filters(df), name
    plain = stored.drop("publish_date")
    for name, time_filter in {
        "range": lambda df: filters.in_time_range(df, filters.THREE_DAYS, AS_OF),
        "retention": lambda df: filters.prune(df, 10, AS_OF),
        "today": lambda df: filters.of_today(df, AS_OF),
        "hot": lambda df: rankings.hot_candidates(analyse(df), ["A"], AS_OF),
    }.items():
        assert rows_of(time_filter(stored)) == rows_of(time_filter(plain)), name


def test_stored_rows_are_not_shuffled(spark, table, monkeypatch):
    from sectorpulse.operators import delta

    monkeypatch.setattr(Config, "refilter", lambda self, df: df)
    rng = random.Random(8)
    load_table(table, frame(spark, [story(rng, k) for k in range(40)]), config(True))
    new = delta.with_keys(frame(spark, [story(rng, k) for k in range(100, 103)]))
    keys = delta._small(new.select(F.explode("keys").alias("key")).distinct(), delta.BROADCAST_KEYS)
    met = table.read().select(ROW_ID, F.explode("keys").alias("key")).join(keys, "key", "left_semi")
    alike = delta._resembling(table.read(), new)
    for df in (met, alike):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_no_similar_title_is_missed(spark):
    rng = random.Random(1)
    letters = "甲乙丙丁戊"
    titles = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 16))) for _ in range(250)]
    new, old = titles[:100], titles[100:] + [t[:-1] + "己" for t in titles[:50]]
    test = may_resemble([("p", t) for t in new])
    for t in old:
        if any(len(t) > 1 and SequenceMatcher(None, x, t).ratio() >= TITLE_RATIO and x != t for x in new):
            assert test("p", t), t
        assert not test("q", t)


def test_a_batch_of_many_titles_takes_the_way_of_the_whole_table(spark, table, monkeypatch):
    from sectorpulse.operators import delta

    monkeypatch.setattr(Config, "refilter", lambda self, df: df)
    monkeypatch.setattr(delta, "BATCH_TITLES", 1)
    monkeypatch.setattr(delta, "BROADCAST_KEYS", 1)
    rng = random.Random(21)
    first, fetched = (frame(spark, [story(rng, k) for k in range(n)]) for n in (30, 12))
    load_table(table, first, config(True))
    want = incremental_refresh(refresh.dedupe_news(first), fetched, config(True), AS_OF, 15).table
    delta_refresh(table, fetched, config(True), AS_OF, 15)
    assert rows_of(table.read()) == rows_of(want)
