"""Small worked cases in the built-in rule language."""

import pytest
from pyspark.sql import functions as F

from sectorpulse import schema
from sectorpulse.operators import aggregates, classify, filters, increments, rankings, refilter, score, verdicts
from sectorpulse.operators.dedupe import append_ids, dedupe_news, merge
from sectorpulse.rules import tables
from sectorpulse.rules.tables import RuleSet, Sector

NOW = "2026-07-05 12:00:00"
EVENTS = RuleSet.events()


def news(spark, *rows):
    """Rows as dicts over a blank sector row."""
    blank = dict.fromkeys(schema.NEWS_COLUMNS, "") | {"news_type": "sector_news", "publish_time": "2026-07-05 10:00:00"}
    full = [tuple([i, *({**blank, **row}[c] for c in schema.NEWS_COLUMNS)]) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, "row_id long, " + ", ".join(f"{c} string" for c in schema.NEWS_COLUMNS))


def event(title, related="", **more):
    return {"news_type": "external_event", "title": title, "related_sectors": related, **more}


def ids(df):
    return [r["row_id"] for r in df.collect()]


def test_analysis_cases(spark):
    df = news(
        spark,
        event("国际油价大涨创阶段新高", "石油石化、化工、半导体芯片", content="OPEC 减产推动原油价格上涨"),
        event("美国宣布新一轮出口管制，多家企业列入实体清单", "半导体芯片，信创软件"),
        {"sector": "机器人", "title": "公司签订大额订单，全年业绩预增"},
        {"sector": "银行", "title": "公司召开例行股东大会"},
        {"sector": "证券", "title": "证监会发布新规征求意见"},
        {"sector": "光伏", "title": "龙头厂商宣布扩产，订单饱满"},
        {"sector": "半导体芯片", "title": "半导体板块盘中拉升，多股涨停"},
        event("AI服务器需求增长，HBM 供不应求", "半导体芯片、人工智能"),
    )
    got = [r["analysis"] for r in score.analyse(df).orderBy("row_id").collect()]
    sides = [{a["sector"]: a["sentiment"] for a in g["sector_assessments"]} for g in got]
    assert sides[0]["石油石化"] == "positive" and sides[0]["化工"] == "negative"
    assert got[0]["divergent"] and got[0]["sentiment"] == "neutral"
    assert sides[1] == {"半导体芯片": "negative", "信创软件": "positive"} and got[1]["impact_level"] == "high"
    assert got[2]["sentiment"] == "positive" and got[2]["confidence"] >= 45
    assert got[3]["sentiment"] == "neutral" and got[3]["reason"] == "判断依据不足"
    assert [g["category"] for g in got[4:7]] == ["policy", "industry", "stock_move"]
    assert got[4]["importance"] > got[5]["importance"] > got[6]["importance"]
    assert got[7]["sentiment"] == "positive"


@pytest.mark.parametrize("title,category,matched", [
    ("海马汽车连续亏损", "苹果产业链", False),
    ("中美元首会谈结束", "美联储/利率", False),
    ("印度卢比兑美元跌破", "美联储/利率", False),
    ("苹果发布 Vision Pro 新版本", "苹果产业链", True),
    ("新品 Pro 版本即将发布", "苹果产业链", False),
    ("Vision 概念产品更新", "苹果产业链", False),
    ("美元 利率走势分化", "美联储/利率", True),
])
def test_classifier_cases(spark, title, category, matched):
    df = classify.classify(news(spark, event(title)), EVENTS, F.lit(category))
    assert df.first()["classification"]["matched"] is matched


def test_rule_and_sector_configuration():
    never = tables.rule_from(" Pro ")
    assert never.co == ["__never_match_keyword__"]
    assert tables.rule_from("Vision Pro").weight == 2.0
    rule = tables.rule_from({"positiveKeywords": ["a", "a", " "], "weight": "2", "fields": ["x"]})
    assert (rule.positive, rule.weight, rule.min_score, rule.fields) == (["a"], 2.0, 2.0, ["title", "summary", "content"])
    assert tables.rule_from({"positiveKeywords": []}) is None
    sectors = tables.sectors_of({"A": "k", "B": {"keywords": ["x"], "risk_filter": "r"}, " ": ["y"]})
    assert sectors == [Sector("A", ["k"]), Sector("B", ["x"], "r")]
    rules, mapping = tables.events_of({"EXTERNAL_EVENTS": {"E": ["k"]}, "EVENT_TO_SECTORS": {"E": "S"}})
    assert list(rules.categories) == ["E"] and mapping == {"E": ["S"]}
    got, warning = tables.load_config("/nonexistent.json", tables.sectors_of, ["default"])
    assert got == ["default"] and warning
    assert RuleSet.events().keywords()["油价能源"] == ["油价", "原油", "OPEC", "布伦特原油", "WTI"]
    with pytest.raises(ValueError):
        RuleSet.of([])


def test_unknown_rule_id_is_no_fallback(spark):
    df = spark.createDataFrame(
        [("苹果产业链", "unknown_rule"), ("苹果产业链", ""), ("x", "Fed-Rate"), ("美联储／利率", ""), ("Vision Pro", "")],
        "s string, i string",
    )
    got = [r[0] for r in df.select(tables.risk_family(F.col("s"), F.col("i"))).collect()]
    assert got == ["", "苹果产业链", "美联储/利率", "美联储/利率", "Vision Pro"]


def test_refilter_drops_what_no_longer_holds(spark):
    df = news(
        spark,
        event("印度卢比兑美元跌破", event_category="美联储/利率"),
        {"sector": "半导体芯片", "title": "芯片"},
        event("美联储降息", event_category="美联储/利率"),
        event("whatever", event_category="gone"),
        {"sector": "苹果产业链", "title": "海马汽车"},
        {"sector": "苹果产业链", "title": "iPhone 新品"},
    )
    assert sorted(ids(refilter.refilter(df, EVENTS))) == [1, 2, 5]
    loose = [Sector("苹果产业链", [], "unknown_rule")]
    assert sorted(ids(refilter.refilter(df, EVENTS, loose))) == [1, 2, 4, 5]


def test_incremental_links(spark):
    old = news(spark, {"link": "http://e.com/a/"}, {"link": "http://e.com/new"}, {"link": ""})
    new = news(
        spark, {"link": "http://e.com/a?from=share"}, {"link": "http://e.com/new"},
        {"link": "http://e.com/older-but-unseen", "publish_time": "2026-07-05 08:00:00"}, {"link": ""},
    )
    assert sorted(ids(increments.new_links(old, new))) == [2, 3]


def test_merge_keeps_older_row_on_ties(spark):
    old = news(spark, {"sector": "s", "title": "一二三四五六"})
    new = news(spark, {"sector": "s", "title": "一二三四五六！"}, {"sector": "t", "title": "一二三四五六"})
    assert sorted(ids(merge(old, append_ids(old, new)))) == [0, 2]
    assert sorted(ids(dedupe_news(news(spark, {"title": "甲" * 9}, {"title": "甲" * 8 + "乙"}, {"title": ""}, {"title": ""})))) == [0, 2, 3]


def test_hot_list_cases(spark):
    rows = score.analyse(news(spark, event("美联储宣布降息，流动性宽松", "黄金、证券")))
    assert ids(rankings.hot_list(rows, ["半导体芯片"], NOW)[0]) == []
    assert ids(rankings.hot_list(rows, ["黄金"], NOW)[0]) == [0]
    twice = score.analyse(news(
        spark, {"title": "美国宣布新一轮出口管制涉及芯片设备", "sector": "半导体芯片", "link": "http://a.com/1"},
        {"title": "美国宣布新一轮出口管制涉及芯片设备！", "sector": "半导体芯片", "link": "http://b.com/2"},
        {"title": "昨天的新闻", "publish_time": "2026-07-04 13:00:00"}, {"title": "旧闻", "publish_time": "2026-06-25 10:00:00"},
    ))
    hot, fallback = rankings.hot_list(twice, ["半导体芯片"], NOW)
    assert ids(hot) == [0, 2] and fallback


def test_a_burst_of_copies_does_not_fill_the_lists(spark, monkeypatch):
    copies = [{"title": "美国宣布新一轮出口管制涉及芯片设备" + "！" * (k % 3), "link": f"http://a.com/{k}"} for k in range(100)]
    others = ["央行宣布降息", "光伏组件价格企稳回升", "某公司发布年度业绩报告", "新能源汽车销量创新高", "黄金价格小幅回落"]
    later = [{"title": t, "link": f"http://b.com/{k}", "publish_time": "2026-07-05 01:00:00"} for k, t in enumerate(others)]
    rows = score.analyse(news(spark, *copies, *later)).cache()
    hot = [ids(rankings.hot_list(rows, [], NOW)[0])]
    report = [ids(rankings.daily_report(rows, NOW))]
    monkeypatch.setattr(rankings, "FIRST_WINDOW", 1000)
    hot.append(ids(rankings.hot_list(rows, [], NOW)[0]))
    report.append(ids(rankings.daily_report(rows, NOW)))
    assert hot[0] == hot[1] and len(hot[0]) == 5
    assert report[0] == report[1] and len(report[0]) == 6


def test_clusters_and_sections(spark):
    rows = score.analyse(news(
        spark, {"title": "英伟达发布新一代 GPU 芯片，算力大幅提升"}, {"title": "英伟达正式发布新一代 GPU 芯片 算力提升明显"},
        {"title": "光伏组件价格企稳回升"},
    ))
    listed = {r["row_id"]: r["related_count"] for r in rankings.sections(rows, 5).collect()}
    assert sorted(listed.values()) == [0, 1] and len(listed) == 2
    assert len(ids(rankings.daily_report(rows, NOW))) == 2


def test_push_worthy_and_history(spark):
    rows = score.analyse(news(
        spark, {"title": "央行发布新政策", "link": "http://a"}, {"title": "盘中拉升涨停", "link": "http://b"},
        {"title": "央行发布新政策", "publish_time": "2026-07-02 10:00:00", "link": "http://c"},
        {"title": "国务院印发规划", "link": "http://d"},
    ))
    assert sorted(ids(filters.push_worthy(rows, NOW))) == [0, 3]
    empty = spark.createDataFrame([], "seq long, link_hash string")
    history = increments.append_history(empty, spark.createDataFrame([(0, "http://a")], "seq long, link string"))
    assert ids(rankings.alert_batch(rows, history, NOW)) == [3]


def test_sentiment_counts(spark):
    df = spark.createDataFrame([(s,) for s in ("positive", "positive", "negative", "neutral")], "s string")
    rows = df.select(F.struct(F.col("s").alias("sentiment")).alias("analysis"))
    assert tuple(aggregates.sentiment_counts(rows).first()) == (4, 2, 1, 1)


BROKEN = [
    '{"shouldKeep": true, "category": "c", "confidence": 0.9}',
    '{"shouldKeep": "true", "category": "c", "confidence": 0.9, "reason": "bad"}',
    '{"shouldKeep": true, "category": 123, "confidence": 0.9, "reason": "bad"}',
    '{"shouldKeep": true, "category": "c", "confidence": "0.9", "reason": "bad"}',
    '{"shouldKeep": true, "category": "c", "confidence": 1.2, "reason": "bad"}',
    '{"shouldKeep": true, "category": "c", "confidence": 0.9, "reason": 123}',
    '{"shouldKeep": true, "category": "c", "confidence": true, "reason": "bad"}',
    "[1]", "not json", None,
]
GOOD = ['{"shouldKeep": true, "category": " c ", "confidence": 1, "reason": "ok"}', '{"shouldKeep": false, "category": "", "confidence": 0.25, "reason": ""}']


def test_verdict_parsing(spark):
    df = spark.createDataFrame([(v,) for v in BROKEN + GOOD], "raw string")
    got = [r[0] for r in df.select(verdicts.parse_verdict(F.col("raw"))).collect()]
    assert [g["valid"] for g in got] == [False] * len(BROKEN) + [True, True]
    assert tuple(got[-2]) == (True, True, "c", 1.0, "ok") and got[-1]["should_keep"] is False


def test_verifier_runs_once_per_request(spark):
    df = news(
        spark, event("GPU 需求增长", event_category="AI产业链"), event("GPU 需求增长", event_category="AI产业链"),
        event("美元 利率走势分化", event_category="美联储/利率"), event("美联储降息", event_category="美联储/利率"),
        event("HBM 紧缺", event_category="AI产业链"),
    )
    judged = classify.classify(df, EVENTS, F.col("event_category"))
    pending = verdicts.requests(judged)
    assert pending.count() == 3

    def verify(item, category, evidence):
        if "HBM" in item["title"]:
            raise TimeoutError("slow")
        keep = "GPU" in item["title"]
        return {"shouldKeep": keep, "category": category, "confidence": 0.9, "reason": str(evidence["score"])}

    answers = verdicts.run_verifier(pending, verify).collect()
    table = spark.createDataFrame(answers, verdicts.VERDICT_SCHEMA)
    assert sum(r["error"] is not None for r in answers) == 1
    assert verdicts.requests(judged, table).isEmpty()
    assert verdicts.requests(judged, table, retry=True).count() == 1
    assert sorted(ids(verdicts.apply_verdicts(judged, table))) == [0, 1, 3]
    assert sorted(ids(verdicts.apply_verdicts(judged, None))) == [0, 1, 2, 3, 4]


def test_merge_normalises_each_content_once(spark, monkeypatch):
    from sectorpulse.functions import text

    seen = spark.sparkContext.accumulator(0)
    whole = text.text_key

    def counted(column):
        def count(value):
            seen.add(1)
            return value

        return whole(F.udf(count, "string")(column))

    def rows(first, n):
        return schema.repair(spark.range(first, first + n, 1, 1).select(
            F.col("id").alias("row_id"),
            F.concat(F.lit("title "), F.char(F.col("id") % 20 + 65)).alias("title"),
            F.concat(F.lit("content "), F.char(F.col("id") % 7 + 65), F.char(F.col("id") % 20 + 65)).alias("content"),
        ))

    old, new = rows(0, 30), rows(30, 20)
    plain = sorted(ids(merge(old, new, fuzzy=False)))
    monkeypatch.setattr(text, "text_key", counted)
    assert sorted(ids(merge(old, new, fuzzy=False))) == plain
    assert seen.value == 50
