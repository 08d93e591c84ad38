"""The registered queries. Every one reads whole tables; limits appear only where they are the
feature (top lists, trimmed history)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import sql as S
from catalog.rules import EVENTS, FAMILIES, KEYWORDS, LEXICON, MAPPING, SECTORS
from catalog.views import AS_OF, news, table, wire
from sectorpulse import schema
from sectorpulse.functions import ids, text, times
from sectorpulse.operators import (
    aggregates,
    classify,
    dedupe,
    events,
    filters,
    increments,
    rankings,
    refilter,
    score,
    verdicts,
)
from sectorpulse.operators.similar import Similarity
from sectorpulse.plans import display as display_plan
from sectorpulse.plans import refresh
from sectorpulse.rules import defaults
from sectorpulse.rules.tables import groups_df, risk_family
from sectorpulse.session import cut_lineage, ensure_checkpoint_dir
from sectorpulse.sinks import snapshot
from sectorpulse.sinks.table import NewsTable
from sectorpulse.sources import fanout, feeds, search
from sectorpulse.sources import news as stored

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

SELECTED = ["en", "de"]
NEWS_COLS = ", ".join(schema.NEWS_COLUMNS)


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def as_int(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("int")


def pairs_text(column: Column) -> Column:
    return F.array_join(
        F.transform(column, lambda a: F.concat(a["sector"], F.lit(":"), a["sentiment"])), "、"
    )


PAIRS_SQL = "coalesce(array_to_string(list_transform({0}, lambda a: a.sector || ':' || a.sentiment), '、'), '')"


def joined_list(x: str, sep: str = ",") -> str:
    return f"coalesce(array_to_string({x}, '{sep}'), '')"


def scored_news(spark: SparkSession, sf: str) -> DataFrame:
    return score.analyse(news(spark, sf), LEXICON)


# --- schema, sources -----------------------------------------------------------------------------


@query(
    f"""SELECT conv_id * 1000 + turn AS row_id, 'sector_news' AS news_type, '' AS sector,
  CASE WHEN role = 'user' THEN '' ELSE role END AS title, role AS source, '' AS publish_time, '' AS link,
  '' AS keyword, text AS content, '' AS event_category, '' AS related_sectors, '' AS reason, '' AS fetched_at
FROM conversations"""
)
def repair_schema(spark, sf):
    raw = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.lit("").alias("news_type"),
        F.when(F.col("role") != "user", F.col("role")).alias("title"),
        F.col("role").alias("source"),
        F.col("text").alias("content"),
        F.col("turn").alias("not_in_schema"),
    )
    return schema.repair(raw)


def _search_frame(spark, sf):
    page = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("row_id"),
        page.alias("新闻标题"),
        F.lit("ignored: the first name wins").alias("title"),
        F.when(F.col("url").endswith(".html"), "").otherwise(F.col("url")).alias("链接"),
        F.col("html").alias("摘要"),
    )


@query(
    f"""SELECT page_id AS row_id, {S.clean("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
  '未知来源' AS source, '' AS publish_time, {S.clean("url")} AS link, 'kw' AS keyword, {S.clean("html")} AS content
FROM pages WHERE NOT ends_with(url, '.html')
  AND {S.clean("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} <> '' AND {S.clean("url")} <> ''"""
)
def search_rows(spark, sf):
    return search.search_rows(_search_frame(spark, sf), F.lit("kw"))


def _item_fields():
    """An API item per event: some lack a link, a source or a title, as real ones do."""
    kind, eid = F.col("event_type"), F.col("event_id").cast("string")
    fields = {name: F.lit("") for name in search.ITEM_FIELDS}
    fields["title"] = F.when(kind == "error", "").otherwise(F.concat(F.lit("<em>"), kind, F.lit("</em> "), eid))
    fields["新闻标题"] = F.when(F.col("value") < 50, F.concat(F.lit("旧题 "), eid)).otherwise("")
    fields["code"] = F.when(kind != "signup", eid).otherwise("")
    fields["articleUrl"] = F.when(kind == "click", F.concat(F.lit("http://a.cn/"), eid)).otherwise("")
    fields["source"] = F.when(kind == "view", F.lit("")).otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string")))
    fields["time"] = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    fields["summary"] = F.col("props")
    return fields


_ITEM_SQL = """items AS (SELECT event_id AS row_id,
  CASE WHEN event_type <> 'error' THEN event_type || ' ' || event_id WHEN value < 50 THEN '旧题 ' || event_id ELSE '' END AS title,
  CASE WHEN event_type = 'view' THEN '东方财富' ELSE 'user ' || user_id END AS source,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS publish_time,
  CASE WHEN event_type = 'click' THEN 'http://a.cn/' || event_id
       WHEN event_type <> 'signup' THEN 'http://finance.eastmoney.com/a/' || event_id || '.html' ELSE '' END AS link,
  event_type AS keyword, props AS content FROM events)"""


@query(f"WITH {_ITEM_SQL} SELECT * FROM items WHERE title <> '' AND link <> ''")
def search_items(spark, sf):
    item = F.struct(*[c.alias(n) for n, c in _item_fields().items()])
    frame = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("keyword"), item.alias("item")
    )
    return search.item_rows(frame)


@query(
    f"""WITH {_ITEM_SQL} SELECT row_id, CASE WHEN keyword = 'purchase' THEN 0 ELSE 1 END AS ok,
  CASE WHEN keyword = 'purchase' THEN 0 ELSE 2 END AS items,
  CASE WHEN keyword = 'purchase' OR keyword = 'error' THEN '' ELSE '<em>' || keyword || '</em> ' || row_id END AS first_title,
  CASE WHEN keyword = 'purchase' THEN '' ELSE '第二条' END AS second_title FROM items"""
)
def parse_responses(spark, sf):
    """Nested objects inside a callback, plain JSON, and broken bodies."""
    item = F.struct(*[c.alias(n) for n, c in _item_fields().items()])
    payload = F.to_json(
        F.struct(F.struct(F.array(item).alias("list"), F.struct(F.lit("第二条").alias("title")).alias("more")).alias("result"))
    )
    body = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("cb("), payload, F.lit(",)")))
        .when(F.col("event_type") == "click", payload)
        .otherwise(F.concat(F.lit(" jQuery_1("), payload, F.lit(");")))
    )
    parsed = search.parse_responses(
        table(spark, sf, "events").select(F.col("event_id").alias("row_id"), body.alias("body"))
    )

    def title(n: int) -> Column:
        return F.coalesce(F.try_element_at("items", F.lit(n))["title"], F.lit(""))

    return parsed.select(
        "row_id", as_int("ok").alias("ok"), F.size("items").alias("items"), title(1).alias("first_title"),
        title(2).alias("second_title"),
    )


def _talk_feed(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.when(F.col("role") == "user", F.col("role")).alias("标题"),
        F.col("text").alias("内容"),
        F.when(F.col("turn") == 0, "2024-01-05 10:00:00").otherwise("10:00:00").alias("发布时间"),
        F.lit("2024-01-05").alias("发布日期"),
    )


def _doc_feed(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("content"), F.col("source").alias("time_of_day")
    )


def _feed_sql(name: str, rows: str) -> str:
    source, base = defaults.FEEDS[name]
    return f"""SELECT row_id, title, '{source}' AS source, publish_time,
  '{base}#' || substr(sha1(title || '|' || publish_time), 1, 12) AS link, '' AS keyword, content
FROM ({rows}) WHERE title <> ''"""


_TALK_SQL = f"""SELECT conv_id * 1000 + turn AS row_id,
  CASE WHEN role = 'user' THEN role ELSE substring({S.clean("text")}, 1, 40) END AS title,
  '2024-01-05 10:00:00' AS publish_time, {S.clean("text")} AS content FROM conversations"""
_DOC_SQL = f"""SELECT doc_id AS row_id, substring({S.clean("text")}, 1, 40) AS title, '' AS publish_time,
  {S.clean("text")} AS content FROM documents"""


@query(_feed_sql("cls_telegraph", _TALK_SQL))
def feed_rows(spark, sf):
    source, base = defaults.FEEDS["cls_telegraph"]
    return feeds.feed_rows(_talk_feed(spark, sf), F.lit(source), F.lit(base))


def _both_feeds(spark, sf):
    return feeds.union_feeds({"cls_telegraph": _talk_feed(spark, sf), "sina_global": _doc_feed(spark, sf)})


_BOTH_SQL = f"({_feed_sql('cls_telegraph', _TALK_SQL)} UNION ALL {_feed_sql('sina_global', _DOC_SQL)})"


@query(f"SELECT source, count(*) AS items, count(DISTINCT link) AS links FROM {_BOTH_SQL} GROUP BY source")
def two_feeds(spark, sf):
    both = _both_feeds(spark, sf)
    return both.groupBy("source").agg(F.count("*").alias("items"), F.countDistinct("link").alias("links"))


_KEYWORD_ROWS = ", ".join(f"({S.quote(k)})" for k in KEYWORDS)
_MATCH_SQL = f"""SELECT f.row_id, f.title, f.source, f.publish_time, f.link, k.keyword, f.content
FROM {_BOTH_SQL} f JOIN (VALUES {_KEYWORD_ROWS}) k(keyword)
  ON contains({S.fold("f.title")}, {S.fold("k.keyword")}) OR contains({S.fold("f.content")}, {S.fold("k.keyword")})"""


@query(_MATCH_SQL)
def match_feed_keywords(spark, sf):
    return feeds.match_keywords(_both_feeds(spark, sf), KEYWORDS)


def _found(spark, sf):
    """Primary and fallback search results per keyword, out of the article table."""
    rows = news(spark, sf).select("row_id", *fanout.NEWS_FIELDS)
    hits = feeds.match_keywords(rows, KEYWORDS)
    return hits.filter(F.col("link") != ""), hits.filter(F.col("link") == "")


def _status(spark):
    rows = [(k, s, ok) for i, k in enumerate(KEYWORDS) for s, ok in (("primary", i % 3 != 0), ("fallback", i % 2 == 0))]
    return spark.createDataFrame(rows, "keyword string, source string, ok boolean")


_STATUS_SQL = "(VALUES " + ", ".join(
    f"({S.quote(k)}, '{s}', {str(ok).lower()})"
    for i, k in enumerate(KEYWORDS)
    for s, ok in (("primary", i % 3 != 0), ("fallback", i % 2 == 0))
) + ") status(keyword, source, ok)"
_HITS_SQL = f"""hits AS (SELECT n.row_id, n.link, k.keyword FROM news n JOIN (VALUES {_KEYWORD_ROWS}) k(keyword)
  ON contains({S.fold("n.title")}, {S.fold("k.keyword")}) OR contains({S.fold("n.content")}, {S.fold("k.keyword")})),
worked AS (SELECT keyword FROM {_STATUS_SQL} WHERE source = 'primary' AND ok),
feedhits AS ({_MATCH_SQL}),
chosen AS (SELECT row_id, link, keyword FROM hits WHERE link <> '' AND keyword IN (SELECT keyword FROM worked)
  UNION ALL SELECT row_id, link, keyword FROM hits WHERE link = '' AND keyword NOT IN (SELECT keyword FROM worked)
  UNION ALL SELECT row_id, link, keyword FROM feedhits)"""


def _chosen(spark, sf):
    primary, fallback = _found(spark, sf)
    matched = feeds.match_keywords(_both_feeds(spark, sf), KEYWORDS)
    return fanout.choose_source(primary, fallback, matched, _status(spark))


@query(S.with_news(_HITS_SQL) + "SELECT row_id, link, keyword FROM chosen")
def source_choice(spark, sf):
    return _chosen(spark, sf).select("row_id", "link", "keyword")


_ASKED = [("sector", s.name, k) for s in SECTORS for k in s.keywords] + [
    ("event", name, k) for name, ks in EVENTS.keywords().items() for k in ks
]
_ASKED_SQL = "(VALUES " + ", ".join(f"({', '.join(map(S.quote, row))})" for row in _ASKED) + ") asked(scope, name, keyword)"


@query(
    S.with_news(_HITS_SQL)
    + f"""SELECT a.scope, a.name, a.keyword, count(*) AS found, count(DISTINCT c.row_id) AS rows_found
FROM chosen c JOIN {_ASKED_SQL.replace("asked(", "a(")} ON a.keyword = c.keyword GROUP BY ALL"""
)
def keyword_fan_out(spark, sf):
    asked = fanout.keyword_table(spark, SECTORS, EVENTS)
    spread = fanout.fan_out(_chosen(spark, sf), asked)
    return spread.groupBy("scope", "name", "keyword").agg(
        F.count("*").alias("found"), F.countDistinct("row_id").alias("rows_found")
    )


@query(
    S.with_news(_HITS_SQL)
    + f"""SELECT a.scope, a.name, count(*) AS keywords, count(f.keyword) AS failed,
  (count(*) = count(f.keyword))::INTEGER AS nothing_worked
FROM {_ASKED_SQL.replace("asked(", "a(")} LEFT JOIN (SELECT keyword FROM {_STATUS_SQL} GROUP BY keyword HAVING NOT bool_or(ok)
  EXCEPT SELECT keyword FROM feedhits WHERE source = '财联社电报') f ON a.keyword = f.keyword
GROUP BY ALL HAVING count(f.keyword) > 0"""
)
def keyword_failures(spark, sf):
    source, base = defaults.FEEDS["cls_telegraph"]
    talk = feeds.feed_rows(_talk_feed(spark, sf), F.lit(source), F.lit(base))
    failed = fanout.failed_keywords(_status(spark), feeds.match_keywords(talk, KEYWORDS))
    errors = fanout.keyword_errors(fanout.keyword_table(spark, SECTORS, EVENTS), failed)
    return errors.withColumn("nothing_worked", as_int("nothing_worked"))


_WORDS = sorted({k for _, _, k in _ASKED})
_FOUND_SQL = f"""found AS (SELECT DISTINCT k.keyword FROM news n JOIN (VALUES {", ".join(f"({S.quote(k)})" for k in _WORDS)}) k(keyword)
  ON contains({S.fold("n.title")}, {S.fold("k.keyword")}) OR contains({S.fold("n.content")}, {S.fold("k.keyword")})
  WHERE n.sector IN ('en', 'es'))"""


@query(
    S.with_news(_FOUND_SQL)
    + f"""SELECT scope, name, keywords, failed, CASE WHEN failed = 0 THEN 'ok' WHEN failed = keywords THEN 'error' ELSE 'warning' END AS outcome
FROM (SELECT a.scope, a.name, count(*) AS keywords, count(*) FILTER (WHERE f.keyword IS NULL) AS failed
  FROM {_ASKED_SQL.replace("asked(", "a(")} LEFT JOIN found f ON a.keyword = f.keyword GROUP BY ALL)"""
)
def ingest_outcomes(spark, sf):
    """What an ingest reports of every sector and category: searches find English articles, feeds Spanish ones."""
    rows, asked = news(spark, sf), fanout.keyword_table(spark, SECTORS, EVENTS)
    worked = feeds.match_keywords(rows.filter("sector = 'en'"), _WORDS).select("keyword", F.lit(True).alias("ok")).distinct()
    status = asked.select("keyword").distinct().join(worked, "keyword", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    failed = fanout.failed_keywords(status, feeds.match_keywords(rows.filter("sector = 'es'"), _WORDS))
    return fanout.outcomes(asked, failed)


@query(S.with_news() + "SELECT row_id, title, link, sector, content FROM news")
def stored_table(spark, sf):
    """A first start from a table that was never written, then a read of what the start wrote."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    nothing = stored.read_or_start(spark, path)
    news(spark, sf).unionByName(nothing, allowMissingColumns=True).write.parquet(path)
    return stored.read_or_start(spark, path).select("row_id", "title", "link", "sector", "content")


# --- projections ---------------------------------------------------------------------------------

_DISPLAY_SQL = ", ".join(
    f'{c} AS "{schema.DISPLAY_NAMES.get(c, c)}"' for c in schema.NEWS_COLUMNS if c != "fetched_at"
)


@query(S.with_news() + f"SELECT row_id, {_DISPLAY_SQL} FROM news")
def cache_to_display(spark, sf):
    return schema.to_display(news(spark, sf))


@query(
    S.with_news()
    + """SELECT row_id, news_type, CASE WHEN sector = '' THEN 'fallback' ELSE sector END AS sector, title, source,
  publish_time, link, keyword, content, CASE WHEN event_category = '' THEN 'none' ELSE event_category END AS event_category,
  CASE WHEN related_sectors = '' THEN 'en' ELSE related_sectors END AS related_sectors, 'why' AS reason,
  '2024-01-20T00:00:00Z' AS fetched_at FROM news"""
)
def display_to_cache(spark, sf):
    return schema.from_display(
        schema.to_display(news(spark, sf)), "2024-01-20T00:00:00Z", sector="fallback", news_type="x",
        event_category="none", related_sectors="en", reason="why",
    )


_MAPPING_SQL = " ".join(f"WHEN {S.quote(c)} THEN {S.quote('、'.join(v))}" for c, v in MAPPING.items() if v)


@query(
    S.with_news(f"m AS (SELECT *, CASE event_category {_MAPPING_SQL} END AS mapped FROM news)")
    + f"""SELECT row_id, event_category, coalesce(mapped, '未映射') AS related_sectors,
  CASE WHEN mapped IS NULL THEN '影响关系不确定' ELSE '根据「' || event_category || '」事件类别映射，可能影响：' || mapped END AS reason
FROM m WHERE {S.IS_EVENT}"""
)
def annotate_events(spark, sf):
    rows = filters.event_rows(news(spark, sf))
    done = events.annotate(rows, F.col("event_category"), MAPPING)
    return done.select("row_id", "event_category", "related_sectors", "reason")


@query(S.with_news() + f"SELECT row_id, {joined_list(S.TARGETS, '|')} AS targets FROM news")
def row_target_sectors(spark, sf):
    return news(spark, sf).select("row_id", F.array_join(score.target_sectors(), "|").alias("targets"))


_SENT = "CASE {0} WHEN 'positive' THEN '利好' WHEN 'negative' THEN '利空' ELSE '中性' END"


@query(
    S.with_news(S.score(LEXICON))
    + f"""SELECT row_id, {_SENT.format("sentiment")} AS sentiment_label,
  CASE impact_level WHEN 'high' THEN '高影响' WHEN 'medium' THEN '中影响' ELSE '低影响' END AS impact_label,
  CASE category WHEN 'policy' THEN '政策' WHEN 'industry' THEN '产业' WHEN 'stock_move' THEN '异动' ELSE '资讯' END AS category_label
FROM scored"""
)
def shown_labels(spark, sf):
    return scored_news(spark, sf).select("row_id", *[c.alias(n) for n, c in score.labels().items()])


@query(
    S.with_news(
        S.score(LEXICON),
        "t AS (SELECT *, list_filter(assessed, lambda a: a.sector = trim(sector))[1] AS own FROM scored)",
        f"""u AS (SELECT *, CASE WHEN {S.IS_EVENT} THEN sentiment ELSE coalesce(own.sentiment, sentiment) END AS s,
  CASE WHEN {S.IS_EVENT} THEN analysis_reason ELSE coalesce(own.reason, analysis_reason) END AS r,
  NOT {S.IS_EVENT} OR len(assessed) = 0 OR divergent AS shown FROM t)""",
    )
    + f"""SELECT row_id, coalesce(CASE WHEN shown THEN s END, '') AS shown_sentiment, r AS shown_reason,
  CASE WHEN {S.IS_EVENT} THEN {PAIRS_SQL.format("assessed[1:3]")} ELSE '' END AS shown_sectors,
  (confidence < 45)::INTEGER AS low_confidence, (shown AND s = 'neutral' AND divergent)::INTEGER AS divergent_mark FROM u"""
)
def shown_tags(spark, sf):
    tags = scored_news(spark, sf).select("row_id", *[c.alias(n) for n, c in score.shown_tags().items()])
    return tags.select(
        "row_id", F.coalesce("shown_sentiment", F.lit("")).alias("shown_sentiment"), "shown_reason",
        pairs_text(F.col("shown_sectors")).alias("shown_sectors"), as_int("low_confidence").alias("low_confidence"),
        as_int("divergent_mark").alias("divergent_mark"),
    )


# --- filters -------------------------------------------------------------------------------------


@query(
    S.with_news(f"t AS (SELECT row_id, {S.publish_ts()} AS ts FROM news)")
    + f"""SELECT '{filters.ALL_TIME}' AS time_range, row_id FROM t
UNION ALL SELECT '{filters.TODAY}', row_id FROM t WHERE ts >= date_trunc('day', {S.NOW})
UNION ALL SELECT '{filters.THREE_DAYS}', row_id FROM t WHERE ts >= {S.NOW} - INTERVAL 3 DAY
UNION ALL SELECT '{filters.THIS_WEEK}', row_id FROM t WHERE ts >= date_trunc('week', {S.NOW})"""
)
def time_ranges(spark, sf):
    rows = news(spark, sf)
    ranges = (filters.ALL_TIME, filters.TODAY, filters.THREE_DAYS, filters.THIS_WEEK)
    parts = [
        filters.in_time_range(rows, r, AS_OF).select(F.lit(r).alias("time_range"), "row_id") for r in ranges
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


_HAYSTACK = S.fold("concat_ws(' ', title, keyword, source, event_category, related_sectors)")


@query(S.with_news() + f"SELECT row_id FROM news WHERE contains({_HAYSTACK}, 'ing') AND source IN ('src1', 'src5', 'src7')")
def free_text_search(spark, sf):
    return filters.search(news(spark, sf), " ING ", ["src1", "src5", "src7"]).select("row_id")


@query(S.with_news() + f"SELECT row_id, sector FROM news WHERE sector IN {('en', 'de')}")
def sector_selection(spark, sf):
    return filters.of_sectors(news(spark, sf), SELECTED).select("row_id", "sector")


@query(S.with_news() + f"SELECT {S.IS_EVENT}::INTEGER AS is_event, count(*) AS n FROM news GROUP BY 1")
def news_type_split(spark, sf):
    rows = news(spark, sf)
    parts = filters.event_rows(rows).select(F.lit(1).alias("is_event")).unionAll(
        filters.sector_rows(rows).select(F.lit(0).alias("is_event"))
    )
    return parts.groupBy("is_event").agg(F.count("*").alias("n"))


@query(S.with_news(S.rule_cte(EVENTS, "news", "event_category")) + "SELECT row_id, event_category FROM classified WHERE matched")
def rule_filter(spark, sf):
    return classify.keep_matched(news(spark, sf), EVENTS, F.col("event_category")).select("row_id", "event_category")


_MARK_SQL = (
    S.rule_cte(EVENTS, "news", "event_category", "ev"),
    S.rule_cte(FAMILIES, "(SELECT *, CASE WHEN sector = 'en' THEN '苹果产业链' ELSE '' END AS family FROM news)", "family", "fa"),
    f"""kept AS (SELECT e.row_id, CASE WHEN {S.IS_EVENT.replace("news_type", "e.news_type")} THEN 'event' ELSE 'sector' END AS scope,
  CASE WHEN {S.IS_EVENT.replace("news_type", "e.news_type")} THEN e.event_category ELSE e.sector END AS name,
  CASE WHEN {S.IS_EVENT.replace("news_type", "e.news_type")} THEN e.matched WHEN f.family <> '' THEN f.matched ELSE true END AS keep
  FROM ev e JOIN fa f USING (row_id))""",
)


@query(S.with_news(*_MARK_SQL) + "SELECT row_id FROM kept WHERE keep")
def refilter_table(spark, sf):
    return refilter.refilter(news(spark, sf), EVENTS, SECTORS, families=FAMILIES).select("row_id")


@query(
    S.with_news(*_MARK_SQL)
    + "SELECT scope, name, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS dropped FROM kept GROUP BY ALL"
)
def refilter_group_counts(spark, sf):
    return refilter.refilter_counts(news(spark, sf), EVENTS, SECTORS, FAMILIES)


@query(
    """SELECT source, lang, CASE WHEN source IN ('src1') THEN '苹果产业链' WHEN source IN ('src2') THEN 'Vision Pro'
  WHEN source = 'src3' THEN '' WHEN source = 'src4' THEN '美联储/利率' WHEN source = 'src6' THEN 'Vision Pro' ELSE '' END AS family,
  count(*) AS n FROM documents GROUP BY ALL"""
)
def high_risk_rules(spark, sf):
    source = F.col("source")
    rule_id = F.when(source == "src1", "Apple_Supply_Chain").when(source == "src2", "vision-pro").when(source == "src3", "nope").otherwise("")
    sector = F.when(source == "src3", "苹果产业链").when(source == "src4", "美联储／利率").when(source == "src6", "Vision Pro").otherwise(source)
    return (
        table(spark, sf, "documents")
        .groupBy("source", "lang", risk_family(sector, rule_id).alias("family"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "SELECT DISTINCT source AS sector FROM documents WHERE contains(lower(source), '1') "
    "UNION SELECT DISTINCT source FROM documents WHERE contains(lang, '1') OR lang = 'es'"
)
def sector_search(spark, sf):
    """Sources as sectors, their languages as keywords."""
    docs = table(spark, sf, "documents")
    sectors = docs.groupBy(F.col("source").alias("sector")).agg(F.collect_set("lang").alias("keywords"))
    return filters.sectors_matching(sectors, " 1").unionAll(filters.sectors_matching(sectors, "ES")).select("sector").distinct()


_RETAIN = f"""SELECT {{0}} FROM (SELECT *, {S.publish_ts()} AS p, try_cast(fetched_at AS TIMESTAMP) AS f FROM news)
WHERE p >= {S.NOW} - INTERVAL 10 DAY OR (p IS NULL AND (f IS NULL OR f >= {S.NOW} - INTERVAL 10 DAY))"""


@query(S.with_news() + _RETAIN.format("row_id"))
def retention_prune(spark, sf):
    return filters.prune(news(spark, sf), 10, AS_OF).select("row_id")


@query(S.with_news() + f"SELECT row_id FROM news WHERE CAST({S.publish_ts()} AS DATE) = CAST({S.NOW} AS DATE)")
def published_today(spark, sf):
    return news(spark, sf).filter(filters.is_today(AS_OF)).select("row_id")


_WORTHY = f"{S.publish_ts()} >= {S.NOW} - INTERVAL 24 HOUR AND (category = 'policy' OR impact_level = 'high')"


@query(S.with_news(S.score(LEXICON)) + f"SELECT row_id, round(importance, 6) AS importance FROM scored WHERE {_WORTHY}")
def push_worthy(spark, sf):
    rows = filters.push_worthy(scored_news(spark, sf), AS_OF)
    return rows.select("row_id", F.round(F.col("analysis")["importance"], 6).alias("importance"))


# --- joins ---------------------------------------------------------------------------------------

_LINKS = f"l AS (SELECT *, {S.link_key('link')} AS lk FROM news)"


@query(
    S.with_news(_LINKS)
    + f"SELECT row_id FROM l WHERE {S.IS_EVENT} AND (lk = '' OR lk NOT IN (SELECT lk FROM l WHERE NOT {S.IS_EVENT} AND lk <> ''))"
)
def incremental_new_links(spark, sf):
    rows = news(spark, sf)
    return increments.new_links(filters.sector_rows(rows), filters.event_rows(rows)).select("row_id")


@query(
    S.with_news(_LINKS)
    + f"""SELECT row_id FROM l WHERE {S.IS_EVENT} AND (lk = '' OR NOT EXISTS (SELECT 1 FROM l k
  WHERE NOT (k.news_type = 'external_event') AND k.lk = l.lk AND k.keyword = l.keyword))"""
)
def incremental_new_links_scoped(spark, sf):
    rows = news(spark, sf)
    return increments.new_links(
        filters.sector_rows(rows), filters.event_rows(rows), scope_columns=("keyword",)
    ).select("row_id")


def _history(spark, sf):
    old = news(spark, sf).filter((F.col("link") != "") & (F.col("keyword") == "fr"))
    return increments.append_history(
        spark.createDataFrame([], "seq long, link_hash string"),
        old.select(F.col("row_id").alias("seq"), "link"),
    )


_HISTORY_SQL = """history AS (SELECT row_id AS seq, substr(sha1(link), 1, 16) AS link_hash FROM news
  WHERE link <> '' AND keyword = 'fr' ORDER BY row_id DESC LIMIT 800)"""


@query(S.with_news(_HISTORY_SQL) + "SELECT row_id FROM news WHERE substr(sha1(link), 1, 16) NOT IN (SELECT link_hash FROM history)")
def unpushed_rows(spark, sf):
    return increments.unpushed(news(spark, sf), _history(spark, sf)).select("row_id")


@query(
    S.with_news(
        _HISTORY_SQL,
        "top AS (SELECT coalesce(max(seq), -1) + 1 AS base FROM history)",
        """added AS (SELECT row_id + base AS seq, substr(sha1(link), 1, 16) AS link_hash FROM news, top WHERE keyword <> 'fr'
  UNION ALL SELECT * FROM history)""",
    )
    + "SELECT seq, link_hash FROM added ORDER BY seq DESC LIMIT 800"
)
def append_history(spark, sf):
    pushed = news(spark, sf).filter(F.col("keyword") != "fr").select(F.col("row_id").alias("seq"), "link")
    return increments.append_history(_history(spark, sf), pushed)


@query(
    S.with_news(*[S.rule_cte(EVENTS, "news", "event_category")])
    + """SELECT event_category, count(*) AS rows_seen, count(*) FILTER (WHERE matched) AS rows_matched,
  round(sum(score), 6) AS total_score FROM classified WHERE event_category IN ('cat_en', 'cat_fr', 'cat_de') GROUP BY 1"""
)
def category_rules_join(spark, sf):
    """Category × rules as a join, aggregated back to rows and categories."""
    per_rule = classify.rule_scores(filters.event_rows(news(spark, sf)), EVENTS, "event_category")
    per_row = per_rule.groupBy("row_id", "event_category").agg(F.sum("hit.score").alias("score"))
    return per_row.groupBy("event_category").agg(
        F.count("*").alias("rows_seen"), F.count_if(F.col("score") > 0).alias("rows_matched"),
        F.round(F.sum("score"), 6).alias("total_score"),
    )


@query(S.with_news() + f"SELECT row_id FROM news WHERE list_has_any({S.TARGETS}, ['en', 'de'])")
def selection_overlap(spark, sf):
    overlap = F.arrays_overlap(score.target_sectors(), F.array(*[F.lit(s) for s in SELECTED]))
    return news(spark, sf).filter(overlap).select("row_id")


@query(
    S.with_news("hot AS (SELECT link FROM news WHERE link <> '' ORDER BY row_id LIMIT 5)")
    + "SELECT row_id, (link IN (SELECT link FROM hot))::INTEGER AS is_hot FROM news"
)
def hot_link_flag(spark, sf):
    rows = news(spark, sf)
    hot = rows.filter(F.col("link") != "").orderBy("row_id").limit(5)
    return increments.mark_hot(rows, hot).select("row_id", as_int("is_hot").alias("is_hot"))


_GROUP_SQL = " ".join(f"WHEN sector IN ({', '.join(map(S.quote, v))}) THEN '{g}'" for g, v in defaults.SECTOR_GROUPS.items())


@query(S.with_wire() + f"SELECT sector, CASE {_GROUP_SQL} ELSE '其他' END AS sector_group, count(*) AS n FROM wire WHERE sector <> '' GROUP BY ALL")
def sector_groups(spark, sf):
    rows = filters.sector_rows(wire(spark, sf)).groupBy("sector").agg(F.count("*").alias("n"))
    return aggregates.with_group(rows, groups_df(spark)).select("sector", "sector_group", "n")


# --- aggregates ----------------------------------------------------------------------------------

_COUNTS = "count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}" for s in aggregates.SENTIMENTS
)


@query(S.with_news(S.score(LEXICON)) + f"SELECT {_COUNTS} FROM scored")
def sentiment_totals(spark, sf):
    return aggregates.sentiment_counts(scored_news(spark, sf))


@query(S.with_news(S.score(LEXICON)) + f"SELECT sector, {_COUNTS} FROM scored WHERE contains({_HAYSTACK}, 'th') GROUP BY sector")
def section_counts(spark, sf):
    return aggregates.sentiment_counts(filters.search(scored_news(spark, sf), "th"), "sector")


@query(
    S.with_news()
    + f"""SELECT count(*) AS total, strftime(max(try_cast(fetched_at AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%SZ') AS latest_fetched_at,
  {S.stamp(f"max({S.publish_ts()})")} AS latest_publish_time FROM news"""
)
def table_metadata(spark, sf):
    return aggregates.metadata(news(spark, sf))


@query(S.with_news() + "SELECT max(fetched_at) AS latest_fetched_at, count(*) AS total FROM news")
def table_fingerprint(spark, sf):
    return aggregates.fingerprint(news(spark, sf)).select("latest_fetched_at", "total")


@query(S.with_news() + "SELECT DISTINCT source FROM news WHERE source <> ''")
def distinct_sources(spark, sf):
    return aggregates.distinct_sources(news(spark, sf))


@query(
    S.with_news(S.score(LEXICON))
    + f"""SELECT {_COUNTS} FROM scored WHERE ({S.IS_EVENT} OR sector IN ('en', 'de'))
  AND CAST({S.publish_ts()} AS DATE) = CAST({S.NOW} AS DATE)"""
)
def today_summary(spark, sf):
    return aggregates.today_summary(scored_news(spark, sf), SELECTED, AS_OF)


@query(S.with_news() + f"SELECT (SELECT count(*) FROM news) AS existing, (SELECT count(*) FROM ({_RETAIN.format('row_id')})) AS final")
def change_counts(spark, sf):
    rows = news(spark, sf)
    return aggregates.change_counts(existing=rows, final=filters.prune(rows, 10, AS_OF))


@query(
    S.with_wire(f"g AS (SELECT DISTINCT sector, CASE {_GROUP_SQL} ELSE '其他' END AS sector_group FROM wire WHERE sector <> '')")
    + "SELECT sector_group, count(*) AS sectors, count(*) FILTER (WHERE sector IN ('黄金', '银行')) AS selected FROM g GROUP BY 1"
)
def group_rollup(spark, sf):
    sectors = filters.sector_rows(wire(spark, sf)).select("sector").distinct()
    return aggregates.group_rollup(sectors, groups_df(spark), ["黄金", "银行"])


# --- de-duplication and clusters -----------------------------------------------------------------


def _greedy_news(source: str = "news", partition: str = S.SCOPE) -> str:
    return S.greedy(source, partition, S.NEWEST_FIRST, S.news_keys())


@query(S.with_news(_greedy_news(), recursive=True) + "SELECT n.* FROM news n JOIN greedy g USING (row_id) WHERE g.keep")
def dedupe_exact(spark, sf):
    """Greedy keep-first per sector, event news as one group; link, title and content keys."""
    return dedupe.dedupe_news(news(spark, sf), fuzzy=False)


@query(S.with_news(_greedy_news(partition="'all'"), recursive=True) + "SELECT row_id FROM greedy WHERE keep")
def dedupe_exact_global(spark, sf):
    return dedupe.dedupe(news(spark, sf), fuzzy=False).select("row_id")


@query()
def dedupe_fuzzy(spark, sf):
    """As above, near-equal titles too. SQL has no matching-blocks ratio: tested by brute force."""
    return dedupe.dedupe_news(news(spark, sf)).select("row_id", "news_type", "sector", "title")


_HALVES = f"""old AS (SELECT * FROM news WHERE keyword <> 'fr'), new AS (SELECT * FROM news WHERE keyword = 'fr'),
both_rows AS (SELECT o.* FROM old o JOIN g1 USING (row_id) WHERE keep
  UNION ALL SELECT (SELECT max(row_id) + 1 FROM old) + row_id, {NEWS_COLS} FROM new)"""


@query(
    S.with_news(
        S.greedy("news_old", S.SCOPE, S.NEWEST_FIRST, S.news_keys(), "g1"),
        _HALVES,
        S.greedy("both_rows", S.SCOPE, S.NEWEST_FIRST, S.news_keys(), "g2"),
        recursive=True,
    ).replace("FROM news_old", "FROM (SELECT * FROM news WHERE keyword <> 'fr') x")
    + "SELECT row_id FROM g2 WHERE keep"
)
def merge_exact(spark, sf):
    rows = news(spark, sf)
    old = rows.filter(F.col("keyword") != "fr")
    new = rows.filter(F.col("keyword") == "fr")
    return dedupe.merge(old, dedupe.append_ids(old, new), fuzzy=False).select("row_id")


_JACCARD_CTES = f"""
ct AS MATERIALIZED (SELECT row_id, {S.SCOPE} AS p, {S.title_key("title")} AS k,
  row_number() OVER (PARTITION BY {S.SCOPE} ORDER BY {S.BY_IMPORTANCE}) AS rn FROM scored),
dk AS MATERIALIZED (SELECT p, k, min(rn) AS tid, CASE WHEN length(k) = 1 THEN [k]
  ELSE list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) END AS grams
  FROM ct WHERE k <> '' GROUP BY p, k),
tg AS MATERIALIZED (SELECT p, tid, len(grams) AS n, unnest(grams) AS g FROM dk),
sim AS MATERIALIZED (SELECT a.p, a.tid AS a, b.tid AS b FROM tg a JOIN tg b ON a.p = b.p AND a.g = b.g
  GROUP BY a.p, a.tid, b.tid, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.5),
near AS MATERIALIZED (SELECT ct.p, ct.rn, ct.row_id, dk.tid, (SELECT list(s.b) FROM sim s WHERE s.p = dk.p AND s.a = dk.tid) AS similar_to
  FROM ct LEFT JOIN dk ON dk.p = ct.p AND dk.k = ct.k),
walk AS (SELECT p, rn, row_id, true AS is_leader, rn AS leader, CASE WHEN tid IS NULL THEN []::BIGINT[] ELSE [tid] END AS led,
    CASE WHEN tid IS NULL THEN []::BIGINT[] ELSE [rn] END AS led_rn FROM near WHERE rn = 1
  UNION ALL SELECT n.p, n.rn, n.row_id, NOT coalesce(list_has_any(w.led, n.similar_to), false),
    CASE WHEN coalesce(list_has_any(w.led, n.similar_to), false)
      THEN list_min(list_filter(w.led_rn, lambda x, i: list_contains(n.similar_to, w.led[i]))) ELSE n.rn END,
    CASE WHEN n.tid IS NULL OR list_has_any(w.led, n.similar_to) THEN w.led ELSE list_append(w.led, n.tid) END,
    CASE WHEN n.tid IS NULL OR list_has_any(w.led, n.similar_to) THEN w.led_rn ELSE list_append(w.led_rn, n.rn) END
  FROM walk w JOIN near n ON n.p = w.p AND n.rn = w.rn + 1)"""
JACCARD_ONLY = Similarity(ratio=None, jaccard=defaults.CLUSTER_JACCARD)


@query(
    S.with_news(S.score(LEXICON), _JACCARD_CTES, recursive=True)
    + """SELECT w.row_id, w.is_leader::INTEGER AS is_leader, l.row_id AS leader_id FROM walk w
JOIN walk l ON l.p = w.p AND l.rn = w.leader"""
)
def event_clusters_jaccard(spark, sf):
    rows = cut_lineage(scored_news(spark, sf))
    picked = rankings.clusters(rows, dedupe.news_scope(), JACCARD_ONLY)
    return rankings.cluster_table(rows, picked).select("row_id", as_int("is_leader").alias("is_leader"), "leader_id")


@query()
def event_clusters(spark, sf):
    """Jaccard or ratio; tested by brute force."""
    rows = cut_lineage(scored_news(spark, sf))
    picked = rankings.clusters(rows, dedupe.news_scope())
    return rankings.cluster_table(rows, picked).select("row_id", as_int("is_leader").alias("is_leader"), "leader_id")


@query(
    S.with_news(
        S.score(LEXICON),
        _JACCARD_CTES,
        "led AS (SELECT w.*, l.row_id AS leader_id FROM walk w JOIN walk l ON l.p = w.p AND l.rn = w.leader)",
        """fol AS (SELECT leader_id, row_id, row_number() OVER (PARTITION BY leader_id ORDER BY rn) AS n FROM led WHERE NOT is_leader)""",
        """lst AS (SELECT f.leader_id, count(*) AS c, string_agg(s.source || '|' || s.publish_time, ';' ORDER BY f.n) FILTER (WHERE f.n <= 8) AS shown
  FROM fol f JOIN news s USING (row_id) GROUP BY 1)""",
        recursive=True,
    )
    + "SELECT l.row_id, coalesce(c, 0) AS related_count, coalesce(shown, '') AS related FROM led l LEFT JOIN lst ON lst.leader_id = l.row_id WHERE is_leader"
)
def related_reports(spark, sf):
    rows = cut_lineage(scored_news(spark, sf))
    clustered = rankings.cluster_table(rows, rankings.clusters(rows, dedupe.news_scope(), JACCARD_ONLY))
    listed = rankings.related_reports(clustered)
    shown = F.transform("related", lambda r: F.concat(r["source"], F.lit("|"), r["publish_time"]))
    return listed.select(
        "row_id", "related_count", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("related")
    )


# --- ranked lists --------------------------------------------------------------------------------


@query(
    S.with_news(S.score(LEXICON))
    + f"SELECT row_id, row_number() OVER (ORDER BY {S.BY_IMPORTANCE}) - 1 AS place FROM scored"
)
def importance_order(spark, sf):
    return _numbered(rankings.sort_by_importance(scored_news(spark, sf)))


@query(S.with_news() + f"SELECT row_id, row_number() OVER (ORDER BY {S.NEWEST_FIRST}) - 1 AS place FROM news")
def time_order(spark, sf):
    return _numbered(rankings.sort_by_time(news(spark, sf)))


def _numbered(ordered: DataFrame) -> DataFrame:
    """Places in a sorted frame without gathering it: partition offsets plus local position."""
    tagged = ordered.select("row_id", F.monotonically_increasing_id().alias("_id"))
    tagged = tagged.withColumn("_part", F.shiftright("_id", 33))
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    # One row per sort partition, so this broadcast is bounded by the partition count.
    before = sizes.alias("a").join(F.broadcast(sizes).alias("b"), F.col("b._part") < F.col("a._part"), "left")
    offsets = before.groupBy("a._part", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    placed = tagged.join(F.broadcast(offsets), "_part")
    return placed.select("row_id", (F.col("_id") - F.col("first") + F.col("before")).alias("place"))


@query(
    S.with_news(
        S.score(LEXICON),
        f"r AS (SELECT row_id, sector, row_number() OVER (PARTITION BY sector ORDER BY {S.BY_IMPORTANCE}) AS place FROM scored)",
    )
    + "SELECT * FROM r WHERE place <= 30"
)
def top_per_sector(spark, sf):
    return rankings.top_per(scored_news(spark, sf), [F.col("sector")], 30).select("row_id", "sector", "place")


@query()
def section_lists(spark, sf):
    """Per section its first 30 event clusters with related reports."""
    listed = rankings.sections(scored_news(spark, sf))
    return listed.select("row_id", "news_type", "sector", "title", "place", "related_count")


_SELECTED_SQL = f"list_has_any({S.TARGETS}, ['en', 'de'])"


@query(
    S.with_news(
        S.score(LEXICON),
        f"h AS (SELECT *, {S.publish_ts()} AS ts, {_SELECTED_SQL} AS related FROM scored)",
    )
    + f"""SELECT row_id, (CAST(ts AS DATE) = CAST({S.NOW} AS DATE))::INTEGER AS is_today,
  round(importance * 1.5 + CASE WHEN sentiment <> 'neutral' OR divergent THEN 1.5 ELSE 0 END + CASE WHEN related THEN 2 ELSE 0 END
  + greatest(0, 1.5 - greatest((epoch_us({S.NOW}) - epoch_us(ts)) / 3600000000.0::DOUBLE, 0) / 16.0), 6) AS hot_score
FROM h WHERE (related OR NOT {S.IS_EVENT}) AND (CAST(ts AS DATE) = CAST({S.NOW} AS DATE) OR ts >= {S.NOW} - INTERVAL 24 HOUR)"""
)
def hot_candidates(spark, sf):
    rows = rankings.hot_candidates(scored_news(spark, sf), SELECTED, AS_OF)
    return rows.select("row_id", as_int("is_today").alias("is_today"), F.round("hot_score", 6).alias("hot_score"))


@query()
def hot_list(spark, sf):
    hot, fallback = rankings.hot_list(scored_news(spark, sf), SELECTED, AS_OF)
    return hot.select("row_id", "title", F.round("hot_score", 6).alias("hot_score"), F.lit(int(fallback)).alias("used_fallback"))


@query(
    S.with_news(S.score(LEXICON), _HISTORY_SQL)
    + f"""SELECT row_id, title, link FROM scored WHERE {_WORTHY} AND substr(sha1(link), 1, 16) NOT IN (SELECT link_hash FROM history)
ORDER BY {S.BY_IMPORTANCE} LIMIT 8"""
)
def alert_batch(spark, sf):
    return rankings.alert_batch(scored_news(spark, sf), _history(spark, sf), AS_OF).select("row_id", "title", "link")


@query()
def daily_report(spark, sf):
    return rankings.daily_report(scored_news(spark, sf), AS_OF).select("row_id", "title", "source")


@query()
def report_history(spark, sf):
    """The alert history after the daily report was delivered."""
    return rankings.report_and_history(scored_news(spark, sf), _history(spark, sf), AS_OF)[1]


@query(
    S.with_news(
        S.score(LEXICON),
        f"""r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY {S.BY_IMPORTANCE}) AS place FROM scored
  WHERE sector IN ('en', 'de') AND CAST({S.publish_ts()} AS DATE) = CAST({S.NOW} AS DATE))""",
    )
    + """SELECT sector, count(*) AS count, string_agg(title || '|' || source || '|' || substring(content, 1, 120), ';' ORDER BY place) AS news
FROM r WHERE place <= 15 GROUP BY sector"""
)
def digest_input(spark, sf):
    lists = rankings.digest_input(scored_news(spark, sf), SELECTED, AS_OF)
    items = F.from_json("news", "array<struct<title:string,source:string,summary:string>>")
    shown = F.transform(items, lambda i: F.concat_ws("|", i["title"], i["source"], i["summary"]))
    return lists.select("sector", "count", F.array_join(shown, ";").alias("news"))


# --- set operations, keyed snapshot --------------------------------------------------------------

_ID = "sha256(concat_ws('|', news_type, sector, event_category, link, title, keyword))"


@query(
    f"""SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT role FROM conversations) GROUP BY source"""
)
def union_with_repair(spark, sf):
    talk = table(spark, sf, "conversations").select(F.col("role").alias("source"))
    return schema.combine(news(spark, sf), talk).groupBy("source").agg(F.count("*").alias("n"))


def _old_and_new(spark, sf):
    rows = news(spark, sf)
    same = rows.withColumn("link", F.lit(""))
    old = same.filter(F.col("keyword") != "es")
    new = same.filter(F.col("source") != "src7")
    return snapshot.last_per_key(old), snapshot.last_per_key(new)


_SNAP = f"""ids AS (SELECT row_id, keyword, source, sha256(concat_ws('|', news_type, sector, event_category, '', title, keyword)) AS id FROM news),
o AS (SELECT id FROM ids WHERE keyword <> 'es' GROUP BY id), n AS (SELECT id, max(row_id) AS row_id FROM ids WHERE source <> 'src7' GROUP BY id)"""


@query(S.with_news(_SNAP) + "SELECT id, row_id FROM n")
def keyed_last_wins(spark, sf):
    return _old_and_new(spark, sf)[1].select("id", "row_id")


@query(
    S.with_news(_SNAP)
    + """SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM o)) AS inserted,
  (SELECT count(*) FROM n WHERE id IN (SELECT id FROM o)) AS updated, (SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM n)) AS deleted"""
)
def snapshot_replacement(spark, sf):
    return snapshot.replacement_counts(*_old_and_new(spark, sf))


@query(S.with_news(_SNAP) + "SELECT id FROM o EXCEPT SELECT id FROM n")
def stale_ids(spark, sf):
    return snapshot.stale_ids(*_old_and_new(spark, sf))


@query(
    S.with_news(S.rule_cte(EVENTS, "news", "event_category"))
    + f"""SELECT row_id, {joined_list("list_filter(matched_keywords, lambda w: w IN ('hable', 'étion', 'nicht'))")} AS shared,
  {joined_list("matched_keywords")} AS ordered_distinct FROM classified WHERE matched"""
)
def small_sets(spark, sf):
    """Intersection with a fixed word set, and first-occurrence distinct."""
    rows = classify.classify(news(spark, sf), EVENTS, F.col("event_category"))
    found = F.col("classification")["matched_keywords"]
    fixed = F.array(*[F.lit(w) for w in ("hable", "étion", "nicht")])
    return rows.filter("classification.matched").select(
        "row_id", F.array_join(F.array_intersect(found, fixed), ",").alias("shared"),
        F.array_join(F.array_distinct(found), ",").alias("ordered_distinct"),
    )


# --- scalar functions ----------------------------------------------------------------------------


@query(f"SELECT page_id, {S.clean('html')} AS cleaned FROM pages")
def clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query(f"SELECT page_id, {S.link_key('url')} AS link_key FROM pages")
def link_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.link_key(F.col("url")).alias("link_key"))


@query(f"SELECT page_id, {S.text_key('html')} AS text_key FROM pages")
def text_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.text_key(F.col("html")).alias("text_key"))


@query(
    S.with_wire()
    + f"SELECT row_id, {S.title_key('title')} AS title_key FROM wire UNION ALL SELECT -doc_id - 1, {S.title_key('text')} FROM documents"
)
def title_keys(spark, sf):
    docs = table(spark, sf, "documents").select((-F.col("doc_id") - 1).alias("row_id"), F.col("text").alias("title"))
    rows = wire(spark, sf).select("row_id", "title").unionAll(docs)
    return rows.select("row_id", text.title_key(F.col("title")).alias("title_key"))


@query(
    S.with_news(
        f"k AS (SELECT row_id, {S.title_key('title')} AS k FROM news)",
        """b AS (SELECT row_id, k, CASE WHEN length(k) = 0 THEN []::VARCHAR[] WHEN length(k) = 1 THEN [k]
  ELSE list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) END AS g FROM k)""",
    )
    + "SELECT row_id, len(g) AS pieces, list_aggregate(list_sort(g), 'string_agg', ' ') AS joined FROM b WHERE len(g) > 0"
)
def title_bigrams(spark, sf):
    grams = text.bigram_set(text.title_key(F.col("title")))
    rows = news(spark, sf).select("row_id", grams.alias("g")).filter(F.size("g") > 0)
    return rows.select("row_id", F.size("g").alias("pieces"), F.array_join(F.array_sort("g"), " ").alias("joined"))


@query(S.with_news() + f"SELECT row_id, {_ID} AS id, substr(sha1(link), 1, 16) AS link_hash FROM news")
def row_identities(spark, sf):
    return news(spark, sf).select("row_id", ids.row_key().alias("id"), ids.link_hash(F.col("link")).alias("link_hash"))


@query(S.with_news() + f"SELECT row_id, {S.stamp(S.publish_ts())} AS publish_ts FROM news")
def publish_times(spark, sf):
    ts = times.publish_ts(F.col("publish_time"))
    return news(spark, sf).select("row_id", F.date_format(ts, times.PRINT_FORMAT).alias("publish_ts"))


@query(
    S.with_news()
    + f"""SELECT row_id, CASE WHEN publish_time = '' THEN '无' ELSE {S.stamp(S.publish_ts() + " + INTERVAL 8 HOUR")} || ' UTC+8' END AS shown,
  CASE WHEN fetched_at = '' THEN '无' ELSE {S.stamp("try_cast(fetched_at AS TIMESTAMP) + INTERVAL 8 HOUR")} END AS fetched FROM news"""
)
def utc8_times(spark, sf):
    return news(spark, sf).select(
        "row_id", times.format_utc8(F.col("publish_time")).alias("shown"),
        times.format_utc8(F.col("fetched_at"), suffix=False).alias("fetched"),
    )


@query(
    f"""SELECT doc_id, {joined_list("list_filter(list_transform(regexp_split_to_array(text, '[,，]'), lambda s: regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda s: s <> '')", "|")} AS parts FROM documents"""
)
def keyword_lists(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.split_keywords(F.col("text")), "|").alias("parts"))


@query(S.with_news() + f"SELECT row_id, {S.fold('title')} AS title, '' AS summary, {S.fold('content')} AS content FROM (SELECT row_id, regexp_replace(title, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS title, regexp_replace(content, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS content FROM news)")
def field_texts(spark, sf):
    rows = news(spark, sf)
    return rows.select("row_id", classify.field_texts(rows).alias("t")).select("row_id", "t.*")


# --- classification ------------------------------------------------------------------------------

_CLASSIFIED = f"""row_id, matched::INTEGER AS matched, round(score, 6) AS score, round(CASE WHEN matched THEN confidence ELSE 0 END, 6) AS confidence,
  {joined_list("matched_keywords")} AS words, rule_reason"""


def _flat_classification(rows: DataFrame) -> DataFrame:
    c = F.col("classification")
    return rows.select(
        "row_id", as_int(c["matched"]).alias("matched"), F.round(c["score"], 6).alias("score"),
        F.round(c["confidence"], 6).alias("confidence"), F.array_join(c["matched_keywords"], ",").alias("words"),
        c["reason"].alias("rule_reason"),
    )


@query(S.with_news(S.rule_cte(EVENTS, "news", "event_category")) + f"SELECT {_CLASSIFIED} FROM classified")
def classify_rows(spark, sf):
    return _flat_classification(classify.classify(news(spark, sf), EVENTS, F.col("event_category")))


def _every_category(rules, source: str) -> str:
    cats = ", ".join(f"({S.quote(c)})" for c in rules.categories)
    return f"(SELECT * FROM {source}, (VALUES {cats}) c(cat))"


@query(
    S.with_news(S.rule_cte(EVENTS, _every_category(EVENTS, "news"), "cat"))
    + f"SELECT row_id, cat AS category, round(score, 6) AS score, {joined_list('matched_keywords')} AS words FROM classified WHERE matched"
)
def classify_all_categories(spark, sf):
    c = F.col("classification")
    return classify.classify_all(news(spark, sf), EVENTS).select(
        "row_id", c["category"].alias("category"), F.round(c["score"], 6).alias("score"),
        F.array_join(c["matched_keywords"], ",").alias("words"),
    )


@query(
    S.with_wire(
        S.rule_cte(
            refresh.RuleSet.events(), _every_category(refresh.RuleSet.events(), "wire"), "cat",
            text=S.fold("CASE WHEN content = '' THEN title ELSE title || ' ' || content END"),
        )
    )
    + f"SELECT row_id, cat AS category, round(score, 6) AS score, {joined_list('matched_keywords')} AS words FROM classified WHERE matched"
)
def classify_wire_builtin_rules(spark, sf):
    c = F.col("classification")
    return classify.classify_all(wire(spark, sf), refresh.RuleSet.events()).select(
        "row_id", c["category"].alias("category"), F.round(c["score"], 6).alias("score"),
        F.array_join(c["matched_keywords"], ",").alias("words"),
    )


_RULE_WORDS = "(VALUES " + ", ".join(
    f"({S.quote(c)}, {i}, {S.quote(w)})" for c, ws in EVENTS.keywords().items() for i, w in enumerate(ws)
) + ") k(category, keyword_pos, keyword)"


@query(
    f"SELECT category, keyword_pos::INTEGER AS keyword_pos, keyword, (SELECT count(*) FROM documents WHERE contains({S.fold('text')}, {S.fold('keyword')})) AS found FROM {_RULE_WORDS}"
)
def rule_keywords(spark, sf):
    """Search keywords of the rules, and how many documents contain each."""
    asked = fanout.keyword_table(spark, [], EVENTS)
    docs = table(spark, sf, "documents").select(F.lit("").alias("title"), F.col("text").alias("content"))
    words = [w for ws in EVENTS.keywords().values() for w in ws]
    found = feeds.match_keywords(docs, words).groupBy("keyword").agg(F.count("*").alias("found"))
    return asked.join(found, "keyword", "left").select(
        F.col("name").alias("category"), "keyword_pos", "keyword", F.coalesce("found", F.lit(0)).alias("found")
    )


# --- scoring -------------------------------------------------------------------------------------


def _flat_analysis(rows: DataFrame) -> DataFrame:
    a = F.col("analysis")
    return rows.select(
        "row_id", a["sentiment"].alias("sentiment"), a["impact_level"].alias("impact_level"),
        a["reason"].alias("analysis_reason"), a["confidence"].alias("confidence"), as_int(a["divergent"]).alias("divergent"),
        pairs_text(a["sector_assessments"]).alias("assessments"), F.array_join(a["macro_rules"], "|").alias("macro_rules"),
        a["category"].alias("category"), F.round(a["importance"], 6).alias("importance"),
    )


_ANALYSIS = f"""row_id, sentiment, impact_level, analysis_reason, confidence, divergent::INTEGER AS divergent,
  {PAIRS_SQL.format("assessed")} AS assessments, {joined_list("list_transform(macro, lambda r: r.name)", "|")} AS macro_rules,
  category, round(importance, 6) AS importance"""


@query(S.with_news(S.score(LEXICON)) + f"SELECT {_ANALYSIS} FROM scored")
def score_news(spark, sf):
    return _flat_analysis(scored_news(spark, sf))


@query(S.with_wire(S.score(score.Lexicon(), "wire")) + f"SELECT {_ANALYSIS} FROM scored")
def score_wire_builtin_lexicon(spark, sf):
    return _flat_analysis(score.analyse(wire(spark, sf)))


@query(
    S.with_news(S.score(LEXICON))
    + f"""SELECT row_id, round(coalesce(list_sum(list_transform(pos, lambda s: s.weight)), 0), 6) AS positive_score,
  round(coalesce(list_sum(list_transform(neg, lambda s: s.weight)), 0), 6) AS negative_score,
  {joined_list("list_transform(pos, lambda s: s.word)")} AS positive_words, g_sent AS sentiment, g_reason AS generic_reason FROM scored"""
)
def signal_direction(spark, sf):
    rows = news(spark, sf)
    folded = text.fold(F.concat_ws(" ", "title", "content"))
    hits = text.let(folded, lambda t: score.words_in(t, LEXICON.vocabulary()))
    found = rows.select("row_id", hits.alias("hits"))
    found = found.select(
        "row_id", score.signals(F.col("hits"), LEXICON.positive).alias("pos"),
        score.signals(F.col("hits"), LEXICON.negative).alias("neg"),
    )
    generic = score.generic_direction(F.col("pos"), F.col("neg"))
    return found.select(
        "row_id", F.round(score.total_weight(F.col("pos")), 6).alias("positive_score"),
        F.round(score.total_weight(F.col("neg")), 6).alias("negative_score"),
        F.array_join(F.transform("pos", lambda s: s["word"]), ",").alias("positive_words"),
        generic["sentiment"].alias("sentiment"), generic["reason"].alias("generic_reason"),
    )


@query(
    S.with_news(S.score(LEXICON))
    + """SELECT m.name AS macro_rule, a.sector, count(*) AS rows_hit, count(*) FILTER (WHERE list_filter(named, lambda x: x.sector = a.sector)[1].reason = a.reason) AS rows_won
FROM (SELECT row_id, named, unnest(macro) AS m FROM scored) x, unnest(m.sectors) t(a) GROUP BY ALL"""
)
def macro_first_wins(spark, sf):
    """How often each macro rule names a sector, and how often it is the first to do so."""
    folded = text.fold(F.concat_ws(" ", "title", "content"))
    hits = text.let(folded, lambda t: score.words_in(t, LEXICON.vocabulary()))
    found = schema.evaluate_once(news(spark, sf), macro=score.macro_hits(hits, LEXICON.macro))
    named = found.select(
        F.explode("macro").alias("m"),
        F.flatten(F.transform("macro", lambda r: r["sectors"])).alias("named"),
    ).select(F.col("m")["name"].alias("macro_rule"), "named", F.explode(F.col("m")["sectors"]).alias("a"))
    first = F.element_at(F.filter("named", lambda x: x["sector"] == F.col("a")["sector"]), 1)
    return named.groupBy("macro_rule", F.col("a")["sector"].alias("sector")).agg(
        F.count("*").alias("rows_hit"), F.count_if(first["reason"] == F.col("a")["reason"]).alias("rows_won")
    )


# --- verdicts ------------------------------------------------------------------------------------

_RULES = refresh.RuleSet.events()


def _wire_events(spark, sf):
    """Event rows of the wire, plus its dollar and Apple talk under the gated categories."""
    rows = filters.event_rows(wire(spark, sf))
    return classify.classify(rows, _RULES, F.col("event_category"))


_WIRE_CLASSIFIED = S.rule_cte(
    _RULES, f"(SELECT * FROM wire WHERE {S.IS_EVENT})", "event_category",
    text=S.fold("CASE WHEN content = '' THEN title ELSE title || ' ' || content END"),
)
_GATE = """matched AND ((event_category = '美联储/利率' AND confidence < 0.75)
  OR (event_category = '美联储/利率' AND list_has_any(matched_keywords, ['美元', '利率', 'Apple', 'Pro', 'Vision'])) OR score <= 1.25)"""


@query(
    S.with_wire(_WIRE_CLASSIFIED)
    + f"""SELECT row_id, ({_GATE})::INTEGER AS gated, round(score, 6) AS score, (confidence < 0.75 OR score <= 1.25)::INTEGER AS drop_on_failure
FROM classified WHERE matched"""
)
def verdict_gate(spark, sf):
    rows = _wire_events(spark, sf).filter("classification.matched")
    proof = verdicts.evidence()
    return rows.select(
        "row_id", as_int(verdicts.needs_verdict()).alias("gated"), F.round(proof["score"], 6).alias("score"),
        as_int(proof["shouldDropOnFailure"]).alias("drop_on_failure"),
    )


@query(
    S.with_wire(_WIRE_CLASSIFIED)
    + f"""SELECT category, count(*) AS requests FROM (SELECT DISTINCT event_category AS category, title, link, content
FROM classified WHERE {_GATE}) GROUP BY 1"""
)
def verdict_requests(spark, sf):
    asked = verdicts.requests(_wire_events(spark, sf))
    return asked.groupBy("category").agg(F.count("*").alias("requests"))


def _verdict_table(spark, sf, rows: DataFrame) -> DataFrame:
    """Verdicts out of the labels: quality says keep, toxicity breaks the answer."""
    keyed = verdicts.with_key(rows.filter(verdicts.needs_verdict()))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    raw = F.when(F.col("toxic") == 1, F.lit("{broken")).otherwise(
        F.to_json(
            F.struct(
                (F.col("quality") == 1).alias("shouldKeep"),
                F.when(F.col("row_id") % 7 == 0, "other").otherwise(F.col("event_category")).alias("category"),
                F.lit(0.9).alias("confidence"),
                F.lit("ok").alias("reason"),
            )
        )
    )
    return keyed.join(labels, "row_id").select("validation_key", raw.alias("raw"), F.lit(None).cast("string").alias("error"))


@query(
    S.with_wire(
        _WIRE_CLASSIFIED,
        f"v AS (SELECT c.*, ({_GATE}) AS gated, l.quality, l.toxic FROM classified c LEFT JOIN labels l ON l.doc_id = c.row_id WHERE matched)",
    )
    + """SELECT row_id FROM v WHERE NOT gated OR CASE WHEN quality IS NULL OR toxic = 1 THEN NOT (confidence < 0.75 OR score <= 1.25)
  ELSE quality = 1 AND row_id % 7 <> 0 END"""
)
def verdict_filter(spark, sf):
    rows = _wire_events(spark, sf)
    return verdicts.apply_verdicts(rows, _verdict_table(spark, sf, rows)).select("row_id")


def _judged_event_rows(spark, sf):
    """Event rows of the wire with their verdicts."""
    rows = _wire_events(spark, sf)
    return filters.event_rows(wire(spark, sf)), _verdict_table(spark, sf, rows)


@query(
    S.with_wire(
        _WIRE_CLASSIFIED,
        f"v AS (SELECT c.*, ({_GATE}) AS gated, l.quality, l.toxic FROM classified c LEFT JOIN labels l ON l.doc_id = c.row_id)",
        """k AS (SELECT event_category AS name, CASE WHEN NOT matched THEN false WHEN NOT gated THEN true
  WHEN quality IS NULL OR toxic = 1 THEN NOT (confidence < 0.75 OR score <= 1.25) ELSE quality = 1 AND row_id % 7 <> 0 END AS keep FROM v)""",
    )
    + """SELECT 'event' AS scope, name, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS dropped
FROM k GROUP BY ALL"""
)
def refilter_verdict_counts(spark, sf):
    """Kept and dropped rows of every category, with the verdicts on doubtful ones."""
    rows, answers = _judged_event_rows(spark, sf)
    return refilter.refilter_counts(rows, _RULES, SECTORS, verdicts=answers)


_RAW_VERDICT_SQL = """SELECT doc_id, CASE doc_id % 6
  WHEN 1 THEN '{"shouldKeep": "true", "category": "c", "confidence": 0.5, "reason": "r"}'
  WHEN 2 THEN '{"shouldKeep": true, "category": ' || doc_id || ', "confidence": 0.5, "reason": "r"}'
  WHEN 3 THEN '{"shouldKeep": true, "category": "c", "confidence": ' || (doc_id % 5) || ', "reason": "r"}'
  WHEN 4 THEN '{"shouldKeep": true, "category": "c", "confidence": 0.5}'
  WHEN 5 THEN '{broken'
  ELSE '{"shouldKeep": ' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || ', "category": " c' || (doc_id % 4)
    || ' ", "confidence": 0.' || (doc_id % 9 + 1) || ', "reason": "ok"}' END AS raw FROM labels"""


@query(
    f"""WITH raws AS ({_RAW_VERDICT_SQL}),
typed AS (SELECT doc_id, raw, coalesce(CASE WHEN json_valid(raw) THEN json_type(raw, '$.shouldKeep') = 'BOOLEAN'
  AND json_type(raw, '$.category') = 'VARCHAR' AND json_type(raw, '$.reason') = 'VARCHAR'
  AND json_type(raw, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
  AND CAST(json_extract_string(raw, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1 END, false) AS valid FROM raws)
SELECT doc_id, valid::INTEGER AS valid, CASE WHEN valid THEN (json_extract_string(raw, '$.shouldKeep') = 'true')::INTEGER END AS should_keep,
  CASE WHEN valid THEN trim(json_extract_string(raw, '$.category')) END AS category,
  CASE WHEN valid THEN CAST(json_extract_string(raw, '$.confidence') AS DOUBLE) END AS confidence FROM typed"""
)
def verdict_parsing(spark, sf):
    """Answers with wrong types, missing fields, odd numbers or no JSON, parsed strictly."""
    table(spark, sf, "labels").createOrReplaceTempView("labels")
    parsed = spark.sql(_RAW_VERDICT_SQL).select("doc_id", verdicts.parse_verdict(F.col("raw")).alias("v"))
    return parsed.select(
        "doc_id", as_int("v.valid").alias("valid"), as_int("v.should_keep").alias("should_keep"), "v.category", "v.confidence"
    )


# --- plans ---------------------------------------------------------------------------------------

def _config(fuzzy: bool) -> refresh.Config:
    return _TestConfig(SECTORS, EVENTS, MAPPING, fuzzy=fuzzy)


class _TestConfig(refresh.Config):
    """Rules of the test language, including the stricter family."""

    def refilter(self, df):
        return refilter.refilter(df, self.events, self.sectors, self.verdicts, FAMILIES)


_KEPT_OLD = """held AS (SELECT n.* FROM news n JOIN kept k USING (row_id) WHERE k.keep AND n.keyword <> 'fr'),
hl AS (SELECT DISTINCT {lk} AS lk FROM held),
fetched AS (SELECT n.*, {lk} AS lk FROM news n WHERE keyword = 'fr'),
unseen AS (SELECT * FROM fetched WHERE lk = '' OR lk NOT IN (SELECT lk FROM hl WHERE lk <> ''))""".format(lk=S.link_key("link"))


_REFRESHED = (
    *_MARK_SQL,
    _KEPT_OLD,
    S.greedy("held", S.SCOPE, S.NEWEST_FIRST, S.news_keys(), "g1"),
    f"""both_rows AS (SELECT h.row_id, h.row_id AS old_id, {", ".join("h." + c for c in schema.NEWS_COLUMNS)} FROM held h JOIN g1 USING (row_id) WHERE keep
  UNION ALL SELECT (SELECT max(row_id) + 1 FROM held) + row_id, row_id, {NEWS_COLS} FROM unseen)""",
    S.greedy("both_rows", S.SCOPE, S.NEWEST_FIRST, S.news_keys(), "g2"),
    f"""final AS (SELECT b.*, {S.publish_ts("b.publish_time")} AS p, try_cast(b.fetched_at AS TIMESTAMP) AS f
  FROM both_rows b JOIN g2 USING (row_id) JOIN kept k ON k.row_id = b.old_id WHERE g2.keep AND k.keep)""",
)
_OLD_FIRST, _OLD_REST = _KEPT_OLD.split(",\n", 1)
_DELTA = (
    *_MARK_SQL,
    _OLD_FIRST.replace("held AS", "loaded AS"),
    S.greedy("loaded", S.SCOPE, S.NEWEST_FIRST, S.news_keys(), "g1"),
    "held AS (SELECT l.* FROM loaded l JOIN g1 USING (row_id) WHERE keep)",
    _OLD_REST,
    f"""both_rows AS (SELECT row_id, row_id AS old_id, {NEWS_COLS} FROM held
  UNION ALL SELECT (SELECT max(row_id) + 1 FROM held) + row_id, row_id, {NEWS_COLS} FROM unseen)""",
    *_REFRESHED[-2:],
)
_RECENT = f"(p >= {S.NOW} - INTERVAL 10 DAY OR (p IS NULL AND (f IS NULL OR f >= {S.NOW} - INTERVAL 10 DAY)))"


@query(
    S.with_news(*_REFRESHED, recursive=True)
    + f"SELECT row_id, title, sector, event_category FROM final WHERE {_RECENT}"
)
def incremental_refresh_exact(spark, sf):
    rows = news(spark, sf)
    old, fetched = rows.filter(F.col("keyword") != "fr"), rows.filter(F.col("keyword") == "fr")
    done = refresh.incremental_refresh(old, fetched, _config(False), AS_OF, 10)
    return done.table.select("row_id", "title", "sector", "event_category")


@query(
    S.with_news(*_REFRESHED, recursive=True)
    + f"""SELECT greatest(count(*) - (SELECT count(*) FROM held), 0) AS added,
  count(*) - count(*) FILTER (WHERE {_RECENT}) AS pruned, count(*) FILTER (WHERE {_RECENT}) AS total FROM final"""
)
def incremental_counts_exact(spark, sf):
    rows = news(spark, sf)
    old, fetched = rows.filter(F.col("keyword") != "fr"), rows.filter(F.col("keyword") == "fr")
    return refresh.incremental_refresh(old, fetched, _config(False), AS_OF, 10).counts


@query(
    S.with_news(*_DELTA, recursive=True)
    + f"SELECT row_id, title, sector, event_category, CAST(CAST(p AS DATE) AS VARCHAR) AS publish_date FROM final WHERE {_RECENT}"
)
def delta_refresh_exact(spark, sf):
    """A batch merged into a stored table of date partitions; read back from its files."""
    rows = news(spark, sf)
    old, fetched = rows.filter(F.col("keyword") != "fr"), rows.filter(F.col("keyword") == "fr")
    ensure_checkpoint_dir(spark)
    table = NewsTable(spark, f"{spark.sparkContext.getCheckpointDir()}/news-{uuid.uuid4().hex}")
    refresh.load_table(table, old, _config(False))
    refresh.delta_refresh(table, fetched, _config(False), AS_OF, 10, batch=1)
    day = F.col("publish_date").cast("string").alias("publish_date")
    return table.read().select("row_id", "title", "sector", "event_category", day)


@query()
def incremental_refresh_counts(spark, sf):
    rows = news(spark, sf)
    old, fetched = rows.filter(F.col("keyword") != "fr"), rows.filter(F.col("keyword") == "fr")
    return refresh.incremental_refresh(old, fetched, _config(True), AS_OF, 10).counts


@query(
    S.with_news(*_MARK_SQL, _greedy_news(), recursive=True)
    + f"""SELECT row_id FROM ({_RETAIN.format("*")}) n JOIN kept k USING (row_id) JOIN greedy g USING (row_id) WHERE k.keep AND g.keep"""
)
def full_refresh_exact(spark, sf):
    return refresh.full_refresh(news(spark, sf), _config(False), AS_OF, 10).select("row_id")


@query()
def ingest_all_sources(spark, sf):
    """Keyword hits of all sectors and categories: fan-out, de-duplication, rules, annotation."""
    raw = _chosen(spark, sf)
    rows = refresh.ingest(raw, _config(True), "2024-01-20T00:00:00Z")
    return rows.select("news_type", "sector", "event_category", "title", "link", "keyword", "related_sectors")


@query(
    S.with_news(
        *_MARK_SQL,
        "held AS (SELECT n.* FROM news n JOIN kept k USING (row_id) WHERE k.keep)",
        S.greedy("held", S.SCOPE, S.NEWEST_FIRST, S.news_keys()),
        "shown AS (SELECT h.* FROM held h JOIN greedy g USING (row_id) WHERE g.keep)",
        S.score(LEXICON, "shown"),
        recursive=True,
    )
    + f"SELECT {_ANALYSIS} FROM scored"
)
def display_exact(spark, sf):
    return _flat_analysis(display_plan.display(news(spark, sf), _config(False), LEXICON).rows)


@query()
def display_fuzzy(spark, sf):
    return _flat_analysis(display_plan.display(news(spark, sf), _config(True), LEXICON).rows)

