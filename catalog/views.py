"""News-shaped views over the given tables, in Spark and in DuckDB SQL.

``news``: every document is an article (first line its title, whole text its content), pages
supply links (four articles share one), events supply publish times in several formats.
``wire``: every event is a flash item whose sentences speak the built-in rule language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-20 12:00:00"
EVENT_SOURCES = ["src0", "src5", "src10", "src15"]
_EVENTS_SQL = "(" + ", ".join(f"'{s}'" for s in EVENT_SOURCES) + ")"


#: Bytes of a flash table's files for a task: each of its rows takes many times its reading.
WIRE_BYTES = 2 << 20


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Share out an input of fewer splits than cores (a small single file); larger inputs, which
    come in enough splits by themselves, are left alone. With ``task_bytes`` a task gets no more
    of the files than that, so that tasks grow in number and not in length."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if task_bytes is not None:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        wanted = max(wanted, int(str(size)) // task_bytes + 1)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by id once, which the join below needs anyhow; everything else is joined without the texts.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition("doc_id")
    keys = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").distinct().withColumns(
        {
            "page_id": F.floor(F.col("doc_id") / 4).cast("long"),
            "event_id": F.col("doc_id") * 10,
        }
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    joined = docs.join(keys.join(pages, "page_id", "left").join(events, "event_id", "left"), "doc_id", "left")
    is_event = F.col("source").isin(EVENT_SOURCES)
    kind, ts = F.col("event_type"), F.col("ts")
    when = (
        F.when(kind == "error", "")
        .when(kind == "click", F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(kind == "signup", F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("")))
    )
    related = (
        F.when(F.col("lang") == "en", "en、fr").when(F.col("lang") == "fr", "fr，de").otherwise("未映射")
    )
    fetched = F.date_format(ts + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return joined.select(
        F.col("doc_id").alias("row_id"),
        F.when(is_event, "external_event").otherwise("sector_news").alias("news_type"),
        F.when(is_event, "").otherwise(F.col("lang")).alias("sector"),
        F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        "source",
        when.alias("publish_time"),
        F.when(kind == "view", "").otherwise(F.coalesce("url", F.lit(""))).alias("link"),
        F.col("lang").alias("keyword"),
        F.col("text").alias("content"),
        F.when(is_event, F.concat(F.lit("cat_"), "lang")).otherwise("").alias("event_category"),
        F.when(is_event, related).otherwise("").alias("related_sectors"),
        F.lit("").alias("reason"),
        F.coalesce(fetched, F.lit("")).alias("fetched_at"),
    )


NEWS_SQL = f"""
news AS (
  SELECT d.doc_id AS row_id,
    CASE WHEN d.source IN {_EVENTS_SQL} THEN 'external_event' ELSE 'sector_news' END AS news_type,
    CASE WHEN d.source IN {_EVENTS_SQL} THEN '' ELSE d.lang END AS sector,
    trim(split_part(d.text, chr(10), 1)) AS title,
    d.source AS source,
    CASE WHEN e.event_type = 'error' THEN ''
         WHEN e.event_type = 'click' THEN strftime(e.ts, '%Y/%m/%d %H:%M:%S')
         WHEN e.event_type = 'signup' THEN strftime(e.ts, '%Y-%m-%d')
         ELSE coalesce(strftime(e.ts, '%Y-%m-%d %H:%M:%S'), '') END AS publish_time,
    CASE WHEN e.event_type = 'view' THEN '' ELSE coalesce(p.url, '') END AS link,
    d.lang AS keyword,
    d.text AS content,
    CASE WHEN d.source IN {_EVENTS_SQL} THEN 'cat_' || d.lang ELSE '' END AS event_category,
    CASE WHEN d.source IN {_EVENTS_SQL} THEN
      CASE d.lang WHEN 'en' THEN 'en、fr' WHEN 'fr' THEN 'fr，de' ELSE '未映射' END
      ELSE '' END AS related_sectors,
    '' AS reason,
    coalesce(strftime(e.ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ'), '') AS fetched_at
  FROM documents d
  LEFT JOIN pages p ON p.page_id = CAST(floor(d.doc_id / 4) AS BIGINT)
  LEFT JOIN events e ON e.event_id = d.doc_id * 10
)"""

_WIRE_TITLES = {
    "click": ("半导体板块盘中拉升，多股涨停 ", "%"),
    "view": ("国际油价大涨", "%，创阶段新高"),
    "signup": ("美联储宣布降息，流动性宽松", ""),
    "purchase": ("公司签订大额订单，全年业绩预增 ", "个百分点"),
    "error": ("美国宣布新一轮出口管制，多家企业列入实体清单", ""),
}


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), WIRE_BYTES)
    value = F.col("value")
    amount = value.cast("decimal(12,2)").cast("string")
    title = F.lit("")
    for kind, (before, after) in _WIRE_TITLES.items():
        middle = amount if after else F.lit("")
        title = F.when(F.col("event_type") == kind, F.concat(F.lit(before), middle, F.lit(after))).otherwise(title)
    content = (
        F.when(value < 15, "")
        .when(value < 35, "iPhone 砍单，苹果供应链需求疲软")
        .when(value < 70, "OPEC 减产推动原油价格上涨")
        .otherwise("工信部发布支持政策，国产替代提速，Vision Pro 供不应求")
    )
    is_event = F.col("event_type").isin("view", "signup")
    sector = (
        F.when(value < 20, "半导体芯片").when(value < 50, "黄金").when(value < 90, "石油石化").otherwise("银行")
    )
    category = F.when(F.col("event_type") == "view", "油价能源").otherwise("美联储/利率")
    related = F.when(F.col("event_type") == "view", "石油石化、化工、航运港口").otherwise("银行、证券、黄金、有色金属")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.when(is_event, "external_event").otherwise("sector_news").alias("news_type"),
        F.when(is_event, "").otherwise(sector).alias("sector"),
        title.alias("title"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("publish_time"),
        F.concat(F.lit("http://Wire.example.com/"), F.col("event_id").cast("string"), F.lit("/?s=1")).alias("link"),
        F.lit("wire").alias("keyword"),
        content.alias("content"),
        F.when(is_event, category).otherwise("").alias("event_category"),
        F.when(is_event, related).otherwise("").alias("related_sectors"),
        F.lit("").alias("reason"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
    )


def _wire_title_sql() -> str:
    amount = "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"
    cases = " ".join(
        f"WHEN '{kind}' THEN '{before}' || " + (f"{amount} || '{after}'" if after else "''")
        for kind, (before, after) in _WIRE_TITLES.items()
    )
    return f"CASE event_type {cases} ELSE '' END"


WIRE_SQL = f"""
wire AS (
  SELECT event_id AS row_id,
    CASE WHEN event_type IN ('view', 'signup') THEN 'external_event' ELSE 'sector_news' END AS news_type,
    CASE WHEN event_type IN ('view', 'signup') THEN ''
         WHEN value < 20 THEN '半导体芯片' WHEN value < 50 THEN '黄金'
         WHEN value < 90 THEN '石油石化' ELSE '银行' END AS sector,
    {_wire_title_sql()} AS title,
    'user' || CAST(user_id AS VARCHAR) AS source,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS publish_time,
    'http://Wire.example.com/' || CAST(event_id AS VARCHAR) || '/?s=1' AS link,
    'wire' AS keyword,
    CASE WHEN value < 15 THEN '' WHEN value < 35 THEN 'iPhone 砍单，苹果供应链需求疲软'
         WHEN value < 70 THEN 'OPEC 减产推动原油价格上涨'
         ELSE '工信部发布支持政策，国产替代提速，Vision Pro 供不应求' END AS content,
    CASE event_type WHEN 'view' THEN '油价能源' WHEN 'signup' THEN '美联储/利率' ELSE '' END AS event_category,
    CASE event_type WHEN 'view' THEN '石油石化、化工、航运港口'
                    WHEN 'signup' THEN '银行、证券、黄金、有色金属' ELSE '' END AS related_sectors,
    '' AS reason,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS fetched_at
  FROM events
)"""
