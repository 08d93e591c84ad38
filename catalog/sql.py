"""SQL fragments (DuckDB) the oracles are made of."""

from __future__ import annotations

from catalog.views import AS_OF, NEWS_SQL, WIRE_SQL
from sectorpulse.functions.text import fold_word
from sectorpulse.operators.score import Lexicon
from sectorpulse.rules import defaults
from sectorpulse.rules.tables import RuleSet

NOW = f"TIMESTAMP '{AS_OF}'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]::VARCHAR[]"


def fold(x: str) -> str:
    """Enough folding for the given tables: ß is their only character that folds further."""
    return f"replace(lower({x}), 'ß', 'ss')"


def clean(x: str) -> str:
    """Enough unescaping for the given tables' entities."""
    text = f"coalesce({x}, '')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, '{entity}', '{char}')"
    text = f"regexp_replace({text}, '&amp;?', '&', 'g')"
    for tag in ("<em>", "</em>", "<span>", "</span>"):
        text = f"replace({text}, '{tag}', '')"
    return f"trim(regexp_replace({text}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def text_key(x: str) -> str:
    return f"regexp_replace(regexp_replace({fold(clean(x))}, '<[^>]+>', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def title_key(x: str) -> str:
    moves = (
        "(?:上涨|下跌|涨近|涨超|涨逾|跌近|跌超|跌逾|大涨|大跌|拉升|跳水|走强|走弱|涨|跌)"
        "\\s*[+-]?\\p{Nd}+(?:\\.\\p{Nd}+)?\\s*(?:%|％|个百分点|点)?"
    )
    percent = "[+-]?\\p{Nd}+(?:\\.\\p{Nd}+)?\\s*(?:%|％|个百分点)"
    text = f"regexp_replace({fold(clean(x))}, '<[^>]+>', '', 'g')"
    text = f"regexp_replace({text}, '{moves}', '', 'g')"
    text = f"regexp_replace({text}, '{percent}', '', 'g')"
    for word in ("最新", "突发", "快讯", "午评", "盘中", "异动", "拉升", "走强", "跳水"):
        text = f"replace({text}, '{word}', '')"
    return f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def link_key(x: str) -> str:
    link = clean(x)
    whole = "^([A-Za-z][A-Za-z0-9+.\\-]*:)?(//[^/?#]*)?([^?#]*)"
    return (
        f"lower(regexp_extract({link}, '{whole}', 1)) || lower(regexp_extract({link}, '{whole}', 2))"
        f" || rtrim(regexp_extract({link}, '{whole}', 3), '/')"
    )


def publish_ts(x: str = "publish_time") -> str:
    return f"coalesce(try_cast({x} AS TIMESTAMP), try_strptime({x}, '%Y/%m/%d %H:%M:%S'))"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


IS_EVENT = "(news_type = 'external_event')"
SCOPE = f"({IS_EVENT}::VARCHAR || '|' || CASE WHEN {IS_EVENT} THEN '' ELSE sector END)"
TARGETS = (
    f"CASE WHEN {IS_EVENT} THEN CASE WHEN trim(related_sectors) = '未映射' THEN []::VARCHAR[] ELSE "
    "list_filter(list_transform(string_split(replace(related_sectors, '，', '、'), '、'), lambda s: trim(s)),"
    " lambda s: s <> '') END ELSE CASE WHEN trim(sector) <> '' THEN [trim(sector)] ELSE []::VARCHAR[] END END"
)


def _entry(word: str, weight: float) -> str:
    return f"{{'word': {quote(word)}, 'folded': {quote(fold_word(word))}, 'weight': {weight}::DOUBLE}}"


def _macro(rule) -> str:
    name, keywords, co, sectors = rule
    listed = ", ".join(
        f"{{'sector': {quote(s)}, 'sentiment': {quote(d)}, 'reason': {quote(r)}}}" for s, d, r in sectors
    )
    return (
        f"{{'name': {quote(name)}, 'keywords': {words(map(fold_word, keywords))}, "
        f"'co': {words(map(fold_word, co))}, 'sectors': [{listed}]}}"
    )


def score(lexicon: Lexicon, source: str = "news") -> str:
    """CTEs ending in ``scored``: the source's columns plus the analysis fields."""

    def has(name: str) -> str:
        return f"list_has_any(hits, {words(map(fold_word, lexicon.words[name]))})"

    def listed(signals: dict) -> str:
        return "[" + ", ".join(_entry(w, x) for w, x in signals.items()) + "]"

    def total(name: str) -> str:
        return f"coalesce(list_sum(list_transform({name}, lambda s: s.weight)), 0)"

    def reason(prefix: str, name: str) -> str:
        return f"'{prefix}' || array_to_string(list_transform({name}[1:4], lambda s: s.word), '、')"

    low = defaults.LOW_CONFIDENCE_REASON
    return f"""
s1 AS (SELECT *, {fold("title || ' ' || content")} AS folded_text, {TARGETS} AS targets FROM {source}),
s2 AS (SELECT *, list_filter({words(lexicon.vocabulary())}, lambda w: contains(folded_text, w)) AS hits FROM s1),
s3 AS (SELECT *, list_filter({listed(lexicon.positive)}, lambda s: list_contains(hits, s.folded)) AS pos,
  list_filter({listed(lexicon.negative)}, lambda s: list_contains(hits, s.folded)) AS neg,
  list_filter([{", ".join(_macro(r) for r in lexicon.macro)}],
    lambda r: list_has_any(hits, r.keywords) AND (len(r.co) = 0 OR list_has_any(hits, r.co))) AS macro FROM s2),
s4 AS (SELECT *, {total("pos")} - {total("neg")} AS balance FROM s3),
s5 AS (SELECT *, CASE WHEN balance >= 1 THEN 'positive' WHEN balance <= -1 THEN 'negative' ELSE 'neutral' END AS g_sent,
  CASE WHEN balance >= 1 THEN {reason(defaults.POSITIVE_PREFIX, "pos")}
       WHEN balance <= -1 THEN {reason(defaults.NEGATIVE_PREFIX, "neg")} ELSE '{low}' END AS g_reason,
  flatten(list_transform(macro, lambda r: r.sectors)) AS named FROM s4),
s6 AS (SELECT *, list_transform(targets, lambda t: coalesce(list_filter(named, lambda a: a.sector = t)[1],
    {{'sector': t, 'sentiment': g_sent, 'reason': g_reason}})) AS assessed FROM s5),
s7 AS (SELECT *, list_filter(assessed, lambda a: a.sentiment = 'positive') AS ups,
  list_filter(assessed, lambda a: a.sentiment = 'negative') AS downs,
  least(90, 20 + 20 * (len(pos) + len(neg) + 2 * len(macro)))::INTEGER AS confidence FROM s6),
s8 AS (SELECT *, len(ups) > 0 AND len(downs) > 0 AS divergent,
  CASE WHEN len(ups) > 0 AND len(downs) > 0 THEN 'neutral' WHEN len(ups) > 0 THEN 'positive'
       WHEN len(downs) > 0 THEN 'negative' WHEN len(assessed) > 0 THEN 'neutral' ELSE g_sent END AS o_sent,
  CASE WHEN len(ups) > 0 AND len(downs) > 0 THEN '{defaults.DIVERGENT_REASON}' WHEN len(ups) > 0 THEN ups[1].reason
       WHEN len(downs) > 0 THEN downs[1].reason WHEN len(assessed) > 0 THEN assessed[1].reason ELSE g_reason END AS o_reason,
  CASE WHEN {has("high")} THEN 'high' WHEN len(macro) > 0 OR abs(balance) >= 2 OR {has("medium")} THEN 'medium'
       ELSE 'low' END AS impact_level,
  CASE WHEN {has("policy")} THEN 'policy' WHEN {has("industry")} THEN 'industry'
       WHEN {has("stock_move")} THEN 'stock_move' ELSE 'general' END AS category FROM s7),
scored AS (SELECT *, CASE WHEN o_sent <> 'neutral' AND confidence < 45 THEN 'neutral' ELSE o_sent END AS sentiment,
  CASE WHEN o_sent <> 'neutral' AND confidence < 45 THEN '{low}' ELSE o_reason END AS analysis_reason,
  CASE category WHEN 'policy' THEN 6.0::DOUBLE WHEN 'industry' THEN 4.0::DOUBLE WHEN 'stock_move' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END
  + CASE impact_level WHEN 'high' THEN 3.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
  + confidence / 100.0::DOUBLE AS importance FROM s8)"""


def rule_cte(rules: RuleSet, source: str, category: str, name: str = "classified", text: str | None = None) -> str:
    """CTE: the source's columns plus matched, score, confidence, matched_keywords, rule_reason."""
    body = text or fold("trim(title) || ' ' || trim(content)")
    scores, found = [], []
    for cat, listed in rules.categories.items():
        for rule in listed:
            hits = f"list_filter({words(rule.positive)}, lambda w: contains(folded_text, {fold('w')}))"
            any_neg = " OR ".join(f"contains(folded_text, {quote(fold_word(w))})" for w in rule.negative) or "false"
            any_co = " OR ".join(f"contains(folded_text, {quote(fold_word(w))})" for w in rule.co) or "true"
            counted = (
                f"{category} = {quote(cat)} AND NOT ({any_neg}) AND ({any_co}) "
                f"AND len({hits}) * {rule.weight} >= {rule.min_score}"
            )
            scores.append(f"CASE WHEN {counted} THEN (len({hits}) * {rule.weight})::DOUBLE ELSE 0 END")
            found.append(f"CASE WHEN {counted} THEN {hits} ELSE []::VARCHAR[] END")
    return f"""
{name}_0 AS (SELECT *, {body} AS folded_text FROM {source}),
{name}_1 AS (SELECT *, {" + ".join(scores)} AS score, flatten([{", ".join(found)}]) AS found FROM {name}_0),
{name}_2 AS (SELECT *, list_filter(found, lambda w, i: list_position(found, w) = i) AS matched_keywords FROM {name}_1),
{name} AS (SELECT *, score > 0 AS matched, least(1.0, score / 2) AS confidence,
  CASE WHEN score > 0 THEN '{defaults.RULE_HIT_PREFIX}' || array_to_string(matched_keywords, ',') ELSE '' END AS rule_reason
  FROM {name}_2)"""


def greedy(rows: str, partition: str, order: str, keys: str, name: str = "greedy") -> str:
    """CTEs (recursive): sequential keep-first scan; ``name`` has row_id and keep.

    ``keys``: expression giving the list of a row's non-blank keys.
    """
    return f"""
{name}_r AS MATERIALIZED (SELECT row_id, {partition} AS p, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS rn,
  {keys} AS ks FROM {rows}),
{name} AS (
  SELECT p, rn, row_id, true AS keep, ks AS seen FROM {name}_r WHERE rn = 1
  UNION ALL
  SELECT r.p, r.rn, r.row_id, NOT list_has_any(g.seen, r.ks),
    CASE WHEN list_has_any(g.seen, r.ks) THEN g.seen ELSE list_concat(g.seen, r.ks) END
  FROM {name} g JOIN {name}_r r ON r.p = g.p AND r.rn = g.rn + 1)"""


NEWEST_FIRST = f"{publish_ts()} DESC NULLS LAST, publish_time DESC, row_id"
BY_IMPORTANCE = f"importance DESC, {publish_ts()} DESC NULLS LAST, row_id"


def news_keys(fragment: bool = False) -> str:
    pairs = [("L", link_key("link")), ("T", title_key("title")), ("C", text_key("content"))]
    listed = ", ".join(f"CASE WHEN {x} <> '' THEN '{k}' || md5({x}) END" for k, x in pairs)
    return f"list_filter([{listed}], lambda k: k IS NOT NULL)"


def with_news(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join([NEWS_SQL, *ctes]) + "\n"


def with_wire(*ctes: str) -> str:
    return "WITH " + ",".join([WIRE_SQL, *ctes]) + "\n"
