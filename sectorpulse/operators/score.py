"""Sentiment, impact and importance of news, as column expressions over the row's own text.

Map-only: one pass finds which lexicon words the text contains, everything after works on that
short list.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions.text import fold, fold_word, let, strip
from sectorpulse.rules import defaults
from sectorpulse.schema import UNMAPPED, evaluate_once, is_event

ANALYSIS = "analysis"


@dataclass(frozen=True)
class Lexicon:
    """Words that decide direction, impact and category; built-in ones by default."""

    positive: dict[str, float] = field(default_factory=lambda: defaults.POSITIVE_SIGNALS)
    negative: dict[str, float] = field(default_factory=lambda: defaults.NEGATIVE_SIGNALS)
    words: dict[str, list[str]] = field(default_factory=lambda: defaults.WORD_SETS)
    macro: list[tuple] = field(default_factory=lambda: defaults.MACRO_RULES)

    def vocabulary(self) -> list[str]:
        """Every distinct folded word; each is searched for once per text."""
        words = [*self.positive, *self.negative]
        words += [w for listed in self.words.values() for w in listed]
        words += [w for _, keywords, co, _ in self.macro for w in [*keywords, *co]]
        return list(dict.fromkeys(fold_word(w) for w in words))


def _constant(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def words_in(text: Column, words: list[str]) -> Column:
    """The (folded) words a folded text contains, in the given order."""
    return F.filter(_constant(words, "array<string>"), lambda w: F.contains(text, w))


def signals(hits: Column, lexicon: dict[str, float]) -> Column:
    """The lexicon entries (word, weight) among the words found, in lexicon order."""
    entries = [{"word": w, "folded": fold_word(w), "weight": x} for w, x in lexicon.items()]
    constant = _constant(entries, "array<struct<word:string,folded:string,weight:double>>")
    return F.filter(constant, lambda s: F.array_contains(hits, s["folded"]))


def total_weight(matched: Column) -> Column:
    return F.aggregate(matched, F.lit(0.0), lambda total, s: total + s["weight"])


def macro_hits(hits: Column, macro: list[tuple]) -> Column:
    """Macro rules with a keyword and, where they ask for one, a co-keyword among the hits."""
    records = [
        {
            "name": name,
            "keywords": [fold_word(w) for w in keywords],
            "co": [fold_word(w) for w in co],
            "sectors": [{"sector": s, "sentiment": d, "reason": r} for s, d, r in sectors],
        }
        for name, keywords, co, sectors in macro
    ]
    constant = _constant(
        records,
        "array<struct<name:string,keywords:array<string>,co:array<string>,"
        "sectors:array<struct<sector:string,sentiment:string,reason:string>>>>",
    )
    return F.filter(
        constant,
        lambda r: F.arrays_overlap(hits, r["keywords"])
        & ((F.size(r["co"]) == 0) | F.arrays_overlap(hits, r["co"])),
    )


def _has_any(hits: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(False)
    return F.arrays_overlap(hits, _constant([fold_word(w) for w in words], "array<string>"))


def target_sectors() -> Column:
    """Sectors a row speaks about: the related list of an event, else its own sector."""
    related = F.replace(F.coalesce(F.col("related_sectors"), F.lit("")), F.lit("，"), F.lit("、"))
    listed = F.filter(F.transform(F.split(related, "、"), lambda s: strip(s)), lambda s: s != "")
    none = F.array().cast("array<string>")
    own = strip(F.coalesce(F.col("sector"), F.lit("")))
    return F.when(
        is_event(), F.when(strip(related) == UNMAPPED, none).otherwise(listed)
    ).otherwise(F.when(own != "", F.array(own)).otherwise(none))


def generic_direction(positive: Column, negative: Column) -> Column:
    """(sentiment, reason) from the balance of direction words."""
    balance = total_weight(positive) - total_weight(negative)

    def reason(prefix: str, matched: Column) -> Column:
        first = F.slice(matched, F.lit(1), F.lit(defaults.REASON_HITS))
        return F.concat(F.lit(prefix), F.array_join(F.transform(first, lambda s: s["word"]), "、"))

    def verdict(sentiment: str, why: Column) -> Column:
        return F.struct(F.lit(sentiment).alias("sentiment"), why.alias("reason"))

    return (
        F.when(
            balance >= defaults.DIRECTION_THRESHOLD,
            verdict("positive", reason(defaults.POSITIVE_PREFIX, positive)),
        )
        .when(
            balance <= -defaults.DIRECTION_THRESHOLD,
            verdict("negative", reason(defaults.NEGATIVE_PREFIX, negative)),
        )
        .otherwise(verdict("neutral", F.lit(defaults.LOW_CONFIDENCE_REASON)))
    )


def assess_sectors(sectors: Column, macro: Column, generic: Column) -> Column:
    """Per target sector: the first macro rule that names it decides, else the generic verdict."""
    named = F.flatten(F.transform(macro, lambda r: r["sectors"]))

    def assess(sector: Column) -> Column:
        first = F.try_element_at(F.filter(named, lambda a: a["sector"] == sector), F.lit(1))
        return F.struct(
            sector.alias("sector"),
            F.coalesce(first["sentiment"], generic["sentiment"]).alias("sentiment"),
            F.coalesce(first["reason"], generic["reason"]).alias("reason"),
        )

    return F.transform(F.array_distinct(sectors), assess)


def _first(assessments: Column, sentiment: str | None = None) -> Column:
    chosen = assessments
    if sentiment is not None:
        chosen = F.filter(assessments, lambda a: a["sentiment"] == sentiment)
    return F.try_element_at(chosen, F.lit(1))


def overall(assessments: Column, generic: Column) -> Column:
    """(sentiment, reason, divergent) over all target sectors, before the confidence gate."""
    up = F.exists(assessments, lambda a: a["sentiment"] == "positive")
    down = F.exists(assessments, lambda a: a["sentiment"] == "negative")

    def verdict(sentiment: Column, reason: Column, divergent: bool = False) -> Column:
        return F.struct(
            sentiment.alias("sentiment"),
            reason.alias("reason"),
            F.lit(divergent).alias("divergent"),
        )

    return (
        F.when(up & down, verdict(F.lit("neutral"), F.lit(defaults.DIVERGENT_REASON), True))
        .when(up, verdict(F.lit("positive"), _first(assessments, "positive")["reason"]))
        .when(down, verdict(F.lit("negative"), _first(assessments, "negative")["reason"]))
        .when(F.size(assessments) > 0, verdict(F.lit("neutral"), _first(assessments)["reason"]))
        .otherwise(verdict(generic["sentiment"], generic["reason"]))
    )


def _lookup(key: Column, table: dict, default) -> Column:
    column = F.lit(default)
    for name, value in table.items():
        column = F.when(key == name, F.lit(value)).otherwise(column)
    return column


def news_category(hits: Column, lexicon: Lexicon) -> Column:
    """policy before industry before stock_move, general when none of their words occurs."""
    return (
        F.when(_has_any(hits, lexicon.words["policy"]), "policy")
        .when(_has_any(hits, lexicon.words["industry"]), "industry")
        .when(_has_any(hits, lexicon.words["stock_move"]), "stock_move")
        .otherwise("general")
    )


def analyse(df: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Add the ``analysis`` record to a news frame."""
    lexicon = lexicon or Lexicon()
    text = fold(
        F.concat_ws(
            " ", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("content"), F.lit(""))
        )
    )
    columns = list(df.columns)
    found = let(text, lambda t: words_in(t, lexicon.vocabulary()))
    parts = evaluate_once(df, _hits=found)
    hits = F.col("_hits")
    parts = evaluate_once(
        parts,
        _pos=signals(hits, lexicon.positive),
        _neg=signals(hits, lexicon.negative),
        _macro=macro_hits(hits, lexicon.macro),
    )
    pos, neg, macro = F.col("_pos"), F.col("_neg"), F.col("_macro")
    parts = evaluate_once(parts, _generic=generic_direction(pos, neg))
    generic = F.col("_generic")
    parts = evaluate_once(parts, _assessed=assess_sectors(target_sectors(), macro, generic))
    count = F.size(pos) + F.size(neg) + 2 * F.size(macro)
    strong = (F.size(macro) > 0) | (F.abs(total_weight(pos) - total_weight(neg)) >= 2.0)
    parts = evaluate_once(
        parts,
        _overall=overall(F.col("_assessed"), generic),
        _confidence=F.least(F.lit(90), 20 + 20 * count).cast("int"),
        _impact=F.when(_has_any(hits, lexicon.words["high"]), "high")
        .when(strong | _has_any(hits, lexicon.words["medium"]), "medium")
        .otherwise("low"),
        _category=news_category(hits, lexicon),
    )
    verdict, confidence = F.col("_overall"), F.col("_confidence")
    unsure = (verdict["sentiment"] != "neutral") & (confidence < defaults.LOW_CONFIDENCE)
    importance = (
        _lookup(F.col("_category"), defaults.CATEGORY_WEIGHTS, 1.0) * 2.0
        + _lookup(F.col("_impact"), defaults.IMPACT_SCORES, 1.0)
        + confidence / F.lit(100.0)
    )
    record = F.struct(
        F.when(unsure, "neutral").otherwise(verdict["sentiment"]).alias("sentiment"),
        F.col("_impact").alias("impact_level"),
        F.when(unsure, defaults.LOW_CONFIDENCE_REASON).otherwise(verdict["reason"]).alias("reason"),
        confidence.alias("confidence"),
        verdict["divergent"].alias("divergent"),
        F.col("_assessed").alias("sector_assessments"),
        F.transform(macro, lambda r: r["name"]).alias("macro_rules"),
        F.col("_category").alias("category"),
        importance.alias("importance"),
    )
    return parts.select(*columns, record.alias(ANALYSIS))


def labels() -> dict[str, Column]:
    """Shown labels of sentiment, impact and category."""
    record = F.col(ANALYSIS)
    return {
        "sentiment_label": _lookup(record["sentiment"], defaults.SENTIMENT_LABELS, "中性"),
        "impact_label": _lookup(record["impact_level"], defaults.IMPACT_LABELS, "低影响"),
        "category_label": _lookup(record["category"], defaults.CATEGORY_LABELS, ""),
    }


def shown_tags() -> dict[str, Column]:
    """What a card shows for a row: sentiment, reason, low-confidence mark and event tags."""
    record = F.col(ANALYSIS)
    assessed = record["sector_assessments"]
    own = F.try_element_at(
        F.filter(assessed, lambda a: a["sector"] == strip(F.col("sector"))), F.lit(1)
    )
    sentiment = F.when(is_event(), record["sentiment"]).otherwise(
        F.coalesce(own["sentiment"], record["sentiment"])
    )
    reason = F.when(is_event(), record["reason"]).otherwise(
        F.coalesce(own["reason"], record["reason"])
    )
    overall_shown = ~is_event() | (F.size(assessed) == 0) | record["divergent"]
    none = F.array().cast("array<struct<sector:string,sentiment:string>>")
    first_three = F.transform(
        F.slice(assessed, F.lit(1), F.lit(3)),
        lambda a: F.struct(a["sector"].alias("sector"), a["sentiment"].alias("sentiment")),
    )
    return {
        "shown_sentiment": F.when(overall_shown, sentiment),
        "shown_reason": reason,
        "shown_sectors": F.when(is_event(), first_three).otherwise(none),
        "low_confidence": record["confidence"] < defaults.LOW_CONFIDENCE,
        "divergent_mark": overall_shown & (sentiment == "neutral") & record["divergent"],
    }


def hot_score(publish_ts: Column, as_of: Column, related: Column) -> Column:
    """Importance, direction, relevance and freshness in one number."""
    record = F.col(ANALYSIS)
    directed = (record["sentiment"] != "neutral") | record["divergent"]
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(publish_ts.cast("timestamp"))
    hours = F.greatest(seconds / F.lit(3_600_000_000.0), F.lit(0.0))
    fresh = F.greatest(F.lit(0.0), F.lit(1.5) - hours / 16.0)
    return (
        record["importance"] * 1.5
        + F.when(directed, 1.5).otherwise(0.0)
        + F.when(related, 2.0).otherwise(0.0)
        + F.coalesce(fresh, F.lit(0.0))
    )
