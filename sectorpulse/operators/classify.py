"""Rule classifier: map-only, every rule of a row's category in one pass over its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions.text import fold, let, strip
from sectorpulse.rules import defaults
from sectorpulse.rules.tables import RuleSet
from sectorpulse.schema import evaluate_once

RESULT = "classification"


def field_texts(df: DataFrame, display_shape: bool = False) -> Column:
    """Folded title, summary and content of a row, blank where a field has no column.

    In display shape the content column also answers for the summary.
    """

    def first(*names: str) -> Column:
        present = [F.nullif(strip(F.col(n)), F.lit("")) for n in names if n in df.columns]
        return fold(F.coalesce(*present, F.lit("")))

    if display_shape:
        title, summary, content = first("标题"), first("新闻内容"), first("新闻内容")
    else:
        title, summary, content = first("title"), first("summary"), first("content")
    return F.struct(title.alias("title"), summary.alias("summary"), content.alias("content"))


def rule_text(texts: Column, fields: Column) -> Column:
    """The text a rule looks at: its fields in order, joined by one blank."""
    parts = F.transform(
        fields,
        lambda f: F.when(f == "title", texts["title"])
        .when(f == "summary", texts["summary"])
        .when(f == "content", texts["content"]),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def _any_in(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def rule_hit(texts: Column, rule: Column) -> Column:
    """(score, words) of one rule; score 0 and no words when the rule stays silent."""

    def evaluate(text: Column) -> Column:
        words = F.transform(
            F.filter(rule["positive"], lambda w: F.contains(text, w["folded"])), lambda w: w["word"]
        )
        score = rule["weight"] * F.size(words)
        allowed = (
            (text != "")
            & ~_any_in(text, rule["negative"])
            & ((F.size(rule["co"]) == 0) | _any_in(text, rule["co"]))
        )
        counted = allowed & (score >= rule["min_score"])
        return F.when(counted, F.struct(score.alias("score"), words.alias("words"))).otherwise(
            F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("words"))
        )

    return let(rule_text(texts, rule["fields"]), evaluate)


def classification(texts: Column, category: Column, rules: Column) -> Column:
    """Classification record of a row under the given rules (array of rule structs)."""

    def finish(hits: Column) -> Column:
        score = F.aggregate(hits, F.lit(0.0), lambda total, h: total + h["score"])
        words = F.array_distinct(F.flatten(F.transform(hits, lambda h: h["words"])))
        matched = score > 0
        return F.struct(
            matched.alias("matched"),
            category.alias("category"),
            F.when(matched, score).otherwise(0.0).alias("score"),
            F.when(matched, F.least(F.lit(1.0), score / 2)).otherwise(0.0).alias("confidence"),
            F.when(matched, words)
            .otherwise(F.array().cast("array<string>"))
            .alias("matched_keywords"),
            F.when(matched, F.concat(F.lit(defaults.RULE_HIT_PREFIX), F.array_join(words, ",")))
            .otherwise("")
            .alias("reason"),
        )

    all_hits = let(texts, lambda t: F.transform(rules, lambda rule: rule_hit(t, rule)))
    return let(all_hits, finish)


def classify(
    df: DataFrame, rules: RuleSet, category: Column, display_shape: bool = False
) -> DataFrame:
    """Add the ``classification`` record for each row's own category."""
    record = classification(field_texts(df, display_shape), category, rules.rules_of(category))
    return evaluate_once(df, **{RESULT: record})


def classify_all(df: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per (row, matching category): each text is read once for all categories."""
    texts = field_texts(df)
    every = F.filter(
        let(
            texts,
            lambda t: F.transform(
                rules.literal(), lambda c: classification(t, c["category"], c["rules"])
            ),
        ),
        lambda c: c["matched"],
    )
    return df.select("*", F.explode(every).alias(RESULT))


def rule_scores(df: DataFrame, rules: RuleSet, category: str) -> DataFrame:
    """Category × rules as a join: one row per (row, rule of its category) with the rule's score.

    The broadcast table is configuration held on the driver, so it does not grow with the data.
    """
    by_category = df.sparkSession.range(1).select(F.explode(rules.literal()).alias("c"))
    table = by_category.select(
        F.col("c")["category"].alias(category), F.explode(F.col("c")["rules"]).alias("rule")
    )
    joined = df.join(F.broadcast(table), category)
    return evaluate_once(joined, hit=let(field_texts(df), lambda t: rule_hit(t, F.col("rule"))))


def keep_matched(df: DataFrame, rules: RuleSet, category: Column) -> DataFrame:
    """Rule filter without verdicts: only rows their category's rules match."""
    return classify(df, rules, category).filter(F.col(RESULT)["matched"]).drop(RESULT)
