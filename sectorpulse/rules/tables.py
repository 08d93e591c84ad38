"""Rule and sector configuration: normalised once on the driver, used as tables or literals.

Configuration is a handful of rows that a person edits, so it lives on the driver. ``to_df`` gives
it as a table for joins; ``literal`` gives it as one constant column, so that classifying needs
neither a join nor a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorpulse.functions.text import fold, fold_word, strip
from sectorpulse.rules import defaults

RULE_TYPE = (
    "struct<rule_pos:int,positive:array<struct<word:string,folded:string>>,"
    "co:array<string>,negative:array<string>,weight:double,min_score:double,fields:array<string>>"
)


def clean_list(value) -> list[str]:
    """Trimmed, non-blank, first occurrence only; one text counts as a list of one."""
    items = [value] if isinstance(value, str) else value if isinstance(value, (list, tuple)) else []
    stripped = (str(item or "").strip() for item in items)
    return list(dict.fromkeys(item for item in stripped if item))


@dataclass(frozen=True)
class Rule:
    positive: list[str]
    co: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    weight: float = 1.0
    min_score: float = 1.0
    fields: list[str] = field(default_factory=lambda: list(defaults.RULE_FIELDS))


def _number(value, default: float) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def rule_from(value) -> Rule | None:
    """A keyword or a rule object to a Rule; None when it has no positive keyword."""
    if isinstance(value, Rule):
        return value
    if isinstance(value, tuple):
        positive, co, negative, weight, least = value
        return Rule(clean_list(positive), clean_list(co), clean_list(negative), weight, least)
    if isinstance(value, str):
        word = value.strip()
        if not word:
            return None
        if fold_word(word) in defaults.NEVER_ALONE:
            return Rule([word], co=[defaults.NEVER_MATCH])
        if word == defaults.DOLLAR:
            return Rule([word], list(defaults.DOLLAR_CO_WORDS), list(defaults.DOLLAR_NOT))
        weight = 2.0 if word == defaults.DOUBLE_WEIGHT else 1.0
        return Rule([word], weight=weight, min_score=weight)
    if isinstance(value, dict):
        positive = clean_list(value.get("positiveKeywords"))
        if not positive:
            return None
        weight = _number(value.get("weight"), 1.0)
        known = [f for f in clean_list(value.get("fields")) if f in defaults.RULE_FIELDS]
        return Rule(
            positive,
            clean_list(value.get("requiredCoKeywords")),
            clean_list(value.get("negativeKeywords")),
            weight,
            _number(value.get("minScore"), weight),
            known or list(defaults.RULE_FIELDS),
        )
    return None


class RuleSet:
    """Ordered rules per category."""

    def __init__(self, categories: dict[str, list[Rule]]):
        self.categories = categories

    @classmethod
    def of(cls, config: dict) -> RuleSet:
        if not isinstance(config, dict):
            raise ValueError("rule configuration must be an object")
        categories = {}
        for name, raw in config.items():
            if not str(name or "").strip():
                continue
            values = [raw] if isinstance(raw, (str, dict)) else raw if isinstance(raw, list) else []
            rules = (rule_from(value) for value in values)
            categories[str(name).strip()] = [rule for rule in rules if rule is not None]
        return cls(categories)

    @classmethod
    def events(cls) -> RuleSet:
        """The built-in event categories."""
        return cls.of(defaults.EVENT_RULES)

    @classmethod
    def risk_families(cls) -> RuleSet:
        """The built-in stricter rules, by family."""
        families = {name: defaults.EVENT_RULES.get(name, []) for name in defaults.RISK_NAMES}
        families["Vision Pro"] = defaults.VISION_PRO_RULES
        return cls.of(families)

    def keywords(self) -> dict[str, list[str]]:
        """Search keywords per category: distinct positive words in rule order."""
        return {
            name: list(dict.fromkeys(word for rule in rules for word in rule.positive))
            for name, rules in self.categories.items()
        }

    def _records(self, name: str) -> list[dict]:
        return [
            {
                "rule_pos": position,
                "positive": [{"word": w, "folded": fold_word(w)} for w in rule.positive],
                "co": [fold_word(w) for w in rule.co],
                "negative": [fold_word(w) for w in rule.negative],
                "weight": rule.weight,
                "min_score": rule.min_score,
                "fields": rule.fields,
            }
            for position, rule in enumerate(self.categories[name])
        ]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per rule: category, rule_pos, positive, co, negative, weight, min_score, fields."""
        rows = [
            (name, pos, r.positive, r.co, r.negative, float(r.weight), float(r.min_score), r.fields)
            for name, rules in self.categories.items()
            for pos, r in enumerate(rules)
        ]
        schema = (
            "category string, rule_pos int, positive array<string>, co array<string>, "
            "negative array<string>, weight double, min_score double, fields array<string>"
        )
        return spark.createDataFrame(rows, schema)

    def literal(self) -> Column:
        """array<struct<category, rules>> as a constant."""
        payload = [{"category": n, "rules": self._records(n)} for n in self.categories]
        schema = f"array<struct<category:string,rules:array<{RULE_TYPE}>>>"
        return F.from_json(F.lit(json.dumps(payload, ensure_ascii=False)), schema)

    def rules_of(self, category: Column) -> Column:
        """The rules of a category; an empty array when it has none or is unknown."""
        found = F.filter(self.literal(), lambda c: c["category"] == category)
        return F.coalesce(
            F.try_element_at(found, F.lit(1))["rules"], F.array().cast(f"array<{RULE_TYPE}>")
        )

    def knows(self, category: Column) -> Column:
        return category.isin(list(self.categories)) if self.categories else F.lit(False)


@dataclass(frozen=True)
class Sector:
    name: str
    keywords: list[str]
    rule_id: str = ""


def sector_from(name: str, value) -> Sector:
    """A keyword, a keyword list, or an object with keywords and perhaps a rule id."""
    rule_id, keywords = "", value
    if isinstance(value, dict):
        keywords = value.get("keywords", value.get("KEYWORDS", []))
        ids = (str(value.get(key) or "").strip() for key in defaults.RULE_ID_NAMES)
        rule_id = next((i for i in ids if i), "")
        keywords = keywords if isinstance(keywords, (list, tuple)) else [keywords]
    return Sector(name, clean_list(keywords), rule_id)


def sectors_of(config: dict) -> list[Sector]:
    if not isinstance(config, dict):
        raise ValueError("sector configuration must be an object")
    names = ((str(name or "").strip(), value) for name, value in config.items())
    return [sector_from(name, value) for name, value in names if name]


def default_sectors() -> list[Sector]:
    return sectors_of(defaults.SECTORS)


def mapping_of(config: dict) -> dict[str, list[str]]:
    """Event category to sectors."""
    if not isinstance(config, dict):
        raise ValueError("mapping must be an object")
    names = ((str(name or "").strip(), value) for name, value in config.items())
    return {name: clean_list(value) for name, value in names if name}


def events_of(payload: dict) -> tuple[RuleSet, dict[str, list[str]]]:
    """Rules and event-to-sector mapping of one configuration object."""
    if not isinstance(payload, dict):
        raise ValueError("event configuration must be an object")
    rules = payload.get("external_events", payload.get("EXTERNAL_EVENTS", {}))
    mapping = payload.get("event_to_sectors", payload.get("EVENT_TO_SECTORS", {}))
    return RuleSet.of(rules), mapping_of(mapping)


def load_config(path: str | Path, parse, default):
    """Parsed configuration file, or the default plus a warning when it cannot be read."""
    try:
        return parse(json.loads(Path(path).read_text(encoding="utf-8"))), None
    except Exception as error:  # any unreadable file falls back
        return default, f"configuration unreadable, defaults used: {type(error).__name__}"


def sectors_df(spark: SparkSession, sectors: list[Sector]) -> DataFrame:
    rows = [(s.name, position, s.keywords, s.rule_id) for position, s in enumerate(sectors)]
    return spark.createDataFrame(
        rows, "sector string, sector_pos int, keywords array<string>, rule_id string"
    )


def mapping_df(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame(
        list(mapping.items()), "event_category string, sectors array<string>"
    )


def groups_df(spark: SparkSession) -> DataFrame:
    rows = [(g, s) for g, names in defaults.SECTOR_GROUPS.items() for s in names]
    return spark.createDataFrame(rows, "sector_group string, sector string")


def _risk_key(column: Column) -> Column:
    return F.replace(F.replace(fold(strip(column)), F.lit(" "), F.lit("")), F.lit("／"), F.lit("/"))


def risk_family(sector: Column, rule_id: Column) -> Column:
    """Stricter rule family of a sector, '' for none; a given rule id is never overruled."""
    by_id = F.lit("")
    for family, names in defaults.RISK_IDS.items():
        by_id = F.when(_risk_key(rule_id).isin(names), family).otherwise(by_id)
    by_name = F.lit("")
    for family, names in defaults.RISK_NAMES.items():
        by_name = F.when(_risk_key(sector).isin(names), family).otherwise(by_name)
    return F.when(F.coalesce(rule_id, F.lit("")) != "", by_id).otherwise(by_name)
