"""Re-apply the current rules to stored news."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions.text import let, strip
from sectorpulse.operators.classify import RESULT, classification, field_texts
from sectorpulse.operators.verdicts import KEPT, apply_verdicts, decided
from sectorpulse.rules.tables import RuleSet, Sector, risk_family
from sectorpulse.schema import evaluate_once, is_event


def marked(
    df: DataFrame, events: RuleSet, sectors: list[Sector] = (), families: RuleSet | None = None
) -> DataFrame:
    """Add scope, name, ruled (does any rule set apply) and the classification under it.

    Map-only: rules and sector ids are configuration constants.
    """
    families = families or RuleSet.risk_families()
    name = strip(F.when(is_event(), F.col("event_category")).otherwise(F.col("sector")))
    ids = {s.name: s.rule_id for s in sectors if s.rule_id}
    id_map = F.from_json(F.lit(json.dumps(ids, ensure_ascii=False)), "map<string,string>")
    named = df.withColumns({"scope": F.when(is_event(), "event").otherwise("sector"), "name": name})
    family = risk_family(F.col("name"), F.coalesce(F.try_element_at(id_map, F.col("name")), F.lit("")))
    named = named.withColumn("_family", F.when(is_event(), F.lit("")).otherwise(family))
    rules = F.when(is_event(), events.rules_of(F.col("name"))).otherwise(
        families.rules_of(F.col("_family"))
    )
    ruled = F.when(is_event(), F.lit(True)).otherwise(F.col("_family").isin(list(families.categories)))
    known = F.coalesce(F.when(is_event(), events.knows(F.col("name"))).otherwise(True), F.lit(False))
    record = let(field_texts(df), lambda t: classification(t, F.col("name"), rules))
    judged = evaluate_once(named, ruled=F.coalesce(ruled, F.lit(False)), known=known, **{RESULT: record})
    return judged.drop("_family")


def refilter(
    df: DataFrame,
    events: RuleSet,
    sectors: list[Sector] = (),
    verdicts: DataFrame | None = None,
    families: RuleSet | None = None,
    **versions: str,
) -> DataFrame:
    """Rows that still hold: unruled sector news untouched, the rest by rule and verdict."""
    tested = marked(df, events, sectors, families)
    in_question = tested.filter(~F.col("ruled") | F.col("known"))
    kept = apply_verdicts(in_question, verdicts, exempt=~F.col("ruled"), **versions)
    return kept.select(*df.columns)


def refilter_counts(
    df: DataFrame,
    events: RuleSet,
    sectors: list[Sector] = (),
    families: RuleSet | None = None,
    verdicts: DataFrame | None = None,
    **versions: str,
) -> DataFrame:
    """Rows per scope and name that ``refilter`` with the same arguments keeps and drops."""
    tested = decided(marked(df, events, sectors, families), verdicts, exempt=~F.col("ruled"), **versions)
    keep = F.col(KEPT) & (~F.col("ruled") | F.col("known"))
    return tested.groupBy("scope", "name").agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped")
    )
