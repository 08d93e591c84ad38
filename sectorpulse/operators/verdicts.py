"""Second opinion on doubtful classifications: gate, requests, parsing, policy.

The verifier is user code behind a network. It runs once per distinct request, over the request
table only; everything else is column work and one join on the request key.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions.ids import validation_key
from sectorpulse.functions.text import WHITESPACE
from sectorpulse.operators.classify import RESULT
from sectorpulse.rules import defaults
from sectorpulse.schema import ROW_ID, evaluate_once

VERDICT_SCHEMA = "validation_key string, raw string, error string"
# How much of each field a request shows.
SHOWN_CHARS = {"title": 200, "summary": 300, "content": 500, "link": 300}


def needs_verdict(high_impact: tuple[str, ...] = defaults.HIGH_IMPACT_CATEGORIES) -> Column:
    """Matched, and either weak for a risky category, generic for an important one, or low."""
    record = F.col(RESULT)
    generic = F.size(generic_words()) > 0
    risky = record["category"].isin(list(defaults.HIGH_RISK_CATEGORIES))
    important = record["category"].isin(list(high_impact)) if high_impact else F.lit(False)
    doubtful = (
        (risky & (record["confidence"] < defaults.GATE_CONFIDENCE))
        | (important & generic)
        | (record["score"] <= defaults.GATE_SCORE)
    )
    return record["matched"] & F.coalesce(doubtful, F.lit(False))


def generic_words() -> Column:
    words = F.array(*[F.lit(w) for w in defaults.GENERIC_WORDS])
    return F.array_intersect(F.col(RESULT)["matched_keywords"], words)


def drops_on_failure() -> Column:
    record = F.col(RESULT)
    return (record["confidence"] < defaults.GATE_CONFIDENCE) | (
        record["score"] <= defaults.GATE_SCORE
    )


def evidence() -> Column:
    record = F.col(RESULT)
    return F.struct(
        record["category"].alias("category"),
        record["score"].alias("score"),
        record["confidence"].alias("confidence"),
        record["matched_keywords"].alias("matchedKeywords"),
        generic_words().alias("genericRiskKeywords"),
        record["reason"].alias("reason"),
        drops_on_failure().alias("shouldDropOnFailure"),
    )


def parse_verdict(raw: Column) -> Column:
    """Strictly typed verdict: every field must be there with its own JSON type."""
    parsed = F.try_parse_json(raw)

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))

    kinds = {n: F.coalesce(kind(n), F.lit("")) for n in ("shouldKeep", "category", "confidence", "reason")}
    number = kinds["confidence"].rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    confidence = F.try_variant_get(parsed, "$.confidence", "double")
    valid = (
        (kinds["shouldKeep"] == "BOOLEAN")
        & (kinds["category"] == "STRING")
        & number
        & F.coalesce(confidence.between(0, 1), F.lit(False))
        & (kinds["reason"] == "STRING")
    )

    def trimmed(name: str) -> Column:
        return F.when(valid, F.trim(F.try_variant_get(parsed, f"$.{name}", "string")))

    return F.struct(
        valid.alias("valid"),
        F.when(valid, F.try_variant_get(parsed, "$.shouldKeep", "boolean")).alias("should_keep"),
        trimmed("category").alias("category"),
        F.when(valid, confidence).alias("confidence"),
        trimmed("reason").alias("reason"),
    )


def with_key(df: DataFrame, **versions: str) -> DataFrame:
    """Add the request key; ``versions``: provider, model, prompt_version, rule_version."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "link", "content")]
    return df.withColumn("validation_key", validation_key(F.col(RESULT)["category"], *text, **versions))


def apply_verdicts(
    df: DataFrame, verdicts: DataFrame | None, exempt: Column | None = None, **versions: str
) -> DataFrame:
    """Keep matched rows the verdicts agree with; ``verdicts`` is (validation_key, raw, error)."""
    return decided(df, verdicts, exempt, **versions).filter(KEPT).select(*df.columns)


#: Column that says whether a row stays.
KEPT = "_kept"


def decided(
    df: DataFrame, verdicts: DataFrame | None, exempt: Column | None = None, **versions: str
) -> DataFrame:
    """All rows with ``_kept``: does the row stay under rules and verdicts?

    Rows outside the gate, or all of them when there is no verifier, are settled by the rules and
    do not travel to the join; ``exempt`` rows stay whatever the rules say.
    """
    exempt = F.lit(False) if exempt is None else exempt
    by_rule = F.coalesce(exempt | F.col(RESULT)["matched"], F.lit(False))
    if verdicts is None:
        return df.withColumn(KEPT, by_rule)
    in_doubt = F.coalesce(~exempt & needs_verdict(), F.lit(False))
    settled = df.filter(~in_doubt).withColumn(KEPT, by_rule)
    doubtful = with_key(df.filter(in_doubt), **versions)
    known = verdicts.groupBy("validation_key").agg(F.max("raw").alias("raw"))
    answered = doubtful.join(known, "validation_key", "left")
    answered = evaluate_once(answered, _verdict=parse_verdict(F.col("raw")))
    verdict = F.col("_verdict")
    agrees = verdict["should_keep"] & (
        (verdict["category"] == "") | (verdict["category"] == F.col(RESULT)["category"])
    )
    keep = F.when(F.coalesce(verdict["valid"], F.lit(False)), agrees).otherwise(~drops_on_failure())
    return settled.unionByName(answered.select(*df.columns, F.coalesce(keep, F.lit(False)).alias(KEPT)))


def _shown(df: DataFrame, name: str, chars: int | None) -> Column:
    text = F.col(name) if name in df.columns else F.lit("")
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " "))
    return (flat if chars is None else F.substring(flat, 1, chars)).alias(name)


def requests(
    df: DataFrame,
    verdicts: DataFrame | None = None,
    shown_chars: dict[str, int | None] = SHOWN_CHARS,
    retry: bool = False,
    **versions: str,
) -> DataFrame:
    """One request per key that has no verdict yet: (validation_key, category, payload).

    A request shows the fields of ``shown_chars``, each cut to that many characters (None: whole); the
    key covers whole fields. With ``retry`` a verdict that was only an error is asked for again; without it an error is an answer.

    The smallest row id speaks for its key; the choice is made before the shuffle as well.
    """
    doubtful = with_key(df.filter(needs_verdict()), **versions)
    payload = F.to_json(
        F.struct(
            F.col(RESULT)["category"].alias("category"),
            F.struct(*[_shown(df, name, chars) for name, chars in shown_chars.items()]).alias("news"),
            evidence().alias("evidence"),
        )
    )
    wanted = doubtful.select(
        "validation_key", ROW_ID, F.col(RESULT)["category"].alias("category"), payload.alias("payload")
    )
    if verdicts is not None:
        final = verdicts.where("raw IS NOT NULL") if retry else verdicts
        wanted = wanted.join(final.select("validation_key"), "validation_key", "left_anti")
    first = F.min_by(F.struct("category", "payload"), F.col(ROW_ID)).alias("first")
    return wanted.groupBy("validation_key").agg(first).select("validation_key", "first.*")


#: Attributes of a verifier that enter the request key.
VERSIONS = ("provider", "model", "prompt_version", "rule_version")


def versions_of(verifier: object) -> dict[str, str]:
    """The versions a verifier declares, for ``requests`` and ``apply_verdicts``; a bare callable has none."""
    found = {name: getattr(verifier, name, None) for name in VERSIONS}
    return {name: str(value) for name, value in found.items() if value}


def _asking(verifier: object) -> Callable[[dict, str, dict], object]:
    """``verifier`` as a function of news, category and evidence."""
    if hasattr(verifier, "verify"):
        return verifier.verify
    try:
        inspect.signature(verifier).bind({}, "", {})
    except TypeError:
        return lambda news, category, evidence: verifier(news, category)
    return verifier


def run_verifier(pending: DataFrame, verifier: object) -> DataFrame:
    """Ask ``verifier`` once per request; failures become error rows.

    A verifier has a method ``verify(news, category, evidence)``, or is a callable of these three or
    of (news, category). Give its ``versions_of`` to ``requests`` and ``apply_verdicts`` alike: answers
    of another model are then asked for anew. Write the result next to the earlier verdicts, so that a
    retry asks nothing twice.
    """
    verify = _asking(verifier)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, payload in zip(batch["validation_key"], batch["payload"]):
                asked = json.loads(payload)
                try:
                    reply = verify(asked["news"], asked["category"], asked["evidence"])
                    text = reply if isinstance(reply, str) else json.dumps(reply, ensure_ascii=False)
                    rows.append((key, text, None))
                except Exception as error:  # the verifier is foreign code
                    rows.append((key, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["validation_key", "raw", "error"])

    return pending.select("validation_key", "payload").mapInPandas(answer, VERDICT_SCHEMA)
