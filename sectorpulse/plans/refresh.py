"""Refresh jobs as DataFrame plans: ingest, full rebuild, incremental merge."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions import times
from sectorpulse.operators.aggregates import change_counts
from sectorpulse.operators.dedupe import append_ids, dedupe, dedupe_news, merge, with_story_keys
from sectorpulse.operators.delta import merge_delta, settle, unseen, with_keys
from sectorpulse.operators.events import annotate
from sectorpulse.operators.filters import PUBLISH_DATE, prune, retained
from sectorpulse.operators.increments import new_links
from sectorpulse.operators.refilter import refilter
from sectorpulse.rules import defaults
from sectorpulse.rules.tables import RuleSet, Sector, default_sectors
from sectorpulse.schema import EXTERNAL_EVENT, NEWS_COLUMNS, ROW_ID, SECTOR_NEWS, repair
from sectorpulse.session import cut_lineage
from sectorpulse.sinks.table import NewsTable, on_dates
from sectorpulse.sources.fanout import fan_out, keyword_table, outcomes

RETENTION_DAYS = 30


@dataclass(frozen=True)
class Config:
    """What a refresh runs with; the built-in tables by default."""

    sectors: list[Sector] = field(default_factory=default_sectors)
    events: RuleSet = field(default_factory=RuleSet.events)
    mapping: dict[str, list[str]] = field(default_factory=lambda: defaults.EVENT_SECTORS)
    fuzzy: bool = True
    keep_fragment: bool = False
    verdicts: DataFrame | None = None

    def refilter(self, df: DataFrame) -> DataFrame:
        return refilter(df, self.events, self.sectors, self.verdicts)

    def fingerprint(self) -> str | None:
        """Names what decides about stored rows; None if it cannot be named, because verdicts may come in at any time."""
        if self.verdicts is not None:
            return None
        families = RuleSet.risk_families().categories
        ruling = (self.sectors, self.events.categories, families, self.mapping, self.fuzzy, self.keep_fragment)
        return hashlib.sha256(repr(ruling).encode()).hexdigest()


def ingest(raw: DataFrame, config: Config, fetched_at: str) -> DataFrame:
    """Keyword results (row_id and the six news fields) to new table rows of all sectors and
    categories in one plan.

    Every asking name is a partition of one de-duplication, so a popular one spreads over many
    tasks instead of being a job of its own. Row ids are renumbered in (name, keyword) order,
    which is the order in which the results of one name follow each other.
    """
    asked = keyword_table(raw.sparkSession, config.sectors, config.events)
    spread = fan_out(raw, asked)
    ordered = spread.orderBy("scope", "name_pos", "keyword_pos", ROW_ID)
    numbered = cut_lineage(ordered.withColumn(ROW_ID, F.monotonically_increasing_id()))
    kept = dedupe(
        numbered,
        [F.col("scope"), F.col("name")],
        config.fuzzy,
        keep_fragment=config.keep_fragment,
    )
    is_event = F.col("scope") == "event"
    scoped = kept.withColumns(
        {
            "news_type": F.when(is_event, EXTERNAL_EVENT).otherwise(SECTOR_NEWS),
            "sector": F.when(is_event, "").otherwise(F.col("name")),
            "fetched_at": F.lit(fetched_at),
        }
    )
    annotated = annotate(scoped, F.when(is_event, F.col("name")).otherwise(""), config.mapping)
    blank = {c: F.when(is_event, F.col(c)).otherwise("") for c in ("related_sectors", "reason")}
    return config.refilter(repair(annotated.withColumns(blank)))


class IngestError(RuntimeError):
    """No keyword of any sector or category could be fetched."""


@dataclass(frozen=True)
class Ingested:
    """New table rows, and per asking name (scope, name, keywords, failed, outcome) what became of its keywords."""

    rows: DataFrame
    outcomes: DataFrame


def ingest_checked(raw: DataFrame, failed: DataFrame, config: Config, fetched_at: str) -> Ingested:
    """``ingest`` that minds the ``failed`` keywords (``fanout.failed_keywords``).

    A name with some failed keywords is a warning, one with nothing but failed keywords an error of its
    own; the others go on. If every name is an error the run has failed and raises before rows are made,
    so that the stored table stays as it is. What is collected is as large as the configuration.
    """
    asked = keyword_table(raw.sparkSession, config.sectors, config.events)
    found = cut_lineage(outcomes(asked, failed))
    if not found.isEmpty() and found.filter("outcome != 'error'").isEmpty():
        names = [r["name"] for r in found.orderBy("scope", "name").collect()]
        raise IngestError("nothing could be fetched for " + ", ".join(names))
    return Ingested(ingest(raw, config, fetched_at), found)


def full_refresh(fetched: DataFrame, config: Config, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """A new table from fetched rows alone. Nothing fetched is a failed run, not an empty table."""
    if fetched.isEmpty():
        raise ValueError("nothing was fetched: the stored table stays as it is")
    kept = dedupe_news(fetched, config.fuzzy, keep_fragment=config.keep_fragment)
    return prune(config.refilter(kept), days, as_of)


@dataclass(frozen=True)
class Refreshed:
    table: DataFrame
    counts: DataFrame


def incremental_refresh(
    existing: DataFrame, fetched: DataFrame, config: Config, as_of, days: int = RETENTION_DAYS
) -> Refreshed:
    """Stored rows under current rules, plus fetched rows with unseen links and new stories.

    Pass the frame of a successful read as ``existing``: a failed read must raise before this.
    """
    held = cut_lineage(with_story_keys(config.refilter(existing), config.keep_fragment))
    unseen = new_links(held, fetched, config.keep_fragment)
    merged = merge(held, append_ids(held, unseen), config.fuzzy, keep_fragment=config.keep_fragment)
    table = cut_lineage(config.refilter(merged))
    final = prune(table, days, as_of)
    counts = change_counts(existing=held, merged=table, final=final).select(
        F.greatest(F.col("merged") - F.col("existing"), F.lit(0)).alias("added"),
        (F.col("merged") - F.col("final")).alias("pruned"),
        F.col("final").alias("total"),
    )
    return Refreshed(final, counts)


def load_table(table: NewsTable, rows: DataFrame, config: Config) -> None:
    """Fill ``table`` with any news rows: de-duplicated, under the current rules, with their keys."""
    settled = settle(config.refilter(rows), config.fuzzy, config.keep_fragment)
    held = cut_lineage(table.typed(settled))
    table.replace(held, table.dates())
    table.set_rules(config.fingerprint() or "")


@dataclass(frozen=True)
class Change:
    """Rows a refresh added and pruned (as ``Refreshed.counts``), rows in the end, and the dates it wrote."""

    added: int
    pruned: int
    total: int
    dates: frozenset[date | None]


def _day(as_of: str | datetime, days: int, spark) -> date:
    cutoff = times.days_before(times.as_of_ts(as_of), days)
    return spark.range(1).select(F.to_date(cutoff).alias("day")).first()["day"]


def delta_refresh(
    table: NewsTable, fetched: DataFrame, config: Config, as_of, days: int = RETENTION_DAYS, batch: int | None = None
) -> Change:
    """``incremental_refresh`` of a stored table: the same rows in the end, but only dates that change are written.

    Stored rows are settled and under the rules noted with the table, so they are scanned for what the batch
    meets and otherwise left alone. Under other rules (or with verdicts) the table is filtered as a whole first.
    A ``batch`` that was given before takes back its rows and is merged again.
    """
    spark = fetched.sparkSession
    ruled = config.fingerprint()
    stored = table.read()
    changed: set[date | None] = set()
    if table.dates() and (ruled is None or ruled != table.rules()):
        stored = cut_lineage(settle(config.refilter(stored), config.fuzzy, config.keep_fragment))
        changed |= table.dates()
    if table.dates() and batch is not None:
        again = table.read().filter(F.col("batch") == batch)
        changed |= {r[0] for r in again.select(PUBLISH_DATE).distinct().collect()}
        stored = stored.filter(~F.col("batch").eqNullSafe(F.lit(batch)))

    n_stored = stored.count()
    keyed = with_keys(append_ids(stored, repair(fetched)), config.keep_fragment)
    new = unseen(stored, keyed)
    delta = merge_delta(stored, new, config.fuzzy, config.keep_fragment)
    removed = cut_lineage(delta.removed.select(ROW_ID, PUBLISH_DATE))
    added = cut_lineage(table.typed(with_keys(config.refilter(delta.added.select(ROW_ID, *NEWS_COLUMNS)), config.keep_fragment), batch))
    n_removed, n_added = removed.count(), added.count()
    merged = n_stored - n_removed + n_added

    # As many dates as the batch and what it displaces have.
    for rows in (removed, added):
        changed |= {r[0] for r in rows.select(PUBLISH_DATE).distinct().collect()}
    if days > 0:
        first = _day(as_of, days, spark)
        table.expire(first)
        # The day of the limit and undated rows are pruned row by row.
        edge = {first, None} & table.dates()
        stale = stored.filter(on_dates(edge) & ~retained(days, as_of)) if edge else stored.limit(0)
        changed |= {r[0] for r in stale.select(PUBLISH_DATE).distinct().collect()}
        changed = {d for d in changed if d is None or d >= first}
    if changed:
        names = table.read().columns
        rows = stored.select(*names).filter(on_dates(changed)).join(removed.select(ROW_ID), ROW_ID, "left_anti")
        rows = rows.select(*names).unionByName(added.filter(on_dates(changed)).select(*names))
        table.replace(cut_lineage(prune(rows, days, as_of)), changed)
    if ruled is not None:
        table.set_rules(ruled)
    total = table.read().count()
    return Change(max(merged - n_stored, 0), merged - total, total, frozenset(changed))
