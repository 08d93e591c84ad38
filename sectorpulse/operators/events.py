"""What an event category means for sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.rules import defaults
from sectorpulse.rules.tables import mapping_df
from sectorpulse.schema import UNMAPPED


def annotate(df: DataFrame, category: Column, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    """Set event_category, related_sectors and the mapping sentence.

    The mapping is configuration on the driver, so its broadcast does not grow with the data.
    """
    table = mapping_df(
        df.sparkSession, defaults.EVENT_SECTORS if mapping is None else mapping
    ).select(F.col("event_category").alias("_category"), F.array_join("sectors", "、").alias("_related"))
    joined = df.withColumn("event_category", category).join(
        F.broadcast(table), F.col("event_category") == F.col("_category"), "left"
    )
    related = F.nullif(F.col("_related"), F.lit(""))
    sentence = F.format_string(defaults.MAPPING_REASON, F.col("event_category"), related)
    return joined.withColumns(
        {
            "related_sectors": F.coalesce(related, F.lit(UNMAPPED)),
            "reason": F.when(related.isNotNull(), sentence).otherwise(defaults.UNCERTAIN_REASON),
        }
    ).drop("_category", "_related")
