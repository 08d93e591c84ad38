"""Operator 10, exact de-duplication: frequent digests apart from the rest, in DataFrame functions only.

A Misra-Gries summary (Spark's ``freqItems``) names every digest that more than ``support`` of all
rows have, and perhaps a few others. The named digests are counted exactly; that is the check of the
summary, and gives their winners. There are at most 1 / ``support`` of them whatever the input, so
they are broadcast: rows with a frequent digest find their winner in the map task and are never
shuffled. All other rows go through an ordinary aggregation by digest, combined before the shuffle,
and a join back.

Defined results: null text counts as empty; an empty table gives an empty result; columns other than
the id and the text never matter; ties of length go to the smallest id, a null id last. Rows that
repeat both id and text count in ``group_size`` and are marked alike; ``deduplicate`` returns one of
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import text_or_empty, written

#: Share of all rows from which a digest is frequent. Spark takes no less than 1 / 10,000.
SUPPORT = 0.0005


def normalised(text: Column) -> Column:
    """``text`` without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_code_points, digest) of every row; one pass over the texts."""
    text = text_or_empty(text_column)
    return docs.select(
        F.col(id_column).alias("id"),
        F.length(text).cast("long").alias("n_code_points"),
        F.sha2(normalised(text).cast("binary"), 256).alias("digest"),
    )


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): most code points first, then the smallest id."""
    # The largest of (length, an id is there, ~id); ~id falls as id rises and can't overflow.
    best = F.max(F.struct("n_code_points", F.col("id").isNotNull().alias("known"), F.bitwise_not("id").alias("low")))
    return rows.groupBy("digest").agg(
        F.bitwise_not(best["low"]).alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def _split(rows: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """The winners of frequent digests, and the marks of all rows."""
    named = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    # At most 1 / support digests of 64 characters: 128 kB at the default.
    frequent = written(_winners(rows.join(F.broadcast(named), "digest", "left_semi")), "frequent-digests")
    fast = rows.join(F.broadcast(frequent), "digest")
    rest = rows.join(F.broadcast(frequent), "digest", "left_anti")
    slow = rest.join(_winners(rest), "digest")
    columns = ["id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"]
    return frequent, fast.select(*columns).unionByName(slow.select(*columns))


def mark(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of every row of ``docs``. Ids are whole numbers."""
    return _split(written(digests(docs, id_column, text_column), "exact-digests"), support)[1]


def deduplicate(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group of equal texts, with all their columns.

    Copies of frequent texts go in the map task. The id and the digest name a row; rows that repeat
    both are one, and the first one met stays.
    """
    rows = written(digests(docs, id_column, text_column), "exact-digests")
    frequent, marks = _split(rows, support)
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    stays = marks.where("kept").select(name.alias("__id"), F.col("digest").alias("__digest")).distinct()
    winners = frequent.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.lit(True).alias("__hot"))
    held = docs.withColumns(
        {
            "__id": F.coalesce(F.col(id_column).cast("string"), F.lit("none")),
            "__digest": F.sha2(normalised(text_or_empty(text_column)).cast("binary"), 256),
        }
    )
    held = held.join(F.broadcast(winners), "__digest", "left")
    held = held.where(F.col("__hot").isNull() | F.col(id_column).eqNullSafe(F.col("__keep")))
    held = held.join(stays, ["__id", "__digest"], "left_semi")
    return held.dropDuplicates(["__id", "__digest"]).select(*docs.columns)
