"""Rows in ascending identifier order, dealt to contiguous parts of about equal size.

Rows are ordered by identifier, then by a hash of the text, then by the text; a null
identifier counts as the smallest, -2**63.  So rows that share an identifier, or have none,
are split between parts too.  The parts' borders are keys of a bounded sample; at most
``MAX_PARTS`` of them are broadcast, 16 bytes each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_PARTS = 1 << 18
SAMPLED = 24  # keys for each part
LOWEST = -(1 << 63)
_SPAN = 1 << 9


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty) and the order's keys at, h."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("at"), F.xxhash64("text").alias("h"))


@dataclass
class Borders:
    """The first keys of all parts but the first."""

    at: np.ndarray
    h: np.ndarray

    def part(self, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of the part of each key: the borders that are not behind it."""
        low, high = np.searchsorted(self.at, at, "left"), np.searchsorted(self.at, at, "right")
        out = low.copy()
        split = np.flatnonzero(high > low)  # keys with a border's identifier
        for a, b in {(int(low[i]), int(high[i])) for i in split}:
            own = split[(low[split] == a) & (high[split] == b)]
            out[own] = a + np.searchsorted(self.h[a:b], h[own], "right")
        return out.astype(np.int32)

    def first(self, part: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether a key is the first of its part (false in part 0)."""
        if not len(self.at):
            return np.zeros(len(part), bool)
        k = np.maximum(part - 1, 0)
        return (part > 0) & (self.at[k] == at) & (self.h[k] == h)


def borders(rows: DataFrame, part_rows: int) -> Borders:
    """Borders of parts of about ``part_rows`` keyed rows, more if there would be too many."""
    n = rows.count()
    parts = min(MAX_PARTS, -(-n // part_rows))
    if parts < 2:
        return Borders(np.zeros(0, np.int64), np.zeros(0, np.int64))
    scale = 1 << 40
    share = min(scale, scale * SAMPLED * parts // n)
    # distinct keys, about SAMPLED for each part: at most 6 million of 16 bytes
    some = rows.select("at", "h").filter(F.pmod(F.xxhash64("at", "h"), F.lit(scale)) < share).distinct().toArrow()
    at, h = some.column(0).to_numpy(), some.column(1).to_numpy()
    order = np.lexsort((h, at))
    pick = np.unique(np.arange(1, parts) * len(order) // parts) if len(order) else np.zeros(0, np.int64)
    pick = order[pick[pick > 0]]
    return Borders(at[pick], h[pick])


def running_sum(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows with a smaller ``key`` (0 up to MAX_PARTS, distinct).

    Sums within spans of keys, then over the spans: no task gets more rows than a span or their number.
    """
    span = F.floor(F.col(key) / F.lit(_SPAN)).cast("int")
    rows = rows.withColumn("_span", span)
    tops = rows.groupBy("_span").agg(F.sum(value).alias("_own"))
    up = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_span", F.coalesce(F.sum("_own").over(up), F.lit(0)).alias("_top"))
    within = Window.partitionBy("_span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(tops, "_span").withColumn("before", (F.col("_top") + F.col("_in")).cast("long")).drop("_span", "_top", "_in")


def least(rows: DataFrame) -> tuple[int, int] | None:
    """The smallest key of keyed rows; None without rows."""
    low = rows.agg(F.min("at")).first()[0]
    if low is None:
        return None
    return low, rows.filter(_at(low)).agg(F.min("h")).first()[0]


def _at(low: int) -> Column:
    return F.col("doc_id").isNull() | (F.col("doc_id") == low) if low == LOWEST else F.col("doc_id") == low
