"""Ordered row access inside keyed groups of any size.

A plain ``Window.partitionBy(key)`` sends a whole group to one task, so one conversation or user
that holds a third of the table stops the job. These operators cut each group into chunks first:
the window runs per ``(key, chunk)``, one small row per chunk carries what the next chunk needs, and
only those rows are ordered per key. The data is shuffled once, on ``(key, chunk)``.

``chunk`` must be a deterministic, order-preserving expression of the first order column within a
key, such as ``int_chunk("turn")`` for dense numbers or ``time_chunk("ts")`` for time.
``hot_time_chunk`` cuts only keys with very many rows and leaves the others whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.session import reliable

CHUNK_ROWS = 4096


def int_chunk(column: str, rows: int = CHUNK_ROWS) -> Column:
    """At most ``rows`` rows per chunk where the column is unique within the key."""
    return F.floor(F.col(column) / F.lit(rows)).cast("long")


def time_chunk(column: str, unit: str = "hour") -> Column:
    return F.date_trunc(unit, F.col(column))


HOT_ROWS = 1_000_000
CUT_ROWS = 1_000_000


def hot_time_chunk(
    df: DataFrame, key: str, column: str, unit: str = "second", hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, Column]:
    """Rows with ``_hot``, and the chunk made of it: keys of more than ``hot_rows`` rows are cut, by rows.

    Counts per key and second are pre-aggregated. Along a hot key's seconds a running total gives each
    second its chunk, so a chunk holds at most ``hot_rows`` rows and those of one second. The cuts are
    written and counted here (one job): without any the rows are left as they are; up to ``CUT_ROWS`` of
    them are broadcast; beyond they are joined by shuffle.
    """
    slot = F.date_trunc(unit, F.col(column))
    counts = df.groupBy(key, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.groupBy(key).agg(F.sum("_n").alias("_n")).where(F.col("_n") > hot_rows).select(key)
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.coalesce(F.sum("_n").over(before), F.lit(0))
    cuts = reliable(counts.join(hot, key, "left_semi").select(key, "_slot", (F.floor(sofar / hot_rows) + 1).alias("_hot")))
    n = cuts.count()
    if n:
        marked = df.withColumn("_slot", slot).join(F.broadcast(cuts) if n <= CUT_ROWS else cuts, [key, "_slot"], "left").drop("_slot")
    else:
        marked = df.withColumn("_hot", F.lit(None).cast("long"))
    return marked, F.coalesce("_hot", F.lit(0))


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    cols: Sequence[str],
    out: str,
    step: int = -1,
) -> DataFrame:
    """Add ``out``: a struct of ``cols`` of the previous (-1) or next (+1) row of the key, or null."""
    direction = (lambda c: F.col(c).asc()) if step < 0 else (lambda c: F.col(c).desc())
    by_row = Window.partitionBy(*keys, "_chunk").orderBy(*[direction(c) for c in order])
    by_chunk = Window.partitionBy(*keys).orderBy(direction("_chunk"))
    payload = F.struct(*cols)
    rows = (
        df.withColumn("_chunk", chunk)
        .withColumn("_near", F.lag(payload).over(by_row))
        .withColumn("_start", F.row_number().over(by_row) == 1)
        .withColumn("_end", F.lead(F.lit(1)).over(by_row).isNull())
    )
    carried = (
        rows.where("_end")
        .select(*keys, "_chunk", F.lag(payload).over(by_chunk).alias("_carried"))
        .where("_carried IS NOT NULL")
    )
    near = F.coalesce(F.col("_near"), F.when(F.col("_start"), F.col("_carried")))
    return (
        rows.join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, near)
        .drop("_chunk", "_near", "_start", "_end", "_carried")
    )


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: Mapping[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums along the order of each key, with or without the current row."""
    frame = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_chunk", chunk).withColumns({f"_v_{k}": v for k, v in sums.items()})
    rows = rows.withColumns(
        {f"_r_{k}": F.coalesce(F.sum(f"_v_{k}").over(frame), F.lit(0)) for k in sums}
    )
    totals = rows.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    offsets = totals.select(
        *keys, "_chunk", *[F.sum(f"_t_{k}").over(before).alias(f"_o_{k}") for k in sums]
    ).where(" OR ".join(f"_o_{k} <> 0" for k in sums))
    rows = rows.join(offsets, [*keys, "_chunk"], "left").withColumns(
        {k: F.col(f"_r_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0)) for k in sums}
    )
    return rows.drop("_chunk", *[f"_{p}_{k}" for p in "vro" for k in sums])


def with_tail(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: str,
    n: int,
    out: str,
) -> DataFrame:
    """Add ``out``: the values of the last ``n`` earlier rows of the key, oldest first."""
    by_row = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-n, -1)
    rows = (
        df.withColumn("_chunk", chunk)
        .withColumn("_tail", F.collect_list(value).over(by_row.rowsBetween(-n, -1)))
        .withColumn("_end", F.lead(F.lit(1)).over(by_row).isNull())
    )
    # Every chunk that exists holds at least one row, so the last n chunks hold the last n rows.
    grown = F.concat("_tail", F.array(value))
    last = F.when(F.size("_tail") < n, grown).otherwise(F.slice(grown, -n, n))
    carried = (
        rows.where("_end")
        .select(*keys, "_chunk", last.alias("_last"))
        .select(*keys, "_chunk", F.flatten(F.collect_list("_last").over(by_chunk)).alias("_earlier"))
        .where(F.size("_earlier") > 0)
    )
    empty = F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")
    everything = F.concat(F.coalesce("_earlier", empty), "_tail")
    return (
        rows.join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, everything)
        .withColumn(out, F.when(F.size(out) > n, F.slice(out, -n, n)).otherwise(F.col(out)))
        .drop("_chunk", "_tail", "_end", "_earlier")
    )

