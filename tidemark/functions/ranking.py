"""Global order statistics without a global sort in one task.

A window without partition keys would move a whole table through a single task. Here the input is computed once and written to the
shared scratch folder as it comes. Only (group, score, tie-break, sums) and a row number of that file are then dealt into ranges that
Spark draws from a sample of the stored values, so ranges hold about equally many rows whatever the values are: narrow, skewed, or one
value held by a third of all rows. The ranges are sorted and written with each row's place; their totals (a row per range) carry
the running offsets, so a rank is an addition, and only running sums need a window, inside ranges. Wide rows are not
dealt or sorted: what was found for a row is joined to it by its number.

NULL scores have no rank: they keep their row, with NULL in every added column, and count nowhere. NaN sorts
above infinity, as everywhere in Spark. NULL groups are a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def _order(name: str, descending: bool) -> Column:
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def _ranges(df: DataFrame, score: str, by: Sequence[str], then: Sequence[str], descending: bool) -> DataFrame:
    """``df`` in sorted ranges of equal size, with the number of its range in ``_range`` and a row's place in it in ``_at``.

    The range bounds come from a sampling job of their own, so give a frame that is stored."""
    order = [*by, _order(score, descending), *then]
    place = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(place.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "ranges")


def _with_offsets(ranges: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Adds ``_o_<name>``, the total of earlier ranges of the group, ``<name>_total``, and ``_first``, the place its rows of the
    range begin at."""
    totals = ranges.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)], F.col("_range").alias("_r"), "_first",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"{n}_total") for n in sums],
    )
    same = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        same = same & ranges[b].eqNullSafe(F.col(f"_by_{i}"))
    return ranges.join(offsets, same).drop("_r", *[f"_by_{i}" for i in range(len(by))])


def running_totals(
    cells: DataFrame,
    score: str,
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    then: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``<name>_before`` (total of all earlier cells) and ``<name>_total``.

    ``cells`` holds one row per (by, score, then); ``sums`` maps names to columns. Cells with a NULL score are left out.
    """
    by = list(by)
    ranges = _ranges(materialize(cells.filter(F.col(score).isNotNull()), "cells"), score, by, then, descending)
    inside = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_offsets(ranges, by, {n: F.col(c) for n, c in sums.items()})
    return placed.withColumns(
        {f"{n}_before": F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    ).drop("_range", "_at", "_first", *[f"_o_{n}" for n in sums])


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their row count ``n``, combined before the shuffle."""
    return df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))


def global_rows(
    df: DataFrame,
    score: str,
    tiebreak: str,
    by: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Exact row number over (score, tiebreak asc) and inclusive running sums.

    Adds ``row_no`` and ``rows_total``; per entry of ``sums`` also ``<name>_upto`` and ``<name>_total``. ``tiebreak``
    must be unique for ranks that do not depend on the run. Rows with a NULL score stay, with NULL in the added columns.
    """
    by, sums = list(by), dict(sums or {})
    stored = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "ranked-input")
    needed = list(dict.fromkeys([*by, score, tiebreak, *sums.values()]))
    wide = set(df.columns) != set(needed)
    ranked = F.col(score).isNotNull()
    ranges = _ranges(stored.select(*needed, "_row"), score, by, [tiebreak, "_row"], descending)
    totals = {"rows": F.when(ranked, 1).otherwise(0).cast("long"), **{n: F.when(ranked, F.col(c)) for n, c in sums.items()}}
    placed = _with_offsets(ranges, by, totals)
    # rows without a score stand behind all others of their group
    added = {
        "row_no": F.when(ranked, F.col("_o_rows") + F.col("_at") - F.col("_first") + 1),
        "rows_total": F.when(ranked, F.col("rows_total")),
    }
    inside = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for n in sums:
        added[f"{n}_upto"] = F.when(ranked, F.col(f"_o_{n}") + F.sum(totals[n]).over(inside))
        added[f"{n}_total"] = F.when(ranked, F.col(f"{n}_total"))
    found = placed.withColumns(added)
    if wide:
        found = stored.join(found.select("_row", *added), "_row")
    return found.select(*df.columns, *added)


def quantile_bin(
    df: DataFrame, score: str, tiebreak: str, n: int = 10, out: str = "bin", by: Sequence[str] = ()
) -> DataFrame:
    """Equal-count bins 1…n over unique ranks (ties ordered by ``tiebreak``); NULL for a NULL score."""
    ranked = global_rows(df, score, tiebreak, by)
    # ceil((row - 1) * n / (rows - 1)) in whole numbers
    place = F.expr(
        f"((row_no - 1) * {n} + greatest(rows_total - 1, 1) - 1) div greatest(rows_total - 1, 1)"
    )
    known = F.col("row_no").isNotNull()
    return ranked.withColumn(out, F.when(known, F.greatest(F.lit(1), place)).cast("int")).drop("row_no", "rows_total")


def top_fraction(df: DataFrame, score: str, tiebreak: str, pct: float) -> DataFrame:
    """The best ``pct`` percent of rows with a score, at least one row."""
    ranked = global_rows(df, score, tiebreak, descending=True)
    k = F.greatest(F.floor(F.col("rows_total") * F.lit(float(pct)) / 100), F.lit(1))
    return ranked.filter(F.col("row_no") <= k).drop("row_no", "rows_total")


def average_ranks(values: DataFrame, col: str, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Average rank of every distinct value; ``values`` has one row per value."""
    placed = running_totals(values, col, {"rows": n}, by)
    return placed.withColumn("avg_rank", F.col("rows_before") + (F.col(n) + 1) / 2)


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    salts: int = 16, how: str = "inner",
) -> DataFrame:
    """Equi-join where single keys of ``left`` may hold a large part of its rows.

    Left rows of one key are spread over ``salts`` tasks by other columns; the right
    side (one row per key, much smaller) is repeated once per salt. ``salts`` is a power
    of two: the masked hash is never NULL, so no filter on it is pushed below ``left``
    and a shuffle both sides come from can be shared.
    """
    if salts & (salts - 1):
        raise ValueError("salts must be a power of two")
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError("copies of the right side would count as rows of their own")
    salted = left.withColumn("_salt", F.xxhash64(*spread_by).bitwiseAND(F.lit(salts - 1).cast("bigint")))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
