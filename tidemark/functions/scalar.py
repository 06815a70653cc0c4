"""Column helpers shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = date(1970, 1, 1)


# --- time ---------------------------------------------------------------------
def ts_lit(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def to_epoch_day(value: date | datetime) -> int:
    return ((value.date() if isinstance(value, datetime) else value) - EPOCH).days


def epoch_day(col: Column | str) -> Column:
    return F.unix_date(F.to_date(col))


def day_to_date(col: Column | str) -> Column:
    return F.date_from_unix_date(col)


def yyyymm(col: Column | str) -> Column:
    return (F.year(col) * 100 + F.month(col)).cast("int")


def weekday0(day: Column) -> Column:
    """Weekday of an epoch day, 0 = Sunday."""
    return F.pmod(day + F.lit(4), F.lit(7)).cast("int")


def since(col: Column | str, as_of: datetime, days: int) -> Column:
    """Second-exact sliding filter ``col >= as_of - days``."""
    return _c(col) >= ts_lit(as_of - timedelta(days=days))


def since_midnight(col: Column | str, as_of: datetime, days: int) -> Column:
    """Calendar filter: from the start of the day ``days`` before ``as_of``."""
    start = datetime.combine(as_of.date() - timedelta(days=days), datetime.min.time())
    return _c(col) >= ts_lit(start)


def in_days(col: Column | str, first: int, last: int) -> Column:
    """Timestamps from the start of epoch day ``first`` to the end of ``last``: a plain
    range on the column, so it reaches the scan and prunes partitions."""
    lo, hi = (datetime.combine(EPOCH + timedelta(days=d), datetime.min.time()) for d in (first, last + 1))
    return (_c(col) >= ts_lit(lo)) & (_c(col) < ts_lit(hi))


def days_before(col: Column | str, as_of: datetime) -> Column:
    """Calendar days between ``col`` and ``as_of``."""
    return (F.lit(to_epoch_day(as_of)) - epoch_day(col)).cast("int")


def local_to_utc(col: Column | str, zone: str) -> Column:
    return F.to_utc_timestamp(col, zone)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- numbers ------------------------------------------------------------------
def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 otherwise (also when it is NULL)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def sum_if(value: Column | str, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, _c(value))), F.lit(0))


def any_if(cond: Column) -> Column:
    """1 if any row matches, else 0: never NULL."""
    return F.max(flag(cond))


def small_distinct(value: Column | str) -> Column:
    """Exact distinct count of values bounded by a calendar or a code list.

    Kept as a small set inside the aggregate: unlike several count(DISTINCT …) in one
    query it does not multiply the input rows.
    """
    return F.size(F.collect_set(_c(value))).cast("long")


def ratio(num: Column, den: Column, digits: int | None = None, default: float = 0.0) -> Column:
    """num / den as double; ``default`` when the denominator is 0 or NULL."""
    value = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    if digits is not None:
        value = F.round(value, digits)
    return F.coalesce(value, F.lit(float(default)))


def gigabytes(col: Column | str) -> Column:
    return _c(col).cast("double") / F.lit(1e9)


def signed_log1p(col: Column | str) -> Column:
    c = _c(col).cast("double")
    return F.signum(c) * F.log1p(F.abs(c))


def expm1_clipped(col: Column | str) -> Column:
    return F.greatest(F.expm1(_c(col)), F.lit(0.0))


def to_number(col: Column | str) -> Column:
    """Number or NULL; text that is no number never fails the job."""
    return _c(col).cast("string").try_cast("double")


def to_id(col: Column | str) -> Column:
    """Text id to long, 0 when it is none (string/number key joins)."""
    return F.coalesce(_c(col).cast("string").try_cast("bigint"), F.lit(0))


def hash_bucket(parts: Sequence[Column], modulus: int) -> Column:
    """Stable bucket 0…modulus-1 of ``a:b:…`` from the first 32 bits of md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(modulus)).cast("int")


# --- text ---------------------------------------------------------------------
def json_field(col: Column | str, key: str) -> Column:
    """Text of a JSON field, '' when it is missing."""
    return F.coalesce(F.get_json_object(_c(col), f"$.{key}"), F.lit(""))


def contains_ci(col: Column | str, needle: str) -> Column:
    return F.contains(F.lower(_c(col)), F.lit(needle.lower()))


def strip_prefix(col: Column | str, prefix: str) -> Column:
    c = _c(col)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


EXTENSION_PATTERN = r"(?:^|/)[.]*[^./][^/]*[.]([^./]*)$"


def file_extension(path: Column | str) -> Column:
    """Lower-cased last suffix, at most 8 characters; dotfiles have none."""
    return F.substring(F.regexp_extract(F.lower(_c(path)), EXTENSION_PATTERN, 1), 1, 8)


# --- choices ------------------------------------------------------------------
def case_chain(rules: Iterable[tuple[Column, object]], default: object) -> Column:
    """First matching rule wins."""
    expr = None
    for cond, value in rules:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default) if expr is not None else F.lit(default)


def lookup(col: Column | str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Literal map lookup for a handful of fixed values."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), _c(col))
    return found if default is None else F.coalesce(found, F.lit(default))


def right_closed_bins(col: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge, next edge] that holds the value, else NULL."""
    c = _c(col)
    rules = [
        ((c > F.lit(lo)) & (c <= F.lit(hi)), F.lit(label))
        for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True)
    ]
    return case_chain(rules, F.lit(None).cast("string"))


def value_tier(col: Column | str, tiers: Sequence[tuple[str, float]]) -> Column:
    c = _c(col)
    rules = [(c >= F.lit(bound), F.lit(name)) for name, bound in tiers]
    return case_chain([*rules, (c > 0, F.lit("Bronze"))], F.lit("Prospect"))


# --- frames -------------------------------------------------------------------
def sentinel_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative sentinel to NULL, with a ``<col>_missing`` flag."""
    out = {}
    for c in cols:
        out[c] = F.when(F.col(c) < 0, None).otherwise(F.col(c))
        out[f"{c}_missing"] = flag(F.col(c) < 0)
    return df.withColumns(out)


def unique_columns(cols: Sequence[str]) -> list[str]:
    """Column list without repeats, first position kept."""
    return list(dict.fromkeys(cols))
