"""Cleaning, splits and preprocessing stages for Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.ml import Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import hash_bucket, sentinel_to_null
from tidemark.functions.stats import collapse_rare, drop_constant, quantile_lower

C = F.col

# --- fixed values: column roles of the conversion panel --------------------------
LEAKS = ("mobile_share_now", "era", "label_payment_14d", "label_sub_started_14d", "days_to_payment",
         "first_payment_usd")
SENTINELS = ("days_since_last_send", "days_since_last_open", "days_since_web_activity",
             "days_since_last_txn", "days_since_sub_event", "tenure_days", "days_since_promo_sub")
CATEGORICAL = ("country", "last_sub_event")
# ----------------------------------------------------------------------------------


def clean(df: DataFrame, sentinels: Sequence[str] = SENTINELS, top_countries: int = 30,
          keep: Sequence[str] = ()) -> DataFrame:
    """Sentinels to NULL with flags, named empty categories, rare countries together,
    constant columns out (``keep`` is never dropped)."""
    out = sentinel_to_null(df, [c for c in sentinels if c in df.columns])
    out = out.withColumns({
        "country": F.coalesce(F.nullif("country", F.lit("")), F.lit("unknown")),
        "last_sub_event": F.coalesce(F.nullif("last_sub_event", F.lit("")), F.lit("none")),
    })
    return drop_constant(collapse_rare(out, "country", top_countries), keep)


def numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def as_doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: C(c).cast("double") for c in cols})


# --- splits -----------------------------------------------------------------------
def split_time(df: DataFrame, col: str, frac: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows up to the date quantile for training, later ones for testing."""
    day = df.select(F.unix_date(F.to_date(col)).alias("_d"))
    cut = quantile_lower(day, "_d", frac)  # one row
    marked = df.join(F.broadcast(cut)).withColumn("_train", F.unix_date(F.to_date(col)) <= C("cutoff"))
    return (marked.filter("_train").drop("cutoff", "_train"), marked.filter("NOT _train").drop("cutoff", "_train"))


def split_date(df: DataFrame, col: str, first_test: date) -> tuple[DataFrame, DataFrame]:
    return df.filter(C(col) < F.lit(first_test)), df.filter(C(col) >= F.lit(first_test))


def split_user(df: DataFrame, pct: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Whole users to one side, by a stable hash: a user never trains and tests."""
    bucket = hash_bucket([C("user_id"), F.lit(f"split-{seed}")], 100)
    return df.filter(bucket >= pct), df.filter(bucket < pct)


def calibration_slice(train: DataFrame, col: str, frac: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Last part of the training time range, kept apart for calibration."""
    return split_time(train, col, frac)


def cap_rows(df: DataFrame, label: str, cap: int, keys: Sequence[str], weight: str = "sample_weight") -> DataFrame:
    """All positives and a stable sample of negatives, about ``cap`` training rows in total.

    Bounds the labelled rows a model is fitted on; never for test rows. Weights of the kept negatives grow so that the
    population is still represented. A cap that leaves no room for negatives is refused.
    """
    positive = F.coalesce(C(label) == 1, F.lit(False))
    counts = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).first()
    if counts["p"] + counts["n"] <= cap or not counts["n"]:
        return df
    if cap <= counts["p"]:
        raise ValueError(f"{counts['p']} positives leave no negatives within {cap} rows")
    frac = (cap - counts["p"]) / counts["n"]
    bits = 52  # a hash as a fraction, exact in a double
    place = F.xxhash64(*[C(k) for k in keys]).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) / F.lit(float(1 << bits))
    return df.filter(positive | (place < frac)).withColumn(
        weight, F.when(positive, C(weight)).otherwise(C(weight) / F.lit(frac)))


def cap_classes(df: DataFrame, label: str, cap: int, keys: Sequence[str], weight: str = "sample_weight") -> DataFrame:
    """``cap_rows`` for any number of positives: where they alone reach ``cap``, stable samples of both classes, about half
    of ``cap`` each (or all negatives if they are fewer), weighted by 1 / rate."""
    positive = F.coalesce(C(label) == 1, F.lit(False))
    counts = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).first()
    if counts["p"] < cap or counts["p"] + counts["n"] <= cap:
        return cap_rows(df, label, cap, keys, weight)
    room = max(cap - cap // 2, cap - counts["n"])  # for positives
    bits = 52
    place = F.xxhash64(*[C(k) for k in keys]).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) / F.lit(float(1 << bits))
    rate = F.when(positive, F.lit(min(1.0, room / counts["p"]))).otherwise(F.lit(min(1.0, (cap - room) / counts["n"]) if counts["n"] else 1.0))
    return df.filter(place < rate).withColumn(weight, C(weight) / rate)


def balanced_weights(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """n / (2 * n_class) per row."""
    sizes = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(C(label) == 1).alias("_pos"))  # one row
    own = F.when(C(label) == 1, C("_pos")).otherwise(C("_n") - C("_pos"))
    return df.join(F.broadcast(sizes)).withColumn(out, C("_n") / (2 * own)).drop("_n", "_pos")


# --- stages -----------------------------------------------------------------------
Stage = Estimator | Transformer
TOP_CATEGORIES = 60  # values of a categorical feature that stay apart; the rest is one category


def kept_categories(train: DataFrame, cat: Sequence[str], top: int = TOP_CATEGORIES) -> dict[str, list[str]]:
    """The most frequent values of each categorical column of the training rows: at most ``top`` names each."""
    return {c: [r[0] for r in train.filter(C(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(top).select(c).collect()]
            for c in cat}


def _category_stages(kept: Mapping[str, Sequence[str]]) -> list[Stage]:
    """Values that are rare or new at scoring time become 'other'; the list travels with the fitted pipeline."""
    if not kept:
        return []

    def quoted(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    names = ", ".join(f"CASE WHEN {c} IN ({', '.join(map(quoted, v))}) THEN {c} ELSE 'other' END AS {c}_top" if v else f"'other' AS {c}_top"
                      for c, v in kept.items())
    return [SQLTransformer(statement=f"SELECT *, {names} FROM __THIS__"),
            *[StringIndexer(inputCol=f"{c}_top", outputCol=f"{c}_ix", handleInvalid="keep") for c in kept]]


def with_values(df: DataFrame, num: Sequence[str]) -> list[str]:
    """The numeric columns that have any value: nothing can be learned from the others, nor put in their place."""
    if not num:
        return []
    found = df.agg(*[F.max(F.col(c).isNotNull() & ~F.isnan(c)).alias(c) for c in num]).first()
    return [c for c in num if found[c]]


def linear_stages(num: Sequence[str], kept: Mapping[str, Sequence[str]]) -> list[Stage]:
    """Median impute, signed log, standardise; one-hot with unseen values as all zeros."""
    filled, cat = [f"{c}_filled" for c in num], list(kept)
    logs = ", ".join(f"signum({c}) * log1p(abs({c})) AS {c}_log" for c in filled)
    return [
        Imputer(strategy="median", inputCols=list(num), outputCols=filled),
        SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_log" for c in filled], outputCol="num_raw"),
        StandardScaler(inputCol="num_raw", outputCol="num_scaled", withMean=True),
        *_category_stages(kept),
        *([OneHotEncoder(inputCols=[f"{c}_ix" for c in cat], outputCols=[f"{c}_hot" for c in cat],
                         handleInvalid="keep")] if cat else []),
        VectorAssembler(inputCols=["num_scaled", *[f"{c}_hot" for c in cat]], outputCol="features"),
    ]


def tree_stages(num: Sequence[str], kept: Mapping[str, Sequence[str]]) -> list[Stage]:
    """Median impute; indexed categories stay categorical for the trees."""
    filled = [f"{c}_filled" for c in num]
    return [
        Imputer(strategy="median", inputCols=list(num), outputCols=filled),
        *_category_stages(kept),
        VectorAssembler(inputCols=[*filled, *[f"{c}_ix" for c in kept]], outputCol="features"),
    ]
