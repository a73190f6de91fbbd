"""Fraud features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.functions.text import last_label
from watchfold.operators.profiling import columns_like
from watchfold.scale import attach_by_key, exact_quantiles, prefix_sum, trailing_totals


def join_identity(tx: DataFrame, identity: DataFrame, key: str, witness: str, flag: str = "has_identity") -> DataFrame:
    """Attach the optional side; the flag is read from one of its columns, not from the key."""
    return tx.join(identity, key, "left").withColumn(flag, F.col(witness).isNotNull().cast("int"))


def impute_median(df: DataFrame, col: str) -> DataFrame:
    """Fill nulls with the exact median and flag them in ``<col>_missing``."""
    median = exact_quantiles(df, col, {"q": 0.5}).select("q").scalar()
    return df.withColumn(f"{col}_missing", F.col(col).isNull().cast("int")).withColumn(
        col, F.coalesce(F.col(col).cast("double"), median)
    )


def velocity(
    df: DataFrame,
    key: str,
    micros: str,
    amount: str,
    windows: Mapping[str, int],
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Count and sum of a key's strictly earlier rows, no older than each window.

    Adds ``velocity_count_<label>`` and ``velocity_value_<label>``.
    """
    out = trailing_totals(df, key, micros, windows, amount, bucket_seconds=bucket_seconds)
    for label in windows:
        out = out.withColumnRenamed(f"count_{label}", f"velocity_count_{label}").withColumnRenamed(
            f"value_{label}", f"velocity_value_{label}"
        )
    return out


def counter_totals(df: DataFrame, pattern: str = r"C\d+", total: str = "c_total", peak: str = "c_max") -> DataFrame:
    """Row-wise sum and maximum over the counter columns, null as 0."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns_like(df, pattern)]
    if not cols:
        return df
    summed = cols[0]
    for c in cols[1:]:
        summed = summed + c
    return df.withColumn(total, summed).withColumn(peak, F.greatest(*cols) if len(cols) > 1 else cols[0])


def missing_flags(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """``cols`` maps a flag name to the column it tells about."""
    return df.withColumns({flag: F.col(c).isNull().cast("int") for flag, c in cols.items()})


def interactions(
    df: DataFrame,
    age: str,
    amount: str,
    product: str,
    express: str = "S",
    new_days: float = 7,
    high: float = 500,
    unknown_age: float = 999,
    age_cap: float = 365,
) -> DataFrame:
    """New-account and high-value-express flags; account age capped."""
    years = F.coalesce(F.col(age).cast("double"), F.lit(float(unknown_age)))
    new = years < new_days
    risky = new & (F.col(amount) > high) & (F.col(product) == express)
    return df.withColumns(
        {
            "new_acct_highval_express": F.coalesce(risky, F.lit(False)).cast("int"),
            "new_acct_flag": new.cast("int"),
            "addr_age_days": F.least(years, F.lit(float(age_cap))),
        }
    )


def tld_mismatch(df: DataFrame, a: str, b: str, out: str = "email_domain_mismatch") -> DataFrame:
    """1 where both last labels are present and differ."""
    x, y = last_label(a), last_label(b)
    return df.withColumn(out, ((x != y) & (x != "") & (y != "")).cast("int"))


def linkage_count(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rows sharing the row's value of ``col``; 1 for null or where the column is absent.

    Counted with map-side aggregation and looked up with the hot values apart, so
    a value shared by a third of all rows stays spread over the tasks.
    """
    if col not in df.columns:
        return df.withColumn(out, F.lit(1).cast("bigint"))
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    return attach_by_key(df, counts, col, out).withColumn(out, F.coalesce(F.col(out), F.lit(1).cast("bigint")))


def select_features(
    df: DataFrame, label: str, drop: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Drop listed columns, keep the label, align to the model's feature names.

    A feature the table lacks is 0; one it has is left as it is, nulls and texts too.
    """
    kept = df.drop(*drop)
    if names is None:
        return kept
    cols: list[Column] = [F.col(label)]
    for n in names:
        cols.append(F.col(n) if n in kept.columns else F.lit(0).alias(n))
    return kept.select(*cols)


def fit_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Code table: sorted distinct values numbered from 0."""
    seen = df.where(F.col(col).isNotNull()).select(col).distinct().withColumn("n", F.lit(1))
    return prefix_sum(seen, col, ["n"]).select(col, (F.col("cum_n") - 1).cast("int").alias(out))


def apply_codes(df: DataFrame, codes: DataFrame, col: str, code: str = "code") -> DataFrame:
    """Code of each row's value; -1 for null and for values not seen when fitting."""
    return df.join(codes, col, "left").withColumn(code, F.coalesce(F.col(code), F.lit(-1)))


def select_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is listed, with the list's other columns (such as its position)."""
    return df.join(ids, key)


def fraud_features(
    tx: DataFrame, identity: DataFrame, key: str, witness: str, account: str, micros: str, amount: str, windows: Mapping[str, int],
    distance: str, age: str, product: str, device: str, coded: Sequence[str] = (), express: str = "S", new_days: float = 7, high: float = 500,
) -> DataFrame:
    """The whole feature run: identity, imputed distance, account age, linkage, codes, and velocity.

    What depends on a row or on value counts comes first, so that it is counted on the
    transactions themselves; the windows are built once, at the end.  Code columns are ``<column>_code``.
    """
    out = join_identity(tx, identity, key, witness)
    out = impute_median(out, distance)
    out = interactions(out, age, amount, product, express, new_days, high)
    out = linkage_count(counter_totals(out), device, "device_linkage_count")
    for c in coded:
        out = apply_codes(out, fit_codes(tx, c, f"{c}_code"), c, f"{c}_code")
    return velocity(out, account, micros, amount, windows)
