"""From feature tables to predictions and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import finite, iso_utc, name, safe_label, top_entries


def drop_for_scoring(df: DataFrame) -> DataFrame:
    """Identifier and label columns out; the data-set tag stays."""
    return df.drop(*S.SCORING_IDENTIFIERS, *S.SCORING_LABELS)


def impute_scoring(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null, NaN and infinities become 0 in numeric columns."""
    kinds = dict(df.dtypes)
    numeric = {c for c in (columns or df.columns)
               if kinds[c] in ("float", "double", "int", "bigint", "smallint", "tinyint")}
    return df.select(*[
        (finite(name(c)) if kinds[c] in ("float", "double") else F.coalesce(name(c), F.lit(0)))
        .alias(c) if c in numeric else name(c) for c in df.columns])


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's features in its order; an absent feature is an error that names it."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"required features are missing: {missing}")
    return df.select(*[name(c) for c in names], *[name(c) for c in keep])


def decode_class(index: Column, labels: Sequence[str]) -> Column:
    """Class name of an index; an unknown index as text."""
    known = F.array(*[F.lit(v) for v in labels])
    i = index.cast("int")
    return F.coalesce(F.get(known, i), i.cast("string"))


def prediction_columns(df: DataFrame, probabilities: str, labels: Sequence[str],
                       index: str | None = None, digits: int | None = 6) -> DataFrame:
    """Add ``prediction``, ``confidence`` (largest probability) and the ``probabilities`` map.

    ``probabilities`` is an array column; without an ``index`` column the first largest
    entry wins.
    """
    p = F.col(probabilities)
    if digits is not None:
        p = F.transform(p, lambda x: F.round(x, digits))
    df = df.withColumn(probabilities, p)
    best = (F.col(index) if index else
            F.array_position(probabilities, F.array_max(probabilities)) - 1)
    return (df.withColumn("prediction", decode_class(best, labels))
            .withColumn("confidence", F.array_max(probabilities))
            .withColumn("probabilities", F.map_from_arrays(
                F.array(*[F.lit(v) for v in labels]), F.col(probabilities))))


def probability_columns(df: DataFrame, probabilities: str, labels: Sequence[str]) -> DataFrame:
    """One column ``Probability_<class>`` per class."""
    return df.withColumns({f"Probability_{safe_label(v)}": F.col(probabilities)[i]
                           for i, v in enumerate(labels)})


def prediction_counts(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(name(prediction).alias("Prediction")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "Prediction"))


def head_of_predictions(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows by position, for a look at the result."""
    shown = [c for c in df.columns if c in ("Prediction", "prediction", "confidence")
             or c.startswith("Probability_")]
    return df.orderBy(*order).limit(n).select(*[name(c) for c in [*order, *shown]])


def alerts(df: DataFrame, only_non_benign: bool = False, min_confidence: float = 0.0) -> DataFrame:
    """Hide benign predictions and those below the confidence; batch or stream."""
    if only_non_benign:
        df = df.where(~F.col("prediction").eqNullSafe(F.lit(S.BENIGN_GROUP)))
    return df.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)


def top_probabilities(df: DataFrame, n: int = 2) -> DataFrame:
    return df.withColumn("top", top_entries(F.col("probabilities"), n))


def to_alert_json(df: DataFrame) -> DataFrame:
    """One compact JSON object per alert, in a single text column."""
    return df.select(F.to_json(F.struct(
        iso_utc(F.unix_micros("end_time") / 1e6).alias("ts"), "src_ip", "dst_ip", "src_port",
        "dst_port", F.col("protocol").alias("proto"),
        F.round("duration_s", 6).alias("duration_s"), "packets", "prediction", "confidence",
        "probabilities")).alias("value"))
