"""Reading results: filters, best rows, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("peptide", "offset", "source_sequence_name")


def _missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def thresholds(df: DataFrame, max_affinity: float | None = None, max_percentile_rank: float | None = None, min_score: float | None = None) -> DataFrame:
    """Rows within all given limits; a missing value is within any limit. Reads canonical or older columns."""
    value = "affinity" if "affinity" in df.columns else "value"
    keep = F.lit(True)
    if max_affinity is not None:
        keep &= _missing(F.col(value)) | (F.col(value) <= max_affinity)
    if max_percentile_rank is not None:
        keep &= _missing(F.col("percentile_rank")) | (F.col("percentile_rank") <= max_percentile_rank)
    if min_score is not None:
        keep &= _missing(F.col("score")) | (F.col("score") >= min_score)
    return df.where(keep)


def only(df: DataFrame, kind: str | None = None, allele: str | None = None) -> DataFrame:
    """Rows of a kind and an allele; None is no condition."""
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    return df if allele is None else df.where(F.col("allele") == allele)


def _order(df: DataFrame) -> list[Column]:
    """Input order where the rows carry it, else a fixed order of the contents."""
    return [F.col(c) for c in (("ord",) if "ord" in df.columns else ("allele", "predictor_name", "predictor_version", "value")) if c in df.columns]


def _first(df: DataFrame, key, order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def best_by_score(df: DataFrame, kind: str | None = None, key=KEY) -> DataFrame:
    """The row of highest score for each key and kind: among rows with an allele, or all if none has one.

    The first of equal scores wins, by ``ord`` if there is such a column; NaN ranks last.
    """
    rows = only(df, kind)
    score = F.when(F.isnan("score"), F.lit(None)).otherwise(F.col("score"))
    return _first(rows, [*key, "kind"], [(F.col("allele") == "").asc(), score.desc_nulls_last(), *_order(rows)])


def best_by_rank(df: DataFrame, kind: str | None = None, key=KEY) -> DataFrame:
    """The row of lowest percentile rank for each key and kind, among rows with an allele and a rank."""
    rows = only(df, kind).where((F.col("allele") != "") & ~_missing(F.col("percentile_rank")))
    return _first(rows, [*key, "kind"], [F.col("percentile_rank").asc(), *_order(rows)])


def best_table(df: DataFrame, kinds, key=KEY) -> DataFrame:
    """One row a key with the best allele, score, value and rank of each kind in a struct named after it."""
    best = best_by_score(df, key=key)
    cells = [F.first(F.when(F.col("kind") == k, F.struct("allele", "score", "value", "percentile_rank")), ignorenulls=True).alias(k) for k in kinds]
    return best.groupBy(*key).agg(*cells)


def nested(df: DataFrame, key=KEY) -> DataFrame:
    """One row a key with its predictions in ``preds``, in input order where known, plus ``kinds``, ``alleles`` and counts."""
    fields = [c for c in df.columns if c not in key and c != "ord"]
    position = [c for c in ("ord",) if c in df.columns]
    item = F.struct(*position, *fields)
    groups = df.groupBy(*key).agg(
        F.sort_array(F.collect_list(item)).alias("preds"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.sort_array(F.collect_set(F.when(F.col("allele") != "", F.col("allele")))).alias("alleles"),
        F.count("*").alias("n_preds"),
    )
    return groups.withColumn("preds", F.transform("preds", lambda x: F.struct(*(x[f].alias(f) for f in fields))))


def kind_counts(df: DataFrame, key=KEY) -> DataFrame:
    return df.groupBy(*key, "kind").agg(F.count("*").alias("n"))


def by_affinity(df: DataFrame) -> DataFrame:
    """Strongest binders first."""
    return df.orderBy(F.col("value").asc_nulls_last(), "peptide", "allele")


def counted(df: DataFrame, name: str):
    """``df`` and an observation that has its row count in ``get['n']`` once it has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
