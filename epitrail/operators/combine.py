"""Pairing peptides with alleles, and putting scores back where they belong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitrail.operators.checks import names_of

#: Rows of samples that are broadcast at most, and parts that the scores of an allele are dealt into beyond that.
SMALL, SPREAD = 20_000, 64


def pairs(peptides: DataFrame, alleles: DataFrame) -> DataFrame:
    """Every peptide with every allele.

    The alleles of a run are a short list (a genotype has a dozen), so they become an array that each row explodes; the
    peptides are not moved.
    """
    rows = names_of(alleles)
    return peptides.select("*", F.explode(F.array(*map(F.lit, rows)).cast("array<string>")).alias("allele"))


def relocate(windows: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores of distinct peptides at each place of the peptide; places without a score go.

    ``windows``: ``name, offset, peptide``, and ``ord`` if the places are numbered. The scores' own places, numbers and flanks are replaced.
    """
    rest = [c for c in scored.columns if c not in ("source_sequence_name", "offset", "n_flank", "c_flank", "ord")]
    at = windows.select("peptide", F.col("name").alias("source_sequence_name"), "offset", *(c for c in ("ord",) if c in windows.columns))
    return at.join(scored.select(*rest), "peptide")


def with_mandatory(left: DataFrame, right: DataFrame, keys: list[str], what: str = "row") -> DataFrame:
    """A left join in which a row without a match is an error."""
    marked = right.withColumn("_found", F.lit(True))
    joined = left.join(marked, keys, "left")
    name = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    error = F.raise_error(F.concat(F.lit(f"No {what} for "), name)).cast("boolean")
    return joined.withColumn("_found", F.coalesce("_found", error)).where("_found").drop("_found")


def remap(df: DataFrame, mapping: DataFrame, column: str = "source_sequence_name", strict: bool = False) -> DataFrame:
    """``column`` by ``mapping`` (key, name); keys outside it stay, or are an error if ``strict``."""
    names = mapping.select(F.col("key").alias(column), F.col("name").alias("_name"))
    joined = with_mandatory(df, names, [column], "name") if strict else df.join(names, column, "left")
    return joined.withColumn(column, F.coalesce("_name", column)).select(*df.columns)


def union(frames: list[DataFrame]) -> DataFrame:
    """Results of several predictors or samples, one below the other."""
    return reduce(DataFrame.unionByName, frames)


def for_samples(scored: DataFrame, samples: DataFrame) -> DataFrame:
    """Scores of distinct pairs for each sample that has the allele; ``samples``: ``sample_name, allele``.

    Alleles are few, so a join on them would gather the scores in a few tasks. Up to ``SMALL`` rows of samples are broadcast; of
    more, the scores are dealt by peptide too.
    """
    own = samples.select("sample_name", "allele").distinct()
    rows = scored.drop("sample_name")
    if len(own.limit(SMALL + 1).collect()) <= SMALL:
        return rows.join(F.broadcast(own), "allele")
    parts = F.lit(SPREAD)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("peptide"), parts).cast("int"))
    return salted.join(own.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))), ["allele", "_salt"]).drop("_salt")
