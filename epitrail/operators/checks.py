"""Validation of peptides and alleles, and completeness of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnsupportedAllele(ValueError):
    """A predictor does not know an allele."""


class MissingPredictions(ValueError):
    """Results lack a pair of peptide and allele, or have one too many."""


#: Violations in the order in which they are looked for.
VIOLATIONS = ("not letters", "unknown residue", "not upper case", "too short", "too long")


def violation(peptide: Column, least: int | None = None, most: int | None = None, allow_x: bool = False, allow_lower: bool = False) -> Column:
    """The first of :data:`VIOLATIONS` that a peptide commits, or null."""
    found = F.when(~F.coalesce(peptide, F.lit("")).rlike(r"\A\p{L}+\z"), VIOLATIONS[0])
    if not allow_x:
        found = found.when(peptide.contains("X"), VIOLATIONS[1])
    if not allow_lower:
        found = found.when(peptide != F.upper(peptide), VIOLATIONS[2])
    if least is not None:
        found = found.when(F.length(peptide) < least, VIOLATIONS[3])
    if most is not None:
        found = found.when(F.length(peptide) > most, VIOLATIONS[4])
    return found


def checked(peptides: DataFrame, **limits) -> DataFrame:
    """The same rows; reading one that commits a violation is an error."""
    why = violation(F.col("peptide"), **limits)
    error = F.raise_error(F.concat(F.lit("Invalid peptide '"), F.coalesce("peptide", F.lit("null")), F.lit("': "), why)).cast("string")
    return peptides.withColumn("peptide", F.when(why.isNull(), F.col("peptide")).otherwise(error))


def split_valid(peptides: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with their ``violation``."""
    marked = peptides.withColumn("violation", violation(F.col("peptide"), **limits))
    return marked.where("violation IS NULL").drop("violation"), marked.where("violation IS NOT NULL")


def unsupported(alleles: DataFrame, valid: DataFrame) -> DataFrame:
    return alleles.join(valid.select("allele").distinct(), "allele", "left_anti")


def require_supported(alleles: DataFrame, valid: DataFrame) -> DataFrame:
    bad = [r.allele for r in unsupported(alleles, valid).select("allele").distinct().orderBy("allele").limit(10).collect()]
    if bad:
        raise UnsupportedAllele(f"Unsupported alleles: {', '.join(bad)}")
    return alleles


def require_one_length(peptides: DataFrame) -> DataFrame:
    """``peptides``; an error if they differ in length."""
    low, high = peptides.agg(F.min(F.length("peptide")), F.max(F.length("peptide"))).first()
    if low != high:
        raise ValueError(f"All peptides must have one length; there are {low} to {high}")
    return peptides


#: Alleles of a run at most: their numbers are literals, and each 64 are a column of bits.
MOST_ALLELES = 4096


def names_of(alleles: DataFrame) -> list[str]:
    """The alleles of one run, a short list, whose size is checked; so no result is shuffled by allele, of which there are few."""
    found = [r.allele for r in alleles.select("allele").where("allele IS NOT NULL").distinct().limit(MOST_ALLELES + 1).collect()]
    if len(found) > MOST_ALLELES:
        raise ValueError(f"A run has at most {MOST_ALLELES} alleles; split it")
    return sorted(found)


def _numbered(results: DataFrame, names: list[str]) -> DataFrame:
    """``peptide, allele, number`` of results: the allele's among the ``names``, or null."""
    number = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))), F.col("allele")) if names else F.lit(None).cast("int")
    return results.select("peptide", "allele", number.alias("number"))


def pair_bits(results: DataFrame, peptides: DataFrame, names: list[str], listed: bool = True) -> DataFrame:
    """``peptide, asked, bits[, others]`` of each peptide that was asked for or has results: one row, one shuffle.

    ``bits``: an array of longs in which bit i says whether there is a result for ``names[i]``; ``others``: alleles of results that are not among the
    ``names``, if they are to be ``listed``. Bits are combined before rows move, so repeated results cost nothing. Lists have Spark sort all rows by peptide; bits alone do not.
    """
    words = range(-(-len(names) // 64))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64)
    zero = F.lit(0).cast("long")
    told = _numbered(results, names)
    other = [F.when(F.col("number").isNull(), F.struct("allele")).alias("other")] if listed else []
    none = [F.lit(None).cast("struct<allele: string>").alias("other")] if listed else []
    seen = told.select("peptide", F.lit(False).alias("asked"), *(F.when(F.floor(F.col("number") / 64) == w, one).otherwise(zero).alias(f"w{w}") for w in words), *other)
    wanted = peptides.select("peptide", F.lit(True).alias("asked"), *(zero.alias(f"w{w}") for w in words), *none)
    sets = [F.collect_set("other").alias("others")] if listed else []
    both = seen.unionByName(wanted).groupBy("peptide").agg(F.max("asked").alias("asked"), *(F.bit_or(f"w{w}").alias(f"w{w}") for w in words), *sets)
    names_of_others = [F.transform("others", lambda x: x["allele"]).alias("others")] if listed else []
    return both.select("peptide", "asked", F.array(*(f"w{w}" for w in words)).cast("array<bigint>").alias("bits"), *names_of_others)


def others(results: DataFrame, names: list[str]) -> DataFrame:
    """``peptide, allele`` of the results whose allele is not among the ``names``, each once."""
    return _numbered(results, names).where("number IS NULL").select("peptide", "allele").distinct()


def _named(names: list[str], is_set: bool) -> Column:
    """Those of the names whose bit is set, or is not."""
    at = lambda i: F.get("bits", F.floor(i / 64).cast("int"))
    bit = lambda i: F.call_function("getbit", at(i), (i % 64).cast("int")) == int(is_set)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), bit) if names else F.array().cast("array<int>")
    listed = F.array(*map(F.lit, names)).cast("array<string>")
    return F.transform(chosen, lambda i: F.get(listed, i))


def _told(bits: DataFrame, names: list[str]) -> DataFrame:
    """``what, peptide, allele`` by :func:`pair_bits`: a peptide that was asked for misses the names without a bit; of another, those with a bit are unexpected."""
    alleles = F.when(F.col("asked"), _named(names, False)).otherwise(_named(names, True))
    return bits.select(F.when(F.col("asked"), "missing").otherwise("unexpected").alias("what"), "peptide", F.explode(alleles).alias("allele"))


def gaps(results: DataFrame, peptides: DataFrame, alleles: DataFrame) -> DataFrame:
    """:func:`missing_pairs` and :func:`unexpected_pairs` in one table, with ``what``: ``missing`` or ``unexpected``; bits are gathered once."""
    names = names_of(alleles)
    return _told(pair_bits(results, peptides, names, listed=False), names).unionByName(others(results, names).withColumn("what", F.lit("unexpected")))


def missing_pairs(results: DataFrame, peptides: DataFrame, alleles: DataFrame) -> DataFrame:
    """``peptide, allele`` of the expected pairs that have no result, read from :func:`pair_bits`."""
    names = names_of(alleles)
    return pair_bits(results, peptides, names, listed=False).where("asked").select("peptide", F.explode(_named(names, False)).alias("allele"))


def unexpected_pairs(results: DataFrame, peptides: DataFrame, alleles: DataFrame) -> DataFrame:
    """``peptide, allele`` of the results that nobody asked for, read from :func:`pair_bits`, and of :func:`others`."""
    names = names_of(alleles)
    known = pair_bits(results, peptides, names, listed=False).where("NOT asked").select("peptide", F.explode(_named(names, True)).alias("allele"))
    return known.unionByName(others(results, names))


def require_complete(results: DataFrame, peptides: DataFrame, alleles: DataFrame) -> DataFrame:
    """``results``; an error names the first missing pair in input order (``ord``, ``allele_ord`` where there are such)."""
    odd = unexpected_pairs(results, peptides, alleles).first()
    if odd:
        raise MissingPredictions(f"Unexpected prediction for {odd.peptide} and {odd.allele}")
    missing = missing_pairs(results, peptides, alleles)
    for frame, key, order in ((alleles, "allele", "allele_ord"), (peptides, "peptide", "ord")):
        if order in frame.columns:
            missing = missing.join(frame.groupBy(key).agg(F.min(order).alias(order)), key)
    order = [c for c in ("allele_ord", "ord") if c in missing.columns]
    first = missing.orderBy(*order, "allele", "peptide").first()
    if first:
        raise MissingPredictions(f"Missing prediction for {first.peptide} and {first.allele}")
    return results
