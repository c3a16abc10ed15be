"""Input order and completeness: ties go to the first that was asked for, whatever the partitions."""

import pytest
from pyspark.sql import functions as F

from epitrail.operators import checks, results
from epitrail.operators.scan import with_ordinal
from epitrail.predictors.base import ExpressionPredictor


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_dense_numbers(spark, parts):
    df = spark.range(0, 200, 1, parts).where("id % 3 <> 0 OR id > 150").select(F.col("id").alias("x"))
    got = [(r.ord, r.x) for r in with_ordinal(df).orderBy("ord").collect()]
    assert got == list(enumerate(i for i in range(200) if i % 3 or i > 150))
    assert with_ordinal(df.where("x < 0")).count() == 0


def flat(spark, alleles):
    """Every pair has the same score and rank."""
    return ExpressionPredictor(spark, alleles, {"score": F.lit(0.5), "value": F.lit(100.0), "percentile_rank": F.lit(1.0)})


@pytest.mark.parametrize("parts", [1, 4, 13])
@pytest.mark.parametrize("alleles", [["HLA-B*07:02", "HLA-A*02:01", "HLA-C*07:01"], ["HLA-C*07:01", "HLA-B*07:02"]])
def test_first_wins_ties_of_proteins(spark, parts, alleles):
    seqs = [(f"p{i}", "ACDEFGHIKLM" * (1 + i % 3)) for i in range(20)]
    df = spark.createDataFrame(seqs, "name string, seq string").repartition(1).sortWithinPartitions(F.length("name"), "name")
    split = spark.createDataFrame(spark.sparkContext.parallelize(df.collect(), parts), df.schema)
    rows = flat(spark, alleles).predict_proteins(split, [9], ordered=True)
    for best in (results.best_by_score(rows), results.best_by_rank(rows)):
        assert {r.allele for r in best.collect()} == {alleles[0]}
    # of the places of a repeated peptide, the first sequence and offset
    first = {}
    for name, seq in seqs:
        for o in range(len(seq) - 8):
            first.setdefault(seq[o : o + 9], (name, o))
    got = results.best_by_score(rows, key=("peptide",)).collect()
    assert {r.peptide: (r.source_sequence_name, r.offset) for r in got} == first
    for r in results.nested(rows).collect():
        assert [x.allele for x in r.preds] == alleles


def test_first_wins_ties_of_peptides(spark):
    given = ["WWWWWWWWW", "AAAAAAAAA", "WWWWWWWWW", "CCCCCCCCC"]
    rows = flat(spark, ["HLA-B*07:02", "HLA-A*02:01"]).predict(given, ordered=True)
    assert [(r.peptide, r.allele) for r in rows.orderBy("ord").collect()] == [(p, a) for p in ("WWWWWWWWW", "AAAAAAAAA", "CCCCCCCCC") for a in ("HLA-B*07:02", "HLA-A*02:01")]
    assert results.best_by_score(rows, key=()).first().peptide == "WWWWWWWWW"


@pytest.mark.parametrize("n_alleles", [0, 1, 63, 64, 65, 200])
def test_completeness_bits(spark, n_alleles):
    names = [f"A{i:03}" for i in range(n_alleles)]
    asked = ["P", "Q", "R", "R", "S"]
    have = [(p, a) for p in ("P", "Q", "T") for a in names if not (p == "Q" and a in ("A000", "A062", "A063", "A064", "A199"))] * 2
    have += [("P", "other"), ("U", "other"), ("P", "other"), ("Q", None)]
    res = spark.createDataFrame(have, "peptide string, allele string")
    pep = spark.createDataFrame([(p,) for p in asked], "peptide string")
    alleles = spark.createDataFrame([(a,) for a in names], "allele string")
    expected = {(p, a) for p in asked for a in names}
    pairs = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert pairs(checks.missing_pairs(res, pep, alleles)) == sorted(expected - set(have), key=str)
    assert pairs(checks.unexpected_pairs(res, pep, alleles)) == sorted(set(have) - expected, key=str)


def test_one_shuffle(spark):
    res = spark.createDataFrame([("P", "A")], "peptide string, allele string")
    bits = checks.pair_bits(res, res.select("peptide"), ["A", "B"])
    plan = bits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_too_many_alleles(spark, monkeypatch):
    monkeypatch.setattr(checks, "MOST_ALLELES", 3)
    with pytest.raises(ValueError, match="at most 3"):
        checks.names_of(spark.range(5).select(F.col("id").cast("string").alias("allele")))
