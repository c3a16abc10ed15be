import pytest
from pyspark.sql import functions as F

from epitrail import schema
from epitrail.operators import checks, combine, results
from epitrail.predictors.base import ExpressionPredictor, MultiSample, RandomPredictor

KEY = ("peptide",)
MIXED = [
    ("KLWPERSTV", "pMHC_affinity", "HLA-A*02:01", 0.71, 33.25, 0.4),
    ("KLWPERSTV", "pMHC_affinity", "HLA-C*07:01", 0.28, 7100.0, 22.0),
    ("KLWPERSTV", "pMHC_presentation", "HLA-A*02:01", 0.88, None, 0.6),
    ("KLWPERSTV", "pMHC_presentation", "HLA-C*07:01", 0.07, None, 31.0),
    ("KLWPERSTV", "antigen_processing", "", 0.64, None, None),
]


def mixed(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(MIXED)], "ord long, peptide string, kind string, allele string, score double, value double, percentile_rank double")
    return schema.canonical(df, keep=("ord",))


def test_schema(spark):
    df = mixed(spark).drop("ord")
    assert tuple(df.columns) == schema.COLUMNS and [f.dataType for f in df.schema] == [f.dataType for f in schema.PREDICTION]
    assert schema.empty(spark).columns == df.columns
    row = schema.canonical(spark.createDataFrame([(None, float("nan"))], "score double, value double"), kind="x", predictor_name="p").first()
    assert (row.score, row.value, row.allele, row.kind, row.predictor_name, row.offset, row.source_sequence_name) == (0.0, None, "", "x", "p", 0, None)
    old = schema.legacy(df)
    assert tuple(old.columns) == schema.LEGACY_COLUMNS and {r.length for r in old.collect()} == {9}
    assert schema.from_legacy(old, "k").where("value = 33.25 and kind = 'k'").count() == 1
    assert schema.from_json(schema.to_json(df)).exceptAll(df).count() == 0
    extra = spark.createDataFrame([('{"peptide":"A","score":1,"kind":"k","unknown":5}',)], "json string")
    assert schema.from_json(extra).first().score == 1.0
    assert len(schema.KINDS) == 8 and schema.describe(df).count() == 5


def test_best(spark):
    df = mixed(spark)
    best = {r.kind: r for r in results.best_by_score(df, key=KEY).collect()}
    assert best["pMHC_affinity"].value == 33.25 and best["pMHC_presentation"].score == 0.88 and best["antigen_processing"].allele == ""
    ranked = {r.kind: r for r in results.best_by_rank(df, key=KEY).collect()}
    assert set(ranked) == {"pMHC_affinity", "pMHC_presentation"} and ranked["pMHC_presentation"].percentile_rank == 0.6
    assert results.best_by_score(df, "pMHC_stability", KEY).count() == 0
    wide = results.best_table(df, ["pMHC_affinity", "pMHC_stability"], KEY).first()
    assert wide.pMHC_affinity.allele == "HLA-A*02:01" and wide.pMHC_stability is None


def test_ties_and_nan(spark):
    rows = [(0, "P", "k", "a", float("nan")), (1, "P", "k", "b", 0.5), (2, "P", "k", "c", 0.5), (3, "P", "k", "", 0.9)]
    df = schema.canonical(spark.createDataFrame(rows, "ord long, peptide string, kind string, allele string, score double"), keep=("ord",))
    assert results.best_by_score(df, key=KEY).first().allele == "b"
    assert results.best_by_score(df.where("allele = ''"), key=KEY).first().score == 0.9


def test_groups(spark):
    row = results.nested(mixed(spark), KEY).first()
    assert [p.score for p in row.preds] == [r[3] for r in MIXED] and row.alleles == ["HLA-A*02:01", "HLA-C*07:01"] and len(row.kinds) == 3
    assert {r.kind: r.n for r in results.kind_counts(mixed(spark), KEY).collect()} == {"pMHC_affinity": 2, "pMHC_presentation": 2, "antigen_processing": 1}
    assert results.by_affinity(mixed(spark)).first().value == 33.25
    df, seen = results.counted(mixed(spark), "rows")
    df.count()
    assert seen.get["n"] == 5


def test_thresholds(spark):
    df = spark.createDataFrame([("A", 100.0, 1.0, 0.9), ("B", None, None, None), ("C", float("nan"), float("nan"), float("nan")), ("D", 900.0, 9.0, 0.1)], "peptide string, affinity double, percentile_rank double, score double")
    assert [r.peptide for r in results.thresholds(df, max_affinity=500, max_percentile_rank=2, min_score=0.5).collect()] == ["A", "B", "C"]
    assert results.thresholds(df).count() == 4
    assert results.only(mixed(spark), "pMHC_affinity", "HLA-C*07:01").count() == 1 and results.only(mixed(spark)).count() == 5


def test_violations(spark):
    words = {"SIINFEKL": None, "siinfekl": "not upper case", "SIINFEKX": "unknown residue", "SIINF": "too short", "S" * 20: "too long", "SII NFEKL": "not letters", "SIINFEKL\n": "not letters", "": "not letters"}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "peptide string")
    got = {r.peptide: r.v for r in df.select("peptide", checks.violation(F.col("peptide"), 8, 15).alias("v")).collect()}
    assert got == words | {None: "not letters"}
    good, bad = checks.split_valid(df, least=8, most=15)
    assert good.count() == 1 and bad.count() == 8
    with pytest.raises(Exception, match="Invalid peptide"):
        checks.checked(df, least=8).collect()
    assert spark.range(1).select(checks.violation(F.lit("SIINFEKX"), allow_x=True)).first()[0] is None


def test_completeness(spark):
    peptides = spark.createDataFrame([(f"P{i}", i) for i in range(50)], "peptide string, ord long")
    alleles = spark.createDataFrame([(f"A{i}", i) for i in range(50)], "allele string, allele_ord long")
    full = peptides.crossJoin(alleles)
    assert checks.require_complete(full, peptides, alleles) is full
    gap = full.where("not (peptide = 'P7' and allele = 'A9')")
    doubled = gap.unionByName(full.where("peptide = 'P1' and allele = 'A1'"))
    with pytest.raises(checks.MissingPredictions, match="P7 and A9"):
        checks.require_complete(doubled, peptides, alleles)
    with pytest.raises(checks.MissingPredictions, match="Unexpected"):
        checks.require_complete(full.unionByName(spark.createDataFrame([("P1", "B", 0, 0)], full.select("peptide", "allele", "ord", "allele_ord").schema).select(*full.columns)), peptides, alleles)


def test_alleles_and_lengths(spark):
    valid = spark.createDataFrame([("HLA-A*02:01",)], "allele string")
    with pytest.raises(checks.UnsupportedAllele):
        RandomPredictor(spark, "HLA-B*07:02", valid_alleles=valid)
    assert RandomPredictor(spark, "A0201,HLA-A*02:01", valid_alleles=valid).alleles.count() == 1
    with pytest.raises(ValueError):
        checks.require_one_length(spark.createDataFrame([("AA",), ("AAA",)], "peptide string"))


def standin(spark, alleles=("HLA-A*02:01", "HLA-B*07:02"), **kw):
    return ExpressionPredictor(spark, alleles, {"value": F.length("peptide") * 10.0, "score": F.lit(0.5)}, name="standin", **kw)


def test_relocation(spark):
    seqs = {"one": "SIINFEKLAA", "two": "SIINFEKLAA", "three": "AASIINFEKL", "tiny": "AAA"}
    df = standin(spark).predict_proteins(seqs, 9, validate=True)
    assert df.count() == 3 * 2 * 2 and set(df.columns) == set(schema.COLUMNS)
    for r in df.collect():
        assert seqs[r.source_sequence_name][r.offset : r.offset + 9] == r.peptide
    assert standin(spark).predict("SIINFEKL", validate=True).count() == 2
    assert standin(spark).predict_legacy(["SIINFEKL", "SIINFEKL"]).count() == 2


def test_random(spark):
    p = RandomPredictor(spark, ["HLA-A*02:01", "HLA-B*07:02"], seed=3)
    a = p.predict_proteins({"seq0": "SIINFEKLQYSIINFEKLQY"}, [8, 9])
    b = RandomPredictor(spark, ["HLA-A*02:01", "HLA-B*07:02"], seed=3).predict_proteins({"seq0": "SIINFEKLQYSIINFEKLQY"}, [8, 9]).repartition(7)
    assert a.exceptAll(b).count() == 0 and a.count() == (13 + 12) * 2
    assert a.where("score < 0 or score >= 1 or value < 0 or value >= 10000 or percentile_rank < 0 or percentile_rank > 99").count() == 0


def test_samples(spark):
    made = MultiSample(spark, {"pat1": "HLA-A*02:01", "pat2": ["HLA-B*07:02", "A0201"]}, standin)
    df = made.predict(["SIINFEKL", "SIINFEKLAA"])
    assert {(r.sample_name, r.allele) for r in df.collect()} == {("pat1", "HLA-A*02:01"), ("pat2", "HLA-B*07:02"), ("pat2", "HLA-A*02:01")} and df.count() == 6
    assert made.predict_proteins({"p": "SIINFEKLAA"}, 9).count() == 6


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    right = spark.createDataFrame([("a", 5)], "k string, y int")
    with pytest.raises(Exception, match="No row for b"):
        combine.with_mandatory(left, right, ["k"]).collect()
    assert combine.with_mandatory(left.where("k = 'a'"), right, ["k"]).first().y == 5
    names = spark.createDataFrame([("a", "A")], "key string, name string")
    assert sorted(r.k for r in combine.remap(left, names, "k").collect()) == ["A", "b"]


def test_described(spark):
    numbers = [0.5, 12345.0, 12355.0, 9999.5, 0.00012346, 0.00001, 100.25, 7.0, 1e-9, 123456789.0, 0.0, -2.5, 1000.5, 1001.5, 99995.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", schema.four_digits(F.col("x")).alias("t"))
    assert {r.x: r.t for r in df.collect()} == {x: f"{x:.4g}" for x in numbers}
    rows = [r.text for r in schema.describe(mixed(spark)).collect()]
    assert "Prediction(KLWPERSTV | HLA-A*02:01 | pMHC_affinity | score=0.71 | value=33.25 | rank=0.40%)" in rows
    assert "Prediction(KLWPERSTV | antigen_processing | score=0.64)" in rows


def test_text_forms(spark):
    rows = spark.createDataFrame(
        [("AAA", 0, "s", "k2", 0, "x"), ("AAA", 0, "s", "k1", 1, "x"), ("AAA", 0, "s", "k2", 2, "y"), ("", 3, None, "k1", 3, "x")],
        "peptide string, offset int, source_sequence_name string, kind string, ord long, allele string",
    )
    assert {r.offset: r.text for r in schema.describe_peptides(rows).collect()} == {0: "PeptideResult(AAA, 3 preds: 2×k2, 1×k1)", 3: "PeptideResult(?, 1 preds: 1×k1)"}
    assert schema.describe_peptides(rows.drop("ord")).where("offset = 0").first().text == "PeptideResult(AAA, 3 preds: 1×k1, 2×k2)"
    older = schema.legacy(schema.canonical(rows.where("ord < 2").withColumn("score", F.lit(0.12345)).withColumn("value", F.when(F.col("ord") == 0, 1234.5678)), predictor_name="p"))
    assert schema.describe_legacy(older.orderBy("affinity")).collect()[-1].text == (
        "BindingPrediction(peptide='AAA', allele='x', score=0.123, percentile_rank=None, affinity=1234.568, source_sequence_name='s', offset=0, prediction_method_name='p')"
    )


def test_nested_json(spark):
    rows = standin(spark).predict_proteins({"one": "SIINFEKLAA", "two": "SIINFEKLAA"}, 9, ordered=True)
    made = schema.to_nested_json(rows)
    assert made.count() == 4 and made.first().json.startswith('{"preds":[{"peptide":')
    back = schema.from_nested_json(made)
    assert sorted(map(str, back.drop("ord").collect())) == sorted(map(str, rows.drop("ord").collect()))
    assert {r.allele for r in back.where("ord = 0").collect()} == {"HLA-A*02:01"}


def test_logging(spark, tmp_path, capsys):
    import logging

    from epitrail import cli

    cli.configure_logging()
    cli.configure_logging()
    assert len(logging.getLogger("epitrail").handlers) == 1
    (tmp_path / "log.conf").write_text(
        "[loggers]\nkeys=root,own\n[handlers]\nkeys=h\n[formatters]\nkeys=f\n[logger_root]\nlevel=WARNING\nhandlers=h\n[logger_own]\nlevel=DEBUG\nhandlers=h\nqualname=epitrail\npropagate=0\n"
        f"[handler_h]\nclass=FileHandler\nformatter=f\nargs=('{tmp_path}/out.log',)\n[formatter_f]\nformat=%(name)s %(message)s\n"
    )
    cli.configure_logging(str(tmp_path / "log.conf"))
    logging.getLogger("epitrail.cli").debug("told")
    assert (tmp_path / "out.log").read_text() == "epitrail.cli told\n"
