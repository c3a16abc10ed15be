import pytest
from pyspark.sql import functions as F

from epitrail.functions.alleles import allele_parts, distinct_alleles, normalize_allele, render_allele, split_alleles
from epitrail.functions.text import int_list, models_path, parse_int_list, parse_version
from epitrail.plans.catalog import NAMES


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "raw string")
    assert {r.raw: r.a for r in df.select("raw", normalize_allele(F.col("raw")).alias("a")).collect()} == NAMES


def test_options(spark):
    df = spark.createDataFrame([("HLA-DRB1*07:01",), ("HLA-DRA*01:01/DRB1*03:01",), ("H2-AA*b/AB*b",), (" hla-a*0201 ",), ("A*001:012",), (None,)], "raw string")
    omit = [r[0] for r in df.select(normalize_allele(F.col("raw"), omit_dra1=True)).collect()]
    assert omit == ["HLA-DRB1*07:01", "HLA-DRB1*03:01", "H-2-IAb", "HLA-A*02:01", "HLA-A*01:12", None]
    assert df.select(normalize_allele(F.col("raw"), infer_pair=False)).first()[0] == "HLA-DRB1*07:01"
    with pytest.raises(Exception, match="Could not parse"):
        spark.createDataFrame([("HLA-A*02:01N",)], "raw string").select(normalize_allele(F.col("raw"), strict=True)).collect()


def test_distinct_in_order(spark):
    df = spark.createDataFrame([("A0201", 0), ("HLA-B*07:02", 1), ("HLA-A*02:01", 2)], "allele string, ord long")
    assert [tuple(r) for r in distinct_alleles(df).orderBy("allele_ord").collect()] == [("HLA-A*02:01", 0), ("HLA-B*07:02", 1)]


def test_parts_and_spellings(spark):
    df = spark.createDataFrame([("HLA-DRA1*01:01-DRB1*15:01",), ("H-2-IAb",)], "a string")
    parts = [[tuple(p) for p in r[0]] for r in df.select(allele_parts(F.col("a"))).collect()]
    assert parts == [[("HLA", "DRA1", "01", "01"), ("HLA", "DRB1", "15", "01")], [("H-2", "IA", "", "b")]]
    assert [r[0] for r in df.select(render_allele(F.col("a"), "class2")).collect()] == ["DRB1_1501", "H-2-IAb"]
    with pytest.raises(ValueError):
        render_allele(F.col("a"), "other")
    assert spark.range(1).select(split_alleles(F.lit("a, b  c,,d"))).first()[0] == ["a", "b", "c", "d"]


def test_text(spark):
    cases = {"1": [1], "1-3": [1, 2, 3], "9, 10": [9, 10], "9,10,12-13": [9, 10, 12, 13]}
    for text, want in cases.items():
        assert parse_int_list(text) == want
        assert spark.range(1).select(int_list(F.lit(text))).first()[0] == want
    assert spark.range(1).select(parse_version(F.lit("v4.2c"))).first()[0] == [4, 2]
    assert models_path(None) is None and models_path("~/x").startswith("/")


ANIMALS = {
    "BoLA-1:02301": "BoLA-1*23:01",
    "BoLA-1*023:01": "BoLA-1*23:01",
    "bola-6*01301": "BoLA-6*13:01",
    "BoLA-NC1*00101": "BoLA-NC1*01:01",
    "SLA-1*01:01": "SLA-1*01:01",
    "SLA-20502": "SLA-2*05:02",
    "Patr-A*01:01": "Patr-A*01:01",
    "Patr-B0101": "Patr-B*01:01",
    "DLA-88*50101": "DLA-88*501:01",
    "DLA-88*501:01": "DLA-88*501:01",
    "Mamu-A1*001:01": "Mamu-A1*01:01",
    "Mamu-A1*00101": "Mamu-A1*01:01",
    "Mamu-A01": "Mamu-A01",
    "Mamu-DPA1*02:01-DPB1*15:01": "Mamu-DPA1*02:01-DPB1*15:01",
    "Mamu-DPA1*02:01/Mamu-DPB1*15:01": "Mamu-DPA1*02:01-DPB1*15:01",
    "Gaga-BF2*21:01": "Gaga-BF2*21:01",
    "Eqca-1*001:01": "Eqca-1*01:01",
    "HLA-DR4": "HLA-DRB1*04:01",
    "DR17": "HLA-DRB1*03:01",
    "HLA-Cw7": "HLA-C*07:01",
    "HLA-DQ8": "HLA-DQB1*03:02",
    "HLA-DPw4": "HLA-DPB1*04:01",
    "A2": "HLA-A*02:01",
    # unknown genes, species, annotations and serotypes
    "SLA-88*01:01": None,
    "Mamu-A1*001:01N": None,
    "Xyz-A*01:01": None,
    "HLA-DR99": None,
    "HLA-Cw7Q": None,
    "Patr-": None,
}


def test_animals_and_serotypes(spark):
    df = spark.createDataFrame([(n,) for n in ANIMALS] * 2, "raw string")
    from epitrail.functions.alleles import with_normal_names

    assert {r.raw: r.a for r in df.select("raw", normalize_allele(F.col("raw")).alias("a")).collect()} == ANIMALS
    assert {r.raw: r.allele for r in with_normal_names(df, "raw").collect()} == ANIMALS
    with pytest.raises(Exception, match="Could not parse"):
        df.where("raw like '%N'").select(normalize_allele(F.col("raw"), strict=True)).collect()
    parts = spark.createDataFrame([("BoLA-NC1*01:01",), ("DLA-88*501:01",)], "a string").select(allele_parts(F.col("a")))
    assert [tuple(r[0][0]) for r in parts.collect()] == [("BoLA", "NC1", "01", "01"), ("DLA", "88", "501", "01")]


def test_normal_forms_stay(spark):
    """A normal form's normal form is itself."""
    names = [a for a in (*ANIMALS.values(), *NAMES.values()) if a]
    df = spark.createDataFrame([(n,) for n in names], "raw string")
    kept = df.select("raw", normalize_allele(F.col("raw"), infer_pair=False).alias("a")).collect()
    assert [r.raw for r in kept] == [r.a for r in kept]
