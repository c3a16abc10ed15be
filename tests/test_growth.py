"""Queries over whole documents: what they must not do as tables grow, beside their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epitrail.functions import scoring
from epitrail.operators import checks, windows
from epitrail.operators.scan import carried
from epitrail.plans import catalog, large  # noqa: F401  large adds its queries to the catalogue
from epitrail.predictors.base import ExpressionPredictor
from epitrail.predictors.processing import ProcessingPredictor

TEXTS = {1: "Some words, and some more words; " * 9, 2: "", 3: None, 4: "zebras ate 12 apples", 5: "abcdefgh", 6: "zzzzzzzz aaaaaaaaaaa", 7: "short"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_hold_the_windows_of_kmers(spark):
    seqs = windows.sequences(spark, {"long": "ACDEFGHIKLMNPQRSTVWY" * 20, "wide": "\U0001f600ß" * 70 + "﻿ABC", "short": "AB", "just": "ABCD"})
    blocks = windows.kmer_blocks(seqs, [4, 7])
    assert blocks.agg(F.max(F.size("peptides"))).first()[0] == windows.BLOCK
    each = blocks.select("name", "k", "start", F.posexplode("peptides").alias("i", "peptide")).select("name", "peptide", (F.col("start") + F.col("i")).alias("offset"))
    want = windows.kmers(seqs, [4, 7]).select("name", "peptide", "offset").collect()
    assert sorted(each.collect()) == sorted(want)


def test_document_kmers_sorts_no_windows(spark, folder):
    df = catalog.QUERIES["document_kmers"](spark, folder)
    assert "Sort" not in plan(df)
    got = {(r["name"], r.k): (r.n, r["first"], r["last"]) for r in df.collect()}
    want = {}
    for i, text in TEXTS.items():
        seq = "".join(c for c in (text or "") if c.isalpha()).upper()
        for k in (8, 11):
            found = [seq[o : o + k] for o in range(len(seq) - k + 1)]
            if found:
                want[str(i), k] = (len(found), min(found), max(found))
    assert got == want


def test_fasta_is_scanned_once_for_places_and_once_for_lines(spark, folder):
    df = catalog.QUERIES["document_fasta"](spark, folder)
    assert plan(df).count("FileScan text") == 2
    assert df.agg(F.sum("n")).first()[0] == sum(max(0, len("".join(c for c in t or "" if c.isalpha())) - k + 1) for t in TEXTS.values() for k in (8, 11))


def test_sums_since_a_mark(spark):
    rows = [("f", b, n, line) for b, lines in enumerate((["a", "bb"], [">x", "ccc", "d"], ["e", "ff"], [">y", ">z", "g"], ["h"])) for n, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "file string, block int, n int, line string").repartition(4)
    head = F.col("line").startswith(">")
    got = carried(lines, {"mark": F.when(head, F.col("line"))}, {"total": F.when(head, 0).otherwise(F.length("line"))}, since={"at": ("mark", "total")}).orderBy("block", "n")
    assert [(r.line, r.mark, r.total, r["at"]) for r in got.collect()] == [
        ("a", None, 0, None), ("bb", None, 1, None), (">x", ">x", 3, 0), ("ccc", ">x", 3, 0), ("d", ">x", 6, 3), ("e", ">x", 7, 4), ("ff", ">x", 8, 5), (">y", ">y", 10, 0), (">z", ">z", 10, 0), ("g", ">z", 10, 0), ("h", ">z", 11, 1),
    ]


def test_own_batches_get_blocks(spark, folder):
    got = plan(catalog.QUERIES["document_own_batches"](spark, folder))
    assert "EvalPython" in got and "explode(sequence(_b" in got and got.index("explode(sequence(_b") < got.index("EvalPython")  # windows are made after Python


def test_batches_of_blocks_see_what_one_window_sees(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELLS", 100)
    rows = [("a", "ACDEFGHIKL" * 30, [((7 * i) % 100) / 100 for i in range(300)]), ("holes", "ACDEFGHIKLMN", [0.5, None] * 6), ("less", "ACDEFGHIKL", [0.25] * 7), ("one", "ACD", [0.1, 0.2, 0.3])]
    given = spark.createDataFrame(rows, "name string, seq string, given array<double>").repartition(2)

    class Given(ProcessingPredictor):
        def profile(self, seqs):
            return seqs.join(given.select("name", F.col("given").alias("probs")), "name")

    def batch(c, n, inner):
        return np.where(np.isnan(c), -1, c) + 10 * np.where(np.isnan(n), -1, n) + 100 * np.where(np.isnan(inner), 0, inner).sum(axis=1)

    found = Given(spark, scoring_mode=scoring.by_batches(batch)).predict_proteins(given.select("name", "seq"), [1, 3, 8], flank_length=2)
    want = {}
    for name, seq, p in rows:
        cell = lambda i, none: none if not 0 <= i < len(p) or p[i] is None else p[i]
        for k in (1, 3, 8):
            for o in range(len(seq) - k + 1):
                want[name, o, k] = cell(o + k - 1, -1) + 10 * cell(o - 1, -1) + 100 * sum(cell(i, 0) for i in range(o, o + k - 1))
    assert {(r.source_sequence_name, r.offset, len(r.peptide)): r.score for r in found.collect()} == pytest.approx(want)


def test_document_binders_moves_no_windows(spark, folder):
    df = catalog.QUERIES["document_binders"](spark, folder)
    assert "Join" not in plan(df)
    assert df.agg(F.sum("n")).first()[0] == 3 * sum(max(0, len("".join(c for c in t or "" if c.isalpha())) - 8) for t in TEXTS.values())


@pytest.mark.parametrize("ordered", [False, True])
def test_scores_in_place_are_those_of_distinct_peptides(spark, ordered):
    seqs = spark.createDataFrame([("a", "ACDEFGHIKLACDEFGHIKL"), ("b", "ACDEFGHIKL"), ("c", None), ("d", "ACD")], "name string, seq string").repartition(3, "name")
    columns = [{"value": F.col("_n") * 2.0 + F.length("allele")}, {"score": F.col("value") / 100, "offset": F.lit(99), "source_sequence_name": F.lit("none")}]
    here, once = (
        ExpressionPredictor(spark, ["HLA-A*02:01", "HLA-DRB1*01:01"], columns, shared={"_n": F.ascii("peptide")}, once=x).predict_proteins(seqs, [8, 9], ordered=ordered) for x in (False, True)
    )
    assert here.schema == once.schema and here.count() == 2 * (13 + 3 + 12 + 2)
    assert sorted(map(str, here.collect())) == sorted(map(str, once.collect()))


def test_document_completeness_gathers_once(spark, folder):
    df = catalog.QUERIES["document_completeness"](spark, folder)
    assert "Sort" not in plan(df) and "ObjectHash" not in plan(df)  # sets of names would have all rows sorted
    assert plan(df).count("FileScan parquet") == 3
    letters = ["".join(c for c in t or "" if c.isalpha()).upper() for t in TEXTS.values()]
    asked = {s[o : o + 9] for s in letters for o in range(len(s) - 8)}
    missing = [sum((ord(p[0]) + 3 * i + ord(p[4])) % 7 == 0 for p in asked) for i in range(3)]
    want = {("missing", a, n) for a, n in zip(catalog.ALLELES, missing) if n} | {("unexpected", "HLA-E*01:01", sum(ord(p[0]) % 5 == 0 for p in asked))}
    assert {(r.what, r.allele, r.n) for r in df.collect()} == want


def test_gaps_are_missing_and_unexpected_pairs(spark):
    have = [("P", "A"), ("P", "A"), ("Q", "other"), ("Q", "other"), ("T", "B"), ("U", None), ("U", "other")]
    res = spark.createDataFrame(have, "peptide string, allele string").repartition(3)
    pep = spark.createDataFrame([("P",), ("Q",), ("Q",)], "peptide string")
    alleles = spark.createDataFrame([("A",), ("B",)], "allele string")
    told = sorted((tuple(r) for r in checks.gaps(res, pep, alleles).collect()), key=str)
    parts = [(what, *r) for what, f in (("missing", checks.missing_pairs), ("unexpected", checks.unexpected_pairs)) for r in f(res, pep, alleles).collect()]
    assert told == sorted(parts, key=str) and len(told) == 3 + 4
