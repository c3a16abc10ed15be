import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epitrail.functions import scoring
from epitrail.predictors.processing import ModelProfile, ProcessingPredictor, ProteasomePredictor

PROTEIN, PROBS = "MKTWLVAGREND", [0.25, 0.6, 0.15, 0.35, 0.5, 0.8, 0.45, 0.05, 0.7, 0.3, 0.65, 0.55]
OTHER, OTHER_PROBS = "GHPSYC", [0.15, 0.75, 0.2, 0.45, 0.6, 0.05]


def stub(spark, scoring_mode=None, cls=ProcessingPredictor, **kw):
    known = {PROTEIN: PROBS, OTHER: OTHER_PROBS, "FW": [0.4, 0.2], "GGTWLVKK": [i / 20 for i in range(1, 9)], "MKTWL": [0.5, 0.1, 0.4, 0.2, 0.35]}
    expr = F.lit(None).cast("array<double>")
    for s, p in known.items():
        expr = F.when(F.col("seq") == s, F.array(*map(F.lit, p))).otherwise(expr)
    return cls(spark, expr, scoring_mode=scoring_mode, **kw)


def at(df, offset):
    return df.where(F.col("offset") == offset).first()


@pytest.mark.parametrize(
    "mode,want",
    [
        ("cterm", 0.8),
        ("nterm_cterm", math.sqrt(0.8 * 0.6)),
        ("cterm_max_internal", 0.8 * 0.5),
        ("cterm_mean_internal", 0.8 * (1 - 1 / 3)),
        ("nterm_cterm_max_internal", (0.8 * 0.5 * 0.6) ** (1 / 3)),
        ("nterm_cterm_mean_internal", (0.8 * (1 - 1 / 3) * 0.6) ** (1 / 3)),
        (lambda c, n, inner: c + n + sum(inner), 0.8 + 0.6 + 1.0),
    ],
)
def test_modes(spark, mode, want):
    row = at(stub(spark, mode).predict_proteins({"p": PROTEIN}, [4]), 2)
    assert row.score == pytest.approx(want) and row.peptide == "TWLV" and row.source_sequence_name == "p" and row.allele == ""


def test_own_modes(spark):
    """The three forms of a user's mode agree, at the start of a sequence, in windows of one residue and of several lengths at once."""
    one = lambda c, n, inner: c + (0 if n is None else n) - max(inner, default=0) * 0.5 + (sum(inner) / len(inner) if inner else 0)
    columns = scoring.by_columns(lambda c, n, inner: c + F.coalesce(n, F.lit(0.0)) - scoring.max_internal(inner) * 0.5 + scoring.mean_internal(inner))

    def batch(c, n, inner):
        cells, sizes = np.where(np.isnan(inner), 0.0, inner), (~np.isnan(inner)).sum(axis=1)
        return c + np.where(np.isnan(n), 0.0, n) - cells.max(axis=1, initial=0.0) * 0.5 + cells.sum(axis=1) / np.maximum(sizes, 1)

    scored = {}
    for name, mode in (("one", one), ("columns", columns), ("batches", scoring.by_batches(batch))):
        p = stub(spark, mode)
        rows = p.predict_proteins({"p": PROTEIN, "q": OTHER}, [1, 2, 5]).collect()
        scored[name] = {(r.source_sequence_name, r.offset, r.peptide): r.score for r in rows}
        flanked = p.predict(["TWL"], ["MK"], [""]).first()
        scored[name][("flanked", 0, "")] = flanked.score
    assert len(scored["one"]) == 12 + 11 + 8 + 6 + 5 + 2 + 1
    assert scored["columns"] == pytest.approx(scored["one"]) and scored["batches"] == pytest.approx(scored["one"])


def test_edges(spark):
    p = stub(spark, "nterm_cterm_max_internal")
    rows = p.predict_proteins({"p": PROTEIN, "q": OTHER, "s": "FW"}, 4, flank_length=2)
    assert rows.count() == 9 + 3
    own = rows.where("source_sequence_name = 'p'")
    assert at(own, 0).score == pytest.approx(math.sqrt(0.35 * (1 - 0.6))) and (at(own, 0).n_flank, at(own, 8).c_flank) == ("", "")
    one = at(stub(spark, "cterm_mean_internal").predict_proteins({"p": PROTEIN}, [1]), 5)
    assert one.score == pytest.approx(0.8)
    assert at(stub(spark, "nterm_cterm").predict_proteins({"p": PROTEIN}, 4), 8).score == pytest.approx(math.sqrt(0.55 * 0.05))
    assert stub(spark).predict_proteins({"s": "FW"}, 4).columns == rows.columns


def test_defaults_and_kinds(spark):
    assert at(stub(spark).predict_proteins({"p": PROTEIN}, 4), 2).kind == "antigen_processing"
    row = at(stub(spark, cls=ProteasomePredictor).predict_proteins({"p": PROTEIN}, 4), 2)
    assert row.kind == "proteasome_cleavage" and row.score == pytest.approx(0.4)
    with pytest.raises(ValueError):
        stub(spark, "no such mode")
    with pytest.raises(TypeError):
        stub(spark, 3)


def test_peptides_with_flanks(spark):
    got = stub(spark, "cterm").predict(["TWLV"], ["GG"], ["KK"]).first()
    assert got.score == pytest.approx(0.3) and (got.n_flank, got.c_flank, got.offset) == ("GG", "KK", 0)
    assert stub(spark, "cterm_max_internal").predict("MKTWL").first().score == pytest.approx(0.35 * 0.5)
    with pytest.raises(ValueError):
        stub(spark).predict(["A"], ["X", "Y"])
    assert stub(spark).predict([]).count() == 0


def test_sites_and_model(spark):
    sites = stub(spark).predict_cleavage_sites({"q": OTHER}, long=True).orderBy("position").collect()
    assert [(r.position, r.residue, r.prob) for r in sites] == [(i, OTHER[i], p) for i, p in enumerate(OTHER_PROBS)]
    model = ModelProfile(spark, lambda: lambda seqs: [[0.5] * len(s) for s in seqs], scoring_mode="cterm")
    assert {r.score for r in model.predict_proteins({"p": PROTEIN}, 4).collect()} == {0.5}


def test_affinity_conversions(spark):
    df = spark.createDataFrame([(50_000.0, 0.3), (500.0, None), (0.0, None), (None, 0.3), (float("nan"), float("nan")), (-1.0, 0.2), (float("inf"), None)], "v double, s double")
    got = [r[0] for r in df.select(scoring.score_from_affinity(F.col("v"), F.col("s"))).collect()]
    assert got == pytest.approx([0.0, 1 - math.log(500) / math.log(50_000), float("inf"), 0.3, 0.0, 0.2, 0.0])
    rescued = [r[0] for r in df.select(scoring.rescued_ic50(F.col("v"), F.col("s"))).collect()]
    assert rescued[0] == 50_000 and rescued[3] == pytest.approx(50_000**0.7) and rescued[5] == pytest.approx(50_000**0.8)
    clamped = [r[0] for r in df.select(scoring.clamped_score(F.col("v"))).collect()]
    assert clamped[2] == 1.0 and clamped[0] == 0.0


def test_long_sequences_in_blocks(spark):
    """Scores of windows do not depend on where blocks begin."""
    import random

    rng = random.Random(4)
    seq = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(700))
    probs = [rng.random() for _ in seq]
    known = F.when(F.col("seq") == seq, F.array(*map(F.lit, probs)))
    for mode in ("nterm_cterm_max_internal", "cterm_mean_internal"):
        got = {r.offset: r.score for r in ProcessingPredictor(spark, known, scoring_mode=mode).predict_proteins({"p": seq}, [9], flank_length=3).collect()}
        for o in range(len(seq) - 8):
            c, inner, n = probs[o + 8], probs[o : o + 8], probs[o - 1] if o else None
            if mode == "cterm_mean_internal":
                want = c * (1 - sum(inner) / 8)
            else:
                want = math.sqrt(c * (1 - max(inner))) if n is None else (c * (1 - max(inner)) * n) ** (1 / 3)
            assert got[o] == pytest.approx(want)
