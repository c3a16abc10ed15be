import pytest

from epitrail.operators import windows

PROTEIN = "ABCDEFGHIJKL"


def test_all_windows_and_flanks(spark, monkeypatch):
    for block in (1, 3, 512):
        monkeypatch.setattr(windows, "BLOCK", block)
        df = windows.kmers(windows.sequences(spark, {"p": PROTEIN, "short": "AB", "four": "WXYZ"}), [4, 5], flank_length=2)
        got = {(r.name, r.offset, r.peptide, r.n_flank, r.c_flank) for r in df.collect()}
        want = {(n, i, s[i : i + k], s[max(0, i - 2) : i], s[i + k : i + k + 2]) for n, s in (("p", PROTEIN), ("short", "AB"), ("four", "WXYZ")) for k in (4, 5) for i in range(len(s) - k + 1)}
        assert got == want and df.count() == 9 + 8 + 1


def test_counts(spark):
    seqs = windows.sequences(spark, PROTEIN)
    assert seqs.first().name == "seq"
    assert windows.kmers(seqs, [3, 4, 5]).count() == 27
    empty = windows.kmers(windows.sequences(spark, "AB"), [4])
    assert empty.count() == 0 and empty.columns == ["name", "peptide", "offset"]
    assert windows.kmers(seqs.selectExpr("name", "cast(null as string) as seq"), [4]).count() == 0


def test_sequences_from_lists(spark):
    assert sorted(map(tuple, windows.sequences(spark, ["AAA", "CCC", "AAA"]).collect())) == [("AAA", "AAA"), ("CCC", "CCC")]
    assert [tuple(r) for r in windows.peptides(spark, "SIINFEKL").collect()] == [("SIINFEKL", 0)]


def test_lengths():
    assert windows.peptide_lengths(None, (9,)) == [9] and windows.peptide_lengths(8, (9,)) == [8]
    for bad in ([], [0], [7]):
        with pytest.raises(ValueError):
            windows.peptide_lengths(bad, (9,), least=8 if bad == [7] else None)
    with pytest.raises(ValueError):
        windows.peptide_lengths(16, (9,), most=15)


@pytest.mark.parametrize("direct", [{"max": 256, "sum": 32}, {"max": 0, "sum": 0}])
@pytest.mark.parametrize("lengths", [[1, 2, 9], [9], [5, 20, 64], [15, 16, 17, 18, 19, 20]])
def test_inside_of_windows(spark, monkeypatch, direct, lengths):
    """Maxima and means, read cell by cell or from tables, against slices of the whole profile."""
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(windows, "DIRECT", direct)
    monkeypatch.setattr(windows, "BLOCK", 16)
    rng = random.Random(1)
    rows = [(str(n), "A" * n, [rng.random() for _ in range(n)]) for n in (0, 1, 8, 9, 63, 64, 65, 200)]
    df = spark.createDataFrame(rows, "name string, seq string, probs array<double>")
    at = windows.kmers(df, lengths, along="probs", tables=("max", "sum"))
    inner = windows.Internal("probs", lengths, F.col("_k"), F.col("_place"))
    got = {(r.name, r.offset, r.k): (r.most, r.mean) for r in at.select("name", "offset", F.col("_k").alias("k"), inner.max().alias("most"), inner.mean().alias("mean")).collect()}
    want = {(name, o, k): p[o : o + k - 1] for name, seq, p in rows for k in lengths for o in range(len(seq) - k + 1)}
    assert got.keys() == want.keys()
    for key, inside in want.items():
        assert got[key][0] == (max(inside) if inside else 0.0)
        assert got[key][1] == pytest.approx(sum(inside) / len(inside) if inside else 0.0, abs=1e-15)


def test_letters_of_any_width(spark):
    seqs = {"plain": "ACDEFGHIKL" * 30, "wide": "AÇDÉ漢🙂" * 40, "none": ""}
    df = windows.kmers(windows.sequences(spark, seqs), [9], flank_length=3)
    want = {(n, i, s[max(0, i - 3) : i], s[i : i + 9], s[i + 9 : i + 12]) for n, s in seqs.items() for i in range(len(s) - 8)}
    assert {(r.name, r.offset, r.n_flank, r.peptide, r.c_flank) for r in df.collect()} == want


def test_time_grows_with_length_and_not_with_its_square(spark):
    """Twice the letters take about twice the time, in one sequence; the square would take four times."""
    import time

    from pyspark.sql import functions as F

    def seconds(n):
        df = spark.range(1).select(F.lit("p").alias("name"), F.repeat(F.lit("ACDEFGHIKL"), n // 10).alias("seq"))
        start = time.perf_counter()
        assert windows.kmers(df, [9], flank_length=2).agg(F.count("*"), F.sum(F.ascii("peptide")), F.max("c_flank")).first()[0] == n - 8
        return time.perf_counter() - start

    seconds(100_000)
    small, large = min(seconds(1_000_000) for _ in range(2)), min(seconds(4_000_000) for _ in range(2))
    assert large < 8 * small
