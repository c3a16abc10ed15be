"""Files in many splits: FASTA by lines, and what a scan carries over the borders."""

import random

import pytest
from pyspark.sql import functions as F

from epitrail.operators.scan import carried, read_lines
from epitrail.sources.files import fasta_kmers, read_fasta, read_fasta_chunks


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_carried_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(2)
    files = {f"f{i}": [f"{'#' if rng.random() < 0.02 else ''}{rng.randint(0, 99)}" for _ in range(n)] for i, n in enumerate((0, 1, 900, 1500))}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    lines = read_lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 8
    mark, value = F.when(F.col("line").startswith("#"), F.col("line")), F.regexp_replace("line", "#", "").cast("long")
    got = carried(lines, {"mark": mark}, {"total": value}, {"last": F.col("line")})
    rows = sorted(tuple(r) for r in got.select(F.element_at(F.split("file", "/"), -1), "block", "n", "line", "mark", "total", "last").collect())
    want = []
    for name in sorted(files):
        seen, total, last = None, 0, None
        for x in files[name]:
            seen = x if x.startswith("#") else seen
            want.append((name, x, seen, total, last))
            total, last = total + int(x.lstrip("#")), x
    assert [(r[0], *r[3:]) for r in rows] == want


def records(rng):
    out = {f"r{i}": "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.choice([0, 1, 8, 9, 50, 700, 5000]))) for i in range(40)}
    out["long"] = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60_000))
    return out


def write(path, seqs, rng):
    for i, part in enumerate((list(seqs.items())[::2], list(seqs.items())[1::2])):
        text = "stray line\n" if i else ""
        for name, seq in part:
            width = rng.choice([1, 7, 60, 61, 10_000])
            text += f">{name} about it\n" + "".join(f"{seq[j : j + width].lower()}  \n" for j in range(0, len(seq), width)) + "\n"
        (path / f"{i}.fa").write_text(text)


@pytest.mark.parametrize("chunk", [50, 1000, 1 << 16])
def test_fasta_in_chunks(spark, tmp_path, small_splits, chunk):
    rng = random.Random(4)
    seqs = records(rng)
    write(tmp_path, seqs, rng)
    chunks = read_fasta_chunks(spark, str(tmp_path), 3, 12, chunk).collect()
    assert {(r.name, r.start, r.lead, r.seq) for r in chunks} == {(n, s, min(s, 3), q[max(0, s - 3) : s + chunk + 12]) for n, q in seqs.items() for s in range(0, len(q), chunk)}
    got = fasta_kmers(spark, str(tmp_path), [8, 11], 3, chunk).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.hash("offset", "peptide", "n_flank", "c_flank").cast("long")).alias("h"))
    want = spark.createDataFrame(
        [(n, i, q[i : i + k], q[max(0, i - 3) : i], q[i + k : i + k + 3]) for n, q in seqs.items() for k in (8, 11) for i in range(len(q) - k + 1)], "name string, offset long, peptide string, n_flank string, c_flank string"
    ).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.hash("offset", "peptide", "n_flank", "c_flank").cast("long")).alias("h"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeated_names_are_records_of_their_own(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACDEFGHIKL\n>x\nACDEFGHIKL\n>empty\n")
    got = fasta_kmers(spark, str(tmp_path), [9])
    assert sorted((r.name, r.record, r.offset) for r in got.collect()) == [("x", 1, 0), ("x", 1, 1), ("x", 2, 0), ("x", 2, 1)]
    assert read_fasta(spark, str(tmp_path)).count() == 3


def written(folder, texts):
    for name, text in texts.items():
        (folder / name).write_text(text)


DASHES = "-" * 40
BOTH = "Pos MHC Peptide Core Of Gp Gl Ip Il Icore Identity Score_EL %Rank_EL Score_BA %Rank_BA Aff(nM) BindLevel"
OLD = "pos HLA peptide Identity 1-log50k(aff) Affinity(nM) %Rank BindLevel"


def new_run(peptides, version="4.1b"):
    lines = "".join(f"  {i + 1}  HLA-A*02:01  {p}  {p} 0 0 0 0 0  {p}  seq{i % 3}  0.{i % 900 + 100}  {i % 100}.5  0.4  7.0  {i + 1}.0 {'<= SB' if i % 5 == 0 else ''}\n" for i, p in enumerate(peptides))
    return f"# NetMHCpan version {version}\n\n# Tmpdir here\n{DASHES}\n {BOTH}\n{DASHES}\n{lines}{DASHES}\n\nProtein PEPLIST. Allele HLA-A*02:01\n"


def old_run(peptides):
    lines = "".join(f"\t{i}  HLA-B07:02  {p}  other  0.{i % 900 + 100}  {i + 2}.0  {i % 60}.0\r\n" for i, p in enumerate(peptides))
    return f"# a comment\n{DASHES}\n{OLD}\n{DASHES}\n{lines}{DASHES}\n"


def peptides(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACDEFGHIKL") for _ in range(9)) for _ in range(n)]


def comparable(df):
    return sorted(tuple(r) for r in df.drop("ord", "file").collect())


def test_one_run_a_file_as_whole_texts(spark, tmp_path, small_splits):
    from epitrail.sources.files import read_output
    from epitrail.sources.stdout import parse_by_header, parse_header_lines, parse_layout, parse_layout_lines

    written(tmp_path, {"a": new_run(peptides(200, 1)), "b": old_run(peptides(150, 2)), "c": new_run([])})
    path = str(tmp_path)
    got = parse_header_lines(read_lines(spark, path))
    want = parse_by_header(read_output(spark, path))
    assert got.count() == 550 and comparable(got) == comparable(want)
    for layout in ("netmhcpan41-ba", "netmhcpan41-el"):
        one = str(tmp_path / "a")
        assert comparable(parse_layout_lines(read_lines(spark, one), layout, "x")) == comparable(parse_layout(read_output(spark, one), layout, "x"))


def test_runs_that_follow_each_other(spark, tmp_path, small_splits):
    from epitrail.sources.stdout import parse_by_header, parse_header_lines

    runs = [new_run(peptides(120, 3)), old_run(peptides(90, 4)), new_run(peptides(60, 5), "4.2c")]
    written(tmp_path, {"log": "".join(runs)})
    got = parse_header_lines(read_lines(spark, str(tmp_path)))
    each = parse_by_header(spark.createDataFrame([(r,) for r in (runs[0], runs[2])], "text string"))
    # what names no version goes with the last that was named
    middle = parse_by_header(spark.createDataFrame([(runs[1],)], "text string")).withColumn("predictor_version", F.lit("4.1b"))
    assert comparable(got) == sorted(comparable(each) + comparable(middle))
    order = [(r.ord, r.kind) for r in got.orderBy("ord").collect()]
    assert len(set(o for o, _ in order)) == len(order) == 2 * 180 + 90


def test_class_two_layout_by_header(spark, tmp_path, small_splits):
    from epitrail.sources.stdout import parse_layout, parse_layout_lines

    head = "Pos MHC Peptide Of Core Core_Rel {}Identity Score_EL %Rank_EL Exp_Bind Score_BA Affinity(nM) %Rank_BA BindLevel"
    row = "{} DRB1_0101 {} 3 ABCDEFGHI 0.9 {}seq 0.5 6.8 NA 0.3 100.5 4.2 {}\n"
    run = lambda inverted, n: f"{DASHES}\n{head.format('Inverted ' if inverted else '')}\n{DASHES}\n" + "".join(row.format(i + 1, "ACDEFGHIKLMNPQR", "0 " if inverted else "", ["", "<=WB", "<= SB"][i % 3]) for i in range(n)) + DASHES + "\n"
    texts = [run(True, 40), run(False, 30), run(True, 20)]
    written(tmp_path, {"log": "".join(texts)})
    for layout in ("netmhciipan43-el", "netmhciipan43-ba"):
        want = parse_layout(spark.createDataFrame([(t,) for t in texts], "text string"), layout, "x")
        assert comparable(parse_layout_lines(read_lines(spark, str(tmp_path)), layout, "x")) == comparable(want)


def test_errors_in_lines(spark, tmp_path):
    from epitrail.sources.stdout import parse_header_lines

    written(tmp_path, {"a": new_run(peptides(5, 1)) + "Error: no license\n"})
    with pytest.raises(Exception, match="no license"):
        parse_header_lines(read_lines(spark, str(tmp_path))).collect()
    written(tmp_path, {"a": f"{DASHES}\n 1 HLA-A02:01 ACDEFGHIK\n"})
    with pytest.raises(Exception, match="header line"):
        parse_header_lines(read_lines(spark, str(tmp_path))).collect()
