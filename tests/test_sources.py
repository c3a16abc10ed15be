import stat
import textwrap

import pytest

from epitrail import cli
from epitrail.operators.windows import sequences
from epitrail.predictors import models, processing, registry, tools, web
from epitrail.sources import files, stdout

DASH = "-" * 60
PAN41 = f"""# NetMHCpan version 4.1b
{DASH}
 Pos         MHC        Peptide      Core Of Gp Gl Ip Il        Icore        Identity  Score_EL %Rank_EL Score_BA %Rank_BA  Aff(nM) BindLevel
{DASH}
   1 HLA-A*11:01       TWNPLEKDAVY TWNPEDAVY  0  0  0  4  2  TWNPLEKDAVY            seq1 0.0031000    77.00 0.020500    88.00 40052.50
   2 HLA-A*11:01        WNPLEKDAVYK WNPLEDVYK  0  0  0  5  2  WNPLEKDAVYK            seq1 0.1250000     2.75 0.250250     5.25  3333.25 <= WB
{DASH}
Protein seq1. Allele HLA-A*11:01. Number of high binders 0.
"""
PAN3 = f"""{DASH}
  Pos          HLA         Peptide       Core Of Gp Gl Ip Il        Icore        Identity   Score Aff(nM)   %Rank  BindLevel
{DASH}
    5  HLA-B*44:02        KEWTPLMD  -KEWTPLMD  0  0  0  0  1     KEWTPLMD      prot|777 0.31250    1700.5    3.50
{DASH}
"""
PAN28 = f"""{DASH}
  pos          HLA      peptide        Identity 1-log50k(aff) Affinity(nM)    %Rank  BindLevel
{DASH}
   21  HLA-A*02:06    WLMPTKEDV  id7 0.625   57.25    1.50 <= WB
   22  HLA-A*02:06    LMPTKEDVR  id7 0.625  NA    1.50
{DASH}
"""
MHC3 = f"""NetMHC version 3.4
{DASH}
 pos    peptide      logscore affinity(nM) Bind Level    Protein Name     Allele
{DASH}
   0  KLDTWPMAV         0.512          196         WB              Q1 HLA-A02:01
   0  TPWRNLDEK         0.117        14100                         Q2 HLA-A02:01
   1  PWRNLDEKG         0.093        18300                         Q2 HLA-A0203
{DASH}
"""
II43 = f"""{DASH}
 Pos  MHC  Peptide  Of  Core  Core_Rel  Inverted  Identity  Score_EL  %Rank_EL  Exp_Bind  Score_BA  %Rank_BA  Affinity(nM)  BindLevel
{DASH}
   1  DRB1_0101  GLPKTWMDERVLSYN  4  TWMDERVLS  0.8  0  s  0.750000  0.25  NA  0.625  12.50  57.25  <=SB
   2  DRB1_0101  LPKTWMDERVLSYNH  3  TWMDERVLS  0.8  0  s  0.125000  5.50  0.2  0.250  33.00  3300.00
{DASH}
"""


def df(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_layouts(spark):
    rows = stdout.parse_layout(df(spark, PAN3), "netmhcpan3", "netmhcpan3").collect()
    assert [(r.offset, r.peptide, r.allele, r.value, r.percentile_rank, r.source_sequence_name, r.score) for r in rows] == [(4, "KEWTPLMD", "HLA-B*44:02", 1700.5, 3.5, "prot|777", 0.3125)]
    rows = stdout.parse_layout(df(spark, MHC3), "netmhc3").orderBy("ord").collect()
    assert [(r.offset, r.value, r.source_sequence_name, r.allele) for r in rows] == [(0, 196.0, "Q1", "HLA-A*02:01"), (0, 14100.0, "Q2", "HLA-A*02:01"), (1, 18300.0, "Q2", "HLA-A*02:03")]
    rows = stdout.parse_layout(df(spark, PAN28), "netmhcpan28").orderBy("ord").collect()
    assert rows[0].value == 57.25 and rows[1].value == pytest.approx(50_000 ** (1 - 0.625)) and rows[0].offset == 21
    el = stdout.parse_layout(df(spark, PAN41), "netmhcpan41-el").orderBy("ord").collect()
    assert [(r.offset, r.score, r.percentile_rank, r.value, r.kind) for r in el][1] == (1, 0.125, 2.75, None, "pMHC_presentation")
    assert stdout.parse_layout(df(spark, PAN41), "netmhc41-ba").orderBy("ord").first().offset == 1  # that layout keeps offsets
    assert {r.kind for r in stdout.parse_layout(df(spark, PAN41), "netmhcpan41-el", legacy_kind=True).collect()} == {"pMHC_affinity"}
    with pytest.raises(ValueError):
        stdout.parse_layout(df(spark, PAN3), "none")
    with pytest.raises(Exception, match="(?i)error"):
        stdout.parse_layout(df(spark, "ERROR: no such allele\n" + PAN28), "netmhcpan28").collect()


def test_class_two(spark):
    el = stdout.parse_layout(df(spark, II43), "netmhciipan43-el").orderBy("ord").collect()
    assert [(r.offset, r.score, r.percentile_rank, r.allele) for r in el] == [(0, 0.75, 0.25, "HLA-DRA1*01:01-DRB1*01:01"), (1, 0.125, 5.5, "HLA-DRA1*01:01-DRB1*01:01")]
    ba = stdout.parse_layout(df(spark, II43), "netmhciipan43-ba").orderBy("ord").first()
    assert (ba.score, ba.value, ba.percentile_rank) == (0.625, 57.25, 12.5)


def test_by_header(spark):
    rows = stdout.parse_by_header(df(spark, PAN41)).orderBy("ord").collect()
    assert [r.kind for r in rows] == ["pMHC_affinity", "pMHC_presentation"] * 2 and {r.predictor_version for r in rows} == {"4.1b"}
    assert rows[2].value == 3333.25 and rows[2].offset == 1 and rows[3].score == 0.125
    one = stdout.prefer_kind(stdout.parse_by_header(df(spark, PAN41)), "pMHC_presentation")
    assert {r.kind for r in one.collect()} == {"pMHC_presentation"} and one.count() == 2
    assert stdout.parse_by_header(df(spark, PAN3)).first().offset == 4
    versions = [r[0] for r in df(spark, PAN41, PAN3, PAN28).select(stdout.detect_version(__import__("pyspark").sql.functions.col("text"))).collect()]
    assert versions == ["4.1", "3.0", "2.8"]
    names = spark.createDataFrame([("seq1", "real")], "key string, name string")
    assert {r.source_sequence_name for r in stdout.parse_by_header(df(spark, PAN41), names=names).collect()} == {"real"}
    with pytest.raises(Exception, match="header"):
        stdout.parse_by_header(df(spark, "nothing\n1 2 3")).collect()


NETCHOP = """
 pos  AA  C      score      Ident
-----------------------------------
   1   A  .   0.100000 seq
   2   C  S   0.900000 seq
-----------------------------------
 pos  AA  C      score      Ident
-----------------------------------
   1   D  .   0.300000 two
-----------------------------------
"""


def test_netchop(spark):
    assert [r.probs for r in stdout.parse_netchop(df(spark, NETCHOP)).orderBy("seq_ord").collect()] == [[0.1, 0.9], [0.3]]
    assert stdout.parse_netchop(df(spark, "no header")).count() == 0
    for bad in (NETCHOP.replace("0.900000", "many"), NETCHOP.replace("-" * 35, "", 1), NETCHOP.replace("C  S   0.900000 seq", "")):
        with pytest.raises(Exception):
            stdout.parse_netchop(df(spark, bad)).collect()


IEDB = "allele\tseq_num\tstart\tend\tlength\tpeptide\tic50\tpercentile_rank\nHLA-A*24:02\t1\t2\t10\t9\tWYPKTMDEF\t815.25\t1.4\nHLA-A*24:02\t1\t5\t13\t9\tKTMDEFGHL\t9001.50\t8.6\n"


def test_iedb(spark):
    rows = stdout.parse_iedb(df(spark, IEDB), "x").orderBy("ord").collect()
    assert [(r.peptide, r.offset, r.value, r.percentile_rank) for r in rows] == [("WYPKTMDEF", 1, 815.25, 1.4), ("KTMDEFGHL", 4, 9001.5, 8.6)]
    assert stdout.parse_iedb(df(spark, IEDB.replace("\tpercentile_rank", "").replace("\t1.4", "").replace("\t8.6", "")), "x").first().percentile_rank is None
    for bad in ("", IEDB.split("\n")[0], IEDB.replace("ic50", "other")):
        with pytest.raises(Exception):
            stdout.parse_iedb(df(spark, bad), "x").collect()


def answer(url, fields):
    if "W" in fields["sequence_text"]:
        raise OSError("down")
    k, seq = int(fields.get("length", 15)), fields["sequence_text"]
    lines = [f"{fields['allele']} 1 {i + 1} {i + k} {k} {seq[i : i + k]} {100 + i} {i}" for i in range(len(seq) - k + 1)]
    return "\n".join(["allele seq_num start end length peptide ic50 percentile_rank", *lines])


def test_web(spark):
    p = web.IedbPredictor(spark, "HLA-A*02:01", "smm-iedb", send=answer)
    rows = p.predict_proteins({"a": "SIINFEKLQY", "b": "AAAAAAAAA"}, [9]).collect()
    assert {(r.source_sequence_name, r.offset, r.peptide) for r in rows} == {("a", 0, "SIINFEKLQ"), ("a", 1, "IINFEKLQY"), ("b", 0, "AAAAAAAAA")}
    assert p.predict("SIINFEKL", validate=True).count() == 1
    with pytest.raises(Exception, match="down"):
        p.predict("SIINFEKW").collect()
    assert web.IedbPredictor(spark, "HLA-A*02:01", "smm-iedb", send=answer, strict=False).predict(["SIINFEKW", "SIINFEKL"]).count() == 1
    dr = web.IedbPredictor(spark, "HLA-DRB1*01:01", "netmhciipan-iedb", send=answer)
    assert {r.allele for r in dr.predict_proteins({"a": "A" * 16}, [15]).collect()} == {"HLA-DRA1*01:01-DRB1*01:01"}


@pytest.fixture
def program(tmp_path):
    """A stand-in for netMHCpan 4.1: one line a peptide, scores by length."""
    path = tmp_path / "fake"
    path.write_text(
        textwrap.dedent(
            """\
            #!/usr/bin/env python3
            import sys
            a = sys.argv[1:]
            if "-listMHC" in a:
                print("# names\\nHLA-A02:01\\nHLA-B07:02\\nnonsense"); sys.exit()
            allele, file = a[a.index("-a") + 1], a[a.index("-f") + 1]
            dash = "-" * 30
            print(dash + "\\n Pos MHC Peptide Core Of Gp Gl Ip Il Icore Identity Score_EL %Rank_EL Score_BA %Rank_BA Aff(nM)\\n" + dash)
            for p in open(file).read().split():
                print(1, allele, p, p, 0, 0, 0, 0, 0, p, "PEPLIST", 0.5, 1.0, 0.25, 2.0, 100 * len(p))
            print(dash)
            """
        )
    )
    path.chmod(path.stat().st_mode | stat.S_IEXEC)
    return str(path)


def test_tool(spark, program):
    p = tools.ToolPredictor(spark, ["A0201", "HLA-B*07:02"], "netmhcpan41-ba", program=program, batch=2, check_alleles=True)
    rows = p.predict(["SIINFEKL", "SIINFEKLQ", "SIINFEKLQY", "SIINFEKL"], validate=True)
    assert rows.count() == 3 * 2 * 2
    assert {(r.peptide, r.value) for r in rows.where("kind = 'pMHC_affinity'").collect()} == {("SIINFEKL", 800.0), ("SIINFEKLQ", 900.0), ("SIINFEKLQY", 1000.0)}
    assert p.predict_proteins({"x": "SIINFEKLQY"}, [9]).count() == 2 * 2 * 2
    with pytest.raises(Exception, match="Invalid peptide"):
        p.predict(["siinfekl"]).collect()
    with pytest.raises(ValueError):
        tools.ToolPredictor(spark, "HLA-C*07:01", program=program, check_alleles=True)


def test_older_view_has_a_row_a_pair(spark, program):
    """Output with two scores gives the mode's kind alone, and so do models of two kinds."""
    for tool, want in (("netmhcpan41-ba", (800.0, 2.0)), ("netmhcpan41-el", (None, 1.0)), ("netmhcpan42-ba", (800.0, 2.0))):
        rows = tools.ToolPredictor(spark, "A0201", tool, program=program).predict_legacy(["SIINFEKL"]).collect()
        assert [(r.affinity, r.percentile_rank) for r in rows] == [want]
    bound = lambda: lambda ps, al: {"value": [50.0 * len(p) for p in ps], "percentile_rank": [None] * len(ps)}
    shown = lambda: lambda ps, al: {"p_score": [0.9] * len(ps), "p_rank": [0.1] * len(ps)}
    flurry = models.MHCflurry(spark, "HLA-A*02:01", load_affinity=bound, load_presentation=shown)
    assert [r.affinity for r in flurry.predict_legacy(["SIINFEKL"]).collect()] == [400.0] and flurry.predict(["SIINFEKL"]).count() == 2
    lacking = models.MHCflurry(spark, "HLA-A*02:01", load_affinity=bound, load_presentation=lambda: lambda ps, al: {"p_score": [None] * len(ps), "p_rank": [None] * len(ps)})
    with pytest.raises(Exception, match="No presentation score"):
        lacking.predict(["SIINFEKL"]).collect()
    with pytest.raises(ValueError, match="one length"):
        tools.ToolPredictor(spark, "A0201", "netmhcstabpan", program=program).predict(["SIINFEKL", "SIINFEKLQ"])


def test_commands():
    t = tools.TOOLS["netmhcpan41-ba"]
    assert tools.build_command(t, "p", "A", "in", "tmp") == ["p", "-p", "-a", "A", "-tdir", "tmp", "-BA", "-f", "in"]
    assert tools.build_command(tools.TOOLS["netmhc3"], "p", "A", "in", "t") == ["p", "--mhc", "A", "--nodirect", "in"]
    assert tools.netmhc_version("-listMHC") == "netmhc4" and tools.netmhc_version("--Alleles") == "netmhc3"
    with pytest.raises(SystemError):
        tools.netmhc_version("")
    assert [tools.netmhcpan_version(x) for x in ("2.8", "3.0a", "4.0", "4.1b", "9.9", "")] == ["netmhcpan28", "netmhcpan3", "netmhcpan4", "netmhcpan41", "netmhcpan42", "netmhcpan42"]
    assert [tools.netmhciipan_version(x) for x in ("netMHCIIpan-4.0", "netMHCIIpan-4.3", "netMHCIIpan-3.1")] == ["netmhciipan4", "netmhciipan43", "netmhciipan3"]


def test_retries(monkeypatch):
    import errno
    import subprocess

    calls = []
    real = subprocess.run

    def run(*a, **k):
        calls.append(1)
        if len(calls) < 3:
            raise OSError(errno.EAGAIN, "again")
        return real(*a, **k)

    monkeypatch.setattr(tools.subprocess, "run", run)
    monkeypatch.setattr(tools, "DELAY", 0.0)
    assert tools.run_program(["echo", "hi"]) == "hi\n" and len(calls) == 3
    with pytest.raises(RuntimeError):
        tools.run_program(["false"])


def test_netchop_program(spark, tmp_path):
    path = tmp_path / "chop"
    path.write_text(
        "#!/usr/bin/env python3\nimport sys\ns = open(sys.argv[1]).read().split('\\n')[1]\n"
        "print(' pos AA C score Ident\\n' + '-' * 30)\nfor i, c in enumerate(s): print(i + 1, c, '.', i / 10, 'seq')\nprint('-' * 30)\n"
    )
    path.chmod(0o755)
    rows = processing.NetChop(spark, str(path), scoring_mode="cterm").predict_proteins({"a": "ABCDEF"}, [4]).orderBy("offset").collect()
    assert [r.score for r in rows] == pytest.approx([0.3, 0.4, 0.5]) and rows[0].predictor_name == "netchop"


def test_mixmhcpred(spark, tmp_path):
    path = tmp_path / "mix.txt"
    path.write_text("# a comment\nPeptide\tScore_bestAllele\tBestAllele\t%Rank_bestAllele\nKLDTWPMAV\t0.41\tA0201\t0.7\nTPWRNLDEK\t-0.25\tA0201\t44.0\n")
    rows = files.read_mixmhcpred(spark, str(path)).collect()
    assert [(r.peptide, r.allele, r.score, r.percentile_rank) for r in rows] == [("KLDTWPMAV", "HLA-A*02:01", 0.41, 0.7), ("TPWRNLDEK", "HLA-A*02:01", -0.25, 44.0)]


def test_models(spark):
    bound = lambda: lambda ps, al: {"value": [50.0 * len(p) for p in ps], "percentile_rank": [None] * len(ps)}
    shown = lambda: lambda ps, al: {"p_score": [0.9] * len(ps), "p_rank": [0.1] * len(ps)}
    both = models.MHCflurry(spark, "HLA-A*02:01", load_affinity=bound, load_presentation=shown).predict(["SIINFEKL"])
    assert {(r.kind, r.value, r.percentile_rank) for r in both.collect()} == {("pMHC_affinity", 400.0, None), ("pMHC_presentation", None, 0.1)}
    assert models.MHCflurryAffinity(spark, "HLA-A*02:01", load_affinity=bound).predict(["SIINFEKL"]).count() == 1
    ensemble = lambda: [lambda ps, al: [0.0] * len(ps), lambda ps, al: [100.0] * len(ps)]
    big = models.BigMHC(spark, "HLA-A*02:01", "im", load=ensemble).predict(["siinfekl"]).first()
    assert big.score == pytest.approx(0.75) and big.kind == "immunogenicity" and big.predictor_name == "bigmhc-im"
    with pytest.raises(ValueError):
        models.bigmhc_folder("/no/such/folder")


def test_registry(spark):
    assert len(registry.REGISTRY) == 39
    assert registry.parse_names("  random , BigMHC ") == ["random", "bigmhc"]
    for bad in ("nope", ""):
        with pytest.raises(ValueError):
            registry.parse_names(bad)
    assert registry.make(spark, "smm-iedb", ["HLA-A*02:01"], [9], strict=False, program="x", models="y").strict is False
    with pytest.raises(ValueError):
        registry.make(spark, "netmhcpan41")
    assert registry.make(spark, "netchop", lengths=[8]).default_lengths == (8,)


def test_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" SIINFEKL \n\nGILGFVFTL\n")
    assert sorted(r.peptide for r in files.read_peptides(spark, str(tmp_path / "p.txt")).collect()) == ["GILGFVFTL", "SIINFEKL"]
    (tmp_path / "s.fasta").write_text(">one first\nsiin\nFEKL\n>two\nGIL\n\n>three\n")
    assert {(r.name, r.seq) for r in files.read_fasta(spark, str(tmp_path / "s.fasta")).collect()} == {("one", "SIINFEKL"), ("two", "GIL"), ("three", "")}
    (tmp_path / "a.txt").write_text("# names\nA0201, HLA-B*07:02\nHLA-A*02:01 nonsense\n")
    assert sorted(r.allele for r in files.read_alleles(spark, str(tmp_path / "a.txt")).collect()) == ["HLA-A*02:01", "HLA-B*07:02"]
    (tmp_path / "out.txt").write_text(PAN3)
    assert stdout.parse_layout(files.read_output(spark, str(tmp_path / "out.txt")), "netmhcpan3").count() == 1
    with pytest.raises(ValueError):
        files.require_rows(sequences(spark, {"a": "A"}).where("false"), "rows")


def test_cli(spark, tmp_path):
    base = ["--mhc-predictor", "random", "--mhc-alleles", "HLA-A*02:01,H-2-Kb", "--mhc-peptide-lengths", "9"]
    assert cli.main([*base, "--sequence", "SIINFEKLQ"]).count() == 2
    assert cli.main([*base, "--sequence", "SIINFEKLQY", "--extract-subsequences", "--output-csv", str(tmp_path / "csv")]).count() == 4
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.count() == 4 and "affinity" in back.columns
    (tmp_path / "s.fasta").write_text(">a\nsiinfeklqy\n")
    assert cli.main([*base, "--input-fasta-file", str(tmp_path / "s.fasta"), "--min-score", "2"]).count() == 0
    (tmp_path / "p.txt").write_text("SIINFEKLQ\n")
    assert cli.main([*base, "--input-peptides-file", str(tmp_path / "p.txt"), "--max-affinity", "10000"]).count() == 2
    with pytest.raises(ValueError):
        cli.main([*base])
    with pytest.raises(ValueError):
        cli.main(["--mhc-predictor", "smm-iedb", "--sequence", "SIINFEKL"])


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from epitrail.streaming.scan import stream_new_peptides, stream_predictions

    spark.createDataFrame([("a", "SIINFEKLQY", 1), ("b", "SIINFEKLQY", 2)], "name string, seq string, t long").selectExpr("name", "seq", "timestamp_seconds(t) as ts").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("name string, seq string, ts timestamp").parquet(str(tmp_path / "in"))
    p = processing.ProcessingPredictor(spark, F.transform(F.split("seq", ""), lambda c: F.lit(0.5)), scoring_mode="cterm")
    for name, df, want in (("scores", stream_predictions(p, arriving, [9]), 4), ("peptides", stream_new_peptides(arriving, [9]), 2)):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == want


def test_csv_in_one_file_is_what_one_task_writes(spark, tmp_path):
    from pyspark.sql import functions as F

    from epitrail.sources.files import write_csv

    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("n"), F.when(F.col("id") % 5 == 0, 'a "quoted", text').when(F.col("id") % 7 == 0, "").alias("odd, name"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"))
    for name, df in {"range": rows, "sorted": rows.repartition(5).orderBy(F.desc("n")), "none": rows.where("n < 0")}.items():
        write_csv(df, f"{tmp_path}/{name}")
        df.coalesce(1).write.option("header", True).option("emptyValue", "").csv(f"{tmp_path}/{name}-one")
        (one,) = (tmp_path / f"{name}-one").glob("part-*.csv")
        assert (tmp_path / name / "part-00000.csv").read_bytes() == one.read_bytes()
    write_csv(rows, f"{tmp_path}/range")  # again
    assert sorted(p.name for p in tmp_path.iterdir() if ".parts-" in p.name) == []
    back = spark.read.csv(f"{tmp_path}/range", header=True)
    assert back.count() == 1000
    write_csv(rows, f"{tmp_path}/many", one_file=False)
    assert len(list((tmp_path / "many").glob("part-*.csv"))) == 7 and spark.read.csv(f"{tmp_path}/many", header=True).count() == 1000
