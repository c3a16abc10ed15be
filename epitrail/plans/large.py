"""Queries over whole ``documents`` and over names, ranges and versions that stand in table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitrail.functions.alleles import distinct_alleles, render_allele, with_normal_names
from epitrail.functions.text import int_list, parse_version
from epitrail.operators import checks, combine, results, windows
from epitrail.operators.quarantine import quarantined
from epitrail.operators.scan import read_lines
from epitrail.plans import catalog
from epitrail.plans.catalog import ALL, ALLELES, CANON, DOCS, HEADERS, OUTPUT, PROT, SCORED, SUM32, _win, query
from epitrail.predictors.base import ExpressionPredictor
from epitrail.schema import from_nested_json, to_nested_json
from epitrail.sources.files import fasta_kmers, scratch_path
from epitrail.sources.stdout import parse_header_lines

_PLACED = SUM32.format("\"offset\" || ':' || substr(seq, greatest(\"offset\" - 3, 0) + 1, least(\"offset\", 3)) || '<' || peptide || '>' || substr(seq, \"offset\" + k + 1, 3)")


@query(f"WITH {DOCS}, {_win(8, 11)} SELECT 'p' || name AS name, k, count(*) AS n, {_PLACED} AS digest FROM win GROUP BY name, k")
def document_fasta(spark, sf):
    """Documents written as FASTA in short lines, and all windows with flanks read back by splits and chunks."""
    seq = catalog.document_proteins(spark, sf)
    lines = F.array_join(F.regexp_extract_all(F.lower("seq"), F.lit("(.{1,60})"), F.lit(1)), "\n")
    path = scratch_path(spark, "fasta")
    seq.select(F.concat(F.lit(">p"), "name", F.lit(" a description\n"), lines).alias("value")).write.text(path)
    w = fasta_kmers(spark, path, [8, 11], flank_length=3).withColumn("k", F.length("peptide"))
    place = F.concat(F.col("offset").cast("string"), F.lit(":"), "n_flank", F.lit("<"), "peptide", F.lit(">"), "c_flank")
    return w.groupBy("name", "k").agg(F.count("*").alias("n"), catalog._sum32(place).alias("digest"))


_FORMS = ("elution_and_binding", "binding", "log_score")


@query(f"{OUTPUT} " + " UNION ALL ".join(catalog._header_sql(f) for f in _FORMS))
def log_lines(spark, sf):
    """A log of many runs under different headers, read by lines: each by the last header above it."""
    path = scratch_path(spark, "log")
    combine.union([catalog._header_output(spark, sf, f) for f in _FORMS]).select("text").write.text(path)
    rows = parse_header_lines(read_lines(spark, path))
    return rows.select(*catalog._HEADER_COLUMNS, F.round("score", 6).alias("score"))


def _odd(peptide: Column, number: Column) -> Column:
    return (F.ascii(peptide) + 3 * number + F.ascii(F.substring(peptide, 5, 1))) % 7 == 0


@query(f"""WITH {DOCS}, {ALL}, {_win(9)}, p AS (SELECT DISTINCT peptide FROM win), m AS (SELECT peptide, allele FROM p, alle WHERE (ascii(peptide) + 3 * ord + ascii(substr(peptide, 5, 1))) % 7 = 0)
SELECT 'missing' AS what, allele, count(*) AS n, {SUM32.format("peptide")} AS digest FROM m GROUP BY allele
UNION ALL SELECT 'unexpected', 'HLA-E*01:01', count(*), {SUM32.format("peptide")} FROM p WHERE ascii(peptide) % 5 = 0 HAVING count(*) > 0""")
def document_completeness(spark, sf):
    """Gaps in, and additions to, the results of all windows of all documents, by allele."""
    asked = windows.distinct_peptides(windows.kmers(catalog.document_proteins(spark, sf), [9]))
    alleles = spark.createDataFrame([(a,) for a in ALLELES], "allele string")
    # results of what was asked for, without some, and with those of an allele that was not asked for
    made = combine.pairs(asked, alleles.union(spark.createDataFrame([("HLA-E*01:01",)], "allele string")))
    kept = F.when(F.col("allele") == "HLA-E*01:01", F.ascii("peptide") % 5 == 0).otherwise(~_odd(F.col("peptide"), catalog.ordinal(F.col("allele"))))
    told = checks.gaps(made.where(kept), asked, alleles)
    return told.groupBy("what", "allele").agg(F.count("*").alias("n"), catalog._sum32(F.col("peptide")).alias("digest"))


@query(f"""WITH {PROT}, {_win(9)}, p AS (SELECT DISTINCT peptide FROM win)
SELECT peptide, CASE WHEN contains(peptide, 'QU') THEN 'ValueError: cannot read QU' END AS reason FROM p""")
def quarantined_peptides(spark, sf):
    """Batches given to a program that stops at some peptides: all others get through, and these land in the table of errors."""
    dealt = windows.distinct_peptides(windows.kmers(catalog.proteins(spark, sf), [9])).withColumn("first", F.substring("peptide", 1, 1))

    def program(peptides: list[str], key: tuple) -> str:
        if any("QU" in p for p in peptides):
            raise ValueError("cannot read QU")
        return "\n".join(peptides)

    # written once: good rows and errors are both read from it
    path = scratch_path(spark, "quarantine")
    quarantined(dealt.repartition("first").sortWithinPartitions("first", "peptide"), program, 500, strict=False).write.parquet(path)
    ran = spark.read.parquet(path)
    good = ran.where("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("peptide"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(ran.where("text IS NULL").select(F.col("item").alias("peptide"), "reason"))


@query(f"""WITH {PROT}, {_win(9)} SELECT peptide, name AS source_sequence_name, "offset", 'HLA-B*07:02' AS allele FROM win
QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY name::BIGINT, "offset") = 1""")
def first_of_equals(spark, sf):
    """Where all scores are equal the best is what was asked for first: sequence, place and allele."""
    seqs = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("string").alias("name"), catalog._letters(F.col("text")).alias("seq"), F.col("item_id").alias("ord"))
    flat = ExpressionPredictor(spark, [ALLELES[1], ALLELES[0], ALLELES[2]], {"score": F.lit(0.5)})
    best = results.best_by_score(flat.predict_proteins(seqs, [9], ordered=True), key=("peptide",))
    return best.select("peptide", "source_sequence_name", "offset", "allele")


@query(f"""WITH {PROT}, {ALL}, {_win(9)}, {SCORED}, placed AS (SELECT w.name, w."offset", s.* FROM win w JOIN scored s USING (peptide))
SELECT {CANON.format(source="name", offset='"offset"', predictor="standin", allele="allele", kind="pMHC_affinity", score="score", value="value", rank="percentile_rank")} FROM placed""")
def nested_json(spark, sf):
    """Results by peptide and place as nested JSON objects, read back."""
    return from_nested_json(to_nested_json(catalog._predictor(spark).predict_proteins(catalog.proteins(spark, sf), [9]))).drop("ord")


def _part(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")


# raw spellings by the number of a part, and their normal forms
_SPELLED = """spelled AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'HLA-A*' || f || ':' || c WHEN 1 THEN 'B' || f || c WHEN 2 THEN 'HLA-DRB1_' || f || c
WHEN 3 THEN 'hla-dqa1*' || f || ':' || c || ';DQB1*' || c || ':' || f WHEN 4 THEN 'BoLA-1:0' || f || c WHEN 5 THEN 'Mamu-A1*0' || f || ':' || c
WHEN 6 THEN ['HLA-Cw7', 'DR4', 'hla-dq8'][1 + (p_partkey // 10) % 3] WHEN 7 THEN 'H2-K' || l WHEN 8 THEN 'HLA-A*' || f || ':' || c || 'N' ELSE 'DLA-88*5' || f || c END AS raw,
CASE p_partkey % 10 WHEN 0 THEN 'HLA-A*' || f || ':' || c WHEN 1 THEN 'HLA-B*' || f || ':' || c WHEN 2 THEN 'HLA-DRA1*01:01-DRB1*' || f || ':' || c
WHEN 3 THEN 'HLA-DQA1*' || f || ':' || c || '-DQB1*' || c || ':' || f WHEN 4 THEN 'BoLA-1*' || f || ':' || c WHEN 5 THEN 'Mamu-A1*' || f || ':' || c
WHEN 6 THEN ['HLA-C*07:01', 'HLA-DRB1*04:01', 'HLA-DQB1*03:02'][1 + (p_partkey // 10) % 3] WHEN 7 THEN 'H-2-K' || lower(l) WHEN 9 THEN 'DLA-88*5' || f || ':' || c END AS allele
FROM (SELECT p_partkey, lpad((10 + p_partkey % 80)::VARCHAR, 2, '0') AS f, lpad((1 + p_partkey * 7 % 60)::VARCHAR, 2, '0') AS c, chr((65 + p_partkey // 10 % 20)::INT) AS l FROM part))"""


def _spelled(spark, sf) -> DataFrame:
    """Names as tools, papers and other species' databases spell them, one a part."""
    n = F.col("p_partkey")
    tenth = F.expr("p_partkey div 10")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    f, c, letter = two(10 + n % 80), two(1 + n * 7 % 60), F.char(65 + tenth % 20)
    forms = [
        F.concat(F.lit("HLA-A*"), f, F.lit(":"), c),
        F.concat(F.lit("B"), f, c),
        F.concat(F.lit("HLA-DRB1_"), f, c),
        F.concat(F.lit("hla-dqa1*"), f, F.lit(":"), c, F.lit(";DQB1*"), c, F.lit(":"), f),
        F.concat(F.lit("BoLA-1:0"), f, c),
        F.concat(F.lit("Mamu-A1*0"), f, F.lit(":"), c),
        F.get(F.array(*map(F.lit, ("HLA-Cw7", "DR4", "hla-dq8"))), (tenth % 3).cast("int")),
        F.concat(F.lit("H2-K"), letter),
        F.concat(F.lit("HLA-A*"), f, F.lit(":"), c, F.lit("N")),
        F.concat(F.lit("DLA-88*5"), f, c),
    ]
    raw = F.coalesce(*(F.when(n % 10 == i, form) for i, form in enumerate(forms)))
    return _part(spark, sf).select("p_partkey", raw.alias("raw"))


@query(f"WITH {_SPELLED} SELECT p_partkey, raw, allele, replace(allele, '*', '') AS plain, replace(replace(allele, '*', ''), ':', '') AS compact FROM spelled")
def spelled_alleles(spark, sf):
    named = with_normal_names(_spelled(spark, sf), "raw")
    return named.select("p_partkey", "raw", "allele", render_allele(F.col("allele")).alias("plain"), render_allele(F.col("allele"), "compact").alias("compact"))


@query(f"WITH {_SPELLED} SELECT allele, min(p_partkey) AS first FROM spelled WHERE allele IS NOT NULL GROUP BY allele")
def spelled_alleles_once(spark, sf):
    names = _spelled(spark, sf).select(F.col("raw").alias("allele"), F.col("p_partkey").alias("ord"))
    return distinct_alleles(names).select("allele", F.col("allele_ord").alias("first"))


@query("SELECT p_partkey, unnest(list_concat(range(p_size, p_size + p_partkey % 4 + 1), [p_partkey % 50]))::INTEGER AS value FROM part")
def part_ranges(spark, sf):
    """Lists such as ``8-11, 15``."""
    text = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + F.col("p_partkey") % 4).cast("string"), F.lit(", "), (F.col("p_partkey") % 50).cast("string"))
    return _part(spark, sf).select("p_partkey", F.explode(int_list(text)).alias("value"))


@query("SELECT p_partkey, p_size::INTEGER AS major, (p_partkey % 13)::INTEGER AS minor FROM part")
def part_versions(spark, sf):
    text = F.concat(F.lit("NetMHCpan version "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), F.lit("b"))
    v = parse_version(text)
    return _part(spark, sf).select("p_partkey", F.get(v, F.lit(0)).alias("major"), F.get(v, F.lit(1)).alias("minor"))


assert set(_FORMS) <= set(HEADERS)
