"""The registered queries over the driver's tables and their SQL.

Stand-ins for proprietary predictors are deterministic: proteins are the letters of whole texts (``benchmark`` for row-level
queries, ``documents`` for the large aggregates), a profile is a function of residue and position, an affinity
one of the peptide and the allele's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epitrail.functions import scoring
from epitrail.functions.alleles import distinct_alleles, normalize_allele, render_allele
from epitrail.functions.text import int_list, joined, parse_version
from epitrail.operators import checks, combine, results, windows
from epitrail.predictors.base import ExpressionPredictor, MultiSample, RandomPredictor
from epitrail.predictors.processing import ProcessingPredictor, ProteasomePredictor
from epitrail.schema import Kind, canonical, describe, from_json, from_legacy, legacy, to_json
from epitrail.predictors.tools import ToolPredictor
from epitrail.sources.files import read_fasta, read_mixmhcpred, scratch_path
from epitrail.sources.layouts import LAYOUTS
from epitrail.sources.stdout import data_lines, parse_by_header, parse_iedb, parse_layout, parse_netchop, prefer_kind, tokens

ALLELES = ("HLA-A*02:01", "HLA-B*07:02", "HLA-C*07:01")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def proteins(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), _letters(F.col("text")).alias("seq"))


def document_proteins(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), _letters(F.col("text")).alias("seq"))


def profile(seq: Column) -> Column:
    residues = F.slice(F.split(seq, ""), F.lit(1), F.length(seq))  # without the empty string that an empty sequence gives
    return F.transform(residues, lambda c, i: ((F.ascii(c) * 37 + 11 * (i + 1)) % 100) / F.lit(100.0))


def ordinal(allele: Column) -> Column:
    out = F.when(allele == ALLELES[0], 0)
    for i, a in enumerate(ALLELES[1:], 1):
        out = out.when(allele == a, i)
    return out


def weight(peptide: Column) -> Column:
    return sum((F.ascii(F.substring(peptide, i, 1)) * i for i in range(1, 16)), F.lit(0))  # of up to 15 residues


def affinity(weight: Column, allele: Column) -> Column:
    """An integer from 1 to 49,999 nM."""
    return (1 + (weight * (ordinal(allele) + 7)) % 49_999).cast("double")


def _predictor(spark, alleles=ALLELES, **options) -> ExpressionPredictor:
    value = F.col("value")
    columns = [{"value": affinity(F.col("_weight"), F.col("allele"))}, {"score": F.round(scoring.log50k(value), 6), "percentile_rank": F.round(value / 500, 4)}]
    return ExpressionPredictor(spark, alleles, columns, name="standin", shared={"_weight": weight(F.col("peptide"))}, **options)


def _processing(spark, cls=ProcessingPredictor, **options):
    return cls(spark, profile(F.col("seq")), **options)


# ------------------------------------------------------------------------------------------------- SQL of the stand-ins

PROT = "prot AS (SELECT CAST(item_id AS VARCHAR) AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark)"
DOCS = "prot AS (SELECT CAST(doc_id AS VARCHAR) AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"
PROFILE = "list_transform(range(1, len(seq) + 1), lambda i: ((ascii(substr(seq, i, 1)) * 37 + 11 * i) % 100) / 100.0::DOUBLE)"
PROF = f"prof AS (SELECT name, seq, {PROFILE} AS p FROM prot)"
ALL = "alle(allele, ord) AS (VALUES ('HLA-A*02:01', 0), ('HLA-B*07:02', 1), ('HLA-C*07:01', 2))"


def _win(*lengths: int, source: str = "prot", more: str = "") -> str:
    ks = ", ".join(f"({k})" for k in lengths)
    return (
        f"win AS (SELECT name, k, o::INTEGER AS \"offset\", substr(seq, o + 1, k) AS peptide{more}, seq FROM "
        f"(SELECT *, unnest(range(0, len(seq) - k + 1)) AS o FROM {source}, (VALUES {ks}) v(k) WHERE len(seq) >= k))"
    )


VALUE = "(1 + (list_sum(list_transform(range(1, len(peptide) + 1), lambda i: ascii(substr(peptide, i, 1)) * i))::BIGINT * (ord + 7)) % 49999)::DOUBLE"
SCORED = f"""pairs AS (SELECT peptide, allele, {VALUE} AS value FROM (SELECT DISTINCT peptide FROM win), alle),
scored AS (SELECT peptide, allele, value, round(1 - ln(value) / ln(50000), 6) AS score, round(value / 500, 4) AS percentile_rank FROM pairs)"""
CANON = """'' AS sample_name, peptide, '' AS n_flank, '' AS c_flank, {source} AS source_sequence_name, {offset} AS "offset",
'{predictor}' AS predictor_name, '' AS predictor_version, {allele} AS allele, '{kind}' AS kind, {score} AS score, {value} AS value, {rank} AS percentile_rank"""
MODE_SQL = {
    "cterm": "c",
    "nterm_cterm": "CASE WHEN n IS NULL THEN c ELSE pow(c * n, 1.0 / 2) END",
    "cterm_max_internal": "c * (1 - mx)",
    "cterm_mean_internal": "c * (1 - mean)",
    "nterm_cterm_max_internal": "CASE WHEN n IS NULL THEN pow(c * (1 - mx), 1.0 / 2) ELSE pow(c * (1 - mx) * n, 1.0 / 3) END",
    "nterm_cterm_mean_internal": "CASE WHEN n IS NULL THEN pow(c * (1 - mean), 1.0 / 2) ELSE pow(c * (1 - mean) * n, 1.0 / 3) END",
}
CUT = """cut AS (SELECT name, "offset", peptide, p[o + k] AS c, CASE WHEN o > 0 THEN p[o] END AS n,
coalesce(list_max(p[o + 1 : o + k - 1]), 0.0) AS mx, coalesce(list_sum(p[o + 1 : o + k - 1]) / (k - 1), 0.0) AS mean FROM
(SELECT name, k, o, o::INTEGER AS "offset", substr(seq, o + 1, k) AS peptide, p FROM
(SELECT *, unnest(range(0, len(seq) - k + 1)) AS o FROM prof, (VALUES (9)) v(k) WHERE len(seq) >= k)))"""

#: The same of long texts, by analytic functions along positions; nine letters a window.
LONG_CUT = """pos AS (SELECT name, i, ((ascii(substr(seq, i, 1)) * 37 + 11 * i) % 100) / 100.0::DOUBLE AS p FROM (SELECT *, unnest(range(1, len(seq) + 1)) AS i FROM prot)),
cut AS (SELECT name, c, n, mx, mean FROM (SELECT name, i, p AS c, lag(p, 9) OVER w AS n, max(p) OVER inside AS mx, sum(p) OVER inside / 8 AS mean FROM pos
WINDOW w AS (PARTITION BY name ORDER BY i), inside AS (PARTITION BY name ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) WHERE i >= 9)"""

# -------------------------------------------------------------------------------------------------------------- queries

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


@query(f'WITH {PROT}, {_win(8, 9, 10, 11)} SELECT name, peptide, "offset" FROM win')
def kmer_scan(spark, sf):
    return windows.kmers(proteins(spark, sf), [8, 9, 10, 11])


@query(f"""WITH {PROT}, {_win(9)} SELECT name, peptide, "offset", substr(seq, greatest("offset" - 3, 0) + 1, least("offset", 3)) AS n_flank,
substr(seq, "offset" + 10, 3) AS c_flank FROM win""")
def kmer_flanks(spark, sf):
    return windows.kmers(proteins(spark, sf), [9], flank_length=3)


@query(f"""WITH {DOCS} SELECT k, sum(len(seq) - k + 1)::BIGINT AS n_windows, count(*) AS n_sequences FROM prot, (VALUES (9), (10)) v(k) WHERE len(seq) >= k GROUP BY k""")
def kmer_counts(spark, sf):
    """Windows of all documents by length; counting needs no window to be cut."""
    return windows.window_counts(document_proteins(spark, sf), [9, 10]).groupBy("k").agg(F.sum("n").alias("n_windows"), F.count("*").alias("n_sequences"))


#: 32 bits of a text's md5 as a number, so that sums of them tell whether two sides have the same rows.
SUM32 = "sum(('0x' || substr(md5({}), 1, 8))::BIGINT)::BIGINT"


def _bits32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _sum32(text: Column) -> Column:
    return F.sum(_bits32(text))


@query(f"""WITH {DOCS}, {_win(8, 11)} SELECT name, k, count(*) AS n, min(peptide) AS first, max(peptide) AS last, {SUM32.format("\"offset\" || ':' || peptide")} AS digest FROM win GROUP BY name, k""")
def document_kmers(spark, sf):
    """Every window of all documents, cut, by document and length: a digest of places and letters tells them all."""
    held = windows.kmer_blocks(document_proteins(spark, sf), [8, 11])
    place = lambda p, i: F.concat((F.col("start") + i).cast("string"), F.lit(":"), p)
    digest = F.aggregate(F.transform("peptides", lambda p, i: _bits32(place(p, i))), F.lit(0).cast("long"), lambda a, x: a + x)
    # numbers in place of letters, in the same order: sums over numbers are kept in memory, while least and greatest strings would have all rows sorted, on disk
    number = lambda peptide: F.conv(peptide, 36, 10).cast("long")
    letters = lambda number: F.conv(number.cast("string"), 10, 36)
    blocks = held.select("name", "k", F.size("peptides").alias("n"), number(F.array_min("peptides")).alias("first"), number(F.array_max("peptides")).alias("last"), digest.alias("digest"))
    found = blocks.groupBy("name", "k").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("digest").alias("digest"))
    return found.select("name", "k", "n", letters(F.col("first")).alias("first"), letters(F.col("last")).alias("last"), "digest")


@query(f"""WITH {DOCS}, {_win(9)} SELECT name, count(*) AS n, {SUM32.format("substr(seq, greatest(\"offset\" - 3, 0) + 1, least(\"offset\", 3)) || '<' || peptide || '>' || substr(seq, \"offset\" + 10, 3)")} AS digest FROM win GROUP BY name""")
def document_flanks(spark, sf):
    """Every window of all documents with its flanks, by document."""
    w = windows.kmers(document_proteins(spark, sf), [9], flank_length=3)
    return w.groupBy("name").agg(F.count("*").alias("n"), _sum32(F.concat("n_flank", F.lit("<"), "peptide", F.lit(">"), "c_flank")).alias("digest"))


@query(f"WITH {PROT}, {_win(9, 10)} SELECT DISTINCT peptide FROM win")
def distinct_peptides(spark, sf):
    return windows.distinct_peptides(windows.kmers(proteins(spark, sf), [9, 10]))


@query(f"WITH {DOCS}, {_win(9)} SELECT substr(peptide, 1, 1) AS residue, count(DISTINCT peptide) AS n_distinct, count(*) AS n_windows FROM win GROUP BY 1")
def peptide_residues(spark, sf):
    """Windows and distinct peptides of all documents by first residue."""
    w = windows.kmers(document_proteins(spark, sf), [9]).groupBy("peptide").agg(F.count("*").alias("n"))
    return w.groupBy(F.substring("peptide", 1, 1).alias("residue")).agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_windows"))


@query(f"""WITH {PROT}, {PROF} SELECT name, (i - 1)::INTEGER AS position, substr(seq, i, 1) AS residue, p[i] AS prob FROM
(SELECT *, unnest(range(1, len(seq) + 1)) AS i FROM prof)""")
def cleavage_profile_long(spark, sf):
    return _processing(spark).predict_cleavage_sites(proteins(spark, sf), long=True)


def _mode(mode: str):
    def run(spark, sf):
        rows = _processing(spark, scoring_mode=mode).predict_proteins(proteins(spark, sf), [9])
        return rows.select("source_sequence_name", "offset", "peptide", F.round("score", 7).alias("score"))

    return run


for _m, _sql in MODE_SQL.items():
    query(f'WITH {PROT}, {PROF}, {CUT} SELECT name AS source_sequence_name, "offset", peptide, round({_sql}, 7) AS score FROM cut', f"score_{_m}")(_mode(_m))


def _document_mode(mode):
    def run(spark, sf):
        rows = _processing(spark, scoring_mode=mode).predict_proteins(document_proteins(spark, sf), [9]).withColumn("score", F.round("score", 7))
        total = F.sum(F.col("score").cast("decimal(20,7)")).cast("double")
        return rows.groupBy(F.col("source_sequence_name").alias("name")).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("best"), total.alias("total"))

    return run


def _own_columns(c: Column, n: Column, inner) -> Column:
    return c * (1 - scoring.max_internal(inner)) + c * (1 - scoring.mean_internal(inner)) / 3


def _own_batches(c, n, inner):
    import numpy as np

    cells, most = np.where(np.isnan(inner), 0.0, inner), inner.shape[1]
    mean = cells.sum(axis=1) / np.maximum(most - np.isnan(inner).sum(axis=1), 1)
    return c * (1 - cells.max(axis=1, initial=0.0)) + c * (1 - mean) / 3


OWN_SQL = f"{MODE_SQL['cterm_max_internal']} + ({MODE_SQL['cterm_mean_internal']}) / 3"

_DOCUMENT_MODES = {m: (m, sql) for m, sql in MODE_SQL.items()}
_DOCUMENT_MODES |= {"own_columns": (scoring.by_columns(_own_columns), OWN_SQL), "own_batches": (scoring.by_batches(_own_batches), OWN_SQL)}

for _m, (_mode_of, _sql) in _DOCUMENT_MODES.items():
    query(
        f"""WITH {DOCS}, {LONG_CUT} SELECT name, count(*) AS n, min(score) AS least, max(score) AS best, sum(score::DECIMAL(20, 7))::DOUBLE AS total
FROM (SELECT name, round({_sql}, 7) AS score FROM cut) GROUP BY name""",
        f"document_{_m}",
    )(_document_mode(_mode_of))


@query(f"""WITH {PROT}, {PROF}, {CUT} SELECT {CANON.format(source="name", offset='"offset"', predictor="proteasome", allele="''", kind="proteasome_cleavage", score="round(c * (1 - mx), 6)", value="NULL::DOUBLE", rank="NULL::DOUBLE")} FROM cut""")
def proteasome_predictions(spark, sf):
    rows = _processing(spark, ProteasomePredictor).predict_proteins(proteins(spark, sf), [9])
    return rows.withColumn("score", F.round("score", 6))


@query(f"""WITH {DOCS}, {PROF}, {CUT} SELECT name, count(*) AS n_windows, round(max(round({MODE_SQL["nterm_cterm_max_internal"]}, 6)), 6) AS best_score FROM cut GROUP BY name""")
def cleavage_summary(spark, sf):
    """Windows and best score of every document."""
    rows = _processing(spark).predict_proteins(document_proteins(spark, sf), [9])
    best = F.round(F.max("score"), 6)  # the best of the rounded scores, as rounding keeps their order
    return rows.groupBy(F.col("source_sequence_name").alias("name")).agg(F.count("*").alias("n_windows"), best.alias("best_score"))


@query(f"""WITH {PROT}, {PROF}, {CUT}, s AS (SELECT *, round({MODE_SQL["nterm_cterm_max_internal"]}, 6) AS score FROM cut)
SELECT name AS source_sequence_name, "offset", peptide, score FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, "offset") = 1""")
def top_cleavage_per_source(spark, sf):
    rows = _processing(spark).predict_proteins(proteins(spark, sf), [9]).withColumn("score", F.round("score", 6))
    kept = results.thresholds(rows, min_score=0.4).withColumn("ord", F.col("offset"))
    return results.best_by_score(kept, key=("source_sequence_name",)).select("source_sequence_name", "offset", "peptide", "score")


@query(f"""WITH {PROT}, {_win(9)}, q AS (SELECT substr(seq, "offset" - 1, 2) AS n_flank, peptide, substr(seq, "offset" + 10, 2) AS c_flank, substr(seq, "offset" - 1, 13) AS seq
FROM win WHERE "offset" >= 2 AND "offset" + 11 <= len(seq)), z AS (SELECT n_flank, peptide, c_flank, {PROFILE} AS p FROM q)
SELECT n_flank, peptide, c_flank, round(p[11], 6) AS score FROM z""")
def peptides_with_flanks(spark, sf):
    """Every window that has both flanks whole, scored as a peptide with flanks."""
    df = windows.kmers(proteins(spark, sf), [9], flank_length=2).where("length(n_flank) = 2 AND length(c_flank) = 2")
    return _processing(spark, scoring_mode="cterm").predict(df.select("peptide", "n_flank", "c_flank")).select("n_flank", "peptide", "c_flank", F.round("score", 6).alias("score"))


@query(f"WITH {PROT}, {ALL}, {_win(9)}, {SCORED} SELECT peptide, allele, value, score FROM scored")
def affinity_matrix(spark, sf):
    peps = windows.kmers(proteins(spark, sf), [9])
    return _predictor(spark).predict(peps).select("peptide", "allele", "value", "score")


@query(f"WITH {PROT}, {ALL}, {_win(9)}, {SCORED} SELECT peptide, allele, round(pow(50000.0, 1 - (1 - ln(value) / ln(50000))), 3) AS back, round(least(1.0, greatest(0.0, 1 - ln(greatest(value, 1e-6)) / ln(50000))), 6) AS clamped FROM scored")
def affinity_roundtrip(spark, sf):
    rows = _predictor(spark).predict(windows.kmers(proteins(spark, sf), [9]))
    back = F.round(scoring.affinity_from_score(scoring.log50k(F.col("value"))), 3)
    return rows.select("peptide", "allele", back.alias("back"), F.round(scoring.clamped_score(F.col("value")), 6).alias("clamped"))


RELOCATED = f"WITH {PROT}, {ALL}, {_win(9)}, {SCORED}, placed AS (SELECT w.name, w.\"offset\", s.* FROM win w JOIN scored s USING (peptide))"


@query(f"""{RELOCATED} SELECT {CANON.format(source="name", offset='"offset"', predictor="standin", allele="allele", kind="pMHC_affinity", score="score", value="value", rank="percentile_rank")} FROM placed""")
def protein_predictions(spark, sf):
    return _predictor(spark).predict_proteins(proteins(spark, sf), [9])


@query(f"WITH {DOCS}, {ALL}, {_win(9)}, {SCORED} SELECT w.name AS source_sequence_name, allele, count(*) AS n, min(value) AS strongest FROM win w JOIN scored s USING (peptide) GROUP BY ALL")
def document_binders(spark, sf):
    """Strongest binding of every document and allele: windows are scored where they stand."""
    rows = _predictor(spark).predict_proteins(document_proteins(spark, sf), [9])
    return rows.groupBy("source_sequence_name", "allele").agg(F.count("*").alias("n"), F.min("value").alias("strongest"))


@query(f'{RELOCATED} SELECT name AS source_sequence_name, "offset", peptide, allele, score, value AS affinity, percentile_rank, \'standin\' AS prediction_method_name, len(peptide)::INTEGER AS length FROM placed')
def legacy_view(spark, sf):
    return legacy(_predictor(spark).predict_proteins(proteins(spark, sf), [9]))


@query(f"""{RELOCATED} SELECT {CANON.format(source="name", offset='"offset"', predictor="standin", allele="allele", kind="pMHC_stability", score="score", value="value", rank="percentile_rank")} FROM placed""")
def legacy_roundtrip(spark, sf):
    return from_legacy(legacy(_predictor(spark).predict_proteins(proteins(spark, sf), [9])), Kind.STABILITY)


@query(f"""{RELOCATED} SELECT {CANON.format(source="name", offset='"offset"', predictor="standin", allele="allele", kind="pMHC_affinity", score="score", value="value", rank="percentile_rank")} FROM placed""")
def json_roundtrip(spark, sf):
    return from_json(to_json(_predictor(spark).predict_proteins(proteins(spark, sf), [9])))


@query(f"""WITH {PROT}, {ALL}, {_win(9)}, {SCORED}, n AS (SELECT *, floor(score * 1024) / 1024 AS s, value / CASE WHEN value < 5000 THEN 64 ELSE 1 END AS v FROM scored)
SELECT 'Prediction(' || peptide || ' | ' || allele || ' | pMHC_affinity | score=' || printf('%.4g', s) || ' | value=' || printf('%.4g', v) || ' | rank=' || printf('%.2f', percentile_rank::DECIMAL(18, 4)::DECIMAL(18, 2)::DOUBLE)
|| '% | standin)' AS text FROM n""")
def described_rows(spark, sf):
    """Numbers with more digits than are shown, exact in binary so that both sides round the same."""
    rows = _predictor(spark).predict(windows.kmers(proteins(spark, sf), [9]))
    value = F.col("value") / F.when(F.col("value") < 5000, 64).otherwise(1)
    return describe(rows.withColumns({"score": F.floor(F.col("score") * 1024) / 1024, "value": value, "percentile_rank": F.col("percentile_rank").cast("decimal(18,4)").cast("decimal(18,2)").cast("double")}))


@query(f"""WITH {PROT}, {ALL}, {_win(9)}, {SCORED} SELECT peptide, allele, kind, CASE WHEN kind = 'pMHC_affinity' THEN score ELSE round(score + 1, 6) END AS score,
CASE WHEN kind = 'pMHC_affinity' THEN value END AS value FROM scored, (VALUES ('pMHC_affinity'), ('pMHC_presentation')) v(kind)""")
def two_kind_join(spark, sf):
    rows = _predictor(spark).predict(windows.kmers(proteins(spark, sf), [9])).select("peptide", "allele", "score", "value")
    shown = rows.select("peptide", "allele", F.round(F.col("score") + 1, 6).alias("p"))
    both = combine.with_mandatory(rows, shown, ["peptide", "allele"])
    kinds = F.array(F.struct(F.lit(Kind.AFFINITY).alias("kind"), "score", "value"), F.struct(F.lit(Kind.PRESENTATION).alias("kind"), F.col("p").alias("score"), F.lit(None).cast("double").alias("value")))
    return both.select("peptide", "allele", F.inline(kinds))


GAPS = f"""WITH {PROT}, {ALL}, {_win(9)}, {SCORED}, obs AS (SELECT peptide, allele FROM scored WHERE (ascii(peptide) + len(peptide) * ascii(substr(peptide, 5, 1))) % 7 <> 0
UNION ALL SELECT peptide, 'HLA-E*01:01' FROM scored WHERE allele = 'HLA-A*02:01' AND ascii(peptide) % 5 = 0)"""


def _gaps(spark, sf):
    peps = windows.kmers(proteins(spark, sf), [9])
    rows = _predictor(spark).predict(peps).select("peptide", "allele")
    kept = rows.where((F.ascii("peptide") + F.length("peptide") * F.ascii(F.substring("peptide", 5, 1))) % 7 != 0)
    odd = rows.where((F.col("allele") == ALLELES[0]) & (F.ascii("peptide") % 5 == 0)).select("peptide", F.lit("HLA-E*01:01").alias("allele"))
    return kept.unionByName(odd), peps, spark.createDataFrame([(a,) for a in ALLELES], "allele string")


@query(f"{GAPS} SELECT peptide, allele FROM scored s WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.peptide = s.peptide AND o.allele = s.allele)")
def completeness_missing(spark, sf):
    return checks.missing_pairs(*_gaps(spark, sf))


@query(f"{GAPS} SELECT DISTINCT peptide, allele FROM obs o WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE o.peptide = s.peptide AND o.allele = s.allele)")
def completeness_unexpected(spark, sf):
    return checks.unexpected_pairs(*_gaps(spark, sf))


# events as prediction rows: type -> kind, user -> peptide, every seventh without value and rank
EVENTS = """ev AS (SELECT event_id AS ord, 'P' || user_id AS peptide, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'HLA-A*0' || (1 + event_id % 3) || ':01' END AS allele,
value AS score, CASE WHEN event_id % 7 <> 0 THEN value * 10 END AS value, CASE WHEN event_id % 7 <> 0 THEN value / 2 END AS percentile_rank FROM events)"""


def _events(spark, sf) -> DataFrame:
    e, some = _table(spark, sf, "events"), F.col("event_id") % 7 != 0
    allele = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("HLA-A*0"), (1 + F.col("event_id") % 3).cast("string"), F.lit(":01")))
    return canonical(
        e.select(
            F.col("event_id").alias("ord"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("peptide"), F.col("event_type").alias("kind"), allele.alias("allele"),
            F.col("value").alias("score"), F.when(some, F.col("value") * 10).alias("value"), F.when(some, F.col("value") / 2).alias("percentile_rank"),
        ),
        keep=("ord",),
    )


@query(f"""WITH {EVENTS} SELECT peptide, kind, ord, allele, score FROM ev QUALIFY row_number() OVER (PARTITION BY peptide, kind ORDER BY (allele = ''), score DESC, ord) = 1""")
def best_by_score(spark, sf):
    return results.best_by_score(_events(spark, sf), key=("peptide",)).select("peptide", "kind", "ord", "allele", "score")


@query(f"""WITH {EVENTS} SELECT peptide, ord, allele, percentile_rank FROM ev WHERE kind = 'purchase' AND allele <> '' AND percentile_rank IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY percentile_rank, ord) = 1""")
def best_by_rank(spark, sf):
    return results.best_by_rank(_events(spark, sf), "purchase", key=("peptide",)).select("peptide", "ord", "allele", "percentile_rank")


@query(f"""WITH {EVENTS}, b AS (SELECT peptide, kind, allele, score FROM ev QUALIFY row_number() OVER (PARTITION BY peptide, kind ORDER BY (allele = ''), score DESC, ord) = 1)
SELECT peptide, any_value(score) FILTER (kind = 'click') AS click_score, any_value(allele) FILTER (kind = 'click') AS click_allele, any_value(score) FILTER (kind = 'purchase') AS purchase_score FROM b GROUP BY peptide""")
def best_table(spark, sf):
    t = results.best_table(_events(spark, sf), ["click", "purchase"], key=("peptide",))
    return t.select("peptide", F.col("click.score").alias("click_score"), F.col("click.allele").alias("click_allele"), F.col("purchase.score").alias("purchase_score"))


@query(f"""WITH {EVENTS} SELECT peptide, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
coalesce(string_agg(DISTINCT allele, ',' ORDER BY allele) FILTER (allele <> ''), '') AS alleles, count(*) AS n_preds FROM ev GROUP BY peptide""")
def kinds_alleles_per_peptide(spark, sf):
    found = results.nested(_events(spark, sf), key=("peptide",)).select("peptide", "kinds", "alleles", "n_preds")
    return found.withColumns({c: joined(F.col(c)) for c in ("kinds", "alleles")})


@query(f"""WITH {EVENTS} SELECT peptide, string_agg(score, ';' ORDER BY ord) AS scores, count(*) AS n FROM (SELECT peptide, ord, round(score, 2)::DECIMAL(18, 2)::VARCHAR AS score FROM ev) GROUP BY peptide""")
def peptide_result_nested(spark, sf):
    n = results.nested(_events(spark, sf), key=("peptide",))
    text = F.transform("preds", lambda x: F.round(x["score"], 2).cast("decimal(18,2)").cast("string"))
    return n.select("peptide", F.array_join(text, ";").alias("scores"), F.col("n_preds").alias("n"))


@query(f"WITH {EVENTS} SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def kind_counts(spark, sf):
    return results.kind_counts(_events(spark, sf), key=())


@query(f"WITH {EVENTS} SELECT ord, value, percentile_rank, score FROM ev WHERE (value IS NULL OR value <= 500) AND (percentile_rank IS NULL OR percentile_rank <= 40) AND score >= 10")
def null_tolerant_filters(spark, sf):
    return results.thresholds(_events(spark, sf), 500, 40, 10).select("ord", "value", "percentile_rank", "score")


@query(f"WITH {EVENTS} SELECT ord, peptide, score FROM ev WHERE kind = 'click' AND allele = 'HLA-A*02:01'")
def filter_kind_allele(spark, sf):
    return results.only(_events(spark, sf), "click", "HLA-A*02:01").select("ord", "peptide", "score")


@query(f"WITH {EVENTS} SELECT DISTINCT peptide, allele, score, value FROM ev")
def legacy_distinct(spark, sf):
    from epitrail.schema import legacy_distinct as distinct

    return distinct(legacy(_events(spark, sf))).select("peptide", "allele", "score", F.col("affinity").alias("value"))


@query(r"""WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\s]+')) AS peptide FROM benchmark)
SELECT peptide, CASE WHEN NOT regexp_matches(peptide, '^\p{L}+$') THEN 'not letters' WHEN contains(peptide, 'X') THEN 'unknown residue' WHEN peptide <> upper(peptide) THEN 'not upper case'
WHEN len(peptide) < 8 THEN 'too short' WHEN len(peptide) > 15 THEN 'too long' END AS violation FROM (SELECT peptide FROM t UNION SELECT translate(peptide, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM t)""")
def validate_peptides(spark, sf):
    words = _table(spark, sf, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("peptide"))
    both = words.unionByName(words.select(F.translate("peptide", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("peptide"))).distinct()
    return both.select("peptide", checks.violation(F.col("peptide"), least=8, most=15).alias("violation"))


SAMPLES = "samp AS (SELECT n_name AS sample_name, CASE n_nationkey % 4 WHEN 0 THEN 'HLA-A*02:01' WHEN 1 THEN 'HLA-B*07:02' WHEN 2 THEN 'HLA-C*07:01' END AS allele FROM nation WHERE n_nationkey % 4 < 3 UNION SELECT n_name, 'HLA-A*02:01' FROM nation WHERE n_nationkey % 2 = 1)"


@query(f"WITH {PROT}, {ALL}, {_win(9)}, {SCORED}, {SAMPLES} SELECT sample_name, allele, count(*) AS n, min(value) AS strongest, sum(value) AS total FROM win JOIN scored USING (peptide) JOIN samp USING (allele) GROUP BY ALL")
def multi_sample_union(spark, sf):
    rows = _table(spark, sf, "nation").orderBy("n_nationkey").collect()
    own = {r.n_name: ([a] if (a := dict(enumerate(ALLELES)).get(r.n_nationkey % 4)) else []) + ([ALLELES[0]] if r.n_nationkey % 2 else []) for r in rows}
    made = MultiSample(spark, {k: v for k, v in own.items() if v}, _predictor)
    out = made.predict_proteins(proteins(spark, sf), [9])
    return out.groupBy("sample_name", "allele").agg(F.count("*").alias("n"), F.min("value").alias("strongest"), F.sum("value").alias("total"))


@query(f"""WITH {PROT}, {ALL}, {PROF}, {CUT}, {_win(9)}, {SCORED} SELECT predictor_name, kind, count(*) AS n, round(sum(score), 3) AS total FROM (
SELECT 'standin' AS predictor_name, 'pMHC_affinity' AS kind, score FROM win JOIN scored USING (peptide)
UNION ALL SELECT 'proteasome', 'proteasome_cleavage', round(c * (1 - mx), 6) FROM cut) GROUP BY ALL""")
def multi_predictor_union(spark, sf):
    given = proteins(spark, sf)
    both = combine.union([_predictor(spark).predict_proteins(given, [9]), _processing(spark, ProteasomePredictor).predict_proteins(given, [9])])
    return both.groupBy("predictor_name", "kind").agg(F.count("*").alias("n"), F.round(F.sum(F.round("score", 6)), 3).alias("total"))


@query(f"{RELOCATED} SELECT name AS source_sequence_name, \"offset\", allele, value FROM placed ORDER BY value, peptide, allele")
def strongest_first(spark, sf):
    return results.by_affinity(_predictor(spark).predict_proteins(proteins(spark, sf), [9])).select("source_sequence_name", "offset", "allele", "value")


@query("SELECT 'nation ' || n_name AS source_sequence_name, o::INTEGER AS ord FROM (SELECT n_name, unnest(range(0, 3)) AS o FROM nation)")
def key_remap(spark, sf):
    n = _table(spark, sf, "nation")
    rows = n.select(F.col("n_nationkey").cast("string").alias("source_sequence_name"), F.explode(F.array(*map(F.lit, range(3)))).alias("ord"))
    names = n.select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit("nation "), "n_name").alias("name"))
    return combine.remap(rows, names, strict=True)


@query("SELECT text, value::INTEGER AS value FROM (VALUES ('1', [1]), ('1-3', [1, 2, 3]), ('9,10', [9, 10]), ('9, 10', [9, 10]), ('9,10,12-13', [9, 10, 12, 13]), ('8 9 10,11-13', [8, 9, 10, 11, 12, 13])) v(text, vs), unnest(vs) u(value)")
def parse_int_ranges(spark, sf):
    df = spark.createDataFrame([(t,) for t in ("1", "1-3", "9,10", "9, 10", "9,10,12-13", "8 9 10,11-13")], "text string")
    return df.select("text", F.explode(int_list(F.col("text"))).alias("value"))


NAMES = {
    "HLA-DRA1*0101/HLA-DRB1*0401": "HLA-DRA1*01:01-DRB1*04:01",
    "HLA-DRA*01:01/DRB1*03:01": "HLA-DRA1*01:01-DRB1*03:01",
    "HLA-DQA1*01:02;DRB1*15:01": "HLA-DQA1*01:02-DRB1*15:01",
    "HLA-DRB1*07:01": "HLA-DRA1*01:01-DRB1*07:01",
    "HLA-DPA1*01:03/DPB1*04:01": "HLA-DPA1*01:03-DPB1*04:01",
    "HLA-DQA1*05:01/DQB1*02:01": "HLA-DQA1*05:01-DQB1*02:01",
    "HLA-DRB1*0401": "HLA-DRA1*01:01-DRB1*04:01",
    "H-2-IAb": "H-2-IAb",
    "H2-IAd": "H-2-IAd",
    "H-2-IEk": "H-2-IEk",
    "H2-Kb": "H-2-Kb",
    "H-2-Kb": "H-2-Kb",
    "HLA-A*02:01": "HLA-A*02:01",
    "A0201": "HLA-A*02:01",
    "HLA-A02:03": "HLA-A*02:03",
    "HLA-A0202": "HLA-A*02:02",
    "DRB1_0101": "HLA-DRA1*01:01-DRB1*01:01",
    "A2": "HLA-A*02:01",
    "B7": "HLA-B*07:01",
    "HLA-DPA1*01:05-DPB1*100:01": "HLA-DPA1*01:05-DPB1*100:01",
    "HLA-DQA10501-DQB10636": "HLA-DQA1*05:01-DQB1*06:36",
    "HLA-A*02:01N": None,
    "nonsense": None,
}
_NAMES_SQL = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in NAMES.items())


@query(f"SELECT raw, allele FROM (VALUES {_NAMES_SQL}) v(raw, allele)")
def allele_names(spark, sf):
    df = spark.createDataFrame([(n,) for n in NAMES], "raw string")
    return df.select("raw", normalize_allele(F.col("raw")).alias("allele"))


@query(f"SELECT DISTINCT allele FROM (VALUES {_NAMES_SQL}) v(raw, allele) WHERE allele IS NOT NULL")
def distinct_alleles_query(spark, sf):
    df = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "allele string, ord long")
    return distinct_alleles(df).select("allele")


@query("""SELECT allele, replace(allele, '*', '') AS plain, replace(replace(allele, '*', ''), ':', '') AS compact, class2 FROM (VALUES ('HLA-A*02:01', NULL),
('HLA-DRA1*01:01-DRB1*01:01', 'DRB1_0101'), ('HLA-DQA1*05:01-DQB1*06:36', 'HLA-DQA10501-DQB10636'), ('H-2-IAb', 'H-2-IAb'), ('HLA-DPA1*01:05-DPB1*100:01', 'HLA-DPA10105-DPB110001')) v(allele, class2)""")
def allele_render(spark, sf):
    names = ["HLA-A*02:01", "HLA-DRA1*01:01-DRB1*01:01", "HLA-DQA1*05:01-DQB1*06:36", "H-2-IAb", "HLA-DPA1*01:05-DPB1*100:01"]
    a, df = F.col("allele"), spark.createDataFrame([(n,) for n in names], "allele string")
    class2 = F.when(a != "HLA-A*02:01", render_allele(a, "class2"))
    return df.select("allele", render_allele(a).alias("plain"), render_allele(a, "compact").alias("compact"), class2.alias("class2"))


@query("SELECT text, major::INTEGER AS major, minor::INTEGER AS minor FROM (VALUES ('4.2c', 4, 2), ('NetMHCpan version 4.1b', 4, 1), ('2.8', 2, 8)) v(text, major, minor)")
def version_numbers(spark, sf):
    df = spark.createDataFrame([(t,) for t in ("4.2c", "NetMHCpan version 4.1b", "2.8")], "text string")
    v = parse_version(F.col("text"))
    return df.select("text", F.get(v, F.lit(0)).alias("major"), F.get(v, F.lit(1)).alias("minor"))


# tool output made from the windows of each protein: a line a window, in the columns of each tool
DASHES = "-" * 40


def _made_output(spark, sf, line, head: str) -> DataFrame:
    """``name, text``: an output for each protein, with a line for each 9-mer."""
    w = windows.kmers(proteins(spark, sf), [9])
    body = w.select("name", "offset", line.alias("line")).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("offset", "line"))).alias("rows"))
    start, end = f"# a comment\n{DASHES}\n{head}\n{DASHES}\n", f"\n{DASHES}\nProtein done"
    return body.select("name", F.concat(F.lit(start), F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit(end)).alias("text"))


def _value():
    return affinity(weight(F.col("peptide")), F.lit(ALLELES[0])).cast("long")


def _score(base: int = 1000) -> Column:
    """Three decimals as text."""
    return F.concat(F.lit("0."), F.lpad((_value() % base).cast("string"), 3, "0"))


OUTPUT = f"WITH {PROT}, {_win(9)}, l AS (SELECT *, v % 1000 / 1000.0::DOUBLE AS s FROM (SELECT *, {VALUE.replace('ord', '0')}::BIGINT AS v FROM win))"


def _layout_output(spark, sf, name: str, inverted: bool = False) -> DataFrame:
    """Lines of a layout: what it does not read is 0, an affinity is NA now and then, and marks of binders stand where the tool puts them."""
    at = LAYOUTS[name]
    n = max(p for p in (at.key, at.offset, at.peptide, at.allele, at.score, at.ic50, at.rank) if p is not None) + 1
    cells = [F.lit("0")] * n
    cells[at.offset] = (F.col("offset") + int(at.one_based)).cast("string")
    cells[at.peptide], cells[at.key] = F.col("peptide"), F.col("name")
    cells[at.allele] = F.lit("DRB1_0101" if name.startswith("netmhcii") else "HLA-A02:01")
    cells[at.score], cells[at.rank or at.score] = _score(), (_value() % 100).cast("string")
    cells[at.score] = _score()
    if at.ic50 is not None:
        cells[at.ic50] = F.when(_value() % 11 == 0, "NA").otherwise(_value().cast("string"))
    marks = F.when(_value() % 3 == 0, "WB") if "WB" in at.ignored and "<=" not in at.ignored else F.when(_value() % 3 == 0, "<=WB").when(_value() % 3 == 1, "<= SB")
    if at.ignored:
        place = min(at.ignored.values())
        cells = cells[:place] + [F.lit("0")] * (place - len(cells)) + [marks] + cells[place:]
    return _made_output(spark, sf, F.concat_ws("  ", *cells), "  Pos  HLA  Peptide  Core" + ("  Inverted  " if inverted else "  ") + "Identity  Score")


def _layout_query(name: str, inverted: bool = False):
    def run(spark, sf):
        rows = parse_layout(_layout_output(spark, sf, name if inverted or "43" not in name else name.replace("43", "4"), inverted), name, name).drop("ord")
        return rows.withColumn("value", F.round("value", 6))

    return run


def _layout_sql(name: str) -> str:
    at = LAYOUTS[name]
    allele = "HLA-DRA1*01:01-DRB1*01:01" if name.startswith("netmhcii") else "HLA-A*02:01"
    value = "NULL::DOUBLE" if at.ic50 is None else "round(CASE WHEN v % 11 = 0 THEN pow(50000.0, 1 - s) ELSE v END, 6)"
    rank = "NULL::DOUBLE" if at.rank is None else "(v % 100)::DOUBLE"
    canon = CANON.format(source="name", offset='"offset"', predictor=name, allele=f"'{allele}'", kind=at.kind, score="s", value=value, rank=rank)
    return f"{OUTPUT} SELECT {canon} FROM l"


for _n in LAYOUTS:
    query(_layout_sql(_n), f"parse_{_n.replace('-', '_')}")(_layout_query(_n, "43" in _n))
for _n in ("netmhciipan43-el", "netmhciipan43-ba"):
    query(_layout_sql(_n), f"parse_{_n.replace('-', '_')}_old_columns")(_layout_query(_n))
query(_layout_sql("netmhcpan3"), "parse_layout_rows")(_layout_query("netmhcpan3"))

#: Headers of NetMHCpan output by what they tell, and the rows that a line gives: kind, score, value, rank as SQL.
_BA, _EL = ("pMHC_affinity", "round(1 - ln(v) / ln(50000), 6)", "v::DOUBLE"), "pMHC_presentation"
HEADERS = {
    "elution_and_binding": ("Pos MHC Peptide Core Of Gp Gl Ip Il Icore Identity Score_EL %Rank_EL Score_BA %Rank_BA Aff(nM) BindLevel", [(*_BA, "(v % 50)::DOUBLE"), (_EL, "s", "NULL::DOUBLE", "(v % 100)::DOUBLE")]),
    "elution": ("Pos MHC Peptide Core Of Gp Gl Ip Il Icore Identity Score_EL %Rank_EL BindLevel", [(_EL, "s", "NULL::DOUBLE", "(v % 100)::DOUBLE")]),
    "log_score": ("pos HLA peptide Identity 1-log50k(aff) Affinity(nM) %Rank BindLevel", [(*_BA, "(v % 100)::DOUBLE")]),
    "binding": ("Pos HLA Peptide Core Of Gp Gl Ip Il Icore Identity Score Aff(nM) %Rank BindLevel", [(*_BA, "(v % 100)::DOUBLE")]),
    "plain_score": ("Pos HLA Peptide Core Of Gp Gl Ip Il Icore Identity Score %Rank BindLevel", [(_EL, "s", "NULL::DOUBLE", "(v % 100)::DOUBLE")]),
}


def _header_output(spark, sf, form: str) -> DataFrame:
    names = HEADERS[form][0].split()
    based = int("Core" in names)
    score, rank, value = _score(), (_value() % 100).cast("string"), _value().cast("string")
    cells = {
        "pos": (F.col("offset") + based).cast("string"), "hla": F.lit("HLA-A02:01"), "mhc": F.lit("HLA-A*02:01"), "peptide": F.col("peptide"), "core": F.col("peptide"), "icore": F.col("peptide"),
        "identity": F.col("name"), "score_el": score, "score": score, "score_ba": F.lit("0.5"), "1-log50k(aff)": F.lit("0.5"), "%rank_el": rank, "%rank": rank,
        "%rank_ba": (_value() % 50).cast("string"), "aff(nm)": value, "affinity(nm)": value, "bindlevel": F.when(_value() % 3 == 0, "<= WB"),
    }
    return _made_output(spark, sf, F.concat_ws("  ", *(cells.get(n.lower(), F.lit("0")) for n in names)), HEADERS[form][0])


_HEADER_COLUMNS = ("source_sequence_name", "offset", "peptide", "allele", "kind", "value", "percentile_rank")


def _header_sql(form: str, kinds=None) -> str:
    rows = [r for r in HEADERS[form][1] if kinds is None or r[0] in kinds]
    return " UNION ALL ".join(
        f"""SELECT name AS source_sequence_name, "offset", peptide, 'HLA-A*02:01' AS allele, '{kind}' AS kind, {score} AS score, {value} AS value, {rank} AS percentile_rank FROM l""" for kind, score, value, rank in rows
    )


def _header_query(form: str):
    return lambda spark, sf: parse_by_header(_header_output(spark, sf, form)).select(*_HEADER_COLUMNS, F.round("score", 6).alias("score"))


for _f in HEADERS:
    query(f"{OUTPUT} {_header_sql(_f)}", f"header_{_f}")(_header_query(_f))
query(f"{OUTPUT} {_header_sql('binding')}", "parse_header_rows")(_header_query("binding"))


@query(f"{OUTPUT} {_header_sql('elution_and_binding', ('pMHC_affinity',))} UNION ALL {_header_sql('elution_and_binding', ('pMHC_presentation',))}")
def header_preferred_kinds(spark, sf):
    """A line with two scores, read twice: as an affinity, and as a presentation chosen from the rows afterwards."""
    text = _header_output(spark, sf, "elution_and_binding")
    rows = combine.union([parse_by_header(text, prefer=Kind.AFFINITY), prefer_kind(parse_by_header(text), Kind.PRESENTATION)])
    return rows.select(*_HEADER_COLUMNS, F.round("score", 6).alias("score"))


class _Printed(ToolPredictor):
    """A tool whose output is made from the peptides themselves; the program is not here."""

    validates = False

    def run(self, asked):
        cells = ["1", F.lit("HLA-A02:01"), F.col("peptide"), F.col("peptide"), *"00000", F.col("peptide"), "PEPLIST", _score(), (_value() % 100).cast("string"), "0.5", (_value() % 50).cast("string"), _value().cast("string")]
        line = F.concat_ws(" ", *(F.lit(c) if isinstance(c, str) else c for c in cells))
        start = f"{DASHES}\n{HEADERS['elution_and_binding'][0]}\n{DASHES}\n"
        batch = asked.select(line.alias("line"), F.pmod(F.xxhash64("peptide"), F.lit(64)).alias("batch")).groupBy("batch").agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))
        return batch.select(F.concat(F.lit(start), "lines", F.lit(f"\n{DASHES}")).alias("text"))


def _older(mode: str, kind: str, score: str, value: str, rank: str):
    sql = f"""{OUTPUT} SELECT name AS source_sequence_name, "offset", peptide, 'HLA-A*02:01' AS allele, {score} AS score, {value} AS affinity, {rank} AS percentile_rank, '{mode}' AS prediction_method_name, 9 AS length FROM l"""

    def run(spark, sf):
        rows = _Printed(spark, "HLA-A*02:01", mode).predict_proteins_legacy(proteins(spark, sf), [9], validate=False)
        return rows.withColumn("score", F.round("score", 6))

    query(sql, f"legacy_{mode.replace('-', '_')}")(run)


_older("netmhcpan41-ba", *HEADERS["elution_and_binding"][1][0])
_older("netmhcpan41-el", *HEADERS["elution_and_binding"][1][1])


@query(f"""{OUTPUT} SELECT name, count(*) AS n_lines, sum(CASE WHEN v % 3 = 0 THEN 16 ELSE 14 END)::BIGINT AS n_tokens FROM l GROUP BY name""")
def output_lines(spark, sf):
    df = _header_output(spark, sf, "binding").select("name", F.explode(data_lines(F.col("text"))).alias("line"))
    return df.groupBy("name").agg(F.count("*").alias("n_lines"), F.sum(F.size(tokens(F.col("line")))).alias("n_tokens"))


@query(f"""WITH {PROT} SELECT name, i::INTEGER AS position, ((i * 37 + len(seq)) % 1000) / 1000.0::DOUBLE AS prob FROM (SELECT name, seq, unnest(range(0, len(seq))) AS i FROM prot)""")
def netchop_output(spark, sf):
    """A profile of each protein in the program's form, read back."""
    seq = proteins(spark, sf).where("seq != ''")
    prob = lambda i: F.concat(F.lit("0."), F.lpad(((i * 37 + F.length("seq")) % 1000).cast("string"), 3, "0"))
    line = lambda i: F.concat_ws("  ", (i + 1).cast("string"), F.substring("seq", i + 1, F.lit(1)), F.lit("."), prob(i), F.lit("seq"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.length("seq") - 1), line), "\n")
    text = F.concat(F.lit(f"\n pos  AA  C      score      Ident\n{DASHES}\n"), body, F.lit(f"\n{DASHES}\n"))
    return parse_netchop(seq.select("name", text.alias("text"))).select("name", F.posexplode("probs").alias("position", "prob"))


@query(f"""{OUTPUT} SELECT name AS source_sequence_name, "offset", peptide, 'HLA-A*02:01' AS allele, 'pMHC_affinity' AS kind, 'smm' AS predictor_name, round(1 - ln(v) / ln(50000), 6) AS score, v::DOUBLE AS value, (v % 100)::DOUBLE AS percentile_rank FROM l""")
def iedb_output(spark, sf):
    """A response for each protein, read back."""
    cells = (F.lit("HLA-A*02:01"), F.lit("1"), (F.col("offset") + 1).cast("string"), (F.col("offset") + 9).cast("string"), F.lit("9"), F.col("peptide"), _value().cast("string"), (_value() % 100).cast("string"))
    w = windows.kmers(proteins(spark, sf), [9]).select("name", F.concat_ws("\t", *cells).alias("line"))
    head = "allele\tseq_num\tstart\tend\tlength\tpeptide\tic50\tpercentile rank\n"
    body = w.groupBy("name").agg(F.concat(F.lit(head), F.array_join(F.collect_list("line"), "\n")).alias("text"))
    rows = parse_iedb(body, "smm", source="name")
    return rows.select(*_HEADER_COLUMNS, "predictor_name", F.round("score", 6).alias("score"))


@query(f"{OUTPUT} SELECT peptide, 'HLA-A*02:01' AS allele, 'pMHC_presentation' AS kind, 'mixmhcpred' AS predictor_name, any_value(s) AS score, any_value((v % 100)::DOUBLE) AS percentile_rank FROM l GROUP BY peptide")
def mixmhcpred_table(spark, sf):
    """A table of the program's form, written and read back."""
    w = windows.kmers(proteins(spark, sf), [9]).select("peptide").distinct()
    path = scratch_path(spark, "mixmhcpred")
    columns = {"Peptide": F.col("peptide"), "Score_bestAllele": _score(), "BestAllele": F.lit("A0201"), "%Rank_bestAllele": (_value() % 100).cast("string")}
    w.select(*(c.alias(n) for n, c in columns.items())).write.csv(path, sep="\t", header=True)
    return read_mixmhcpred(spark, path).select("peptide", "allele", "kind", "predictor_name", "score", "percentile_rank")


@query(f"""WITH {PROT} SELECT 'p' || name AS name, seq FROM prot""")
def fasta_records(spark, sf):
    """Proteins written as FASTA, in lines of at most 60 letters and small ones among them, and read back."""
    seq = proteins(spark, sf)
    lines = F.array_join(F.regexp_extract_all(F.lower("seq"), F.lit("(.{1,60})"), F.lit(1)), "\n")
    path = scratch_path(spark, "fasta")
    seq.select(F.concat(F.lit(">p"), "name", F.lit(" a description\n"), lines).alias("value")).write.text(path)
    return read_fasta(spark, path)


@query(f"WITH {SAMPLES} SELECT DISTINCT allele FROM samp WHERE allele NOT IN ('HLA-A*02:01', 'HLA-B*07:02')")
def unsupported_alleles(spark, sf):
    """Alleles of the samples that a tool does not list."""
    own = {0: ALLELES[0], 1: ALLELES[1], 2: ALLELES[2]}
    named = F.coalesce(*(F.when(F.col("n_nationkey") % 4 == k, a) for k, a in own.items()))
    alleles = _table(spark, sf, "nation").select(named.alias("allele")).where("allele IS NOT NULL")
    listed = spark.createDataFrame([(ALLELES[0],), (ALLELES[1],)], "allele string")
    return checks.unsupported(alleles, listed).distinct()


@query(f"WITH {PROT}, {_win(8, 9)} SELECT len(peptide)::INTEGER AS length, count(*) AS n FROM win GROUP BY ALL")
def one_length_groups(spark, sf):
    """Windows by length: each group passes the rule of tools that take one length, and both together do not."""
    w = windows.kmers(proteins(spark, sf), [8, 9])
    try:
        checks.require_one_length(w)
    except ValueError:
        groups = [checks.require_one_length(w.where(F.length("peptide") == k)) for k in (8, 9)]
        return groups[0].unionByName(groups[1]).groupBy(F.length("peptide").alias("length")).agg(F.count("*").alias("n"))
    raise AssertionError("two lengths passed as one")


def random_predictions(spark, sf):
    """Reproducible random scores; a hash that SQL elsewhere lacks."""
    return RandomPredictor(spark, ALLELES, seed=7).predict_proteins(proteins(spark, sf), [9])


QUERIES["random_predictions"] = random_predictions
