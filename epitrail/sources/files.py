"""Reading peptides, sequences, alleles and tool output from files, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epitrail.functions.alleles import normalize_allele, split_alleles
from epitrail.operators.scan import carried, read_lines
from epitrail.operators.windows import kmers, peptide_lengths
from epitrail.schema import COLUMNS, canonical


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the one that driver and executors share, ``spark.checkpoint.dir``; where that is unset a local session gets a new one."""
    import uuid

    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="epitrail-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    """``peptide``: one a line without the white space around it; empty lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("peptide")).where("peptide != ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq``: the first word of each header, and the sequence in upper case."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("r")).where("trim(r) != ''")
    header, body = F.substring_index("r", "\n", 1), F.expr("CASE WHEN instr(r, '\n') > 0 THEN substring(r, instr(r, '\n') + 1) ELSE '' END")
    return records.select(F.get(F.split(F.trim(header), r"\s+"), F.lit(0)).alias("name"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


#: Letters of a chunk of a sequence.
CHUNK = 1 << 16


def read_fasta_chunks(spark: SparkSession, path: str, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``name, file, record, start, seq, lead``: sequences of any length in chunks, read by splits of the files.

    A record is never one row: its lines find their places by a scan over splits (:func:`epitrail.operators.scan.carried`) and meet in chunks of ``chunk`` letters from ``start`` on, with up
    to ``before`` letters (``lead`` of them) that stand before the chunk and ``after`` that follow it, so that windows over its end are whole. ``record`` numbers the records
    of a file from 1. Lines before the first header are left out, records without letters have no chunk; names and letters are as in :func:`read_fasta`.
    """
    is_header = F.ltrim("line").startswith(">")
    letters = F.upper(F.regexp_replace("line", r"\s", ""))
    lines = read_lines(spark, path).select("file", "block", "n", is_header.alias("is_header"), F.when(is_header, F.col("line")).otherwise(letters).alias("line"))
    name = F.get(F.split(F.trim(F.regexp_replace("line", r"^\s*>", "")), r"\s+"), F.lit(0))
    size = F.when(F.col("is_header"), 0).otherwise(F.length("line")).cast("long")
    # one scan: a line's record, the name in its header, and how many letters stand between them
    placed = carried(lines, {"name": F.when(F.col("is_header"), name)}, {"upto": size, "record": F.col("is_header").cast("long")}, since={"at": ("name", "upto")})
    found = placed.where("NOT is_header AND line != '' AND name IS NOT NULL").select("file", "record", "name", "at", "line")
    # a line's letters go to each chunk that they are part of or that wants them beside it
    end = F.col("at") + F.length("line")
    low, high = F.expr(f"greatest((at - {after}) div {chunk}, 0L)"), F.expr(f"(at + length(line) - 1 + {before}) div {chunk}")
    dealt = found.select("file", "record", "name", "at", "line", end.alias("end"), F.explode(F.sequence(low, high)).alias("c"))
    a, b = F.greatest("at", F.col("c") * chunk - before), F.least("end", (F.col("c") + 1) * chunk + after)
    pieces = dealt.select("file", "record", "name", "c", a.alias("a"), F.substring("line", (a - F.col("at") + 1).cast("int"), (b - a).cast("int")).alias("part"), (b > a).alias("some")).where("some")
    whole = pieces.groupBy("file", "record", "c").agg(F.first("name").alias("name"), F.sort_array(F.collect_list(F.struct("a", "part"))).alias("parts"))
    start, first = F.col("c") * chunk, F.get("parts", F.lit(0))["a"]
    chunks = whole.select("name", "file", "record", start.alias("start"), F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("seq"), (start - first).cast("int").alias("lead"))
    return chunks.where(F.length("seq") > F.col("lead"))  # the letters before a border alone are no chunk


def fasta_kmers(spark: SparkSession, path: str, lengths, flank_length: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``name, file, record, peptide, offset`` (long), and flanks if asked for: every window of all sequences of FASTA files, however long they are."""
    lengths = peptide_lengths(lengths, None)
    chunks = read_fasta_chunks(spark, path, flank_length, max(lengths) - 1 + flank_length, chunk)
    at = kmers(chunks, lengths, flank_length)
    own = F.col("offset") - F.col("lead")
    kept = at.where((own >= 0) & (own < chunk)).withColumn("offset", F.col("start") + own)
    return kept.select("name", "file", "record", "peptide", "offset", *(("n_flank", "c_flank") if flank_length else ()))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"No {what}")
    return df


def read_alleles(spark: SparkSession, path: str) -> DataFrame:
    """``allele``: normal forms of the names in a file, separated by lines, commas or spaces; ``#`` starts a comment line."""
    text = spark.read.text(path).where(~F.trim("value").startswith("#"))
    names = text.select(F.explode(split_alleles(F.col("value"))).alias("raw"))
    return names.select(normalize_allele(F.col("raw")).alias("allele")).where("allele IS NOT NULL").distinct()


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``: captured tool output, a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_mixmhcpred(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows of a MixMHCpred table: tab-separated, ``#`` comments, one row a peptide with its best allele."""
    raw = spark.read.csv(path, sep="\t", comment="#", header=True)
    return canonical(
        raw.select(
            F.trim("Peptide").alias("peptide"),
            normalize_allele(F.col("BestAllele")).alias("allele"),
            F.col("Score_bestAllele").cast("double").alias("score"),
            F.col("`%Rank_bestAllele`").cast("double").alias("percentile_rank"),
        ),
        predictor_name="mixmhcpred",
        kind="pMHC_presentation",
    )


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """With a header, into the folder ``path``: as one file, ``part-00000.csv``, or a file a partition, each with its header.

    All partitions are written in parallel in either case. For one file they are then joined in order below one header: by the file system's own concatenation where it
    has one (HDFS), which moves no data; elsewhere the driver streams them, a buffer at a time. The rows, and their order, are those that one task would write.
    """
    options = {"emptyValue": ""}
    if not one_file:
        df.write.mode("overwrite").options(header=True, **options).csv(path)
        return
    import csv
    import io
    import uuid

    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join(names))
    folder = path.rstrip("/")
    parts_at = f"{folder}.parts-{uuid.uuid4().hex}"
    fs = place(folder).getFileSystem(conf)
    head = io.StringIO()
    csv.writer(head, lineterminator="\n").writerow(df.columns)
    try:
        df.write.options(header=False, **options).csv(parts_at)
        parts = sorted(str(x.getPath()) for x in fs.listStatus(place(parts_at)) if x.getPath().getName().startswith("part-") and x.getLen())
        fs.delete(place(folder), True)
        target = place(folder, "part-00000.csv")

        def begun():
            out = fs.create(target, True)
            out.write(bytearray(head.getvalue().encode()))
            return out

        begun().close()
        paths = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
        for i, p in enumerate(parts):
            paths[i] = place(p)
        try:
            if parts:
                fs.concat(target, paths)
        except Exception:  # this file system does not concatenate
            out = begun()
            for p in parts:
                source = fs.open(place(p))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
            out.close()
    finally:
        fs.delete(place(parts_at), True)


def write_results(df: DataFrame, path: str) -> None:
    """Canonical rows as Parquet, a folder a kind, so that readers of one kind skip the rest."""
    df.select(*COLUMNS).write.mode("overwrite").partitionBy("kind").parquet(path)
