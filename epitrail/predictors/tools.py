"""Predictors that run a program on each executor: one process for a batch of peptides and an allele."""

from __future__ import annotations

import copy
import errno
import re
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitrail.functions.alleles import normalize_allele, render_allele
from epitrail.operators import checks
from epitrail.operators.quarantine import quarantined
from epitrail.operators.combine import pairs
from epitrail.operators.windows import distinct_peptides, peptides
from epitrail.predictors.base import Predictor
from epitrail.schema import Kind
from epitrail.sources.files import scratch_path
from epitrail.sources.layouts import LAYOUTS
from epitrail.sources.stdout import parse_by_header, parse_layout

BATCH = 10_000
TRIES, DELAY = 5, 1.0


def run_program(command: list[str], timeout: float | None = None, check: bool = True) -> str:
    """Standard output of a program. A start that fails for want of processes is tried again, waiting twice as long each time."""
    delay = DELAY
    for attempt in range(TRIES):
        try:
            done = subprocess.run(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, timeout=timeout)
            break
        except OSError as e:
            if e.errno != errno.EAGAIN or attempt == TRIES - 1:
                raise
            time.sleep(delay)
            delay *= 2
    text = done.stdout.decode("utf-8", errors="replace")
    if check and done.returncode:
        raise RuntimeError(f"{command[0]} ended with code {done.returncode}: {text[-500:]}")
    return text


def run_on_text(df: DataFrame, column: str, command: Callable[[str], list[str]], content: Callable[[str], str], timeout: float | None = None) -> DataFrame:
    """``df`` with the output of a program, in ``text``, for a file made of each row's ``column``."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for value in pdf[column]:
                with tempfile.TemporaryDirectory() as folder:
                    path = Path(folder, "input")
                    path.write_text(content(value))
                    out.append(run_program(command(str(path)), timeout))
            yield pdf.assign(text=out)

    return df.mapInPandas(run, schema + ",text:string")


@contextmanager
def one_of(name: str, limit: int | None) -> Iterator[None]:
    """At most ``limit`` holders of a name at once on this host, whatever executors run there; None: no limit.

    Each slot is a locked file; the system unlocks it when its process ends, however it ends.
    """
    if limit is None:
        yield
        return
    import fcntl

    files = [open(Path(tempfile.gettempdir(), f"epitrail-{re.sub(r'[^A-Za-z0-9]', '_', name)}-{i}.lock"), "a") for i in range(limit)]
    try:
        while True:
            for f in files:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except BlockingIOError:
                    continue
                yield
                return
            time.sleep(0.05)
    finally:
        for f in files:
            f.close()


def limited(spark, name: str, limit: int | None):
    """The resource profile of a stage whose tasks each take one unit of the executors' resource ``name``; None where there is no limit or no such resource.

    With ``spark.executor.resource.<name>.amount`` set to the limit, as many tasks run on an executor and the other cores are free for other stages. Without it,
    as in local mode, :func:`one_of` alone keeps the limit, and tasks that wait hold their cores.
    """
    if limit is None or spark.conf.get(f"spark.executor.resource.{name}.amount", None) is None:
        return None
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    return ResourceProfileBuilder().require(TaskResourceRequests().resource(name, 1)).build


@dataclass(frozen=True)
class Tool:
    """How a program is called and what it writes.

    ``parser``: a layout's name, or ``header`` where the header tells. ``list_flags``: to list alleles; empty: none.
    """

    program: str
    parser: str
    allele_flag: str = "-a"
    file_flag: str | None = "-f"
    peptide_flags: tuple[str, ...] = ("-p",)
    extra: tuple[str, ...] = ()
    temp_flag: str | None = None
    list_flags: tuple[str, ...] = ("-listMHC",)
    style: str = "plain"
    by_length: bool = False
    kind: str = Kind.AFFINITY
    lengths: tuple[int, ...] = (9,)
    least: int = 8
    most: int | None = None
    one_length: bool = False
    #: Processes on a host at once; None: as many as there are tasks.
    limit: int | None = None


_CLASS2 = {"list_flags": ("-list",), "peptide_flags": ("-inptype", "1"), "temp_flag": "-tdir", "style": "class2", "lengths": tuple(range(15, 21)), "least": 9}
_PAN = {"program": "netMHCpan", "temp_flag": "-tdir"}
_PAN2 = {"program": "netMHCIIpan", **_CLASS2}

# The programs' own flags and limits.
TOOLS = {
    "netmhc3": Tool("netMHC", "netmhc3", "--mhc", None, (), ("--nodirect",), list_flags=("-A",), by_length=True, limit=1),
    "netmhc4": Tool("netMHC", "netmhc4", temp_flag="-tdir", style="compact"),
    "netmhccons": Tool("netMHCcons", "netmhccons", peptide_flags=("-inptype", "1"), temp_flag="-tdir", list_flags=(), by_length=True),
    "netmhcpan28": Tool(**_PAN, parser="header", by_length=True),
    "netmhcpan3": Tool(**_PAN, parser="header"),
    "netmhcpan4-ba": Tool(**_PAN, parser="header", extra=("-BA",)),
    "netmhcpan4-el": Tool(**_PAN, parser="header", kind=Kind.PRESENTATION),
    "netmhcpan41-ba": Tool(**_PAN, parser="header", extra=("-BA",)),
    "netmhcpan41-el": Tool(**_PAN, parser="header", kind=Kind.PRESENTATION),
    "netmhcpan42-ba": Tool(**_PAN, parser="header", extra=("-BA",)),
    "netmhcpan42-el": Tool(**_PAN, parser="header", kind=Kind.PRESENTATION),
    "netmhciipan3": Tool(**_PAN2, parser="netmhciipan3"),
    "netmhciipan4-el": Tool(**_PAN2, parser="netmhciipan4-el", extra=("-BA",), kind=Kind.PRESENTATION),
    "netmhciipan4-ba": Tool(**_PAN2, parser="netmhciipan4-ba", extra=("-BA",)),
    "netmhciipan43-el": Tool(**_PAN2, parser="netmhciipan43-el", extra=("-BA",), kind=Kind.PRESENTATION),
    "netmhciipan43-ba": Tool(**_PAN2, parser="netmhciipan43-ba", extra=("-BA",)),
    "netmhcstabpan": Tool("netMHCstabpan", "netmhcstabpan", kind=Kind.STABILITY, one_length=True),
}


def build_command(tool: Tool, program: str, allele: str, path: str, temp: str, peptide_mode: bool = True) -> list[str]:
    command = [program, *(tool.peptide_flags if peptide_mode else ()), tool.allele_flag, allele]
    if tool.temp_flag:
        command += [tool.temp_flag, temp]
    command += tool.extra
    return command + ([tool.file_flag, path] if tool.file_flag else [path])


def spread(asked: DataFrame) -> Column:
    """By what the peptides of an allele are dealt: a run has few alleles, so each is split over all cores."""
    return F.pmod(F.xxhash64("peptide"), F.lit(max(1, asked.sparkSession.sparkContext.defaultParallelism)))


class ToolPredictor(Predictor):
    """Runs a :class:`Tool` on the executors. Pairs are dealt by allele, length and :func:`spread` into batches, a process each."""

    validates = True
    #: Where a line tells of several kinds: the one that its row is of; None: a row each.
    prefer: str | None = None

    def __init__(self, spark, alleles=(), tool: str | Tool = "netmhcpan41-ba", program: str | None = None, batch: int = BATCH, legacy_kind: bool = False, check_alleles: bool = False, **options):
        self.name = tool if isinstance(tool, str) else tool.program
        self.tool = TOOLS[tool] if isinstance(tool, str) else tool
        self.program, self.batch, self.legacy_kind = program or self.tool.program, batch, legacy_kind
        self.default_lengths, self.least_length, self.most_length, self.kind = self.tool.lengths, self.tool.least, self.tool.most, self.tool.kind
        if check_alleles and self.tool.list_flags:
            options["valid_alleles"] = supported_alleles(spark, self.program, self.tool.list_flags)
        super().__init__(spark, alleles, **options)

    def predict(self, given, validate: bool = False) -> DataFrame:
        if self.tool.one_length:
            given = given if isinstance(given, DataFrame) else peptides(self.spark, given)
            checks.require_one_length(given)
        return super().predict(given, validate)

    def one_kind(self) -> ToolPredictor:
        one = copy.copy(self)
        one.prefer = self.kind
        return one

    def run(self, asked: DataFrame, strict: bool = True, patience: int | None = None) -> DataFrame:
        """``text``: the output of each process; unless ``strict``, also the pairs that fail: see :func:`epitrail.operators.quarantine.quarantined`."""
        tool, program = self.tool, self.program
        spelled = asked.select("peptide", render_allele(F.col("allele"), tool.style).alias("allele"), (F.length("peptide") if tool.by_length else F.lit(0)).alias("n"))
        dealt = spelled.repartition("allele", "n", spread(spelled)).sortWithinPartitions("allele", "n")

        def process(rows: list[str], key: tuple) -> str:
            with tempfile.TemporaryDirectory() as folder, one_of(program, tool.limit):
                path = Path(folder, "peptides")
                path.write_text("".join(f"{p}\n" for p in rows))
                text = run_program(build_command(tool, program, key[0], str(path), folder))
            if not strict and (said := re.search(r"(?i)ERROR[^\n]*", text)):
                raise RuntimeError(said[0])
            return text

        return quarantined(dealt, process, self.batch, strict, limited(self.spark, self.name, tool.limit), patience)

    def _parsed(self, text: DataFrame) -> DataFrame:
        if self.tool.parser == "header":
            return parse_by_header(text, self.name, prefer=self.prefer)
        return parse_layout(text, self.tool.parser, self.name, legacy_kind=self.legacy_kind)

    def score(self, asked: DataFrame) -> DataFrame:
        return self._parsed(self.run(asked))

    def predict_or_quarantine(self, given, patience: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Canonical rows of the peptides that pass, and a table of those that do not: ``peptide, allele, batch, reason``.

        Peptides that break a rule are in it once, without an allele. Of the others a batch with which the program fails, or in whose output it reports an error, is halved
        until the peptide at fault is alone; all others are scored. The outputs are written to the shared folder once, so no program runs twice for the two tables.
        """
        df = given if isinstance(given, DataFrame) else peptides(self.spark, given)
        good, bad = (checks.split_valid(df, least=self.least_length, most=self.most_length) if self.validates else (df, df.where("FALSE").withColumn("violation", F.lit(""))))
        path = scratch_path(self.spark, "tool-output")
        # in folders of their own, so that no parser ever sees a row that has no output
        made = self.run(pairs(distinct_peptides(good), self.alleles), False, patience).withColumn("failed", F.col("reason").isNotNull())
        made.write.partitionBy("failed").parquet(path)
        ran = self.spark.read.schema(made.schema).parquet(path)
        # the name that the program was given, back to the one that was asked for
        spelled = self.alleles.select(render_allele(F.col("allele"), self.tool.style).alias("_spelled"), F.col("allele").alias("_asked"))
        failed = ran.where("failed").withColumn("_spelled", F.substring_index("group", "/", 1)).join(F.broadcast(spelled), "_spelled", "left")
        invalid = bad.select("peptide", F.lit(None).cast("string").alias("allele"), F.lit(None).cast("string").alias("batch"), F.col("violation").alias("reason")).distinct()
        errors = failed.select(F.col("item").alias("peptide"), F.coalesce("_asked", "_spelled").alias("allele"), "batch", "reason")
        return self._canonical(self._parsed(ran.where("NOT failed").select("text"))), invalid.unionByName(errors)


def supported_alleles(spark, program: str, flags: tuple[str, ...]) -> DataFrame:
    """``allele``: what a program says it knows; lines that are no names are left out."""
    lines = [x.strip() for x in run_program([program, *flags]).splitlines()]
    names = [(x.split()[0],) for x in lines if x and not x.startswith("#")]
    found = spark.createDataFrame(names, "raw string").select(normalize_allele(F.col("raw"), infer_pair=True).alias("allele")).where("allele IS NOT NULL").distinct()
    if found.isEmpty():
        raise SystemError(f"{program} lists no alleles")
    return found


def netmhc_version(help_text: str) -> str:
    """``netmhc3`` or ``netmhc4`` by what the program's help mentions."""
    new, old = "-listMHC" in help_text, "--Alleles" in help_text
    if new == old:
        raise SystemError("Could not tell the version of NetMHC")
    return "netmhc4" if new else "netmhc3"


def netmhcpan_version(text: str) -> str:
    """The version in ``--version`` output as a tool's stem; unknown ones count as the newest."""
    found = re.search(r"([0-9]+)\.([0-9]+)", text)
    stem = {("2", "8"): "netmhcpan28", ("3", "0"): "netmhcpan3", ("4", "0"): "netmhcpan4", ("4", "1"): "netmhcpan41"}
    return stem.get(found.groups(), "netmhcpan42") if found else "netmhcpan42"


def netmhciipan_version(help_text: str) -> str:
    for mark, stem in (("-4.0", "netmhciipan4"), ("-4", "netmhciipan43"), ("-3", "netmhciipan3")):
        if mark in help_text:
            return stem
    raise ValueError("Could not tell the version of NetMHCIIpan")


class MixMHCpred(Predictor):
    """MixMHCpred: a process an allele and batch, which writes a table."""

    name = "mixmhcpred"
    kind = Kind.PRESENTATION
    validates = True
    most_length = 14

    def __init__(self, spark, alleles=(), program: str = "MixMHCpred", with_cysteine: bool = True, batch: int = BATCH, **options):
        self.program, self.with_cysteine, self.batch = program, with_cysteine, batch
        super().__init__(spark, alleles, **options)

    def score(self, asked: DataFrame) -> DataFrame:
        program, flags = self.program, [] if self.with_cysteine else ["-c"]

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            for pdf in batches:
                for allele, part in pdf.groupby("allele", sort=True):
                    with tempfile.TemporaryDirectory() as folder:
                        given, out = Path(folder, "in"), Path(folder, "out")
                        given.write_text("".join(f"{p}\n" for p in part["peptide"]))
                        run_program([program, "-i", str(given), "-o", str(out), "-a", allele, *flags])
                        got = pd.read_csv(out, comment="#", sep="\t")
                    yield pd.DataFrame({"peptide": got["Peptide"], "raw": got["BestAllele"].astype(str), "score": got["Score_bestAllele"].astype(float), "percentile_rank": got["%Rank_bestAllele"].astype(float)})

        spelled = asked.select("peptide", render_allele(F.regexp_replace("allele", "^HLA-", ""), "compact").alias("allele"))
        rows = spelled.repartition("allele", spread(spelled)).mapInPandas(run, "peptide string, raw string, score double, percentile_rank double")
        return rows.withColumn("allele", normalize_allele(F.col("raw"))).drop("raw")


assert all(t.parser == "header" or t.parser in LAYOUTS for t in TOOLS.values())
