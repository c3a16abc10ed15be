"""Predictors of antigen processing: from a profile of cleavage along a sequence to scores of its windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epitrail.functions import scoring
from epitrail.operators.windows import Internal, kmers, peptide_lengths, sequences
from epitrail.schema import Kind, canonical


class ProcessingPredictor:
    """Scores need no allele. Subclasses give :meth:`profile`; here it is an expression of ``seq``.

    A profile has one number a residue: the probability of a cut after it. It is made once a sequence, before windows.
    """

    name = "processing"
    version = ""
    kind = Kind.PROCESSING
    default_scoring = "nterm_cterm_max_internal"
    default_lengths: tuple[int, ...] = (9,)
    takes_alleles = False

    def __init__(self, spark: SparkSession, profile: Column | None = None, scoring_mode=None, default_lengths=None):
        self.spark, self._profile = spark, profile
        self.mode = scoring.resolve_mode(scoring_mode, self.default_scoring)
        name = self.default_scoring if scoring_mode is None else scoring_mode
        self.tables = scoring.TABLES[name] if isinstance(name, str) else getattr(name, "tables", ())
        self.blocks = getattr(name, "blocks", None)
        self.default_lengths = tuple(peptide_lengths(default_lengths, self.default_lengths))

    def profile(self, seqs: DataFrame) -> DataFrame:
        """``seqs`` with ``probs``; a row whose sequence is null may be left out."""
        if self._profile is None:
            raise NotImplementedError("give a profile")
        return seqs.withColumn("probs", self._profile)

    def _scored(self, place: str) -> Column:
        p, o, k = F.col("probs"), F.col(place), F.col("_k")
        return self.mode(scoring.c_term(p, o, k), scoring.n_term(p, o), scoring.internal(p, o, k))

    def predict_proteins(self, given, lengths=None, flank_length: int = 0) -> DataFrame:
        """Canonical rows of all windows of sequences; flanks are recorded and never change a score."""
        df = given if isinstance(given, DataFrame) else sequences(self.spark, given)
        lengths = peptide_lengths(lengths, self.default_lengths)
        with_profile = self.profile(df.select("name", "seq").where("seq IS NOT NULL"))
        if self.blocks:
            rows = kmers(with_profile, lengths, flank_length, along="probs", scored=self.blocks).withColumnRenamed("name", "source_sequence_name")
            return canonical(rows, kind=self.kind, predictor_name=self.name, predictor_version=self.version)
        at = kmers(with_profile, lengths, flank_length, along="probs", tables=self.tables)
        p, o, k = F.col("probs"), F.col("_place"), F.col("_k")
        inner = Internal("probs", lengths, k, o)
        score = self.mode(scoring.c_term(p, o, k), scoring.n_term(p, o), inner if self.tables else inner.values())
        rows = at.withColumn("score", score).withColumnRenamed("name", "source_sequence_name")
        return canonical(rows, kind=self.kind, predictor_name=self.name, predictor_version=self.version)

    def predict(self, given, n_flanks=None, c_flanks=None) -> DataFrame:
        """Canonical rows of peptides, a row each, with optional flanks that the profile sees.

        ``given``: strings, with lists of flanks beside them, or a DataFrame ``peptide[, n_flank, c_flank]``.
        """
        if isinstance(given, DataFrame):
            df = given
        else:
            given = [given] if isinstance(given, str) else list(given)
            for what in (n_flanks, c_flanks):
                if what is not None and len(what) != len(given):
                    raise ValueError("There must be as many flanks as peptides")
            none = [""] * len(given)
            rows = list(zip(given, n_flanks or none, c_flanks or none))
            df = self.spark.createDataFrame(rows, "peptide string, n_flank string, c_flank string")
        for c in ("n_flank", "c_flank"):
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(""))) if c in df.columns else df.withColumn(c, F.lit(""))
        whole = df.where(F.length("peptide") > 0).withColumn("seq", F.concat("n_flank", "peptide", "c_flank"))
        placed = self.profile(whole).withColumn("offset", F.length("n_flank")).withColumn("_k", F.length("peptide"))
        rows = placed.withColumn("score", self._scored("offset")).drop("offset")
        return canonical(rows, kind=self.kind, predictor_name=self.name, predictor_version=self.version)

    def one_kind(self) -> ProcessingPredictor:
        return self

    def predict_cleavage_sites(self, given, long: bool = False) -> DataFrame:
        """``name, probs``, or with ``long`` a row a residue: ``name, position, residue, prob``."""
        df = given if isinstance(given, DataFrame) else sequences(self.spark, given)
        out = self.profile(df.select("name", "seq").where("seq IS NOT NULL"))
        if not long:
            return out.select("name", "probs")
        return out.select("name", "seq", F.posexplode("probs").alias("position", "prob")).select(
            "name", "position", F.substring("seq", F.col("position") + 1, F.lit(1)).alias("residue"), "prob"
        )


class ProteasomePredictor(ProcessingPredictor):
    """The same for the proteasome alone."""

    name = "proteasome"
    kind = Kind.CLEAVAGE
    default_scoring = "cterm_max_internal"


class ModelProfile(ProteasomePredictor):
    """A profile from a Python model: ``load()`` gives a function from a list of sequences to lists of numbers.

    The model is loaded once a worker and sees Arrow batches.
    """

    def __init__(self, spark, load: Callable[[], Callable[[list[str]], list]], name: str = "model", **options):
        self.load, self.name = load, name
        super().__init__(spark, **options)

    def profile(self, seqs: DataFrame) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def probs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in batches:
                yield pd.Series([[float(x) for x in p] for p in model(s.tolist())], dtype=object)

        return seqs.withColumn("probs", probs.asNondeterministic()("seq"))


class NetChop(ProteasomePredictor):
    """Profiles from the netChop program, one process a sequence."""

    name = "netchop"

    def __init__(self, spark, program: str = "netChop", timeout: float = 120.0, **options):
        self.program, self.timeout = program, timeout
        super().__init__(spark, **options)

    def profile(self, seqs: DataFrame) -> DataFrame:
        from epitrail.predictors.tools import run_on_text
        from epitrail.sources.stdout import parse_netchop

        program, timeout = self.program, self.timeout
        fasta = lambda seq: f">seq\n{seq}\n"
        ran = run_on_text(seqs, "seq", lambda path: [program, path], fasta, timeout)
        one = parse_netchop(ran)
        wrong = F.raise_error(F.lit("netChop gave a profile of another length than its sequence")).cast("array<double>")
        fine = (F.col("seq_ord") == 0) & (F.size("probs") == F.length("seq"))
        return one.withColumn("probs", F.when(fine, F.col("probs")).otherwise(wrong)).drop("seq_ord")


def pepsickle(spark, human_only: bool = False, threshold: float = 0.5, **options) -> ModelProfile:
    """Profiles of the pepsickle package's epitope model."""

    def load():
        from pepsickle.model_functions import initialize_epitope_model, predict_protein_cleavage_locations

        model = initialize_epitope_model(human_only=human_only)
        run = lambda s: predict_protein_cleavage_locations(protein_id="seq", protein_seq=s, model=model, mod_type="epitope", proteasome_type="C", threshold=threshold)
        return lambda seqs: [[row[2] for row in run(s)] for s in seqs]

    return ModelProfile(spark, load, name="pepsickle", **options)
