"""Predictors backed by Python models that load once a worker and score Arrow batches."""

from __future__ import annotations

import copy
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitrail.functions.scoring import clamped_score
from epitrail.functions.text import models_path
from epitrail.operators.checks import UnsupportedAllele
from epitrail.predictors.base import Predictor
from epitrail.schema import Kind

#: load() -> model; model(peptides, alleles) -> a dict of equally long lists of numbers by column.
Load = Callable[[], Callable[[list[str], list[str]], dict[str, list]]]


def scored_by(asked: DataFrame, load: Load, columns: tuple[str, ...]) -> DataFrame:
    """``asked`` with the model's columns, as doubles. The model runs once a row."""

    def run(batches: Iterator) -> Iterator:
        model = load()
        for pdf in batches:
            got = model(pdf["peptide"].tolist(), pdf["allele"].tolist())
            yield pdf.assign(**{c: [float(x) if x is not None else float("nan") for x in got[c]] for c in columns})

    plain = asked.select("peptide", "allele")
    return plain.mapInPandas(run, "peptide string, allele string, " + ", ".join(f"{c} double" for c in columns))


class ModelPredictor(Predictor):
    """Any model of the form :data:`Load`."""

    def __init__(self, spark, alleles=(), load: Load | None = None, columns=("score",), name: str = "model", kind: str = Kind.AFFINITY, **options):
        self.load, self.columns, self.name, self.kind = load, tuple(columns), name, kind
        super().__init__(spark, alleles, **options)

    def score(self, asked: DataFrame) -> DataFrame:
        return scored_by(asked, self.load, self.columns)


class MHCflurry(Predictor):
    """MHCflurry: affinities and presentation scores of each pair, as two rows; a pair with one alone is an error."""

    name = "mhcflurry"
    most_length = 15

    def __init__(self, spark, alleles=(), models: str | None = None, load_affinity: Load | None = None, load_presentation: Load | None = None, **options):
        path = models_path(models)
        self.load_affinity = load_affinity or (lambda: _mhcflurry_affinity(path))
        self.load_presentation = load_presentation or (lambda: _mhcflurry_presentation(path))
        super().__init__(spark, alleles, **options)

    def affinities(self, asked: DataFrame) -> DataFrame:
        got = scored_by(asked, self.load_affinity, ("value", "percentile_rank"))
        return got.withColumn("score", clamped_score(F.col("value"))).withColumn("kind", F.lit(Kind.AFFINITY))

    def score(self, asked: DataFrame) -> DataFrame:
        load_affinity, load_presentation = self.load_affinity, self.load_presentation

        def load():  # both models see each batch once, so their rows need no join
            bind, show = load_affinity(), load_presentation()
            return lambda peptides, alleles: bind(peptides, alleles) | show(peptides, alleles)

        got = scored_by(asked, load, ("value", "percentile_rank", "p_score", "p_rank")).withColumn("score", clamped_score(F.col("value")))
        lacks = F.raise_error(F.concat(F.lit("No presentation score for "), "peptide", F.lit(", "), "allele")).cast("double")
        both = got.withColumn("p_score", F.when(F.col("p_score").isNull() | F.isnan("p_score"), lacks).otherwise(F.col("p_score")))
        rows = F.array(
            F.struct(F.lit(Kind.AFFINITY).alias("kind"), "score", "value", "percentile_rank"),
            F.struct(F.lit(Kind.PRESENTATION).alias("kind"), F.col("p_score").alias("score"), F.lit(None).cast("double").alias("value"), F.col("p_rank").alias("percentile_rank")),
        )
        return both.select("peptide", "allele", F.inline(rows))


    def one_kind(self) -> Predictor:
        one = copy.copy(self)
        one.score = one.affinities
        return one


class MHCflurryAffinity(MHCflurry):
    """MHCflurry's affinities alone."""

    name = "mhcflurry-affinity"

    def score(self, asked: DataFrame) -> DataFrame:
        return self.affinities(asked)


def _mhcflurry_affinity(path):
    from mhcflurry import Class1AffinityPredictor

    model = Class1AffinityPredictor.load(path) if path else Class1AffinityPredictor.load()

    def run(peptides, alleles):
        unknown = sorted(set(alleles) - set(model.supported_alleles))
        if unknown:
            raise UnsupportedAllele(f"Unsupported alleles: {', '.join(unknown)}")
        got = model.predict_to_dataframe(peptides=peptides, alleles=alleles, throw=True)
        rank = got["prediction_percentile"] if "prediction_percentile" in got else [None] * len(got)
        return {"value": got["prediction"].tolist(), "percentile_rank": list(rank)}

    return run


def _mhcflurry_presentation(path):
    from mhcflurry import Class1PresentationPredictor

    model = Class1PresentationPredictor.load(path) if path else Class1PresentationPredictor.load()

    def run(peptides, alleles):
        score, rank = [None] * len(peptides), [None] * len(peptides)
        for allele in set(alleles):
            at = [i for i, a in enumerate(alleles) if a == allele]
            got = model.predict(peptides=[peptides[i] for i in at], alleles=[allele], verbose=0)
            for i, s, r in zip((at[j] for j in got["peptide_num"]), got["presentation_score"], got["presentation_percentile"]):
                score[i], rank[i] = s, r
        return {"p_score": score, "p_rank": rank}

    return run


def bigmhc_folder(path: str | None = None) -> str:
    """The argument, else ``BIGMHC_DIR``, else ``~/bigmhc``."""
    folder = models_path(path or os.environ.get("BIGMHC_DIR") or "~/bigmhc")
    if not os.path.isdir(folder):
        raise ValueError(f"No BigMHC folder at {folder}; give one, or set BIGMHC_DIR")
    return folder


class BigMHC(Predictor):
    """BigMHC: the mean of an ensemble's sigmoids, for presentation (``el``) or immunogenicity (``im``).

    Alleles are passed on as they are. ``load`` gives the members: functions of upper-case peptides and alleles to logits.
    """

    name = "bigmhc"
    normalizes = False
    least_length = None

    def __init__(self, spark, alleles=(), mode: str = "el", load: Callable | None = None, folder: str | None = None, **options):
        if mode not in ("el", "im"):
            raise ValueError("mode must be el or im")
        self.kind = Kind.PRESENTATION if mode == "el" else Kind.IMMUNOGENICITY
        self.name = f"bigmhc-{mode}"
        if load is None:
            place = bigmhc_folder(folder)
            load = lambda: _bigmhc_members(place, mode)
        self.members = load
        super().__init__(spark, alleles, **options)

    def score(self, asked: DataFrame) -> DataFrame:
        members = self.members

        def load():
            import numpy as np

            models = members()

            def run(peptides, alleles):
                upper = [p.upper() for p in peptides]
                total = sum(1 / (1 + np.exp(-np.asarray(m(upper, alleles), dtype=float))) for m in models)
                return {"score": (total / len(models)).tolist()}

            return run

        return scored_by(asked, load, ("score",))


def _bigmhc_members(folder: str, mode: str):
    import sys

    sys.path.insert(0, os.path.join(folder, "src"))
    try:
        import torch
        from bigmhc import BigMHC as Net
        from encseq import EncSeq
    finally:
        sys.path.pop(0)
    names = [f"bat{2**i}" for i in range(9, 16)]
    places = [os.path.join(folder, "models", n, "im" if mode == "im" else "") for n in names]
    nets = [Net.load(p).eval() for p in places]
    codes = EncSeq(os.path.join(folder, "data", "pseudoseqs.csv"))

    def member(net):
        def run(peptides, alleles):
            with torch.no_grad():
                return [float(net(codes.mhc(a), codes.pep(p))[0]) for p, a in zip(peptides, alleles)]

        return run

    return [member(n) for n in nets]
