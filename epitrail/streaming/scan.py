"""Windows and scores of sequences that arrive as a stream.

Scanning and scoring look at one row at a time, so the transformations of the batch engine run on a stream as they
are. Distinct peptides need state; a watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from epitrail.operators.windows import kmers
from epitrail.predictors.processing import ProcessingPredictor


def stream_predictions(predictor: ProcessingPredictor, arriving: DataFrame, lengths=None, flank_length: int = 0) -> DataFrame:
    """Canonical rows of a stream ``name, seq``."""
    return predictor.predict_proteins(arriving, lengths, flank_length)


def stream_new_peptides(arriving: DataFrame, lengths, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Peptides of a stream ``name, seq, <time>``, each once within the time that late rows are waited for."""
    windows = kmers(arriving, lengths).withWatermark(time, late)
    return windows.select("peptide", time).dropDuplicatesWithinWatermark(["peptide"])
