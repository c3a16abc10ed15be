"""Command line: predict peptides or sequences with one or more predictors, filter, and write CSV.

    spark-submit epitrail/cli.py --mhc-predictor random --mhc-alleles HLA-A*02:01 --sequence SIINFEKLQY
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from epitrail.functions.text import parse_int_list
from epitrail.operators.combine import union
from epitrail.operators.results import thresholds
from epitrail.operators.windows import peptides, sequences
from epitrail.predictors import registry
from epitrail.schema import legacy
from epitrail.sources import files

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    mhc = p.add_argument_group("predictors")
    mhc.add_argument("--mhc-predictor", required=True, nargs="+", help="names, separated by commas or spaces")
    mhc.add_argument("--mhc-predictor-path", help="the program to run")
    mhc.add_argument("--mhc-predictor-models-path", help="the models to load")
    mhc.add_argument("--mhc-peptide-lengths", "--mhc-epitope-lengths", type=parse_int_list, help="such as 8-11,15")
    mhc.add_argument("--mhc-alleles", default="")
    mhc.add_argument("--mhc-alleles-file")
    mhc.add_argument("--do-not-raise-on-error", action="store_true")
    p.add_argument("--log-config", help="a logging configuration file; by default messages go to standard error")
    given = p.add_argument_group("input")
    given.add_argument("--sequence", nargs="*", help="peptides, or sequences to scan")
    given.add_argument("--extract-subsequences", action="store_true", help="scan the given sequences")
    given.add_argument("--input-peptides-file")
    given.add_argument("--input-fasta-file")
    keep = p.add_argument_group("filters")
    keep.add_argument("--max-affinity", type=float)
    keep.add_argument("--max-percentile-rank", type=float)
    keep.add_argument("--min-score", type=float)
    p.add_argument("--output-csv")
    p.add_argument("--output-parts", action="store_true", help="write a file a partition, as results too large for one task need")
    return p


def alleles_of(spark: SparkSession, args) -> list[str]:
    found = [a for a in args.mhc_alleles.replace(",", " ").split()]
    if args.mhc_alleles_file:
        found += [r.allele for r in files.read_alleles(spark, args.mhc_alleles_file).orderBy("allele").collect()]
    return list(dict.fromkeys(found))


def predictors_of(spark: SparkSession, args) -> list:
    names = registry.parse_names(args.mhc_predictor)
    alleles = alleles_of(spark, args) if any(n not in registry.ALLELE_FREE for n in names) else []
    if not alleles and any(n not in registry.ALLELE_FREE | {"random"} for n in names):
        raise ValueError("MHC alleles are needed")
    options = {"program": args.mhc_predictor_path, "models": args.mhc_predictor_models_path, "strict": not args.do_not_raise_on_error}
    return [registry.make(spark, n, alleles, args.mhc_peptide_lengths, **options) for n in names]


def results(spark: SparkSession, args) -> DataFrame:
    """The older view of all predictors' rows within the limits."""
    scan, given = args.extract_subsequences, None
    if args.input_fasta_file:
        given, scan = files.require_rows(files.read_fasta(spark, args.input_fasta_file), "sequences in the FASTA file"), True
    elif args.sequence:
        given = sequences(spark, args.sequence) if scan else peptides(spark, args.sequence)
    elif args.input_peptides_file:
        given = files.read_peptides(spark, args.input_peptides_file)
        given = given.selectExpr("peptide as name", "peptide as seq").distinct() if scan else given
    else:
        raise ValueError("Give a sequence, a peptide file or a FASTA file")
    made = [p.predict_proteins(given) if scan else p.predict(given) for p in map(lambda p: p.one_kind(), predictors_of(spark, args))]
    return thresholds(legacy(union(made)), args.max_affinity, args.max_percentile_rank, args.min_score)


def configure_logging(path: str | None = None) -> None:
    """Messages of the library to standard error from INFO on, or as a file in the format of ``logging.config.fileConfig`` says."""
    if path is not None:
        from logging.config import fileConfig

        fileConfig(path, disable_existing_loggers=False)
        return
    own = logging.getLogger("epitrail")
    if not own.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        own.addHandler(handler)
    own.setLevel(logging.INFO)


def main(argv: list[str] | None = None) -> DataFrame:
    args = parser().parse_args(sys.argv[1:] if argv is None else argv)
    configure_logging(args.log_config)
    spark = SparkSession.builder.appName("epitrail").getOrCreate()
    out = results(spark, args)
    if args.output_csv:
        files.write_csv(out, args.output_csv, one_file=not args.output_parts)
        log.info("Wrote %s", args.output_csv)
    else:
        out.show(50, truncate=False)
    return out


if __name__ == "__main__":
    main()
