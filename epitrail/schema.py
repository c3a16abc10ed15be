"""The fixed schemas: canonical prediction rows, and the older view of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind:
    """What a row measures."""

    AFFINITY = "pMHC_affinity"
    PRESENTATION = "pMHC_presentation"
    STABILITY = "pMHC_stability"
    IMMUNOGENICITY = "immunogenicity"
    PROCESSING = "antigen_processing"
    CLEAVAGE = "proteasome_cleavage"
    TAP = "tap_transport"
    ERAP = "erap_trimming"


KINDS = (Kind.AFFINITY, Kind.PRESENTATION, Kind.STABILITY, Kind.IMMUNOGENICITY, Kind.PROCESSING, Kind.CLEAVAGE, Kind.TAP, Kind.ERAP)

PREDICTION = T.StructType(
    [
        T.StructField("sample_name", T.StringType(), False),
        T.StructField("peptide", T.StringType(), False),
        T.StructField("n_flank", T.StringType(), False),
        T.StructField("c_flank", T.StringType(), False),
        T.StructField("source_sequence_name", T.StringType(), True),
        T.StructField("offset", T.IntegerType(), False),
        T.StructField("predictor_name", T.StringType(), False),
        T.StructField("predictor_version", T.StringType(), False),
        T.StructField("allele", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("percentile_rank", T.DoubleType(), True),
    ]
)
COLUMNS = tuple(PREDICTION.names)

#: Filled in where a row or its predictor gives nothing.
DEFAULTS = {"sample_name": "", "n_flank": "", "c_flank": "", "offset": 0, "predictor_name": "", "predictor_version": "", "allele": ""}

LEGACY_COLUMNS = ("source_sequence_name", "offset", "peptide", "allele", "score", "affinity", "percentile_rank", "prediction_method_name", "length")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PREDICTION)


def canonical(df: DataFrame, keep: tuple[str, ...] = (), **shared) -> DataFrame:
    """``df`` in the canonical columns and types.

    A column's value is the row's own, else the shared constant, else the default; NaN becomes null in ``value`` and
    ``percentile_rank``; a null score becomes 0. Columns outside the schema are dropped, but those in ``keep``.
    """
    out = []
    for field in PREDICTION:
        name, kind = field.name, field.dataType
        given = [F.col(name).cast(kind)] if name in df.columns else []
        if name in ("value", "percentile_rank"):
            given = [F.nanvl(c, F.lit(None).cast("double")) for c in given]
        fallback = shared.get(name, DEFAULTS.get(name, 0.0 if name == "score" else None))
        if fallback is not None:
            given.append(F.lit(fallback).cast(kind))
        if name == "peptide":
            given.append(F.lit(""))
        out.append((F.coalesce(*given) if given else F.lit(None).cast(kind)).alias(name))
    return df.select(*out, *keep)


def legacy(df: DataFrame, columns=LEGACY_COLUMNS) -> DataFrame:
    """The older view of canonical rows: renamed, without kind, version, sample and flanks."""
    renamed = df.select(
        "source_sequence_name", "offset", "peptide", "allele", "score",
        F.col("value").alias("affinity"), "percentile_rank",
        F.col("predictor_name").alias("prediction_method_name"), F.length("peptide").alias("length"),
    )
    return renamed.select(*columns)


def from_legacy(df: DataFrame, kind: str) -> DataFrame:
    """Canonical rows of one kind from the older view; a null score becomes 0, a null allele empty."""
    names = {"affinity": "value", "prediction_method_name": "predictor_name"}
    return canonical(df.drop("kind").withColumnsRenamed(names), kind=kind)


def legacy_distinct(df: DataFrame) -> DataFrame:
    """Rows of the older view that differ in any of its eight own fields."""
    return df.dropDuplicates(list(LEGACY_COLUMNS[:-1]))


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object a row in ``json``."""
    return df.select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("json"))


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Canonical rows from JSON objects; unknown keys are dropped, missing ones get their defaults."""
    return canonical(df.select(F.from_json(column, PREDICTION.simpleString()).alias("r")).select("r.*"))


def to_nested_json(df: DataFrame, key=("sample_name", "peptide", "offset", "source_sequence_name")) -> DataFrame:
    """The ``key`` and ``json``: an object a peptide and place, ``{"preds": [..]}``, with its predictions in input order (``ord``) where it is known, else in that of their contents.

    A prediction has all columns but the sample's name, as in the flat form.
    """
    fields = [c for c in COLUMNS if c != "sample_name"]
    one = F.struct(*(c for c in ("ord",) if c in df.columns), F.struct(*fields).alias("pred"))
    preds = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["pred"]).alias("preds")
    return df.groupBy(*key).agg(preds).select(*key, F.to_json(F.struct("preds"), {"ignoreNullFields": "false"}).alias("json"))


def from_nested_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Canonical rows, and ``ord``, their place in the list, from objects of :func:`to_nested_json`; ``sample_name`` is that of the row if it has one. Unknown keys are dropped."""
    kept = [c for c in ("sample_name",) if c in df.columns]
    each = df.select(*kept, F.posexplode(F.from_json(column, f"struct<preds: array<{PREDICTION.simpleString()}>>")["preds"]).alias("ord", "r"))
    return canonical(each.select(*kept, "ord", *(F.col(f"r.{c}") for c in COLUMNS if c not in kept)), keep=("ord",))


def four_digits(x: Column) -> Column:
    """A number as text with four significant digits, no zeros at the end, and an exponent under 1e-4 and from 1e4 on (``%.4g``).

    Formatting rounds halves up, so exact halves over an even digit are moved down by a little first.
    """
    y = x * F.pow(F.lit(10.0), 3 - F.get(F.split(F.format_string("%.16e", x), "e"), F.lit(1)).try_cast("int"))
    half = (F.abs(y) - F.floor(F.abs(y)) == 0.5) & (F.floor(x * 256) == x * 256) & (F.floor(F.abs(y)) % 2 == 0)
    x = F.when(half, x * (1 - 1e-13)).otherwise(x)
    parts = F.split(F.format_string("%.3e", x), "e")  # digits and exponent, rounded
    digits, power = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("int")
    trimmed = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    rounded = F.concat(digits, F.lit("e"), F.get(parts, F.lit(1))).try_cast("double")
    plain = F.lit(None).cast("string")
    for p in range(-4, 4):
        text = F.format_string(f"%.{3 - p}f", rounded)
        plain = F.when(power == p, trimmed(text) if p < 3 else text).otherwise(plain)
    scientific = F.concat(F.when(digits.contains("."), trimmed(digits)).otherwise(digits), F.lit("e"), F.get(parts, F.lit(1)))
    return F.when(x == 0, "0").when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.coalesce(plain, scientific))


def describe(df: DataFrame) -> DataFrame:
    """A short text a row, in ``text``: peptide, allele, kind, score, value, rank and predictor, those that there are."""
    some = lambda c, text: F.when(c, text)
    parts = F.concat_ws(
        " | ",
        some(F.col("peptide") != "", F.col("peptide")).otherwise("?"),
        some(F.col("allele") != "", F.col("allele")),
        "kind",
        F.concat(F.lit("score="), four_digits(F.col("score"))),
        some(F.col("value").isNotNull(), F.concat(F.lit("value="), four_digits(F.col("value")))),
        some(F.col("percentile_rank").isNotNull(), F.format_string("rank=%.2f%%", "percentile_rank")),
        some(F.col("predictor_name") != "", F.col("predictor_name")),
    )
    return df.select(F.concat(F.lit("Prediction("), parts, F.lit(")")).alias("text"))


def describe_peptides(df: DataFrame, key=("peptide", "offset", "source_sequence_name")) -> DataFrame:
    """The ``key`` and a short text of each peptide and place, in ``text``: how many predictions there are, and of which kinds.

    Kinds stand in the order in which they come first (``ord``) where that is known, else by name.
    """
    place = [F.min("ord").alias("first")] if "ord" in df.columns else []
    counts = df.groupBy(*key, "kind").agg(F.count("*").alias("n"), *place)
    one = F.struct(*(["first"] if place else []), "kind", "n")
    groups = counts.groupBy(*key).agg(F.sum("n").alias("n_preds"), F.sort_array(F.collect_list(one)).alias("kinds"))
    kinds = F.array_join(F.transform("kinds", lambda x: F.concat(x["n"].cast("string"), F.lit("\u00d7"), x["kind"])), ", ")
    peptide = F.when(F.col("peptide") == "", "?").otherwise(F.col("peptide"))
    text = F.concat(F.lit("PeptideResult("), peptide, F.lit(", "), F.col("n_preds").cast("string"), F.lit(" preds: "), kinds, F.lit(")"))
    return groups.select(*key, text.alias("text"))


def describe_legacy(df: DataFrame) -> DataFrame:
    """A text a row of the older view, in ``text``, with all its own fields; numbers have three decimals (halves are rounded up)."""
    number = lambda c: F.when(F.col(c).isNull(), "None").otherwise(F.format_string("%.3f", F.col(c).cast("double")))
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    parts = {
        "peptide": quoted("peptide"), "allele": quoted("allele"), "score": number("score"), "percentile_rank": number("percentile_rank"), "affinity": number("affinity"),
        "source_sequence_name": F.coalesce(quoted("source_sequence_name"), F.lit("None")), "offset": F.col("offset").cast("string"), "prediction_method_name": quoted("prediction_method_name"),
    }
    fields = F.concat_ws(", ", *(F.concat(F.lit(f"{name}="), text) for name, text in parts.items()))
    return df.select(F.concat(F.lit("BindingPrediction("), fields, F.lit(")")).alias("text"))
