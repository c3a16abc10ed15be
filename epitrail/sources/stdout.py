"""Rows from captured tool output, by DataFrame functions: one input row holds the whole output of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitrail.functions.alleles import normalize_allele
from epitrail.functions.scoring import rescued_ic50, score_from_affinity
from epitrail.operators.scan import carried
from epitrail.schema import Kind, canonical
from epitrail.sources.layouts import LAYOUTS, Layout


def number(token: Column) -> Column:
    """A double, or null for anything else (``NA``)."""
    return token.try_cast("double")


def guarded(text: Column, program: str) -> Column:
    """The text; an error with the rest of the line if the tool reports one."""
    line = F.regexp_extract(text, r"(?i)(ERROR[^\n]*)", 1)
    return F.when(text.isNull() | (line == ""), text).otherwise(F.raise_error(F.concat(F.lit(f"{program} failed: "), line)).cast("string"))


def data_lines(text: Column) -> Column:
    """Trimmed lines after the first line of dashes that start with an integer."""
    return with_lines(text, lines_of_data)


def with_lines(text: Column, f) -> Column:
    """``f`` of the trimmed lines of a text, which are made once."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    return F.get(F.transform(F.array(lines), f), F.lit(0))


def lines_of_data(lines: Column) -> Column:
    after = F.slice(lines, F.array_position(F.transform(lines, lambda x: x.startswith("---")), True).cast("int") + 1, F.size(lines))
    return F.when(F.exists(lines, lambda x: x.startswith("---")), F.filter(after, lambda x: x.rlike(r"^-?[0-9]+(\s|$)"))).otherwise(F.array().cast("array<string>"))


def tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def cleaned(fields: Column, ignored: dict[str, int]) -> Column:
    """Without the tokens that stand where they are to be ignored."""
    if not ignored:
        return fields
    drop = lambda x, i: _any((x == t) & (i == p) for t, p in ignored.items())
    return F.filter(fields, lambda x, i: ~drop(x, i))


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def parse_layout(df: DataFrame, layout: str | Layout, predictor_name: str = "", predictor_version: str = "", text: str = "text", legacy_kind: bool = False) -> DataFrame:
    """Canonical rows, and ``ord``, of output in a known layout.

    ``df`` has the output in ``text``; every other column is dropped. An invalid IC50 beside a finite score is
    computed from it. ``legacy_kind`` calls every row an affinity. For ``netmhciipan43`` output without an
    ``Inverted`` column the positions of version 4 hold.
    """
    if isinstance(layout, str):
        if layout not in LAYOUTS:
            raise ValueError(f"Unknown layout {layout!r}")
        if layout.startswith("netmhciipan43"):
            old = LAYOUTS[layout.replace("43", "4")]
            new = LAYOUTS[layout]
            inverted = F.col(text).contains(" Inverted ")
            return _layout(df.where(inverted), new, predictor_name, predictor_version, text, legacy_kind).unionByName(
                _layout(df.where(~inverted), old, predictor_name, predictor_version, text, legacy_kind)
            )
        layout = LAYOUTS[layout]
    return _layout(df, layout, predictor_name, predictor_version, text, legacy_kind)


def _layout(df: DataFrame, at: Layout, name: str, version: str, text: str, legacy_kind: bool) -> DataFrame:
    whole = guarded(F.col(text), name or "The tool") if at.stops_on_error else F.col(text)
    lines = df.select(data_lines(whole).alias("lines")).select(F.posexplode("lines").alias("ord", "line"))
    return _layout_rows(lines, at, name, version, legacy_kind, ("ord",))


def _layout_rows(lines: DataFrame, at: Layout, name: str, version: str, legacy_kind: bool, keep: tuple[str, ...]) -> DataFrame:
    """Canonical rows of lines of data, ``line``; the columns ``keep`` stay."""
    fields = lines.select(*keep, cleaned(tokens(F.col("line")), at.ignored).alias("f"))
    get = lambda i: F.get("f", F.lit(i))
    score = number(get(at.score))
    ic50 = F.lit(None).cast("double") if at.ic50 is None else rescued_ic50(number(get(at.ic50)), score)
    rows = fields.select(
        *keep,
        get(at.peptide).alias("peptide"),
        normalize_allele(get(at.allele)).alias("allele"),
        get(at.key).alias("source_sequence_name"),
        (get(at.offset).cast("int") - int(at.one_based)).alias("offset"),
        score.alias("score"),
        ic50.alias("value"),
        (F.lit(None).cast("double") if at.rank is None else number(get(at.rank))).alias("percentile_rank"),
    )
    kind = Kind.AFFINITY if legacy_kind else at.kind
    return canonical(rows, keep=keep, kind=kind, predictor_name=name, predictor_version=version)


def header(text: Column) -> Column:
    """Tokens of the line after a line of dashes that names the columns."""
    is_header = lambda lines: lambda x, i: (i > 0) & F.get(lines, i - 1).startswith("---") & x.rlike(r"(?i)(^|\s)pos(\s|$)") & x.rlike(r"(?i)(^|\s)(hla|mhc)(\s|$)")
    return tokens(with_lines(text, lambda lines: F.get(F.filter(lines, is_header(lines)), F.lit(0))))


#: What the columns of NetMHCpan output may be called, by what they hold.
FIELDS = {
    "position": ("Pos", "pos"),
    "peptide": ("Peptide", "peptide"),
    "allele": ("HLA", "MHC"),
    "identity": ("Identity",),
    "score_el": ("Score_EL",),
    "rank_el": ("%Rank_EL",),
    "score_ba": ("Score_BA",),
    "rank_ba": ("%Rank_BA",),
    "ic50": ("Aff(nM)",),
    "old_score": ("1-log50k(aff)",),
    "old_ic50": ("Affinity(nM)",),
    "score": ("Score",),
    "rank": ("%Rank",),
    "core": ("Core",),
}


def parse_by_header(df: DataFrame, predictor_name: str = "netMHCpan", predictor_version: str = "", text: str = "text", names: DataFrame | None = None, prefer: str | None = None) -> DataFrame:
    """Canonical rows, and ``ord``, of NetMHCpan output from 2.8 to 4.2; the header tells which columns there are.

    With scores for elution and binding a line gives two rows, an affinity and a presentation; with ``prefer``, a kind, it gives the
    row of that kind, or the first. Offsets are from 1 where there is a ``Core`` column. Numbers that are none are an error.
    ``names``: ``key, name`` to rename identities by.
    """
    raw = df.select(guarded(F.col(text), "NetMHCpan").alias("t"))
    # the places of the columns are found once an output; a line only reads them
    found = raw.select(header(F.col("t")).alias("head"), F.regexp_extract("t", r"# NetMHCpan version (\S+)", 1).alias("found"), data_lines(F.col("t")).alias("lines"))
    once = found.select("head", "found", "lines", places_of(F.col("head")).alias("at")).select("found", "at", checked_lines(F.col("head"), F.col("at"), F.col("lines")).alias("lines"))
    each = once.select("found", "at", F.posexplode("lines").alias("pos", "line"))
    made = _header_rows(each.withColumn("base", 2 * F.col("pos")), predictor_name, predictor_version, prefer, ("ord",))
    if names is None:
        return made
    from epitrail.operators.combine import remap

    return remap(made, names)


def places_of(head: Column) -> Column:
    """Where the columns are that a header names, and how lines are read (``form``): 0 elution and binding, 1 elution, 2 version 2.8, 3 binding, 4 elution without its own names."""
    place = lambda options: F.coalesce(*(F.nullif(F.array_position(head, n).cast("int"), F.lit(0)) for n in options)) - 1
    some = lambda what: place(FIELDS[what]).isNotNull()
    form = F.when(some("score_el") & some("score_ba"), 0).when(some("score_el"), 1).when(some("old_score"), 2).when(some("score") & some("ic50"), 3).when(some("score"), 4)
    return F.struct(*(place(options).alias(what) for what, options in FIELDS.items()), form.alias("form"))


def checked_lines(head: Column, at: Column, lines: Column) -> Column:
    """``lines``; an error if there is no header, or it lacks a column."""
    wrong = lambda what: F.raise_error(F.lit(what)).cast("array<string>")
    checked = F.when(head.isNull(), wrong("Could not find the header line in NetMHCpan output"))
    for what in ("position", "peptide", "allele", "identity"):
        checked = checked.when(at[what].isNull(), wrong(f"No {what} column in NetMHCpan output"))
    return checked.when(at["form"].isNull(), wrong("Could not tell the score columns of NetMHCpan output")).otherwise(lines)


def _header_rows(lines: DataFrame, predictor_name: str, predictor_version: str, prefer: str | None, keep: tuple[str, ...]) -> DataFrame:
    """Canonical rows of lines of data: ``line, at, found`` (the version) and ``base``, twice the line's number, from which ``ord`` is made."""
    each = lines.withColumn("f", tokens(F.col("line")))
    some = lambda what: F.col(f"at.{what}").isNotNull()
    token = lambda what: F.get("f", F.col(f"at.{what}"))
    value = lambda what: token(what).cast("double")
    none = F.lit(None).cast("double")
    row = lambda kind, score, ic50, rank: F.struct(F.lit(kind).alias("kind"), score.alias("score"), ic50.alias("value"), rank.alias("percentile_rank"))
    zero = F.lit(0.0)
    bound = lambda ic50, score, rank: row(Kind.AFFINITY, score_from_affinity(value(ic50), value(score)), value(ic50), value(rank))
    eluted = lambda score, rank: row(Kind.PRESENTATION, F.coalesce(value(score), zero), none, rank)
    two = [bound("ic50", "score_ba", "rank_ba"), eluted("score_el", value("rank_el"))]
    if prefer is not None:
        two = two[1:] if prefer == Kind.PRESENTATION else two[:1]
    form = F.col("at.form")
    rows = (
        F.when(form == 0, F.array(*two))
        .when(form == 1, F.array(eluted("score_el", F.coalesce(value("rank_el"), value("rank")))))
        .when(form == 2, F.array(bound("old_ic50", "old_score", "rank")))
        .when(form == 3, F.array(bound("ic50", "score", "rank")))
        .otherwise(F.array(eluted("score", value("rank"))))
    )
    wide = each.select(
        *(k for k in keep if k != "ord"),
        "base",
        token("peptide").alias("peptide"),
        normalize_allele(token("allele")).alias("allele"),
        token("identity").alias("source_sequence_name"),
        (token("position").cast("int") - F.when(some("core"), 1).otherwise(0)).alias("offset"),
        (F.lit(predictor_version) if predictor_version else F.col("found")).alias("predictor_version"),
        F.posexplode(rows).alias("nth", "r"),
    )
    out = wide.select("*", "r.*").withColumn("ord", F.col("base") + F.col("nth"))
    return canonical(out, keep=keep, predictor_name=predictor_name)


# ------------------------------------------------------------------------------------------- output of any size, by lines


def output_lines(lines: DataFrame, program: str, stops_on_error: bool, marks: dict[str, Column]) -> DataFrame:
    """``file, ord, line`` of the lines of data of captured output, and of each line what ``marks`` have come to there.

    ``lines``: as :func:`epitrail.operators.scan.read_lines` gives them. A file may hold the output of several runs, and be of any size: it is read by splits. Lines of data stand
    after the first line of dashes and begin with an integer; ``ord`` numbers a file's lines. ``marks`` read ``line``, trimmed, and ``above``, the line before it.
    A line with which a tool reports an error is one, if ``stops_on_error``.
    """
    trimmed = F.trim(F.regexp_replace("line", r"[\t\r]", " "))
    if stops_on_error:
        trimmed = guarded(trimmed, program)
    clean = lines.select("file", "block", "n", trimmed.alias("line"))
    beside = carried(clean, {}, {"ord": F.lit(1).cast("long")}, {"above": F.col("line")})
    dashed = {"_dashed": F.when(F.col("line").startswith("---"), True)}
    seen = carried(beside, dashed | marks)
    return seen.where("_dashed AND line RLIKE '^-?[0-9]+( |$)'").select("file", "ord", "line", *marks)


def parse_layout_lines(lines: DataFrame, layout: str, predictor_name: str = "", predictor_version: str = "", legacy_kind: bool = False) -> DataFrame:
    """Canonical rows, ``file`` and ``ord``, of captured output in a known layout, read by lines: see :func:`output_lines` and :func:`parse_layout`."""
    if layout not in LAYOUTS:
        raise ValueError(f"Unknown layout {layout!r}")
    at, keep = LAYOUTS[layout], ("file", "ord")
    options = (predictor_name, predictor_version, legacy_kind, keep)
    program = predictor_name or "The tool"
    if not layout.startswith("netmhciipan43"):
        return _layout_rows(output_lines(lines, program, at.stops_on_error, {}), at, *options)
    # each header tells whether the lines below it have the column
    titled = F.col("above").startswith("---") & F.col("line").rlike(r"(?i)(^|\s)pos(\s|$)")
    found = output_lines(lines, program, at.stops_on_error, {"inverted": F.when(titled, F.concat(F.lit(" "), "line", F.lit(" ")).contains(" Inverted "))})
    old = LAYOUTS[layout.replace("43", "4")]
    return _layout_rows(found.where("inverted"), at, *options).unionByName(_layout_rows(found.where("NOT coalesce(inverted, FALSE)"), old, *options))


def parse_header_lines(lines: DataFrame, predictor_name: str = "netMHCpan", predictor_version: str = "", prefer: str | None = None) -> DataFrame:
    """Canonical rows, ``file`` and ``ord``, of captured NetMHCpan output, read by lines: see :func:`output_lines` and :func:`parse_by_header`.

    A line is read by the last header above it, so that runs of several versions may follow each other in a file.
    """
    named = F.col("above").startswith("---") & F.col("line").rlike(r"(?i)(^|\s)pos(\s|$)") & F.col("line").rlike(r"(?i)(^|\s)(hla|mhc)(\s|$)")
    head = tokens(F.col("line"))
    version = F.nullif(F.regexp_extract("line", r"# NetMHCpan version (\S+)", 1), F.lit(""))
    found = output_lines(lines, "NetMHCpan", True, {"at": F.when(named, places_of(head)), "found": version})
    line = F.get(checked_lines(F.col("at"), F.col("at"), F.array("line")), F.lit(0))
    each = found.select("file", "at", F.coalesce("found", F.lit("")).alias("found"), line.alias("line"), (2 * F.col("ord")).alias("base"))
    return _header_rows(each, predictor_name, predictor_version, prefer, ("file", "ord"))


def prefer_kind(rows: DataFrame, kind: str) -> DataFrame:
    """One row a peptide, allele and place: of the preferred kind, else the first."""
    from pyspark.sql import Window

    key = Window.partitionBy("peptide", "allele", "offset", "source_sequence_name").orderBy(F.col("kind") != kind, "ord")
    return rows.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def detect_version(text: Column) -> Column:
    """The format of NetMHCpan output, by its columns."""
    head = header(text)
    has = lambda n: F.array_contains(head, n)
    return (
        F.when(has("Score_EL") | has("Score_BA"), "4.1")
        .when(has("1-log50k(aff)"), "2.8")
        .when(has("Score") & ~has("Aff(nM)"), "4.0 EL")
        .when(has("Score"), F.when(text.rlike("# NetMHCpan version 4"), "4.0 BA").otherwise("3.0"))
    )


def parse_netchop(df: DataFrame, text: str = "text") -> DataFrame:
    """``seq_ord, probs``: the profile of each sequence of netChop output, plus the other columns of ``df``.

    A header without dashes below it, a short line, or a score that is no number is an error.
    """
    named = lambda x: x.contains("pos") & x.contains("AA") & x.contains("score")
    heads = lambda ls: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: named(F.get(ls, i)))
    rest = [c for c in df.columns if c != text]
    both = with_lines(F.col(text), lambda ls: F.struct(ls.alias("ls"), heads(ls).alias("h"))).alias("_b")
    each = df.select(*rest, both).select(*rest, "_b", F.posexplode("_b.h").alias("seq_ord", "_i")).select(*rest, "seq_ord", "_i", F.col("_b.ls").alias("_ls"))
    dashed = F.when(F.get("_ls", F.col("_i") + 1).contains("----"), F.col("_ls")).otherwise(F.raise_error(F.lit("Expected dashes after the netChop header")).cast("array<string>"))
    body = each.select(*rest, "seq_ord", F.slice(dashed, F.col("_i") + 3, F.size("_ls")).alias("_b"))
    end = F.array_position(F.transform("_b", lambda x: x.contains("-------")), True).cast("int")
    rows = body.withColumn("_b", F.when(end > 0, F.slice("_b", F.lit(1), end - 1)).otherwise(F.col("_b")))
    score = lambda x: F.coalesce(
        F.when(F.size(tokens(x)) >= 4, F.get(tokens(x), F.lit(3)).try_cast("double")),
        F.raise_error(F.concat(F.lit("Unexpected netChop output line: "), x)).cast("double"),
    )
    return rows.select(*rest, "seq_ord", F.transform("_b", score).alias("probs"))


def parse_iedb(df: DataFrame, predictor_name: str, kind: str = Kind.AFFINITY, text: str = "text", source: str | None = None) -> DataFrame:
    """Canonical rows, and ``ord``, of responses: a header line and lines of values, separated by white space.

    ``start`` is from 1. A response without rows, or without allele, peptide, ic50, start and end, is an error; a rank
    may be missing. ``source``: a column beside the text that names the sequence.
    """
    name = F.col(source) if source else F.lit(None).cast("string")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    held = df.select(name.alias("source_sequence_name"), lines.alias("ls"))
    empty = F.raise_error(F.lit("No predictions in the response")).cast("array<string>")
    held = held.withColumn("ls", F.when(F.size("ls") > 1, F.col("ls")).otherwise(empty))
    spaced = F.replace(F.get("ls", F.lit(0)), F.lit("percentile rank"), F.lit("percentile_rank"))
    each = held.select("source_sequence_name", tokens(spaced).alias("head"), F.posexplode(F.slice("ls", 2, F.size("ls"))).alias("ord", "line")).withColumn("f", tokens(F.col("line")))

    def at(name: str, needed: bool = True) -> Column:
        place = F.array_position("head", name).cast("int")
        missing = F.raise_error(F.lit(f"The response has no column {name}")).cast("string") if needed else F.lit(None).cast("string")
        return F.when(place > 0, F.get("f", place - 1)).otherwise(missing)

    ic50 = at("ic50").cast("double")
    rank = F.coalesce(at("percentile_rank", False), at("rank", False)).try_cast("double")
    rows = each.select(
        "ord", "source_sequence_name", at("peptide").alias("peptide"), normalize_allele(at("allele"), infer_pair=False).alias("allele"),
        (at("start").cast("int") - 1).alias("offset"), F.when(at("end").isNotNull(), ic50).alias("value"),
        score_from_affinity(ic50, F.lit(None).cast("double")).alias("score"), rank.alias("percentile_rank"),
    )
    return canonical(rows, keep=("ord",), kind=kind, predictor_name=predictor_name)
