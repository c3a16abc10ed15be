"""MHC allele names as Column expressions: normal form, and the spellings that tools want."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitrail.functions.nomenclature import SEROTYPES, SPECIES, alternatives

#: Human genes, longer names first where one starts another.
GENES = "DRA1|DRA|DRB[1-9]|DQA1|DQA2|DQB1|DQB2|DPA1|DPA2|DPB1|DPB2|DMA|DMB|DOA|DOB|MICA|MICB|TAP1|TAP2|HFE|A|B|C|E|F|G"
_COLON = rf"^({GENES})\*?([0-9]{{1,3}}):([0-9]{{2,3}})(:[0-9]+)*$"
_PLAIN = rf"^({GENES})\*?([0-9]{{4,}})$"
_ONE = rf"^({GENES})\*([0-9]{{1,3}})$"
_SEROTYPE = rf"^({GENES})([0-9]{{1,2}})$"


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spelled(raw: Column) -> Column:
    return F.replace(F.replace(F.upper(F.trim(raw)), F.lit(";"), F.lit("/")), F.lit("_"), F.lit("*"))


def _family(x: Column) -> Column:
    return F.when(F.length(x) == 1, F.concat(F.lit("0"), x)).when(x.rlike("^0[0-9]{2}$"), F.substring(x, 2, 2)).otherwise(x)


def _code(x: Column) -> Column:
    return F.when(F.length(x) == 0, F.lit("01")).when(x.rlike("^0[0-9]{2}$"), F.substring(x, 2, 2)).otherwise(x)


def _gene(x: Column) -> Column:
    return F.when(x == "DRA", "DRA1").otherwise(x)


def _human(part: Column) -> Column:
    """One chain without its species: ``gene*family:code``, or null."""
    name = lambda p, i: F.regexp_extract(part, p, i)
    digits = name(_PLAIN, 2)
    # without a colon two digits are the family, but three of the five of a DPB1
    wide = (F.length(digits) == 5) & (name(_PLAIN, 1) == "DPB1")
    family = F.when(wide, F.substring(digits, 1, 3)).otherwise(F.substring(digits, 1, 2))
    code = F.when(wide, F.substring(digits, 4, 2)).when(F.length(digits) == 5, F.substring(digits, 3, 3)).otherwise(F.substring(digits, 3, 2))
    join = lambda g, f, c: F.concat(_gene(g), F.lit("*"), _family(f), F.lit(":"), _code(c))
    return (
        F.when(part.rlike(_COLON), join(name(_COLON, 1), name(_COLON, 2), name(_COLON, 3)))
        .when(part.rlike(_PLAIN), join(name(_PLAIN, 1), family, code))
        .when(part.rlike(_ONE), F.concat(_gene(name(_ONE, 1)), name(_ONE, 2)))
        .when(part.rlike(_SEROTYPE), join(name(_SEROTYPE, 1), name(_SEROTYPE, 2), F.lit("01")))
    )


_PREFIX = rf"^({alternatives(SPECIES)})-?(.+)$"
_ANIMAL_GENES = alternatives(g for genes in SPECIES.values() for g in genes)
_ANIMAL_COLON = rf"^({_ANIMAL_GENES})[*:-]?([0-9]{{1,3}}):([0-9]{{2,3}})(:[0-9]+)*$"
_ANIMAL_PLAIN = rf"^({_ANIMAL_GENES})[*:-]?([0-9]{{2,3}})([0-9]{{2}}|[0-9]{{3}})$"
_ANIMAL_ONE = rf"^({_ANIMAL_GENES})[*:-]?([0-9]{{1,3}}|[A-Z]{{2,8}}[0-9]{{0,2}})$"


def _map_of(pairs) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def _animal(s: Column) -> Column:
    """The normal form of a name with another species' prefix, pairs of chains too, or null. A gene must be one of its species."""
    species = F.regexp_extract(s, _PREFIX, 1)
    genes = F.element_at(F.create_map(*(x for name, own in SPECIES.items() for x in (F.lit(name.upper()), F.array(*map(F.lit, own))))), species)

    def chain(part: Column) -> Column:
        get = lambda p, i: F.regexp_extract(part, p, i)
        joined = lambda p: F.concat(get(p, 1), F.lit("*"), _family(get(p, 2)), F.lit(":"), _code(get(p, 3)))
        # without a colon the last two digits are the code, or the last three of six
        gene = F.coalesce(*(F.nullif(get(p, 1), F.lit("")) for p in (_ANIMAL_COLON, _ANIMAL_PLAIN, _ANIMAL_ONE)))
        named = F.when(part.rlike(_ANIMAL_COLON), joined(_ANIMAL_COLON)).when(part.rlike(_ANIMAL_PLAIN), joined(_ANIMAL_PLAIN)).when(part.rlike(_ANIMAL_ONE), F.concat(gene, get(_ANIMAL_ONE, 2)))
        return F.when(F.array_contains(genes, gene), named)

    parts = F.split(F.regexp_replace(F.regexp_extract(s, _PREFIX, 2), rf"([/-])({alternatives(SPECIES)})-", "$1"), "/|-(?=D)")
    chains = F.transform(parts, chain)
    whole = F.when(F.size(chains) <= 2, F.array_join(F.when(~F.exists(chains, lambda c: c.isNull()), chains), "-"))
    return F.concat(F.element_at(_map_of((n.upper(), n) for n in SPECIES), species), F.lit("-"), whole)


def normalize_allele(raw: Column, omit_dra1: bool = False, infer_pair: bool = True, strict: bool = False) -> Column:
    """The normal form of an allele name, e.g. ``HLA-A*02:01``, ``HLA-DRA1*01:01-DRB1*15:01``, ``H-2-Kb``, ``H-2-IAb``.

    Takes pairs joined by ``/``, ``;`` or ``-``, ``_`` for ``*``, names without separators, and serotypes (``A2``, ``DR4``, ``Cw7``: the allele that
    stands for it, alone). Names of other species (``BoLA-1*023:01``, ``Mamu-A1*001:01``) are those of :mod:`epitrail.functions.nomenclature`. A
    DRB chain alone gets the usual alpha chain if ``infer_pair``; ``omit_dra1`` leaves that chain out. Names with
    trailing annotations, like everything else that is not understood, give null, or an error if ``strict``.
    """
    def named(s: Column) -> Column:
        locus = F.regexp_replace(s, r"^H-?2-?", "")
        one = r"^(I[AE]|[KDLQTM])-?\*?([A-Z][A-Z0-9]*)$"
        pair = r"^(A|E)A\*?([A-Z][A-Z0-9]*)[/-](?:H-?2-?)?(A|E)B\*?([A-Z][A-Z0-9]*)$"
        ex = lambda p, i: F.regexp_extract(locus, p, i)
        same = (ex(pair, 1) == ex(pair, 3)) & (ex(pair, 2) == ex(pair, 4))
        murine = F.when(locus.rlike(one), F.concat(F.lit("H-2-"), ex(one, 1), F.lower(ex(one, 2)))).when(
            locus.rlike(pair) & same, F.concat(F.lit("H-2-I"), ex(pair, 1), F.lower(ex(pair, 2)))
        )
        chains = F.transform(F.split(F.regexp_replace(s, r"HLA-?", ""), "[/-]"), _human)
        serotype = F.element_at(_map_of(SEROTYPES.items()), F.regexp_replace(s, r"^HLA-?", ""))
        human_name = F.coalesce(F.concat(F.lit("HLA-"), serotype), let(chains, human))
        return F.when(s.rlike(r"^H-?2-?."), murine).when(s.rlike(_PREFIX), _animal(s)).otherwise(human_name)

    def human(chains: Column) -> Column:
        alpha, beta, default = F.get(chains, F.lit(0)), F.get(chains, F.lit(1)), F.lit("DRA1*01:01")
        lone = alpha.startswith("DRB") & F.lit(infer_pair and not omit_dra1)
        single = F.when(lone, F.concat(default, F.lit("-"), alpha)).otherwise(alpha)
        both = F.when(F.lit(omit_dra1) & (alpha == default), beta).otherwise(F.concat(alpha, F.lit("-"), beta))
        return F.concat(F.lit("HLA-"), F.when(F.size(chains) == 1, single).when(F.size(chains) == 2, both))

    out = let(_spelled(raw), named)
    if strict:
        out = F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(
            F.coalesce(out, F.raise_error(F.concat(F.lit("Could not parse MHC allele '"), raw, F.lit("'"))).cast("string"))
        )
    return out


def with_normal_names(df: DataFrame, column: str, into: str = "allele", **options) -> DataFrame:
    """``df`` with the normal forms of a column of names: each distinct name is read once, and joined back."""
    names = df.select(F.col(column).alias("_raw")).distinct().withColumn(into, normalize_allele(F.col("_raw"), **options))
    return df.join(names, F.col(column).eqNullSafe(F.col("_raw")), "left").drop("_raw")


def split_alleles(text: Column) -> Column:
    """Names separated by commas or white space, as an array without empty ones."""
    return F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")


def distinct_alleles(df: DataFrame, column: str = "allele", **options) -> DataFrame:
    """``allele`` in normal form, each once, with ``allele_ord``: the order of first mention in ``ord`` if there is one."""
    order = F.col("ord") if "ord" in df.columns else F.lit(0)
    named = df.select(normalize_allele(F.col(column), **options).alias("allele"), order.alias("ord"))
    return named.where("allele IS NOT NULL").groupBy("allele").agg(F.min("ord").alias("allele_ord"))


def allele_parts(allele: Column) -> Column:
    """species, gene, family, code of each chain of a normal form."""
    chain = r"([A-Z0-9.]+)\*([0-9]+):([0-9]+)"
    species = F.regexp_extract(allele, "^([A-Za-z]+)-", 1)
    human = F.transform(
        F.split(F.regexp_replace(allele, "^[A-Za-z]+-", ""), "-"),
        lambda p: F.struct(
            species.alias("species"), F.regexp_extract(p, chain, 1).alias("gene"),
            F.regexp_extract(p, chain, 2).alias("allele_family"), F.regexp_extract(p, chain, 3).alias("allele_code"),
        ),
    )
    rest = F.regexp_replace(allele, "^H-2-", "")
    mouse = F.array(
        F.struct(F.lit("H-2").alias("species"), F.regexp_extract(rest, "^(I?[A-Z])", 1).alias("gene"), F.lit("").alias("allele_family"), F.regexp_extract(rest, "^I?[A-Z](.*)$", 1).alias("allele_code"))
    )
    return F.when(allele.startswith("H-2-"), mouse).otherwise(human)


def without(allele: Column, marks: str) -> Column:
    return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit("")), marks, allele)


def render_allele(allele: Column, style: str = "plain") -> Column:
    """A normal form as tools spell it.

    ``plain``: without ``*``; ``compact``: without ``*`` and ``:``; ``class2``: ``DRB1_0101``,
    ``HLA-DQA10501-DQB10636``, ``H-2-IAb``.
    """
    if style == "plain":
        return without(allele, "*")
    if style == "compact":
        return without(allele, "*:")
    if style != "class2":
        raise ValueError(f"Unknown style {style!r}")
    drb = F.regexp_extract(allele, r"(DRB[0-9])\*([0-9]+):([0-9]+)$", 0)
    return (
        F.when(allele.startswith("H-2-"), allele)
        .when(drb != "", F.replace(F.replace(drb, F.lit("*"), F.lit("_")), F.lit(":"), F.lit("")))
        .when(allele.contains("-D"), without(allele, "*:"))
        .otherwise(F.raise_error(F.concat(F.lit("Unexpected allele "), allele)).cast("string"))
    )
