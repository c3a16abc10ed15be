"""Sliding k-mer windows over sequences, with their flanks."""

from __future__ import annotations

import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sequences(spark: SparkSession, given: dict[str, str] | str | Iterable[str]) -> DataFrame:
    """``name, seq``: a mapping by name, one string named ``seq``, or strings that are their own names (each once)."""
    if isinstance(given, str):
        rows = [("seq", given)]
    elif isinstance(given, dict):
        rows = list(given.items())
    else:
        rows = list(dict.fromkeys((s, s) for s in given))
    return spark.createDataFrame(rows, "name string, seq string")


def peptides(spark: SparkSession, given: str | Iterable[str]) -> DataFrame:
    """``peptide, ord`` in the order given; one string is one peptide."""
    given = [given] if isinstance(given, str) else list(given)
    return spark.createDataFrame([(p, i) for i, p in enumerate(given)], "peptide string, ord long")


def peptide_lengths(lengths, default, least: int | None = None, most: int | None = None) -> list[int]:
    """Checked lengths: one or several integers, or the default for None."""
    lengths = default if lengths is None else lengths
    lengths = [lengths] if isinstance(lengths, int) else list(lengths)
    if not lengths:
        raise ValueError("Peptide lengths are needed")
    for n in lengths:
        if n < max(1, least or 1):
            raise ValueError(f"Peptide length {n} is under the least, {max(1, least or 1)}")
        if most is not None and n > most:
            raise ValueError(f"Peptide length {n} is over the most, {most}")
    return lengths


#: Sequences are cut into blocks of so many windows first: cutting a window costs the distance from its block's start.
BLOCK = 64


#: Residues inside a window up to which it is read cell by cell, in generated code; longer ones read the tables of :func:`running`. Making a table is a
#: call a cell, which costs as much as reading some hundred cells to find a maximum, or some ten to add them up.
DIRECT = {"max": 256, "sum": 32}


class Internal:
    """What the profile says of the inside of a window: all its residues but the last.

    ``lengths``: the lengths of all windows. Inside short windows cells are read one by one. A longer window of w residues inside reads the maximum as two cells of a
    table of running maxima, and the sum as a cell for each binary digit of w; the tables are made once a block of windows. No function is called for a cell of a window.
    """

    def __init__(self, along: str, lengths: Iterable[int], length: Column, place: Column):
        self.along, self.lengths, self.length, self.place = along, sorted(set(lengths)), length, place
        self.most = self.lengths[-1] - 1

    def _by_length(self, f) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for k in self.lengths:
            out = out.when(self.length == k, f(k - 1) if k > 1 else F.lit(0.0))
        return out

    def _cell(self, what: str, level: int, at: int) -> Column:
        return F.get(table_name(self.along, what, level), self.place + at)

    def max(self) -> Column:
        """0 if there is nothing inside."""
        if self.most <= DIRECT["max"]:
            return F.coalesce(F.array_max(self.values()), F.lit(0.0))

        def of(w: int) -> Column:
            level = w.bit_length() - 1
            first = self._cell("max", level, 0)
            return F.coalesce(first if w == 1 << level else F.greatest(first, self._cell("max", level, w - (1 << level))), F.lit(0.0))

        return self._by_length(of)

    def mean(self) -> Column:
        """0 if there is nothing inside."""
        if self.most <= DIRECT["sum"]:
            total = F.lit(0.0)
            for i in range(self.most):  # a window of any length reads as many as it has
                cell = self._cell("sum", 0, i)
                total = total + (cell if i < self.lengths[0] - 1 else F.when(self.length - 1 > i, cell).otherwise(0.0))
            return F.when(self.length > 1, total / (self.length - 1)).otherwise(0.0)

        def of(w: int) -> Column:
            total, at = None, 0
            for level in range(w.bit_length()):
                if w >> level & 1:
                    cell = self._cell("sum", level, at)
                    total, at = cell if total is None else total + cell, at + (1 << level)
            return total / w

        return self._by_length(of)

    def values(self) -> Column:
        return F.slice(self.along, self.place + 1, self.length - 1)


def table_name(along: str, what: str, level: int) -> str:
    return f"_{along}_{what}_{level}" if level else along


def running(blocks: DataFrame, along: str, what: str, most: int) -> DataFrame:
    """``blocks`` with tables over the array ``along``: element i of table j is the max or sum of the 2^j elements from i on.

    Each table comes from the one before it, up to the largest that a window with ``most`` residues inside reads.
    """
    join = F.greatest if what == "max" else operator.add

    def table(below: str, step: int) -> Column:
        return F.transform(below, lambda x, i: join(x, F.get(below, i + step)))

    for level in range(1, most.bit_length()):
        cells = table(table_name(along, what, level - 1), 1 << (level - 1))
        blocks = blocks.withColumn(table_name(along, what, level), cells)
    return blocks


def kmers(seqs: DataFrame, lengths: Iterable[int], flank_length: int = 0, along: str | None = None, tables: Iterable[str] = (), scored=None) -> DataFrame:
    """Every window of the given lengths, with all columns of ``seqs`` but ``seq`` kept.

    Adds ``peptide, offset`` (from 0), and with a flank length ``n_flank, c_flank``. Sequences shorter than a length, or
    null, have no window of it. Windows are cut row by row: nothing is shuffled. A window costs the same wherever it stands: blocks are cut from bytes
    of one width a letter (a byte if all letters are ASCII, else four), so the time grows with the length of a sequence and not with its square.

    ``along``: a column with an array, an element a residue. A window gets its block's part of it alone, and with it ``_k``, its
    length, and ``_place``, where in that part it starts; the residue before a window is in it too. ``tables`` (``max``, ``sum``): tables of
    :func:`running` beside the part, made once a block, which :class:`Internal` reads where windows are long. ``scored``: a function of the part, the place of the first window in it,
    the number of windows and their length that gives an array, an element a window; windows then have their element as ``score``, in place of the columns above.
    """
    lengths = peptide_lengths(lengths, None)
    tables = sorted({t for t in tables if max(lengths) - 1 > DIRECT[t]})
    kept = [c for c in seqs.columns if c not in ("seq", along)]
    f = flank_length
    held = _blocks(seqs, lengths, f, along)
    for what in tables:
        held = running(held, along, what, max(lengths) - 1)
    if scored:
        held = held.withColumn("_scores", scored(F.col(along), F.col("_before"), F.col("_last") - F.col("_b") + 1, F.col("_k"))).drop(along)
    at = held.select("*", F.explode(F.sequence(F.col("_b"), F.col("_last"))).alias("offset"))
    place = F.col("offset") - F.col("_b") + F.col("_before")  # in the block, from 0
    columns = [_letters(place, F.col("_k")).alias("peptide"), F.col("offset")]
    made = [table_name(along, what, level) for what in tables for level in range(1, (max(lengths) - 1).bit_length())]
    more = [along, *made, "_k", place.alias("_place")] if along else []
    if scored:
        more = [F.get("_scores", F.col("offset") - F.col("_b")).alias("score")]
    return at.select(*kept, *columns, *(flanks(f, place) if f else []), *more)


def kmer_blocks(seqs: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """The windows of :func:`kmers` in blocks: ``k, start, peptides``, up to ``BLOCK`` windows of one length from offset ``start`` on, with all columns of ``seqs`` but ``seq``.

    What is summed up over windows can be summed up in a block first, and then over rows that are ``BLOCK`` times fewer.
    """
    held = _blocks(seqs, peptide_lengths(lengths, None), 0, None)
    cut = F.transform(F.sequence(F.lit(0), F.col("_last") - F.col("_b")), lambda place: _letters(place, F.col("_k")))
    return held.select(*(c for c in seqs.columns if c != "seq"), F.col("_k").alias("k"), F.col("_b").alias("start"), cut.alias("peptides"))


def _blocks(seqs: DataFrame, lengths: list[int], f: int, along: str | None) -> DataFrame:
    """Blocks of windows from ``_b`` to ``_last`` with their letters, flanks of ``f`` letters and part of ``along``; the first window is at place ``_before``."""
    kept = [c for c in seqs.columns if c not in ("seq", along)]
    k = F.explode(F.array(*map(F.lit, lengths)))
    ascii_only = F.octet_length("seq") == F.length("seq")
    wide = F.when(ascii_only, F.col("seq").cast("binary")).otherwise(F.encode("seq", "UTF-32"))
    sized = seqs.select(*kept, *([along] if along else []), F.length("seq").alias("_n"), wide.alias("_wide"), F.when(ascii_only, 1).otherwise(4).alias("_u"))
    fits = sized.select("*", k.alias("_k")).where(F.col("_n") >= F.col("_k"))
    blocks = fits.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("_k"), F.lit(BLOCK))))
    before = F.least(F.col("_b"), F.lit(max(f, 1) if along else f))
    first, size = F.col("_b") - before, before + BLOCK + F.col("_k") - 1 + f
    cut = F.substring("_wide", first * F.col("_u") + 1, size * F.col("_u"))
    # a block of ASCII stays bytes, of which a window is copied without looking at what stands before it
    letters = [F.when(F.col("_u") == 1, cut).alias("_bytes"), F.when(F.col("_u") != 1, F.decode(cut, "UTF-32")).alias("seq")]
    parts = [*letters, *([F.slice(along, first + 1, size).alias(along)] if along else [])]
    last = F.least(F.col("_b") + BLOCK - 1, F.col("_n") - F.col("_k"))
    return blocks.select(*kept, "_k", "_b", last.alias("_last"), *parts, before.alias("_before"))


def window_counts(seqs: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """``name, k, n``: how many windows of each length a sequence has, counted without cutting any."""
    k = F.explode(F.array(*map(F.lit, peptide_lengths(lengths, None))))
    return seqs.select("name", F.length("seq").alias("_n"), k.alias("k")).where(F.col("_n") >= F.col("k")).select("name", "k", (F.col("_n") - F.col("k") + 1).cast("long").alias("n"))


def _letters(place: Column, size) -> Column:
    """Letters of a block from ``place`` on, counted from 0."""
    return F.when(F.col("seq").isNull(), F.substring("_bytes", place + 1, size).cast("string")).otherwise(F.substring("seq", place + 1, size))


def flanks(length: int, place: Column) -> list:
    """``n_flank, c_flank`` of the window at ``place`` in its block."""
    before = _letters(F.greatest(place - length, F.lit(0)), F.least(place, F.lit(length)))
    after = _letters(place + F.col("_k"), F.lit(length))
    return [before.alias("n_flank"), after.alias("c_flank")]


def distinct_peptides(windows: DataFrame) -> DataFrame:
    return windows.select("peptide").distinct()
