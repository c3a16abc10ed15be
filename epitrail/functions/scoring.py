"""Scores as Column expressions: cleavage scoring modes, affinity conversions, profile windows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: The concentration, in nM, that gets score 0.
MAX_IC50 = 50_000.0


def internal(profile: Column, offset: Column, length: Column) -> Column:
    """Cleavage after each residue of the window but its last."""
    return F.slice(profile, offset + 1, length - 1)


def c_term(profile: Column, offset: Column, length: Column) -> Column:
    """Cleavage after the window."""
    return F.get(profile, offset + length - 1)


def n_term(profile: Column, offset: Column) -> Column:
    """Cleavage before the window; null at the start of a sequence."""
    return F.get(profile, offset - 1)


def max_internal(inner) -> Column:
    """Of an array, or of a window that has tables of its own (:class:`epitrail.operators.windows.Internal`)."""
    if not isinstance(inner, Column):
        return inner.max()
    return F.coalesce(F.array_max(inner), F.lit(0.0))


def mean_internal(inner) -> Column:
    """As :func:`max_internal`."""
    if not isinstance(inner, Column):
        return inner.mean()
    total = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(inner) > 0, total / F.size(inner)).otherwise(0.0)


def geometric_mean(*values: Column) -> Column:
    """Of the values that are not null."""
    logs = [F.coalesce(v, F.lit(1.0)) for v in values]
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    product = logs[0]
    for v in logs[1:]:
        product = product * v
    return F.pow(product, F.lit(1.0) / n)


Mode = Callable[[Column, Column, Column], Column]

#: Scoring modes by name: (c, n, inner) -> score; ``inner`` as for :func:`max_internal`.
MODES: dict[str, Mode] = {
    "cterm": lambda c, n, inner: c,
    "nterm_cterm": lambda c, n, inner: geometric_mean(c, n),
    "cterm_max_internal": lambda c, n, inner: c * (1 - max_internal(inner)),
    "cterm_mean_internal": lambda c, n, inner: c * (1 - mean_internal(inner)),
    "nterm_cterm_max_internal": lambda c, n, inner: geometric_mean(c, 1 - max_internal(inner), n),
    "nterm_cterm_mean_internal": lambda c, n, inner: geometric_mean(c, 1 - mean_internal(inner), n),
}


#: What a mode wants of the inside of a window; user functions want the numbers themselves.
TABLES = {"cterm": (), "nterm_cterm": ()} | {f"{n}cterm_{what}_internal": (table,) for n in ("", "nterm_") for what, table in (("max", "max"), ("mean", "sum"))}


@dataclass(frozen=True)
class OwnMode:
    """A user's mode, and what it wants of the inside of a window; see :func:`by_columns` and :func:`by_batches`."""

    mode: Mode
    tables: tuple[str, ...] = ()
    #: Scores of all windows of a block at once: (profile, place of the first, number of windows, their length) -> array.
    blocks: Callable[[Column, Column, Column, Column], Column] | None = None


def by_columns(f: Mode) -> OwnMode:
    """A mode from a function (c, n, inner) of Columns, which stays in generated code; ``inner`` is read by :func:`max_internal` and :func:`mean_internal` alone."""
    return OwnMode(f, ("max", "sum"))


#: Cells of a matrix that a mode of batches is given at most.
CELLS = 1 << 20


def by_batches(f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> OwnMode:
    """A mode from a function of whole batches: numbers c and n of each window, and a matrix with the cells inside, a row a window.

    NaN stands for what there is not: n at the start of a sequence, cells of shorter windows. Windows of sequences come to Python in blocks, as the block's part of the profile.
    """
    def run(c: pd.Series, n: pd.Series, inner: pd.Series) -> pd.Series:
        sizes = inner.map(len).to_numpy(dtype=int)
        cells = np.full((len(sizes), sizes.max(initial=0)), np.nan)
        if sizes.any():
            cells[np.arange(cells.shape[1])[None, :] < sizes[:, None]] = np.concatenate(inner.to_numpy())
        return pd.Series(np.asarray(f(c.to_numpy(dtype=float), n.to_numpy(dtype=float), cells), dtype=float))

    return OwnMode(F.pandas_udf(run, DoubleType()), blocks=_of_blocks(f))


def _of_blocks(f):
    """:attr:`OwnMode.blocks` of a function of batches: cells are read where they stand in the Arrow batch."""
    def run(profile: pa.Array, place: pa.Array, many: pa.Array, length: pa.Array) -> pa.Array:
        cells = np.append(profile.flatten().to_numpy(zero_copy_only=False).astype(float), np.nan)
        many, length = many.to_numpy().astype(np.int64), length.to_numpy().astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(profile), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        bounds = np.concatenate([[0], np.cumsum(many)])
        first = np.repeat(ends - sizes, many)  # of the window's block
        at = first + np.repeat(place.to_numpy().astype(np.int64), many) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], many)
        k, end = np.repeat(length, many), np.repeat(ends, many)
        out = np.empty(bounds[-1])
        step = max(1, CELLS // max(1, length.max(initial=1)))

        def cell(i, low, high):
            return cells[np.where((i >= low) & (i < high), i, len(cells) - 1)]

        for a in range(0, len(at), step):
            w = slice(a, a + step)
            i = at[w][:, None] + np.arange(k[w].max() - 1)
            inner = cell(i, 0, np.minimum(end[w], at[w] + k[w] - 1)[:, None])
            out[w] = f(cell(at[w] + k[w] - 1, 0, end[w]), cell(at[w] - 1, first[w], end[w]), inner)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, from_pandas=True))

    def blocks(profile: Column, place: Column, many: Column, length: Column) -> Column:
        return F.arrow_udf(run, ArrayType(DoubleType()))(profile, place, many, length)

    return blocks


def user_mode(f: Callable[[float, float | None, list[float]], float]) -> Mode:
    """A mode from a Python function of one window's numbers, called once a window; :func:`by_batches` and :func:`by_columns` are the fast forms."""
    def each(c: pd.Series, n: pd.Series, inner: pd.Series) -> pd.Series:
        return pd.Series([float(f(x, None if y is None or y != y else y, list(z))) for x, y, z in zip(c, n, inner)], dtype="float64")

    return F.pandas_udf(each, "double")


def resolve_mode(scoring: str | Callable | OwnMode | None, default: str) -> Mode:
    """A name, an :class:`OwnMode`, a Python function (c, n, inner) -> float, or None for the default."""
    scoring = default if scoring is None else scoring
    if isinstance(scoring, OwnMode):
        return scoring.mode
    if isinstance(scoring, str):
        if scoring not in MODES:
            raise ValueError(f"Unknown scoring mode {scoring!r}; there are {', '.join(sorted(MODES))}")
        return MODES[scoring]
    if callable(scoring):
        return user_mode(scoring)
    raise TypeError(f"scoring must be a name or a function, not {type(scoring).__name__}")


def valid_ic50(x: Column) -> Column:
    """Neither null, NaN nor infinite, and at least 0."""
    return x.isNotNull() & ~F.isnan(x) & (x < float("inf")) & (x >= 0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def log50k(ic50: Column) -> Column:
    """1 - log(ic50) / log(50000), unclamped; infinite for 0."""
    return F.when(ic50 == 0, float("inf")).otherwise(1 - F.ln(ic50) / math.log(MAX_IC50))


def score_from_affinity(ic50: Column, raw: Column) -> Column:
    """From a valid IC50, else the finite raw score, else 0."""
    return F.when(valid_ic50(ic50), log50k(ic50)).when(finite(raw), raw).otherwise(0.0)


def clamped_score(ic50: Column) -> Column:
    """Between 0 and 1, for models that give no score of their own."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.ln(F.greatest(ic50, F.lit(1e-6))) / math.log(MAX_IC50)))


def missing_score(score: Column, ic50: Column) -> Column:
    """The score, or where it is missing the one that the affinity gives."""
    return F.coalesce(score, log50k(ic50))


def affinity_from_score(score: Column) -> Column:
    return F.pow(F.lit(MAX_IC50), 1 - score)


def rescued_ic50(ic50: Column, score: Column) -> Column:
    """The IC50, or where it is not valid and the score is finite, the one that the score gives."""
    return F.when(valid_ic50(ic50), ic50).when(finite(score), affinity_from_score(score)).otherwise(ic50)
