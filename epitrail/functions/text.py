"""Small conversions of text arguments."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_int_list(text: str) -> list[int]:
    """``"8 9 10,11-13"`` as a list; ranges include both ends."""
    out: list[int] = []
    for part in re.split(r"[,\s]+", text.strip()):
        if part:
            low, _, high = part.partition("-")
            out += range(int(low), int(high or low) + 1)
    return out


def int_list(text: Column) -> Column:
    """The same as an expression: an array of integers."""
    parts = F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")
    low = lambda x: F.element_at(F.split(x, "-"), 1).cast("int")
    high = lambda x: F.element_at(F.split(x, "-"), -1).cast("int")
    return F.flatten(F.transform(parts, lambda x: F.sequence(low(x), high(x))))


def joined(values: Column, separator: str = ",") -> Column:
    return F.array_join(values.cast("array<string>"), separator)


def parse_version(text: Column) -> Column:
    """``"4.2c"`` as the array [4, 2]; null if there is no version."""
    major, minor = (F.regexp_extract(text, r"([0-9]+)\.([0-9]+)", i) for i in (1, 2))
    return F.when(major != "", F.array(major.cast("int"), minor.cast("int")))


def models_path(path: str | None) -> str | None:
    """An absolute path without links; None stays."""
    return None if path is None else os.path.realpath(os.path.expanduser(path))
