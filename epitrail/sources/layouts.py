"""Where the columns are in the output of each tool."""

from __future__ import annotations

from dataclasses import dataclass, field

from epitrail.schema import Kind


@dataclass(frozen=True)
class Layout:
    """Token positions, from 0, after ``ignored`` tokens are taken out of a line; None: the tool has no such column."""

    key: int
    offset: int
    peptide: int
    allele: int
    score: int
    ic50: int | None
    rank: int | None
    one_based: bool
    ignored: dict[str, int] = field(default_factory=dict)
    stops_on_error: bool = False
    kind: str = Kind.AFFINITY


_WEAK = {"WB": 4, "SB": 4}


def _bind(first: int) -> dict[str, int]:
    """Marks of binders that stand between columns, or after the last, in class-II output."""
    return {"<=SB": first, "<=WB": first, "<=": first, "SB": first + 1, "WB": first + 1}


_EL = Kind.PRESENTATION

# The column positions are those of the tools' own output.
LAYOUTS = {
    "netmhc3": Layout(4, 0, 1, 5, 2, 3, None, False, _WEAK),
    "netmhc4": Layout(10, 0, 2, 1, 11, 12, 13, False),
    "netmhc41-ba": Layout(10, 0, 2, 1, 13, 15, 14, False),
    "netmhc41-el": Layout(10, 0, 2, 1, 11, None, 12, False, kind=_EL),
    "netmhcpan28": Layout(3, 0, 2, 1, 4, 5, 6, False, stops_on_error=True),
    "netmhcpan3": Layout(10, 0, 2, 1, 11, 12, 13, True),
    "netmhcpan4-ba": Layout(10, 0, 2, 1, 11, 12, 13, True),
    "netmhcpan4-el": Layout(10, 0, 2, 1, 11, None, 12, True, kind=_EL),
    "netmhcpan41-ba": Layout(10, 0, 2, 1, 13, 15, 14, True),
    "netmhcpan41-el": Layout(10, 0, 2, 1, 11, None, 12, True, kind=_EL),
    "netmhccons": Layout(3, 0, 2, 1, 4, 5, 6, False),
    "netmhciipan3": Layout(3, 0, 2, 1, 7, 8, 9, False, stops_on_error=True),
    "netmhciipan4-el": Layout(6, 0, 2, 1, 7, None, 8, True, _bind(13), True, _EL),
    "netmhciipan4-ba": Layout(6, 0, 2, 1, 10, 11, 12, True, _bind(13), True),
    "netmhciipan43-el": Layout(7, 0, 2, 1, 8, None, 9, True, _bind(14), True, _EL),
    "netmhciipan43-ba": Layout(7, 0, 2, 1, 11, 13, 12, True, _bind(14), True),
    "netmhcstabpan": Layout(3, 0, 2, 1, 5, None, 6, True, kind=Kind.STABILITY),
}
