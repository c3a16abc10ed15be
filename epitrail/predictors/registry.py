"""Predictors by name, as the command line knows them."""

from __future__ import annotations

import re
from collections.abc import Callable

from epitrail.predictors import base, models, processing, tools, web


def _tool(name: str) -> Callable:
    return lambda spark, **kw: tools.ToolPredictor(spark, tool=name, **kw)


def _detected(program: str, flags: list[str], which: Callable[[str], str], modes: str = "") -> Callable:
    """The program's own output tells which tool it is."""

    def make(spark, **kw):
        path = kw.get("program") or program
        stem = which(tools.run_program([path, *flags], check=False))
        return tools.ToolPredictor(spark, tool=next(t for t in (stem, f"{stem}-{modes}") if t in tools.TOOLS), **kw)

    return make


def _web(name: str) -> Callable:
    return lambda spark, **kw: web.IedbPredictor(spark, method=name, **kw)


# The names users give.
REGISTRY: dict[str, Callable] = {
    "netmhc": _detected("netMHC", ["-h"], tools.netmhc_version),
    "netmhc3": _tool("netmhc3"),
    "netmhc4": _tool("netmhc4"),
    "netmhcpan": _detected("netMHCpan", ["--version", "/dev/null"], tools.netmhcpan_version, "ba"),
    "netmhcpan28": _tool("netmhcpan28"),
    "netmhcpan3": _tool("netmhcpan3"),
    "netmhcpan4": _tool("netmhcpan4-ba"),
    "netmhcpan4-ba": _tool("netmhcpan4-ba"),
    "netmhcpan4-el": _tool("netmhcpan4-el"),
    "netmhcpan41": _tool("netmhcpan41-ba"),
    "netmhcpan41-ba": _tool("netmhcpan41-ba"),
    "netmhcpan41-el": _tool("netmhcpan41-el"),
    "netmhcpan42": _tool("netmhcpan42-ba"),
    "netmhcpan42-ba": _tool("netmhcpan42-ba"),
    "netmhcpan42-el": _tool("netmhcpan42-el"),
    "netmhciipan": _detected("netMHCIIpan", ["-h"], tools.netmhciipan_version, "el"),
    "netmhciipan3": _tool("netmhciipan3"),
    "netmhciipan4": _tool("netmhciipan4-el"),
    "netmhciipan4-ba": _tool("netmhciipan4-ba"),
    "netmhciipan4-el": _tool("netmhciipan4-el"),
    "netmhciipan43": _tool("netmhciipan43-el"),
    "netmhciipan43-ba": _tool("netmhciipan43-ba"),
    "netmhciipan43-el": _tool("netmhciipan43-el"),
    "netmhccons": _tool("netmhccons"),
    "netmhcstabpan": _tool("netmhcstabpan"),
    "mixmhcpred": tools.MixMHCpred,
    "mhcflurry": models.MHCflurry,
    "mhcflurry-affinity": models.MHCflurryAffinity,
    "bigmhc": models.BigMHC,
    "bigmhc-el": models.BigMHC,
    "bigmhc-im": lambda spark, **kw: models.BigMHC(spark, mode="im", **kw),
    "netchop": lambda spark, **kw: processing.NetChop(spark, **kw),
    "pepsickle": lambda spark, **kw: processing.pepsickle(spark, **kw),
    "random": base.RandomPredictor,
    "netmhcpan-iedb": _web("netmhcpan-iedb"),
    "netmhccons-iedb": _web("netmhccons-iedb"),
    "smm-iedb": _web("smm-iedb"),
    "smm-pmbec-iedb": _web("smm-pmbec-iedb"),
    "netmhciipan-iedb": _web("netmhciipan-iedb"),
}

#: Names whose predictors need no alleles.
ALLELE_FREE = {"netchop", "pepsickle"}
#: Options that only some predictors take.
ACCEPTS = {"program": lambda n: n in ALLELE_FREE - {"pepsickle"} or n.startswith(("netmhc", "mixmhc")) and not n.endswith("-iedb"), "models": lambda n: n.startswith("mhcflurry"), "strict": lambda n: n.endswith("-iedb")}


def parse_names(text: str | list[str]) -> list[str]:
    """Names separated by commas or spaces, in any case; unknown ones are an error."""
    parts = [p for t in ([text] if isinstance(text, str) else text) for p in re.split(r"[,\s]+", t.lower()) if p]
    unknown = [p for p in parts if p not in REGISTRY]
    if unknown or not parts:
        raise ValueError(f"Unknown predictor {', '.join(unknown) or 'name'}; there are {', '.join(sorted(REGISTRY))}")
    return parts


def make(spark, name: str, alleles=None, lengths=None, **options):
    """The predictor of a name; options that it does not take are left out."""
    (name,) = parse_names(name)
    kept = {k: v for k, v in options.items() if v is not None and (k not in ACCEPTS or ACCEPTS[k](name))}
    if name not in ALLELE_FREE:
        if not alleles and name != "random":
            raise ValueError(f"{name} needs alleles")
        if alleles:
            kept["alleles"] = alleles
    if lengths:
        kept["default_lengths"] = lengths
    return REGISTRY[name](spark, **kept)
