"""What allele names are made of, as data: species with their genes, and the alleles that stand for serotypes.

Fixed values of the public nomenclature (IPD-MHC for animals, WHO serotypes for HLA). The expressions of :mod:`epitrail.functions.alleles` are compiled from
these tables; a species or a serotype is added here alone.
"""

from __future__ import annotations

_PRIMATE = "A A1 A2 A3 A4 A5 A6 A7 A8 AG B B1 B2 B3 C E F G I DRA DRB1 DRB3 DRB4 DRB5 DRB6 DRBW DQA1 DQB1 DPA1 DPB1 DMA DMB DOA DOB".split()

#: Prefix as it is written: genes. Prefixes and genes are read in any case.
SPECIES = {
    "Patr": _PRIMATE,  # chimpanzee
    "Papa": _PRIMATE,  # bonobo
    "Gogo": _PRIMATE,  # gorilla
    "Popy": _PRIMATE,  # orangutan
    "Mamu": _PRIMATE,  # rhesus macaque
    "Mafa": _PRIMATE,  # crab-eating macaque
    "Mane": _PRIMATE,  # pig-tailed macaque
    "BoLA": "1 2 3 4 5 6 T2A T2B T2C NC1 NC2 NC3 NC4 DRA DRB1 DRB2 DRB3 DQA DQA1 DQB DQB1 D18.4 HD6 AW10 JSP.1".split(),  # cattle
    "SLA": "1 2 3 6 7 8 DRA DRB1 DQA DQB1 DMA DMB DOA DOB".split(),  # pig
    "DLA": "88 12 64 79 88L DRA DRB1 DQA1 DQB1".split(),  # dog
    "FLA": "A C E F H J K O DRA DRB".split(),  # cat
    "Eqca": "1 2 3 4 5 6 7 16 DRA DRB1 DRB2 DRB3 DQA DQB".split(),  # horse
    "Ovar": "N DRA DRB1 DQA1 DQA2 DQB1 DQB2".split(),  # sheep
    "Gaga": "BF1 BF2 BLB1 BLB2".split(),  # chicken
}

#: Serotypes whose names do not begin with their gene and digits, by the allele that stands for each. ``A2`` and the like need no row: A*02:01.
SEROTYPES = {
    "CW1": "C*01:02",
    "CW2": "C*02:02",
    "CW3": "C*03:03",
    "CW4": "C*04:01",
    "CW5": "C*05:01",
    "CW6": "C*06:02",
    "CW7": "C*07:01",
    "CW8": "C*08:01",
    "CW9": "C*03:03",
    "CW10": "C*03:04",
    "DR1": "DRB1*01:01",
    "DR2": "DRB1*15:01",
    "DR3": "DRB1*03:01",
    "DR4": "DRB1*04:01",
    "DR5": "DRB1*11:01",
    "DR6": "DRB1*13:01",
    "DR7": "DRB1*07:01",
    "DR8": "DRB1*08:01",
    "DR9": "DRB1*09:01",
    "DR10": "DRB1*10:01",
    "DR11": "DRB1*11:01",
    "DR12": "DRB1*12:01",
    "DR13": "DRB1*13:01",
    "DR14": "DRB1*14:01",
    "DR15": "DRB1*15:01",
    "DR16": "DRB1*16:01",
    "DR17": "DRB1*03:01",
    "DR18": "DRB1*03:02",
    "DR51": "DRB5*01:01",
    "DR52": "DRB3*01:01",
    "DR53": "DRB4*01:01",
    "DQ2": "DQB1*02:01",
    "DQ4": "DQB1*04:01",
    "DQ5": "DQB1*05:01",
    "DQ6": "DQB1*06:01",
    "DQ7": "DQB1*03:01",
    "DQ8": "DQB1*03:02",
    "DQ9": "DQB1*03:03",
    "DPW1": "DPB1*01:01",
    "DPW2": "DPB1*02:01",
    "DPW3": "DPB1*03:01",
    "DPW4": "DPB1*04:01",
    "DPW5": "DPB1*05:01",
    "DPW6": "DPB1*06:01",
}


def alternatives(names) -> str:
    """A regular expression for one of the names, longer ones first where one starts another."""
    import re

    return "|".join(re.escape(n.upper()) for n in sorted(set(names), key=lambda n: (-len(n), n)))
