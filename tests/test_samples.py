"""Lines as the tools print them, written out here, for layouts whose registered queries make their own output."""

import pytest

from epitrail.sources.stdout import parse_layout

DASHES = "-" * 60
HEAD2 = "  Pos  MHC  Peptide  Of  Core  Core_Rel  Identity  Score_EL  %Rank_EL  Exp_Bind  Score_BA  Affinity(nM)  %Rank_BA  BindLevel"

#: layout: header, lines, and (offset, peptide, allele, source, score, value, rank) of each.
SAMPLES = {
    "netmhc4": (
        "  pos          HLA      peptide         Core Offset  I_pos  I_len  D_pos  D_len        iCore        Identity 1-log50k(aff) Affinity(nM)    %Rank  BindLevel",
        ["    0    HLA-A0201    GLMKWYTRV    GLMKWYTRV      0      0      0      0      0    GLMKWYTRV            seqX         0.612        66.51     0.90 <= WB", "    1    HLA-A0201    LMKWYTRVN    LMKWYTRVN      0      0      0      0      0    LMKWYTRVN            seqX         0.061           NA    42.00"],
        [(0, "GLMKWYTRV", "HLA-A*02:01", "seqX", 0.612, 66.51, 0.9), (1, "LMKWYTRVN", "HLA-A*02:01", "seqX", 0.061, 50000 ** (1 - 0.061), 42.0)],
    ),
    "netmhcpan4-ba": (
        "  Pos          HLA         Peptide       Core Of Gp Gl Ip Il        Icore        Identity     Score   Aff(nM)   %Rank  BindLevel",
        ["    3  HLA-B*07:02        RPHERNGFV  RPHERNGFV  0  0  0  0  0    RPHERNGFV         PEPLIST 0.7035120      24.7    0.1245 <= SB"],
        [(2, "RPHERNGFV", "HLA-B*07:02", "PEPLIST", 0.703512, 24.7, 0.1245)],
    ),
    "netmhcpan4-el": (
        "  Pos          HLA         Peptide       Core Of Gp Gl Ip Il        Icore        Identity     Score   %Rank  BindLevel",
        ["    1  HLA-B*07:02        RPHERNGFV  RPHERNGFV  0  0  0  0  0    RPHERNGFV         PEPLIST 0.8123450    0.0456 <= SB"],
        [(0, "RPHERNGFV", "HLA-B*07:02", "PEPLIST", 0.812345, None, 0.0456)],
    ),
    "netmhccons": (
        "  pos       Allele      peptide        Identity 1-log50k(aff) Affinity(nM)    %Rank  BindLevel",
        ["    4   HLA-A24:02    TYQWVLNRF        protein2         0.588        86.40     0.40     <= SB"],
        [(4, "TYQWVLNRF", "HLA-A*24:02", "protein2", 0.588, 86.4, 0.4)],
    ),
    "netmhciipan3": (
        "  Seq         Allele              Peptide    Identity  Pos      Core  Core_Rel  1-log50k(aff)  Affinity(nM)  %Rank  Exp_Bind  BindingLevel",
        ["    7      DRB1_1501      VNRKLWDETQAGHPS     fragment    4 LWDETQAGH     0.715          0.4021        645.20  22.50     9.999"],
        [(7, "VNRKLWDETQAGHPS", "HLA-DRA1*01:01-DRB1*15:01", "fragment", 0.4021, 645.2, 22.5)],
    ),
    "netmhciipan4-el": (
        HEAD2,
        [
            "    1      DRB1_0401      VNRKLWDETQAGHPS    4    LWDETQAGH     0.980        fragment      0.713420      1.85      NA      0.452110        375.33     14.20   <=WB",
            "    2      DRB1_0401      NRKLWDETQAGHPSW    3    LWDETQAGH     0.940        fragment      0.113420     11.85      NA      0.352110       1107.33     34.20       ",
        ],
        [(0, "VNRKLWDETQAGHPS", "HLA-DRA1*01:01-DRB1*04:01", "fragment", 0.71342, None, 1.85), (1, "NRKLWDETQAGHPSW", "HLA-DRA1*01:01-DRB1*04:01", "fragment", 0.11342, None, 11.85)],
    ),
    "netmhciipan4-ba": (
        HEAD2,
        ["    9  HLA-DQA10501-DQB10201      VNRKLWDETQAGHPS    4    LWDETQAGH     0.980        fragment      0.913420      0.35      NA      0.652110         43.12      0.80   <= SB"],
        [(8, "VNRKLWDETQAGHPS", "HLA-DQA1*05:01-DQB1*02:01", "fragment", 0.65211, 43.12, 0.8)],
    ),
    "netmhcstabpan": (
        "  pos          HLA      peptide        Identity      Pred  Thalf(h) %Rank_Stab BindLevel",
        ["    2  HLA-A*02:01    GLMKWYTRV         PEPLIST     0.733      2.23       1.20 <= WB"],
        [(1, "GLMKWYTRV", "HLA-A*02:01", "PEPLIST", 2.23, None, 1.2)],
    ),
}


@pytest.mark.parametrize("layout", SAMPLES)
def test_printed_lines(spark, layout):
    head, lines, want = SAMPLES[layout]
    text = "\n".join(["# a comment", "", DASHES, head, DASHES, *lines, DASHES, "", "Number of high binders 0", ""])
    rows = parse_layout(spark.createDataFrame([(text,)], "text string"), layout, layout).orderBy("ord").collect()
    got = [(r.offset, r.peptide, r.allele, r.source_sequence_name, r.score, r.value, r.percentile_rank) for r in rows]
    assert [g[:5] + g[6:] for g in got] == [w[:5] + w[6:] for w in want]
    assert [g[5] for g in got] == [None if w[5] is None else pytest.approx(w[5]) for w in want]
