"""Fixed values of residues. They must be as they are for right results."""

#: Enumeration order of the twenty residues.
ALPHABET = "GAVLIPFYWSTCMNQDEKRH"

#: Kyte-Doolittle hydropathy.
KYTE_DOOLITTLE = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

#: Hopp-Woods hydrophilicity.
HOPP_WOODS = {
    "A": -0.5, "R": 3.0, "N": 0.2, "D": 3.0, "C": -1.0, "Q": 0.2, "E": 3.0, "G": 0.0, "H": -0.5, "I": -1.8,
    "L": -1.8, "K": 3.0, "M": -1.3, "F": -2.5, "P": 0.0, "S": 0.3, "T": -0.4, "W": -3.4, "Y": -2.3, "V": -1.5,
}

#: pKa of the chain ends and of side chains that lose (acid) or take (base) a proton.
N_TERMINAL, C_TERMINAL = 9.0, 2.0
ACID = {"D": 3.9, "E": 4.1, "C": 8.3, "Y": 10.1}
BASE = {"H": 6.0, "K": 10.5, "R": 12.5}

#: Table charge in tenths; other residues have none.
TABLE_CHARGE = {"R": 10, "K": 10, "D": -10, "E": -10, "H": 1}

#: Four-residue motifs by weight.
MOTIFS = {
    1: ("LLLR", "LLRL", "LLRR", "LRLL", "LRLR", "LRRL", "LRRR", "RLLR", "RLRL", "RLRR", "RRLL", "RRLR", "RRVV"),
    2: ("RRVR", "RVRR", "RVRV", "RVVR", "VRRR", "VRRV", "VRVR", "VRVV", "VVRR", "VVRV", "VVVR"),
}
