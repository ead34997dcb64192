"""Residue names, letters, labels and atom order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.hashing import col

# Fixed values. Residue name, letter, and the residue whose atom order it uses.
RESIDUE_TABLE = """
ALA A ALA
CYS C CYS
ASP D ASP
GLU E GLU
PHE F PHE
GLY G GLY
HIS H HIS
ILE I ILE
LYS K LYS
LEU L LEU
MET M MET
ASN N ASN
PRO P PRO
GLN Q GLN
ARG R ARG
SER S SER
THR T THR
VAL V VAL
TRP W TRP
TYR Y TYR
MSE 0 MET
FME 1 MET
SEP 2 SER
TPO 3 THR
HIC 4 HIS
MVA 5 VAL
AIB 6 ALA
UNK X GLY
"""

# Fixed values. Atoms of each residue in slot order; the first four are the backbone.
ATOM_TABLE = """
ALA N CA C O CB
CYS N CA C O CB SG
ASP N CA C O CB CG OD1 OD2
GLU N CA C O CB CG CD OE1 OE2
PHE N CA C O CB CG CD1 CD2 CE1 CE2 CZ
GLY N CA C O
HIS N CA C O CB CG CD2 ND1 CE1 NE2
ILE N CA C O CB CG1 CG2 CD1
LYS N CA C O CB CG CD CE NZ
LEU N CA C O CB CG CD1 CD2
MET N CA C O CB CG SD CE
ASN N CA C O CB CG ND2 OD1
PRO N CA C O CB CG CD
GLN N CA C O CB CG CD NE2 OE1
ARG N CA C O CB CG CD NE CZ NH1 NH2
SER N CA C O CB OG
THR N CA C O CB CG2 OG1
VAL N CA C O CB CG1 CG2
TRP N CA C O CB CG CD1 CD2 CE2 CE3 NE1 CZ2 CZ3 CH2
TYR N CA C O CB CG CD1 CD2 CE1 CE2 CZ OH
"""

# Fixed values. Labels 0-19 are the canonical letters, 20-26 the modified
# residues, 27 is unknown and 28 the mask token.
LETTERS = "ACDEFGHIKLMNPQRSTVWY0123456X"
CANONICAL = 20
UNKNOWN = 27
MASK = 28
MASK_TOKEN = "<mask>"
SLOTS = 14

RESIDUES = [tuple(line.split()) for line in RESIDUE_TABLE.split("\n") if line]
ATOMS = {name: atoms for name, *atoms in (line.split() for line in ATOM_TABLE.split("\n") if line)}


def _lookup(pairs, key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, key)


def residue_letter(name) -> Column:
    """Three-letter residue name to letter; null when the name is not known."""
    return _lookup([(n, one) for n, one, _ in RESIDUES], col(name))


def residue_parent(name) -> Column:
    """The canonical residue whose atom order a residue uses."""
    return _lookup([(n, parent) for n, _, parent in RESIDUES], col(name))


def is_known_residue(name) -> Column:
    return col(name).isin(*[n for n, _, _ in RESIDUES])


def atom_slot(name, atom) -> Column:
    """Slot 0-13 of an atom in its residue; null when the residue has no such atom."""
    slots = [
        (f"{n} {a}", i) for n, _, parent in RESIDUES for i, a in enumerate(ATOMS[parent])
    ]
    return _lookup(slots, F.concat_ws(" ", col(name), col(atom)))


def letter_label(letter) -> Column:
    """Letter to label; anything outside the alphabet is unknown."""
    c = col(letter)
    at = F.instr(F.lit(LETTERS), c)
    known = (F.length(c) == 1) & (at > 0)
    return (
        F.when(known, at - 1).when(c == MASK_TOKEN, F.lit(MASK)).otherwise(F.lit(UNKNOWN)).cast("int")
    )


def label_letter(label) -> Column:
    """Label to letter; anything outside the label range is ``X``."""
    c = col(label)
    return (
        F.when(c.between(0, UNKNOWN), F.substring(F.lit(LETTERS), c.cast("int") + 1, F.lit(1)))
        .when(c == MASK, F.lit(MASK_TOKEN))
        .otherwise(F.lit("X"))
    )


def label_name(label) -> Column:
    """Label as a metric name: the letter without angle brackets."""
    return F.translate(label_letter(label), "<>", "")


def label_names(n: int) -> list[str]:
    """The names of labels 0..n-1, for use on the driver."""
    names = list(LETTERS) + [MASK_TOKEN.strip("<>")]
    return [names[i] if i < len(names) else "X" for i in range(n)]


def sequence_labels(sequence) -> Column:
    """A sequence as an array of labels."""
    return F.transform(F.split(col(sequence), ""), letter_label)


def label_rows(df: DataFrame, sequence: str, *keep) -> DataFrame:
    """One row per residue: the kept columns, ``pos`` from 0, and ``label``."""
    return (
        df.filter(F.length(sequence) > 0)
        .select(*keep, F.posexplode(F.split(F.col(sequence), "")).alias("pos", "letter"))
        .withColumn("label", letter_label("letter"))
        .drop("letter")
    )


def residue_table(spark: SparkSession) -> DataFrame:
    """The residue lookup as a table of 28 rows, for users who prefer a join."""
    return spark.createDataFrame(RESIDUES, "resname string, letter string, parent string")


def atom_table(spark: SparkSession) -> DataFrame:
    """One row per (residue, slot): 20 residues with at most 14 atoms each."""
    rows = [(r, i, a) for r, atoms in ATOMS.items() for i, a in enumerate(atoms)]
    return spark.createDataFrame(rows, "parent string, slot int, atom string")
