from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from conftest import CHAIN, position, sequence, spelled
from curata.operators import curate as C
from curata.plans import curate as P
from curata.sources import mmcif

LONG, OTHER, TINY = sequence(1, 12), sequence(2, 7), sequence(3, 3)
END = len(CHAIN)


def placed(seed):
    """A rigid placement without rotation as 16 numbers, from a seed; 0 stays where it is."""
    numbers = [float(i % 5 == 0) for i in range(16)]
    for axis in range(3):
        numbers[4 * axis + 3] = random.Random(f"{seed}/{axis}").randint(-40, 40) / 2 if seed else 0.0
    return numbers


def files(spark, *texts, refined=False):
    rows = [(f"f{i}", t, refined) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, content string, is_refined boolean")


def chains(spark, *texts, refined=False, **cfg):
    config = P.CurateConfig(**cfg)
    return P.build_chains(P.accept(files(spark, *texts, refined=refined), config), config)


@pytest.mark.parametrize(
    "text, kept",
    [
        (dict(), True),
        (dict(method="NEUTRON DIFFRACTION"), False),
        (dict(method="SOLUTION NMR; X-RAY DIFFRACTION"), True),
        (dict(method="ELECTRON MICROSCOPY"), True),
        (dict(resolution=5.0), False),
        (dict(resolution=None), False),
        (dict(chains=[("A", TINY)]), False),
    ],
)
def test_gates(spark, cif, text, kept):
    assert chains(spark, cif(**text)).isEmpty() != kept


def test_refined_files_need_no_method(spark, cif):
    assert chains(spark, cif(method="NEUTRON DIFFRACTION"), refined=True).count() == 1
    assert chains(spark, cif(method=None), refined=True).count() == 1
    assert chains(spark, cif(method=None)).isEmpty()


def test_short_limits_are_refused():
    with pytest.raises(ValueError):
        P.CurateConfig(min_chain_length=3)


def test_arrays(spark, cif):
    row = chains(spark, cif(chains=[("H", LONG)])).first()
    assert (row.chain, row.sequence) == ("H", LONG)
    for number, letter in enumerate(LONG, 1):
        present = len(spelled()[letter][1])
        coords, mask = row.coords[number - 1], row.atom_mask[number - 1]
        assert coords == [position(number, k) for k in range(present)] + [[0.0] * 3] * (14 - present)
        assert mask == [True] * present + [False] * (14 - present)
        assert row.bfactor[number - 1] == [25.5] * present + [0.0] * (14 - present)
        assert row.occupancy[number - 1] == [1.0] * present + [0.0] * (14 - present)


def test_several_chains_and_files(spark, cif):
    given = {"4qrs": {"H": LONG, "L": OTHER}, "6tuv": {"A": CHAIN, "Z": TINY}}
    got = chains(spark, *[cif(pdb=pdb, chains=list(own.items())) for pdb, own in given.items()])
    assert {(r.pdb, r.chain, r.sequence) for r in got.collect()} == {
        (pdb, chain, letters) for pdb, own in given.items() for chain, letters in own.items() if len(letters) > 3
    }


def atom(number, name, residue, place, occupancy=1.0, model=1, group="HETATM", at=1.0):
    """A line of the atom loop in chain A; ``place`` is the residue number as it stands in the file."""
    return f"{group} {number} {name[0]} {name} . {residue} A 1 {place} {at} {at} {at} {occupancy:.2f} 30.00 {END + 1} A {model}"


def test_modified_and_unknown_residues(spark, cif):
    extra = [
        atom(999, "O", "HOH", END + 1), atom(998, "SE", "MSE", END + 2), atom(997, "N", "ALA", END + 3, model=2),
        atom(996, "O", "ALA", "?"),
    ]
    assert chains(spark, cif(extra_atoms=extra)).first().sequence == CHAIN + "0"


def test_first_of_equal_occupancies_wins(spark):
    rows = [("CA", 0.5, 1), ("CA", 0.9, 2), ("CA", 0.9, 3), ("N", 1.0, 4)]
    atoms = spark.createDataFrame(
        [("p", "A", 1, "ALA", a, o, i) for a, o, i in rows],
        "pdb string, chain string, seq_id int, resname string, atom string, occ double, atom_no int",
    )
    assert {r.atom: r.atom_no for r in C.best_atoms(atoms).collect()} == {"CA": 2, "N": 4}
    pair = [("ALA", 0.3, 1), ("ALA", 0.3, 2), ("GLY", 0.9, 3), ("GLY", 0.8, 4), ("SER", 0.85, 5)]
    residues = spark.createDataFrame(
        [("p", "A", 1, r, "N", o, i) for r, o, i in pair],
        "pdb string, chain string, seq_id int, resname string, atom string, occ double, atom_no int",
    )
    assert {r.resname for r in C.best_residues(residues).collect()} == {"GLY"}


def test_one_shuffle_form_equals_the_steps(spark, cif):
    names = {letter: name for letter, (name, _) in spelled().items()}
    second = next(x for x in "STV" if x != CHAIN[1])
    double = atom(900, "N", names[second], 2, 2.0, group="ATOM", at=9.0)
    twice = atom(901, "CA", names[CHAIN[0]], 1, 1.5, group="ATOM", at=8.0)
    texts = [cif(extra_atoms=[double, twice]), cif(pdb="6tuv", chains=[("A", OTHER), ("B", TINY)])]
    atoms = mmcif.atom_rows(P.accept(files(spark, *texts), P.CurateConfig()))
    steps = C.residue_arrays(C.best_atoms(C.best_residues(C.known_residues(atoms))))
    want = C.chain_records(C.long_chains(steps)).orderBy("pdb", "chain").collect()
    got = C.resolve_chains(atoms).orderBy("pdb", "chain").collect()
    assert str(got) == str(want) and [r.sequence for r in got] == [CHAIN[0] + second + CHAIN[2:], OTHER]
    assert got[0].coords[0][1] == [8.0, 8.0, 8.0]


def nested(spark, text):
    accepted = P.accept(files(spark, text), P.CurateConfig())
    known = mmcif.atom_rows(accepted).select("pdb", "chain").distinct()
    generators = mmcif.generator_rows(accepted)
    members = C.generator_members(generators, known)
    out = C.nest_assemblies(members, C.assembly_transforms(generators, mmcif.operator_rows(accepted)))
    row = out.first()
    return row.assemblies if row else []


PAIR = [("H", LONG), ("L", OTHER)]


@pytest.mark.parametrize("seed", range(5))
def test_assemblies(spark, cif, seed):
    """Generators of listed chains and copies; chains that the file does not have are left out, and with them empty ones."""
    r = random.Random(seed)
    given = [
        [(r.choices(["H", "L", "X"], k=r.randint(1, 3)), [placed(r.randint(0, 9)) for _ in range(r.randint(1, 3))]) for _ in range(r.randint(1, 2))]
        for _ in range(seed)
    ]
    want = []
    for generators in given:
        own = [(sorted(set(members) - {"X"}, key=members.index), matrices) for members, matrices in generators]
        own = [g for g in own if g[0]]
        want += [own] if own else []
    got = nested(spark, cif(chains=PAIR, assemblies=given))
    flat = lambda m: [x for line in m for x in line]
    assert [[(g.chains, [flat(m) for m in g.asmb_xforms]) for g in a] for a in got] == want


@pytest.mark.parametrize(
    "text, want",
    [("1", [["1"]]), ("1,2", [["1"], ["2"]]), ("(1-3)", [["1"], ["2"], ["3"]]), ("(P)(1,2)", [["P", "1"], ["P", "2"]])],
)
def test_operator_expressions(spark, text, want):
    assert spark.range(1).select(C.oper_combinations(F.lit(text)).alias("x")).first().x == want


def test_values_over_several_lines(spark, cif):
    text = cif(chains=[*PAIR, ("A", CHAIN)], assemblies=[[(["H", "L", "A"], [placed(0), placed(4)])]])
    assert "\nH,L,A 1 1,2" in text
    got = nested(spark, text.replace("\nH,L,A 1 1,2", "\n;H,\nL,A\n; 1\n;1,2\n;"))
    assert [[(g.chains, len(g.asmb_xforms)) for g in a] for a in got] == [[(["H", "L", "A"], 2)]]


def test_plain_and_gzipped_files(spark, cif, tmp_path):
    (tmp_path / "a.cif").write_text(cif(pdb="1aaa"))
    with gzip.open(tmp_path / "b.cif.gz", "wt") as f:
        f.write(cif(pdb="2bbb", resolution=1.5))
    got = mmcif.entries(mmcif.read_text(spark, str(tmp_path)))
    assert sorted((r.pdb, r.resolution) for r in got.collect()) == [("1aaa", 2.0), ("2bbb", 1.5)]


def test_quoted_names_and_unknown_values(spark, cif):
    line = """HETATM 999 O "O5'" . ALA A 1 {0} 1.0 {1} 1.0 {2} {3} {0} A 1"""
    extra = [line.format(END + 1, "?", "1.00", "30.00"), line.format(END + 1, "2.0", ".", "?")]
    rows = mmcif.atom_rows(mmcif.entries(files(spark, cif(extra_atoms=extra)))).filter(F.col("seq_id") == END + 1).collect()
    assert [(r.atom, r.y, r.occ, r.b) for r in rows] == [("O5'", 2.0, 1.0, 0.0)]
