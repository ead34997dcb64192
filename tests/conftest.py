from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from curata.functions import residues as R  # noqa: E402
from curata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("curata-tests", cores=8, partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


LETTERS = "".join(letter for _, letter, _ in R.RESIDUES if letter.isalpha())


def sequence(seed, n):
    """A chain of ``n`` plain residues."""
    return "".join(random.Random(seed).choices(LETTERS, k=n))


CHAIN = sequence(17, 9)


def spelled():
    """Letter to residue name and atoms."""
    return {letter: (name, R.ATOMS[parent]) for name, letter, parent in R.RESIDUES}


def rendered(category, rows):
    """A category as name-value pairs (a dict) or as a loop (a list of dicts)."""
    if isinstance(rows, dict):
        return [f"_{category}.{name} {value}" for name, value in rows.items()]
    return ["loop_", *(f"_{category}.{name}" for name in rows[0]), *(" ".join(map(str, r.values())) for r in rows)]


def position(residue, atom):
    """Where the test structures have atom ``atom`` (from 0) of residue ``residue`` (from 1)."""
    return [10.0 * residue + atom, -1.0 * residue, atom / 2]


def cif_text(
    pdb="1abc", method="X-RAY DIFFRACTION", resolution=2.0, chains=(("A", CHAIN),), date="2020-01-01",
    assemblies=(), extra_atoms=(),
):
    """Structure text; an assembly is a list of (chains, matrices), each matrix of 16 numbers."""
    known = spelled()
    parts = {"entry": {"id": pdb.upper()}, "pdbx_database_status": {"recvd_initial_deposition_date": date}}
    if resolution is not None:
        parts["refine"] = {"ls_d_res_high": resolution, "pdbx_refine_id": "X"}
    if method is not None:
        parts["exptl"] = [{"entry_id": pdb.upper(), "method": f'"{method}"'}]
    parts["atom_site"] = [
        {
            "group_PDB": "ATOM", "id": 100 * number + k, "type_symbol": atom[0], "label_atom_id": atom, "label_alt_id": ".",
            "label_comp_id": known[letter][0], "label_asym_id": chain, "label_entity_id": 1, "label_seq_id": number,
            **dict(zip(("Cartn_x", "Cartn_y", "Cartn_z"), position(number, k))), "occupancy": 1.0,
            "B_iso_or_equiv": 25.5, "auth_seq_id": number, "auth_asym_id": chain, "pdbx_PDB_model_num": 1,
        }
        for chain, sequence in chains
        for number, letter in enumerate(sequence, 1)
        for k, atom in enumerate(known[letter][1])
    ]
    text = [f"data_{pdb.upper()}", *(line for name, rows in parts.items() for line in rendered(name, rows)), *extra_atoms]
    matrices = [m for generators in assemblies for _, own in generators for m in own]
    if matrices:
        numbers = iter(range(1, len(matrices) + 1))
        text += rendered(
            "pdbx_struct_assembly_gen",
            [
                {"asym_id_list": ",".join(members), "assembly_id": n, "oper_expression": ",".join(str(next(numbers)) for _ in own)}
                for n, generators in enumerate(assemblies, 1)
                for members, own in generators
            ],
        )
        cell = {f"matrix[{i}][{j}]": 4 * i + j - 5 for i in (1, 2, 3) for j in (1, 2, 3)} | {f"vector[{i}]": 4 * i - 1 for i in (1, 2, 3)}
        text += rendered(
            "pdbx_struct_oper_list",
            [{"type": "'crystal symmetry operation'", "id": n} | {c: m[at] for c, at in cell.items()} for n, m in enumerate(matrices, 1)],
        )
    return "\n".join(text) + "\n"


@pytest.fixture
def cif():
    return cif_text
