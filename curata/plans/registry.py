"""Named functions a user can extend: constructs, metrics, masks, schedules, clusterings and sources.

Names are checked when a plan is built.  Nothing is global state: registering
a function adds a name, and a plan that names it uses it.
"""

from __future__ import annotations

from collections.abc import Callable

from curata.functions.noise import SCHEDULES
from curata.operators.assembly import CONSTRUCTS
from curata.operators.clustering import MODES
from curata.operators.metrics import MASKS, METRICS
from curata.sources.mmcif import SOURCES

KINDS: dict[str, dict[str, Callable]] = {
    "construct": CONSTRUCTS,  # DataFrame of placed residues -> DataFrame of inputs
    "metric": METRICS,  # column names -> Column
    "mask": MASKS,  # column names -> MaskGroup
    "schedule": SCHEDULES,  # (t, max_t, rate) -> Column
    "cluster": MODES,  # (edges, lengths) -> DataFrame of member, rep
    "source": SOURCES,  # (session, location) -> DataFrame of path, content, is_refined
}


def register(kind: str, name: str, function: Callable) -> None:
    known = _kind(kind)
    if name in known and known[name] is not function:
        raise ValueError(f"{kind} {name!r} is already registered")
    known[name] = function


def unregister(kind: str, name: str) -> None:
    _kind(kind).pop(name, None)


def lookup(kind: str, name: str) -> Callable:
    known = _kind(kind)
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; known: {sorted(known)}")
    return known[name]


def _kind(kind: str) -> dict[str, Callable]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(KINDS)}")
    return KINDS[kind]
