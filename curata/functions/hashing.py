"""Seeded hashes and uniforms that depend only on row keys.

``rand()`` depends on partitioning and on task retries, so every random choice
in this package is a hash of the row's keys and a seed.  ``xxhash64`` is the
fast mode; ``md5`` gives the same values in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Split seeds and the odd constant that spreads epochs over seeds.
TEST_SEED = 43
VAL_SEED = 44
EPOCH_STRIDE = 6_364_136_223_846_793_005

MODES = ("xxhash64", "md5")
_DIGITS = 13  # 52 bits: the most hex digits that a double holds exactly


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"hash mode must be one of {MODES}, not {mode!r}")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def digest(seed, *keys) -> Column:
    """Hex md5 of ``seed:key1:key2``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_text(k) for k in keys]))


def sort_hash(seed, *keys, mode: str = "xxhash64") -> Column:
    """A hash to order by."""
    _check(mode)
    if mode == "md5":
        return digest(seed, *keys)
    return F.xxhash64(F.lit(str(seed)), *[_text(k) for k in keys])


def uniform(seed, *keys, mode: str = "xxhash64") -> Column:
    """A double in [0, 1) fixed by the seed and the keys."""
    _check(mode)
    if mode == "md5":
        head = F.conv(F.substring(digest(seed, *keys), 1, _DIGITS), 16, 10).cast("bigint")
        return head * F.lit(2.0 ** -(4 * _DIGITS))
    return F.shiftrightunsigned(sort_hash(seed, *keys), 11) * F.lit(2.0**-53)


def below(share: float, seed, *keys, mode: str = "xxhash64") -> Column:
    """True for a ``share`` of all keys, the same keys every time."""
    _check(mode)
    if share >= 1:
        return F.lit(True)
    if mode == "md5":
        limit = f"{int(share * 16**_DIGITS):0{_DIGITS}x}"
        return F.substring(digest(seed, *keys), 1, _DIGITS) < F.lit(limit)
    return uniform(seed, *keys) < F.lit(float(share))


def pick(n, seed, *keys, mode: str = "xxhash64") -> Column:
    """An integer in [0, n)."""
    return F.floor(uniform(seed, *keys, mode=mode) * n).cast("int")


def union_share(target: float, n_columns: int) -> float:
    """The share per column so that a row hit in any column has chance ``target``."""
    return 1 - (1 - target) ** (1 / n_columns)


def epoch_seed(base: int, epoch: int, fixed: bool = False) -> int:
    """Train seeds move with the epoch; validation and test seeds do not."""
    return base if fixed else (base + epoch * EPOCH_STRIDE) % 2**64
