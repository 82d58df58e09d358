"""Deterministic random keys: a pure function of stable columns, never of partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SPACE = 1 << 32


def random_key(columns: list[Column], seed: int, kind: str = "hash") -> Column:
    """Uniform bigint in [0, 2^32). `kind="mix"` is a plain multiplicative key of one integer column (below 2^31)."""
    if kind == "hash":
        return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(KEY_SPACE))
    if kind == "mix":
        (column,) = columns
        return F.pmod((column.cast("bigint") + seed) * F.lit(2654435761), F.lit(KEY_SPACE))
    raise ValueError(f"unknown key kind {kind!r}")


def key_levels(key: Column, bits: tuple[int, ...] = (22, 12)) -> list[tuple[str, Column]]:
    """Coarse-to-fine buckets of a key: 1,024 coarse ones, 1,024 fine ones in each."""
    return [(f"_level{i}", F.shiftright(key, b)) for i, b in enumerate(bits)]
