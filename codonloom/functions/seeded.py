"""Seeded numbers that any engine with MD5 can draw again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The numbers lie in [0, 2 ** BITS).
BITS = 60


def seeded(seed: int | str, *parts: Column | str) -> Column:
    """A whole number from the first 15 hexadecimal digits of the MD5 of ``seed:part:...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) from its parts: reproducible and free of state."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def sql_seeded(seed: int | str, *parts: str) -> str:
    return f"('0x' || left(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 15))::BIGINT"


def sql_uniform(*parts: str) -> str:
    return f"(('0x' || left(md5(concat_ws(':', {', '.join(parts)})), 13))::BIGINT / {1 << 52}.0::DOUBLE)"
