"""The five hosts and the spellings that name them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host keys with the species and the short species forms that name them.
HOST_NAMES = {
    "E_coli": ["e coli", "escherichia coli"],
    "Human": ["human", "homo sapiens", "h sapiens"],
    "Mouse": ["mouse", "mus musculus", "m musculus"],
    "S_cerevisiae": ["s cerevisiae", "saccharomyces cerevisiae"],
    "P_pastoris": ["p pastoris", "pichia pastoris", "komagataella pastoris", "komagataella phaffii"],
}


def host_key(c: Column | str) -> Column:
    """Host key named by a free spelling (case, blanks, dots, ``_`` and ``-`` aside), else null."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(F.lower(c), r"[\s\p{Z}._\-]+", "")
    known = {n.replace(" ", ""): key for key, names in HOST_NAMES.items() for n in [*names, key.lower().replace("_", "")]}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.coalesce(plain, F.lit("")))
