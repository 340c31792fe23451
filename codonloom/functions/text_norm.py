"""Normal forms of proteins, coding sequences and host names as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space characters removed from residue strings.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\u200b"
)


def _letters(c: Column | str, swap: tuple[str, str] = ("", "")) -> Column:
    """Upper case without white space and ``*``; only texts that hold other characters than
    capital letters (or the swapped one) pay for the character-wise translation."""
    c = F.upper(F.col(c) if isinstance(c, str) else c)
    other = "[^A-Z]" if not swap[0] else f"[^A-Z]|{swap[0]}"
    out = F.when(c.rlike(other), F.translate(c, swap[0] + WHITE_SPACE + "*", swap[1])).otherwise(c)
    return F.nullif(out, F.lit(""))


def protein_key(c: Column | str) -> Column:
    """Protein without case, white space and ``*``; null when nothing is left."""
    return _letters(c)


def sequence_key(c: Column | str) -> Column:
    """Coding sequence without case, white space and ``*``, with T for U; null when empty."""
    return _letters(c, ("U", "T"))
