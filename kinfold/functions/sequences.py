"""Residue clean-up, tokens and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residues each model family replaces by X, and the translation-direction prefixes.
RARE_RESIDUES = {"t5": "UZO", "esm": "UZOB"}
# The whitespace of Python's str.split(), and the gap sign.
GAPS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000-"
)
PREFIX_AA = "<AA2fold>"
PREFIX_3DI = "<fold2AA>"


def _rare(family: str) -> str:
    if family not in RARE_RESIDUES:
        raise ValueError(f"unknown model family {family!r}; one of {sorted(RARE_RESIDUES)}")
    return RARE_RESIDUES[family]


def strip_gaps(seq: Column) -> Column:
    """Remove whitespace of any kind and alignment gaps (one character map, cheaper than a pattern)."""
    return F.translate(seq, GAPS, "")


def clean(seq: Column, is_3di: bool = False) -> Column:
    out = strip_gaps(seq)
    return F.lower(out) if is_3di else out


def mask_rare(seq: Column, family: str = "esm") -> Column:
    rare = _rare(family)
    return F.translate(seq, rare, "X" * len(rare))


def clean_and_mask(seq: Column, family: str = "esm") -> Column:
    """``mask_rare(clean(seq))`` in one pass."""
    rare = _rare(family)
    return F.translate(seq, rare + GAPS, "X" * len(rare))


def tokens(seq: Column, is_3di: bool = False) -> Column:
    """Direction prefix, then the residues separated by blanks."""
    prefix = PREFIX_3DI if is_3di else PREFIX_AA
    return F.concat(F.lit(prefix + " "), F.array_join(F.split(seq, ""), " "))


def n_residues(seq: Column) -> Column:
    return F.length(seq)
