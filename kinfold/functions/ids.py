"""Identifier rules: three id-to-key rules, one inverse, accessions and hierarchy terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip()/str.split() treat as whitespace, as a regex class body.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (SQL ``trim`` only knows blanks)."""
    return F.regexp_replace(c, f"^[{WHITESPACE}]+|[{WHITESPACE}]+\\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITESPACE}]+\\z", "")


def fasta_key(header: Column) -> Column:
    """Header to store key: strip, drop leading ``>``s, every ``/`` becomes ``_``."""
    return F.translate(F.regexp_replace(strip(header), "^>+", ""), "/", "_")


def embedder_key(raw_id: Column) -> Column:
    """Key written by the embedders: every ``/`` and every ``.`` becomes ``_``."""
    return F.translate(raw_id, "/.", "__")


def export_key(fasta_id: Column) -> Column:
    """Key looked up by the exporters: only the first ``/`` becomes ``_``."""
    return F.regexp_replace(fasta_id, "^([^/]*)/", "$1_")


def key_to_id(key: Column) -> Column:
    """Inverse used by label joins and exports: the first ``_`` becomes ``/``."""
    return F.regexp_replace(key, "^([^_]*)_", "$1/")


def header_field(header: Column, split_char: str = "!", field: int = 0) -> Column:
    """Field ``field`` of a header split at ``split_char``; the whole header where it has fewer fields."""
    if not split_char:
        raise ValueError("split_char must not be empty")
    parts = F.split(header, re.escape(split_char), -1)
    # a negative field counts from the end, as Python indexing does
    index = F.lit(field) if field >= 0 else F.size(parts) + F.lit(field)
    return F.coalesce(F.get(parts, index), header)


def accession(header: Column, strict: bool = False) -> Column:
    """Text between the leading ``>`` and the first ``/`` of a header line.

    ``strict`` reproduces the rule that a header without ``/`` never matches an annotation (its accession
    keeps the line end); otherwise the stripped text is used.
    """
    body = F.substring_index(F.substring(header, 2, 2147483647), "/", 1)
    if strict:
        return F.when(F.contains(header, F.lit("/")), body)
    return rstrip(body)


def member_accession(member: Column) -> Column:
    """Accession of a bare member id ``ACC/START-END``."""
    return F.substring_index(member, "/", 1)


def segments(member: Column) -> Column:
    """``ACC/25-112_187-234`` to an array of (start, end)."""
    tail = F.substring_index(member, "/", -1)
    return F.transform(
        F.split(tail, "_"),
        lambda s: F.struct(
            F.substring_index(s, "-", 1).cast("int").alias("start"),
            F.substring_index(s, "-", -1).cast("int").alias("end"),
        ),
    )


def parent_term(term: Column) -> Column:
    """Term without its last dotted component; a term without a dot stays as it is."""
    return F.regexp_replace(term, "\\.[^.]*\\z", "")


def cluster_file(ordinal: Column) -> Column:
    """``cluster_00042.faa``; widens past five digits."""
    return F.format_string("cluster_%05d.faa", ordinal)
