"""Removal of repeated lines by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a document are a window. A window that occurs more than once anywhere keeps its first occurrence, in order
of id and position; the lines of all later ones are covered, overlapping or adjoining covered stretches are merged, and
what lies between the stretches is the document's new text. Each removed line has an equal line that stays: it is in the
first occurrence of its window or, if that is covered by another window, in that one's, and places only go down.

Only digests and positions are shuffled to find repeats. Counts of a frequent window are combined before the shuffle, and the join
that marks its occurrences has the occurrences on the side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import packed, text_key


def _windows(lines: Column, size: int) -> Column:
    """Position and 128-bit digest of each window that has a line with something in it."""
    here = lambda i: [F.get(lines, i + k) for k in range(size)]
    found = F.transform(
        F.sequence(F.lit(0), F.size(lines) - size),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(F.lit(1), *here(i)).alias("h1"),
            F.xxhash64(F.lit(2), *here(i)).alias("h2"),
            (F.length(F.trim(F.concat(*here(i)))) > 0).alias("filled"),
        ),
    )
    return F.filter(F.when(F.size(lines) >= size, found), lambda w: w["filled"])


def covered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Where later occurrences of repeated windows begin: ``a``, ``b`` (128-bit key of id and text) and the sorted ``at`` of each such document."""
    docs = df.select(F.col(id_col).alias("id"), F.split(F.col(text_col), "\n", -1).alias("lines"), text_key(id_col, text_col).alias("key"))
    rows = docs.select("id", "key.a", "key.b", F.inline(_windows(F.col("lines"), size)))
    place = F.struct("id", "a", "b", "at")
    repeated = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    later = rows.join(repeated.select("h1", "h2", "first"), ["h1", "h2"]).where(F.col("first") < place)
    return later.groupBy("a", "b").agg(F.array_sort(F.collect_set("at")).alias("at"))


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """All columns of ``df`` as ``row``, with ``n_lines``, ``n_removed`` and the new ``text``.

    Lines end at a line feed; a text without one is one line. A document of fewer than ``size`` lines has no window and stays as it is; so does a
    null text (0 lines). Windows of blank lines alone do not count as repeats. Windows may repeat within a document. Rows equal in id
    and text are one document and get the same result; null ids come first in the order, and of equal ids the smaller digest. If all
    lines go, the text is empty. An empty table gives an empty result. Column names cannot clash, all are inside ``row``.
    """
    docs = df.select(packed(df).alias("row"), F.col(text_col).alias("old"), text_key(id_col, text_col).alias("key"))
    docs = docs.select("row", "old", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    marked = docs.join(covered(df, id_col, text_col, size), ["a", "b"], "left").select("row", "old", "at", F.split("old", "\n", -1).alias("lines"))
    at, lines, n = F.col("at"), F.col("lines"), F.size("lines")
    # a merged stretch begins where the place before does not reach it, and ends where the next is out of reach
    begins = F.filter(at, lambda x, i: (i == 0) | (x > F.get(at, i - 1) + size))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + size))
    cut = marked.withColumns({"begins": begins, "ends": F.transform(ends, lambda x: x + size)})
    begins, ends = F.col("begins"), F.col("ends")

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        stop = F.when(i == F.size(begins), n).otherwise(F.get(begins, i))
        return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))

    stays = F.flatten(F.transform(F.sequence(F.lit(0), F.size(begins)), between))
    done = cut.select("row", "old", lines, F.when(at.isNotNull(), stays).alias("stays"))
    n_lines = F.when(F.col("old").isNull(), 0).otherwise(n)
    return done.select(
        "row",
        n_lines.alias("n_lines"),
        F.when(F.col("stays").isNull(), 0).otherwise(n - F.size("stays")).alias("n_removed"),
        F.when(F.col("stays").isNull(), F.col("old")).otherwise(F.array_join("stays", "\n")).alias("text"),
    )


def sql(size: int = 3) -> str:
    """The same result for ``documents`` in another engine's SQL, on the lines themselves instead of digests."""
    some = " || ".join(f"a[i + {k + 1}]" for k in range(size))
    window = ", ".join(f"a[i + {k + 1}]" for k in range(size))
    reach = " UNION ".join(f"SELECT doc_id, i + {k} AS j FROM later" for k in range(size))
    return f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
    w AS (SELECT doc_id, a, unnest(range(0, len(a) - {size - 1})) AS i FROM l),
    o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY {window} ORDER BY doc_id, i) AS k FROM w WHERE length(trim({some})) > 0),
    later AS (SELECT doc_id, i FROM o WHERE k > 1),
    gone AS ({reach}),
    e AS (SELECT doc_id, unnest(a) AS line, unnest(range(0, len(a))) AS j FROM l),
    t AS (SELECT e.doc_id, count(g.j) AS n_removed, string_agg(CASE WHEN g.j IS NULL THEN line END, chr(10) ORDER BY e.j) AS text
          FROM e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY 1)
    SELECT l.doc_id, coalesce(len(a), 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed,
           CASE WHEN l.text IS NOT NULL THEN coalesce(t.text, '') END AS text FROM l LEFT JOIN t ON t.doc_id = l.doc_id"""
