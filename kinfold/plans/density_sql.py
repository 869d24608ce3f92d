"""The clustering of ``embeddings`` as recursive SQL for DuckDB: spanning tree, merges, condensed tree, selection."""

from __future__ import annotations

UNIT = """u AS (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e FROM embeddings)"""

# one linear layer whose weights follow a formula; its bias is (j - 3) / 16
PROJECTED = """x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
    y AS (SELECT vec_id, j, sum(v * ((j * 31 + i * 17) % 13 - 6) / 8.0) + (j - 3.0) / 16.0 AS y FROM x CROSS JOIN range(8) t(j) GROUP BY 1, 2),
    z AS (SELECT vec_id AS id, list(y ORDER BY j) AS y FROM y GROUP BY 1),
    u AS MATERIALIZED (SELECT id, list_transform(y, lambda a: a / sqrt(list_sum(list_transform(y, lambda b: b * b)))) AS e FROM z)"""


def tree(min_samples: int = 2, metric: str = "euclidean", unit: str = UNIT) -> str:
    """CTEs up to ``edges`` (k, lo, hi, w, a, b): Prim's algorithm, one vertex per step, edges ordered by (w, lo, hi); a and b are places of the ends."""
    reach = "SELECT * FROM p" if min_samples <= 2 else "SELECT p.id, p.neighbor, greatest(p.d, a.core, b.core) AS d FROM p JOIN c a ON a.id = p.id JOIN c b ON b.id = p.neighbor"
    weight = "best" if metric == "euclidean" else "best * best / 2"
    nearer = "d.d < x.best OR (d.d = x.best AND (least(x.pick, x.v) < x.lo OR (least(x.pick, x.v) = x.lo AND greatest(x.pick, x.v) < x.hi)))"
    return f"""{unit}, p AS MATERIALIZED (SELECT a.id AS id, b.id AS neighbor, list_distance(a.e, b.e) AS d FROM u a JOIN u b ON a.id <> b.id),
    c AS MATERIALIZED (SELECT id, d AS core FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, neighbor) = {max(min_samples - 1, 1)}),
    d AS MATERIALIZED ({reach}),
    s AS (SELECT 0 AS step, neighbor AS v, d AS best, least(id, neighbor) AS lo, greatest(id, neighbor) AS hi FROM d WHERE id = (SELECT min(id) FROM u)
    UNION ALL SELECT x.step + 1, x.v, CASE WHEN {nearer} THEN d.d ELSE x.best END,
      CASE WHEN {nearer} THEN least(x.pick, x.v) ELSE x.lo END, CASE WHEN {nearer} THEN greatest(x.pick, x.v) ELSE x.hi END
    FROM (SELECT *, first_value(v) OVER (ORDER BY best, lo, hi) AS pick FROM s) x JOIN d ON d.id = x.pick AND d.neighbor = x.v WHERE x.v <> x.pick),
    places AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS place FROM u),
    edges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY best, s.lo, s.hi) AS k, s.lo, s.hi, {weight} AS w, a.place AS a, b.place AS b
      FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY step ORDER BY best, lo, hi) = 1) s JOIN places a ON a.id = s.lo JOIN places b ON b.id = s.hi)"""


def condensed(min_samples: int = 2, metric: str = "euclidean", unit: str = UNIT) -> str:
    """Further CTEs: merges (k, l, r, n), members (k, c) of the merges in each cluster, clusters (c, up, w, n, s), points (id, c, w).

    A merge is numbered by its edge and a cluster by its first merge; ``l`` and ``r`` are what is merged, a point being minus its place.
    """
    return f"""{tree(min_samples, metric, unit)},
    run AS (SELECT 0::BIGINT AS k, (SELECT list(-place ORDER BY place) FROM places) AS held, 0::BIGINT AS l, 0::BIGINT AS r
    UNION ALL SELECT e.k, list_transform(run.held, lambda x: CASE WHEN x = run.held[e.a] OR x = run.held[e.b] THEN e.k ELSE x END), run.held[e.a], run.held[e.b]
    FROM run JOIN edges e ON e.k = run.k + 1),
    merges AS MATERIALIZED (SELECT e.k, e.lo, e.hi, e.w, run.l, run.r, len(list_filter(run.held, lambda x: x = run.k)) AS n FROM run JOIN edges e ON e.k = run.k),
    members AS (SELECT k, k AS c FROM merges WHERE sign(l) = sign(r)
    UNION ALL SELECT m.k, members.c FROM members JOIN merges m ON greatest(m.l, m.r) = members.k AND sign(m.l) <> sign(m.r)),
    tops AS MATERIALIZED (SELECT c, max(k) AS top FROM members GROUP BY c),
    splits AS (SELECT k, w, unnest([l, r]) AS side FROM merges WHERE l > 0 AND r > 0),
    leaving AS (SELECT b.c, b.k, m.w, CASE WHEN sign(m.l) <> sign(m.r) THEN 1 WHEN m.l < 0 THEN 2 ELSE m.n END AS n FROM members b JOIN merges m ON m.k = b.k),
    clusters AS MATERIALIZED (SELECT t.c, u.k AS up, u.w AS w, m.n, l.s - coalesce(1 / u.w, 0) * l.n AS s, row_number() OVER (ORDER BY t.c) AS o
      FROM tops t JOIN merges m ON m.k = t.top LEFT JOIN splits u ON u.side = t.top JOIN (SELECT c, sum(n / w) AS s, sum(n) AS n FROM leaving GROUP BY c) l ON l.c = t.c),
    points AS MATERIALIZED (SELECT p.id, b.c, x.w FROM (SELECT k, w, unnest([l, r]) AS side FROM merges) x JOIN places p ON p.place = -x.side JOIN members b ON b.k = x.k)"""


def condensed_sql(min_samples: int = 2, metric: str = "euclidean") -> str:
    return f"""WITH RECURSIVE {condensed(min_samples, metric)}
    SELECT concat(m.lo, '-', m.hi) AS parent, p.id::VARCHAR AS child, round(1 / p.w, 6) AS "lambda", 1::BIGINT AS size FROM points p JOIN merges m ON m.k = p.c
    UNION ALL SELECT concat(a.lo, '-', a.hi), concat(b.lo, '-', b.hi), round(1 / c.w, 6), c.n::BIGINT FROM clusters c JOIN merges a ON a.k = c.up JOIN merges b ON b.k = c.c"""


def labels(min_samples: int = 2, metric: str = "euclidean", unit: str = UNIT) -> str:
    """Further CTEs up to ``labels`` (id, label): excess of mass, lowest clusters first, then the topmost selected cluster of each."""
    return f"""{condensed(min_samples, metric, unit)},
    kids AS MATERIALIZED (SELECT a.o, a.s, list(b.o) FILTER (b.o IS NOT NULL) AS below FROM clusters a LEFT JOIN clusters b ON b.up = a.c GROUP BY a.o, a.s),
    eom AS (SELECT 0::BIGINT AS o, []::DOUBLE[] AS best
    UNION ALL SELECT k.o, list_append(eom.best, greatest(k.s, coalesce(list_sum(list_transform(k.below, lambda x: eom.best[x])), 0))) FROM eom JOIN kids k ON k.o = eom.o + 1),
    chosen AS MATERIALIZED (SELECT k.o, k.s >= coalesce(list_sum(list_transform(k.below, lambda x: f.best[x])), 0) * (1 - 1e-12) AS wins
      FROM kids k CROSS JOIN (SELECT best FROM eom ORDER BY o DESC LIMIT 1) f),
    topmost AS (SELECT c, NULL::BIGINT AS win FROM clusters WHERE up IS NULL
    UNION ALL SELECT c.c, coalesce(t.win, CASE WHEN x.wins THEN c.c END) FROM topmost t JOIN clusters c ON c.up = t.c JOIN chosen x ON x.o = c.o),
    named AS (SELECT p.id, t.win, min(p.id) OVER (PARTITION BY t.win) AS first FROM points p JOIN topmost t ON t.c = p.c),
    numbers AS (SELECT win, row_number() OVER (ORDER BY min(first)) - 1 AS label FROM named WHERE win IS NOT NULL GROUP BY win),
    labels AS MATERIALIZED (SELECT n.id, coalesce(x.label, -1)::BIGINT AS label FROM named n LEFT JOIN numbers x ON x.win = n.win)"""


def labels_sql(min_samples: int = 2, metric: str = "euclidean") -> str:
    return f"WITH RECURSIVE {labels(min_samples, metric)} SELECT id, label FROM labels"
