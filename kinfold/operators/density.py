"""Hierarchical density clustering (HDBSCAN, minimum cluster size 2, excess-of-mass selection) as table operations.

1. exact spanning tree of the mutual-reachability graph (``mst``), contracted in Borůvka rounds;
2. the merge tree, cut into chains. A chain belongs to a component of a round and hangs, with all its edges, below
   the lightest edge leaving that component. Its own edges are the edges inside the component that are lighter than
   that edge but heavier than the one leaving their smaller component. Along a chain the merges are nested, so
   ordering a chain by weight orders its part of the merge tree. There are at most log2(n) levels of chains;
3. a component of at most HOME_ROWS points is a home: all chains inside it are complete, and one task runs through them,
   lightest edge first, giving its clusters with their sizes, stabilities and the best selection;
4. the chains of larger components, of which there are few but long ones, are worked off level by level, as running sums and
   running maxima along chains that are cut into stretches;
5. the topmost selected cluster above each home, down the levels.

Every step is a join, an aggregation or a scan over rows, or a task over a home of bounded size; no table is gathered in one place.

With a minimum cluster size of 2 a merge of two chains is a split of a cluster, and a single point joining a chain
falls out of the cluster it joins. A cluster is named by its first merge: the split that ends it, or the merge of its two closest points.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.vectors import norm, with_unit
from kinfold.operators import mst
from kinfold.operators.neighbors import BLOCK_ROWS, TILE_ROWS, build_cells, core_distances, distinct_points
from kinfold.operators.ordering import CHUNK_ROWS, following, running, with_position
from kinfold.session import checkpoint, checkpoint_counting

METRICS = ("euclidean", "cosine")
ORTHOGONAL = math.sqrt(2.0)  # distance of orthogonal unit vectors
NOISE = -1
HOME_ROWS = 1 << 18  # points of a component that one task works off
TIE = 1e-12  # relative difference below which two stabilities count as equal (the parent wins a tie)


def spanning_rounds(
    df: DataFrame,
    id_col: str = "id",
    vec: str = "embedding",
    min_samples: int = 2,
    metric: str = "euclidean",
    normalize: bool = True,
    tile_rows: int = TILE_ROWS,
    block_rows: int = BLOCK_ROWS,
    last_edges: int = mst.LAST_EDGES,
) -> mst.Rounds:
    """Contraction rounds of the spanning tree of the rows (unique bigint ids)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if min_samples < 1:
        raise ValueError("min_samples must be positive")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    if normalize or metric == "cosine":
        rows = with_unit(rows, "vec")
    rows = checkpoint(rows)
    n = rows.count()
    if min_samples > n:
        raise ValueError("min_samples exceeds the number of rows")
    zeros, n_zero = None, 0
    if metric == "cosine":
        is_zero = norm(F.col("vec")) == 0
        zeros, rows = rows.where(is_zero).select("id"), rows.where(~is_zero)
        n_zero = zeros.count()
    cells = build_cells(distinct_points(rows, "id", "vec"), tile_rows, block_rows)
    # up to 2 samples the core distance never exceeds the distance itself
    cores = checkpoint(core_distances(cells, min_samples, n_zero, ORTHOGONAL)) if min_samples > 2 else None
    edges = mst.copy_edges(rows, cells.points, cores)
    if n_zero < n:
        edges = edges.unionByName(mst.candidate_edges(cells, cores))
    if n_zero:
        edges = edges.unionByName(_zero_edges(zeros, rows, cores))
    if metric == "cosine":
        # on unit vectors 1 - cos = d^2 / 2, which keeps the order of the edges but not their weights
        edges = edges.withColumn("w", F.col("w") * F.col("w") / 2)
    return mst.contract(edges, last_edges)


def _zero_edges(zeros: DataFrame, rows: DataFrame, cores: DataFrame | None) -> DataFrame:
    """Edges of zero vectors, which are as far from everything as orthogonal vectors are.

    All edges of a zero vector weigh about the same, so two stars hold the tree edges: the first zero vector with every
    row, and the first row of least weight with every zero vector (the order of equal edges is by ids).
    """
    lone = zeros.select("id", F.lit(ORTHOGONAL).alias("w"))
    if cores is None:
        far = rows.select("id", F.lit(ORTHOGONAL).alias("w"))
    else:
        # copies share the core of their carrier, on which they hang anyway
        far = cores.select("id", F.greatest(F.lit(ORTHOGONAL), F.col("core")).alias("w"))
    far = far.unionByName(lone)
    first_zero = lone.agg(F.min(F.struct("w", "id")).alias("h")).scalar()
    first_row = far.agg(F.min(F.struct("w", "id")).alias("h")).scalar()
    ends = far.withColumn("h", first_zero["id"]).unionByName(
        zeros.withColumn("_f", first_row).select("id", F.col("_f.w").alias("w"), F.col("_f.id").alias("h"))
    )
    ends = ends.where(F.col("id") != F.col("h"))
    return ends.select(F.least("id", "h").alias("lo"), F.greatest("id", "h").alias("hi"), "w")


def place_merges(rounds: mst.Rounds, home_rows: int = HOME_ROWS) -> DataFrame:
    """Every choice of a component with the chain its edge belongs to, the edge that chain hangs on, and its home.

    The chain is that of the first component above whose own edge is heavier. Its home is the largest component above with at most ``home_rows``
    points; a chain of a larger component has none.
    """
    edge = F.struct("w", "lo", "hi")
    above = F.filter("path", lambda a: a["w"].isNull() | (F.struct(*[a[c].alias(c) for c in ("w", "lo", "hi")]) > edge))[0]
    home = F.try_element_at(F.filter("path", lambda a: a["n"] <= home_rows), F.lit(-1))
    placed = rounds.table.where(F.col("w").isNotNull()).select("level", "comp", "w", "lo", "hi", above.alias("c"), home.alias("h"))
    has = F.col("c.n") <= home_rows
    return checkpoint(
        placed.select(
            (F.col("level") == 0).alias("is_point"), "comp", "w", "lo", "hi",
            F.col("c.level").alias("chain_level"), F.col("c.comp").alias("chain"), F.col("c.w").alias("top_w"), F.col("c.lo").alias("top_lo"), F.col("c.hi").alias("top_hi"),
            F.when(has, F.col("h.level")).alias("home_level"), F.when(has, F.col("h.comp")).alias("home"),
        )
    )


def _lambda(w):
    return F.when(w > 0, 1 / w)  # null stands for infinity


#: What a home yields. kind 0, a point: the cluster it falls out of and the merge at which it does, the topmost selected cluster of the home above it, the
#: chain by which the home's part hangs together. 1, a cluster: its name, the split it comes from, size, stability, selected or not. 2, a chain whose hook
#: lies outside: the merge it hangs on, size and value of its best selection (flag: infinite).
HOME = (
    "kind int, id long, lo long, hi long, up_lo long, up_hi long, w double, size long, value double, flag boolean, win_lo long, win_hi long, chain_level int, chain long"
)


def _home(pdf: pd.DataFrame) -> pd.DataFrame:
    """Condense all complete chains of a home."""
    merges = pdf.drop_duplicates(["lo", "hi"])
    merges = merges.iloc[np.lexsort((merges["hi"], merges["lo"], merges["w"]))]
    los, his, ws = (merges[c].tolist() for c in ("lo", "hi", "w"))
    at = {e: i for i, e in enumerate(zip(los, his))}
    joins: dict[int, list[int]] = defaultdict(list)
    for point, lo, hi in pdf.loc[pdf["is_point"], ["comp", "lo", "hi"]].itertuples(index=False):
        joins[at[lo, hi]].append(point)
    keys = list(zip(merges["chain_level"].tolist(), merges["chain"].tolist()))
    tops = {
        k: (None, None, None) if math.isnan(w) else (w, int(lo), int(hi))
        for k, w, lo, hi in zip(keys, merges["top_w"].astype(float), merges["top_lo"].fillna(0), merges["top_hi"].fillna(0))
    }
    hooks: dict[int, list[tuple]] = defaultdict(list)  # chains by the merge they hang on
    outside = [k for k, (_, lo, hi) in tops.items() if (lo, hi) not in at]
    for k, (_, lo, hi) in tops.items():
        if (lo, hi) in at:
            hooks[at[lo, hi]].append(k)
    size = dict.fromkeys(tops, 0)
    best, endless = dict.fromkeys(tops, 0.0), dict.fromkeys(tops, False)
    last: dict[tuple, int] = {}  # the cluster a chain is in
    clusters: list[dict] = []

    def close(key: tuple, w: float | None, parent: int, up: tuple) -> None:
        c = clusters[last[key]]
        birth = 0.0 if w is None else 1 / w if w > 0 else None
        c["stability"] = 0.0 if birth is None else c["mass"] - birth * c["n"]
        own = c["own"] and birth is not None
        c["wins"] = w is not None and (own or (not c["below_endless"] and c["stability"] >= c["below"] * (1 - TIE)))
        best[key], endless[key] = max(c["stability"], c["below"]), own or c["below_endless"]
        c["size"], c["w"], c["parent"], c["up"] = size[key], w, parent, up

    of_merge = []
    for i, (key, w) in enumerate(zip(keys, ws)):
        hung, points = hooks.get(i, ()), joins.get(i, ())
        if hung or key not in last:
            new = len(clusters)
            for k in hung:
                close(k, w, new, (los[i], his[i]))
            if key in last:
                close(key, w, new, (los[i], his[i]))
            below, unending = sum(best[k] for k in hung) + best[key], any(endless[k] for k in hung) or endless[key]
            clusters.append({"lo": los[i], "hi": his[i], "mass": 0.0, "n": 0, "own": False, "below": below, "below_endless": unending, "chain": key})
            last[key] = new
        c = clusters[last[key]]
        size[key] += len(points) + sum(size[k] for k in hung)
        out = size[key] if hung else len(points)
        c["n"] += out
        if w > 0:
            c["mass"] += out / w
        else:
            c["own"] = True
        of_merge.append(last[key])
    for k in outside:
        w, lo, hi = tops[k]
        close(k, w, -1, (lo, hi))
    rows: list[tuple] = []
    win, root = [None] * len(clusters), [None] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):  # parents come later than what they split into
        c = clusters[i]
        inner = c["parent"] >= 0
        root[i] = root[c["parent"]] if inner else c["chain"]
        win[i] = (win[c["parent"]] if inner else None) or ((c["lo"], c["hi"]) if c["wins"] else None)
        rows.append((1, None, c["lo"], c["hi"], *c["up"], c["w"], c["size"], c["stability"], c["wins"], None, None, None, None))
    for i, points in joins.items():
        m = of_merge[i]
        for point in points:
            rows.append((0, point, clusters[m]["lo"], clusters[m]["hi"], None, None, ws[i], None, None, None, *(win[m] or (None, None)), *root[m]))
    for k in outside:
        rows.append((2, None, None, None, *tops[k][1:], None, size[k], best[k], endless[k], None, None, *k))
    names = [c.split()[0] for c in HOME.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for name, kind in (c.split() for c in HOME.split(", ")):
        out[name] = out[name].astype({"int": "Int32", "long": "Int64", "double": "Float64", "boolean": "boolean"}[kind])
    return out


def _climb(merges: DataFrame, alone: DataFrame, below: DataFrame, levels: list[int], chunk: int) -> tuple[DataFrame, DataFrame]:
    """Sizes, clusters and selections of the chains of large components, lowest level first.

    ``merges`` are theirs (pos, level, comp, w, lo, hi, top_*), ``alone`` counts the points that join at each, ``below`` holds the chains that hang on them
    so far (top_lo, top_hi, size, v, inf). Returns nodes (lo, hi, w, level, comp, seg, name) and segments. A segment is the stretch of a chain between
    two splits: one cluster.
    """
    all_nodes, all_segments = [], []
    chain = ["comp"]
    for level in levels:
        hung = below.groupBy(F.col("top_lo").alias("lo"), F.col("top_hi").alias("hi")).agg(
            F.sum("size").alias("_size"), F.sum("v").alias("_v"), F.max("inf").alias("_inf"), F.count(F.lit(1)).alias("_chains")
        )
        here = merges.where(F.col("level") == level).join(alone, ["lo", "hi"], "left").join(hung, ["lo", "hi"], "left").fillna(0, ["_points", "_size", "_v", "_inf", "_chains"])
        here = here.withColumn("_add", F.col("_points") + F.col("_size")).withColumn("_split", (F.col("_chains") > 0).cast("long"))
        here = checkpoint(running(here, chain, "pos", {"size": "_add", "seg": "_split"}, chunk=chunk))
        # what leaves the cluster at this merge: everything at a split, else the points that join here
        here = here.withColumn("_out", F.when(F.col("_split") == 1, F.col("size")).otherwise(F.col("_points")))
        lam = _lambda(F.col("w"))
        segs = here.groupBy("comp", "seg").agg(
            F.min("pos").alias("pos"),
            F.min_by(F.struct("w", "lo", "hi"), "pos").alias("_first"),
            F.max("size").alias("size"),
            F.sum(F.coalesce(F.col("_out") * lam, F.lit(0.0))).alias("_mass"),
            F.sum("_out").alias("_n"),
            F.max(lam.isNull().cast("int")).alias("_own_inf"),
            F.sum("_v").alias("_b"),
            F.max("_inf").alias("_b_inf"),
            F.first(F.struct(F.col("top_w").alias("w"), F.col("top_lo").alias("lo"), F.col("top_hi").alias("hi"))).alias("_top"),
        )
        segs = following(segs, chain, "pos", "_first", "_next", chunk=chunk).withColumn("_up", F.coalesce("_next", "_top"))
        root = F.col("_up.w").isNull()
        birth = F.when(root, F.lit(0.0)).otherwise(_lambda(F.col("_up.w")))
        # born at an infinite density: no stability of its own
        segs = segs.select(
            "comp", "seg", "pos", "size", "_first", "_up", "_top", "_b", "_b_inf",
            root.alias("_root"),
            F.coalesce(F.col("_mass") - birth * F.col("_n"), F.lit(0.0)).alias("stability"),
            F.when(birth.isNull(), 0).otherwise(F.col("_own_inf")).alias("_own_inf"),
        )
        # best(i) = max(stability(i), hung(i) + best(i-1)) unrolled with prefix sums of what hangs below
        segs = running(segs, chain, "pos", {"_hung": "_b", "_hung_inf": "_b_inf"}, chunk=chunk)
        segs = segs.withColumn("_a", F.col("stability") - F.col("_hung"))
        segs = running(segs, chain, "pos", {}, {"_before": "_a", "_before_inf": "_own_inf"}, chunk=chunk)
        children = F.col("_hung") + F.greatest(F.coalesce("_before", F.lit(0.0)), F.lit(0.0))
        children_inf = (F.col("_hung_inf") > 0) | (F.coalesce("_before_inf", F.lit(0)) > 0)
        own_inf = F.col("_own_inf") == 1
        wins = ~F.col("_root") & (own_inf | (~children_inf & (F.col("stability") >= children * (1 - TIE))))
        segs = checkpoint(
            segs.select(
                F.lit(level).alias("level"), "comp", "seg", "pos", "size", "stability", "_top",
                F.col("_first.lo").alias("lo"), F.col("_first.hi").alias("hi"), F.col("_up.lo").alias("up_lo"), F.col("_up.hi").alias("up_hi"), F.col("_up.w").alias("w"),
                wins.alias("wins"),
                F.greatest(F.col("stability"), children).alias("_best"),
                (own_inf | children_inf).cast("int").alias("_best_inf"),
            )
        )
        all_segments.append(segs)
        names = segs.select("comp", "seg", F.struct("lo", "hi").alias("name"))
        all_nodes.append(here.select("lo", "hi", "w", "level", "comp", "seg").join(names, ["comp", "seg"]))
        chains = segs.groupBy("comp").agg(
            F.first("_top.lo").alias("top_lo"),
            F.first("_top.hi").alias("top_hi"),
            F.max("size").alias("size"),
            F.max_by("_best", "seg").alias("v"),
            F.max("_best_inf").alias("inf"),
        ).where(F.col("top_lo").isNotNull()).drop("comp")
        below = below.unionByName(chains)
    nodes, segments = all_nodes[0], all_segments[0]
    for extra in all_nodes[1:]:
        nodes = nodes.unionByName(extra)
    for extra in all_segments[1:]:
        segments = segments.unionByName(extra)
    return checkpoint(nodes), segments


def _descend(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(lo, hi, w, name, win): the cluster of each merge of ``nodes`` and the topmost selected cluster holding it (null: none)."""
    chain = F.struct("level", "comp")
    won = F.when(F.col("wins"), F.struct("seg", F.struct("lo", "hi").alias("name")))
    own = segments.groupBy("level", "comp").agg(F.first("_top.lo").alias("lo"), F.first("_top.hi").alias("hi"), F.max(won).alias("own"))
    own = checkpoint(own.select(chain.alias("chain"), "lo", "hi", "own"))
    # where a chain hangs: the chain above it, and what is selected there at or above that merge
    hooks = nodes.select("lo", "hi", chain.alias("next"), "seg")
    above = own.select(F.col("chain").alias("next"), F.col("own").alias("_own"))
    links = own.join(hooks, ["lo", "hi"]).join(above, "next").select("chain", "next", F.when(F.col("_own.seg") >= F.col("seg"), F.col("_own.name")).alias("win"))
    roots = own.where(F.col("lo").isNull()).select("chain", F.lit(None).cast(links.schema["next"].dataType).alias("next"), F.lit(None).cast(links.schema["win"].dataType).alias("win"))
    # follow the links upwards, several at a time; the selection nearest the root wins
    current, open_ends = checkpoint_counting(links.unionByName(roots), F.col("next").isNotNull())
    while open_ends:
        step = current.withColumnsRenamed({"next": "_n0", "win": "_w0"})
        for i in range(1, mst.HOPS):
            hop = current.select(F.col("chain").alias(f"_n{i - 1}"), F.col("next").alias(f"_n{i}"), F.col("win").alias(f"_w{i}"))
            step = step.join(hop, f"_n{i - 1}", "left")
        best = F.coalesce(*[f"_w{i}" for i in range(mst.HOPS - 1, -1, -1)])
        current, open_ends = checkpoint_counting(step.select("chain", F.col(f"_n{mst.HOPS - 1}").alias("next"), best.alias("win")), F.col("next").isNotNull())
    resolved = own.join(current.select("chain", F.col("win").alias("outer")), "chain").select("chain.level", "chain.comp", "own", "outer")
    won = F.coalesce("outer", F.when(F.col("own.seg") >= F.col("seg"), F.col("own.name")))
    return nodes.join(resolved, ["level", "comp"]).select("lo", "hi", "w", "name", won.alias("win"))


def condense(rounds: mst.Rounds, home_rows: int = HOME_ROWS, chunk: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Points and clusters of the condensed tree.

    Points: id, cluster (lo, hi) it falls out of, ``w`` at which it does, ``win`` (lo, hi): the selected cluster it belongs to, null for noise. Clusters:
    lo, hi, up_lo, up_hi (the cluster it was split off, null for the root), ``w`` of that split, size, stability, wins.
    """
    placed = place_merges(rounds, home_rows)
    homes = checkpoint(placed.where("home is not null").groupBy("home_level", "home").applyInPandas(_home, HOME))
    name = lambda lo, hi: F.when(F.col(lo).isNotNull(), F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi")))
    points = homes.where("kind = 0").select("id", "lo", "hi", "w", name("win_lo", "win_hi").alias("win"), "chain_level", "chain")
    clusters = homes.where("kind = 1").select("lo", "hi", "up_lo", "up_hi", "w", "size", F.col("value").alias("stability"), F.col("flag").alias("wins"))
    large = placed.where("home is null")
    levels = sorted(r.chain_level for r in large.select("chain_level").distinct().collect())  # at most log2(n)
    if not levels:
        return points.drop("chain_level", "chain"), clusters
    hung = homes.where("kind = 2").select("chain_level", "chain", F.col("up_lo").alias("top_lo"), F.col("up_hi").alias("top_hi"), "size", F.col("value").alias("v"), F.col("flag").cast("int").alias("inf"))
    columns = [F.col("chain_level").alias("level"), F.col("chain").alias("comp"), "w", "lo", "hi", "top_w", "top_lo", "top_hi"]
    merges = checkpoint(with_position(large.select(*columns).distinct(), ["level", "comp", "w", "lo", "hi"]))
    alone = checkpoint(large.where("is_point").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("_points")))
    nodes, segments = _climb(merges, alone, hung.drop("chain_level", "chain").where("top_lo is not null"), levels, chunk)
    topmost = checkpoint(_descend(nodes, segments))
    # a selected cluster further up takes what homes have selected
    outer = hung.join(topmost.select(F.col("lo").alias("top_lo"), F.col("hi").alias("top_hi"), F.col("win").alias("outer")), ["top_lo", "top_hi"])
    points = points.join(outer.select("chain_level", "chain", "outer"), ["chain_level", "chain"], "left").withColumn("win", F.coalesce("outer", "win"))
    direct = large.where("is_point").select(F.col("comp").alias("id"), "lo", "hi").join(topmost, ["lo", "hi"]).select("id", "name.lo", "name.hi", "w", "win")
    upper = segments.select("lo", "hi", "up_lo", "up_hi", "w", "size", "stability", "wins")
    return points.select("id", "lo", "hi", "w", "win").unionByName(direct), clusters.unionByName(upper)


def label_rounds(rounds: mst.Rounds, home_rows: int = HOME_ROWS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(id, label) from the contraction rounds; labels count up by the first id of a cluster, noise is -1."""
    points = checkpoint(condense(rounds, home_rows, chunk)[0].select("id", "win"))
    firsts = points.where(F.col("win").isNotNull()).groupBy("win").agg(F.min("id").alias("_first"))
    numbered = with_position(firsts, ["_first"], "_label").select("win", "_label")
    return points.join(numbered, "win", "left").select("id", F.coalesce("_label", F.lit(NOISE)).cast("long").alias("label"))


def hdbscan(
    df: DataFrame,
    id_col: str = "id",
    vec: str = "embedding",
    min_samples: int = 2,
    metric: str = "euclidean",
    normalize: bool = True,
    home_rows: int = HOME_ROWS,
    chunk: int = CHUNK_ROWS,
    **sizes: int,
) -> DataFrame:
    """Cluster labels (``id_col``, label) of the rows of ``df``; -1 is noise.

    Vectors are L2-normalised first unless ``normalize`` is off (zero vectors stay zero; for the cosine metric they are at
    distance 1 from everything). ``id_col`` holds unique
    integers. ``min_samples`` counts the point itself. ``home_rows``, ``chunk`` and ``sizes`` (``tile_rows``, ``block_rows``, ``last_edges``) bound what
    one task holds and change no result.
    """
    rounds = spanning_rounds(df, id_col, vec, min_samples, metric, normalize, **sizes)
    if not rounds.any:  # fewer than two rows
        return df.select(F.col(id_col).cast("long").alias(id_col), F.lit(NOISE).cast("long").alias("label"))
    return label_rounds(rounds, home_rows, chunk).withColumnRenamed("id", id_col)


def condensed_tree(
    df: DataFrame,
    id_col: str = "id",
    vec: str = "embedding",
    min_samples: int = 2,
    metric: str = "euclidean",
    normalize: bool = True,
    home_rows: int = HOME_ROWS,
    chunk: int = CHUNK_ROWS,
    **sizes: int,
) -> DataFrame:
    """(parent, child, lambda, size): what leaves each cluster, and at which density.

    A cluster is named ``lo-hi`` by its first merge, a point by its id; ``size`` is 1 for a point, and ``lambda`` is infinite where points coincide. Fewer than two
    rows give no tree.
    """
    rounds = spanning_rounds(df, id_col, vec, min_samples, metric, normalize, **sizes)
    if not rounds.any:
        return df.sparkSession.createDataFrame([], "parent string, child string, lambda double, size bigint")
    points, clusters = condense(rounds, home_rows, chunk)
    at = F.coalesce(_lambda(F.col("w")), F.lit(float("inf"))).alias("lambda")
    name = lambda lo, hi: F.concat_ws("-", lo, hi)
    left = points.select(name("lo", "hi").alias("parent"), F.col("id").cast("string").alias("child"), at, F.lit(1).cast("long").alias("size"))
    split = clusters.where("up_lo is not null").select(name("up_lo", "up_hi").alias("parent"), name("lo", "hi").alias("child"), at, "size")
    return left.unionByName(split)
