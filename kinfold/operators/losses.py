"""Metric-learning losses, evaluated per batch.

A batch has a bounded number of rows, so its similarity matrix lives inside one task and only the loss leaves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import matrix
from kinfold.session import checkpoint_counting

EPS = 1e-12
SIDE = 4096  # rows, and proxies, of a piece of the product when both sides are long
LONGEST = 16  # times SIDE: the longer side of a piece at most


def supcon_value(z: np.ndarray, labels: np.ndarray, temperature: float) -> float:
    """Supervised contrastive loss of one batch; anchors without a positive count as 0 in the mean."""
    sim = z @ z.T / temperature
    sim -= sim.max(axis=1, keepdims=True)
    others = ~np.eye(len(z), dtype=bool)
    positive = (labels[:, None] == labels[None, :]) & others
    log_prob = sim - np.log(np.maximum((np.exp(sim) * others).sum(axis=1, keepdims=True), EPS))
    per_anchor = (positive * log_prob).sum(axis=1) / np.maximum(positive.sum(axis=1), EPS)
    return float(-per_anchor.mean())


def supcon_loss(df: DataFrame, temperature: float = 0.07) -> DataFrame:
    """(batch, n_rows, loss) from (batch, label, vec) with L2-normalised vectors."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        loss = supcon_value(matrix(pdf["vec"]), pdf["label"].to_numpy(), temperature)
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "n_rows": [len(pdf)], "loss": [loss]})

    return df.select("batch", "label", "vec").groupBy("batch").applyInPandas(one, "batch long, n_rows long, loss double")


def proxy_terms(z: np.ndarray, labels: np.ndarray, proxies: np.ndarray, classes: np.ndarray, margin: float, alpha: float):
    """(sum of ln(1+P) over classes present, their number, sum of ln(1+N) over all given classes)."""
    unit = proxies / np.maximum(np.linalg.norm(proxies, axis=1, keepdims=True), EPS)
    cos = z @ unit.T
    own = labels[:, None] == classes[None, :]
    pos = np.where(own, np.exp(-alpha * (cos - margin)), 0.0).sum(axis=0)
    neg = np.where(own, 0.0, np.exp(alpha * (cos + margin))).sum(axis=0)
    present = own.any(axis=0)
    return float(np.log1p(pos[present]).sum()), int(present.sum()), float(np.log1p(neg).sum())


def grid(n: int, m: int, side: int = SIDE) -> tuple[int, int]:
    """Parts into which ``n`` rows and ``m`` proxies are cut so that a piece of the product has about ``side`` squared pairs.

    Pieces are as square as the sizes allow: for k pieces each side is copied about root k times, the least for that number. No side of a piece is
    longer than ``LONGEST`` times ``side``.
    """
    pieces = max(1, -(-n * m // side**2))
    rows = min(max(1, round((pieces * n / max(m, 1)) ** 0.5)), pieces)
    return max(rows, -(-n // (LONGEST * side))), max(-(-pieces // rows), -(-m // (LONGEST * side)))


def product(df: DataFrame, proxies: DataFrame, parts: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the piece (r, c) each copy goes to: a batch whole in one r, a proxy in one c."""
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = df.select("batch", "label", "vec", place("batch", parts[0]).alias("r")).withColumn("c", copies(parts[1]))
    return left, proxies.select("class_idx", "proxy", place("class_idx", parts[1]).alias("c")).withColumn("r", copies(parts[0]))


def proxy_anchor_loss(df: DataFrame, proxies: DataFrame, margin: float = 0.2, alpha: float = 32.0, side: int = SIDE) -> DataFrame:
    """(batch, loss) from (batch, label, vec) and (class_idx, proxy).

    The positive term averages over the classes present in the batch, the negative term over all classes. The product of rows and proxies is cut on a
    grid chosen from both sizes, which are counted while the sides are written; each piece yields one row per batch.
    """
    df, n = checkpoint_counting(df.select("batch", "label", "vec"), F.lit(True))
    proxies, m = checkpoint_counting(proxies.select("class_idx", "proxy"), F.lit(True))
    left, right = product(df, proxies, grid(n, m, side))

    def pair(rows: pd.DataFrame, cls: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(cls):
            p, k = matrix(cls["proxy"]), cls["class_idx"].to_numpy()
            for batch, part in rows.groupby("batch"):
                out.append((batch, *proxy_terms(matrix(part["vec"]), part["label"].to_numpy(), p, k, margin, alpha), len(k)))
        return pd.DataFrame(out, columns=["batch", "pos", "n_pos", "neg", "n"])

    parts = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(
        pair, "batch long, pos double, n_pos long, neg double, n long"
    )
    per_batch = parts.groupBy("batch").agg(*[F.sum(c).alias(c) for c in ("pos", "n_pos", "neg", "n")])
    positive = F.coalesce(F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)), F.lit(0.0))
    return per_batch.select("batch", (positive + F.col("neg") / F.col("n")).alias("loss"))
