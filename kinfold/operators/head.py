"""Projection head: (linear, batch norm, GELU, dropout) per hidden layer, linear, L2 norm."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kinfold.functions.vectors import TORCH_EPS, matrix

BN_EPS = 1e-5
_GRID = np.linspace(-6.0, 6.0, 6145)
_ERF = np.array([math.erf(v) for v in _GRID])
_SLOPE = 2.0 / math.sqrt(math.pi) * np.exp(-_GRID**2)


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by cubic Hermite interpolation of exact values (error below 1e-12)."""
    t = np.clip(x, -6.0, 6.0)
    step = _GRID[1] - _GRID[0]
    i = np.minimum(((t + 6.0) / step).astype(int), len(_GRID) - 2)
    u = (t - _GRID[i]) / step
    a, b, c, d = _ERF[i], _ERF[i + 1], _SLOPE[i] * step, _SLOPE[i + 1] * step
    return a + u * (c + u * (3 * (b - a) - 2 * c - d + u * (2 * (a - b) + c + d)))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + erf(x / math.sqrt(2.0))) + x * np.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


@dataclass
class Head:
    """Learned parameters by name, plus the running statistics of the batch norms."""

    dims: list[int]
    params: dict[str, np.ndarray] = field(default_factory=dict)
    running: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def n_hidden(self) -> int:
        return len(self.dims) - 2

    @classmethod
    def create(cls, input_dim: int, hidden: list[int] | None = None, output_dim: int = 128, seed: int = 42) -> "Head":
        rng = np.random.default_rng(seed)
        head = cls([input_dim, *([1024] if hidden is None else hidden), output_dim])
        for i, (n_in, n_out) in enumerate(zip(head.dims[:-1], head.dims[1:])):
            bound = 1.0 / math.sqrt(n_in)
            head.params[f"w{i}"] = rng.uniform(-bound, bound, (n_out, n_in))
            head.params[f"b{i}"] = rng.uniform(-bound, bound, n_out)
            if i < head.n_hidden:
                head.params[f"g{i}"], head.params[f"s{i}"] = np.ones(n_out), np.zeros(n_out)
                head.running[f"mean{i}"], head.running[f"var{i}"] = np.zeros(n_out), np.ones(n_out)
        return head

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Evaluation mode: running statistics, no dropout."""
        p = self.params
        for i in range(self.n_hidden):
            x = x @ p[f"w{i}"].T + p[f"b{i}"]
            x = (x - self.running[f"mean{i}"]) / np.sqrt(self.running[f"var{i}"] + BN_EPS) * p[f"g{i}"] + p[f"s{i}"]
            x = gelu(x)
        x = x @ p[f"w{self.n_hidden}"].T + p[f"b{self.n_hidden}"]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TORCH_EPS)


def save_head(spark: SparkSession, head: Head, path: str) -> None:
    """Write a head as a small table: one row per parameter."""
    parts = {"dims": np.array(head.dims, float), **{f"p:{k}": v for k, v in head.params.items()}, **{f"r:{k}": v for k, v in head.running.items()}}
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in parts.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_head(spark: SparkSession, path: str) -> Head:
    parts = {r.name: np.array(r.data).reshape(r.shape) for r in spark.read.parquet(path).collect()}  # as large as the model
    head = Head([int(v) for v in parts.pop("dims")])
    for name, value in parts.items():
        (head.params if name.startswith("p:") else head.running)[name[2:]] = value
    return head


def project(df: DataFrame, head: Head, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """(id, embedding): vectors sent through the trained head, batch by Arrow batch; the head is shipped once."""
    shipped = df.sparkSession.sparkContext.broadcast(head)
    kind = df.schema[id_col].dataType.simpleString()
    width = head.dims[0]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["v"])
                if x.shape[1] != width:
                    raise ValueError(f"vectors have {x.shape[1]} items, the head expects {width}")
                yield pd.DataFrame({"id": pdf["id"], "embedding": list(shipped.value.forward(x))})

    out = df.selectExpr(f"`{id_col}` as id", f"cast(`{vec}` as array<double>) as v").mapInPandas(
        run, f"id {kind}, embedding array<double>"
    )
    return out.withColumnRenamed("id", id_col)
