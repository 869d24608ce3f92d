"""Sequence embedding: a pluggable residue embedder run over prepared batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("bisect", "drop")
Embedder = Callable[[list[str]], list[np.ndarray]]


class CodePointEmbedder:
    """Deterministic stand-in for a protein language model (no weights are available offline).

    Residue ``c`` maps to ``((code(c) * (j + 1)) % 97) / 97`` in dimension ``j``. It has no biological meaning.
    """

    def __init__(self, dim: int = 8) -> None:
        self.factor = np.arange(1, dim + 1)

    def __call__(self, seqs: list[str]) -> list[np.ndarray]:
        out = []
        for s in seqs:
            codes = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            out.append((codes[:, None] * self.factor[None, :]) % 97 / 97.0)
        return out


_model: dict[str, Embedder] = {}


def _load(factory: Callable[[], Embedder], name: str) -> Embedder:
    """One model per Python worker, however many batches it sees; a closure is another object in each task, so the model goes by its name."""
    if name not in _model:
        _model.clear()
        _model[name] = factory()
    return _model[name]


def _run(model: Embedder, seqs: list[str], policy: str) -> list[np.ndarray | None]:
    """Embed a batch; on a runtime error halve it and retry, or give the whole batch up."""
    try:
        return list(model(seqs))
    except RuntimeError:
        if policy == "drop" or len(seqs) == 1:
            return [None] * len(seqs)
        half = len(seqs) // 2
        return _run(model, seqs[:half], policy) + _run(model, seqs[half:], policy)


def embed(
    batches: DataFrame,
    factory: Callable[[], Embedder] = CodePointEmbedder,
    policy: str = "bisect",
    pool: bool = True,
    half_precision: bool = True,
    name: str | None = None,
) -> DataFrame:
    """(key, status, length, embedding) from (bucket, batch, key, sequence).

    ``name`` identifies the model within a worker: models that differ need names that differ. By default one call is one model.

    ``pool`` averages over the residues, otherwise the matrix of residue vectors is kept. ``half_precision`` rounds
    through float16, the precision of the store. Rows the model fails on come back as ``failed`` without a vector.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    name = name or uuid.uuid4().hex

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _run(_load(factory, name), pdf["sequence"].tolist(), policy)
        vectors = []
        for m in found:
            if m is not None:
                m = m.mean(axis=0) if pool else m
                m = m.astype(np.float16).astype(np.float64) if half_precision else m
                m = m if pool else list(m)
            vectors.append(m)
        return pd.DataFrame({
            "key": pdf["key"],
            "status": ["failed" if m is None else "embedded" for m in found],
            "length": pdf["sequence"].str.len(),
            "embedding": vectors,
        })

    kind = "array<double>" if pool else "array<array<double>>"
    slim = batches.select("bucket", "batch", "key", "sequence")
    key_type = slim.schema["key"].dataType.simpleString()
    return slim.groupBy("bucket", "batch").applyInPandas(one, f"key {key_type}, status string, length long, embedding {kind}")


def stats() -> list[Column]:
    """Counters of a run, to be observed while its result is written."""
    done = F.col("status") == "embedded"
    return [
        F.count_if(done).alias("n_embedded"),
        F.count_if(~done).alias("n_failed"),
        F.coalesce(F.avg(F.when(done, F.col("length"))), F.lit(0.0)).alias("avg_length"),
    ]


def embed_stats(result: DataFrame) -> DataFrame:
    return result.agg(*stats())
