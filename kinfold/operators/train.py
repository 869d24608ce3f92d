"""Data-parallel training of the projection head.

An epoch is a pseudo-random order cut into batches. One optimiser step takes ``world_size`` batches, each handled
by its own task with its own loss, and averages their gradients, as data-parallel training on several devices does;
``world_size=1`` is the single-device case. The averaging runs on Spark; the driver holds the model and its optimiser
state, never the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import TORCH_EPS, matrix
from kinfold.operators.batching import epoch_batches
from kinfold.operators.head import BN_EPS, Head, gelu, gelu_slope
from kinfold.operators.losses import EPS
from kinfold.session import checkpoint

LOSSES = ("supcon", "proxy_anchor")
GRAD_PART = 1 << 16


@dataclass
class TrainConfig:
    """Defaults of the published run configuration."""

    loss_type: str = "proxy_anchor"
    temperature: float = 0.07
    margin: float = 0.2
    alpha: float = 32.0
    hidden: list[int] = field(default_factory=lambda: [1024])
    output_dim: int = 128
    dropout: float = 0.2
    batch_size: int = 1024
    world_size: int = 1
    lr: float = 1e-3
    weight_decay: float = 1e-4
    eps: float = 1e-8
    betas: tuple[float, float] = (0.9, 0.999)
    epochs: int = 1000
    warmup_epochs: int = 20
    min_lr: float = 1e-6
    clip: float = 1.0
    patience: int = 15
    min_delta: float = 1e-4
    seed: int = 42

    def __post_init__(self) -> None:
        if self.loss_type not in LOSSES:
            raise ValueError(f"unknown loss type {self.loss_type!r}; one of {LOSSES}")
        if self.temperature <= 0:
            raise ValueError("temperature must be positive")

    def override(self, **values) -> "TrainConfig":
        unknown = set(values) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return TrainConfig(**{**self.__dict__, **values})


def lr_at(epoch: Column, lr: float = 1e-3, warmup: int = 20, epochs: int = 1000, min_lr: float = 1e-6) -> Column:
    """Learning rate of an epoch: linear warm-up from half, then cosine decay to ``min_lr``."""
    cosine = (F.lit(1.0) + F.cos(F.lit(math.pi) * (epoch - warmup) / F.lit(float(epochs - warmup)))) / 2
    return F.when(epoch < warmup, F.lit(lr) * (0.5 + 0.5 * epoch / F.lit(float(warmup)))).otherwise(
        F.lit(min_lr) + F.lit(lr - min_lr) * cosine
    )


def lr_value(epoch: int, cfg: TrainConfig) -> float:
    if epoch < cfg.warmup_epochs:
        return cfg.lr * (0.5 + 0.5 * epoch / cfg.warmup_epochs)
    angle = math.pi * (epoch - cfg.warmup_epochs) / (cfg.epochs - cfg.warmup_epochs)
    return cfg.min_lr + (cfg.lr - cfg.min_lr) * (1 + math.cos(angle)) / 2


def early_stop(history: DataFrame, patience: int = 15, min_delta: float = 1e-4) -> DataFrame:
    """(epoch, val_loss, best, waited, stopped) for one run's history (epoch, val_loss): one row per epoch.

    An epoch improves when it undercuts the best so far by more than ``min_delta``; training stops after ``patience``
    epochs in a row without improvement, later epochs are marked as stopped.
    """
    state = "struct<best:double,waited:int,stopped:boolean>"
    seed = F.expr(f"cast(named_struct('best', double('infinity'), 'waited', 0, 'stopped', false) as {state})")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        better = x["val_loss"] < last["best"] - F.lit(min_delta)
        waited = F.when(better, F.lit(0)).otherwise(last["waited"] + 1)
        new = F.struct(
            F.when(better, x["val_loss"]).otherwise(last["best"]).alias("best"),
            waited.alias("waited"),
            (waited >= patience).alias("stopped"),
        )
        return F.concat(acc, F.array(F.when(last["stopped"], last).otherwise(new.cast(state))))

    # an epoch per row: a history has at most as many rows as the run has epochs
    packed = history.agg(F.sort_array(F.collect_list(F.struct("epoch", "val_loss"))).alias("h"))
    folded = packed.select("h", F.aggregate("h", F.array(seed), step).alias("s"))
    rows = folded.select(F.posexplode("h").alias("i", "r"), "s")
    s = F.element_at("s", F.col("i") + 2)
    return rows.select("r.epoch", "r.val_loss", s["best"].alias("best"), s["waited"].cast("long").alias("waited"), s["stopped"].alias("stopped"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The checkpoint to keep: smallest validation loss, earliest on a tie."""
    return history.agg(F.min(F.struct("val_loss", "epoch")).alias("b")).select("b.epoch", "b.val_loss")


def init_proxies(num_classes: int, dim: int, seed: int) -> np.ndarray:
    """Normal with the fan-out Kaiming scale."""
    return np.random.default_rng(seed).normal(0.0, math.sqrt(2.0 / num_classes), (num_classes, dim))


def loss_and_grad(z: np.ndarray, y: np.ndarray, cfg: TrainConfig, proxies: np.ndarray | None):
    """Loss of a batch of unit vectors, its gradient by the vectors and by the proxies."""
    if cfg.loss_type == "supcon":
        sim = z @ z.T / cfg.temperature
        sim = sim - sim.max(axis=1, keepdims=True)
        others = ~np.eye(len(z), dtype=bool)
        e = np.exp(sim) * others
        norm = np.maximum(e.sum(axis=1, keepdims=True), EPS)
        positive = (y[:, None] == y[None, :]) & others
        count = np.maximum(positive.sum(axis=1, keepdims=True), EPS)
        loss = -((positive * (sim - np.log(norm))).sum(axis=1) / count[:, 0]).mean()
        has = positive.any(axis=1, keepdims=True)
        g = -(positive / count - has * e / norm) / len(z) / cfg.temperature
        return float(loss), (g + g.T) @ z, None
    length = np.maximum(np.linalg.norm(proxies, axis=1, keepdims=True), TORCH_EPS)
    unit = proxies / length
    cos = z @ unit.T
    own = y[:, None] == np.arange(len(proxies))[None, :]
    pos = np.where(own, np.exp(-cfg.alpha * (cos - cfg.margin)), 0.0)
    neg = np.where(own, 0.0, np.exp(cfg.alpha * (cos + cfg.margin)))
    p, n = pos.sum(axis=0), neg.sum(axis=0)
    present = own.any(axis=0)
    k_pos = max(int(present.sum()), 1)
    loss = np.log1p(p).sum() / k_pos + np.log1p(n).sum() / len(proxies)
    g = cfg.alpha * (neg / (1 + n) / len(proxies) - pos / (1 + p) / k_pos)
    gu = g.T @ z
    return float(loss), g @ unit, (gu - unit * (gu * unit).sum(axis=1, keepdims=True)) / length


def batch_step(head: Head, proxies, x: np.ndarray, y: np.ndarray, cfg: TrainConfig, rng) -> tuple[float, dict, dict]:
    """Training-mode loss, parameter gradients and batch-norm statistics of one batch."""
    p, saved, stats = head.params, [], {}
    for i in range(head.n_hidden):
        a = x @ p[f"w{i}"].T + p[f"b{i}"]
        mean, var = a.mean(axis=0), a.var(axis=0)
        stats[f"mean{i}"], stats[f"var{i}"] = mean, var * len(a) / max(len(a) - 1, 1)
        hat = (a - mean) / np.sqrt(var + BN_EPS)
        pre = hat * p[f"g{i}"] + p[f"s{i}"]
        mask = (rng.random(pre.shape) >= cfg.dropout) / (1 - cfg.dropout) if cfg.dropout else np.ones_like(pre)
        saved.append((x, hat, np.sqrt(var + BN_EPS), pre, mask))
        x = gelu(pre) * mask
    last = head.n_hidden
    out = x @ p[f"w{last}"].T + p[f"b{last}"]
    length = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), TORCH_EPS)
    z = out / length
    loss, gz, gp = loss_and_grad(z, y, cfg, proxies)
    grads = {} if gp is None else {"proxies": gp}
    g = (gz - z * (gz * z).sum(axis=1, keepdims=True)) / length
    grads[f"w{last}"], grads[f"b{last}"] = g.T @ x, g.sum(axis=0)
    g = g @ p[f"w{last}"]
    for i in range(last - 1, -1, -1):
        x, hat, std, pre, mask = saved[i]
        g = g * mask * gelu_slope(pre)
        grads[f"g{i}"], grads[f"s{i}"] = (g * hat).sum(axis=0), g.sum(axis=0)
        g = g * p[f"g{i}"]
        g = (g - g.mean(axis=0) - hat * (g * hat).mean(axis=0)) / std
        grads[f"w{i}"], grads[f"b{i}"] = g.T @ x, g.sum(axis=0)
        g = g @ p[f"w{i}"]
    return loss, grads, stats


@dataclass
class Trained:
    head: Head
    proxies: np.ndarray | None
    history: DataFrame  # epoch, train_loss, val_loss, lr
    best_epoch: int


class _AdamW:
    def __init__(self, params: dict[str, np.ndarray], cfg: TrainConfig) -> None:
        self.params, self.cfg, self.t = params, cfg, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], lr: float) -> None:
        self.t += 1
        b1, b2 = self.cfg.betas
        size = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, self.cfg.clip / (size + 1e-6))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = b1 * self.m[k] + (1 - b1) * g
            self.v[k] = b2 * self.v[k] + (1 - b2) * g * g
            self.params[k] *= 1 - lr * self.cfg.weight_decay
            root = np.sqrt(self.v[k] / (1 - b2**self.t)) + self.cfg.eps
            self.params[k] -= lr * self.m[k] / (1 - b1**self.t) / root


def _gather(batches: DataFrame, head: Head, proxies, cfg: TrainConfig, epoch: int):
    """One optimiser step's mean loss, gradients and statistics over the batches of ``batches``."""
    names = [*head.params, *(["proxies"] if proxies is not None else [])]
    shapes = {k: (proxies if k == "proxies" else head.params[k]).shape for k in names} | {k: v.shape for k, v in head.running.items()}
    shipped = batches.sparkSession.sparkContext.broadcast((head, proxies))

    def grad(pdf: pd.DataFrame) -> pd.DataFrame:
        model, prox = shipped.value
        batch = int(pdf["batch"].iloc[0])
        pdf = pdf.sort_values("id")
        rng = np.random.default_rng([cfg.seed, epoch, batch])
        loss, grads, stats = batch_step(model, prox, matrix(pdf["vec"]), pdf["label"].to_numpy(), cfg, rng)
        flat = np.concatenate([np.ravel({**grads, **stats}[k]) for k in shapes])
        parts = [flat[i : i + GRAD_PART] for i in range(0, len(flat), GRAD_PART)]
        return pd.DataFrame({"part": range(len(parts)), "loss": loss, "n": len(pdf), "values": parts})

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:  # world_size rows
        values = np.mean(np.stack(pdf["values"].to_numpy()), axis=0)
        return pd.DataFrame({
            "part": [pdf["part"].iloc[0]], "loss": [(pdf["loss"] * pdf["n"]).sum()], "n": [pdf["n"].sum()], "values": [values]
        })

    schema = "part int, loss double, n long, values array<double>"
    got = batches.groupBy("batch").applyInPandas(grad, schema).groupBy("part").applyInPandas(mean, schema)
    pdf = got.toPandas().sort_values("part")  # as large as the model
    shipped.destroy()
    flat, out, at = np.concatenate(pdf["values"].to_list()), {}, 0
    for k, shape in shapes.items():
        size = int(np.prod(shape))
        out[k] = flat[at : at + size].reshape(shape)
        at += size
    grads = {k: out[k] for k in names}
    return float(pdf["loss"].iloc[0]), int(pdf["n"].iloc[0]), grads, {k: out[k] for k in head.running}


def evaluate(df: DataFrame, head: Head, proxies, cfg: TrainConfig) -> DataFrame:
    """(dataset, loss): mean loss in evaluation mode over fixed batches of (dataset, batch, id, label, vec)."""
    shipped = df.sparkSession.sparkContext.broadcast((head, proxies))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        model, prox = shipped.value
        loss, _, _ = loss_and_grad(model.forward(matrix(pdf["vec"])), pdf["label"].to_numpy(), cfg, prox)
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "n": [len(pdf)], "loss": [loss]})

    per_batch = df.groupBy("dataset", "batch").applyInPandas(one, "dataset string, n long, loss double")
    return per_batch.groupBy("dataset").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def fit(
    train: DataFrame,
    val: DataFrame,
    cfg: TrainConfig | None = None,
    rank: Column | None = None,
    resume: tuple[Head, np.ndarray | None] | None = None,
) -> Trained:
    """Train on (id, label, vec) with labels 0..k-1, validate on the same shape; returns the best epoch's head.

    ``resume`` continues from given parameters. The rows of an epoch are written once in batch order, so a step reads
    only its own batches.
    """
    cfg = cfg or TrainConfig()
    rows = checkpoint(train.select("id", "label", F.col("vec").cast("array<double>").alias("vec")))
    facts = rows.agg(F.count_distinct("label").alias("k"), F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if resume:
        head, proxies = resume
    else:
        head = Head.create(facts["d"], cfg.hidden, cfg.output_dim, cfg.seed)
        proxies = init_proxies(facts["k"], cfg.output_dim, cfg.seed) if cfg.loss_type == "proxy_anchor" else None
    learned = dict(head.params) | ({"proxies": proxies} if proxies is not None else {})
    optimiser = _AdamW(learned, cfg)
    val_batches = checkpoint(
        epoch_batches(val, "id", 1, cfg.batch_size, F.col("id").cast("long")).drop("epoch").join(val, "id").select(
            F.lit("val").alias("dataset"), "batch", "id", "label", F.col("vec").cast("array<double>").alias("vec")
        )
    )
    n_batches = -(-facts["n"] // cfg.batch_size)
    history, best, best_loss, waited, reference = [], None, math.inf, 0, math.inf
    for epoch in range(cfg.epochs):
        lr = lr_value(epoch, cfg)
        order = epoch_batches(rows, "id", 1, cfg.batch_size, rank if rank is not None else F.xxhash64("id", F.lit(cfg.seed), F.lit(epoch)))
        placed = checkpoint(order.drop("epoch").join(rows, "id").repartitionByRange("batch").sortWithinPartitions("batch"))
        total, seen = 0.0, 0
        for at in range(0, n_batches, cfg.world_size):
            step = placed.where((F.col("batch") >= at) & (F.col("batch") < at + cfg.world_size))
            loss, n, grads, stats = _gather(step, head, proxies, cfg, epoch)
            optimiser.step(grads, lr)
            head.params.update({k: learned[k] for k in head.params})
            proxies = learned.get("proxies")
            for k, v in stats.items():
                head.running[k] = 0.9 * head.running[k] + 0.1 * v
            total, seen = total + loss, seen + n
        val_loss = float(evaluate(val_batches, head, proxies, cfg).first()["loss"])
        history.append((epoch, total / max(seen, 1), val_loss, lr))
        if val_loss < best_loss:
            best_loss = val_loss
            kept = Head(list(head.dims), {k: v.copy() for k, v in head.params.items()}, {k: v.copy() for k, v in head.running.items()})
            best = (epoch, kept, None if proxies is None else proxies.copy())
        if val_loss < reference - cfg.min_delta:
            reference, waited = val_loss, 0
        else:
            waited += 1
            if waited >= cfg.patience:
                break
    table = rows.sparkSession.createDataFrame(history, "epoch long, train_loss double, val_loss double, lr double")
    if best is None:
        best = (-1, head, proxies)
    return Trained(best[1], best[2], table, best[0])
