"""Sequence models: an LSTM autoencoder in numpy, trained and scored in Spark tasks on all sequences.

Encoder LSTM, its last state repeated, decoder LSTM, a dense layer for each step; mean squared
error, Adam, early stopping. reconstruction() is a linear baseline with the same interface.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept as materialised


def latent_size(features: int) -> int:
    return max(4, min(64, 2 * features))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Lstm:
    """One layer. Weights: input, state and bias of the gates input, forget, output, candidate."""

    size: int
    inputs: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, rng: np.random.Generator) -> Lstm:
        limit = np.sqrt(6 / (self.inputs + 4 * self.size))
        q, _ = np.linalg.qr(rng.normal(size=(4 * self.size, self.size)))
        bias = np.zeros(4 * self.size)
        bias[self.size : 2 * self.size] = 1.0
        self.weights = {"w": rng.uniform(-limit, limit, (self.inputs, 4 * self.size)), "u": q.T.copy(), "b": bias}
        return self

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c, out, kept, s = np.zeros((n, self.size)), np.zeros((n, self.size)), np.zeros((n, steps, self.size)), [], self.size
        for t in range(steps):
            z = x[:, t] @ self.weights["w"] + h @ self.weights["u"] + self.weights["b"]
            i, f, o, g = _sigmoid(z[:, :s]), _sigmoid(z[:, s : 2 * s]), _sigmoid(z[:, 2 * s : 3 * s]), np.tanh(z[:, 3 * s :])
            before, c = c, f * c + i * g
            tanh = np.tanh(c)
            kept.append((x[:, t], h, before, i, f, o, g, tanh))
            h = o * tanh
            out[:, t] = h
        return out, kept

    def backward(self, grad: np.ndarray, kept: list) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        n, steps, _ = grad.shape
        dx = np.zeros((n, steps, self.inputs))
        total = {k: np.zeros_like(v) for k, v in self.weights.items()}
        dh, dc = np.zeros((n, self.size)), np.zeros((n, self.size))
        for t in reversed(range(steps)):
            x, h, before, i, f, o, g, tanh = kept[t]
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - tanh**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], 1)
            total["w"] += x.T @ dz
            total["u"] += h.T @ dz
            total["b"] += dz.sum(0)
            dx[:, t], dh, dc = dz @ self.weights["w"].T, dz @ self.weights["u"].T, dc * f
        return dx, total


@dataclass
class Adam:
    """The optimiser's state over all weights in a row: moving means of gradients and of their squares."""

    first: np.ndarray
    second: np.ndarray
    step: int = 0

    def change(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        return rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-7)


@dataclass
class Autoencoder:
    features: int
    latent: int
    encoder: Lstm
    decoder: Lstm
    dense: dict[str, np.ndarray]
    history: list[tuple[float, float]] = field(default_factory=list)

    @classmethod
    def start(cls, features: int, seed: int = 42) -> Autoencoder:
        rng, latent = np.random.default_rng(seed), latent_size(features)
        limit = np.sqrt(6 / (latent + features))
        dense = {"w": rng.uniform(-limit, limit, (latent, features)), "b": np.zeros(features)}
        return cls(features, latent, Lstm(latent, features).start(rng), Lstm(latent, latent).start(rng), dense)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        coded, kept = self.encoder.forward(x)
        repeated = np.repeat(coded[:, -1:, :], x.shape[1], 1)
        out, kept2 = self.decoder.forward(repeated)
        return out @ self.dense["w"] + self.dense["b"], (kept, out, kept2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0]

    def loss_and_gradient(self, x: np.ndarray) -> tuple[float, list[tuple[dict, dict]]]:
        y, (kept, out, kept2) = self._forward(x)
        error = y - x
        d = 2 * error / error.size
        flat, flat_out = d.reshape(-1, self.features), out.reshape(-1, self.latent)
        dense = {"w": flat_out.T @ flat, "b": flat.sum(0)}
        repeated, decoder = self.decoder.backward(d @ self.dense["w"].T, kept2)
        last = np.zeros_like(repeated)
        last[:, -1] = repeated.sum(1)
        _, encoder = self.encoder.backward(last, kept)
        return float((error**2).mean()), [(self.dense, dense), (self.decoder.weights, decoder), (self.encoder.weights, encoder)]

    def fit(self, x: np.ndarray, epochs: int = 40, batch: int = 128, patience: int = 5, validation: float = 0.15, rate: float = 1e-3, seed: int = 42) -> Autoencoder:
        """Adam; the last share of a shuffle is for validation if there are over 100 sequences; stops
        when its loss (else the training loss) hasn't fallen for patience epochs; keeps the best."""
        rng = np.random.default_rng(seed)
        x = x[rng.permutation(len(x))]
        held = int(len(x) * validation) if len(x) > 100 else 0
        train, check = x[: len(x) - held], x[len(x) - held :]
        adam = Adam(np.zeros_like(self.flat()), np.zeros_like(self.flat()))
        best, since, saved = np.inf, 0, None
        for _ in range(epochs):
            order = rng.permutation(len(train))
            losses = [self._step(train[order[at : at + batch]], adam, rate) for at in range(0, len(train), batch)]
            value = float(((self.predict(check) - check) ** 2).mean()) if held else float(np.mean(losses))
            self.history.append((float(np.mean(losses)), value))
            if value < best - 1e-9:
                best, since, saved = value, 0, self.flat()
            elif (since := since + 1) >= patience:
                break
        if saved is not None:
            self.load(saved)
        return self

    def _step(self, x: np.ndarray, adam: Adam, rate: float) -> float:
        loss, parts = self.loss_and_gradient(x)
        self.load(self.flat() - adam.change(np.concatenate([g[k].ravel() for w, g in parts for k in w]), rate))
        return loss

    def fit_all(
        self,
        sequences: DataFrame,
        key: list[str],
        epochs: int = 40,
        batch: int = 128,
        patience: int = 5,
        validation: float = 0.15,
        rate: float = 1e-3,
        seed: int = 42,
        part_rows: int = 20_000,
        most_parts: int = 256,
    ) -> Autoencoder:
        """fit() on the column steps of all sequences; no row reaches the driver, and none is left out.

        Rows are dealt by a hash of key to parts of about part_rows (larger ones from most_parts parts
        on, as a part is streamed and not held). In an epoch each part takes Adam's steps from the
        same weights, and weights and moments are averaged by the parts' rows: local SGD with one
        exchange an epoch. The driver gets three numbers a weight from each part. A hash chooses the
        rows for validation, if there are over 100 sequences; otherwise all are checked. Their loss is
        taken in the next pass, with the weights it begins with, so that history starts with those
        before training. The same rows give the same weights, however they are partitioned, but for
        rounding. Without rows nothing changes.
        """
        draw = F.xxhash64(*key, F.lit(seed))
        rows = materialised(sequences.select(draw.alias("draw"), "steps"))
        n = rows.count()
        if not n:
            return self
        held = F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * validation if n > 100 else 0)
        parts = min(-(-n // part_rows), most_parts)
        rows = rows.withColumn("held", held).repartition(parts, "draw").sortWithinPartitions("draw", "steps")
        rows = materialised(rows.select("steps", "held"))
        all_checked = not rows.filter("held").limit(1).count()
        features, context = self.features, rows.sparkSession.sparkContext

        def one_pass(weights: np.ndarray, adam: Adam, epoch: int, train: bool) -> tuple[np.ndarray, Adam, float, float]:
            shared = context.broadcast((weights, adam.first, adam.second))  # bounded by features and latent size
            before = adam.step

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                now, still = Autoencoder.start(features), Autoencoder.start(features)
                now.load(shared.value[0])
                still.load(shared.value[0])
                own, rng = Adam(shared.value[1].copy(), shared.value[2].copy(), before), np.random.default_rng([seed, epoch])
                learnt, checked, loss, check = 0, 0, 0.0, 0.0
                for some in batches:
                    if not some.num_rows:
                        continue
                    x = some.column(0).flatten().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1, features)
                    aside = some.column(1).to_numpy(zero_copy_only=False).astype(bool)
                    tested, x = (x, x) if all_checked else (x[aside], x[~aside])
                    if len(tested):
                        check += float(((still.predict(tested) - tested) ** 2).mean()) * len(tested)
                        checked += len(tested)
                    order = rng.permutation(len(x)) if train else []
                    for at in range(0, len(order), batch):
                        taken = x[order[at : at + batch]]
                        loss += now._step(taken, own, rate) * len(taken)
                        learnt += len(taken)
                if learnt or checked:
                    state = [np.concatenate([now.flat(), own.first, own.second]).tolist()]
                    yield pa.RecordBatch.from_pydict({"learnt": [learnt], "checked": [checked], "loss": [loss], "check": [check], "step": [own.step], "state": state})

            got = rows.mapInArrow(run, "learnt long, checked long, loss double, check double, step long, state array<double>").collect()
            shared.destroy()
            learnt, value = sum(r["learnt"] for r in got), sum(r["check"] for r in got) / max(1, sum(r["checked"] for r in got))
            if not learnt:
                return weights, adam, value, np.nan
            mean = sum(np.array(r["state"]) * (r["learnt"] / learnt) for r in got)
            weights, first, second = np.split(mean, 3)
            return weights, Adam(first, second, max(r["step"] for r in got)), value, sum(r["loss"] for r in got) / learnt

        weights = saved = self.flat()
        adam, best, since = Adam(np.zeros_like(weights), np.zeros_like(weights)), np.inf, 0
        for epoch in range(epochs + 1):
            after, adam, value, loss = one_pass(weights, adam, epoch, epoch < epochs)
            self.history.append((loss, value))
            if value < best - 1e-9:
                best, since, saved = value, 0, weights
            elif (since := since + 1) >= patience:
                break
            weights = after
        self.load(saved)
        return self

    def flat(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([v.ravel() for w in (self.dense, self.decoder.weights, self.encoder.weights) for v in w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for w in (self.dense, self.decoder.weights, self.encoder.weights):
            for v in w.values():
                v[...] = flat[at : at + v.size].reshape(v.shape)
                at += v.size


@dataclass
class Persistence:
    """A forecaster: the next step is the last one; one step, or flat, a row of features."""

    flat: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x[:, -1] if self.flat else x[:, -1:]


@dataclass
class Linear:
    """A linear reconstruction from the first principal components: a baseline, not the autoencoder."""

    mean: np.ndarray
    axes: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1) - self.mean
        return (flat @ self.axes.T @ self.axes + self.mean).reshape(x.shape)


def reconstruction(x: np.ndarray, components: int = 4) -> Linear:
    flat = x.reshape(len(x), -1)
    mean = flat.mean(0)
    return Linear(mean, np.linalg.svd(flat - mean, full_matrices=False)[2][:components])


def reconstruction_of(sequences: DataFrame, components: int = 4) -> Linear:
    """reconstruction() of all sequences: each task sends its number of rows, their mean and the
    products of what they differ from it by; the driver adds these up."""
    at = sequences.columns.index("steps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                flat = np.array(batch.column(at).to_pylist(), float).reshape(batch.num_rows, -1)
                mean = flat.mean(0)
                own = len(flat), mean, (flat - mean).T @ (flat - mean)
                total = own if total is None else _joined(total, own)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"n": [total[0]], "mean": [total[1].tolist()], "products": [total[2].ravel().tolist()]})

    rows = sequences.mapInArrow(run, "n long, mean array<double>, products array<double>").collect()
    if not rows:
        raise ValueError("no sequences")
    total = None
    for r in rows:
        mean = np.array(r["mean"])
        own = r["n"], mean, np.array(r["products"]).reshape(len(mean), -1)
        total = own if total is None else _joined(total, own)
    return Linear(total[1], np.linalg.eigh(total[2])[1].T[::-1][:components])


def _joined(a: tuple, b: tuple) -> tuple:
    """Rows, mean and products of the rows of both."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def errors(sequences: DataFrame, model, target: str | None = None) -> DataFrame:
    """sequences with error and error_by_feature, by the shape of what the model gives: as many steps
    as it got are a reconstruction, compared with steps; one step (or a row of features) is a
    forecast, compared with the column target. Mean squares. Another shape is a ValueError."""
    spark = sequences.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by features and latent size
    schema = sequences.select("*", F.lit(0.0).alias("error"), F.array(F.lit(0.0)).alias("error_by_feature")).schema
    at, to = sequences.columns.index("steps"), sequences.columns.index(target) if target else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(at).to_pylist(), float)
            y = shared.value.predict(x)
            if y.ndim == 2:
                y = y[:, None]
            if y.ndim == 3 and y.shape[1] == x.shape[1] and to is None:
                square = (y - x) ** 2
            elif y.ndim == 3 and y.shape[1] == 1 and to is not None:
                square = (y - np.array(batch.column(to).to_pylist(), float)[:, None]) ** 2
            else:
                raise ValueError(f"a model that gives {y.shape} for {x.shape}, with target {target}")
            by_feature = square.mean(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(square.mean((1, 2))), pa.array(by_feature.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "error", "error_by_feature"])

    return sequences.mapInArrow(run, schema)
