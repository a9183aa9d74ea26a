"""A residual 1-D convolutional network over event sequences: training, forward pass and filter.

Weights are a dictionary of arrays (convolutions with their normalisations folded in), stored as a
Parquet table of (name, shape, values), and broadcast: under a million numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.functions.scratch import stored

#: Channels in, channels out, stride of each residual block.
BLOCKS = [(32, 64, 1), (64, 64, 1), (64, 128, 2), (128, 128, 1), (128, 256, 2), (256, 256, 1)]
STEM, HEAD, OUT = (4, 32, 7), 128, 3


def random_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"stem": (STEM[1], STEM[0], STEM[2]), "stem_b": (STEM[1],), "fc1": (HEAD, BLOCKS[-1][1]), "fc1_b": (HEAD,), "fc2": (OUT, HEAD), "fc2_b": (OUT,)}
    for i, (a, b, stride) in enumerate(BLOCKS):
        shapes |= {f"r{i}_1": (b, a, 3), f"r{i}_1b": (b,), f"r{i}_2": (b, b, 3), f"r{i}_2b": (b,)}
        if a != b or stride != 1:
            shapes |= {f"r{i}_s": (b, a, 1), f"r{i}_sb": (b,)}
    return {k: (rng.standard_normal(s) * np.sqrt(2 / np.prod(s[1:])) if len(s) > 1 else np.zeros(s)).astype("f4") for k, s in shapes.items()}


def _met(j: int, k: int, stride: int, length: int, steps: int) -> tuple[slice, slice]:
    """The steps whose tap j lies on the input, and the places it lies on."""
    pad = k // 2
    lo, hi = max(0, -((j - pad) // stride)), min(steps, (length - 1 + pad - j) // stride + 1)
    return (slice(lo, hi), slice(lo * stride + j - pad, (hi - 1) * stride + j - pad + 1, stride)) if hi > lo else (slice(0, 0), slice(0, 0))


class Room:
    """Arrays by name, used again by the next call: the system clears new ones page by page, which takes as long as the work in them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size, held = math.prod(shape), self.held.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self.held[name] = np.empty(size, kind)
        return held[:size].reshape(shape)


def spans(x: np.ndarray, k: int, stride: int, room: Room) -> np.ndarray:
    """(n * steps, k * channels): what each step of a convolution over (n, length, channels), padded to keep the length,
    looks at, so that it is one product. All have one room: they are made again where they are needed again."""
    n, length, c = x.shape
    steps = (length - 1) // stride + 1
    out = room("spans", (n, steps, k, c), x.dtype)
    for j in range(k):
        here, there = _met(j, k, stride, length, steps)
        out[:, : here.start, j], out[:, here.stop :, j], out[:, here, j] = 0, 0, x[:, there]
    return out.reshape(n * steps, k * c)


def _flat(w: np.ndarray) -> np.ndarray:
    """(taps * in, out) of (out, in, taps), as spans() has its columns."""
    return np.ascontiguousarray(w.transpose(2, 1, 0)).reshape(-1, w.shape[0])


def _conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, stride: int, room: Room, name: str) -> np.ndarray:
    """(n, steps, out) of (n, length, in), in the room of that name."""
    seen = spans(x, w.shape[2], stride, room)
    out = np.matmul(seen, _flat(w), out=room(name, (len(seen), len(w)), np.result_type(x, w)))
    out += b
    return out.reshape(len(x), -1, len(w))


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, stride: int = 1) -> np.ndarray:
    """(n, channels, length) by (out, in, taps), padded to keep the length."""
    return _conv(x.transpose(0, 2, 1), w, b, stride, Room(), "out").transpose(0, 2, 1)


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0, out=x)


def _layers(x: np.ndarray, w: dict[str, np.ndarray], room: Room) -> list[np.ndarray]:
    """The stem's output, and of each block what is between its convolutions and what comes out."""
    kept = [_relu(_conv(x, w["stem"], w["stem_b"], 1, room, "stem"))]
    for i, (_, _, stride) in enumerate(BLOCKS):
        a = kept[-1]
        h = _relu(_conv(a, w[f"r{i}_1"], w[f"r{i}_1b"], stride, room, f"h{i}"))
        z = _conv(h, w[f"r{i}_2"], w[f"r{i}_2b"], 1, room, f"z{i}")
        z += _conv(a, w[f"r{i}_s"], w[f"r{i}_sb"], stride, room, "aside") if f"r{i}_s" in w else a
        kept += [h, _relu(z)]
    return kept


def forward(x: np.ndarray, w: dict[str, np.ndarray], room: Room | None = None) -> np.ndarray:
    """Probabilities of real, rain and snow for (n, length, 4) sequences."""
    x = _layers(x.astype("f4"), w, room or Room())[-1]
    h = np.maximum(x.mean(axis=1) @ w["fc1"].T + w["fc1_b"], 0)
    z = h @ w["fc2"].T + w["fc2_b"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score(rows: DataFrame, weights: dict[str, np.ndarray], seq: str = "seq", batch: int = 16) -> DataFrame:
    """rows with p_real, p_rain, p_snow from their sequence column."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("p_real double, p_rain double, p_snow double")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        room = Room()
        for part in parts:
            found = [forward(np.stack(part.iloc[i : i + batch].to_list()).reshape(-1, part.iloc[i].size // STEM[0], STEM[0]), shared.value, room) for i in range(0, len(part), batch)]
            yield pd.DataFrame(np.concatenate(found).astype("f8") if found else np.empty((0, 3)), columns=["p_real", "p_rain", "p_snow"])

    out = rows.withColumn("_p", apply(F.flatten(seq)))  # one array a row: nested ones come as an object a step
    return out.select(*rows.columns, "_p.*")


def _conv_back(x: np.ndarray, w: np.ndarray, dy: np.ndarray, stride: int, room: Room, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _conv() sends back: to its input (in the room of that name), its weights and its constants."""
    (o, c, k), (n, length, _), steps = w.shape, x.shape, dy.shape[1]
    d, kind = dy.reshape(-1, o), np.result_type(dy, w)
    dw = (spans(x, k, stride, room).T @ d).reshape(k, c, o).transpose(2, 1, 0)
    back = np.matmul(d, _flat(w).T, out=room("back", (len(d), k * c), kind)).reshape(n, steps, k, c)
    dx = room(name, x.shape, kind)
    dx[:] = 0
    for j in range(k):
        here, there = _met(j, k, stride, length, steps)
        dx[:, there] += back[:, here, j]
    return dx, dw, d.sum(axis=0)


def gradients(x: np.ndarray, y: np.ndarray, share: np.ndarray, w: dict[str, np.ndarray], room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """The mean weighted cross-entropy of classes y (their weights: share), and its gradient."""
    x0, room = x.astype("f4"), room or Room()
    kept = _layers(x0, w, room)
    a = kept[-1]
    mean = a.mean(axis=1)
    head = np.maximum(mean @ w["fc1"].T + w["fc1_b"], 0)
    z = head @ w["fc2"].T + w["fc2_b"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    p, of = e / e.sum(axis=1, keepdims=True), share[y]
    loss = float(-(of * np.log(p[np.arange(len(y)), y] + 1e-9)).sum() / of.sum())
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    d *= (of / of.sum())[:, None]
    g = {"fc2": d.T @ head, "fc2_b": d.sum(axis=0)}
    d = (d @ w["fc2"]) * (head > 0)
    g |= {"fc1": d.T @ mean, "fc1_b": d.sum(axis=0)}
    d = np.repeat((d @ w["fc1"])[:, None] / a.shape[1], a.shape[1], axis=1)
    for i in reversed(range(len(BLOCKS))):
        a, h, out = kept[2 * i : 2 * i + 3]
        stride = BLOCKS[i][2]
        d *= out > 0
        dh, g[f"r{i}_2"], g[f"r{i}_2b"] = _conv_back(h, w[f"r{i}_2"], d, 1, room, "dh")
        dh *= h > 0
        da, g[f"r{i}_1"], g[f"r{i}_1b"] = _conv_back(a, w[f"r{i}_1"], dh, stride, room, f"da{i % 2}")
        if f"r{i}_s" in w:
            ds, g[f"r{i}_s"], g[f"r{i}_sb"] = _conv_back(a, w[f"r{i}_s"], d, stride, room, "ds")
            da += ds
        else:
            da += d
        d = da
    d *= kept[0] > 0
    _, g["stem"], g["stem_b"] = _conv_back(x0, w["stem"], d, 1, room, "dx")
    return loss, g


#: Rows that a task learns from in an epoch, about: the more rows there are, the more tasks.
TASK_ROWS = 1000
#: Weights that are averaged together.
PIECE = 65_536


def _averaged(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("part")
    flat = sum(np.frombuffer(p, "f4") for p in pieces["weights"])
    return pd.DataFrame({"piece": pieces["piece"].iloc[:1], "loss": [pieces["loss"].sum()], "weights": [flat.tobytes()]}, index=pieces.index[:1])


def train(rows: DataFrame, epochs: int = 12, batch: int = 16, rate: float = 1e-3, tasks: int = 4, seed: int = 42, seq: str = "seq", label: str = "cls") -> tuple[dict[str, np.ndarray], DataFrame]:
    """(weights, losses (epoch, loss)) learned from all rows of sequences and classes 0 to 2.

    Data-parallel: in each epoch every task (``tasks``, or one for each TASK_ROWS rows if these are more) takes Adam
    steps over its rows from the shared weights. The tasks' weights are averaged by their numbers of rows, in pieces
    that are shuffled: one model, under four megabytes, comes to the driver. Classes weigh in inversely to their frequency."""
    spark = rows.sparkSession
    kept = stored(rows.select(F.flatten(seq).cast("array<float>").alias("seq"), F.col(label).cast("int").alias("cls")))
    counts = {r.cls: r["count"] for r in kept.groupBy("cls").count().collect()}  # three rows
    if not counts:
        raise ValueError("no labelled rows")
    n = sum(counts.values())
    share = np.array([n / counts[c] if c in counts else 0.0 for c in range(OUT)], "f4")
    tasks, place = max(tasks, math.ceil(n / TASK_ROWS)), F.xxhash64(F.lit(seed), "seq", "cls")
    dealt = kept.repartitionById(tasks, F.pmod(place, F.lit(tasks)).cast("int")).sortWithinPartitions(place).persist()  # every epoch reads it
    weights = random_weights(seed)
    for i in range(len(BLOCKS)):
        weights[f"r{i}_2"] *= 0.3  # blocks begin near the identity
    losses = []
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast(weights)
        step = rate * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)))

        def learn(batches: Iterator[pd.DataFrame], shared=shared, step=step, epoch=epoch) -> Iterator[pd.DataFrame]:
            own = [b for b in batches if len(b)]
            if not own:
                return
            y = np.concatenate([b["cls"].to_numpy("i4") for b in own])
            x = np.concatenate([np.stack(b["seq"].to_list()) for b in own]).astype("f4").reshape(len(y), -1, STEM[0])
            w = {k: v.copy() for k, v in shared.value.items()}
            m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
            room = Room()
            order, total, steps = np.random.default_rng([seed, epoch, len(y)]).permutation(len(y)), 0.0, 0
            for a in range(0, len(y), batch):
                at = order[a : a + batch]
                loss, g = gradients(x[at], y[at], share, w, room)
                total, steps = total + loss * len(at), steps + 1
                for k in w:
                    m[k] += np.float32(0.1) * (g[k] - m[k])
                    v[k] += np.float32(0.001) * (g[k] * g[k] - v[k])
                    move = np.sqrt(v[k] * np.float32(1 / (1 - 0.999**steps)))
                    move += np.float32(1e-8)
                    np.divide(m[k], move, out=move)
                    move *= np.float32(step / (1 - 0.9**steps))
                    w[k] *= np.float32(1 - step * 1e-4)
                    w[k] -= move
            flat = np.concatenate([w[k].ravel() for k in sorted(w)]) * np.float32(len(y) / n)
            for i, a in enumerate(range(0, len(flat), PIECE)):
                yield pd.DataFrame({"piece": [i], "part": [TaskContext.get().partitionId()], "loss": [total if i == 0 else 0.0], "weights": [flat[a : a + PIECE].astype("f4").tobytes()]})

        parts = dealt.mapInPandas(learn, "piece int, part int, loss double, weights binary")
        pieces = sorted(parts.groupBy("piece").applyInPandas(_averaged, "piece int, loss double, weights binary").collect())
        flat, at = np.frombuffer(b"".join(r.weights for r in pieces), "f4"), 0
        for k in sorted(weights):
            weights[k] = flat[at : at + weights[k].size].reshape(weights[k].shape)
            at += weights[k].size
        shared.unpersist()
        losses.append((epoch, pieces[0].loss / n))
    dealt.unpersist()
    return weights, spark.createDataFrame(losses, "epoch int, loss double")


def real_tracks(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.where(F.col("p_rain") + F.col("p_snow") <= threshold)


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    rows = [(k, list(map(int, v.shape)), v.ravel().tolist()) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<float>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r["values"], "f4").reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
