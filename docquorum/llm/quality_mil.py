"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of characters, over its whole text. A passage is encoded by one
layer from shares of character classes, word shapes and repetition; a gated attention (Ilse et al., 2018) weighs the
passages, and the weighted sum is scored. Encoder, attention and score are learnt together from labels of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import drawn, sample

CHARS = 800
HIDDEN = 16
ATTENTION = 8
CLASSES = " \n.,;:!?|#*$%&<>-_/\\@=\"'()[]{}"
UPPER, LOWER, DIGIT, OTHER = len(CLASSES), len(CLASSES) + 1, len(CLASSES) + 2, len(CLASSES) + 3
WIDTH = len(CLASSES) + 4


def _classes() -> np.ndarray:
    table = np.full(1 << 16, OTHER, np.uint8)
    for code in range(0x250):
        c = chr(code)
        table[code] = (
            CLASSES.index(c) if c in CLASSES else UPPER if c.isupper() else LOWER if c.islower()
            else DIGIT if c.isdigit() else OTHER)
    return table


_TABLE = _classes()


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage; a null or empty text is one passage of zeros."""
    text = text or ""
    n = max(1, -(-len(text) // CHARS))
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    counts = np.bincount(
        np.arange(len(codes)) // CHARS * WIDTH + _TABLE[codes], minlength=n * WIDTH).reshape(n, WIDTH).astype(float)
    size = np.maximum(counts.sum(axis=1), 1)
    letters = np.maximum(counts[:, UPPER] + counts[:, LOWER], 1)
    tokens = text.split()
    shape = np.zeros((n, 4))
    for i in range(n):
        part = tokens[i * len(tokens) // n:(i + 1) * len(tokens) // n]
        if part:
            shape[i] = (
                len(set(part)) / len(part), sum(a == b for a, b in zip(part, part[1:])) / len(part),
                min(len(part), 200) / 200, min(len(part[0]) + len(part[-1]), 60) / 60)
    gaps = counts[:, 0] + counts[:, 1] + 1
    whole = np.array([
        len(set(tokens)) / max(1, len(tokens)), np.log1p(len(tokens)) / 10,
        len(set(text.split("\n"))) / (text.count("\n") + 1)])
    return np.c_[
        np.sqrt(counts / size[:, None]), counts[:, UPPER] / letters, (size - gaps) / gaps / 10, shape,
        np.broadcast_to(whole, (n, 3))]


FEATURES = WIDTH + 9


class Model:
    """Parameters by name, with the mean and spread of the features."""

    def __init__(self, parameters: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.p, self.mean, self.spread = parameters, mean, spread

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probability of label 1 of each bag, and the attention of its passages."""
        begins = np.cumsum([0] + [len(b) for b in bags])
        x = (np.concatenate(bags) - self.mean) / self.spread
        state = _forward(self.p, np.clip(x, -8, 8), begins)
        return state["probability"], np.split(state["a"], begins[1:-1])


def _forward(p: dict, x: np.ndarray, begins: np.ndarray) -> dict:
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["g"]
    e = np.exp(e - np.maximum.reduceat(e, begins[:-1])[owner])
    a = e / np.add.reduceat(e, begins[:-1])[owner]
    z = np.add.reduceat(a[:, None] * h, begins[:-1], axis=0)
    probability = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return {"owner": owner, "h": h, "t": t, "s": s, "a": a, "z": z, "probability": probability}


def _gradients(p: dict, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(p, x, begins)
    owner, h, t, s, a = f["owner"], f["h"], f["t"], f["s"], f["a"]
    off = (f["probability"] - y) / len(y)
    dz = off[:, None] * p["c"]
    da = (h * dz[owner]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, begins[:-1])[owner])
    dgate = de[:, None] * p["g"]
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    dh = (a[:, None] * dz[owner] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
    out = {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "g": (t * s).T @ de,
           "c": f["z"].T @ off, "d": off.sum()}
    return {k: v + 1e-4 * p[k] for k, v in out.items()}


def train(bags: list[np.ndarray], labels: np.ndarray, steps: int = 300, seed: int = 5) -> Model:
    """Full-batch Adam; without both labels the model gives the smoothed share of label 1."""
    r = np.random.default_rng(seed)
    p = {
        "w": r.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
        "v": r.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)), "u": r.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)),
        "g": r.normal(0, ATTENTION ** -0.5, ATTENTION), "c": np.zeros(HIDDEN), "d": np.float64(0),
    }
    share = (labels.sum() + 1) / (len(labels) + 2)
    p["d"] = np.float64(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(p, np.zeros(FEATURES), np.ones(FEATURES))
    x, begins = np.concatenate(bags), np.cumsum([0] + [len(b) for b in bags])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / spread, -8, 8)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for k, g in _gradients(p, x, begins, labels).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - 0.02 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(p, mean, spread)


def fit(labelled: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
        most: int = 1_500, most_chars: int = 6_000_000) -> Model:
    """Train on a bounded sample: ``most`` documents of either label, drawn by hash, and of these, in the order of their
    draw and whatever their length, as many whole texts as fit into ``most_chars`` characters of either label."""
    texts, labels = drawn(sample(labelled, most, label, text, doc_id).collect(), most_chars)
    return train([passages(t) for t in texts], np.array(labels, float))


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns, and ``quality_mil``: a struct of ``score`` (probability of label 1), ``passages`` and
    ``attention`` (the weights of the passages in their order).

    A null or empty text is one passage without characters and gets a score. Repeated rows are scored alike; an empty
    table gives an empty result; a column of the input named ``quality_mil`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages int, attention array<float>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for begin in range(0, len(texts), 500):
                bags = [passages(t) for t in texts.iloc[begin:begin + 500]]
                probability, attention = shared.value.score(bags)
                out += zip(probability, map(len, bags), attention)
            yield pd.DataFrame(out, columns=["score", "passages", "attention"])

    return docs.withColumn("quality_mil", score(F.col(text)))
