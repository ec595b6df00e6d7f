"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum costs one pass over a document's
features by the identity sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Fitting uses a bounded sample of labelled documents (``max_rows``); scoring runs over all texts, batch by batch, without a
shuffle. Neither labels nor language, source or id are inputs: the only metadata is the stored length in characters.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .labelled import held_out, training_rows

#: Character classes of single bytes: lower, upper, digit, blank, line end, stop, shout, bar, other symbol, beyond ASCII.
_CLASS = np.full(256, 8, "u1")
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:'\"()-", b"!?", b"|")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9
STATS = 20


@dataclass(frozen=True)
class FmSettings:
    """``max_rows`` bounds the training sample; ``word_bits`` the table of hashed words; ``factors`` the rank."""

    max_rows: int = 12_000
    word_bits: int = 16
    factors: int = 8
    epochs: int = 6
    batch: int = 256
    rate: float = 0.05
    decay: float = 1e-5
    seed: int = 7


@dataclass(frozen=True)
class FmModel:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    word_bits: int


def features(text: str | None, n_chars: float | None, word_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, their values (unit length together), and STATS structure and metadata numbers of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, n)
    ids, counts = np.unique(hashes & ((1 << word_bits) - 1), return_counts=True)
    values = np.log1p(counts)
    values = values / max(1e-9, math.sqrt(float(values @ values)))
    shares = np.bincount(_CLASS[np.frombuffer(raw, "u1")], minlength=10) / max(1, len(raw))
    lines = raw.split(b"\n")
    grams = hashes[:-3] * 1_000_003 + hashes[1:-2] * 10_007 + hashes[2:-1] * 101 + hashes[3:] if n > 3 else hashes[:0]
    stats = [
        math.log1p(n), len(raw) / max(1, n), len(ids) / max(1, n), math.log1p(len(lines)), len(set(lines)) / len(lines),
        len(np.unique(grams)) / len(grams) if len(grams) else 1.0, n / len(lines) / 20, float(n == 0),
        math.log1p(max(0.0, n_chars)) if n_chars is not None and math.isfinite(n_chars) else math.log1p(len(raw)),
        float(n_chars is None or not math.isfinite(n_chars)),
    ]
    return ids, values.astype("f4"), np.concatenate([np.sqrt(shares), stats]).astype("f4")


def _feature_rows(word_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, n, label in zip(batch["doc_id"].tolist(), batch["_text"].tolist(), batch["_chars"].tolist(), batch["label"].tolist()):
                ids, values, stats = features(text if isinstance(text, str) else None, n, word_bits)
                rows.append((key, label, ids.astype("i4").tobytes(), values.tobytes(), stats.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "ids", "vals", "stats"])

    return run


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", n_chars: str = "n_chars",
        settings: FmSettings = FmSettings()) -> FmModel:
    """Fit on the bounded sample with AdaGrad over mini-batches; the rows' features are made on the executors.

    Without any labelled row, or with labels of one kind only, the model gives every text the same score.
    """
    s = settings
    rows = training_rows(docs, labels, label, {"_text": text, "_chars": n_chars}, s.max_rows, ~held_out())
    got = rows.select("doc_id", "label", "_text", F.col("_chars").cast("double").alias("_chars")).mapInPandas(
        _feature_rows(s.word_bits), "doc_id long, label int, ids binary, vals binary, stats binary").toPandas()
    got = got.sort_values(["doc_id", "ids"]).reset_index(drop=True)
    size = (1 << s.word_bits) + STATS
    y = got["label"].to_numpy("f8").clip(0, 1) if len(got) else np.zeros(0)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(s.seed)
    w, v = np.zeros(size, "f4"), (0.02 * rng.standard_normal((size, s.factors))).astype("f4")
    mean, scale = np.zeros(STATS, "f4"), np.ones(STATS, "f4")
    if not len(y) or y.min() == y.max():
        return FmModel(bias, w, np.zeros_like(v), mean, scale, s.word_bits)
    stats = np.vstack([np.frombuffer(x, "f4") for x in got["stats"]])
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    stats = np.clip((stats - mean) / scale, -4, 4)
    stat_ids = np.arange(STATS) + (1 << s.word_bits)
    ids = [np.concatenate([np.frombuffer(x, "i4"), stat_ids]) for x in got["ids"]]
    vals = [np.concatenate([np.frombuffer(x, "f4"), stats[k] / 4]) for k, x in enumerate(got["vals"])]
    gw, gv, gb = np.full(size, 1e-6, "f4"), np.full((size, s.factors), 1e-6, "f4"), 1e-6
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), s.batch):
            at = order[lo:lo + s.batch]
            sizes = np.array([len(ids[k]) for k in at])
            i, x = np.concatenate([ids[k] for k in at]), np.concatenate([vals[k] for k in at])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = v[i] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = bias + np.add.reduceat(w[i] * x, starts) + 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts)).sum(1)
            g = ((_sigmoid(z) - y[at]) / len(at)).astype("f4")
            gx = np.repeat(g, sizes) * x
            used, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, gx, len(used)).astype("f4") + s.decay * w[used]
            dv = s.decay * v[used]
            part = gx[:, None] * (np.repeat(sums, sizes, 0) - vx)
            dv = dv + np.stack([np.bincount(back, part[:, f], len(used)) for f in range(s.factors)], 1).astype("f4")
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= s.rate * dw / np.sqrt(gw[used])
            v[used] -= s.rate * dv / np.sqrt(gv[used])
            gb += float(g.sum()) ** 2
            bias -= s.rate * float(g.sum()) / math.sqrt(gb)
    return FmModel(float(bias), w, v, mean, scale, s.word_bits)


def score_text(model: FmModel, text: str | None, n_chars: float | None) -> float:
    ids, values, stats = features(text, n_chars, model.word_bits)
    base = 1 << model.word_bits
    z = np.clip((stats - model.mean) / model.scale, -4, 4) / 4
    vx = np.concatenate([model.factors[ids] * values[:, None], model.factors[base:] * z[:, None]])
    sums = vx.sum(0)
    pairs = 0.5 * float((sums * sums).sum() - (vx * vx).sum())
    return float(_sigmoid(model.bias + float(model.linear[ids] @ values) + float(model.linear[base:] @ z) + pairs))


def score(docs: DataFrame, model: FmModel, text: str = "text", n_chars: str = "n_chars", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (0/1) of every row.

    Null and empty texts are scored by their statistics; a null length is replaced by the measured one and flagged; a
    row without an id counts as held out; repeated rows each get a row; an empty table gives none.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [score_text(model, t if isinstance(t, str) else None, n) for t, n in zip(batch["_text"].tolist(), batch["_chars"].tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": found,
                                "predicted": [int(p >= 0.5) for p in found]})

    rows = pick(docs, doc_id=doc_id, _text=text, _chars=n_chars).select("doc_id", held_out().alias("held_out"), "_text", F.col("_chars").cast("double").alias("_chars"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
