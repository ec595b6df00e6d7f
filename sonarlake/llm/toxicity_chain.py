"""Toxicity by a classifier chain.

The categories form a chain of linear models. Link j sees the words of a text and the probabilities of links 1..j-1. For
training, those earlier probabilities are predicted out of fold, so that a later link learns how far earlier ones can be
trusted on unseen texts. The last link is toxicity as a whole and decides.

Features are the distinct words of a text and how many of them share each beginning, hashed; weights are kept sparse by follow-the-regularised-
leader updates with an L1 term, so a long text gathers no noise from ordinary words. A word's contribution to all links is
one small vector, cached per worker; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, pick
from .labelled import training_rows

#: Seed terms that give a toxic training text its category labels, in order of the chain.
CATEGORIES = {
    "insult": "idiot moron stupid clown fool dumm dummkopf imbécile crétin imbécil estúpido".split(),
    "contempt": "worthless pathetic loser useless wertlos erbärmlich minable inutile patético inútil".split(),
    "disgust": "trash scum disgusting garbage filth abschaum ekelhaft ordure dégoûtant basura asqueroso".split(),
}
OVERALL = "toxic"
_BREAKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


@dataclass(frozen=True)
class ChainSettings:
    """``max_rows`` bounds the training sample of labelled documents; a text is rejected from ``reject_at`` on."""

    max_rows: int = 8_000
    bits: int = 19
    starts: tuple[int, ...] = (4, 5, 6, 7, 8)
    min_texts: int = 3
    folds: int = 3
    epochs: int = 4
    batch: int = 256
    alpha: float = 0.3
    l1: float = 8.0
    l2: float = 0.5
    reject_at: float = 0.35
    categories: dict[str, list[str]] = field(default_factory=lambda: dict(CATEGORIES))

    @property
    def links(self) -> list[str]:
        return [*self.categories, OVERALL]


@dataclass(frozen=True)
class ChainModel:
    """Per link: bias, weights of hashed features, weights of the earlier links' log-odds."""

    settings: ChainSettings
    bias: list[float]
    words: np.ndarray
    earlier: list[np.ndarray]


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split())


def word_features(word: bytes, settings: ChainSettings) -> list[int]:
    """Hashes of the word and of its beginnings."""
    mask = (1 << settings.bits) - 1
    letters = word.decode("utf-8", "replace")
    return [zlib.crc32(word) & mask, *{zlib.crc32(letters[:k].encode(), 77) & mask for k in settings.starts if len(letters) >= k}]


def _feature_rows(settings: ChainSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Generations(lambda ws: [word_features(w, settings) for w in ws], 200_000)
        seeds = [frozenset(w.encode() for w in ws) for ws in settings.categories.values()]
        for batch in batches:
            rows = []
            for key, text, label in zip(batch["doc_id"].tolist(), batch["_text"].tolist(), batch["label"].tolist()):
                words = words_of(text if isinstance(text, str) else None)
                ids, counts = np.unique(np.array([i for f in known.values(list(words)) for i in f], "i4"), return_counts=True)
                marks = sum(1 << k for k, s in enumerate(seeds) if label and not s.isdisjoint(words))
                rows.append((key, int(label) << len(seeds) | marks, ids.tobytes(), np.minimum(counts, 255).astype("u1").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "marks", "ids", "counts"])

    return run


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(ids: list[np.ndarray], counts: list[np.ndarray], extra: np.ndarray, y: np.ndarray, size: int, s: ChainSettings) -> tuple[float, np.ndarray]:
    """One linear link: bias and weights over hashed features followed by the columns of ``extra``."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(math.log(share / (1 - share)))
    total = size + extra.shape[1]
    z, n = np.zeros(total), np.zeros(total)
    if y.sum() == 0:
        return bias, np.zeros(total, "f4")
    tail = np.arange(size, total)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) > s.l1, -(zi - np.sign(zi) * s.l1) / ((1 + np.sqrt(n[i])) / s.alpha + s.l2), 0.0)

    rng = np.random.default_rng(5)
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), s.batch):
            at = order[lo:lo + s.batch]
            sizes = np.array([len(ids[k]) for k in at]) + len(tail)
            i = np.concatenate([np.concatenate([ids[k], tail]) for k in at])
            x = np.concatenate([np.concatenate([counts[k], extra[k]]) for k in at])
            used, back = np.unique(i, return_inverse=True)
            w = weights(used)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            margin = w[back] * x
            logits = bias + np.where(sizes > 0, np.add.reduceat(np.append(margin, 0.0), np.minimum(starts, len(margin))), 0.0)
            g = _sigmoid(logits) - y[at]
            d = np.bincount(back, np.repeat(g, sizes) * x, len(used))
            sigma = (np.sqrt(n[used] + d * d) - np.sqrt(n[used])) / s.alpha
            z[used] += d - sigma * w
            n[used] += d * d
    return bias, weights(np.arange(total)).astype("f4")


def _logits(ids: list[np.ndarray], counts: list[np.ndarray], extra: np.ndarray, bias: float, w: np.ndarray, size: int) -> np.ndarray:
    return np.array([bias + float(w[i] @ c) for i, c in zip(ids, counts)]) + extra @ w[size:]


def _chain(got: pd.DataFrame, s: ChainSettings) -> ChainModel:
    """The links one after the other over the feature rows of the sample."""
    got = got.sort_values(["doc_id", "marks", "ids"]).reset_index(drop=True)
    size = 1 << s.bits
    ids = [np.frombuffer(x, "i4") for x in got["ids"]]
    texts = np.bincount(np.concatenate(ids), minlength=size) if ids else np.zeros(size, int)
    fit_for = (texts >= s.min_texts) & (texts < max(2, len(ids) // 2))
    counts = [np.frombuffer(x, "u1")[fit_for[i]].astype("f4") for i, x in zip(ids, got["counts"])]
    ids = [i[fit_for[i]] for i in ids]
    marks = got["marks"].to_numpy("i8") if len(got) else np.zeros(0, "i8")
    fold = np.array([zlib.crc32(str(k).encode()) % s.folds for k in got["doc_id"]], "i8") if len(got) else np.zeros(0, "i8")
    extra = np.zeros((len(ids), 0))
    bias, words, earlier = [], np.zeros((len(s.links), size), "f4"), []
    for k in range(len(s.links)):
        y = ((marks >> k) & 1).astype("f8")
        b, w = _train(ids, counts, extra, y, size, s) if len(y) else (-9.0, np.zeros(size + k, "f4"))
        bias.append(b)
        words[k] = w[:size]
        earlier.append(w[size:].astype("f8"))
        if k + 1 < len(s.links):
            out = np.zeros(len(ids))
            for f in range(s.folds):
                rest, mine = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(mine) and len(rest):
                    bf, wf = _train([ids[i] for i in rest], [counts[i] for i in rest], extra[rest], y[rest], size, s)
                    out[mine] = _logits([ids[i] for i in mine], [counts[i] for i in mine], extra[mine], bf, wf, size)
            extra = np.column_stack([extra, _sigmoid(out)])
    return ChainModel(s, bias, words, earlier)


def _fit_rows(s: ChainSettings):
    """One row per link: bias, features with a weight, their weights, weights of the earlier links."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not sum(map(len, parts)):
            return
        model = _chain(pd.concat(parts), s)
        used = [np.flatnonzero(w) for w in model.words]
        yield pd.DataFrame({"link": range(len(used)), "bias": model.bias, "ids": [u.astype("i4").tobytes() for u in used],
                            "weights": [w[u].tobytes() for w, u in zip(model.words, used)], "earlier": [e.tobytes() for e in model.earlier]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", settings: ChainSettings = ChainSettings()) -> ChainModel:
    """Fit the chain on the bounded sample; features are made on the executors, rare ones are left out.

    The links need each other's out-of-fold results, so one task fits them over at most ``max_rows`` short feature rows; the
    driver gets the weights only. Without toxic rows every link gives its prior, which rejects nothing.
    """
    s = settings
    rows = training_rows(docs, labels, label, {"_text": text}, s.max_rows)
    made = rows.select("doc_id", "label", "_text").mapInPandas(_feature_rows(s), "doc_id long, marks int, ids binary, counts binary")
    fitted = made.repartition(1).mapInPandas(_fit_rows(s), "link int, bias double, ids binary, weights binary, earlier binary").collect()
    if not fitted:
        return _chain(pd.DataFrame({c: [] for c in ("doc_id", "marks", "ids", "counts")}), s)
    fitted.sort(key=lambda r: r.link)
    words = np.zeros((len(s.links), 1 << s.bits), "f4")
    for k, r in enumerate(fitted):
        words[k, np.frombuffer(r.ids, "i4")] = np.frombuffer(r.weights, "f4")
    return ChainModel(s, [r.bias for r in fitted], words, [np.frombuffer(r.earlier, "f8") for r in fitted])


def score(docs: DataFrame, model: ChainModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, a probability per category, score (toxic as a whole), predicted (0/1) and kept of every row.

    A null or empty text gets the prior and is kept; repeated rows each get a row; an empty table gives none.
    """
    s = model.settings
    used = np.flatnonzero(model.words.any(0))
    table = {int(i): model.words[:, i].astype("f8") for i in used}  # sparse: only features with a weight
    bias, earlier, links = np.array(model.bias), model.earlier, s.links

    def contributions(words: list[bytes]) -> list:
        out = []
        for w in words:
            hits = [table[i] for i in word_features(w, s) if i in table]
            out.append(tuple(np.sum(hits, axis=0).tolist()) if hits else False)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Generations(contributions, 300_000)
        for batch in batches:
            probs = np.zeros((len(batch), len(links)))
            for r, text in enumerate(batch["_text"].tolist()):
                found = [v for v in known.values(list(words_of(text if isinstance(text, str) else None))) if v is not False]
                z = bias + (np.sum(found, axis=0) if found else 0.0)
                for k in range(len(links)):
                    probs[r, k] = _sigmoid(z[k] + probs[r, :k] @ earlier[k])
            toxic = probs[:, -1] >= s.reject_at
            out = {"doc_id": batch["doc_id"].astype("Int64")} | {f"p_{c}": probs[:, k] for k, c in enumerate(links[:-1])}
            yield pd.DataFrame(out | {"score": probs[:, -1], "predicted": toxic.astype("int32"), "kept": ~toxic})

    shape = "doc_id long, " + "".join(f"p_{c} double, " for c in links[:-1]) + "score double, predicted int, kept boolean"
    return pick(docs, doc_id=doc_id, _text=text).mapInPandas(run, shape)
