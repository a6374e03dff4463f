"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is described by plain statistics
of its bytes and words and encoded by a small layer; gated attention weighs the
encoded passages, and the weighted mean is scored.  Only document labels are used:
which passages matter is learned.  The model is fitted on a bounded sample of
labelled documents (``FIT_DOCUMENTS``); every passage of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.rows import carried, crc_remainder, digest
from ratingloom.llm.words import Chunk, chunked, grams, mix

#: Labelled documents that the model is fitted on, at most.
FIT_DOCUMENTS = 6000
#: Passages of one document that take part in fitting, evenly spread; scoring uses all.
FIT_PASSAGES = 48
PASSAGE_WORDS = 64
HASHED = 32
HIDDEN = 24
GATE = 12
STEPS = 300

# Byte classes: letters by case, digits, line ends, other white space, bytes beyond ASCII,
# and every other printable byte for itself.
_CLASS = np.full(256, 5)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[10] = 0, 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_OTHER] = 6 + np.arange(len(_OTHER))
_CLASSES = 6 + len(_OTHER)
FEATURES = _CLASSES + 8 + HASHED


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of statistics per passage, and how many passages each text has (one at least)."""
    chunk = Chunk(texts)
    parts = np.maximum(1, -(-chunk.counts // PASSAGE_WORDS))
    total = int(parts.sum())
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    owner = np.repeat(np.arange(len(texts)), chunk.counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(chunk.counts) - chunk.counts, chunk.counts)
    passage = first[owner] + within // PASSAGE_WORDS
    begins = chunk.bounds[:-1].repeat(parts)
    opening = within % PASSAGE_WORDS == 0
    later = opening & (within > 0)
    begins[passage[later]] = chunk.starts[later]
    lengths = np.diff(np.concatenate((begins, [len(chunk.raw)])))
    of_byte = np.repeat(np.arange(total), lengths)
    classes = np.bincount(of_byte * _CLASSES + _CLASS[chunk.raw], minlength=total * _CLASSES).reshape(total, _CLASSES)
    words = np.bincount(passage, minlength=total)
    some = np.maximum(words, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values, total) / some

    sizes = (chunk.ends - chunk.starts).astype(float)
    keys = mix(chunk.hashed ^ (passage.astype(np.uint64) << np.uint64(20)))
    distinct = np.bincount(passage[np.unique(keys, return_index=True)[1]], minlength=total) / some
    runs = grams(chunk.hashed, 4)
    if len(runs):
        keyed = mix(runs[: len(owner)] ^ (owner[: len(runs)].astype(np.uint64) << np.uint64(20)))
        fresh = np.zeros(len(owner))
        fresh[np.unique(keyed, return_index=True)[1]] = 1
    else:
        fresh = np.zeros(0)
    bag = np.bincount(passage * HASHED + (chunk.hashed >> np.uint64(40)).astype(np.int64) % HASHED, minlength=total * HASHED)
    initial = chunk.raw[chunk.starts] if len(chunk.starts) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(20 * classes / np.maximum(lengths, 1)[:, None]),
        mean(sizes)[:, None] / 8, np.sqrt(mean(sizes**2))[:, None] / 8,
        distinct[:, None], mean(fresh)[:, None],
        mean((initial >= 65) & (initial < 91))[:, None], mean(_CLASS[initial] > 5)[:, None],
        np.log1p(words)[:, None] / 4, np.log1p(np.repeat(chunk.counts, parts))[:, None] / 8,
        bag.reshape(total, HASHED) / some[:, None] * 4,
    ]
    return np.hstack(columns), parts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the encoder, the gate and the last layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, rows: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of documents whose passages are consecutive rows, with what led to them."""
        w = self.weights
        first = np.concatenate(([0], np.cumsum(parts)[:-1]))
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["encode"] + w["encode0"])
        t, g = np.tanh(h @ w["view"]), _sigmoid(h @ w["gate"])
        e = (t * g) @ w["weigh"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), parts))
        a = e / np.repeat(np.add.reduceat(e, first), parts)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ w["last"] + w["last0"][0])}

    def score(self, rows: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Probability that a document is good."""
        return self.forward(rows, parts)["score"]

    def attention(self, rows: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Each passage's weight in its document."""
        return self.forward(rows, parts)["a"]


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11, steps: int = STEPS, batch: int = 512) -> Model:
    """Fit by Adam on the cross entropy of document labels.

    Without any document, or with labels of one kind only, the score is the share
    of good documents, smoothed by one of either kind.
    """
    rng = np.random.default_rng(seed)
    wide = {"encode": (FEATURES, HIDDEN), "view": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "weigh": (GATE,), "last": (HIDDEN,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in wide.items()}
    prior = (labels.sum() + 1) / (len(labels) + 2)
    weights |= {"encode0": np.zeros(HIDDEN), "last0": np.array([np.log(prior / (1 - prior))])}
    if len(set(labels.tolist())) < 2:
        weights["last"] = np.zeros(HIDDEN)
        return Model(np.zeros(FEATURES), np.ones(FEATURES), weights)
    every = np.vstack(bags)
    model = Model(every.mean(0), every.std(0) + 1e-3, weights)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate((order, rng.permutation(len(bags))))
        chosen, order = order[:batch], order[batch:]
        parts = np.array([len(bags[i]) for i in chosen])
        first = np.concatenate(([0], np.cumsum(parts)[:-1]))
        f, w = model.forward(np.vstack([bags[i] for i in chosen]), parts), weights
        d_last = (f["score"] - labels[chosen]) / len(chosen)
        d_z = d_last[:, None] * w["last"]
        spread = np.repeat(d_z, parts, axis=0)
        d_a = (spread * f["h"]).sum(1)
        d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, first), parts))
        d_tg = d_e[:, None] * w["weigh"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * spread + d_t @ w["view"].T + d_g @ w["gate"].T
        d_x = d_h * (1 - f["h"] ** 2)
        slopes = {
            "last": f["z"].T @ d_last, "last0": np.array([d_last.sum()]), "weigh": (f["t"] * f["g"]).T @ d_e,
            "view": f["h"].T @ d_t, "gate": f["h"].T @ d_g, "encode": f["x"].T @ d_x, "encode0": d_x.sum(0),
        }
        rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
        for k, slope in slopes.items():
            slope = slope + 1e-4 * weights[k]
            one, two = moments[k]
            one += 0.1 * (slope - one)
            two += 0.01 * (slope**2 - two)
            weights[k] -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return model


def train(documents: DataFrame, labels: DataFrame, modulus: int = 5, limit: int = FIT_DOCUMENTS) -> Model:
    """A model fitted on labelled documents whose crc32(doc_id) is no multiple of ``modulus``.

    At most ``limit`` of them, in a seeded order.  Null labels and ids are left out;
    of several labels of one document the lowest counts.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(crc_remainder("doc_id", modulus) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # Bounded by ``limit``, so it can be sent everywhere.
    known = known.orderBy(digest(3, F.col("doc_id")), "doc_id").limit(limit)
    chosen = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, ids, goods = [], frame["doc_id"].tolist(), frame["quality"].tolist()
            for block in chunked(frame["text"]):
                features, parts = passages(block)
                rows.extend(np.split(features.astype(np.float32), np.cumsum(parts)[:-1]))
            thinned = [r[np.linspace(0, len(r) - 1, min(len(r), FIT_PASSAGES)).astype(int)] for r in rows]
            yield pd.DataFrame({"doc_id": ids, "quality": goods, "rows": [r.tobytes() for r in thinned]})

    found = chosen.mapInPandas(described, "doc_id long, quality int, rows binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["rows"])))
    bags = [np.frombuffer(r["rows"], np.float32).reshape(-1, FEATURES).astype(float) for r in found]
    return fit(bags, np.array([float(r["quality"]) for r in found]))


def score(documents: DataFrame, model: Model, modulus: int = 5, threshold: float = 0.3) -> DataFrame:
    """``documents`` with ``held_out``, ``score`` and ``predicted``.

    A null text is empty; an empty text is one passage without words.  Null ids are
    scored like any other, repeated rows alike.  The documents' own columns stay,
    except ones that bear the names of the three.
    """
    kept = documents.drop("held_out", "score", "predicted")

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = []
            for block in chunked(frame["text"]):
                values.append(model.score(*passages(block)))
            yield frame.assign(score=np.concatenate(values) if values else np.zeros(0))

    found = carried(kept, scored, "score double")
    return found.withColumn("held_out", crc_remainder("doc_id", modulus) == 0).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """Train and score."""
    return score(documents, train(documents, labels, modulus), modulus)
