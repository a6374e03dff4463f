"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters.  A chain over the whole text has two states, plain and
offending; a token's evidence is the word itself, its beginnings and its
neighbours, all hashed into one table of weights.  Forward-backward marginals give
every token's probability; neighbouring tokens above one half are a span with
its place in the text, and the marginals of a document together give its score.

Only documents are labelled, so labelled tokens are made first: in a toxic document
a token is offending if its word, or the longest of its beginnings that enough
texts hold, is significantly more frequent in toxic texts than in others; all
other tokens are plain.  The chain is fitted on a bounded sample of labelled rows
(``FIT_DOCUMENTS`` and ``FIT_BYTES``, whole texts), the score on a part of them that
the chain has not seen; every token of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.rows import carried, crc_remainder, digest
from ratingloom.llm.words import chunked, mix, powers
from ratingloom.session import stage

#: Labelled rows that the model is fitted on, at most, and the bytes of their texts, at most.
FIT_DOCUMENTS, FIT_BYTES = 4000, 8 << 20
#: Of every so many rows of the sample one is kept for the score.
CALIBRATION = 4
TABLE = 1 << 18
#: Bytes of a token's beginnings that are evidence.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Texts that must hold a word or beginning before its frequency says anything.
SUPPORT = 8
#: How many times as frequent in toxic texts an offending word is, at the least.
RATIO = 4.0
STEPS = 40

_U = np.uint64
_RNG = np.random.default_rng(0xC4F)
_VALUE = _RNG.integers(1, 2**64, 256, dtype=_U)
_BASE = 0xD1342543DE82EF95 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Tokens:
    """The letter runs of several texts: places and hashed evidence."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        data = raw.copy()
        data[(raw >= 65) & (raw < 91)] += 32
        # Capitals of Latin-1 are two bytes, the second 0x80 to 0x9E.
        after = np.append(False, raw[:-1] == 0xC3) & (raw >= 0x80) & (raw < 0x9F) & (raw != 0x97)
        data[after] += 32
        letter = _LETTER[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False]))))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.raw = raw
        self.bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        cuts = np.searchsorted(self.starts, self.bounds)
        #: How many tokens each text has.
        self.counts = np.diff(cuts)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        #: Whether a token is the first of its text.
        self.opens = np.zeros(len(self.starts), bool)
        self.opens[cuts[:-1][self.counts > 0]] = True
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_VALUE[data] * powers(_BASE, len(data)), out=sums[1:])
        unwind = powers(_UNBASE, len(data))[self.starts]
        #: Numbers of the word and of its beginnings, longest first; a short word is its own beginning.
        self.keys = [mix((sums[self.ends] - sums[self.starts]) * unwind)]
        for n in reversed(BEGINNINGS):
            ends = np.minimum(self.starts + n, self.ends)
            self.keys.append(mix((sums[ends] - sums[self.starts]) * unwind) ^ _U(n))

    def evidence(self) -> np.ndarray:
        """A row per kind of evidence: each token's place in the table of weights."""
        word = self.keys[0]
        before, after = np.roll(word, 1), np.roll(word, -1)
        before[self.opens] = 0
        after[np.roll(self.opens, -1)] = 0
        keys = [*self.keys, before ^ _U(3), after ^ _U(5)]
        return np.stack([(mix(k + _U(1 + n)) % _U(TABLE)).astype(np.int32) for n, k in enumerate(keys)])

    def places(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens start and end, in characters of their own text."""
        first = np.cumsum((self.raw & 0xC0) != 0x80)
        base = self.bounds[self.owner[tokens]]
        before = np.where(base > 0, first[base - 1], 0)
        return first[self.starts[tokens]] - 1 - before, first[self.ends[tokens] - 1] - before


def chain(unary: np.ndarray, opens: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the offending state, of the four moves into each token, and the log partition.

    ``unary`` is the log weight of the offending state against the plain one, ``moves`` the
    log weights (plain and offending start, and the four moves).  Texts stand one
    after another; ``opens`` marks their first tokens.  Messages pass through
    products of 2 x 2 matrices: the tokens are cut into equal runs, whose products
    are formed side by side and linked run by run, so long texts cost no more steps.
    """
    n = len(unary)
    if n == 0:
        return np.zeros(0), np.zeros((0, 4)), 0.0
    length = max(1, int(np.sqrt(n)))
    runs = -(-n // length)

    def laid(values: np.ndarray, end: float) -> np.ndarray:
        return np.append(values, np.full(runs * length - n, end)).reshape(runs, length).T

    lift = laid(np.exp(np.clip(unary, -50, 50)), 1.0)
    weight = np.exp(moves)
    open_ = laid(opens, True).astype(bool)
    # m[t, i, j]: from state i of the token before to state j; a text's start forgets the token before.
    m = np.empty((length, 2, 2, runs))
    for i in (0, 1):
        for j in (0, 1):
            m[:, i, j] = np.where(open_, weight[j], weight[2 + 2 * i + j]) * (lift if j else 1.0)
    # Products of whole runs, from both states at once.
    p = np.repeat(np.eye(2)[:, :, None], runs, axis=2)
    for step in m:
        p = p[:, :1] * step[0] + p[:, 1:] * step[1]
        p /= p.sum((0, 1))
    enter, leave = np.empty((2, runs)), np.empty((2, runs))
    a0, a1, b0, b1 = 1.0, 0.0, 0.5, 0.5
    for r, ((p00, p01), (p10, p11)) in enumerate(p.transpose(2, 0, 1).tolist()):
        enter[0, r], enter[1, r] = a0, a1
        a0, a1 = a0 * p00 + a1 * p10, a0 * p01 + a1 * p11
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    for r, ((p00, p01), (p10, p11)) in reversed([*enumerate(p.transpose(2, 0, 1).tolist())]):
        leave[0, r], leave[1, r] = b0, b1
        b0, b1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    before, sizes, state = np.empty((length, 2, runs)), np.empty((length, runs)), enter
    for t, step in enumerate(m):
        before[t] = state
        state = state[0] * step[0] + state[1] * step[1]
        sizes[t] = state.sum(0)
        state = state / sizes[t]
    after, state = np.empty((length, 2, runs)), leave
    for t in range(length - 1, -1, -1):
        after[t] = state
        state = m[t, :, 0] * state[0] + m[t, :, 1] * state[1]
        state = state / state.sum(0)
    pair = before[:, :, None] * m * after[:, None]
    pair = (pair / pair.sum((1, 2), keepdims=True)).transpose(3, 0, 1, 2).reshape(-1, 4)[:n]
    return pair[:, 1] + pair[:, 3], pair, float(np.log(sizes.T.ravel()[:n]).sum())


@dataclass
class Model:
    """Weights of the evidence, of the moves, and of the document's score."""

    table: np.ndarray
    moves: np.ndarray
    last: np.ndarray

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Every token's probability of being offending."""
        return chain(self.table[tokens.evidence()].sum(0), tokens.opens, self.moves)[0]

    def score(self, tokens: Tokens, marginals: np.ndarray) -> np.ndarray:
        """Every document's probability of being toxic."""
        # Row by row: the last digit of a matrix product depends on where a row stands.
        return _sigmoid((document_evidence(tokens, marginals) * self.last).sum(axis=1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def document_evidence(tokens: Tokens, marginals: np.ndarray) -> np.ndarray:
    """A document's marginals in five numbers: one, the expected offending tokens as they are,
    in logarithm and by the text's length, and the greatest marginal."""
    texts = len(tokens.counts)
    hoped = np.bincount(tokens.owner, marginals, texts)
    most = np.zeros(texts)
    np.maximum.at(most, tokens.owner, marginals)
    share = np.log((hoped + 0.02) / (tokens.counts + 50.0))
    return np.stack([np.ones(texts), np.minimum(hoped, 5.0), np.log(hoped + 0.02), share, most], axis=1)


def token_labels(parts: list[Tokens], toxic: np.ndarray) -> list[np.ndarray]:
    """Which tokens are offending, given which of the (different) texts are toxic; the texts come in parts."""
    first = np.cumsum([0, *(len(p.counts) for p in parts)])
    owner = np.concatenate([p.owner + f for p, f in zip(parts, first)]).astype(np.int32)
    bad = toxic[owner]
    weight = np.array([(~bad).sum(), bad.sum()]) + 1.0
    out, open_ = np.zeros(len(bad), bool), bad.copy()
    for level in range(1 + len(BEGINNINGS)):
        known, at = np.unique(np.concatenate([p.keys[level] for p in parts]), return_inverse=True)
        seen = np.unique(at * len(toxic) + owner)
        texts = np.bincount(seen // len(toxic), minlength=len(known))
        held = np.bincount(seen // len(toxic), toxic[seen % len(toxic)], len(known))
        held, other = held + 0.5, texts - held + 0.5
        # Two standard errors below the logarithm of the ratio of the two frequencies.
        low = np.log(held / other * weight[0] / weight[1]) - 2 * np.sqrt(1 / held + 1 / other)
        enough = open_ & (texts >= SUPPORT)[at]
        out |= enough & (low >= np.log(RATIO))[at]
        open_ &= ~enough
    return np.split(out, np.cumsum([len(p.owner) for p in parts])[:-1])


def slopes(opened: np.ndarray, places: np.ndarray, labels: np.ndarray, table: np.ndarray, moves: np.ndarray) -> tuple:
    """The log likelihood of labelled tokens, and its slopes by the table and by the moves."""
    unary = table[places].sum(0)
    one, pair, total = chain(unary, opened, moves)
    state = labels.astype(np.int64)
    move = np.where(opened, state, 2 + 2 * np.roll(state, 1) + state)
    gain = float(unary[labels].sum() + moves[move].sum() - total)
    by_table = np.bincount(places.ravel(), np.tile(labels - one, len(places)), len(table))
    expected = np.concatenate(([(1 - one)[opened].sum(), one[opened].sum()], pair[~opened].sum(0)))
    return gain, by_table, np.bincount(move, minlength=6) - expected


def fit_chain(parts: list[tuple], steps: int = STEPS, keep: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the chain that make the token labels likely, by Adam on the penalised log likelihood.

    Each part holds which tokens open a text, their evidence and their labels.
    """
    weights = [np.zeros(TABLE), np.array([0.0, -4.0, 0.0, -4.0, 0.0, -4.0])]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        found = [-keep * w for w in weights]
        for part in parts:
            for total, slope in zip(found, slopes(*part, *weights)[1:]):
                total += slope
        for k, slope in enumerate(found):
            one, two = moments[k]
            one += 0.1 * (slope - one)
            two += 0.01 * (slope**2 - two)
            weights[k] += 0.2 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return weights[0], weights[1]


def fit_score(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A logistic regression by Newton's method, with a small penalty."""
    last = np.zeros(evidence.shape[1])
    for _ in range(30):
        p = _sigmoid(evidence @ last)
        slope = evidence.T @ (p - toxic) + 0.1 * last
        bend = (evidence * (p * (1 - p))[:, None]).T @ evidence + 0.1 * np.eye(len(last))
        last = last - np.linalg.solve(bend, slope)
    return last


def fit(texts: list[str | None], toxic: np.ndarray) -> Model:
    """A model from labelled texts; with labels of one kind only, the score is their smoothed share."""
    prior = (toxic.sum() + 1) / (len(toxic) + 2)
    plain = Model(np.zeros(TABLE), np.array([0.0, -9.0, 0.0, -9.0, 0.0, -9.0]), np.array([np.log(prior / (1 - prior)), 0, 0, 0, 0]))
    if len(set(toxic.tolist())) < 2:
        return plain
    # Copies of a text say nothing new; of differing labels toxic counts.
    different: dict[str, bool] = {}
    for text, bad in zip(texts, toxic.tolist()):
        different[text or ""] = different.get(text or "", False) or bool(bad)
    texts, toxic = list(different), np.array(list(different.values()))
    later = np.arange(len(texts)) % CALIBRATION == CALIBRATION - 1
    # Texts for the score stand last, so that the others fill the first parts.
    order = np.argsort(later, kind="stable")
    texts, toxic = [texts[k] for k in order], toxic[order]
    first = int((~later).sum())
    if len(set(toxic[first:].tolist())) < 2:
        first = 0
    blocks = [*chunked(texts[:first]), *chunked(texts[first:])]
    parts = [Tokens(b) for b in blocks]
    labels = token_labels(parts, toxic)
    begins = np.cumsum([0, *map(len, blocks)])
    seen = [(p.opens, p.evidence(), held) for p, held, at in zip(parts, labels, begins) if at < first or first == 0]
    kept = [b for b, at in zip(blocks, begins) if at >= first]
    del parts, labels
    model = Model(*fit_chain(seen), plain.last)
    evidence = []
    for block in kept:
        tokens = Tokens(block)
        evidence.append(document_evidence(tokens, model.marginals(tokens)))
    model.last = fit_score(np.vstack(evidence), toxic[first:].astype(float))
    return model


def train(
    documents: DataFrame, labels: DataFrame, modulus: int = 5, limit: int = FIT_DOCUMENTS, most: int = FIT_BYTES
) -> Model:
    """A model fitted on labelled documents whose crc32(doc_id) is no multiple of ``modulus``.

    At most ``limit`` of them in a seeded order, and of these as many as have ``most``
    bytes together.  Null labels and ids are left out; of several labels of one
    document the highest counts.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(crc_remainder("doc_id", modulus) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Bounded by ``limit``, so it can be sent everywhere.
    known = known.withColumn("turn", digest(5, F.col("doc_id"))).orderBy("turn", "doc_id").limit(limit)
    marked = documents.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    # The sample is chosen without its texts, which are fetched once it is known to be small.
    found = marked.join(F.broadcast(known), "doc_id").select("doc_id", "mark", "turn", "toxic", size.alias("size")).distinct()
    so_far = F.sum("size").over(Window.orderBy("turn", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0))
    chosen = found.orderBy("turn", "doc_id", "mark").limit(limit).withColumn("so_far", so_far).filter(F.col("so_far") <= most)
    chosen = stage(chosen.drop("size", "so_far"), "toxic-sample")
    found = marked.join(F.broadcast(chosen), ["doc_id", "mark"]).groupBy("turn", "doc_id", "mark", "toxic").agg(F.min("text").alias("text"))
    found = sorted(found.collect(), key=lambda r: (r["turn"], r["doc_id"], r["mark"]))
    return fit([r["text"] for r in found], np.array([r["toxic"] > 0 for r in found], bool))


_ADDED = "score double, spans array<struct<start:long,end:long,probability:double>>"


def score(documents: DataFrame, model: Model, modulus: int = 5, threshold: float = 0.5) -> DataFrame:
    """``documents`` with ``held_out``, ``score``, ``spans`` and ``predicted``.

    ``spans`` lists the offending runs of tokens: start and end in characters of the text, and the
    greatest probability in the run.  A null text is empty, and an empty text has no
    tokens and is scored like any text without offending ones.  Null ids are scored
    like any other, repeated rows alike.  The documents' own columns stay, except ones
    that bear the names of the four.
    """
    kept = documents.drop("held_out", "score", "spans", "predicted")

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores: list[float] = []
            spans: list[list[dict]] = []
            for block in chunked(frame["text"]):
                tokens = Tokens(block)
                marginals = model.marginals(tokens)
                scores += model.score(tokens, marginals).tolist()
                spans += offending(tokens, marginals)
            yield frame.assign(score=scores, spans=pd.Series(spans, index=frame.index, dtype=object))

    found = carried(kept, scored, _ADDED)
    return found.withColumn("held_out", crc_remainder("doc_id", modulus) == 0).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )


def offending(tokens: Tokens, marginals: np.ndarray, least: float = 0.5) -> list[list[dict]]:
    """For each text the runs of neighbouring tokens whose marginals reach ``least``."""
    out: list[list[dict]] = [[] for _ in tokens.counts]
    at = np.flatnonzero(marginals >= least)
    if len(at):
        first = np.append(True, (np.diff(at) != 1) | tokens.opens[at[1:]])
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(at)) - 1
        start, _ = tokens.places(at[heads])
        _, end = tokens.places(at[tails])
        best = np.maximum.reduceat(marginals[at], heads)
        for text, a, b, p in zip(tokens.owner[at[heads]].tolist(), start.tolist(), end.tolist(), best.tolist()):
            out[text].append({"start": a, "end": b, "probability": p})
    return out


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """Train and score."""
    return score(documents, train(documents, labels, modulus), modulus)
