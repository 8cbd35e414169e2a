"""Quality of whole texts from a linear-chain conditional random field over their lines.

Every line with a word is good or bad. Its score comes from its own features and those of the lines
next to it, and from the label of the line before. Forward and backward passes run for all texts of a
group at once, a line further each step, and give each line's probability to be bad; the mean of these, weighed by line length,
is the bad share of the text. A logistic curve turns it into the probability of label 1.

Labels exist for texts only. Lines of good texts are good; for bad texts the lines start as bad, and
after each fit those that the field itself thinks good become good (one line stays bad).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.common import arrow_rows, fold, raw
from ligandloom.llm.tokens import SPACE, grouped, mix, tokenise
from ligandloom.llm.toxicity import fit_curve

#: The field is fitted on at most so many labelled texts of each class, chosen by a hash of their keys. Of a
#: text of more lines it sees so many lines in a row, from a place that a hash of the text picks.
SAMPLE, LINES = 1500, 300
ROUNDS, STEPS, RATE, RIDGE = 3, 80, 0.1, 1e-3

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0xC0:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~_=+@"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?\"'()-"]] = True
_CLASSES = (
    _UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK, np.arange(256) == ord("|"), np.arange(256) == ord("!"),
    ~SPACE & ((np.arange(256) & 0xC0) != 0x80),
)
#: Indicators: feature place and level.
_LEVELS = ((2, 0.03), (2, 0.15), (3, 0.1), (3, 0.3), (4, 0.2), (4, 0.6), (5, 0.4), (8, 0.1), (8, 0.3))
OWN = 13 + len(_LEVELS)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line with a word, its length in characters, and each text's first line (and the end)."""
    tokens = tokenise(texts)
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    ends = np.flatnonzero(data == 10)
    stops = np.sort(np.r_[ends, tokens.offsets[1:] - 1]) if len(texts) else ends
    starts = np.r_[0, stops[:-1] + 1].astype(np.int64)
    first = np.searchsorted(tokens.starts, starts)
    last = np.searchsorted(tokens.starts, stops)
    real = last > first
    starts, stops, first, last = starts[real], stops[real], first[real], last[real]
    text_first = np.searchsorted(starts, tokens.offsets)
    if not len(starts):
        return np.zeros((0, OWN), np.float32), np.zeros(0), text_first
    counts = []
    for members in _CLASSES:
        sums = np.r_[0, np.cumsum(members[data], dtype=np.int32)]
        counts.append(sums[stops] - sums[starts])
    upper, letters, digits, symbols, marks, pipes, bangs, chars = (c.astype(float) for c in counts)
    words = (last - first).astype(float)
    h = tokens.hashes
    line_of = np.repeat(np.arange(len(starts)), last - first)
    again = np.zeros(len(h))
    for lag in (1, 2):
        same = np.zeros(len(h), bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (line_of[lag:] == line_of[:-lag])
        again = np.maximum(again, same)
    repeats = np.add.reduceat(again, first)
    inside = np.arange(len(h)) - np.repeat(first, last - first)
    ident = np.add.reduceat(mix(h + mix(inside.astype(np.uint64) + np.uint64(1))), first)
    text_of = np.searchsorted(text_first, np.arange(len(starts)), "right") - 1
    _, back, times = np.unique(mix(ident + mix(text_of.astype(np.uint64))), return_inverse=True, return_counts=True)
    tail = data[np.maximum(tokens.ends[last - 1] - 1, 0)]
    own = np.empty((len(starts), OWN), np.float32)
    own[:, 0] = np.log1p(words) / 5
    own[:, 1] = chars / words / 10
    own[:, 2] = symbols / np.maximum(chars, 1)
    own[:, 3] = pipes / words
    own[:, 4] = bangs / words
    own[:, 5] = upper / np.maximum(letters, 1)
    own[:, 6] = digits / np.maximum(chars, 1)
    own[:, 7] = marks / np.maximum(chars, 1)
    own[:, 8] = repeats / words
    own[:, 9] = times[back] > 1
    own[:, 10] = np.minimum(np.log1p(times[back] - 1), 5) / 5
    own[:, 11] = words < 4
    own[:, 12] = np.isin(tail, (0x2E, 0x21, 0x3F))
    for k, (place, level) in enumerate(_LEVELS):
        own[:, 13 + k] = own[:, place] > level
    return own, chars, text_first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, whether there is no such line, and a constant."""
    n = len(own)
    out = np.zeros((n, 3 * OWN + 3), np.float32)
    if not n:
        return out
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    out[:, :OWN] = own
    inner = ~edge[1:n]
    out[1:, OWN : 2 * OWN][inner] = own[:-1][inner]
    out[:-1, 2 * OWN : 3 * OWN][inner] = own[1:][inner]
    out[:, -3] = edge[:n]
    out[:, -2] = edge[1:]
    out[-1, -2] = 1
    out[:, -1] = 1
    return out


def forward_backward(unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (up to each text's constant) of good and bad before and after each line.

    ``unary`` is a line's score for bad against good, ``pair`` the score of a label after a label.
    """
    n = len(unary)
    score = np.stack([np.zeros(n), unary], axis=1)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    begin = first[:-1][order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    if n:
        ahead[begin[: active[0]]] = score[begin[: active[0]]]
    for t in range(1, len(active)):
        at = begin[: active[t]] + t
        before = ahead[at - 1]
        ahead[at] = score[at] + np.logaddexp(before[:, :1] + pair[0], before[:, 1:] + pair[1])
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        after = behind[at] + score[at]
        behind[at - 1] = np.logaddexp(after[:, :1] + pair[:, 0], after[:, 1:] + pair[:, 1])
    return ahead, behind


def marginals(ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Probability of each line to be bad."""
    total = ahead + behind
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50)))


def fit_field(x: np.ndarray, y: np.ndarray, first: np.ndarray, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and label pairs that make the labels ``y`` of the lines most likely, by Adam on all of them."""
    w, pair = start or (np.zeros(x.shape[1]), np.zeros((2, 2)))
    w, pair = w.copy(), pair.copy()
    n_texts = max(1, len(first) - 1)
    inner = np.ones(len(x), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    moments = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for step in range(1, STEPS + 1):
        unary = x @ w
        ahead, behind = forward_backward(unary, pair, first)
        p = marginals(ahead, behind)
        joint = ahead[inner - 1][:, :, None] + pair + (behind[inner] + np.stack([np.zeros(len(inner)), unary[inner]], axis=1))[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        gradient = np.r_[x.T @ (y - p), (seen - expected).ravel()] / n_texts - RIDGE * np.r_[w, pair.ravel()]
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = RATE * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w += move[:-4]
        pair += move[-4:].reshape(2, 2)
    return w, pair


class Model(NamedTuple):
    weights: np.ndarray
    pair: np.ndarray
    bias: float
    slope: float
    empty: float  # score of a text without words


def bad_shares(weights: np.ndarray, pair: np.ndarray, own: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities to be bad; nan for a text without lines."""
    ahead, behind = forward_backward(with_neighbours(own, first) @ weights, pair, first)
    sums = np.r_[0.0, np.cumsum(marginals(ahead, behind) * size)]
    total = np.r_[0.0, np.cumsum(size)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (sums[first[1:]] - sums[first[:-1]]) / (total[first[1:]] - total[first[:-1]])


def fit(sample: DataFrame, sizes: dict[int, int]) -> Model:
    """Learn from (body, quality), a bounded sample; ``sizes`` are the class sizes of all training labels."""
    n_good, n_bad = sizes.get(1, 0), sizes.get(0, 0)
    empty = (n_good + 1) / (n_good + n_bad + 2)

    def features(rows: Iterable[tuple]) -> Iterator[tuple]:
        for group in grouped(rows, 0):
            own, size, first = line_features([t or b"" for t, _ in group])
            for k, (_, quality) in enumerate(group):
                a, b = int(first[k]), int(first[k + 1])
                if b - a > LINES:
                    a += xxhash.xxh64_intdigest(group[k][0], 5) % (b - a - LINES + 1)
                    b = a + LINES
                if a < b:
                    yield quality, own[a:b].tobytes(), size[a:b].astype(np.float32).tobytes()

    rows = arrow_rows(sample, features, "quality int, own binary, size binary", 64).collect()
    rows.sort(key=lambda r: (r.quality, bytes(r.own)))  # the sum of a gradient depends on the order
    quality = np.array([r.quality for r in rows])
    if len(np.unique(quality)) < 2:
        return Model(np.zeros(3 * OWN + 3), np.zeros((2, 2)), float(np.log(empty / (1 - empty))), 0.0, empty)
    parts = [np.frombuffer(r.own, np.float32).reshape(-1, OWN) for r in rows]
    first = np.cumsum([0, *(len(p) for p in parts)])
    own, size = np.concatenate(parts), np.concatenate([np.frombuffer(r.size, np.float32) for r in rows])
    x = with_neighbours(own, first)
    bad = np.repeat(quality == 0, np.diff(first))
    y, field = bad.astype(float), None
    for _ in range(ROUNDS):
        field = fit_field(x, y, first, field)
        ahead, behind = forward_backward(x @ field[0], field[1], first)
        p = np.where(bad, marginals(ahead, behind), -1.0)
        worst = np.maximum.reduceat(p, first[:-1])
        y = (bad & ((p > 0.5) | (p == np.repeat(worst, np.diff(first))))).astype(float)
    share = bad_shares(*field, own, size, first)
    weight = np.where(quality == 1, n_good / max(1, (quality == 1).sum()), n_bad / max(1, (quality == 0).sum()))
    bias, slope = fit_curve(1 - share, quality.astype(float), weight)
    return Model(*field, bias, slope, empty)


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    own, size, first = line_features(texts)
    share = bad_shares(model.weights, model.pair, own, size, first)
    score = 1 / (1 + np.exp(-np.clip(model.bias + model.slope * (1 - share), -30, 30)))
    return np.where(np.isnan(share), model.empty, score)


def score_column(model: Model, text: str | Column) -> Column:
    """Probability of label 1 of a text column; null and empty texts have the share of label 1."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for group in grouped(((t.as_py() or b"",) for t in texts), 0, 1 << 20):
            out.append(score_texts(model, [t for (t,) in group]))
        return pa.array(np.concatenate(out), pa.float64())

    return run(raw(text))


def training_sample(
    docs: DataFrame, labels: DataFrame, text: str, key: str, sample: int = SAMPLE
) -> tuple[DataFrame, dict[int, int]]:
    """(body, quality) of at most ``sample`` labelled rows of each class of the training part, and the class sizes."""
    known = (
        labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1) & (fold(key, 3) != 1))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max("quality").cast("int").alias("quality"), F.min("quality").alias("least"))
        .where("quality = least").select("key", "quality")
    )
    sizes = dict(known.groupBy("quality").count().collect())
    chosen = [
        known.where(F.col("quality") == y).orderBy(F.xxhash64(F.lit(3), "key"), "key").limit(sample) for y in (0, 1)
    ]
    # the chosen keys are bounded: no text is shuffled to meet its label
    picked = docs.select(F.col(key).alias("key"), raw(text).alias("body")).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "key"
    )
    # of rows that repeat an id the one with the least text
    one = picked.groupBy("key").agg(F.min(F.struct(F.coalesce("body", F.lit(b"")).alias("body"), "quality")).alias("r"))
    return one.select("r.body", "r.quality"), sizes


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; repeated rows are scored each time."""
    model = fit(*training_sample(docs, labels, text, key))
    return docs.select(
        F.col(key).alias("doc_id"), (fold(key, 3) == 1).alias("held_out"), score_column(model, text).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
