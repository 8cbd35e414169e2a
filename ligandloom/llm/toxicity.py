"""Toxicity of whole texts: a lexicon, found with its misspellings, weighed by context.

The lexicon is a trie. A Levenshtein automaton over all its terms at once is the
intersection of the trie with "at most e edits": its states are sets of
(trie node, edits so far), made as they are first reached, so a word costs one table
step per letter and most words die after a few. Short terms allow no edit, middle
ones one, long ones two.

Terms are a small seed list and the words that training documents labelled toxic
hold far more often than the others, as a likelihood ratio test tells: of the words that pass, a part of
LEVEL may do so by chance, so neither their number nor a share of the texts is fixed. What a term's exact and
misspelt finds are worth is their precision in the training documents. A find counts less where its
window of words quotes or reports, and more next to the second person. A logistic curve turns
the sum, and the sum for each STRETCH of the text, as finds by chance add up in long ones, into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.common import arrow_rows, fold, raw
from ligandloom.llm.tokens import grouped, mix, shingles, tokenise
from ligandloom.session import discard, stored

SEED = (
    "idiot moron stupid loser pathetic worthless disgusting scum trash clown imbecile bastard bitch asshole "
    "dumbass retard vermin filthy shithead scumbag"
).split()
#: A learned term is this many times as often in distinct toxic texts as in the others. The level is the part of the
#: learned terms that may pass the test by chance.
RATIO, LEVEL = 15.0, 0.05
#: Letters of the shortest learned term.
SHORTEST = 3
#: Words of a run by which near copies among the training texts are told, and rounds of telling them.
KIN, ROUNDS = 5, 3
#: The curve and the lexicon are fitted on at most so many labelled rows of each class, chosen by a hash of their keys.
SAMPLE = 20_000
WINDOW = 8
QUOTED, ADDRESSED = 0.25, 1.25
#: Bytes by which the density of finds is measured.
STRETCH = 1000
THRESHOLD = 0.3
#: Words a worker remembers, and states it keeps of the automaton, before it starts afresh.
MEMO, STATES = 150_000, 50_000

EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‹›‘’‚…¡¿–—"
QUOTES = tuple(q.encode() for q in "\"“”„«»‹›‘’‚") + (b"'",)
REPORTS = frozenset(
    w.encode()
    for w in (
        "said says called calls wrote writes quoted quote quotes word words term terms means meaning "
        "sagte nannte schrieb wort zitat dijo llamó escribió palabra cita dit appelé écrit mot citation"
    ).split()
)
PERSON = frozenset(
    w.encode() for w in "you your you're youre u du dich dir ihr tú tu te usted vous toi ton ta".split()
)


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Finds the term nearest to a word; equal distances go to the term that comes first."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.allow: list[int] = [0]
        for at, term in enumerate(terms):
            node, most = 0, edits_for(term)
            self.allow[0] = max(self.allow[0], most)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.allow.append(0)
                node = self.next[node][c]
                self.allow[node] = max(self.allow[node], most)
            if self.term[node] < 0:
                self.term[node] = at
        self.letters = {c for t in terms for c in t}
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state(self._close({0: 0}))

    def _close(self, nodes: dict[int, int]) -> dict[int, int]:
        """Letters of a term may be missing from the word: go down the trie at one edit each."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes[node] < e:
                continue
            for child in self.next[node].values():
                if e + 1 <= self.allow[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [
                (e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= edits_for(self.terms[self.term[n]])
            ]
            self.found.append(min(ends) if ends else None)
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allow[node] and nodes.get(node, 99) > e:
                nodes[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)
            for c, child in self.next[node].items():
                reach(child, e if c == letter else e + 1)
        return self._state(self._close(nodes))

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) or None."""
        if len(self.sets) > STATES:
            self._restart()
        state = self.start
        for c in word:
            if c not in self.letters:
                c = "\0"
            step = self.steps[state].get(c)
            if step is None:
                step = self.steps[state][c] = self._step(state, c)
            state = step
            if not self.sets[state]:
                return None
        found = self.found[state]
        return None if found is None else (found[1], found[0])


def bare(token: bytes) -> str:
    """The word of a token: lower case, without punctuation around it."""
    return token.decode("utf-8", "replace").lower().strip(EDGE)


class _Memo(dict):
    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, token: bytes):
        word = bare(token)
        found = self.automaton.match(word) if word else None
        if len(self) >= MEMO:
            self.clear()
        self[token] = found
        return found


_MEMOS: dict[tuple[str, ...], _Memo] = {}


def memo_of(terms: list[str]) -> _Memo:
    """Made once in a worker and used for all its tasks."""
    key = tuple(terms)
    if key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[key] = _Memo(LexiconAutomaton(terms))
    return _MEMOS[key]


def finds(memo: _Memo, text: bytes) -> Iterator[tuple[int, int, float]]:
    """(term, edits, context factor) of each find in a text."""
    tokens = text.split()
    for at, found in [(i, f) for i, t in enumerate(tokens) if (f := memo[t]) is not None]:
        around = tokens[max(0, at - WINDOW) : at + WINDOW + 1]
        quoted = (
            tokens[at].startswith(QUOTES) and tokens[at].endswith(QUOTES + tuple(q + p for q in QUOTES for p in (b".", b",")))
            or _inside_quotes(tokens, at)
            or any(t.lower().strip(b".,:;!?") in REPORTS for t in around)
        )
        near = any(t.lower().strip(b".,:;!?") in PERSON for t in around)
        yield found[0], found[1], QUOTED if quoted else ADDRESSED if near else 1.0


def _inside_quotes(tokens: list[bytes], at: int) -> bool:
    """A quotation opens before and closes after the word, within the window."""
    before = tokens[max(0, at - WINDOW) : at + 1]
    after = tokens[at : at + WINDOW + 1]
    opened = any(t.startswith(QUOTES) for t in before)
    closed = any(t.rstrip(b".,:;!?").endswith(QUOTES) for t in after)
    return opened and closed


class Model(NamedTuple):
    terms: list[str]
    exact: np.ndarray  # worth of an exact find of each term
    fuzzy: np.ndarray  # worth of a misspelt one
    bias: float
    slope: float
    density: float


def evidence(model: Model, found: Iterable[tuple[int, int, float]], size: int) -> tuple[float, float]:
    """Logarithms of what the finds of a text of ``size`` bytes are worth, and of that for each stretch; 0, 0 without finds."""
    total = sum((model.fuzzy[t] if e else model.exact[t]) * c for t, e, c in found)
    return math.log1p(total), math.log1p(total / (1 + size / STRETCH))


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    """Of rows of evidence."""
    return 1 / (1 + np.exp(-np.clip(model.bias + x @ np.array([model.slope, model.density]), -30, 30)))


def _document_words(rows: Iterable[tuple]) -> Iterator[tuple[str, int, int]]:
    """(word, toxic, texts of this partition that hold it), a bounded table at a time."""
    count: Counter[tuple[str, int]] = Counter()
    for text, toxic in rows:
        words = set(map(bare, set((text or b"").split())))
        count.update((w, toxic) for w in words if len(w) >= SHORTEST)
        if len(count) >= MEMO:
            yield from ((w, y, n) for (w, y), n in count.items())
            count.clear()
    yield from ((w, y, n) for (w, y), n in count.items())


def _marked(rows: Iterable[tuple]) -> Iterator[tuple[list[int], bytes, int]]:
    """(least hashes of the runs of ``KIN`` words, text, toxic): near copies mostly agree in each hash, other texts do not."""
    for group in grouped(rows, 0):
        tokens = tokenise([t or b"" for t, _ in group])
        runs = shingles(tokens.hashes, KIN)
        for (text, toxic), a, b in zip(group, tokens.first[:-1].tolist(), tokens.first[1:].tolist()):
            part = runs[a : b - KIN + 1] if b - a >= KIN else tokens.hashes[a:b]
            least = [int(mix(part + np.uint64(k)).min().view(np.int64)) if len(part) else 0 for k in range(ROUNDS)]
            yield least, text or b"", toxic


def _surprise(t: Column, o: Column, n_toxic: int, n_other: int) -> Column:
    """The likelihood ratio statistic of a word in ``t`` toxic and ``o`` other texts."""
    both, share = t + o, n_toxic / (n_toxic + n_other)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (
        part(t, both * share) + part(o, both * (1 - share))
        + part(n_toxic - t, n_toxic - both * share) + part(n_other - o, n_other - both * (1 - share))
    )


def learn_terms(train: DataFrame) -> list[str]:
    """The lexicon: the seed and the words that mark the toxic training texts (body, toxic).

    Copies and near copies are no independent texts: of those that agree in a least hash of their runs of words,
    one counts. The chance of a statistic of x or more is below exp(-x / 2);
    the bar is the least x that so few of the words tried pass by chance.
    """
    marked = arrow_rows(train.select("body", "toxic"), _marked, "h array<bigint>, body binary, toxic int", batch=256)
    for k in range(ROUNDS):
        first = F.min(F.struct("body", "h")).alias("first")
        marked = marked.groupBy(F.col("h")[k].alias("least"), "toxic").agg(first).select("first.*", "toxic")
    texts = stored(marked.select("body", "toxic"), "texts")
    sizes = dict(texts.groupBy("toxic").count().collect())
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return list(SEED)
    words = stored(
        arrow_rows(texts, _document_words, "word string, toxic int, n bigint").groupBy("word")
        .agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("o")),
        "words",
    )
    t, o = F.col("t"), F.col("o")
    often = (t + 0.5) / (n_toxic + 1) >= RATIO * (o + 0.5) / (n_other + 1)
    marks = words.where(often).withColumn("x", F.floor(_surprise(t, o, n_toxic, n_other)))
    tried, passed, bar = words.count(), 0, math.inf
    # a statistic is below 2 * n * log(n) for n texts in the sample, which bounds these rows
    for x, n in sorted(marks.groupBy("x").count().collect(), reverse=True):
        passed += n
        if tried * math.exp(-x / 2) <= LEVEL * passed:
            bar = x
    learned = [] if bar == math.inf else marks.where(F.col("x") >= bar).select("t", "word").collect()
    for done in (words, texts):
        discard(done)
    return list(dict.fromkeys([*SEED, *(w for _, w in sorted((-r.t, r.word) for r in learned))]))


def _worth(toxic: int, other: int, n_toxic: int, n_other: int, prior: float) -> float:
    """From -1 ... 1, cut at 0: balanced precision of a find, held to ``prior`` where little was seen."""
    t, o, s = toxic / max(n_toxic, 1), other / max(n_other, 1), 2 / max(n_toxic, 1)
    return max(0.0, 2 * (t + prior * s) / (t + o + s) - 1)


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Bias and the weight of each column of evidence in a logistic curve with a small ridge, by Newton steps.

    Evidence that would speak against class 1 is left out: all columns are tried, then each alone, the last first.
    """
    design = np.c_[np.ones(len(x)), x]
    every = list(range(design.shape[1]))
    out = np.zeros(len(every))
    for columns in (every, *([0, k] for k in reversed(every[1:]))):
        part, w = design[:, columns], np.zeros(len(columns))
        ridge = np.where(np.array(columns) == 0, 1e-3, 1e-1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            gradient = part.T @ (n * (p - y)) + ridge * w
            curve = (part * (n * p * (1 - p))[:, None]).T @ part + np.diag(ridge)
            step = np.linalg.solve(curve, gradient)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            out[columns] = w
            return tuple(out.tolist())
    out[0] = math.log((n @ y + 0.5) / (n @ (1 - y) + 0.5))
    return tuple(out.tolist())


def fit(train: DataFrame) -> Model:
    """Learn from (body binary, toxic int), in four passes over it whose results are small."""
    terms = learn_terms(train)

    def find(rows: Iterable[tuple]) -> Iterator[tuple]:
        memo = memo_of(terms)
        for text, toxic in rows:
            merged: Counter = Counter()
            for t, e, c in finds(memo, text or b""):
                merged[t, min(e, 1), c] += 1
            yield toxic, len(text or b""), [(t, e, c, k) for (t, e, c), k in sorted(merged.items())]

    found = stored(
        arrow_rows(
            train, find, "toxic int, size bigint, found array<struct<term:int,edit:int,factor:double,n:bigint>>"
        ),
        "finds",
    )
    sizes = dict(found.groupBy("toxic").count().collect())
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return Model(terms, np.full(len(terms), 0.8), np.full(len(terms), 0.6), -3.0, 4.0, 0.0)
    seen = found.select("toxic", F.explode(F.array_distinct(F.transform("found", lambda f: F.struct(f.term, f.edit)))))
    counts = {
        (r.term, r.edit): (r.t, r.o)
        for r in seen.select("toxic", "col.*").groupBy("term", "edit")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")).collect()
    }
    exact = np.array([_worth(*counts.get((t, 0), (0, 0)), n_toxic, n_other, 0.9) for t in range(len(terms))])
    fuzzy = np.array([_worth(*counts.get((t, 1), (0, 0)), n_toxic, n_other, 0.8) for t in range(len(terms))])
    model = Model(terms, exact, fuzzy, 0.0, 0.0, 0.0)

    def weigh(rows: Iterable[tuple]) -> Iterator[tuple]:
        for toxic, size, all_finds in rows:
            x = evidence(model, ((f["term"], f["edit"], f["factor"] * f["n"]) for f in all_finds), size)
            yield toxic, *(round(v, 3) for v in x)

    # no more places than texts in the sample
    weighed = arrow_rows(found, weigh, "toxic int, x double, d double").groupBy("x", "d", "toxic").count()
    places = np.array(sorted(weighed.select("x", "d", "toxic", "count").collect()), float)  # sums in one order
    discard(found)
    bias, slope, density = fit_curve(places[:, :2], places[:, 2], places[:, 3])
    return model._replace(bias=bias, slope=slope, density=density)


def score_column(model: Model, text: str | Column) -> Column:
    """Probability that a text is toxic; null and empty texts have no find and so the base probability."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = memo_of(model.terms)
        for texts in batches:
            bodies = [t.as_py() or b"" for t in texts]
            x = np.array([evidence(model, finds(memo, t), len(t)) for t in bodies], float).reshape(-1, 2)
            yield pa.array(probability(model, x), pa.float64())

    return run(raw(text))


def training_rows(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE
) -> DataFrame:
    """(body, toxic) of at most ``sample`` labelled rows of each class, from the training part of the keys.

    Null and conflicting labels teach nothing. The chosen keys are bounded, so
    they are broadcast and no text is shuffled to meet its label.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & (fold(key, 4) != 2))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max("toxic").cast("int").alias("toxic"), F.min("toxic").alias("least")).where("toxic = least")
        .select("key", "toxic")
    )
    chosen = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(5), "key"), "key").limit(sample) for y in (0, 1)
    ]
    return stored(
        docs.select(F.col(key).alias("key"), raw(text).alias("body"))
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "key").select("body", "toxic"),
        "training",
    )


def fit_once(docs: DataFrame, labels: DataFrame, text: str, key: str) -> Model:
    """The model of ``training_rows``, whose table goes once it is fitted."""
    train = training_rows(docs, labels, text, key)
    model = fit(train)
    discard(train)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; nulls and repeated rows are scored like any other."""
    model = fit_once(docs, labels, text, key)
    return (
        docs.select(F.col(key).alias("doc_id"), (fold(key, 4) == 2).alias("held_out"), score_column(model, text).alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold; all columns stay whatever their names."""
    model = fit_once(docs, labels, text, key)
    return docs.where(score_column(model, text) < THRESHOLD)
