"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel compares windows of text, words as a rule: it counts the ordered symbol
triples that both hold, gaps allowed, each gap at a discount. So characters put between
an insult's letters, or left out of it, cost some likeness only. Landmark windows give
Nyström features, on which a linear machine with squared hinge loss is trained.

A document is toxic if one of its windows is; which one, no label says. Training
therefore alternates between fitting the machine and choosing each toxic document's
windows, while all windows of the other documents are negative (multiple-instance
learning). The document's score is its highest window's margin, put through a logistic curve that
is fitted to documents held back from the training.

As the kernel is an inner product, landmarks and coefficients fold into one weight for
each triple, and a window is scored by looking up its triples.

Defined results: null and empty texts score as the lowest margin; without labels of both kinds every
score is the share of toxic labels (0 without labels); repeated rows get equal results;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_mart.llm.common import extended, in_slices, joined, kept, schema_of
from ledger_mart.llm.learning import by_chance, sample_by_class, whitening

SAMPLE = 4000  # labelled documents learned from, at most
LANDMARKS = 256
SYMBOLS = 64
SPAN = 5  # a triple reaches over so many symbols at most
DECAY = 0.6  # for each symbol left out
WINDOW = 24
ROUNDS = 5
CUT = 0.3
SUPPORT = 2  # toxic documents that must point to a window for it to be learned, where any window has so many
OFTEN = 0.08  # of the documents that hold the toxic documents' commonest own window: what is in so many is an insult of its own
TOGETHER = 0.1  # of those documents: how often one counts at least, though it is seldom the chosen one
PUT_IN, VARIED = 4, 4  # variants for each place of a word, and how much less one counts than the word
#: Windows of each clean document that are learned from in each round, and how many of them all: the highest, and some of the rest.
NEGATIVES, HARD, EASY = 2, 6000, 2000
_EDGE, _OTHER = 0, 1
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_INSERTED = re.compile(r"[\W_]+")
_TRIM = ".,!?;:\"'()[]{}«»…-"
_KEPT = 100_000


def _symbols() -> np.ndarray:
    """Symbol by code point: edges, other characters, a to z, digits, and a hash of other letters."""
    point = np.arange(0x110000, dtype=np.uint64)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    hashed = 38 + (point * np.uint64(2654435761) >> np.uint64(9)) % np.uint64(SYMBOLS - 38)
    table = np.where(letter, hashed, _OTHER).astype(np.uint8)
    table[97:123] = range(2, 28)
    table[48:58] = range(28, 38)
    return table


def windows(text: str | None) -> set[str]:
    """The different windows of a text: its words in lower case, those with signs also without
    them, rows of single characters put together, and long windows in pieces."""
    text = (text or "").lower()
    found = {w.strip(_TRIM) or w for w in set(text.split())}
    if "  " in text or re.search(r"(?<!\S)\S\s\S\s\S(?!\S)", text):
        found |= {"".join(m.group().split()) for m in _SPACED.finditer(text)}
    for odd in [w for w in found if not w.isalnum()]:
        found.add(_INSERTED.sub("", odd) or odd)
    for long in [w for w in found if len(w) > WINDOW]:
        found.remove(long)
        found |= {long[i : i + WINDOW] for i in range(0, len(long) - WINDOW // 2, WINDOW // 2)}
    return found


class Triples:
    """Codes and weights of the triples of windows: (windows x triples), 0 weight where there is none."""

    def __init__(self) -> None:
        self.symbols = kept("toxicity", "window symbols", _symbols)
        self.offsets = [(a, b) for b in range(2, SPAN) for a in range(1, b)]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        width = max(map(len, words)) + 2
        symbol = np.zeros((len(words), width + SPAN), np.int32)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(w) for w in words])
        row = np.repeat(np.arange(len(words)), length)
        column = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
        symbol[row, column + 1] = self.symbols[points]
        place = np.arange(width)
        codes, weights = [], []
        for a, b in self.offsets:
            codes.append((symbol[:, :width] * SYMBOLS + symbol[:, a : a + width]) * SYMBOLS + symbol[:, b : b + width])
            weights.append(np.where(place + b < length[:, None] + 2, DECAY ** (b - 2), 0).astype(np.float32))
        codes, weights = np.hstack(codes), np.hstack(weights)
        return codes, weights / np.maximum(np.sqrt((weights**2).sum(axis=1, keepdims=True)), 1e-6)


@dataclass
class Model:
    weights: np.ndarray  # by triple
    bias: float
    slope: float
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        codes, weights = Triples()(words)
        return (self.weights[codes] * weights).sum(axis=1) + self.bias

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def xxh32(text: str) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(text.encode("utf-8", "surrogatepass"))


def variants(word: str) -> list[str]:
    """The word with a letter put between two of its own, and with an inner one left out: what its writers
    do to hide it. Which letter is put in depends on the word and the place alone."""
    if len(word) < 4 or not word.isalpha():
        return []
    put = [word[:i] + chr(97 + xxh32(f"{word} {i} {k}") % 26) + word[i:] for i in range(1, len(word)) for k in range(PUT_IN)]
    return put + [word[:i] + word[i + 1 :] for i in range(1, len(word) - 1) if len(word) > 4]


def by_length(words: Iterable[str], most: int = 2_000) -> Iterator[list[str]]:
    """Lots of windows of like length, so that little is padding."""
    words = sorted(words, key=len)
    for at in range(0, len(words), most):
        yield words[at : at + most]


def margins_of(model: Model, words: Iterable[str]) -> dict[str, float]:
    return {w: m for lot in by_length(words) for w, m in zip(lot, model.margins(lot).tolist())}


def _kernel_to(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The triples that the landmarks hold, and landmarks x triples."""
    codes, weights = Triples()(marks)
    used, at = np.unique(codes, return_inverse=True)
    dense = np.zeros((len(marks), len(used)), np.float32)
    np.add.at(dense, (np.arange(len(marks))[:, None], at.reshape(codes.shape)), weights)
    return used, dense


def _kernel(words: list[str], used: np.ndarray, dense: np.ndarray) -> np.ndarray:
    found = np.zeros((len(words), len(dense)), np.float32)
    at = np.full(SYMBOLS**3, len(used), np.int32)
    at[used] = np.arange(len(used))
    wide = np.vstack([dense.T, np.zeros((1, len(dense)), np.float32)])
    for start in range(0, len(words), 256):
        codes, weights = Triples()(words[start : start + 256])
        for i, (c, w) in enumerate(zip(codes, weights)):
            held = w > 0
            found[start + i] = w[held] @ wide[at[c[held]]]
    return found


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for 1/2 ridge |w|^2 + sum cost max(0, 1 - y x.w)^2, the last column the bias."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.ones(x.shape[1])
    keep[-1] = 1e-6
    for _ in range(30):
        short = 1 - y * (x @ w) > 0
        a, c = x[short], cost[short]
        new = np.linalg.solve(2 * a.T @ (a * c[:, None]) + np.diag(keep), 2 * a.T @ (c * y[short]))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def _logistic(margin: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, with smoothed targets."""
    up, down = weight[truth == 1].sum(), weight[truth == 0].sum()
    target = np.where(truth == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margin, np.ones_like(margin)])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _first_margins(docs: list[set[str]], truth: np.ndarray) -> dict[str, float]:
    """Log odds of a window's adjacent triples, from the documents of each kind that hold them."""
    held = {0: np.zeros(SYMBOLS**3, np.float32), 1: np.zeros(SYMBOLS**3, np.float32)}
    triples = Triples()
    for words, label in zip(docs, truth):
        if words:
            codes, weights = triples(list(words))
            held[label][np.unique(codes[weights > 0])] += 1
    share = [(held[k] + 0.5) / ((truth == k).sum() + 1) for k in (0, 1)]
    odds = np.log(share[1] / share[0]).astype(np.float32)
    first = Model(odds, 0.0, 1.0, 0.0)
    return margins_of(first, set().union(*docs))


def fit(docs: list[set[str]], truth: np.ndarray, share: float) -> Model:
    """``share``: of toxic ones among all labelled documents."""
    constant = Model(np.zeros(SYMBOLS**3, np.float32), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if len(set(truth.tolist())) < 2:
        return constant
    back = np.arange(len(docs)) % 4 == 3  # held back for the logistic curve
    train = [(d, t) for d, t, b in zip(docs, truth, back) if not b and d]
    toxic, clean = [d for d, t in train if t], [d for d, t in train if not t]
    if not toxic or not clean:
        return constant
    in_clean = Counter(w for d in clean for w in d)
    in_toxic = Counter(w for d in toxic for w in d)
    most = max((n for w, n in in_toxic.items() if w not in in_clean), default=0)
    # a document may hold several insults, of which only one is chosen below
    often = sorted(w for w, n in in_toxic.items() if w not in in_clean and n >= max(SUPPORT, OFTEN * most))
    own = [[w for w in d if w not in in_clean] or list(d) for d in toxic]
    value = _first_margins([d for d, _ in train], np.array([t for _, t in train]))
    negative: set[str] = set()
    for turn in range(ROUNDS):
        chosen = Counter(max(words, key=lambda w: (value[w], w)) for words in own)
        for words in clean:
            negative.update(sorted(words, key=lambda w: (-value[w], w))[:NEGATIVES])
        apart = [w for w in chosen if w not in in_clean] or list(chosen)
        # what one document alone suggests may be any of its rare words
        shared = [w for w in apart if chosen[w] >= SUPPORT] or apart
        shared = list(dict.fromkeys([*shared, *often]))
        weight_of = {w: max(chosen[w], min(in_toxic[w], TOGETHER * most)) for w in shared}
        made = {v: weight_of[w] / VARIED for w in often for v in variants(w) if v not in in_clean and v not in weight_of}
        weight_of |= made
        positive = [*shared, *made]
        rest = sorted(negative - set(positive), key=lambda w: (-value[w], w))
        rest = rest[:HARD] + rest[HARD :: max(1, len(rest) // EASY)]
        by_count = sorted(shared, key=lambda w: (-weight_of[w], w)) + sorted(made, key=lambda v: xxh32(v))
        half = LANDMARKS // 2
        marks = by_count[: half // 2] + by_count[half // 2 :: max(1, len(by_count) // half)][:half] + rest[:: max(1, len(rest) // half)][:half]
        used, dense = _kernel_to(list(dict.fromkeys(marks)))
        white = whitening(dense @ dense.T)
        words = positive + rest
        x = np.column_stack([_kernel(words, used, dense) @ white, np.ones(len(words))])
        y = np.repeat([1.0, -1.0], [len(positive), len(rest)])
        cost = np.concatenate([[weight_of[w] for w in positive], np.ones(len(rest))])
        cost[: len(positive)] *= len(rest) / cost[: len(positive)].sum() / 2
        w = _machine(x, y, cost)
        weights = np.zeros(SYMBOLS**3, np.float32)
        weights[used] = dense.T @ (white @ w[:-1])
        model = Model(weights, float(w[-1]), 1.0, 0.0)
        value = margins_of(model, set().union(*docs) if turn == ROUNDS - 1 else value)
    lowest = min(value.values())
    margin = np.array([max((value[w] for w in d), default=lowest) for d in docs])
    of = back if len(set(truth[back].tolist())) == 2 else np.ones(len(docs), bool)
    kind = truth[of]
    weight = np.where(kind == 1, share / max(1, kind.sum()), (1 - share) / max(1, (1 - kind).sum())) * of.sum()
    model.slope, model.shift = _logistic(margin[of], kind, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """From the windows of at most about ``most`` labelled documents, as many toxic as not
    where there are enough. Of several labels of a document the highest counts."""
    toxic = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), toxic.where("doc_id is not null"), ["doc_id"])
    rows, counts = sample_by_class(known, "toxic", "doc_id", most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(windows(t.as_py()))) for t in batch.column("text")]
            yield extended(batch, ["doc_id", "toxic"], found=pa.array(found, pa.string()))

    got = by_chance(rows.mapInArrow(cut, "doc_id long, toxic int, found string").collect(), "doc_id")
    total = sum(counts.values())
    return fit([set(r["found"].split()) for r in got], np.array([r["toxic"] for r in got], int), counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id unless given) with score and ``window``, the one that decided it."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    run = uuid.uuid4().hex  # margins stay known to a process from task to task of one run

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        state = kept("toxicity", "margins", dict)
        if state.get("run") != run:
            state.clear()
        state["run"], known = run, state.setdefault("known", {})
        for batch in in_slices(batches, 1 << 20):
            margin, window = [], []
            for at in range(0, len(batch), 256):
                found = [windows(t.as_py()) for t in batch.column("_text")[at : at + 256]]
                if len(known) > _KEPT:
                    known.clear()
                known.update(margins_of(model, set().union(*found) - known.keys()))
                best = [max(f, key=known.__getitem__, default="") for f in found]
                window += [b or None for b in best]
                margin += [known[b] if b else -1e3 for b in best]
            score = model.chance(np.array(margin, float))
            yield extended(batch, keep, score=pa.array(score), window=pa.array(window, pa.string()))

    schema = schema_of(docs, keep, "score double, window string")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, taught: Column) -> DataFrame:
    """doc_id, score and window of every document, learned from labels of those ``taught``."""
    return score(docs, learn(docs.where(taught), labels))
