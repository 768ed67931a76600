"""Language identification by string kernels.

The kernel of two texts counts the letter n-grams of one to three symbols that both
hold, over the root of the product of how many each holds. Landmark texts give Nyström
features; kernel ridge regression on them holds each language against the rest. As the
kernel is an inner product, landmarks and coefficients fold into one weight for each
n-gram and language, and a batch of texts is scored by the product of its sparse
presence matrix with those weights.

The machine tells learned languages apart and says little of other texts: its best output
is never far below the others' mean. Whether a text is in a learned language at all is judged by
``Familiar``: the mean log probability of its trigrams, against that of labelled texts held back.

Defined results: ``und`` and score 0 for null texts, texts without a letter, and if there is nothing to
learn from; one language learned is predicted for every text with a letter; rows without
lang teach nothing; repeated rows get equal results; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_mart.llm.common import extended, in_slices, kept, schema_of
from ledger_mart.llm.learning import by_chance, sample_by_class, whitening

SYMBOLS = 64
FEATURES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
SAMPLE = 2000  # texts learned from, at most
LANDMARKS = 300
RIDGE = 1e-3
UNKNOWN = "und"


def _symbol_table() -> np.ndarray:
    """Symbol by code point: 0 for what is no letter, a to z, and a hash of other letters."""
    point = np.arange(0x110000, dtype=np.uint64)
    letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    hashed = 27 + (point * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SYMBOLS - 27)
    table = np.where(letter, hashed, 0).astype(np.uint8)
    table[97:123] = range(1, 27)
    return table


class Presence:
    """Sorted codes of the n-grams that a text holds."""

    def __init__(self) -> None:
        self.symbols = kept("language", "letter symbols", _symbol_table)
        self.held = np.zeros(FEATURES, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.symbols[points].astype(np.int32)
        if not symbol.any():
            return np.zeros(0, np.int32)
        symbol = np.concatenate([[0], symbol, [0]]).astype(np.int32)
        symbol = symbol[np.r_[True, (symbol[1:] > 0) | (symbol[:-1] > 0)]]
        self.held[symbol] = True
        pair = symbol[:-1] * SYMBOLS + symbol[1:]
        self.held[SYMBOLS + pair] = True
        self.held[SYMBOLS + SYMBOLS**2 + pair[:-1] * SYMBOLS + symbol[2:]] = True
        found = np.flatnonzero(self.held)
        self.held[found] = False
        return found[found > 0].astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-grams x languages, of unit-length presence vectors
    bias: np.ndarray

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """Texts x languages; each row is the text's presence vector times the weights."""
        starts = np.cumsum([0, *[len(f) for f in found[:-1]]])
        sums = np.add.reduceat(self.weights[np.concatenate(found)], starts, axis=0)
        return sums / np.sqrt([len(f) for f in found])[:, None] + self.bias


def fit(found: list[np.ndarray], languages: list[str], counts: dict[str, int]) -> Model | None:
    """Texts in an order of chance; the landmarks are the first of each language in turn.
    Each language weighs as its count in the corpus, however many of its texts are here."""
    pairs = [(f, lang) for f, lang in zip(found, languages) if len(f)]
    if not pairs:
        return None
    found, languages = [p[0] for p in pairs], [p[1] for p in pairs]
    names = sorted(set(languages))
    turn = {}
    order = sorted(range(len(found)), key=lambda i: (turn.setdefault(languages[i], iter(range(len(found)))).__next__(), i))
    marks = order[:LANDMARKS]
    used = np.unique(np.concatenate([found[i] for i in marks]))
    dense = np.zeros((len(marks), len(used)), np.float32)
    for row, i in enumerate(marks):
        dense[row, np.searchsorted(used, found[i])] = 1 / np.sqrt(len(found[i]))
    kernel = np.zeros((len(found), len(marks)))
    for i, f in enumerate(found):
        at = np.searchsorted(used, f)
        at = at[at < len(used)]
        at = at[np.isin(used[at], f, assume_unique=True)]
        kernel[i] = dense[:, at].sum(axis=1) / np.sqrt(len(f))
    white = whitening(kernel[marks])
    features = kernel @ white
    truth = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    balance = np.array([counts[x] / languages.count(x) for x in languages])
    balance *= len(found) / balance.sum()
    centre, middle = np.average(features, axis=0, weights=balance), np.average(truth, axis=0, weights=balance)
    x, y = features - centre, truth - middle
    left = x.T @ (x * balance[:, None]) + RIDGE * len(found) * np.eye(x.shape[1])
    solved = np.linalg.solve(left, x.T @ (y * balance[:, None]))
    weights = np.zeros((FEATURES, len(names)), np.float32)
    weights[used] = dense.T @ (white @ solved)
    return Model(names, weights, middle - centre @ solved)


def learn(docs: DataFrame, most: int = SAMPLE) -> Model | None:
    """From at most about ``most`` rows with a lang; features are made where the rows are."""
    rows, counts = sample_by_class(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"), "lang", "doc_id", most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in batches:
            found = [presence(t.as_py()).tobytes() for t in batch.column("text")]
            yield extended(batch, ["doc_id", "lang"], found=pa.array(found, pa.binary()))

    got = by_chance(rows.mapInArrow(features, schema_of(rows, ["doc_id", "lang"], "found binary")).collect(), "doc_id")
    return fit([np.frombuffer(r["found"], np.int32) for r in got], [r["lang"] for r in got], counts)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id unless given) with lang_pred and score."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence, model = Presence(), sent.value and Model(**sent.value)
        for batch in in_slices(batches, 1 << 20):
            predicted, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for at in range(0, len(batch), 512):
                found = [presence(t.as_py()) for t in batch.column("_text")[at : at + 512]]
                some = [i for i, f in enumerate(found) if len(f)] if model else []
                if some:
                    value = model.scores([found[i] for i in some])
                    for i, best, v in zip(some, value.argmax(axis=1), value.max(axis=1)):
                        predicted[at + i], score[at + i] = model.languages[best], min(1.0, max(0.0, (v + 1) / 2))
            yield extended(batch, keep, lang_pred=pa.array(predicted, pa.string()), score=pa.array(score))

    schema = schema_of(docs, keep, "lang_pred string, score double")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(scored, schema)


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the trigrams in a text, words' edges among them, each as often as it occurs."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = np.concatenate([[0], kept("language", "letter symbols", _symbol_table)[points], [0]]).astype(np.int32)
    symbol = symbol[np.r_[True, (symbol[1:] > 0) | (symbol[:-1] > 0)]]
    return (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]


@dataclass
class Familiar:
    """Deviations of a text's mean log probability from the held-back texts' middle, by its length."""

    log_p: np.ndarray  # by trigram, of the learned languages together
    middle: float
    spread: float  # of long texts
    noise: float  # of a single trigram

    def deviations(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (mean - self.middle) / np.sqrt(self.spread**2 + self.noise**2 / np.maximum(n, 1))


def fit_familiar(taught: list[tuple[np.ndarray, np.ndarray, str]], back: list[tuple[np.ndarray, np.ndarray, str]]) -> Familiar | None:
    """From (codes, counts, language) of texts; spreads are by quartiles, so that odd texts among them don't widen the bounds."""
    back = [b for b in back or taught if len(b[0])]
    by_language: dict[str, np.ndarray] = {}
    for codes, counts, lang in taught:
        np.add.at(by_language.setdefault(lang, np.zeros(SYMBOLS**3)), codes, counts)
    sums = [c for c in by_language.values() if c.sum()]
    if not sums or not back:
        return None
    # a trigram that was never seen counts half
    log_p = np.log(np.mean([(c + 0.5) / (c.sum() + 0.5 * (c > 0).sum() + 0.5) for c in sums], axis=0)).astype(np.float32)
    n = np.array([c.sum() for _, c, _ in back], float)
    mean = np.array([log_p[k] @ c / c.sum() for k, c, _ in back])
    every = np.concatenate([(log_p[k] - m) ** 2 * c for (k, c, _), m in zip(back, mean)]).sum() / n.sum()
    noise = 2 * np.sqrt(every)  # neighbours share two symbols
    off = lambda x, middle: 1.4826 * float(np.median(np.abs(x - middle)))
    long = mean[n >= np.median(n)]
    middle = float(np.median(long))
    return Familiar(log_p, middle, max(off(long, middle), 0.05), float(noise))


def learn_familiar(docs: DataFrame, most: int = SAMPLE) -> Familiar | None:
    """From the rows that ``learn`` learns from; every fourth is held back."""
    rows, _ = sample_by_class(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"), "lang", "doc_id", most)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(trigrams(t.as_py()), return_counts=True) for t in batch.column("text")]
            codes, counts = [f[0].astype(np.int32).tobytes() for f in found], [f[1].astype(np.int32).tobytes() for f in found]
            yield extended(batch, ["doc_id", "lang"], codes=pa.array(codes, pa.binary()), counts=pa.array(counts, pa.binary()))

    got = by_chance(rows.mapInArrow(counted, schema_of(rows, ["doc_id", "lang"], "codes binary, counts binary")).collect(), "doc_id")
    texts = [(np.frombuffer(r["codes"], np.int32), np.frombuffer(r["counts"], np.int32), r["lang"]) for r in got]
    return fit_familiar([t for i, t in enumerate(texts) if i % 4 != 3], texts[3::4])


def familiarity(docs: DataFrame, model: Familiar | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``familiarity``: the deviations by which a text's trigrams are likelier than held-back
    texts' are; null for texts without a letter and if there was nothing to learn from."""
    sent = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value and Familiar(**sent.value)
        for batch in in_slices(batches, 1 << 20):
            codes = [trigrams(t.as_py()) if model else () for t in batch.column("_text")]
            mean = [float(model.log_p[c].mean()) if len(c) else 0.0 for c in codes]
            n = np.array([len(np.unique(c)) for c in codes])  # repeats tell nothing more
            found = model.deviations(np.array(mean), n) if model else np.zeros(len(n))
            yield extended(batch, keep, familiarity=pa.array(found, pa.float64(), mask=n == 0))

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(scored, schema_of(docs, keep, "familiarity double"))


def identified(docs: DataFrame, taught: Column) -> DataFrame:
    """doc_id, lang_pred and score of every document, learned from those ``taught``."""
    return predict(docs, learn(docs.where(taught)))
