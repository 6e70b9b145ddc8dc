"""Toxicity by class-conditional Kneser-Ney models.

One model for each class, toxic and ordinary. Only the counts of whole contexts are a class's own; the
counts to which they back off are shared, those of both classes together. A word is modelled by its
characters, so a letter sequence that neither class knows says nothing, and a rare word is judged by the
familiar parts that it is made of. A word in an expression, a common pair that the classes use unlike, is
modelled by the word before it.

A toxic document is a text of which a small share of words is drawn from the toxic model and the rest
from the ordinary one. Its log-likelihood less that under the ordinary model alone, divided by the root
of its length in words, is what decides: the score is the logistic function of this one number, with
the threshold and slope that fit the training rows best.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
ORDER = 7
DISCOUNT = 0.75
#: Bounds of the sample that the models are fitted on: documents of each class.
FIT_TOXIC, FIT_ORDINARY = 2_000, 4_000
#: Occurrences of a word, and different words before a pair of them, from which they are common enough to model
#: expressions by, and the chi-square from which a pair's counts in the two classes differ by more than chance.
EXPRESSION, APART = 8, 30.0
#: Share of words of a toxic document that the toxic model draws.
SHARE = 0.02
FOLDS = 4
CACHE = 300_000
#: Bits of a symbol in a gram, ORDER of which make one number. 0 stands for what is before a word, 1 for its end, the
#: last 128 for the digits of code points: the commonest characters have symbols of their own, and every other one, known
#: or not, is spelt by the three digits of its code point.
BITS = 9
DIGITS = (1 << BITS) - 128
_MASKS = [np.uint64((1 << BITS * n) - 1) for n in range(ORDER + 1)]


def alphabet_of(words: list[str], counts: np.ndarray) -> np.ndarray:
    """Code points of the commonest characters, as many as there are codes for."""
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.bincount(chars, np.repeat(counts, np.fromiter(map(len, words), np.int64, len(words))))
    common = np.argsort(-seen, kind="stable")[: DIGITS - 2]
    return common[seen[common] > 0]


def _lookup(alphabet: np.ndarray) -> np.ndarray:
    codes = np.zeros(0x110000, np.uint16)
    codes[alphabet] = np.arange(2, len(alphabet) + 2)
    codes[3] = 1
    return codes


def _grams(words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, word number) of all characters of words, each with the ORDER - 1 before it; the last character in the lowest bits."""
    text = "".join([w + "\x03" for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = codes[points]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    number = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    spelt = np.flatnonzero(chars == 0)
    if len(spelt):
        wide = np.ones(len(chars), np.int64)
        wide[spelt] = 3
        first = (np.cumsum(wide) - wide)[spelt]
        chars, number = np.repeat(chars, wide), np.repeat(number, wide)
        for k in range(3):
            chars[first + k] = DIGITS + (points[spelt] >> np.uint32(7 * (2 - k)) & np.uint32(127))
        lengths = np.bincount(number, minlength=len(words))
    chars = chars.astype(np.uint64)
    ends = np.cumsum(lengths)
    place = np.arange(len(number), dtype=np.int32)
    place -= np.repeat((ends - lengths).astype(np.int32), lengths)
    grams = chars.copy()
    for k in range(1, ORDER):
        earlier = chars[:-k] << np.uint64(BITS * k)
        earlier[place[k:] < k] = 0
        grams[k:] |= earlier
    return grams, number


@dataclass
class Ratio:
    """log P(character | toxic) - log P(character | ordinary), by gram or else by context; zero for unknown contexts."""

    alphabet: np.ndarray
    grams: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    defaults: np.ndarray

    def __post_init__(self) -> None:
        self.codes = _lookup(self.alphabet)

    def of(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        if not words:
            return np.zeros(0)
        grams, number = _grams(words, self.codes)
        out = np.zeros(len(grams))
        for keys, table, values in ((grams >> np.uint64(BITS), self.contexts, self.defaults), (grams, self.grams, self.values)):
            at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            hit = table[at] == keys
            out[hit] = values[at[hit]]
        return np.bincount(number, out, len(words))


def fit_ratio(toxic: Counter, ordinary: Counter) -> Ratio:
    """Both models from word counts of the two classes."""
    words = list(toxic.keys() | ordinary.keys())
    return _fit_words(words, [np.fromiter((c.get(w, 0) for w in words), np.float32, len(words)) for c in (ordinary, toxic)])


def _fit_words(words: list[str], weights: list[np.ndarray]) -> Ratio:
    """Both models from the counts of each word in the ordinary and the toxic class."""
    alphabet = alphabet_of(words, weights[0] + weights[1])
    grams, number = _grams(words, _lookup(alphabet))
    top, inverse = np.unique(grams, return_inverse=True)
    del grams
    own = [np.bincount(inverse, w[number], len(top)) for w in weights]
    del number, inverse
    # Shared backoff: continuation counts, from the shortest contexts up.
    levels, rows = [], top
    for n in range(ORDER - 1, 0, -1):
        rows, into, counts = np.unique(rows & _MASKS[n], return_inverse=True, return_counts=True)
        levels.append((rows, into, counts.astype(np.float64)))
    base = None
    while levels:
        rows, into, counts = levels.pop()
        if base is None:
            lower, context = np.full(len(rows), 1 / max(len(rows), 256)), np.zeros(len(rows), np.int64)
        else:
            lower, context = base, np.unique(rows >> np.uint64(BITS), return_inverse=True)[1]
        total, types = np.bincount(context, counts), np.bincount(context)
        base = ((np.maximum(counts - DISCOUNT, 0) + DISCOUNT * types[context] * lower) / total[context])[into]
    # Each class: own counts of whole contexts over the shared distribution.
    contexts, context = np.unique(top >> np.uint64(BITS), return_inverse=True)
    logs, default = [], []
    for n in own:
        total, types = np.bincount(context, n, len(contexts)), np.bincount(context, n > 0, len(contexts))
        left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1e-9), 1.0)
        share = np.where(total[context] > 0, np.maximum(n - DISCOUNT, 0) / np.maximum(total[context], 1e-9), 0.0)
        logs.append(np.log(share + left[context] * base))
        default.append(np.log(left))
    return Ratio(alphabet, top, (logs[1] - logs[0]).astype(np.float32), contexts, (default[1] - default[0]).astype(np.float32))


def fit_expressions(toxic: list[list[str]], ordinary: list[list[str]]) -> dict[tuple[str, str], float]:
    """log P(word | word before, toxic) - log P(the same | ordinary) of common pairs."""
    number: dict[str, int] = {}
    ids = [[np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in part] for part in (toxic, ordinary)]
    return _fit_pairs(list(number), *ids)


def _fit_pairs(vocabulary: list[str], toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> dict[tuple[str, str], float]:
    """As ``fit_expressions``, of texts as numbers of words.

    A pair counts once for each word before it: what copies of a text repeat is no usage. A class's own
    counts of pairs back off to the shared continuation counts, the numbers of different words before a
    word in both classes. Words that aren't common are one word here.
    """
    counts = np.zeros(len(vocabulary), np.int64)
    for t in (*toxic, *ordinary):
        np.add.at(counts, t, 1)
    frequent = np.flatnonzero(counts >= EXPRESSION)
    number = np.zeros(len(vocabulary), np.int64)
    number[frequent] = np.arange(1, len(frequent) + 1)
    names, size = [vocabulary[i] for i in frequent.tolist()], len(frequent) + 1
    each = []
    for texts in (toxic, ordinary):
        codes, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for t in texts:
            pair = number[t[:-1]] * size + number[t[1:]]
            around = np.concatenate((np.full(min(len(pair), 1), len(vocabulary)), t[:-2]))
            mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + around.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            one = np.unique(mixed ^ (mixed >> np.uint64(29)), return_index=True)
            codes.append(pair[one[1]])
            keys.append(one[0])
        each.append(np.concatenate(codes)[np.unique(np.concatenate(keys), return_index=True)[1]])
    pairs, inverse = np.unique(np.concatenate(each), return_inverse=True)
    own = [np.bincount(inverse[: len(each[0])], minlength=len(pairs)), np.bincount(inverse[len(each[0]) :], minlength=len(pairs))]
    before, word = pairs // size, pairs % size
    shared = np.bincount(word, minlength=size)[word] / max(len(pairs), 1)
    logs = []
    for n in own:
        total, types = np.bincount(before, n, size)[before], np.bincount(before, n > 0, size)[before]
        logs.append(np.log(np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types * shared) / np.maximum(total, 1), shared)))
    whole = np.array([n.sum() for n in own], np.float64)
    expected = (own[0] + own[1])[None] * (whole / max(whole.sum(), 1))[:, None]
    apart = ((np.stack(own) - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) >= APART
    common = (before > 0) & (word > 0) & (own[0] + own[1] >= EXPRESSION) & apart
    return {(names[a - 1], names[b - 1]): r for a, b, r in zip(before[common].tolist(), word[common].tolist(), (logs[0] - logs[1])[common].tolist(), strict=True)}


class Ratios:
    """Log-likelihood ratios of the words of texts, with a bounded cache."""

    def __init__(self, ratio: Ratio, expressions: dict[tuple[str, str], float]) -> None:
        self.ratio, self.expressions, self.known = ratio, expressions, {}

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for t in texts for w in t} - self.known.keys())
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.known.update(zip(part, self.ratio.of(part).tolist(), strict=True))
        out = []
        for t in texts:
            r = np.fromiter(map(self.known.__getitem__, t), np.float64, len(t))
            inside = np.fromiter(map(self.expressions.get, zip(t, t[1:], strict=False), itertools.repeat(np.nan)), np.float64, max(len(t) - 1, 0))
            found = np.flatnonzero(~np.isnan(inside))
            r[found + 1] = inside[found]
            out.append(r)
        return out


def evidence(ratios: np.ndarray) -> float:
    """Log-likelihood of a toxic document less that of an ordinary one, by the root of the length; 0 for a wordless text.

    A word's ratio counts from -30 to 12: one word of which both models are surer than that decides no more.
    """
    return float(np.log1p(SHARE * np.expm1(np.clip(ratios, -30, 12))).sum() / np.sqrt(max(len(ratios), 1)))


@dataclass
class Model:
    ratio: Ratio
    expressions: dict[tuple[str, str], float]
    threshold: float
    slope: float

    def scores(self, texts: list[str | None], ratios: Ratios) -> np.ndarray:
        x = np.array([evidence(r) for r in ratios.of([words_in(t) for t in texts])], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * (x - self.threshold), -30, 30)))


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(threshold, slope) of the logistic function that fits best, the slope above 0."""
    spread = x.std() + 1e-9
    z, w = np.stack(((x - x.mean()) / spread, np.ones(len(x))), axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([0.1, 1e-3]), z.T @ (y - p) - np.array([0.1, 1e-3]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(w[0]), 1e-3)
    return float(x.mean() - spread * w[1] / slope), slope / spread


def fit(texts: list[str], labels: list[int]) -> Model:
    """Models on all texts; threshold and slope by models that didn't see the text (FOLDS folds)."""
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in words_in(t)), np.int32) for t in texts]
    vocabulary = list(number)
    del number
    y = np.array(labels, np.float64)

    def learned(rows: list[int]) -> tuple[Ratio, dict]:
        toxic, ordinary = ([ids[i] for i in rows if y[i] == label] for label in (1, 0))
        weights = [np.bincount(np.concatenate([np.empty(0, np.int32), *part]), minlength=len(vocabulary)).astype(np.float32) for part in (ordinary, toxic)]
        own = np.flatnonzero(weights[0] + weights[1])
        words = [vocabulary[i] for i in own.tolist()] or ["\x04"]
        ratio = _fit_words(words, [w[own] if len(own) else np.ones(1, np.float32) for w in weights])
        return ratio, _fit_pairs(vocabulary, toxic, ordinary)

    threshold, slope = (0.0, 1.0) if not len(y) else (-3.0, 1.0) if y.all() else (3.0, 1.0)
    if 0 < y.sum() < len(y) and len(y) >= 2 * FOLDS:
        x = np.zeros(len(y))
        for fold in range(FOLDS):
            other = Ratios(*learned([i for i in range(len(y)) if i % FOLDS != fold]))
            own = list(range(fold, len(y), FOLDS))
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                x[part] = [evidence(r) for r in other.of([[vocabulary[w] for w in ids[i].tolist()] for i in part])]
            del other
        threshold, slope = _logistic(x, y)
    return Model(*learned(list(range(len(y)))), threshold, slope)


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = FIT_TOXIC, most_ordinary: int = FIT_ORDINARY) -> Model:
    """Fit on a bounded sample of the labelled documents for which ``train`` (of ``_id``) holds.

    Of each class, ``most_toxic`` and ``most_ordinary`` documents at most are taken, whole, the first by a
    hash of the id. A task fits on their texts, and only the model reaches the driver, in arrays whose size the
    sample bounds. ``docs`` needn't be the table that will be scored.
    Defined results: labels other than 0 and 1 and null ids are left out; an id labelled both ways counts
    in both classes; rows that repeat an id count once, with the smallest of their texts; null texts are
    left out; without any label of one class all texts score alike but for their own evidence.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).where("_doc is not null and _text is not null")
    known = known.where(train).distinct().join(texts.select("_doc"), F.col("_id") == F.col("_doc"), "left_semi")
    by_hash = lambda y, most: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = by_hash(1, most_toxic).union(by_hash(0, most_ordinary))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        parts = [pickle.dumps(x, pickle.HIGHEST_PROTOCOL) for x in _values(fit([t for _, _, t in got], [y for _, y, _ in got]))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array(parts, pa.binary())], names=["part", "value"])

    parts = rows.coalesce(1).mapInArrow(fitted, "part long, value binary").collect()  # a row for each value of the model
    return _model([pickle.loads(r["value"]) for r in sorted(parts, key=lambda r: r["part"])]) if parts else fit([], [])


def _values(model: Model) -> tuple:
    """The model as plain values."""
    r = model.ratio
    return r.alphabet, r.grams, r.values, r.contexts, r.defaults, model.expressions, model.threshold, model.slope


def _model(values: Sequence) -> Model:
    return Model(Ratio(*values[:5]), *values[5:])


def _shared(docs: DataFrame, model: Model):
    """The model as a broadcast of plain values, of a size that the fitting sample bounds, and how a task takes it."""
    held = docs.sparkSession.sparkContext.broadcast(_values(model))

    def taken() -> tuple[Model, Ratios]:
        own = _model(held.value)
        return own, Ratios(own.ratio, own.expressions)

    return taken


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text: the higher, the likelier toxic.

    Defined results: null, empty and wordless texts have the score of no evidence; rows that repeat an id
    are scored each; a null id is kept; an empty table gives no rows; other columns are ignored.
    """
    taken = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ratios = taken()
        for batch in batches:
            out = [own.scores(batch.column(1)[at : at + 128].to_pylist(), ratios) for at in range(0, batch.num_rows, 128)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, score double")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents with a score below ``threshold``, all columns and repeated rows as they are; defined results as of ``score``."""
    taken = _shared(docs, model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ratios = taken()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield part.filter(pa.array(own.scores(part.column(place).to_pylist(), ratios) < threshold))

    return docs.mapInArrow(run, docs.schema)
