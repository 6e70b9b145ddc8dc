"""Language-model scores of a hidden Markov model over word symbols.

The SYMBOLS - BUCKETS - 1 most frequent training words and the end of a text are symbols of their own;
every other word has the symbol of its bucket, by a hash of its last letters, and within the bucket the
probability (c + 1) / (n + v + 1) of its count among the n tokens and v words there, so that all words,
seen or not, have one. Baum-Welch: each round, tasks add up expected counts over all training
documents, Spark sums them, and only these sums, of fixed size, reach the driver. The scaled forward
recursion over a whole text then gives its exact likelihood.

Word counts cover the whole corpus and are never broadcast: documents are kept in blocks with a
dictionary of their own, and each block's words are looked up in the counts by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, words_of, written

STATES = 8
SYMBOLS = 8192
BUCKETS = 2048
SUFFIX = 3
ROUNDS = 3
#: Training takes so many tokens of a text side by side; see expected_counts.
STRETCH = 64
ANCHORS = 64
BLOCK_BYTES = 24 << 20
SLICE = 512
DOCS = "block long, id long, train boolean, n int, low binary, mid binary, high binary"
END = 0


def bucket_of(word: bytes) -> int:
    """The bucket of a word: by its last letters, without the marks that may follow them."""
    text = word.decode("utf-8", "replace").rstrip(".,;:!?\"')|")
    return xxhash.xxh32_intdigest((text or word.decode("utf-8", "replace"))[-SUFFIX:]) % BUCKETS


def _planes(ids: np.ndarray) -> list[bytes]:
    """Three byte planes of numbers below 2^24: the upper ones are nearly empty and compress away."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [raw[:, k].tobytes() for k in range(3)]


def _from_planes(low: bytes, mid: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint8) + (np.frombuffer(mid, np.uint8).astype(np.int64) << 8) + (np.frombuffer(high, np.uint8).astype(np.int64) << 16)


def blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> tuple[DataFrame, DataFrame]:
    """(documents as numbers in their block's dictionary, dictionary rows with counts among training documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        counts = np.zeros(1 << 16, np.int64)
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            block = (part << 20) + serial
            words = list(number)
            for at in range(0, len(words), 100_000):
                some = words[at : at + 100_000]
                n = len(some)
                yield batch_of([[block] * n, [None] * n, [None] * n, [None] * n, [None] * n, [None] * n, [None] * n, some, range(at, at + n), counts[at : at + n].tolist(), [bucket_of(w) for w in some]])

        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                rows = []
                for doc, own, text in zip(batch.column(0)[s : s + 256].to_pylist(), batch.column(1)[s : s + 256].to_pylist(), batch.column(2)[s : s + 256], strict=True):
                    text = text.as_py()
                    words = words_of(text)
                    size += sum(map(len, words)) + len(words)
                    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
                    if len(number) > len(counts):
                        counts = np.concatenate((counts, np.zeros(max(len(counts), len(number) - len(counts)), np.int64)))
                    if own and len(ids):
                        if len(ids) * 20 < len(number):
                            np.add.at(counts, ids, 1)
                        else:
                            counts[: len(number)] += np.bincount(ids, minlength=len(number))
                    rows.append(((part << 20) + serial, doc, own, len(ids), *_planes(ids), None, None, None, None))
                    if size > BLOCK_BYTES or len(number) > 1 << 22:
                        yield batch_of(list(zip(*rows, strict=True)))
                        yield from close()
                        rows, serial = [], serial + 1
                        number, counts, size = {}, np.zeros(1 << 16, np.int64), 0
                if rows:
                    yield batch_of(list(zip(*rows, strict=True)))
        if number:
            yield from close()

    def batch_of(columns: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32()]
        names = ["block", "id", "train", "n", "low", "mid", "high", "word", "local", "count", "bucket"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    all_rows = written(source.mapInArrow(run, f"{DOCS}, word binary, local int, count long, bucket int"), "hmm-blocks")
    return all_rows.where("word is null").select("block", "id", "train", "n", "low", "mid", "high"), all_rows.where("word is not null").select("block", "word", "local", "count", "bucket")


def encode(docs: DataFrame, id_col: str, text_col: str, train: Column) -> tuple[DataFrame, dict]:
    """Documents as symbols, with what doesn't depend on states: (id, train, n_tokens, n_known, base, fixed, symbols)."""
    numbered, words = blocks(docs, id_col, text_col, train)
    vocabulary = written(words.groupBy("word").agg(F.sum("count").alias("c"), F.max("bucket").alias("bucket")), "hmm-words")
    known = vocabulary.where("c > 0")
    n_docs = numbered.where("train").count()
    got = known.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, types = int(got[0] or 0) + n_docs, int(got[1]) + (n_docs > 0)
    frequent = known.orderBy(F.col("c").desc(), "word").limit(SYMBOLS - BUCKETS - 1)
    top = {r["word"]: n + 1 for n, r in enumerate(frequent.select("word").collect())}  # at most SYMBOLS rows
    spark = docs.sparkSession
    ranks = spark.createDataFrame([(bytes(w), n) for w, n in top.items()], "word binary, symbol int")
    symbols = vocabulary.join(F.broadcast(ranks), "word", "left").withColumn("symbol", F.coalesce("symbol", F.lit(SYMBOLS - BUCKETS) + F.col("bucket")))
    rest = symbols.where(F.col("symbol") >= SYMBOLS - BUCKETS).where("c > 0").groupBy("symbol").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # at most BUCKETS rows
    inside = np.zeros(SYMBOLS)
    for r in rest:
        inside[r["symbol"]] = r["n"] + r["v"]
    log_base = np.log10(total + types + 1)
    looked_up = words.drop("bucket", "count").join(symbols.select("word", "c", "symbol"), "word").select(F.col("block").alias("in_block"), "local", "c", "symbol")

    def join_block(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("local").to_numpy())
        c, symbol = right.column("c").to_numpy()[order], right.column("symbol").to_numpy()[order]
        one = np.log10(c + 1.0)
        fixed = np.where(symbol >= SYMBOLS - BUCKETS, one - np.log10(inside[symbol] + 1), 0.0) if len(c) else np.zeros(0)
        end = np.log10(n_docs + 1.0)
        rows = []
        for doc, own, low, mid, high in zip(*(left.column(k) for k in ("id", "train", "low", "mid", "high")), strict=True):
            ids = _from_planes(low.as_py(), mid.as_py(), high.as_py())
            n = len(ids) + 1
            syms = np.append(symbol[ids], END).astype("<u2")
            rows.append((doc.as_py(), own.as_py(), n, int((c[ids] > 0).sum()) + (n_docs > 0), float(one[ids].sum() + end - n * log_base), float(fixed[ids].sum()), syms.tobytes()))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        names = ["id", "train", "n_tokens", "n_known", "base", "fixed", "symbols"]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    # Blocks are of bounded size, so a task's share stays as it is when there are more of them.
    parts = max(shuffle_parts(spark), numbered.agg(F.count_distinct("block")).first()[0])
    left, right = numbered.repartition(parts, "block"), looked_up.repartition(parts, "in_block")
    encoded = left.groupBy("block").cogroup(right.groupBy("in_block")).applyInArrow(join_block, "id long, train boolean, n_tokens long, n_known long, base double, fixed double, symbols binary")
    return written(encoded, "hmm-encoded"), {"tokens": total, "types": types, "docs": n_docs}


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors that tasks give as slices (slice int, data binary); ``size`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(data.as_py())
                held[k] = held[k] + v if k in held else v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["slice", "data"])

    out = np.zeros(-(-size // SLICE) * SLICE)
    for r in parts.repartition(shuffle_parts(parts.sparkSession), "slice").mapInArrow(add, "slice int, data binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += np.frombuffer(r["data"])
    return out[:size]


def slices(vector: np.ndarray) -> pa.RecordBatch:
    n = -(-len(vector) // SLICE)
    padded = np.zeros(n * SLICE)
    padded[: len(vector)] = vector
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([padded[k * SLICE : (k + 1) * SLICE].tobytes() for k in range(n)], pa.binary())], names=["slice", "data"])


def neighbour_counts(texts: list[np.ndarray]) -> np.ndarray:
    """Per symbol: its count, and how often each of the ANCHORS commonest symbols follows and precedes it."""
    out = np.zeros((SYMBOLS, 1 + 2 * ANCHORS))
    if texts:
        flat = np.concatenate(texts)
        out[:, 0] = np.bincount(flat, minlength=SYMBOLS)
        a, b = flat[:-1], flat[1:]
        inner = a != END
        for x, y, at in ((a, b, 0), (b, a, 1)):
            near = inner & (y > 0) & (y <= ANCHORS)
            out[:, 1 + at * ANCHORS : 1 + (at + 1) * ANCHORS] = np.bincount(x[near] * ANCHORS + y[near] - 1, minlength=SYMBOLS * ANCHORS).reshape(SYMBOLS, ANCHORS)
    return out.reshape(-1)


def start_model(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transitions, emissions) from clusters of symbols with like neighbours."""
    near = near.reshape(SYMBOLS, 1 + 2 * ANCHORS)
    count, x = near[:, 0], np.sqrt(near[:, 1:] / np.maximum(near[:, 1:].sum(axis=1), 1)[:, None])
    weight = near[:, 1:].sum(axis=1)
    rng = np.random.default_rng(5)
    often = np.argsort(-weight)[:2000]
    centres = x[often[:1]]
    while len(centres) < STATES:  # the next centre is the common symbol farthest from all so far
        d = ((x[often, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack((centres, x[often[(d * np.sqrt(weight[often])).argmax()]]))
    for _ in range(30):
        to = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(STATES):
            w = weight * (to == k)
            if w.sum() > 0:
                centres[k] = (x * w[:, None]).sum(axis=0) / w.sum()
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    share = np.exp(-6 * (d - d.min(axis=1, keepdims=True)))
    share[weight < 5] = 1
    share = share / share.sum(axis=1, keepdims=True) * (1 + 0.02 * rng.random(share.shape))
    emit = share.T * (count + 0.1)
    move = np.full((STATES, STATES), 0.4 / STATES) + 0.6 * np.eye(STATES)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True)


def _stretches(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(stretches of STRETCH tokens, the longest first; rank of a text's first stretch by text; the stretch after each, or -1)."""
    cut = [t[i : i + STRETCH] for t in texts for i in range(0, len(t), STRETCH)]
    counts = np.array([-(-len(t) // STRETCH) for t in texts], np.int64)
    order = np.argsort([-len(c) for c in cut], kind="stable")
    rank = np.empty(len(cut), np.int64)
    rank[order] = np.arange(len(cut))
    first = np.cumsum(counts) - counts
    after = np.append(rank[1:], -1)
    after[first + counts - 1] = -1
    by_rank = np.empty(len(cut), np.int64)
    by_rank[rank] = after
    return [cut[i] for i in order], rank[first], by_rank


def expected_counts(texts: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Expected start, transition and emission counts of whole texts.

    Long texts are taken in stretches side by side, and nothing is lost at their limits: the product of a
    stretch's step matrices carries the forward and the backward vector over it, so every stretch starts
    from the exact vectors of the whole text, and the step between two stretches is counted like any other.
    """
    k = STATES
    by_symbol = np.zeros((SYMBOLS, k))
    starts, moves = np.zeros(k), np.zeros((k, k))
    texts = [t for t in texts if len(t)]
    if not texts:
        return np.concatenate((starts, moves.reshape(-1), by_symbol.reshape(-1)))
    pieces, firsts, after = _stretches(texts)
    b_of, move32 = np.ascontiguousarray(emit.T, np.float32), move.astype(np.float32)
    n = np.array([len(p) for p in pieces])
    before = np.full(len(pieces), -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)

    def padded(at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbols: step x stretch, how many stretches go on at each step)."""
        sym = np.zeros((int(n[at]), end - at), np.int64)
        for j, p in enumerate(pieces[at:end]):
            sym[: len(p), j] = p
        return sym, (np.arange(int(n[at]))[:, None] < n[None, at:end]).sum(axis=1)

    # Products over all stretches that another one follows or precedes.
    product = np.zeros((len(pieces), k, k), np.float32)
    for at in range(0, len(pieces), 2048):
        end = min(at + 2048, len(pieces))
        if not ((after[at:end] >= 0) | (before[at:end] >= 0)).any():
            continue
        sym, live = padded(at, end)
        held = np.broadcast_to(np.eye(k, dtype=np.float32), (end - at, k, k)).copy()
        for t, m in enumerate(live):
            b = b_of[sym[t, :m]]
            if t == 0:  # a text's first token has no step before it
                opening = before[at : at + m] < 0
                stepped = move32[None] * b[:, None, :]
                stepped[opening] = np.eye(k, dtype=np.float32)[None] * b[opening][:, None, :]
            else:
                stepped = (held[:m].reshape(-1, k) @ move32).reshape(-1, k, k) * b[:, None, :]
            held[:m] = stepped / np.maximum(stepped.max(axis=(1, 2)), 1e-30)[:, None, None]
        product[at:end] = held
    # The forward vector before each stretch, and the backward vector at its end.
    into, back = np.zeros((len(pieces), k), np.float32), np.ones((len(pieces), k), np.float32)
    here = firsts
    into[here] = start
    last = firsts[after[firsts] < 0]
    while len(here := here[after[here] >= 0]):
        v = (into[here][:, None, :] @ product[here])[:, 0]
        here = after[here]
        into[here] = v / np.maximum(v.sum(axis=1), 1e-30)[:, None]
        last = np.concatenate((last, here[after[here] < 0]))
    here = last
    while len(here := here[before[here] >= 0]):
        v = (product[here] @ back[here][:, :, None])[:, :, 0]
        here = before[here]
        back[here] = v / np.maximum(v.sum(axis=1), 1e-30)[:, None]
    for at in range(0, len(pieces), 2048):
        end = min(at + 2048, len(pieces))
        sym, live = padded(at, end)
        length, first, own = len(sym), before[at:end] < 0, into[at:end]
        b = b_of[sym]
        alpha = np.zeros((length, end - at, k), np.float32)
        scale = np.ones((length, end - at), np.float32)
        for t in range(length):
            m = live[t]
            a = np.where(first[:, None], own, own @ move32) * b[0] if t == 0 else (alpha[t - 1, :m] @ move32) * b[t, :m]
            s = np.maximum(a.sum(axis=1), 1e-30)
            scale[t, :m] = s
            alpha[t, :m] = a / s[:, None]
        beta = back[at:end].copy()
        ends = alpha[n[at:end] - 1, np.arange(end - at)]
        beta /= np.maximum((ends * beta).sum(axis=1), 1e-30)[:, None]
        for t in range(length - 1, -1, -1):
            m = live[t]
            if t + 1 < length:
                more = live[t + 1]
                right = b[t + 1, :more] * beta[:more] / scale[t + 1, :more, None]
                moves += (alpha[t, :more].T @ right).astype(np.float64)
                beta[:more] = right @ move32.T
            alpha[t, :m] *= beta[:m]
        right = (b[0] * beta / scale[0][:, None])[~first]
        moves += (own[~first].T @ right).astype(np.float64)
        starts += alpha[0][first].sum(axis=0)
        mask = np.arange(length)[:, None] < n[None, at:end]
        flat, gamma = sym[mask], alpha[mask]
        for j in range(k):
            by_symbol[:, j] += np.bincount(flat, gamma[:, j], SYMBOLS)
    return np.concatenate((starts, (moves * move).reshape(-1), by_symbol.reshape(-1)))


def next_model(counts: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model that expected counts give; each state's emissions are smoothed towards all symbols' shares."""
    k = STATES
    starts, moves, by_symbol = counts[:k], counts[k : k + k * k].reshape(k, k), counts[k + k * k :].reshape(SYMBOLS, k)
    share = (seen + 0.5) / (seen + 0.5).sum()
    emit = by_symbol.T + 50 * share[None]
    return (starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)


def log_likelihoods(texts: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 probability of each whole text, by the scaled forward recursion."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out = np.zeros(len(texts))
    b_of = np.ascontiguousarray(emit.T)
    for at in range(0, len(order), 1024):
        own = order[at : at + 1024]
        n = np.array([len(texts[i]) for i in own])
        flat = np.concatenate([texts[i] for i in own]).astype(np.int64)
        begin = np.cumsum(n) - n
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right") if len(n) else []
        total = np.zeros(len(own))
        a = None
        for t in range(int(n[0])):
            m = int(live[t])
            b = b_of[flat[begin[:m] + t]]
            a = start * b if a is None else (a[:m] @ move) * b
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:m] += np.log10(s)
        out[own] = total
    return out


def _texts(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in batch.column(column)]


def _portions(texts: list[np.ndarray], tokens: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """The texts in portions of about so many tokens, a longer text by itself."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > tokens:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def train_model(encoded: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch over the symbols of all training documents."""
    own = encoded.where("train").select("symbols")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * (1 + 2 * ANCHORS))
        for batch in batches:
            total += neighbour_counts(_texts(batch, 0))
        yield slices(total)

    counted = summed(own.mapInArrow(near, "slice int, data binary"), SYMBOLS * (1 + 2 * ANCHORS))
    seen = counted.reshape(SYMBOLS, -1)[:, 0]
    model = start_model(counted)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES**2 + SYMBOLS * STATES)
            for batch in batches:
                for texts in _portions(_texts(batch, 0)):
                    total += expected_counts(texts, *model)
            yield slices(total)

        model = next_model(summed(own.mapInArrow(expect, "slice int, data binary"), STATES + STATES**2 + SYMBOLS * STATES), seen)
    return model


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Defined results: a null or empty text is its end alone; with no training document every token is
    unknown; rows that repeat an id are documents of their own; a null ``train`` counts as false; an
    empty table gives no rows; other columns are ignored.
    """
    encoded, of = encode(docs, id_col, text_col, train)
    model = train_model(encoded, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                value = log_likelihoods(_texts(part, 6), *model) + part.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(value)], names=["id", "train", "n_tokens", "n_known", "base_score", "score"])

    out = encoded.select("id", "train", "n_tokens", "n_known", "base", "fixed", "symbols").mapInArrow(run, "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(of["tokens"]).cast("long"))
