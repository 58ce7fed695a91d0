"""Toxicity by non-negative positive-unlabelled learning.

Only texts confirmed as toxic are labelled examples; everything else is unlabelled text, which holds toxic texts too. With the share
of toxic texts (the class prior, pi), the risk of a classifier over toxic (p) and unlabelled (u) texts is

    pi * E_p[loss(z)] + max(0, E_u[loss(-z)] - pi * E_p[loss(-z)])

where the second part, the risk of the clean texts, is kept from turning negative: a step that finds it below zero goes back on it.
The classifier is linear in which words and beginnings of words a text has (hashed, each counted once), and in the order of
magnitude of its length. Texts are turned into buckets where they lie; the driver gets the buckets of a bounded sample alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import BASE, boxed, mix, powers, prefix_hash, slices, small_batches, strings, unboxed

_U = np.uint64
#: Texts that are fitted: confirmed toxic ones at most, unlabelled ones at most.
POSITIVE, UNLABELLED = 2000, 6000
#: Buckets that are weighed: those that toxic texts have more often than unlabelled ones, by so many standard deviations, and that
#: more than COMMON of the toxic texts, and RARE at least, have; so many at most.
APART, COMMON, RARE, KEPT = 4, 0.02, 3, 30_000
BITS, PREFIXES = 20, (4, 5, 6, 7, 8, 9, 10)
#: One further bucket for each power of two of a text's number of words.
LENGTHS = 48
SIZE = (1 << BITS) + LENGTHS
#: The share of toxic texts where labels don't tell it, since they confirm toxic texts only.
PRIOR = 0.1
THRESHOLD = 0.3
SLICE = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of lower-case texts, repeats included: each word, its beginnings of 4 to 10 bytes, and the length bucket."""
    mask = _LETTER[data]
    change = np.zeros(len(data) + 1, bool)
    change[1 : len(data)] = mask[1:] != mask[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    inside = mask[at[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = at[:-1][inside], at[1:][inside]
    row = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(row, minlength=len(offsets) - 1)
    length = (1 << BITS) + np.log2(words + 1).astype(np.int64)
    c, inverse = prefix_hash(data), powers(len(data) + 1)[1]
    found, rows = [length], [np.arange(len(offsets) - 1)]
    for kind, k in enumerate((0, *PREFIXES)):
        some = ends - starts >= k
        s = starts[some]
        h = (c[s + k if k else ends] - c[s]) * inverse[s]
        found.append((mix(h + _U((kind * BASE) % (1 << 64))) >> _U(64 - BITS)).astype(np.int64))
        rows.append(row[some])
    return np.concatenate(found), np.concatenate(rows)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return strings(pc.utf8_lower(texts.cast(pa.large_string())))


def bag(texts: pa.Array) -> pa.Array:
    """The buckets of each text, once each."""
    data, offsets = lowered(texts)
    flat, sizes = [np.zeros(0, np.int32)], []
    for i, j in slices(offsets, SLICE):
        own = offsets[i : j + 1] - offsets[i]
        b, r = buckets(data[offsets[i] : offsets[j]], own)
        key = np.unique(r * SIZE + b)
        flat.append((key % SIZE).astype(np.int32))
        sizes.append(np.bincount(key // SIZE, minlength=j - i))
    at = np.concatenate([[0], np.cumsum(np.concatenate([[0], *sizes])[1:])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))


@dataclass
class Model:
    """A weight for each bucket and a bias."""

    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of lower-case texts: the sum of the weights of the buckets that each has."""
        out = np.full(len(offsets) - 1, self.bias)
        for i, j in slices(offsets, SLICE):
            own = offsets[i : j + 1] - offsets[i]
            b, r = buckets(data[offsets[i] : offsets[j]], own)
            some = self.weights[b] != 0
            key = np.unique(r[some] * SIZE + b[some])
            out[i:j] += np.bincount(key // SIZE, self.weights[key % SIZE], minlength=j - i)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(pi * risk of toxic texts, estimated risk of clean ones, which may be negative) of logits under the logistic loss."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(positive), loss(-unlabelled) - prior * loss(-positive)


class _Rows:
    """Bags laid end to end."""

    def __init__(self, bags: list[np.ndarray]) -> None:
        self.flat = np.concatenate([np.zeros(0, np.int64), *bags])
        self.at = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, which of the picked rows has each)."""
        size = self.at[rows + 1] - self.at[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        begin = np.repeat(self.at[rows] - (np.cumsum(size) - size), size)
        return self.flat[begin + np.arange(len(owner))], owner


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, *, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-2, floor: float = 0.0, least: int = 700, seed: int = 5) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the non-negative risk over bags of features below size, by stochastic gradient descent (Adam).

    A step takes toxic and unlabelled bags in the proportion of the sample. Where its estimate of the clean texts' risk is under
    -floor, the step goes up that part's gradient instead. A small sample is gone through more often, for `least` steps. Without toxic bags everything is clean, without others everything toxic.
    """
    if not positive or not unlabelled:
        return np.zeros(size), -20.0 if not positive else 20.0
    rng = np.random.default_rng(seed)
    p, u = _Rows(positive), _Rows(unlabelled)
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, -(-len(u) // batch))
    per = max(1, len(p) // steps)
    epochs = max(epochs, -(-least // steps))

    def gradient(x: _Rows, rows: np.ndarray) -> tuple[np.ndarray, callable]:
        flat, owner = x.pick(rows)
        z = np.bincount(owner, w[flat], minlength=len(rows)) + w[size]
        return z, lambda g: np.concatenate([np.bincount(flat, g[owner], minlength=size), [g.sum()]])

    for _ in range(epochs):
        order, toxic = rng.permutation(len(u)), rng.permutation(len(p))
        for k in range(steps):
            zp, back_p = gradient(p, toxic[np.arange(k * per, (k + 1) * per) % len(toxic)])
            zu, back_u = gradient(u, order[k * batch : (k + 1) * batch])
            clean = risk(zp, zu, prior)[1]
            # d loss(z) / dz = sigmoid(z) - 1, d loss(-z) / dz = sigmoid(z).
            of_clean = back_u(sigmoid(zu) / len(zu)) - back_p(prior * sigmoid(zp) / len(zp))
            g = back_p(prior * (sigmoid(zp) - 1) / len(zp)) + of_clean if clean >= -floor else -of_clean
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            # The bias is not pulled towards zero.
            w[:size] *= 1 - rate * decay
            w -= move * (1 - step / (epochs * steps + 1))
    return w[:size], float(w[size])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _place(seed: str, *of: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / float(1 << 30)


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of least place, and those that tie with the last: found by their places alone, so no task gets their texts."""
    last = rows.select("place").orderBy("place").limit(n).agg(F.max("place")).first()[0]
    return rows.where(F.col("place") <= F.lit(last if last is not None else 0.0))


def sample(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> tuple[DataFrame, float]:
    """((toxic, bag) of the texts that are fitted, the class prior).

    Toxic ids and unlabelled texts are drawn by hashes, at rates that give the numbers asked for, where so many are. The prior is
    the share of ids that labels call toxic; where they call none clean, PRIOR. An id with both labels is clean.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    texts = docs.select("doc_id", "text").where("text is not null")
    ids = known.where("toxic = 1").select("doc_id", _place("toxic", "doc_id").alias("place"))
    # Twice the rate holds the rows asked for almost surely; the limit bounds what is broadcast.
    ids = ids.where(F.col("place") * toxic < 2 * positive).orderBy("place", "doc_id").limit(2 * positive)
    found = _first(texts.join(F.broadcast(ids), "doc_id"), positive)
    total = texts.count()
    others = _first(texts.withColumn("place", _place("unlabelled", "doc_id", "text")).where(F.col("place") * total < 2 * unlabelled), unlabelled)
    both = found.select(F.lit(1).alias("toxic"), "text").unionByName(others.select(F.lit(0).alias("toxic"), "text"))
    rows = small_batches(both).select("toxic", F.arrow_udf(bag, "array<int>")("text").alias("bag"))
    return rows, toxic / n if 0 < toxic < n else PRIOR


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1); other labels and null ids don't count.

    Only ids labelled 1 are examples; all other texts of docs, labelled 0 or not at all, are unlabelled ones.
    """
    rows, share = sample(docs, labels, positive, unlabelled)
    rows = rows.persist()
    counts = rows.select("toxic", F.explode("bag").alias("b")).groupBy("b").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    tp, tn = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not tp or tp == tn:
        rows.unpersist()
        return Model(np.zeros(SIZE, np.float32), -20.0 if not tp else 20.0)
    mean = F.col("n") / tn
    apart = (F.col("p") / tp - (F.col("n") - F.col("p")) / (tn - tp)) / F.sqrt(mean * (1 - mean) * (1 / tp + 1 / (tn - tp)) + 1e-9)
    often = counts.where(F.col("p") >= RARE + COMMON * tp).select("b", apart.alias("apart"))
    best = often.where(F.col("apart") > APART).orderBy(F.desc("apart"), "b").limit(KEPT)
    kept = np.array(sorted({r.b for r in best.collect()} | set(range(1 << BITS, SIZE))), np.int64)
    wanted = docs.sparkSession.sparkContext.broadcast(kept)

    @F.arrow_udf("array<int>")
    def numbered(bags: pa.Array) -> pa.Array:
        bags = bags.combine_chunks() if isinstance(bags, pa.ChunkedArray) else bags
        flat, at = np.asarray(bags.flatten()), np.asarray(bags.offsets)
        place = np.minimum(np.searchsorted(wanted.value, flat), len(wanted.value) - 1)
        some = wanted.value[place] == flat
        sums = np.concatenate([[0], np.cumsum(some)])
        return pa.ListArray.from_arrays(pa.array(sums[at - at[0]], pa.int32()), pa.array(place[some], pa.int32()))

    # Sorted, so that the order in which tasks answer doesn't matter.
    found = sorted((r.toxic, tuple(r.bag)) for r in rows.select("toxic", numbered("bag").alias("bag")).collect())
    rows.unpersist()
    wanted.unpersist()
    side = lambda t: [np.array(x, np.int64) for y, x in found if y == t]
    w, bias = train(side(1), side(0), len(kept), prior or share)
    weights = np.zeros(SIZE, np.float32)
    weights[kept] = w
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with score (how likely the text is toxic, 0 to 1) and predicted (1 from threshold on).

    Null and empty texts and those without letters have the score of a text without words. Rows are kept one to one, repeated ones
    get equal scores; columns of docs with these names are replaced, all others pass.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def predict(texts: pa.Array) -> pa.Array:
        return pa.array(np.round(sigmoid(sent.value.logits(*lowered(texts))), 6))

    return unboxed(boxed(small_batches(docs), predict(F.col(text)).alias("p")), score=F.col("p"), predicted=(F.col("p") >= threshold).cast("int"))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query: documents with crc32(doc_id) mod 4 = 2 are held out of the fit, as text and as labels."""
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def brute_force(text: str | None, weights: np.ndarray, bias: float) -> float:
    """The score of one text, feature by feature."""
    words, now = [], b""
    for x in (text or "").lower().encode() + b" ":
        if chr(x).isascii() and not chr(x).isalpha():
            words += [now] if now else []
            now = b""
        else:
            now += bytes([x])
    found = {(1 << BITS) + int(np.log2(len(words) + 1))}
    for word in words:
        for kind, k in enumerate((0, *PREFIXES)):
            if len(word) >= k:
                h = sum((x + 1) * int(powers(i + 1)[0][i]) for i, x in enumerate(word[:k] if k else word))
                h = mix(np.array([(h + kind * BASE) % (1 << 64)], _U))[0]
                found.add(int(h >> _U(64 - BITS)))
    return float(1 / (1 + np.exp(-(bias + sum(float(weights[b]) for b in found)))))
