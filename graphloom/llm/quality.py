"""Quality classification: averaged vectors of hashed word and character n-grams, softmax output."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import boxed, small_batches, strings, unboxed
from graphloom.llm._embed import Features, Model, train

#: At most so many labelled rows are fitted, whole texts, half of each label or all of a rarer one.
FIT_ROWS = 4000
FEATURES = Features(chars=(3, 4), words=(1, 2), lower=False, bits=16, prior=20)
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: Features = FEATURES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality 0 or 1); other labels and null ids don't count.

    Labelled ids are picked by a hash at a rate per label that gives about `rows` in all, evenly over the labels; what a rare label
    lacks, the others fill up. An id with both labels has label 0. The list of ids, at most 2 * rows, is what is broadcast; of its
    documents at most `rows` are fitted. The bias makes up for the rates, so that scores are those of the labels' own shares.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = sorted((r.n, r.quality) for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect())
    if not counts:
        return train([], [], features)
    rates, left = {}, float(rows)
    for k, (n, label) in enumerate(counts):
        take = min(n, left / (len(counts) - k))
        rates[label] = take / n
        left -= take
    rate = F.element_at(F.create_map(*(F.lit(x) for pair in rates.items() for x in pair)), F.col("quality"))
    place = (F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) / rate).alias("place")
    picked = known.select("doc_id", "quality", place).where("place < 1").orderBy("place", "doc_id").limit(2 * rows)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    sample = found.orderBy("place", "doc_id", "text").limit(rows).collect()
    sample = [sample[i] for i in np.random.default_rng(2).permutation(len(sample))]
    model = train([x.text for x in sample], [str(x.quality) for x in sample], features, documents=[x.doc_id for x in sample])
    named = {str(label): rate for label, rate in rates.items()}
    model.bias -= model.temperature * np.log([named.get(c, 1.0) for c in model.classes])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with score (how likely label 1 is, 0 to 1) and predicted (1 from threshold on).

    Null and empty texts have no features and get the score of the bias. Rows are kept one to one; columns of docs with these names
    are replaced, all others pass. A model without both labels gives the label that it has seen, or 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def predict(texts: pa.Array) -> pa.Array:
        m = sent.value
        if "1" not in m.classes:
            return pa.array(np.full(len(texts), 0.0 if "0" in m.classes else 1.0))
        data, offsets = strings(texts)
        return pa.array(np.round(m.probabilities(data, offsets)[:, m.classes.index("1")], 6))

    return unboxed(boxed(small_batches(docs), predict(F.col(text)).alias("p")), score=F.col("p"), predicted=(F.col("p") >= threshold).cast("int"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query: documents with crc32(doc_id) mod 5 = 0 are held out of the fit."""
    model = fit(docs, labels.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
