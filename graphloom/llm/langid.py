"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphloom.llm._common import boxed, small_batches, strings, unboxed
from graphloom.llm._embed import Features, Model, train

#: At most so many labelled rows are fitted, whole texts, evenly over the languages; at most so many languages, the most frequent ones.
FIT_ROWS, MOST_LANGUAGES = 2000, 1000
FEATURES = Features(chars=(2, 3, 4), lower=True, bits=15)
UNKNOWN = "und"


def drawn(known: DataFrame, label: str, rates: dict, rows: int, seed: str) -> list[Row]:
    """At most `rows` rows (doc_id, text, label) of known, at a rate per label: the same rows whatever the partitions.

    Rows have their place in the draw by a hash of doc_id and text, so rows that are alike in both stand together.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(rates.items()) for x in pair)), F.col(label))
    # Twice the rate holds the first `rows` of the draw almost surely; the limit is what bounds them.
    return known.select("doc_id", "text", label, (draw / rate).alias("place")).where("place < 2").orderBy("place", "doc_id", "text", label).limit(rows).collect()


def fit(docs: DataFrame, rows: int = FIT_ROWS, features: Features = FEATURES) -> Model:
    """A model from the rows of docs (doc_id, text, lang) whose lang and text are not null; without any, one that knows only `und`."""
    known = docs.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return train([], [], features)
    sample = drawn(known.where(F.col("lang").isin(*counts)), "lang", {lang: min(1.0, rows / len(counts) / n) for lang, n in counts.items()}, rows, "langid")
    sample = [sample[i] for i in np.random.default_rng(1).permutation(len(sample))]
    return train([x.text for x in sample], [x.lang for x in sample], features, documents=[x.doc_id for x in sample])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected (the score is under the calibrated threshold).

    A null text and one without letters are `und` with score 0, and rejected. Rows are kept one to one; columns of docs with these
    names are replaced, all others pass.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        m = sent.value
        data, offsets = strings(texts)
        p = m.probabilities(data, offsets)
        best, score = p.argmax(axis=1), np.round(p.max(axis=1), 6)
        ascii_letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
        letters = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for i in np.flatnonzero(~letters):
            letters[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
        lang = [m.classes[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
        score = np.where(letters, score, 0.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(score < m.reject_below)], ["lang_pred", "score", "rejected"])

    return unboxed(boxed(small_batches(docs), predict(F.col(text)).alias("p")), **{c: F.col("p")[c] for c in ("lang_pred", "score", "rejected")})


def predictions(docs: DataFrame) -> DataFrame:
    """The columns of the query: documents with crc32(doc_id) mod 4 = 2 are held out of the fit."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held, F.lit(False)).alias("held_out"))
    model = fit(rows.where("not held_out"))
    return identify(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
