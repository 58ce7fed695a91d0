"""Toxicity, whitening and alignment of tokenizers against plain versions."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import alignment, langid, quality, toxicity, whitening
from graphloom.llm._common import BASE, mix, strings

# --- 1 and 2 -----------------------------------------------------------------------------------------------------------------

_M = 0xD6E8FEB86659FD93


def _mixed(x):
    return int(mix(np.array([x % (1 << 64)], np.uint64))[0])


def _forward(text, model):
    """Probabilities of the classes of an averaged model, feature by feature."""
    f, raw = model.features, (text or "").encode()
    raw = bytes(b + 32 if f.lower and 65 <= b <= 90 else b for b in raw)
    found = []
    for kind, k in enumerate(f.chars):
        found += [(int.from_bytes(raw[i : i + k], "big") * BASE % (1 << 64) >> (64 - f.bits)) + (kind << f.bits) for i in range(len(raw) - k + 1)]
    words = [w for w in bytes(32 if b in b"\t\n\v\f\r" else b for b in raw).split(b" ") if w]
    hashes = [_mixed(sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(w))) for w in words]
    for j, k in enumerate(f.words):
        for i in range(len(hashes) - k + 1):
            g = hashes[i]
            for h in hashes[i + 1 : i + k]:
                g = g * _M + h
            g = k if k > 1 and len(set(hashes[i : i + k])) == 1 else g
            found.append((_mixed(g) >> (64 - f.bits)) + ((len(f.chars) + j) << f.bits))
    z = [sum(float(model.table[b, c]) for b in found) / max(1, len(found) + f.prior) for c in range(len(model.classes))]
    z = [(x + b) / model.temperature for x, b in zip(z, model.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_language_and_quality_equal_a_forward_pass_feature_by_feature(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("Alpha", "beta", "gämma", "δέλτα", "eps,", "no no no", "x\ty")) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    texts += ["", " ", "a", "ab", "no no", "日本"]
    docs = spark.createDataFrame([(i, t, ["en", "de", "fr"][i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.length("text").cast("int").alias("n")).selectExpr("doc_id", "int(n % 2) AS quality")
    model = langid.fit(docs)
    for r in langid.identify(docs, model).collect():
        p = _forward(r.text, model)
        if any(map(str.isalpha, r.text)):
            assert abs(r.score - max(p)) < 2e-5 and p[model.classes.index(r.lang_pred)] > max(p) - 1e-5
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    model = quality.fit(docs, labels)
    for r in quality.score(docs, model).collect():
        assert abs(r.score - _forward(r.text, model)[model.classes.index("1")]) < 2e-5


# --- 11 ----------------------------------------------------------------------------------------------------------------------


def _speech(seed, n, share=0.2):
    rng = random.Random(seed)
    plain, bad = "the river runs over stones and under a bridge of wood".split(), ["Grumpface", "grumpfaces", "blorkhead"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 60))]
        toxic = rng.random() < share
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_is_learnt_from_confirmed_and_unlabelled_texts(spark):
    rows = _speech(1, 1200)
    docs = spark.createDataFrame([(i, t, "en", "own", "own") for i, t, _ in rows] + [(9000, None, "en", "x", "y"), (9001, "", None, "x", "y"), (9002, "12 !!", None, "x", "y"), (9003, "stones " * 40_000 + "grumpface", None, "x", "y"), (None, "a blorkhead", None, "x", "y"), (0, rows[0][1], "en", "x", "y")], "doc_id long, text string, lang string, score string, predicted string")
    # Half of the texts are labelled; labels of clean ones tell nothing but the prior.
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (1, None)], "doc_id long, toxic int")
    found = toxicity.predictions(docs, labels).collect()
    assert len(found) == docs.count() and found[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    by = {r.doc_id: r for r in found}
    right = [by[i].predicted == y for i, _, y in rows]
    assert sum(right) / len(right) > 0.97
    held = [by[i].predicted == y for i, _, y in rows if by[i].held_out]
    assert len(held) > 200 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert by[9000].score == by[9001].score == by[9002].score < 0.3 and by[9003].predicted == 1 and by[None].predicted == 1
    alone = toxicity.fit(docs, labels.where("toxic = 1"), prior=0.2)
    told = {r.doc_id: r.predicted for r in toxicity.score(docs.select("doc_id", "text"), alone).collect()}
    assert sum(told[i] == y for i, _, y in rows) > 0.97 * len(rows)
    model = toxicity.fit(docs, labels)
    kept = toxicity.score(docs, model)
    assert kept.columns == ["doc_id", "text", "lang", "score", "predicted"] and kept.count() == docs.count()
    texts = [t for _, t, _ in rows[:40]] + [None, "", "Ärger über GRUMPFACE", "x" * 500]
    scored = {r.text: r.score for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert all(abs(scored[t] - toxicity.brute_force(t, model.weights, model.bias)) < 1e-6 for t in texts)
    # What is learnt does not depend on how rows are dealt.
    again = toxicity.fit(docs.repartition(7), labels.repartition(2))
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_toxicity_of_empty_tables_and_without_examples(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in _speech(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.predictions(docs, labels).collect()} == {0}
    assert {r.predicted for r in toxicity.predictions(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.predictions(docs.limit(0), labels).count() == 0


def test_the_risk_of_clean_texts_is_kept_from_turning_negative():
    rng = np.random.default_rng(0)
    z, u = rng.normal(2, 1, 500), rng.normal(-1, 2, 800)
    p, clean = toxicity.risk(z, u, 0.3)
    assert math.isclose(p, 0.3 * np.log1p(np.exp(-z)).mean()) and math.isclose(clean, np.log1p(np.exp(u)).mean() - 0.3 * np.log1p(np.exp(z)).mean())
    # Features of their own for each text: the unlabelled texts' risk could be made arbitrarily negative by learning the toxic ones by heart.
    bags_p, bags_u = [np.array([0, 10 + i]) for i in range(20)], [np.array([1 + i % 5, 40 + i]) for i in range(80)] + [np.array([0, 130 + i]) for i in range(10)]
    w, bias = toxicity.train(bags_p, bags_u, 200, 0.2, epochs=200, rate=0.05)
    logits = lambda bags: np.array([w[b].sum() + bias for b in bags])
    assert toxicity.risk(logits(bags_p), logits(bags_u), 0.2)[1] > -0.05
    assert logits([np.array([0])])[0] > logits([np.array([1])])[0]


def test_buckets_are_the_same_however_texts_are_cut_into_batches():
    texts = [t for _, t, _ in _speech(3, 50)] + ["", "éa ßb", "a" * 40]
    whole = toxicity.bag(pa.array(texts)).to_pylist()
    assert whole == [toxicity.bag(pa.array([t])).to_pylist()[0] for t in texts]
    assert toxicity.bag(pa.array([None, ""])).to_pylist() == [[1 << toxicity.BITS]] * 2


# --- 12 ----------------------------------------------------------------------------------------------------------------------


def _plain_whitening(rows, components):
    """By fractions up to the eigenvectors."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(64 * c) + 1000000 for c in v) for i, v in ok}
    fitted = sorted(set(x.values()))
    n, d = len(fitted), len(fitted[0])
    s = [sum(v[k] for v in fitted) for k in range(d)]
    centred = [[Fraction(v[k]) - Fraction(s[k], n) for k in range(d)] for v in fitted]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    out = {i: (sum((n * v[k] - s[k]) ** 2 for k in range(d)), np.array([float(Fraction(v[k]) - Fraction(s[k], n)) for k in range(d)]) @ q / np.sqrt(e)) for i, v in x.items()}
    return n, out, e / np.trace(cov)


def test_whitening_equals_fractions(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    rows = [(i, [float(c) for c in (mix @ rng.normal(size=6)).astype(np.float32)]) for i in range(90)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [None] * 6), (104, [float("nan")] + [0.0] * 5), (105, [float("inf")] + [0.0] * 5), (106, [1e300] + [0.0] * 5), (107, []), (108, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, "own", 1, "n") for i, v in rows], "vec_id long, embedding array<double>, component string, row int, x string").repartition(5)
    good = [(i, v) for i, v in rows if i < 102]
    n, want, explained = _plain_whitening(good, 4)
    found = whitening.whiten(vectors, components=4)
    assert found.columns == ["vec_id", "embedding", "component", "row", "x", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    assert sorted((r.vec_id, r.component) for r in found) == sorted((i, k) for i, _ in good for k in range(1, 5))
    sign = {}
    for r in found:
        squared, w = want[r.vec_id]
        assert r.n == n == 90 and int(r.deviation) == squared
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9
        sign.setdefault(r.component, math.copysign(1, r.whitened * w[r.component - 1]))
        assert abs(r.whitened - sign[r.component] * w[r.component - 1]) < 1e-8


def test_whitening_without_variance_and_without_rows(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in whitening.whiten(one).orderBy("vec_id", "component").collect()] == [(i, k, 1, 0, None, 0.0) for i in (1, 2) for k in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    found = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in found) and abs(max(r.explained for r in found) - 1) < 1e-12
    assert whitening.whiten(line.limit(0)).count() == 0
    assert whitening.whiten(line.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_sums_of_products_are_exact_where_doubles_and_longs_are_not(spark):
    rng = random.Random(4)
    x = [[rng.randrange(-(1 << 54), 1 << 54) for _ in range(3)] for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(3)
    one = [[*v, 1] for v in x]
    want = [[sum(v[i] * v[j] for v in one) for j in range(4)] for i in range(4)]
    assert whitening.scatter(df, 3, whitening.enough_primes(40 << 108)) == want
    big = rng.randrange(1 << 200)
    moduli = whitening.enough_primes(big)
    assert math.prod(moduli) > 2 * big and whitening.from_residues([big % p for p in moduli], moduli) == big
    assert whitening.from_residues([-big % p for p in moduli], moduli) == -big
    assert whitening.primes(3, 10) == [1021, 1019, 1013]
    model = whitening.Whitening(10**12, [0, 10**15], np.ones(1), np.ones((2, 1)), 1.0, 1 << 54)
    d = model.deviations(np.array([[1 << 54, -(1 << 54)]]))
    assert d.tolist() == [[10**12 << 54, -(10**12 << 54) - 10**15]] and model.squared(d)[0] == sum(v * v for v in d.tolist()[0])


def test_a_large_block_of_residues_is_exact():
    x = np.random.default_rng(1).integers(-(1 << 40), 1 << 40, (20_000, 3))
    p = whitening.primes(1)[0]
    got = whitening.modular_gram(x, p)
    one = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1).astype(object)
    assert (got == np.array((one.T @ one) % p, np.int64)).all()


# --- 13 ----------------------------------------------------------------------------------------------------------------------

ODD = ["<|endoftext|> x </s>", "a▁b c", "c d", "  lead  two   spaces ", "tab\tand\nnew \n\n line\n", " nbsp   x　 y z", "日本語 の テキスト 😀 emoji", "<0x41> <unk>", None, "", " ", "é è ß ß ñ x", "x" * 3000, " " * 50, "a\x00b c", "don't they're I'll 123 4567", "\r\n win\r\n dos", "…ü…", "ß next à next é ", "日" * 700 + "x", "ab" * 9000]


@pytest.fixture(scope="module")
def paths():
    return alignment.tokenizer_path("byte_bpe_50k.json"), alignment.tokenizer_path("piece_bpe_32k.model")


def test_alignments_equal_brute_force(spark, paths):
    rng = random.Random(5)
    words = ["thnder", "ouble", "the", "inesea,", "worth", "less.\n", "ß", "Éa", "12", "(x)", "\n\n"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    texts += [texts[-1], texts[-1], "the " * 20_000]
    docs = spark.createDataFrame([(None if i == 5 else i, t, "own", i) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, pair int")
    want = alignment.brute_force(texts, *paths)
    for size, parts in ((2000, 3), (1 << 20, 2)):
        found = alignment.alignments(docs.repartition(parts), size=size).collect()
        assert len(found) == len(texts)
        by = {r.doc_id: tuple(r)[1:] for r in found}
        assert [by[None if i == 5 else i] for i in range(len(texts))] == want
    assert want[1][0] == 0 and want[8][0] == want[9][0] == 0 and want[10][0] > 0
    assert alignment.alignments(docs.limit(0)).count() == 0
    groups = {r.doc_id: r.groups for r in alignment.token_groups(docs.where("doc_id in (2, 8)")).collect()}
    assert groups[8] == "" and groups[2].count(";") == 1
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.linked_pairs(docs, size=3000).collect()}
    top = {}
    for (a, _), (n, _) in pairs.items():
        top[a] = max(top.get(a, 0), n)
    assert all(best == (n == top[a]) for (a, _), (n, best) in pairs.items()) and max(top.values()) > 30


def test_chunks_are_encoded_as_in_their_text(paths):
    a, b = alignment.ByteTokens(paths[0]), alignment.PieceTokens(paths[1])
    assert a.cuts and b.cuts
    texts = [t for t in ODD if t and "▁" not in t]
    for t in texts:
        x = alignment.block(*strings(pa.array([t])), a, b)
        assert x.n_a[0] == len(a.tokenizer.encode(" " + t, add_special_tokens=False).ids) and x.n_b[0] == len(b.model.encode(t))


def test_links_of_a_large_group_are_counted_by_ids():
    rng = np.random.default_rng(2)
    groups = alignment.Groups(np.array([3, 90, 1]), np.array([2, 80, 1]), np.array([0, 0, 2]))
    ids_a, ids_b = rng.integers(0, 9, 94), rng.integers(0, 9, 83)
    total = lambda most: {k: int(n) for k, n in _added(*alignment.links(ids_a, ids_b, groups, most)).items()}
    assert total(10) == total(10**6) and sum(total(10).values()) == 3 * 2 + 90 * 80 + 1


def _added(pair, weight, text):
    out = {}
    for p, w, t in zip(pair.tolist(), weight.tolist(), text.tolist(), strict=True):
        out[p, t] = out.get((p, t), 0) + w
    return out
