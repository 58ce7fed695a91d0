import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontam, ngram_join, packing, quality

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
OWN = ["score", "predicted", "n", "n_words", "n_hit", "contaminated", "n_lines", "n_dropped", "kept_text", "__x", "__row", "row", "told", "key", "drops", "p", "id", "g", "a.b"]
LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def lines_kept(rows):
    """{(doc_id, text): text without repeated lines} by the contract."""
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n") if i is not None else ():
            held[key(s)].add(i)
    goes = lambda i, s: i is not None and len(key(s)) >= 40 and len(held[key(s)]) >= 5 and i != max(held[key(s)])
    return {(i, t): t and "\n".join(s for s in t.split("\n") if not goes(i, s)) for i, t in rows}


def documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    line = "A line that many documents have, and which is long enough."
    odd = [(9001, None, None, None, None), (9002, "", "en", "src0", 0), *[(9003, "the and of is " * 30, "en", "src0", None)] * 2, *[(9010 + i, f"{line}\nthe text of number {i} is this one and no other at all", "en", None, 7) for i in range(6)]]
    odd += [(None, line, "en", "src0", 3), (None, None, None, None, None), (None, None, None, None, None), (9030, "the " * 3000 + "end", "en", "src1", 1)]
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(decontam.words_of(r.text)) >= 13]
    odd += [(9040, bench[0], "en", "src0", 1), (None, bench[1], "en", "src0", 1)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(f"own {c}") for c in OWN})


def test_stages_against_plain_versions(spark):
    """Each stage on what its predecessor kept, with nulls, empty and long texts, repeated rows and clashing columns: values compared."""
    docs = documents(spark)
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept, changed = docs, 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in kept.collect()]
        out = stage(spark, kept, DATA)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(kept.dtypes)
        after = Counter(tuple(r) for r in out.collect())
        if name == "quality":
            model = quality.fit(kept, spark.read.parquet(f"{DATA}/labels.parquet").where(~quality.held_out()))
            good = {r.text for r in quality.score(kept.select("text"), model).where("predicted = 1").collect()}
            want = Counter(r for r in before if r[1] in good)
        elif name == "lines":
            texts = lines_kept([r[:2] for r in before])
            new = [(*r[:1], texts[r[:2]], *r[2:4], r[4] if texts[r[:2]] == r[1] else len(texts[r[:2]]), *r[5:]) for r in before]
            changed += sum(a != b for a, b in zip(before, new, strict=True))
            want = Counter(new)
        elif name == "near_copies":
            roots = ngram_join.brute_force({r[0]: r[1] for r in before if r[0] is not None})
            want = Counter(r for r in before if r[0] is None or roots[r[0]][1] == r[0])
        else:
            want = Counter(r for r in before if not decontam.brute_force(r[1], bench)[4])
        assert after == want, name
        assert name == "lines" or len(want) < len(before)
        # The next stage sees rows without text or doc_id whatever this one keeps.
        more = [r for r in before if (r[0] is None or not r[1]) and not after[r]] if name == "quality" else []
        kept = spark.createDataFrame([*after.elements(), *more], docs.schema)
    assert changed >= 5
    whole = packing.TextTokenizer(packing.tokenizer_path())
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    want = Counter()
    for r in kept.collect():
        n = len(whole.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, n, k) for k in range(n))
    assert Counter((r.doc_id, r.doc_tokens, r.start + k) for r in pieces for k in range(r.length)) == want
    seqs = defaultdict(list)
    for r in pieces:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        v.sort()
        total = sum(n for _, n in v)
        assert [a for a, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and (total == 2048 or total & (total - 1) == 0)


def test_run_applies_all_stages(spark):
    """run() gives the pieces of what the stages keep of documents, one after the other."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        docs = spark.createDataFrame(out.collect(), out.schema)
    want = Counter()
    tokens = packing.tokenize(docs, packing.tokenizer_path())
    for r in tokens.collect():
        want[r.doc_id, r.doc_tokens] += r.doc_tokens
    got = Counter()
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want and 0 < docs.count() < spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0
