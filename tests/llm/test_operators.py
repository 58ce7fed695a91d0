import base64
import hashlib
import itertools
import pickle
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import _common, decontam, htmlcut, langid, line_dedup, media, ngram_join, packing, quality, suffix_dedup, warc
from graphloom.llm._common import strings
from graphloom.llm._components import components
from graphloom.llm._embed import Features, train
from graphloom.llm._shared import pack48

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n string, g string, drops string"


def table(spark, texts, parts=3, lang="en"):
    """documents with further columns whose names operators use inside."""
    rows = [(i, t, lang if (i or 0) % 3 else None, f"s{(i or 0) % 2}" if (i or 0) % 5 else None, len(t or ""), "x", "y", None, "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def words(rng, n, vocabulary=30):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCD") * rng.choice((1, 2)) if vocabulary > 20 else rng.choice("abc") for _ in range(n))


def corpus(seed, n=40):
    """Random texts with copies, near copies, shared lines, nulls, empty and blank texts, ties and one long text."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(n)]
    shared = words(rng, 40)
    out = []
    for i, t in enumerate(base):
        w = t.split(" ")
        out.append(t)
        if i % 3 == 0 and len(w) > 20:
            w[rng.randrange(len(w))] = "Changed"
            out.append(" ".join(w))
        if i % 4 == 0:
            out.append(t + "\n" + shared)
        if i % 7 == 0:
            out.append(t)
    out += [None, "", " \t\n", "ä", "one two", "ONE  two", "é" * 60, "longer " * 3000 + shared]
    rng.shuffle(out)
    return list(enumerate(out))


# --- 1 and 2 -----------------------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(0)
    speak = {"xx": "kilo mano rupa tesi".split(), "yy": "schwer durch nicht auch".split()}
    rows = [(i, " ".join(rng.choice(speak[lang]) for _ in range(rng.randrange(3, 30))), lang) for i in range(300) for lang in [rng.choice(["xx", "yy"])]]
    rows += [(900, None, "xx"), (901, "", None), (902, "12 34 !!", "yy"), (903, "日本語", None), (904, "nicht " * 50_000, None), (0, rows[0][1], rows[0][2]), (None, "mano rupa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predictions(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:300])
    assert all(0 <= r.score <= 1 for r in found)
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == "und" and by[902].score == 0
    assert by[903].lang_pred in speak and by[904].lang_pred == "yy" and by[None].lang_pred == "xx"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    model = langid.fit(docs)
    kept = langid.identify(docs.withColumn("score", F.lit("own")), model)
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred", "rejected"] and kept.count() == len(rows)
    assert langid.predictions(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rejection_threshold_reaches_its_target():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcd" if i % 2 else "cdef"), 6)) for i in range(600)]
    model = train(texts, [str(i % 2) for i in range(600)], Features(bits=12), target=0.95)
    assert 0 < model.reject_below <= 1 and model.table.shape == ((3 << 12) + 1, 2)


def test_quality(spark):
    rng = random.Random(1)
    good, bad = "and the of with from".split(), "BUY NOW!!! $$$ ###".split()
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(rng.randrange(2, 40)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "and the of " * 30_000), (3, rows[3][1]), (None, "and the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(5, None, 1), (None, 1, 0), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.predictions(docs, labels).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].predicted == int(i % 4 > 0) for i in range(400))
    assert by[900].score == by[901].score and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    assert {r.predicted for r in quality.predictions(docs, labels.limit(0)).collect()} == {1}
    assert quality.predictions(docs.limit(0), labels).count() == 0


def test_quality_is_fitted_evenly_over_labels(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(quality, "train", lambda texts, labels, features, **more: drawn.append(Counter(labels)) or train(texts, labels, features, **more))
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    docs, rare = ids.withColumn("text", F.concat(F.lit("text "), F.col("doc_id"))), ids.select("doc_id", (F.col("doc_id") % 100 > 0).cast("int").alias("quality"))
    model = quality.fit(docs, rare, rows=400)
    assert drawn[-1]["0"] == 50 and 280 < drawn[-1]["1"] < 420
    # Texts say nothing of their label, so that scores are near its share.
    assert np.mean([r.score for r in quality.score(docs.limit(50), model).collect()]) > 0.95
    quality.fit(docs, ids.select("doc_id", (F.col("doc_id") % 5 > 0).cast("int").alias("quality")), rows=400)
    assert 150 < drawn[-1]["0"] < 250 and 150 < drawn[-1]["1"] < 250
    quality.fit(docs, rare.limit(30), rows=400)
    assert drawn[-1].total() == 30


# --- 3 -----------------------------------------------------------------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("plain text only, no markup at all in here.", "plain text only, no markup at all in here."),
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T&amp;t</h1><p>One  two\n three.<p>Caf&eacute; &#8364;</article><footer>&copy; x</footer></body></html>", "T&t\n\nOne two three.\n\nCafé €"),
    ("<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies.</div><main><p>This is the first paragraph of it.</p><form><label>Mail</label><button>Go</button></form><p>Short.</p><section id=comments><article><p>Nice one, I like it very much.</p></article></section></main><aside><p>Read this as well, please do.</p></aside></body>", "This is the first paragraph of it.\n\nShort."),
    ("<article><p>Kept <b>bold<br><script>if (a < b) { x('</p>') }</script> text.</p><!-- <p>no</p> --><style>p{}</style><p>cut &am", "Kept bold text.\n\ncut &am"),
    ("<div class=post><p>A < b and c > d are compared here.</p></div><div class='ad banner'><p>Buy this thing now, it is cheap.</p></div>", "A < b and c > d are compared here."),
    ("<article><ul><li>First point of it.</li><li>Second.</li></ul><p title='a>b'>Quoted mark.</p></article><p", "First point of it.\n\nSecond.\n\nQuoted mark."),
]


UNMARKED = {
    "<div><h2>Results</h2><p>The measured values are given below for all of the runs.</p><ul><li>Alpha</li><li>Beta</li></ul></div>": "Results\n\nThe measured values are given below for all of the runs.\n\nAlpha\n\nBeta",
    "<h2>Results</h2><table><tr><td>42</td><td>17</td></tr></table>": "Results\n\n42\n\n17",
    "<h1>Title</h1><p>Short text here.</p><ul><li>One</li><li>Two</li><li>Three</li></ul>": "Title\n\nShort text here.\n\nOne\n\nTwo\n\nThree",
    "<div><p>See <a href=x>the full report of the committee on this matter</a> now.</p></div>": "See the full report of the committee on this matter now.",
    "<p><a href=x>Read the whole story of the river</a></p>": "Read the whole story of the river",
    "<p>" + "A long paragraph of many words stands here. " * 8 + "</p><ul><li>Alpha</li><li>Beta</li></ul>": ("A long paragraph of many words stands here. " * 8).strip() + "\n\nAlpha\n\nBeta",
    "<ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul><p>" + "A long paragraph of many words stands here. " * 4 + "</p><div class=share>Share this</div><footer>Imprint</footer>": ("A long paragraph of many words stands here. " * 4).strip(),
}


@pytest.mark.parametrize("html", UNMARKED)
def test_text_that_nothing_marks_is_content(html):
    assert htmlcut.main_text(html) == UNMARKED[html]


def test_main_text(spark):
    rows = [(i, None if i == 2 else f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(3, "u3", PAGES[3][0])]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    found = htmlcut.extract(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert htmlcut.extract(pages.limit(0)).count() == 0
    assert len(htmlcut.main_text("<article>" + "<p>A sentence of some length, for all.</p>" * 5000).split("\n\n")) == 5000
    assert htmlcut.main_text("<div>" * 3000 + "<p>Deep down there is a sentence, at last.") == "Deep down there is a sentence, at last."


@pytest.mark.parametrize(
    "stray,text",
    [("</>", " "), ("</ p>", " "), ("</3 it>", " "), ("a <é b", "a <é b"), ("x <中", "x <中"), ("1 <2 and <", "1 <2 and <")],
)
def test_text_goes_on_after_a_stray_tag(stray, text):
    page = f"<article><p>It begins {stray} here.</p><p>And it goes on after that.</p></article>"
    assert htmlcut.main_text(page) == " ".join(f"It begins {text} here.".split()) + "\n\nAnd it goes on after that."
    assert htmlcut.main_text("<article><p>It begins here.</p><p>Cut off </3 it") == "It begins here.\n\nCut off"


@pytest.mark.parametrize(
    "start",
    [
        "<head><title>No</title><body>",
        "<html><head><meta charset=x><link rel=y><title>No</title>\n<script>no</script><body class=z>",
        "<head><style>no</style><noscript><link rel=y><body>",
        "<head><title>No</title>",
        "<head><title>No</title></head><body>",
    ],
)
def test_a_head_ends_without_an_end_tag(start):
    assert htmlcut.main_text(start + "<article><p>All of this is to be kept.</p></article>") == "All of this is to be kept."
    assert htmlcut.main_text(start + "<b>All</b> of this is to be kept, and more of it.") == "All of this is to be kept, and more of it."


@pytest.mark.parametrize(
    "attributes,kept",
    [
        ("class=post style='overflow:hidden'", True),
        ('data-hidden="false"', True),
        ("title='it is hidden'", True),
        ('data-role="navigation" data-id=comments', True),
        ("title = hidden", True),
        ('alt="id=comments"', True),
        ('title="hidden', True),
        ("hidden", False),
        ("class=post HIDDEN", False),
        ('title="a"hidden', False),
        ("style=x / aria-hidden = 'true'", False),
        ("ID=comments", False),
    ],
)
def test_attributes_are_read_by_their_own_names(attributes, kept):
    page = f"<body><div {attributes}><p>All of this is one sentence of the article.</p></div></body>"
    assert htmlcut.main_text(page) == ("All of this is one sentence of the article." if kept else "")


def test_text_ends_a_head():
    assert htmlcut.main_text("<head> <title>No</title>\n All of this is to be kept, and more of it.") == "All of this is to be kept, and more of it."


def test_min_cut_is_minimal():
    import itertools

    rng = random.Random(0)
    for _ in range(150):
        n = rng.randint(1, 8)
        costs = [rng.choice([0, rng.uniform(-3, 3)]) for _ in range(n)]
        links = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]

        def value(keep):
            return sum(abs(c) for c, k in zip(costs, keep) if (c > 0) != bool(k) and c) + sum(c for a, b, c in links if keep[a] != keep[b])

        assert value(htmlcut.min_cut(costs, links)) == pytest.approx(min(map(value, itertools.product([0, 1], repeat=n))))


@pytest.mark.parametrize(
    "start,end",
    [
        ("<html><head><title>T</title><body><article>", "</article>"),
        ("<body><form action=/x id=aspnetForm><div>", "</div></form>"),
        ("<form><fieldset>", "</fieldset></form>"),
        ("<div class='post-content has-sidebar'>", "</div>"),
        ("<article class='discussion-paper'>", "</article>"),
        ("<div id='text-share'>", "</div>"),
        ("<a name=top><div>", "</div>"),
        ("<div><button>", "</div>"),
        ("<div class=content><header class='article-header'>", "</header></div>"),
        ("<body class='no-sidebar single-post'><div id=main-content>", "</div>"),
    ],
)
def test_names_and_wrappers_do_not_empty_a_page(start, end):
    text = ["This is the first paragraph of a page, which has some words to tell and ends with a full stop, as sentences do at all times.", "And here is the second one, long enough to be taken for text by whoever reads it, and with a comma or two, as they are used."]
    page = "<nav><ul><li><a href=/>Home</a><li><a href=/b>Other</a></ul></nav>" * (not start.startswith("<html")) + start + "".join(f"<p>{t}</p>" for t in text) + end + "<footer>&copy; x 2020</footer>"
    assert htmlcut.main_text(page) == "\n\n".join(text)


def test_headline_of_an_article_header():
    page = "<article class=post><div class='article-header'><h1>The headline</h1></div><p>A paragraph of the article, which is short.</p><div class='post-footer'>Tagged x</div><div class='comments-area'><p>I have a remark on this, and it is a long one, too.</p></div></article><div class='ad-content'>Buy it now.</div>"
    assert htmlcut.main_text(page) == "The headline\n\nA paragraph of the article, which is short."


# --- 4 -----------------------------------------------------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))) for i in range(8)] + [("8", None), ("9", "!!"), ("7", "a  B-c"), (None, "b c a b")]
    texts = [(i, " ".join(rng.choice("aAbBc") + rng.choice(["", ".", ",\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    texts += [(50, None), (51, ""), (52, "ä " + items[2][1] + " ö"), (53, items[3][1] + "\n" + "x " * 900), (54, items[3][1]), (54, items[3][1]), (None, items[3][1])]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    named = [(i or "", t) for i, t in items]
    found = decontam.digest(docs, bench).collect()
    assert len(found) == len(texts)
    want = {i: decontam.brute_force(t, [(i, t) for i, t in named if i]) for i, t in texts}
    every = {i: decontam.brute_force(t, named) for i, t in texts}
    for r in found:
        assert (r.n_words, r.n_hit, r.contaminated) == (every[r.doc_id][0], every[r.doc_id][1], every[r.doc_id][4])
        assert (r.n_items, r.items_sha256) == want[r.doc_id][2:4]
    for wave in (8, 2):
        monkeypatch.setattr(decontam, "WAVE", wave)
        blocks = decontam.overlaps(docs, bench, block_chars=20).select("row.doc_id", "told").collect()
        assert {r.doc_id: (r.told.words, sum(x.e - x.s for x in r.told.spans)) for r in blocks} == {i: v[:2] for i, v in every.items()}
    assert decontam.digest(docs, bench.limit(0)).where("n_hit > 0").isEmpty()
    assert decontam.digest(docs.limit(0), bench).count() == 0
    wide = docs.withColumns({c: F.lit("own") for c in ("n_words", "n_hit", "contaminated", "items", "__words", "__row", "row", "told", "text2", "a.b")})
    for action in ("drop", "spans"):
        kept = decontam.decontaminate(wide, bench, action=action)
        assert kept.columns == wide.columns
        assert {tuple(r[2:]) for r in kept.collect()} == {("own",) * 10}
    assert decontam.decontaminate(docs, bench).count() == sum(not every[i][4] for i, _ in texts)
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, action="spans").collect()}
    assert cut[52] == "ä  ö" and cut[50] is None and cut[54] == ""


def test_passages_after_rows_without_words():
    passage = [f"w{i}" for i in range(14)]
    for n in (13, 14):
        index = decontam.ItemIndex([("a", " ".join(passage[:n]))])
        for before in ([""], ["", "!! ."], ["x"], ["x y", ""]):
            raw = [t.encode() for t in [*before, " ".join(passage[:n]), ""]]
            count, found = index.scan(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            assert count.tolist() == [len(decontam.words_of(t.decode())) for t in raw]
            assert {row: (decontam.joined(spans), ids) for row, (spans, ids) in found.items()} == {len(before): ([(0, n)], {"a"})}


def test_decontamination_behind_a_null_row(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(0, None), (1, "?!"), (2, passage)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.digest(docs, bench).collect()}
    assert found == {0: (0, 0, 0, False), 1: (0, 0, 0, False), 2: (13, 13, 1, True)}


def test_automaton_knows_all_substrings():
    rng = random.Random(1)
    for _ in range(30):
        seqs = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        index = pickle.loads(pickle.dumps(decontam.ItemIndex([(str(i), " ".join(s)) for i, s in enumerate(seqs)], window=3)))
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text = [rng.choice("abcd") for _ in range(40)]
        for k, (_, n) in enumerate(index.walk(index.ids.get(x.encode(), -1) for x in text), 1):
            assert n == max((m for m in range(k + 1) if tuple(text[k - m : k]) in subs), default=0)


def test_repetitive_items_take_linear_time():
    """An item of many equal words, and a document of more of them: a quadratic index would take hours."""
    index = decontam.ItemIndex([("a", "so " * 100_000), ("b", "so " * 13)])
    data = np.frombuffer(b"so " * 200_000, np.uint8)
    words, found = index.scan(data, np.array([0, len(data)]))
    assert words.tolist() == [200_000] and decontam.joined(found[0][0]) == [(0, 200_000)] and found[0][1] == {"a", "b"}


# --- 5 and 6 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,most", [(0, 1 << 20), (1, 1 << 20), (0, 0), (1, 3000)])
def test_suffix_dedup_against_brute_force(spark, seed, most):
    """With buckets that are resolved, all parted by windows, and some of each."""
    texts = corpus(seed)
    found = suffix_dedup.dedup(table(spark, texts + texts[:2] + [(None, texts[0][1])]), most).collect()
    want = suffix_dedup.brute_force(dict(texts))
    assert len(found) == len(texts) + 3 and sum(v[1] for v in want.values()) > 1000
    for r in found:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert suffix_dedup.dedup(table(spark, texts).limit(0)).count() == 0


def test_texts_under_one_id_keep_apart(spark):
    """Two texts of document 2, the one with a passage of document 1, the other without, whatever a few bits of their hashes say."""
    passage = "a passage that stands in the first document and in one text of the second one, word by word."
    texts = [(1, "Before it. " + passage), (2, passage + " And after.")] + [(2, f"{k} is a text of its own, which has nothing in common with any other {k * 7919} of them {k}") for k in range(40)]
    for r in suffix_dedup.dedup(table(spark, texts)).collect():
        own = bytes(r.kept).decode()
        assert r.n_removed == (len(passage) if "And after" in own else 0), own


def test_segments_settle_in_ranges_of_seeds(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 3)
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice("kilo mano".split()) for _ in range(60))) for i in range(40)]
    want = suffix_dedup.brute_force(dict(texts))
    blobs = []
    docs = pa.table({"doc_id": [i for i, _ in texts], "tag": [0] * 40, "text": [t for _, t in texts], "blobs": [[pack48(suffix_dedup.seed_hashes(*strings(pa.array([t])))[0] >> np.uint64(16))] for _, t in texts]})
    found = defaultdict(list)
    for k in range(0, 40, 8):
        for b in suffix_dedup.segments(docs.slice(k, 8), 1):
            for kind, doc, blob in zip(*(b[c].to_pylist() for c in ("kind", "doc_id", "blob"))):
                (blobs if kind == 0 else found[doc]).append(blob)
    out = suffix_dedup.resolve(blobs)
    for doc, blob in zip(out["doc_id"].to_pylist(), out["blob"].to_pylist()):
        found[doc].append(blob)
    assert sum(v[1] for v in want.values()) > 500
    for i, t in texts:
        kept, gone, runs = suffix_dedup._apply(t.encode(), found[i])
        assert (gone, runs, hashlib.sha256(kept).hexdigest()) == want[i][1:]


def test_long_rows_are_cut_into_overlapping_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    offsets = np.array([0, 30, 3000, 3049, 4000])
    whole = [np.concatenate(x) for x in zip(*[(lo + k for k in (0,)) for lo in ()])] or suffix_dedup.row_seeds(data, offsets)
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    parts = suffix_dedup.row_seeds(data, offsets)
    cover = lambda x: sorted((int(r), int(w), int(h)) for h, r, lo, hi in zip(*x) for w in range(lo, hi + 1))
    assert cover(parts) == cover(whole)
    assert len(cover(whole)) == sum(max(0, n - 49) for n in np.diff(offsets))


def test_suffix_ranks():
    rng = random.Random(3)
    text = np.array([rng.choice(b"ab") for _ in range(300)] + [0] * 8, np.uint8)
    text[100:180] = text[10:90]
    group = np.random.default_rng(0).integers(0, 3, 250)
    rank = suffix_dedup.equal_suffixes(text, np.arange(250), group, 50, 16)
    keys = [(int(group[i]), text[i : i + 50].tobytes()) for i in range(250)]
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    for a in range(0, 250, 7):
        for b in range(0, 250, 11):
            assert (rank[a] < rank[b]) == (order[keys[a]] < order[keys[b]])
            assert (rank[a] == rank[b]) == (keys[a] == keys[b])


@pytest.mark.parametrize("seed,block,pivots", [(0, 2048, 64), (1, 4, 64), (1, 2, 0), (2, 3, 1)])
def test_near_copies_against_brute_force(spark, seed, block, pivots, monkeypatch):
    """With groups whole, split into blocks that pivots join, and blocks with the rest compared with all of the group."""
    monkeypatch.setattr(ngram_join, "REFINE", 3 if seed else 200)
    if pivots == 1:
        monkeypatch.setattr(_common, "LIGHT", 1)
        monkeypatch.setattr(_common, "HEAVY", 10)
    texts = corpus(seed)
    docs = table(spark, texts + texts[:2] + [(None, texts[0][1])])
    want = ngram_join.brute_force(dict(texts))
    assert sum(i != c for i, (_, c) in want.items()) > 10
    found = ngram_join.near_copies(docs, block=block, pivots=pivots).collect()
    assert len(found) == len(texts) + 3
    for r in found:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (None, None))
    if not seed:
        kept = ngram_join.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted({r.doc_id for r in kept.where("doc_id is not null").collect()}) == sorted(i for i, (_, c) in want.items() if i == c)
        assert ngram_join.near_copies(docs.limit(0)).count() == 0


def test_overlap_counts_and_chains():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(70)]
    got = ngram_join.overlap(sets[:50], sets[20:])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[20 + j])) for i in range(50) for j in range(50))
    ids = np.arange(50)
    link = rng.random((50, 50)) < 0.02
    up = list(range(50))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in zip(*np.nonzero(link)):
        up[find(int(i))] = find(int(j))
    spanned = list(range(50))

    def find2(x):
        while spanned[x] != x:
            x = spanned[x]
        return x

    for a, b in ngram_join.forest(ids, ids, link):
        spanned[find2(a)] = find2(b)
    assert all((find(a) == find(b)) == (find2(a) == find2(b)) for a in range(50) for b in range(50))


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


# --- 7, 8, 9 and 10 ----------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = [(0, "abc"), (1, None), (2, ""), (3, "é" * 70_000), (4, "abc"), (4, "abc"), (None, "x" * 64)]
    found = media.stored_texts(table(spark, texts)).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = (dict(texts)[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(media.write_container(payload)).hexdigest()
    assert media.stored_texts(table(spark, texts).limit(0)).count() == 0
    rows = [(0, media.write_container(bytes(200_000))), (1, None), (2, b"junk"), (3, b""), (4, media.write_container(b"a" * 64)[:-9])]
    out = {r.i: r for r in media.media_columns(spark.createDataFrame(rows, "i int, media binary")).collect()}
    assert out[0].codec == "raw " and out[0].duration == 25.0 and [(k.offset, k.bytes) for k in out[0].keyframes] == [(32, 200_000)]
    assert all(out[i].codec is None and out[i].keyframes is None for i in (1, 2, 3, 4))


def test_media_sample_tables():
    """Sizes, chunks of changing length, and a table of sync samples."""
    sizes = [5, 7, 1, 9, 4]
    body = b"".join(bytes([i]) * n for i, n in enumerate(sizes))
    full = media.full
    stbl = media.box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))), full(b"stts", struct.pack(">III", 1, 5, 10)),
        full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 3, 1)), full(b"stsz", struct.pack(">II5I", 0, 5, *sizes)),
        full(b"co64", struct.pack(">IQQ", 2, 16, 28)), full(b"stss", struct.pack(">III", 2, 1, 4)),
    )
    mdhd = full(b"mdhd", struct.pack(">QQIQI", 0, 0, 25, 50, 0), version=1)
    data = media.box(b"free") + media.box(b"mdat", body) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    (t,) = media.tracks(data)
    assert (t["codec"], t["duration"], t["timescale"], t["samples"]) == ("avc1", 50, 25, 5)
    assert t["keyframes"] == [(16, 5), (29, 9)] and media.read_payload(data, t) == body


def boxes_of_a_track(*tables, ident=1, more=b""):
    full = media.full
    tkhd = full(b"tkhd", struct.pack(">III", 0, 0, ident), bytes(72))
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, 10, 0), bytes(4))
    hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0")
    stsd = full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78)))
    return media.box(b"moov", media.box(b"trak", tkhd, media.box(b"mdia", mdhd, hdlr, media.box(b"minf", media.box(b"stbl", stsd, *tables)))), more)


def test_media_fragments(spark):
    """Two fragments: sizes and flags of each sample in the first, defaults and a first sample's flags in the second."""
    full, box = media.full, media.box
    empty = [full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4))]
    head = boxes_of_a_track(*empty, ident=3, more=box(b"mvex", full(b"trex", struct.pack(">5I", 3, 1, 2, 4, 0x10000))))
    samples = [(5, 0), (6, 0x10000), (7, 0)]
    size = len(box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 3), flags=0x20000), full(b"trun", struct.pack(">Ii", 3, 0), *(struct.pack(">II", *x) for x in samples), flags=0x601))))
    moof = box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 3), flags=0x20000), full(b"trun", struct.pack(">Ii", 3, size + 8), *(struct.pack(">II", *x) for x in samples), flags=0x601)))
    one = moof + box(b"mdat", b"a" * 5 + b"b" * 6 + b"c" * 7)
    second = lambda at: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">II", 3, 9), flags=0x20008), full(b"trun", struct.pack(">IiI", 2, at, 0), flags=5)))
    data = head + one + second(len(second(0)) + 8) + box(b"mdat", b"ddddeeee")
    (t,) = media.tracks(data)
    assert (t["codec"], t["handler"], t["samples"], t["duration"]) == ("avc1", "vide", 5, 3 * 2 + 2 * 9)
    assert [data[a : a + n] for a, n in t["keyframes"]] == [b"aaaaa", b"ccccccc", b"dddd"]
    assert media.read_payload(data, t) == b"aaaaabbbbbbcccccccddddeeee"
    (r,) = media.media_columns(spark.createDataFrame([(1, data, "own", "x", "y")], "i int, media binary, `told` string, `row` string, codec string")).collect()
    assert (r.told, r.row, r.codec, r.duration, r.n_tracks) == ("own", "x", "avc1", 2.4, 1)


def test_malformed_media(spark):
    full, box = media.full, media.box
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    times, chunk = full(b"stts", struct.pack(">III", 1, 2, 1)), full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1))
    far = boxes_of_a_track(times, chunk, full(b"stsz", struct.pack(">II", 8, 2)), full(b"co64", struct.pack(">IQ", 1, (1 << 64) - 100)))
    high = boxes_of_a_track(times, chunk, full(b"stsz", struct.pack(">II", 8, 2)), full(b"stco", struct.pack(">II", 1, 1 << 20)))
    first = boxes_of_a_track(times, full(b"stsc", struct.pack(">IIII", 1, 0, 2, 1)), full(b"stsz", struct.pack(">II", 8, 2)), full(b"stco", struct.pack(">II", 1, 0)))
    sync = boxes_of_a_track(times, chunk, full(b"stsz", struct.pack(">II", 1, 2)), full(b"stco", struct.pack(">II", 1, 0)), full(b"stss", struct.pack(">II", 1, 0)))
    short = boxes_of_a_track(full(b"stsz", bytes(2)))
    bad = [deep, far, high, first, sync, short, box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd"))))]
    for x in bad:
        with pytest.raises(ValueError):
            media.tracks(x)
    four = boxes_of_a_track(full(b"stts", struct.pack(">III", 1, 3, 1)), full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), full(b"stz2", struct.pack(">3xBI2B", 4, 3, 0x12, 0x30)), full(b"stco", struct.pack(">II", 1, 8)))
    (t,) = media.tracks(four)
    assert t["chunks"] == [(8, 6)] and t["samples"] == 3
    out = media.media_columns(spark.createDataFrame([(i, x) for i, x in enumerate([*bad, four])], "i int, media binary")).collect()
    assert [r.codec for r in out] == [None] * len(bad) + ["avc1"]


def test_packing(spark):
    rng = random.Random(8)
    texts = [(i, words(rng, rng.choice([0, 3, 50, 900, 4000]))) for i in range(60)] + [(90, None), (91, ""), (3, "again"), (None, "no id"), (92, "İ <|endoftext|>.a, b.c'll ́x")]
    docs = table(spark, texts)
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, group_tokens=20_000).collect()
    ids = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in texts)
    seqs, docs_of = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        docs_of[r.doc_id, r.doc_tokens].append(r)
    for v in seqs.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(len(k) * n for k, n in ids.items())
    crcs = Counter((r.start, r.length, r.ids_crc32) for r in rows)
    for (doc, n), v in docs_of.items():
        v.sort(key=lambda r: r.start)
        assert [r.start for r in v] == [sum(x.length for x in v[:k]) for k in range(len(v))] and v[-1].start + v[-1].length == n
        (own,) = [k for k in ids if len(k) == n and any(t is not None and i == doc or doc == i for i, t in texts if tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) == k)][:1]
        assert all(zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in v)
    assert crcs
    assert packing.pack(docs.limit(0)).count() == 0


def test_deficits_keep_the_mixture():
    from collections import deque

    share = {"a": 0.5, "b": 0.3, None: 0.2}
    queues, who = {s: deque() for s in share}, {}
    for s, p in share.items():
        for _ in range(int(1000 * p)):
            who[len(who)] = s
            queues[s].append([len(who) - 1, 0, 300])
    sent, seen, worst = Counter(), 0, 0
    for doc, _, n, _, offset in packing.deficit_round_robin([(queues, share, dict.fromkeys(share, 0.0))]):
        sent[who[doc]] += n
        seen += n
        if offset + n == 2048 and seen < 0.9 * 300_000:
            worst = max(worst, max(abs(sent[s] - p * seen) for s, p in share.items()))
    assert sum(sent.values()) == 300_000 and worst <= 300


@pytest.mark.parametrize("targets", [None, {"s0": 9, "s1": 1}, {"s1": 0.5, "s0": 0.3, "none": 1.0}, {"s0": 0.0}])
def test_windows_have_their_target(spark, targets):
    """Over all groups, what each source has sent at a window's end is within a document of its target, while it has documents."""
    rng = random.Random(3)
    sizes = {"s0": 700, "s1": 500, None: 200}
    rows = [(i, s, n, np.full(n, 7, "<u2").tobytes()) for i, (s, n) in enumerate((s, rng.randrange(1, 300)) for s, k in sizes.items() for _ in range(k))]
    before, parts = Counter(), []
    for i, (doc, s, n, ids) in enumerate(sorted(rows, key=lambda r: (r[0] % 5, rng.random()))):
        parts.append((doc % 5, before[doc % 5, s], doc, s, n, bytearray(ids)))
        before[doc % 5, s] += n
    tokens = spark.createDataFrame(parts, "part int, before long, doc_id long, source string, doc_tokens long, ids binary")
    found = packing.pack_tokens(tokens, length=512, group_tokens=20_000, targets=targets).collect()
    total = Counter()
    for _, s, n, _ in rows:
        total[s] += n
    assert Counter((r.doc_id, r.start + k) for r in found for k in range(r.length)) == Counter((d, k) for d, _, n, _ in rows for k in range(n))
    named = {s: w for s, w in (targets or total).items() if w and total[s]} or total
    late = {s: total[s] for s in total if s not in named}
    sent, seen, checked = Counter(), 0, 0
    for window, pieces in itertools.groupby(sorted(found, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        for r in pieces:
            sent[r.source] += r.length
            seen += r.length
        for shares in (named, late):
            left = [s for s in shares if sent[s] < total[s] - 600]
            if len(left) < len(shares) or not left:
                continue
            whole = sum(sent[s] for s in shares)
            checked += 1
            for s, w in shares.items():
                assert abs(sent[s] - whole * w / sum(shares.values())) <= 600, (window, s)
            if shares is named and whole < sum(total[s] for s in named) - 5000:
                assert not any(sent[s] > 600 for s in late)
    assert checked > 50 and len({r.sequence_id >> 32 for r in found}) >= 9


def test_any_tokenizer_file(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    assert packing.chunked(packing.tokenizer_path()) and not packing.chunked(path)
    texts = [(0, "Some Text, don't lower it.\n\n  Spaces stay"), (1, None), (2, "<|endoftext|>x"), (3, "É ß 日本")]
    whole = Tokenizer.from_file(path)
    for r in packing.tokenize(table(spark, texts, lang="en"), path).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == whole.encode(texts[r.doc_id][1] or "", add_special_tokens=False).ids + [1]


def test_tokenizer_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, mine, rng = Tokenizer.from_file(path), packing.ChunkTokenizer(path), random.Random(2)
    texts = ["".join(rng.choice("aB.,'é <|>12sSĺ%&$\n!?") for _ in range(30)) for _ in range(300)] + [None, "", "<|EndOfText|> <|endoftext|>", "ǆ İ ﬁ ẞ ² Ⅷ ªº 日本 한국 ไทย שלום e\u0301"]
    array = pa.array(["skipped", *texts]).slice(1)
    for t, got in zip(texts, mine(array)):
        assert whole.encode(t or "", add_special_tokens=False).ids == got.tolist()


def test_warc_headers_stand_whatever_a_url_holds(spark):
    odd = [chr(c) for c in [*range(0x20), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x3000, 0xFEFF]]
    urls = [f"http://a/{c}Page-ID: 99" for c in odd] + [f"http://a/{c}WARC-Payload-Digest: sha1:Q{c}WARC-Type: revisit" for c in odd] + ["", " ", ": ", "WARC-Type: x"]
    pages = spark.createDataFrame([(i, u, f"page {i % 40}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.archived_pages(pages).collect()}
    assert len(found) == len(urls)
    for i, u in enumerate(urls):
        assert found[i].url == u.replace("\r", "%0D").replace("\n", "%0A") and found[i].payload_bytes == len(f"page {i % 40}")
        assert found[i].payload_digest == base64.b32encode(hashlib.sha1(f"page {i % 40}".encode()).digest()).decode()


def test_warc(spark, tmp_path):
    import gzip

    html = ["<p>a</p>", "<p>b</p>", None, "", "<p>a</p>", "ü\r\n\r\nWARC/1.1\r\nPage-ID: 7\r\n\r\n", "<p>a</p>"]
    rows = [(i, f"http://x/{i}", h, "own") for i, h in enumerate(html)] + [(6, "http://x/6", "<p>a</p>", "own"), (None, None, "<p>a</p>", "own"), (None, "u\r\nWARC-Type: no", "only", "own"), (9, "same", "one", ""), (9, "same", "two", ""), (9, "", "big " * 40_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, header string").repartition(3)
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 8
    found = warc.archived_pages(pages).collect()
    assert len(found) == len(rows)
    last = {"<p>a</p>": 6, "<p>b</p>": 1, "": 3, html[5]: 5}
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = []
    for i, u, h, _ in rows:
        h = h or ""
        revisit = h in last and i != last[h]
        want.append((i, u and u.replace("\r\n", "%0D%0A"), len(h.encode()), digest(h), "revisit" if revisit else "response", last[h] if revisit else None))
    assert Counter(map(tuple, found)) == Counter(want)
    small = warc.archived_pages(pages, min_revisit=9).collect()
    assert {r.record_type for r in small if r.payload_bytes < 9} == {"response"}
    warc.export_warc(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    ids, kinds = [], Counter()
    for p in (tmp_path / "w").glob("part-*"):
        data = p.read_bytes()
        raw, members = gzip.decompress(data), 0
        while data:
            d = zlib.decompressobj(31)
            d.decompress(data)
            data, members = d.unused_data, members + 1
        n = 0
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            assert lines[0] == b"WARC/1.1"
            fields = dict(x.split(b": ", 1) for x in lines[1:])
            assert len(fields) == len(lines) - 1 and (fields[b"WARC-Type"] == b"warcinfo") == (n == 0)
            size = int(fields[b"Content-Length"])
            if fields[b"WARC-Type"] == b"response":
                assert fields[b"WARC-Payload-Digest"].decode() == "sha1:" + digest(raw[:size].decode())
            ids.append(fields[b"WARC-Record-ID"])
            kinds[fields[b"WARC-Type"]] += 1
            assert raw[size : size + 4] == b"\r\n\r\n"
            raw = raw[size + 4 :]
            n += 1
        assert n == members
    assert len(set(ids)) == len(ids) and kinds[b"response"] + kinds[b"revisit"] == len(rows) and kinds[b"revisit"] == 4
    assert warc.archived_pages(pages.limit(0)).count() == 0
    broken = spark.createDataFrame([(bytearray(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"),)], "record binary")
    with pytest.raises(Exception, match="not a WARC record"):
        warc.restore(broken).collect()


def test_line_dedup(spark):
    long = "x" * 38
    lines = [f"{long} {c}" for c in "abc"] + ["Ö" * 40, "short", "É" * 39, "  " + "w" * 40 + "\t\r"]
    rng = random.Random(2)
    texts = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else rng.choice(lines).swapcase() for _ in range(rng.randrange(0, 6)))) for i in range(25)]
    texts += [(30, None), (31, ""), (32, "\n\n"), (33, (lines[0] + "\n") * 2000), (34, "only here " * 6), (24, texts[24][1])]
    docs = table(spark, texts + [(None, lines[0])])
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for i, t in texts:
        for s in (t or "").split("\n"):
            held[key(s)].add(i)
    found = line_dedup.drop_repeated_lines(docs).collect()
    assert len(found) == len(texts) + 1
    dropped = 0
    for r in found:
        own = (r.text or "").split("\n")
        if r.doc_id is None:
            assert r.n_dropped == 0
            continue
        keep = [s for s in own if len(key(s)) < 40 or len(held[key(s)]) < 5 or r.doc_id == max(held[key(s)])]
        dropped += len(own) - len(keep)
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(own), len(own) - len(keep), "\n".join(keep))
    assert dropped > 20
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0
    clash = docs.withColumns({c: F.lit(c) for c in ("__id", "__lines", "row", "key", "own_text", "a.b", "n_lines")})
    out = line_dedup.drop_repeated_lines(clash)
    assert out.columns == [*clash.columns, "n_dropped", "kept_text"]
    for r in out.collect():
        assert (r["__id"], r["row"], r["key"], r["own_text"], r["a.b"], r["score"], r["drops"]) == ("__id", "row", "key", "own_text", "a.b", "x", "z")


def test_line_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(bytes([i]), 10 * k + i) for i in range(k, k + 3)], "h binary, doc_id long")
        new = {r.h for r in runs.unseen(batch).collect()}
        assert new == {bytes([i]) for i in range(k, k + 3) if k == 0 or i == k + 2}
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.h for r in runs.read(*runs.runs()).collect()) == [bytes([i]) for i in range(7)]
    got = {r.h: (r.n_docs, r.last_doc) for r in runs.counted(1).collect()}
    assert got[bytes([2])] == (3, 22) and got[bytes([6])] == (1, 46) and len(got) == 7
    assert {r.h for r in runs.counted(3).collect()} == {bytes([i]) for i in range(2, 5)}


def test_line_runs_last_in_their_folder(spark, tmp_path):
    """An index opened anew goes on where the last whole batch left it; one whose manifest is not whole is added again."""
    path = str(tmp_path / "runs")
    batches = [spark.createDataFrame([(bytes([i]), 10 * k + i) for i in range(k, k + 3)], "h binary, doc_id long") for k in range(5)]
    once = line_dedup.LineRuns(spark, fanout=2)
    for batch in batches:
        once.add(batch)
        line_dedup.LineRuns(spark, path, fanout=2).add(batch)
        if batch is batches[2]:
            newest = max((tmp_path / "runs").glob("manifest-*"))
            (newest / "_SUCCESS").unlink()
            line_dedup.LineRuns(spark, path, fanout=2).add(batch)
    again = line_dedup.LineRuns(spark, path, fanout=2)
    assert [len(level) for level in again.levels] == [len(level) for level in once.levels] and len(again.repeated) == len(once.repeated) == 4
    assert {tuple(r) for r in again.counted(1).collect()} == {tuple(r) for r in once.counted(1).collect()}
    assert not again.unseen(batches[4]).count()


def test_batches_of_lines_follow_the_number_of_documents(spark, monkeypatch):
    texts = [(i, f"{'y' * 40}{i // 6}\nshort") for i in range(36)]
    want = {tuple(r) for r in line_dedup.drop_repeated_lines(table(spark, texts)).collect()}
    made = []
    plain = line_dedup.LineRuns.add
    monkeypatch.setattr(line_dedup.LineRuns, "add", lambda self, lines: (made.append(1), plain(self, lines))[1])
    monkeypatch.setattr(line_dedup, "BATCH_DOCS", 5)
    assert {tuple(r) for r in line_dedup.drop_repeated_lines(table(spark, texts)).collect()} == want and len(made) == 8


def test_each_batch_merge_anti_joins_the_runs(spark, monkeypatch):
    """On the query's path: batch k meets the runs of the batches before it, on the levels that compaction left."""
    seen = []
    plain = line_dedup.LineRuns.unseen

    def watch(self, rows):
        out = plain(self, rows)
        seen.append(([len(x) for x in self.levels], out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(line_dedup.LineRuns, "unseen", watch)
    texts = [(i, "\n".join(f"{'x' * 40}{k}" for k in range(i % 7))) for i in range(40)]
    assert sum(r.n_dropped for r in line_dedup.drop_repeated_lines(table(spark, texts), batches=5).collect()) > 60
    assert [levels for levels, _ in seen] == [[1], [2], [0, 1], [1, 1]]
    for levels, plan in seen:
        # Spark writes each node twice where it holds first and final plans.
        assert "SortMergeJoin" in plan and plan.count("LeftAnti") >= sum(levels) and "BroadcastHashJoin" not in plan


def test_a_line_of_most_documents_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(_common, "LIGHT", 1)
    monkeypatch.setattr(_common, "HEAVY", 10)
    texts = [(i, f"{'common ' * 8}\n{'own ' * 12}{i // 6}") for i in range(60)]
    by = {r.doc_id: r.n_dropped for r in line_dedup.drop_repeated_lines(table(spark, texts)).collect()}
    assert by == {i: (i != 59) + (i % 6 != 5) for i in range(60)}
