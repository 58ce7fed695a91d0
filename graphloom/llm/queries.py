"""The registered queries of this package, one for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.langid import predictions

    return predictions(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import predictions

    return predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.htmlcut import extract

    return extract(read(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontam import digest

    return digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffix_dedup import dedup

    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ngram_join import near_copies

    return near_copies(read(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.media import stored_texts

    return stored_texts(read(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.warc import archived_pages

    return archived_pages(read(spark, sf_dir, "pages")).drop("url")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import predictions

    return predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.whitening import whiten

    out = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.drop("embedding").withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.alignment import alignments

    return alignments(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language, op2_quality, op3_main_text, op4_decontaminate, op5_suffix_dedup, op6_near_copies, op7_media, op8_pack, op9_warc, op10_line_dedup, op11_toxicity, op12_whitening, op13_alignment)}

_LINES = """
lines AS (
  SELECT doc_id, pos, line, CASE WHEN length(k) >= 40 THEN k END AS k FROM (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (
      SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))),
hot AS (SELECT k, max(doc_id) AS last FROM lines WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all({_LOWER}, '{_WORD}')"

ORACLE = {
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
j AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM j)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, n, p FROM dw JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    # All windows of 50 bytes, as hexadecimal digits, by their first document; runs of those that go; what lies between them.
    "op5_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM d WHERE n >= 50)),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS o FROM w) WHERE o < doc_id),
i AS (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS f FROM g)),
x AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY ALL),
y AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list({'a': a, 'b': b} ORDER BY a) AS l FROM x GROUP BY doc_id),
z AS (SELECT doc_id, h, n, n_removed, n_spans, CASE WHEN l IS NULL THEN h ELSE array_to_string(list_transform(range(len(l) + 1), lambda j: substr(h, (2 * CASE WHEN j = 0 THEN 0 ELSE l[j].b END + 1)::BIGINT, (2 * (CASE WHEN j = len(l) THEN n ELSE l[j + 1].a END - CASE WHEN j = 0 THEN 0 ELSE l[j].b END))::BIGINT)), '') END AS kept FROM d LEFT JOIN y USING (doc_id))
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM z""",
    # All shingles of five words, pairs by a join on them, and what links reach by recursion.
    "op6_near_copies": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, k.b FROM r JOIN (SELECT a, b FROM l UNION SELECT b, a FROM l) k ON k.a = r.o)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.o AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(o) AS o FROM r GROUP BY id) m ON m.id = doc_id""",
    "op9_warc": """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha1(coalesce(html, '')), 5 * i + 1, 5))::BIGINT >> (15 - 5 * j) & 31)::INT + 1, 1), '' ORDER BY i, j) FROM range(8) a(i), range(4) b(j)) AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)""",
    "op10_line_dedup": f"""
WITH {_LINES}
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE doc_id < last)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (k) GROUP BY doc_id""",
}
