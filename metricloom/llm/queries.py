"""The registered queries of this subpackage: each applies one operator to its whole table.

Defined results are those of the operators: every row of the table has its row in the result, nulls,
repeats and empty texts among them, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER), with_text=False)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    from .common import scratch

    return warc.archive(table(spark, sf_dir, "pages"), scratch(spark, "archives")).drop("url", "record_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs)).drop("text")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = langid.label(docs.select("doc_id", "text"), langid.fit(docs), with_text=False)
    return labelled.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as R

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return R.judge(docs, R.weights(docs, table(spark, sf_dir, "labels"))).drop("text", "llr")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).drop("key")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.deduplicate(table(spark, sf_dir, "documents"), texts=False)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.groups(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classifiers as C

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = C.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return C.toxicity(docs, model).select("doc_id", C.toxicity_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classifiers as C

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = C.quality_model(docs, table(spark, sf_dir, "labels"))
    return C.quality(docs, model).select("doc_id", C.quality_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op1_warc": op1_warc, "op2_langid": op2_langid, "op3_rules": op3_rules, "op4_winnowing": op4_winnowing, "op5_bpe": op5_bpe, "op6_substrings": op6_substrings, "op7_jaccard": op7_jaccard, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_pii": op10_pii}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {}

ORACLES["op1_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM m
"""

ORACLES["op4_winnowing"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, l, j, array_to_string(w[j:j + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS j FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
), h AS (
  SELECT doc_id, j, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + l)) AS p FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_LINE_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op6_substrings"] = f"""
WITH d AS (SELECT doc_id, {_LINE_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op7_jaccard"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_LINE_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (h) GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)
), r AS (
  SELECT a AS doc_id, b AS m FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.m = l.a
), c AS (
  SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
