"""The operators bound to the test tables, with the SQL they are checked with where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_path
from . import (collocations, content_sort, main_text, mixing, neighbours, packing, quality, secret_scan, simhash,
               substrings, token_counts, warc, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its component of near-duplicates."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op2_source_mix", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || sha256(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
      FROM d GROUP BY source),
w AS (SELECT source, size, [5, 2, 1][(place % 3 + 1)::INT]::BIGINT AS weight FROM s),
r AS (SELECT *, (sum(size) OVER ())::BIGINT AS total,
        coalesce(sum(2 * size) OVER (ORDER BY size::DOUBLE / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
        (sum(weight) OVER (ORDER BY size::DOUBLE / weight, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM w),
o AS (SELECT *, total * 3 - filled * 2 AS residue, (total * 3 - filled * 2) * weight < 2 * size * 2 * rest AS is_open FROM r),
g AS (SELECT source, size AS source_size, CASE WHEN is_open
        THEN ((SELECT max_by(residue, rest) FROM o WHERE is_open) * weight)::DOUBLE
             / ((SELECT max(rest) FROM o WHERE is_open) * 2)::DOUBLE ELSE (2 * size)::DOUBLE END AS target FROM o),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
c AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS words FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (d.size * (p.passes + CASE WHEN p.target - p.passes * p.source_size > 0 AND c.upto - c.words < p.target - p.passes * p.source_size
     AND 2 * (p.target - p.passes * p.source_size) >= (c.upto - c.words) + c.upto THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
""")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words the mix takes of each: sources weigh 5, 2, 1 in turn and share 150 % of all words."""
    rows = materialise(mixing.sized(_table(spark, sf_dir, "documents")), "mix-sized")
    mixed = mixing.mix(rows, mixing.targets(mixing.cycled_weights(rows)))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.col("times")).alias("taken"))


@_query("op4_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays (largest doc_id)."""
    return content_sort.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


@_query("op6_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
      FROM d, unnest(generate_series(1, len(w) - 19)) AS t(i) WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM s),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM r, unnest(generate_series(0, 19)) AS t(k) WHERE n > 1),
x AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
              lambda z: gone IS NULL OR NOT list_contains(gone, z[2])), lambda z: z[1]), ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that repeat a 20-word window found earlier, and what is left."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), digest=True).drop("removed")


@_query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of a power of two of tokens, 2048 at most."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@_query("op5_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives in the shared folder and read back."""
    path = shared_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: matches of the fixed patterns, and strings that look random."""
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex")],
                        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("all")).alias("spans"))


@_query("op8_nearest")
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every 50th vector among all others."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract(_table(spark, sf_dir, "pages"))


@_query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, by a model of the labelled documents outside fold 0."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.remainder(F.col("doc_id")) == 0, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), quality.score(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@_query("op11_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM w, range(1, 6) AS s(k), unnest(generate_series(1, len(w) - k + 1)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS part FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT f.lang, f.phrase, f.a, j, h.a AS l, e.a AS r, t.n, ((1000::HUGEINT * f.a * t.n) // (h.a::HUGEINT * e.a))::BIGINT AS score
      FROM f CROSS JOIN range(1, 5) AS s(j) JOIN t ON t.lang = f.lang
      JOIN f AS h ON h.lang = f.lang AND h.phrase = array_to_string(f.part[1:j], ' ')
      JOIN f AS e ON e.lang = f.lang AND e.phrase = array_to_string(f.part[j + 1:], ' ')
      WHERE j < f.k),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
x AS (SELECT lang, array_to_string(part[i:i + m - 1], ' ') AS phrase, max(a) AS within
      FROM f, range(2, 5) AS s(m), unnest(generate_series(1, k - m + 1)) AS u(i) WHERE m < k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN x USING (lang, phrase) WHERE within IS NULL OR within < a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose words attract each other most."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@_query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four leading components, whitened."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw documents to packed sequences."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
