"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideshare.llm.bpe import round_trip
from tideshare.llm.collocations import collocations
from tideshare.llm.common import table
from tideshare.llm.ctw import score_texts
from tideshare.llm.decontamination import contamination
from tideshare.llm.exact_dedup import exact_dedup
from tideshare.llm.simhash import near_duplicates
from tideshare.llm.substring_dedup import substring_dedup
from tideshare.llm.suffix_dedup import suffix_dedup
from tideshare.llm.token_counts import token_counts
from tideshare.llm.token_store import read_documents, write_store
from tideshare.llm.toxicity import toxicity
from tideshare.llm.url_filter import url_filter
from tideshare.llm.whitening import whitening

#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf, "documents"), length=100)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), shingle=3, distance=3)


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = substring_dedup(table(spark, sf, "documents"), size=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents"))


def op8_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"))


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter(table(spark, sf, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_token_store(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    store = write_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(store, docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"), sizes=range(2, 4), at_least=10, top=2000, absorbed_percent=50)


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening(table(spark, sf, "embeddings"), count=4)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_simhash, op3_substring_dedup, op4_bpe_round_trip, op5_decontamination, op6_toxicity, op7_exact_dedup, op8_lm_score, op9_url_filter, op10_token_counts, op11_token_store, op12_collocations, op13_whitening)}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), word AS (
            SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM d
        ), spot AS (
            SELECT doc_id, j AS i, string_agg(w, ' ') OVER run AS win, count(*) OVER run AS n
            FROM word WINDOW run AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
        ), again AS (
            SELECT doc_id, i FROM spot WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM again
        ), kept AS (
            SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS words, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(words, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark WHERE item_id IS NOT NULL
        ), sized AS (
            SELECT item_id, ws, least(13, len(ws)) AS size FROM b WHERE len(ws) > 0
        ), phrase AS (
            SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w
            FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM sized)
        ), place AS (
            SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM phrase) WHERE len(ws) >= size
        ), hit AS (
            SELECT doc_id, i, size, item_id FROM (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM place) JOIN phrase USING (size, w)
        ), words AS (
            SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_exact_dedup": rf"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm, length(coalesce(text, '')) AS n
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op9_url_filter": r"""
        WITH p AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), r(rh, rp, v) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                   ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), hit AS (
            SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
            FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
            GROUP BY page_id
        )
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)""",
    "op12_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
        ), total AS (
            SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
        ), g AS (
            SELECT lang, k AS size, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
            FROM w, (VALUES (1), (2), (3)) AS sizes(k)
        ), f AS (
            SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL
        ), c AS (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2 AND f >= 10
        ), longer AS (
            SELECT lang, part, max(a) AS a
            FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM c WHERE size = 3)
            GROUP BY lang, part
        ), kept AS (
            SELECT c.* FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.phrase = longer.part
            WHERE longer.a IS NULL OR 100 * longer.a < 50 * c.a
        ), cut AS (
            SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:size], ' ') AS p2
            FROM kept, (VALUES (1), (2)) AS cuts(k) WHERE k < size
        ), scored AS (
            SELECT cut.lang, cut.phrase, a, k, f1.f AS l, f2.f AS r,
                   CAST(1000000::HUGEINT * a * a // (f1.f::HUGEINT * f2.f) AS BIGINT) AS score
            FROM cut JOIN f f1 ON f1.lang = cut.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = cut.lang AND f2.phrase = p2
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
