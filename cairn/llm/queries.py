"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, codes, html, merkle, neardup, packing, pst, quality, secrets, substring, suffix, topk, toxicity
from cairn.llm._spark import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.apply(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.apply(docs).drop("text", "n_lost_words")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.apply(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int) -> str:
    """The codebooks' rounds, one after another."""
    out = """
        WITH k AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        ), x AS MATERIALIZED (SELECT r, i - 1 AS place, (8 * i - 1) // len(e) AS part, e[i] AS v FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS i FROM k)),
        b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, v AS c FROM x WHERE r <= 16)"""
    near = "(SELECT r, part, min(d) AS d, arg_min(entry, 16 * d + entry) AS entry FROM (SELECT r, x.part, entry, CAST(sum((v - c) * (v - c)) AS BIGINT) AS d FROM x JOIN b{0} b ON x.part = b.part AND x.place = b.place GROUP BY r, x.part, entry) GROUP BY r, part)"
    for i in range(rounds):
        out += f""",
        a{i} AS MATERIALIZED {near.format(i)},
        s{i} AS (SELECT x.part, entry, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN x ON a.r = x.r AND a.part = x.part GROUP BY x.part, entry, place),
        b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM b{i} b LEFT JOIN s{i} s ON b.part = s.part AND b.entry = s.entry AND b.place = s.place)"""
    return out + f""",
        z AS MATERIALIZED {near.format(rounds)},
        t AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
        FROM k JOIN t ON k.r = t.r"""


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.apply(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring": op2_substring,
    "op3_packing": op3_packing,
    "op4_topk": op4_topk,
    "op5_secrets": op5_secrets,
    "op6_neardup": op6_neardup,
    "op7_html": op7_html,
    "op8_suffix": op8_suffix,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_codes": op12_codes,
    "op13_lm": op13_lm,
}
ORACLE: dict[str, str] = {
    "op2_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
        f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
        x AS (SELECT h.doc_id, list(i) AS hits FROM h JOIN f ON h.k = f.k WHERE f.first < h.doc_id GROUP BY h.doc_id),
        g AS (SELECT doc_id, list_distinct(flatten(list_transform(hits, lambda i: range(i, i + 50)))) AS gone FROM x),
        t AS (SELECT d.doc_id, d.w, g.gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM t""",
    "op10_quality": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS y FROM d),
        v AS (SELECT doc_id, y, regexp_extract_all(y, '[^\x20\x09-\x0D]+') AS w FROM l),
        m AS (
            SELECT doc_id, y, len(w) AS n, len(list_distinct(w)) AS u, right(w[-1], 1) AS z, lower(y) AS low, length(regexp_replace(y, '[^#*$%&|<>]', '', 'g')) AS symbols,
                   length(regexp_replace(y, '[^!]', '', 'g')) AS shouts, length(regexp_replace(y, '[^|]', '', 'g')) AS bars FROM v WHERE len(w) > 0
        ), f AS (
            SELECT doc_id, y, n, 2 * symbols > n OR 2 * shouts > n OR (bars >= 2 AND bars * 4 >= n) OR (n >= 10 AND 10 * u < 3 * n)
                   OR (n < 4 AND NOT list_contains(['.', '!', '?', ':', ';', '"', chr(39), ')', ']', '…', '”', '’', '»', '。', '！', '？'], z))
                   OR (n <= 25 AND len(list_filter(['all rights reserved', 'click here', 'cookie policy', 'enable javascript', 'lorem ipsum', 'privacy policy', 'sign up for our',
                       'subscribe to our', 'terms of service', 'terms of use', 'use of cookies', 'use cookies'], lambda p: contains(low, p))) > 0) AS failed FROM m
        ), g AS (SELECT doc_id, count(*) - count(DISTINCT y) AS dups, coalesce(sum(n) FILTER (failed), 0) AS lost FROM f GROUP BY doc_id),
        i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
        t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM i),
        r AS (SELECT doc_id, count(DISTINCT i + k.k) AS repeats FROM t, (SELECT unnest([0, 1, 2]) AS k) k WHERE c > 1 GROUP BY doc_id),
        a AS (
            SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda s: length(s))), 0) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(dups, 0) AS n_dup_lines, coalesce(repeats, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
            FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
        ), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 2 * lost <= n_words AS kept FROM b""",
    "op8_suffix": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        o AS (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS o FROM d),
        b AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2098) AS p FROM o),
        w AS (SELECT doc_id, o, p, unnest(range(0, len(p) // 2 - 49)) AS j FROM b),
        s AS (SELECT doc_id, o + j AS i, md5(substr(p, 2 * j + 1, 100)) AS k FROM w),
        f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
        x AS (SELECT s.doc_id, s.i FROM s JOIN f ON s.k = f.k WHERE f.first < s.doc_id),
        y AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM x),
        z AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM y),
        r AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS e FROM z GROUP BY doc_id, n),
        g AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, list(a ORDER BY a) AS begins, list(e ORDER BY a) AS ends FROM r GROUP BY doc_id),
        t AS (SELECT d.doc_id, d.h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
                     list_append(coalesce(begins, []), len(h) // 2) AS begins, list_prepend(0, coalesce(ends, [])) AS ends FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
               sha256(unhex(array_to_string(list_transform(range(1, len(begins) + 1), lambda m: substr(h, 2 * ends[m] + 1, 2 * (begins[m] - ends[m]))), ''))) AS kept_sha256 FROM t""",
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_merkle": r"""
        WITH RECURSIVE b AS (
            SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS bytes
        ), c AS (
            SELECT doc_id, coalesce('1' || source, '0') AS g,
                   xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, bytes[(xor(a, x) & 255) + 1]))) % 5 = 0 AS hit,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head, text FROM documents, b
        ), l AS (
            SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(text) || ':' || CASE WHEN coalesce(hit, false) THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS x FROM c
        ), n AS (
            SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
        ), t AS (
            SELECT g, 0 AS k, i, leaf AS h, n FROM n
            UNION ALL SELECT g, k + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY g, k, i // 16
        ), s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (
            SELECT 0 AS k, i, h, n FROM s
            UNION ALL SELECT k + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY k, i // 16
        ), r AS (SELECT g, k, i // 16 AS p, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY g, k, i // 16),
        v AS (SELECT k, i // 16 AS p, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY k, i // 16),
        w AS (
            SELECT row, g, 0 AS k, i, x, '' AS proof FROM n
            UNION ALL SELECT row, w.g, w.k + 1, i // 16, sha256(array_to_string(hs[1:i % 16], '') || x || array_to_string(hs[i % 16 + 2:], '')),
                             proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], '') FROM w JOIN r ON w.g = r.g AND w.k = r.k AND i // 16 = p
        ), y AS (SELECT row, g, arg_max(x, k) AS x, arg_max(proof, k) AS proof FROM w GROUP BY row, g),
        z AS (
            SELECT row, 0 AS k, s.i, x, proof FROM y JOIN s ON y.g = s.g
            UNION ALL SELECT row, z.k + 1, i // 16, sha256(array_to_string(hs[1:i % 16], '') || x || array_to_string(hs[i % 16 + 2:], '')),
                             proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], '') FROM z JOIN v ON z.k = v.k AND i // 16 = p
        ), e AS (SELECT row, arg_max(x, k) AS x, arg_max(proof, k) AS proof FROM z GROUP BY row)
        SELECT doc_id, leaf, s.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = o.h AS verified
        FROM e JOIN (SELECT row, doc_id, leaf, g FROM n) n ON e.row = n.row JOIN s ON n.g = s.g, (SELECT h FROM u WHERE n = 1) o""",
    "op12_codes": _codes_sql(codes.ROUNDS),
}
