"""Queries and SQL of this subpackage for the driver's entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import byte_bpe, decontaminate, hamming, katz, language_id, main_text, near_dup, token_counts, token_store, toxicity
from kerbline.runtime import scratch, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), target)
    return token_store.read_digests(spark, target)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(_table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = katz.katz_scores(_table(spark, sf_dir, "documents"))
    # Sums of doubles differ in their last digits with the order of addition.
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_store, op2_language_id, op3_hamming_top_k, op4_decontamination, op5_toxicity,
        op6_main_text, op7_near_duplicates, op8_byte_bpe, op9_token_counts, op10_katz,
    )
}

_CODE = "list_reduce(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END), lambda a, b: a | b)"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a text in lower case, and the crc32 of the decimal id, bit by bit.
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+')"
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT + 1, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: CASE WHEN xor(a, greatest(b - 1, 0)) % 2 = 1 THEN xor(xor(a, greatest(b - 1, 0)) >> 1, 3988292384) ELSE xor(a, greatest(b - 1, 0)) >> 1 END), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op3_hamming_top_k": f"""
        WITH coded AS (SELECT vec_id, {_CODE} AS code FROM embeddings),
        pairs AS (
            SELECT q.vec_id AS query_id, a.vec_id AS neighbour_id, bit_count(xor(q.code, a.code))::BIGINT AS distance
            FROM coded q JOIN coded a ON q.vec_id <> a.vec_id WHERE q.vec_id % 20 = 0
        ),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank, neighbour_id, distance FROM pairs)
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op7_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i::INT] || ' ' || ws[i::INT + 1]) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        near AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total FROM n a JOIN n b ON a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS MATERIALIZED (SELECT a, b FROM near JOIN shared USING (a, b) WHERE 100 * c >= 80 * (total - c)),
        both_ AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(node, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.top FROM reach r JOIN both_ e ON e.a = r.node AND r.top < e.b),
        comp AS (SELECT node, min(top) AS top FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, top AS component_id, doc_id = top AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON node = doc_id
    """,
    "op10_katz": f"""
        WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held, list_append({_WORDS}, ' end') AS ws FROM documents),
        t AS (SELECT doc_id, held, unnest(ws) AS w, unnest(list_prepend(' start', ws[:-2])) AS v FROM d),
        uni AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY 1),
        tot AS MATERIALIZED (SELECT sum(c) AS n, count(*) AS k, (sum(c) + count(*) + 1)::DOUBLE AS z FROM uni),
        bi AS MATERIALIZED (SELECT v, w, count(*) AS c FROM t WHERE NOT held GROUP BY 1, 2),
        r AS (SELECT count(*) FILTER (c = 1) AS n1, list_transform(range(1, 7), lambda i: 0) AS z, [count(*) FILTER (c = 1), count(*) FILTER (c = 2), count(*) FILTER (c = 3), count(*) FILTER (c = 4), count(*) FILTER (c = 5), count(*) FILTER (c = 6)] AS m FROM bi),
        raw AS (SELECT list_transform(range(1, 6), lambda i: CASE WHEN m[i::INT] > 0 AND 6 * m[6] / m[1] < 1 THEN ((i + 1) * m[i::INT + 1] / (i * m[i::INT]) - 6 * m[6] / m[1]) / (1 - 6 * m[6] / m[1]) ELSE 0 END) AS x FROM r),
        disc AS MATERIALIZED (SELECT list_transform(range(1, 6), lambda i: CASE WHEN x[i::INT] > 0 AND x[i::INT] < 1 THEN x[i::INT] ELSE (i - 0.5) / i END::DOUBLE) AS y FROM raw),
        kept AS MATERIALIZED (SELECT bi.v, bi.w, bi.c, CASE WHEN bi.c <= 5 THEN bi.c * y[bi.c::INT] ELSE bi.c::DOUBLE END AS kept, (uni.c + 1) / z AS p FROM bi JOIN uni USING (w), tot, disc),
        ctx AS (SELECT v, sum(c) + (sum(c) FILTER (c > 5) IS NOT DISTINCT FROM sum(c) OR sum(c) >= 1000)::INT AS whole, sum(kept) AS mass, sum(p) AS seen FROM kept GROUP BY 1),
        scored AS (SELECT t.doc_id, t.held, coalesce(uni.c, 0) AS c, (coalesce(uni.c, 0) + 1) / z AS base,
            CASE WHEN kept.c IS NOT NULL THEN kept.kept / whole WHEN whole IS NOT NULL THEN (1 - mass / whole) / (1 - seen) * (coalesce(uni.c, 0) + 1) / z ELSE (coalesce(uni.c, 0) + 1) / z END AS p
          FROM t CROSS JOIN tot LEFT JOIN uni ON uni.w = t.w LEFT JOIN kept ON kept.v = t.v AND kept.w = t.w LEFT JOIN ctx ON ctx.v = t.v)
        SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, (SELECT n FROM tot)::BIGINT AS train_tokens, round(sum(log10(base)), 6) AS base_score, round(sum(log10(p)), 6) AS score FROM scored GROUP BY 1, 2
    """,
}
