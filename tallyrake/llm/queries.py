"""Thin registered queries ``opN_<name>``: each applies one operator, with production
parameters, to its whole table and derives the result columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at 85 % of 5-word shingles."""
    from .near_dedup import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of near equal bytes by sampled splitters."""
    from .sharding import shard_by_bytes
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written to frame files and read back from them."""
    import public_tokenizers

    from tallyrake.session import scratch_path

    from .token_files import document_starts, write_token_files
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return document_starts(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by error-correcting output codes."""
    from .language import languages
    return languages(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "ambiguous")


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows seen in an earlier document, removed."""
    from .window_dedup import dedup_windows
    out = dedup_windows(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, substitutions tolerated."""
    from .decontam import contaminated
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_equal", "n_compared")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import extract
    return extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the distinct-word table and decoded again."""
    import public_tokenizers

    from .bpe import round_trip
    out = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every 50th vector."""
    from .maxscore import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200-byte strings that start at two places, removed at both."""
    from .suffix_dedup import dedup_bytes
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or link-graph verdict of every page's url."""
    from .url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of every language."""
    from .phrases import collocations
    return collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened along the first 8 principal directions."""
    from .whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened", "explained", "identity_error")


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_sharding, op3_token_files, op4_language, op5_window_dedup, op6_decontaminate, op7_html_text,
    op8_bpe, op9_maxscore, op10_suffix_dedup, op11_url_filter, op12_phrases,
    op13_whitening)}

#: The others can't be said in SQL, or not at whole-table cost: see tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op9_maxscore": """
        WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM t q JOIN t c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_window_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
                   FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
        k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM p),
        f AS (SELECT g, min(doc_id) AS low FROM k GROUP BY g HAVING min(doc_id) < max(doc_id)),
        h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN f USING (g) WHERE doc_id > low),
        gone AS (SELECT doc_id, list(j) AS js FROM h GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN ws ELSE
                   list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(js, i)), lambda i: ws[i]) END, ' '), '')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)""",
    "op11_url_filter": r"""
        WITH RECURSIVE rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                                     ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        u AS (SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        x AS (SELECT host AS src, unnest(regexp_extract_all(html,
                  '(?is)<a(?:rea)?\s[^<>]*?href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s<>]*)', 1)) AS raw FROM u),
        y AS (SELECT src, regexp_extract(raw, '(?s)//([^/?#]*)', 1) AS dst0, regexp_extract(raw, '(?s)//[^/?#]*([^?#]*)', 1) AS path FROM x),
        z AS (SELECT src, translate(dst0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, path, false AS own FROM y
              UNION ALL SELECT host, host, path, true FROM u),
        d AS (SELECT DISTINCT dst AS host, path FROM z),
        f AS (SELECT host, path, arg_max(action, length(h || p)) AS action, arg_max(h || p, length(h || p)) AS rule
              FROM d JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
        s AS (SELECT z.dst AS host, count(*) AS n, sum(CASE WHEN action = 'allow' THEN 1 ELSE 0 END) AS a,
                     sum(CASE WHEN action = 'block' THEN 1 ELSE 0 END) AS b
              FROM z LEFT JOIN f ON f.host = z.dst AND f.path = z.path WHERE z.dst <> '' GROUP BY z.dst),
        e AS (SELECT src, dst, count(*) AS n FROM z WHERE NOT own AND src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
        o AS (SELECT src, sum(n) AS total FROM e GROUP BY src),
        flow AS (SELECT 'trust' AS kind, e.src AS host, e.dst AS target, n / total AS share FROM e JOIN o ON o.src = e.src
                 UNION ALL SELECT 'distrust', e.dst, e.src, n / total FROM e JOIN o ON o.src = e.src),
        m(k, kind, host, mass) AS (
            SELECT 0, 'trust', host, CAST(1 AS DOUBLE) FROM s WHERE a >= 0.9 * n
            UNION ALL SELECT 0, 'distrust', host, CAST(1 AS DOUBLE) FROM s WHERE b >= 0.9 * n
            UNION ALL
            SELECT m.k + 1, m.kind, flow.target, sum(0.85 * m.mass * flow.share)
            FROM m JOIN flow ON flow.kind = m.kind AND flow.host = m.host WHERE m.k < 29 GROUP BY m.k, m.kind, flow.target),
        t AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS trust,
                     sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS distrust FROM m GROUP BY host)
        SELECT u.page_id, u.host, u.path, f.rule,
               coalesce(f.action, CASE WHEN t.distrust >= 0.25 AND t.distrust > t.trust THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN f ON f.host = u.host AND f.path = u.path LEFT JOIN t ON t.host = u.host""",
    "op12_phrases": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
              FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
                    FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m)),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase),
        n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10),
        k AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:m], ' ') AS p2
              FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
        s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.a AS l, y.a AS r,
                     CAST((CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
              FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.p1 AND x.m = k.k
                     JOIN f y ON y.lang = k.lang AND y.phrase = k.p2 AND y.m = k.m - k.k),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
        d AS (SELECT lang, part, max(a) AS longer
              FROM (SELECT lang, a, p2 AS part FROM k WHERE m = 3 AND k = 1
                    UNION ALL SELECT lang, a, p1 FROM k WHERE m = 3 AND k = 2) GROUP BY lang, part),
        o AS (SELECT b.*, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS INTEGER) AS rank
              FROM b LEFT JOIN d ON d.lang = b.lang AND d.part = b.phrase AND b.m = 2
              WHERE d.longer IS NULL OR 100 * d.longer < 50 * b.a)
        SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000""",
}
