"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fold, table

#: File name of the public vocabulary that the queries use; its folder is found by the installed package.
VOCABULARY = "word_bpe_49k.json"


#: The public vocabulary whose pieces the language models give probabilities to.
PIECES = "piece_bpe_32k.model"


#: The key of the pseudonyms is the session's; this one is for trying things out and protects nothing.
KEY_SETTING, TRIAL_KEY = "spark.quire.pii.key", "not-a-secret"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TRIAL_KEY)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.jaccard import join_components

    return join_components(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import labelled_sample, score_quality

    docs, part = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    known = labelled_sample(docs, table(spark, sf_dir, "labels").filter(part != 0), "quality")
    return score_quality(docs, known).select("doc_id", (part == 0).alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import archived

    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.langid import identify

    docs, part = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4)
    return identify(docs, docs.filter(part != 2), vocabulary(PIECES)).select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pii import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_pii", F.array_join("pii_kinds", ",").alias("pii_kinds"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.licences import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op1_topk": op1_topk, "op2_jaccard": op2_jaccard, "op3_bpe": op3_bpe, "op4_token_counts": op4_token_counts, "op5_mixing": op5_mixing, "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_ann": op8_ann, "op9_langid": op9_langid, "op10_pii": op10_pii, "op11_prefix_trie": op11_prefix_trie, "op12_collocations": op12_collocations, "op13_licences": op13_licences}

ORACLES: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op2_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node
        )
        SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body FROM pages
        ), d AS (
            SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first_page < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_page < d.page_id THEN f.first_page END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
    "op11_prefix_trie": """
        WITH t AS (
            SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), a AS (
            SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS at FROM t
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
        ), b AS (
            SELECT c.conv_id, a.at AS place, a.key, a.words FROM c JOIN a ON a.conv_id = c.base AND a.at <= c.h
            UNION ALL SELECT c.conv_id, 10 + a.at, a.key, a.words FROM c JOIN a ON a.conv_id = c.conv_id AND a.at > c.h
        ), r AS (
            SELECT conv_id, words, row_number() OVER w AS depth, list(key) OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS length FROM b
            WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
            UNION ALL SELECT conv_id, 0, 0, [], (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id) FROM c
        ), m AS (
            SELECT conv_id, depth, words, length, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM r
        ), n AS (
            SELECT node, depth, any_value(words) AS words, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth) AS ends FROM m GROUP BY ALL
        ), p AS (
            SELECT n.*, u.node AS parent, (SELECT count(*) FROM n k JOIN m v ON v.conv_id = k.node AND v.depth = n.depth WHERE k.depth = n.depth + 1 AND v.node = n.node) AS n_children FROM n LEFT JOIN m u ON u.conv_id = n.node AND u.depth = n.depth - 1
        ), s AS (
            SELECT v.node, v.depth, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved FROM p k JOIN m v ON v.conv_id = k.node AND v.depth <= k.depth GROUP BY ALL
        )
        SELECT p.node AS conv_id, CAST(p.depth AS BIGINT) AS depth, p.parent AS parent_conv_id, p.n_convs, p.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(p.ends, '')) AS ends_sha256
        FROM p JOIN s USING (node, depth)
    """,
    "op12_collocations": """
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
            FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
        ), g AS (
            SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM t CROSS JOIN (SELECT unnest([1, 2, 3]) AS size) WHERE len(ws) >= size
        ), f AS (
            SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL
        ), c AS (
            SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= 10
        ), k AS (
            SELECT c.*, unnest(range(1, size)) AS k FROM c
        ), s AS (
            SELECT k.lang, k.size, k.phrase, k.a, k.k, x.n AS l, y.n AS r, (CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(x.n AS HUGEINT) * y.n) AS score
            FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k.k + 1:], ' ')
        ), w AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), d AS (
            SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = w.lang AND o.size > w.size AND contains(' ' || o.phrase || ' ', ' ' || w.phrase || ' ') AND 100 * o.a >= 50 * w.a)
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d
        )
        SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(n.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
        FROM r JOIN (SELECT lang, sum(len(ws)) AS n FROM t GROUP BY lang) n ON n.lang = r.lang WHERE rank <= 2000
    """,
}
