"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import pfair_slots

    return pfair_slots(_table(spark, sf_dir, "documents"))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent_lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import removed_spans

    return removed_spans(_table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_words")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import radix_groups

    return radix_groups(_table(spark, sf_dir, "documents"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives

    return derivatives(_table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_tree import chat_trees, read_back

    probe = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(chat_trees(rows), in_order=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_topk": op3_exact_topk,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_license_scan": op5_license_scan,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_bayes": op10_quality_bayes,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_chat_prefix_tree": op13_chat_prefix_tree,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) END AS sh
            FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
        l2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS doc_id, b AS reached FROM l2 UNION SELECT r.doc_id, l2.b FROM r JOIN l2 ON l2.a = r.reached),
        m AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id
        FROM s LEFT JOIN m ON m.doc_id = s.doc_id""",
    "op8_line_dedup": r"""
        WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS parts FROM documents WHERE text IS NOT NULL),
        n AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
        u AS (
            SELECT doc_id, i, sum(length(parts[i])) OVER (PARTITION BY doc_id ORDER BY i) AS "end",
                   regexp_replace(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', '') AS word
            FROM n),
        l AS (SELECT doc_id, list(word ORDER BY i) AS words FROM u GROUP BY doc_id),
        k AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM l),
        x AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS t FROM k),
        g AS (SELECT doc_id, i, first_value(doc_id) OVER w AS first_id, first_value(i) OVER w AS first_i FROM x WINDOW w AS (PARTITION BY t ORDER BY doc_id, i)),
        r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM g WHERE doc_id <> first_id OR i - first_i >= 50),
        s AS (SELECT doc_id, i, sum(CASE WHEN i - prev <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
        e AS (SELECT doc_id, span, min(i) AS a, max(i) + 49 AS b FROM s GROUP BY doc_id, span)
        SELECT e.doc_id, CAST(ua."end" - length(ua.word) AS BIGINT) AS start, CAST(ub."end" AS BIGINT) AS "end", CAST(b - a + 1 AS BIGINT) AS n_words
        FROM e JOIN u ua ON ua.doc_id = e.doc_id AND ua.i = a JOIN u ub ON ub.doc_id = e.doc_id AND ub.i = b""",
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
               CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op11_phrase_mining": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
        g AS (
            SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM p
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM p),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
        w AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        c AS (SELECT *, unnest(range(1, k)) AS cut FROM w),
        s AS (
            SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
            FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM w WHERE k = 3),
        m AS (SELECT lang, phrase, max(a) AS a FROM i GROUP BY ALL),
        x AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.a IS NULL OR 100 * m.a < 50 * b.a),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM x)
        SELECT o.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
    "op12_importance_resampling": r"""
        WITH t AS (
            SELECT list(c ORDER BY i) AS tab
            FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
        d AS (
            SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        w AS (
            SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM d),
        u AS (SELECT side, doc_id, unnest(w) AS word FROM w),
        e AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda j: CAST('0x' || substr(hex(encode(word)), 2 * j + 1, 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT word FROM u)),
        h AS (SELECT word, xor(list_reduce(bytes, lambda c, b: xor(tab[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM e, t),
        k AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM u JOIN h USING (word) GROUP BY bucket),
        z AS (SELECT sum(s) AS s, sum(t) AS t FROM k),
        g AS (SELECT bucket, CAST(floor(1000 * ln((k.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((k.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM k, z),
        x AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM u JOIN h USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
        y AS (
            SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM documents LEFT JOIN x ON x.doc_id = documents.doc_id),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
        SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank
        FROM y LEFT JOIN r ON r.doc_id = y.doc_id""",
    "op13_chat_prefix_tree": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
            SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|turn|><|text|><|end|>') AS size FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(size) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
