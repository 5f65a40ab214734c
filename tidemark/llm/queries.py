"""Registered queries of the operators on training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import huffman, mil_quality, quality_rules, resharding, warc
from tidemark.llm.filter_audit import filter_audit
from tidemark.llm.katz import katz_scores
from tidemark.llm.ngram_join import ngram_jaccard_components
from tidemark.llm.packing import pack_documents
from tidemark.llm.sentencepiece_scan import sentencepiece_digests
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.store import table, work_dir
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.topk import top_k

# The words of every text.
WORD = r"[^\x20\x09-\x0D]+"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality_rules.fit_rules(docs, quality_rules.quality_labels(labels))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.apply_rules(docs.select("doc_id", "text"), rules).select(
        "row.doc_id", *(f"stats.{c}" for c in counts), "base_failed", "kept", "rule"
    )


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"), texts=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_jaccard_components(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-ids")
    manifest = huffman.write_token_ids(table(spark, sf_dir, "documents"), folder)
    return huffman.read_token_ids(manifest, folder)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = mil_quality.fit(docs, mil_quality.quality_labels(labels))
    return mil_quality.score_quality(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        mil_quality.held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= mil_quality.THRESHOLD).cast("int").alias("predicted"),
        "n_passages",
        "top_attention",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(manifest, folder).drop("url")


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = resharding.old_shard_by_text()
    plan = resharding.plan_shards(docs, old)
    rows = resharding.rewrite(docs, plan, old, work_dir(spark, "shards"), untouched=True)
    return rows.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit(resharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_topk_search": op2_topk_search,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_packing": op5_packing,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_files": op7_token_files,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_resharding": op10_resharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_katz_scores": op13_katz_scores,
}

ORACLES: dict[str, str] = {
    "op2_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op3_substring_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS g FROM p),
        m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
        r AS (SELECT g.doc_id, g.i FROM g JOIN m USING (g) WHERE g.doc_id > m.first),
        x AS (SELECT doc_id, list(DISTINCT i + o) AS gone FROM r, range(13) AS t(o) GROUP BY doc_id),
        k AS (
            SELECT d.doc_id, d.w, coalesce(x.gone, []) AS gone FROM d LEFT JOIN x USING (doc_id)
        ),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
        gone AS (SELECT doc_id, unnest(gone) AS i FROM x),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
            FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT k.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM k LEFT JOIN kept USING (doc_id)
    """,
    "op6_ngram_join": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS w
            FROM documents
        ),
        p AS (
            SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0
        ),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
            FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ),
        l AS (
            SELECT x, y FROM c JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
            WHERE 100 * common >= 80 * (nx.n + ny.n - common)
        ),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, seen) AS (
            SELECT x, x FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen
        ),
        m AS (SELECT doc_id, min(seen) AS seen FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
               least(d.doc_id, coalesce(m.seen, d.doc_id)) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op11_filter_audit": f"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
        ),
        f AS (
            SELECT doc_id, part,
                   (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER
                   + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INTEGER
                   + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
                   + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS bits
            FROM d
        ),
        l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
        c AS (
            SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
            FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits
        ),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
        o AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs
            FROM x AS p, x AS q, x AS r, x AS s, x AS t
            WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5
        ),
        steps AS (
            SELECT filter_order, step::INTEGER AS step, bs[step] AS bit, coalesce(list_sum(bs[1 : step - 1]), 0)::INTEGER AS before
            FROM o, range(1, 6) AS r(step)
        ),
        e AS (SELECT *, (bits & bit) <> 0 AS fails, (bits & before) <> 0 AS earlier FROM c, steps)
        SELECT part, filter_order, step,
               coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost,
               coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost,
               coalesce(sum(n * (120 // greatest(bit_count(bits), 1))) FILTER (fails), 0)::BIGINT AS shapley
        FROM e GROUP BY part, filter_order, step
    """,
    "op12_spelling_variants": """
        WITH RECURSIVE crc AS (
            SELECT list(c ORDER BY b) AS t FROM (
                SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) AS r(b)
            )
        ),
        d AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
            FROM documents
        ),
        u AS (
            SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM d WHERE length(run) >= 5 GROUP BY doc_id, run
        ),
        h AS (
            SELECT doc_id, run, n, coalesce(xor(4294967295, list_reduce(
                [4294967295] || list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))), 1) AS h
            FROM u, crc
        ),
        r AS (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                   ELSE run END AS word, n FROM h
        ),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        v AS (SELECT word, n, i, left(word, i) || '_' || substr(word, i + 2) AS gap, left(word, i) || substr(word, i + 2) AS less
              FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
        p AS (
            SELECT a.word, b.word AS near FROM v AS a JOIN v AS b ON a.gap = b.gap AND a.word <> b.word
            UNION SELECT a.word, b.word FROM v AS a JOIN w AS b ON a.less = b.word
            UNION SELECT b.word, a.word FROM v AS a JOIN w AS b ON a.less = b.word
        ),
        m AS (
            SELECT p.word, count(*) AS n_near, first(p.near ORDER BY b.n DESC, hex(encode(p.near))) AS near,
                   max(b.n) AS near_n FROM p JOIN w AS b ON b.word = p.near GROUP BY p.word
        ),
        f AS (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
                   CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
            FROM w LEFT JOIN m USING (word)
        ),
        e(word, root, n) AS (
            SELECT word, word, n FROM f UNION ALL SELECT e.word, f.form, f.form_n FROM e JOIN f ON f.word = e.root WHERE f.form IS NOT NULL
        ),
        g AS (SELECT word, last(root ORDER BY n) AS root FROM e GROUP BY word)
        SELECT f.word, form, root, f.n, n_near, form_n FROM f JOIN g USING (word)
    """,
}
