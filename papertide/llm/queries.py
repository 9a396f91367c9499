"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.substring_dedup import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents")).drop("kept_text", "rid")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.bpe import encode_decode

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.jaccard_join import similar

    return similar(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.quality_rules import verdicts

    return verdicts(table(spark, sf_dir, "documents")).drop("rid", "common_lines")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_md5", "items", "spans")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("found")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.token_files import read_files, write_files

    documents = table(spark, sf_dir, "documents")
    return read_files(write_files(documents, public_tokenizers.path("byte_bpe_50k.json"), added=True), documents.schema["doc_id"].dataType.simpleString())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.warc import archive_pages, read_pages

    pages = table(spark, sf_dir, "pages")
    return read_pages(spark, archive_pages(pages), pages.schema["page_id"].dataType.simpleString())


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.preference import conversations_of, format_pairs, reply_pairs

    found = format_pairs(reply_pairs(conversations_of(table(spark, sf_dir, "conversations"))), id_col="conv_id")
    shown = {c: F.array_join(F.transform(c, lambda x: F.concat(x.start.cast("string"), F.lit(":"), x.stop.cast("string"))), ",") for c in ("chosen_mask", "rejected_mask")}
    return found.withColumns(shown)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papertide.llm.lm_score import score

    return score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_lm_score": op6_lm_score,
    "op7_token_files": op7_token_files,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_preference": op10_preference,
}
_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _licence_sql() -> str:
    """The scan's definition over the same templates."""
    from papertide.llm.license_scan import BASE, FURTHER

    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.share}, {quoted(t.words)}, {t.key_at}, {quoted(t.key_words)})" for i, t in enumerate(BASE + FURTHER))
    return f"""
        WITH t(tid, label, base, share, words, key_at, key) AS (VALUES {templates}),
        tw AS (SELECT tid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM t),
        d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
        dw AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
        df AS (SELECT word, count(DISTINCT r) AS df FROM dw WHERE word IN (SELECT word FROM tw) GROUP BY word),
        v AS (SELECT tid, word, min(place) AS first, count(*) AS n, any_value(1 + ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1))) AS idf FROM tw LEFT JOIN df USING (word) GROUP BY tid, word),
        c AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY idf DESC, first) AS k FROM v),
        x AS (SELECT tid, word, idf / sum(idf * n) OVER (PARTITION BY tid) AS weight FROM c WHERE k <= 4),
        s AS (SELECT r, tid, pos - place AS start, sum(weight) AS votes FROM dw JOIN x USING (word) JOIN tw USING (tid, word) GROUP BY r, tid, pos - place),
        b AS (SELECT r, tid, max(votes) AS best FROM s GROUP BY r, tid),
        f AS (SELECT s.r, tid, label, base, start FROM s JOIN t USING (tid) JOIN d ON d.r = s.r WHERE votes >= share - 1e-9 AND start + key_at >= 0 AND list_slice(w, start + key_at + 1, start + key_at + len(key)) = key),
        p AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                     coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY r),
        m AS (SELECT r, round(max(least(0.99, best)), 6) AS best FROM b GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN labels IS NOT NULL THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
        FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)
    """


ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": _licence_sql(),
    "op1_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d),
        k AS (SELECT r, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS k FROM s),
        c AS (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM k),
        hit AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM c WHERE n > 1),
        each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN hit USING (r, p) GROUP BY r),
        n AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
    """,
    "op4_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        k AS (SELECT r, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda s: list_slice(w, s, s + 4)) END) AS k FROM d WHERE len(w) > 0),
        e AS (SELECT DISTINCT r, md5(CAST(len(k) AS VARCHAR) || ' ' || array_to_string(k, ' ')) AS k FROM k),
        n AS (SELECT r, count(*) AS n FROM e GROUP BY r),
        pair AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM e a JOIN e b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r),
        link AS (SELECT x, y FROM pair JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
        reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, link.y FROM reach JOIN link ON link.x = reach.t),
        c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r),
        m AS (SELECT x AS r, count(*) AS n_links FROM link GROUP BY x)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN m USING (r)
    """,
    "op5_decontaminate": f"""
        WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
        iw AS (SELECT item, unnest(CASE WHEN len(w) < 8 THEN [w] ELSE list_transform(range(1, len(w) - 6), lambda s: list_slice(w, s, s + 7)) END) AS k FROM i WHERE len(w) > 0),
        items AS (SELECT DISTINCT item, len(k) AS n, md5(array_to_string(k, ' ')) AS k FROM iw),
        d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
        s AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM items)),
        h AS (SELECT r, s, n, item FROM (SELECT r, s, n, md5(array_to_string(list_slice(w, s, s + n - 1), ' ')) AS k FROM s) JOIN items USING (n, k)),
        p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
        m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)
    """,
    "op9_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        g AS (SELECT r, s, count(*) OVER (PARTITION BY r, k) AS n FROM (SELECT r, s, array_to_string(list_slice(w, s, s + 2), ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM d))),
        rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([s, s + 1, s + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
        l AS (SELECT r, source, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS lw FROM (SELECT r, source, text, unnest(lines) AS line FROM d)),
        m AS (SELECT *, array_to_string(lw, ' ') AS norm FROM l WHERE len(lw) > 0),
        dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM m GROUP BY r),
        host AS (SELECT coalesce(source, chr(1)) AS h, count(DISTINCT text) AS docs FROM d GROUP BY 1),
        above AS (SELECT coalesce(source, chr(1)) AS h, norm, count(DISTINCT text) AS n FROM m GROUP BY 1, 2 HAVING count(DISTINCT text) >= 20),
        lost AS (SELECT r, sum(len(lw)) AS n FROM m JOIN above ON coalesce(m.source, chr(1)) = above.h AND m.norm = above.norm JOIN host ON host.h = above.h WHERE above.n > 0.01 * docs GROUP BY r),
        f AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_common_words
            FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT *, NOT base_failed AND n_common_words <= 0.5 * n_words AS kept FROM b
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        q AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS chief FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND chief <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND chief <> page_id THEN chief END AS refers_to
        FROM r
    """,
    "op10_preference": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
            FROM conversations),
        l AS (SELECT conv_id, max(k) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id),
        u AS (SELECT t.*, l.last, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS shown FROM t JOIN l USING (conv_id) WHERE k <= last),
        c AS (
            SELECT conv_id, max(last) AS last, coalesce(string_agg(shown, '' ORDER BY k) FILTER (k < last), '') AS before, max(shown) FILTER (k = last) AS chosen, max(text) FILTER (k = last) AS reply,
                   coalesce(max_by(text, k) FILTER (k < last AND role = 'assistant'), min_by(text, k) FILTER (k < last AND role = 'user'), '') AS stale
            FROM u GROUP BY conv_id),
        d AS (SELECT *, reply = stale AS same, '<|assistant|>' || chr(10) || replace(stale, '<|', '< |') || '<|end|>' || chr(10) AS rejected FROM c)
        SELECT conv_id, CAST(CASE WHEN same THEN last ELSE last - 1 END AS BIGINT) AS n_prompt_turns, CASE WHEN same THEN before || chosen ELSE before END AS prompt,
               CASE WHEN same THEN '' ELSE chosen END AS chosen, CASE WHEN same THEN '' ELSE rejected END AS rejected,
               CASE WHEN same THEN '' ELSE '14:' || CAST(length(chosen) - 1 AS VARCHAR) END AS chosen_mask,
               CASE WHEN same THEN '' ELSE '14:' || CAST(length(rejected) - 1 AS VARCHAR) END AS rejected_mask
        FROM d
    """,
}
