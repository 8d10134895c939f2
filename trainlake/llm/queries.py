"""The operators as queries over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.llm import chat, contamination, exact_dedup, fingerprints, html, language, licenses, negatives, ngram_join, packing, pieces, token_blocks, whitening
from trainlake.llm.common import prepared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under its name, with its SQL if it has any."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
    WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
        FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (shingle) GROUP BY 1, 2),
    links AS (
        SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
    ),
    reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(min(y), doc_id) AS component_id
    FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN reached ON x = doc_id GROUP BY doc_id
""")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summarise(table(spark, sf_dir, "documents"))


@query()
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_sensitivity(table(spark, sf_dir, "documents"))


@query()
def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.round_trip(table(spark, sf_dir, "documents"))


WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def sql_words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def template_rows() -> str:
    """The templates as SQL rows: label, words, distinct words needed, distinct words, base or not."""
    rows = [f"('{t.label}', {sql_words(t.words)}, {licenses.needed(t)}, {len(set(t.words))}, {t.base})" for t in licenses.TEMPLATES]
    return ", ".join(rows)


@query(f"""
    WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
    templates AS (SELECT * FROM (VALUES {template_rows()}) AS t(label, words, needed, n_distinct, base)),
    blocks AS (
        SELECT doc_id, label, base, n_distinct, needed, i, w[i : i + len(words) - 1] AS block, words
        FROM docs, templates, unnest(range(1, len(w) + 1)) AS t(i)
        WHERE list_contains(words, w[i])
    ),
    found AS (
        SELECT doc_id, label, base, i - 1 AS place, len(list_distinct(list_intersect(block, words))) / CAST(n_distinct AS DOUBLE) AS share
        FROM blocks
        WHERE CASE WHEN base THEN block = words ELSE len(list_distinct(list_intersect(block, words))) >= needed END
    ),
    scored AS (
        SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
               string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
               CASE WHEN count(*) FILTER (base) > 0 THEN 1.0 ELSE max(share) END AS score
        FROM found GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM docs LEFT JOIN scored USING (doc_id)
""")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@query(f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}'
        UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('{chat.START}{chat.SEP}{chat.END}') + length(role) + length(text)
               + length(regexp_replace(role || text, '[^\\\\|]', '', 'g'))) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id
""")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{CONTROL_TEXT}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{CONTROL_TEXT}'")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = chat.format_chats(given.unionByName(own), chat.text_part(F.col("text")))
    return chat.digests(chats)


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query(f"""
    WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
    items AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    windows AS (
        SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
        FROM items, unnest(range(1, len(w) - size + 2)) AS t(s)
    ),
    places AS (
        SELECT doc_id, size, q, array_to_string(w[q : q + size - 1], ' ') AS phrase
        FROM docs, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS t(q)
    ),
    met AS (SELECT doc_id, q, size, item_id FROM places JOIN windows USING (size, phrase)),
    hit AS (SELECT doc_id, count(DISTINCT spot) AS n FROM met, unnest(range(q, q + size)) AS t(spot) GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id
    )
    SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination.digest_items(found)


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("""
    WITH vectors AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ),
    scores AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
        FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ),
    positives AS (
        SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
    )
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
           other AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
        AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, anchors=F.col("vec_id") % 100 == 0, label=label)
