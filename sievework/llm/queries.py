"""The registered queries of this folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.alignment import token_alignment
from sievework.llm.class_lm import scored
from sievework.llm.jaccard_join import jaccard_components
from sievework.llm.language import identified
from sievework.llm.lexical_search import lexical_search
from sievework.llm.mixing import mix
from sievework.llm.packing import pack
from sievework.llm.quality import BASE, judged
from sievework.llm.secret_scan import (
    ACCESS, ASSIGN, ASSIGN_LEAST, CANDIDATE, HEX, SecretSettings, secret_spans, term, with_digests,
)
from sievework.llm.sharding import shard
from sievework.llm.token_counts import token_counts
from sievework.llm.toxicity import toxicity
from sievework.llm.vector_search import top_k


# The vocabulary files the token queries are for; any path can be given.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", *[f"_quality.{name}" for name in (*BASE, "base_failed", "kept")])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), VOCABULARY)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identified(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    names = ("held_out", "lang_pred", "score", "ambiguous")
    return rows.select("doc_id", *[f"_language.{name}" for name in names])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), VOCABULARY)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(documents(spark, sf_dir), VOCABULARY, PIECES)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(secret_spans(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_class_lm": op3_class_lm,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_top_k": op7_top_k,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_secret_scan": op13_secret_scan,
}

# Lower case of A-Z only, and words, as DuckDB has them.
LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD_LIST = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
TERM_LIST = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"



def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_sql(settings: SecretSettings = SecretSettings()) -> str:
    """The secret scan in SQL. Matches are placed by marks around them; each window
    of a candidate is counted anew."""
    cuts = " UNION ALL ".join(
        f"SELECT rid, {quoted(kind)} AS kind, {place} AS place, string_split(regexp_replace(t, "
        f"{quoted(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM texts"
        for place, (kind, pattern) in enumerate(
            (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidate", CANDIDATE))
        )
    )
    allowed = " OR ".join(f"regexp_matches(value, {quoted(p)})" for p in settings.allowed)

    def by_class(of) -> str:
        whens = " ".join(f"WHEN regexp_matches(body, {quoted(c.pattern)}) THEN {of(c)}" for c in settings.classes)
        return f"CASE {whens} END"

    terms = ", ".join(str(term(n)) for n in range(1, max(c.window for c in settings.classes) + 1))
    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS rid, doc_id,
                replace(replace(coalesce(text, ''), chr(1), chr(3)), chr(2), chr(3)) AS t FROM documents),
        cuts AS ({cuts}),
        placed AS (
            SELECT rid, kind, place, split_part(p[i], chr(2), 1) AS value,
                list_sum(list_transform(p[1:i - 1], lambda x: length(x))) - (i - 2) AS start
            FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM cuts)),
        spans AS (SELECT *, start + length(value) AS stop FROM placed),
        base AS (
            SELECT * FROM spans WHERE place < 3 AND (kind <> 'assign'
                OR length(regexp_extract(value, {quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST})),
        candidates AS (
            SELECT row_number() OVER () AS cid, rid, start, rtrim(value, '=') AS body FROM spans c
            WHERE place = 3 AND NOT ({allowed}) AND NOT EXISTS (
                SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start <= c.start AND b.stop >= c.stop)),
        classed AS (
            SELECT *, {by_class(lambda c: c.window)} AS width, {by_class(lambda c: c.most)} AS most,
                {by_class(lambda c: "lower(body)" if c.name == "hex" else "body")} AS signs FROM candidates),
        windows AS (
            SELECT cid, rid, start, width, most, i, string_split(signs[i + 1:i + width], '') AS w
            FROM (SELECT *, unnest(range(0, length(body) - width + 1)) AS i FROM classed)),
        hot AS (
            SELECT cid, rid, start + i AS start, start + i + width AS stop FROM windows
            WHERE list_sum(list_transform(map_values(list_histogram(w)), lambda n: [{terms}][n::BIGINT])) <= most),
        runs AS (
            SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY cid ORDER BY start) AS run
            FROM (SELECT *, lag(stop) OVER (PARTITION BY cid ORDER BY start) AS before FROM hot)),
        entropy AS (
            SELECT rid, 'entropy' AS kind, 3 AS place, min(start) AS start, max(stop) AS stop
            FROM runs GROUP BY rid, cid, run),
        kept AS (
            SELECT rid, kind, place, start, stop FROM base UNION ALL
            SELECT * FROM entropy e WHERE NOT EXISTS (
                SELECT 1 FROM base b WHERE b.rid = e.rid AND b.start < e.stop AND b.stop > e.start)),
        joined AS (
            SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                count(*) FILTER (kind = 'hex') AS n_hex,
                string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place, stop) FILTER (place < 3) AS base,
                string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place, stop) AS spans
            FROM kept GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
            coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM texts LEFT JOIN joined USING (rid)"""


ORACLES: dict[str, str] = {
    "op13_secret_scan": secret_sql(),
    "op1_quality_rules": f"""
        WITH worded AS (
            SELECT doc_id, coalesce(text, '') AS t, {WORD_LIST.format("coalesce(text, '')")} AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM documents),
        windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM (
                SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS gram FROM (
                    SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded))),
        repeated AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(3) r(k) WHERE times > 1 GROUP BY 1),
        figures AS (
            SELECT doc_id, t, w, lines, len(w) AS n_words,
                length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                coalesce(n, 0) AS n_repeat_words
            FROM worded LEFT JOIN repeated USING (doc_id)),
        judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                OR 2 * n_dup_lines > len(lines)
                OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < n_words
                OR 10 * (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))
                    > 7 * (length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')))
                OR 20 * len(list_distinct(w)) < n_words AS rejected
            FROM figures)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
            n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
            n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
        FROM judged""",
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op11_lexical_search": f"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, {TERM_LIST.format(LOWER_AZ)} AS terms FROM documents),
        sizes AS (
            SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
        tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, sizes GROUP BY term, n_docs),
        asked AS (SELECT DISTINCT item_id, unnest({TERM_LIST.format(LOWER_AZ)}) AS term FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, rid, sum(w * ((1000000000 * tf)
                // (1000 * tf + 8 * (100 - 90 + (90 * len(terms) * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (rid), sizes GROUP BY ALL),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, {WORD_LIST.format(LOWER_AZ)} AS w FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM worded),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (gram) GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
            WHERE 100 * c >= 80 * (a.n + b.n - c)),
        reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM sizes
            UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
        SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles,
            coalesce(min(r.other), d.doc_id) AS component_id
        FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reached r USING (doc_id)
        GROUP BY d.doc_id""",
}
