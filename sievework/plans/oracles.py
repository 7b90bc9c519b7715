"""The registered queries as SQL for DuckDB, written from their definitions.

RE2 has no lookaround and ASCII shorthands, so the patterns differ in form from
the ones the engine uses.
"""

from __future__ import annotations

from dataclasses import replace

from sievework import lexicons
from sievework.config import NearDupSettings
from sievework.functions.rules import LETTER_SWAPS
from sievework.functions.shingles import MIX, odd_numbers, optimal_bands
from sievework.operators.reports import FILTERS_FIRST, STAGES
from sievework.plans.catalog import (
    ARMS, BLOCKLIST, BOUNDS, EMBEDDING, FLOORS, HELD_OUT, MARKED_WORDS, META_TALK, NEAR_DUP, WHOLE_WORDS,
)

NOT_WORD = r"[^\p{L}\p{N}_]"
TWO64 = "18446744073709551616::UHUGEINT"
LOW = "4294967295::UBIGINT"


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def unescaped(x: str) -> str:
    """The entities of the pages, which may lack their semicolon, decoded twice."""
    for _ in range(2):
        for name, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
            x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def without_urls(x: str) -> str:
    return rf"regexp_replace({x}, 'https?://\S+|www\.\S+', '', 'g')"


def without_edit(x: str) -> str:
    return rf"regexp_replace({x}, '(?is)\n*\**\s*edit\s*\d*\s*:.*$', '')"


def without_strict_edit(x: str) -> str:
    """As above, where no letter comes before it."""
    note = r"edit\s*\d*\s*:.*$"
    x = rf"regexp_replace({x}, '(?is)(?:\n+\**\s*|\*+\s*|\s+){note}', '')"
    return rf"regexp_replace({x}, '(?is)(^|[^\p{{L}}\s*]){note}', '\1')"


def capped(x: str) -> str:
    for mark, pattern in (("!", "!"), ("?", r"\?"), (".", r"\."), (",", ",")):
        x = f"regexp_replace({x}, '{pattern}{{3,}}', '{mark}{mark}', 'g')"
    return x


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normalised(x: str) -> str:
    x = unescaped(f"coalesce({x}, '')")
    x = f"replace(replace({x}, chr(8203), ' '), chr(160), ' ')"
    return collapsed(capped(without_edit(without_urls(x))))


def n_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def word_start(words) -> str:
    return NOT_WORD + "(?:" + "|".join(words) + ")"


def has_word(x: str, words) -> str:
    return f"regexp_matches(' ' || lower({x}), {text_literal(word_start(words))})"


def count_words(x: str, words) -> str:
    return f"len(regexp_extract_all(' ' || lower({x}), {text_literal(word_start(words))}))"


def has_closed_word(x: str, closed, open_=()) -> str:
    """Whether a word is one of `closed` or begins with one of `open_`."""
    parts = [f"(?:{'|'.join(closed)}){NOT_WORD}", *open_]
    return f"regexp_matches(' ' || lower({x}) || ' ', {text_literal(NOT_WORD + '(?:' + '|'.join(parts) + ')')})"


def count_closed_words(x: str, words) -> str:
    """Each sign between words is doubled, so that two words do not share one."""
    doubled = f"regexp_replace(' ' || lower({x}) || ' ', '({NOT_WORD})', '\\1\\1', 'g')"
    longest = sorted((w.replace(" ", "  ") for w in words), key=len, reverse=True)
    return f"len(regexp_extract_all({doubled}, {text_literal(NOT_WORD + '(?:' + '|'.join(longest) + ')' + NOT_WORD)}))"


def in_bounds(x: str, low: int, high: int, chars: int) -> str:
    return f"({n_words(x)} BETWEEN {low} AND {high} AND length({x}) <= {chars})"


WIDE = (BOUNDS.min_words, BOUNDS.max_words, BOUNDS.max_chars)

CORPUS = """
corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_id, text, CAST(quality AS DOUBLE) AS score, source
  FROM documents LEFT JOIN labels USING (doc_id)
)"""

MESSY = r"""
messy AS (
  SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN text || ' see https://example.com/a?b=c and www.example.org now'
    WHEN 1 THEN text || E' \n\n** EDIT 2 : thanks, all\nbye'
    WHEN 2 THEN text || ' what!!!!!! really???? wait.... no,,,, ok!!'
    WHEN 3 THEN E'\t ' || text || E' \t\n tabs \r\n and   blanks '
    WHEN 4 THEN 'Tom &amp;amp; Jerry ' || text
    ELSE '[Removed] ' || text END AS text
  FROM documents
)"""

SINGLE = """
SELECT CAST(item_id AS VARCHAR) AS source_id, text, CAST(NULL AS DOUBLE) AS score,
       'benchmark' AS source
FROM benchmark"""

TWO_FIELD = """
SELECT conv_id || '-' || turn AS source_id,
       trim(trim(coalesce(title, '')) || ' ' || trim(coalesce(body, ''))) AS text,
       CAST(NULL AS DOUBLE) AS score, 'conversations' AS source
FROM (
  SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN text END AS title,
    CASE WHEN role = 'assistant' THEN text
      WHEN role = 'user' AND next_role = 'assistant' THEN next_text END AS body
  FROM (
    SELECT *, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role, lag(role) OVER w AS last_role
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  ) WHERE NOT (role = 'assistant' AND last_role IS NOT DISTINCT FROM 'user')
)"""

UNION = f"""
{CORPUS.strip()},
everything AS (SELECT * FROM corpus UNION ALL {SINGLE} UNION ALL {TWO_FIELD})"""

OFFENSIVE = "({} OR {})".format(
    has_word("text", BLOCKLIST),
    has_word("text", ["".join(LETTER_SWAPS.get(c, c) for c in w) for w in BLOCKLIST]),
)

HITS = [count_words("text", kws) for _, kws in lexicons.CONTEXT_KEYWORDS]
KEYWORD_TAG = "CASE greatest({0}) WHEN 0 THEN '' {1} END".format(
    ", ".join(f"h{i}" for i in range(len(HITS))),
    " ".join(
        f"WHEN h{i} THEN {text_literal(label)}"
        for i, (label, _) in enumerate(lexicons.CONTEXT_KEYWORDS)
    ),
)
COUNTED = ", ".join(f"{hits} AS h{i}" for i, hits in enumerate(HITS))


def keyword_tags(rows: str) -> str:
    """Columns of `rows` with `tag`, empty without a keyword."""
    return f"(SELECT *, {KEYWORD_TAG} AS tag FROM (SELECT *, {COUNTED} FROM {rows}))"


def row_reason(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '(?i)\\[(removed|deleted)\\]') OR trim({x}) = ''
      THEN 'dead_or_empty' WHEN NOT {in_bounds(x, *WIDE)} THEN 'length' END"""


def signatures(rows: str, settings: NearDupSettings) -> str:
    """CTEs up to `sig(id, p, v)`: the MinHash values of `rows(id, text)`."""
    places = odd_numbers("place", settings.shingle_size)
    perms = odd_numbers("permutation", settings.num_perm)
    values = ", ".join(f"({i}, {int(a) >> 32}::UBIGINT, {int(a) & 0xFFFFFFFF}::UBIGINT)" for i, a in enumerate(perms))
    k = settings.shingle_size
    shifted = ", ".join(f"lead(h, {j}) OVER w AS h{j}" for j in range(k))
    total = " + ".join(
        f"(coalesce(h{j}, 0)::UHUGEINT * {int(c)}::UHUGEINT) % {TWO64}" for j, c in enumerate(places)
    )
    return rf"""
tokens AS (
  SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM {rows}
),
token AS (
  SELECT id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM tokens
),
hashed AS (
  SELECT id, n, pos, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM token
),
neighbours AS (
  SELECT id, n, pos, {shifted} FROM hashed WINDOW w AS (PARTITION BY id ORDER BY pos)
),
summed AS (
  SELECT id, (({total}) % {TWO64})::UBIGINT AS x FROM neighbours
  WHERE pos <= greatest(n - {k - 1}, 1)
),
mixed AS (
  SELECT id, ((xor(x, x >> 33)::UHUGEINT * {MIX}::UHUGEINT) % {TWO64})::UBIGINT AS x FROM summed
),
shingle AS (
  SELECT DISTINCT id, xor(x, x >> 33) >> 32 AS hi, xor(x, x >> 33) & {LOW} AS lo FROM mixed
),
perm(p, a_hi, a_lo) AS (VALUES {values}),
sig AS (
  SELECT id, p,
    min((((a_hi * lo) & {LOW}) + ((a_lo * hi) & {LOW}) + ((a_lo * lo) >> 32)) & {LOW}) AS v
  FROM shingle, perm GROUP BY id, p
)"""


def bands(rows: str, settings: NearDupSettings) -> str:
    """CTEs up to `band(id, band, bucket)`."""
    n_bands, n_rows = optimal_bands(settings.threshold, settings.num_perm)
    return signatures(rows, settings) + f""",
band AS (
  SELECT id, (p // {n_rows})::INTEGER AS band,
    md5((p // {n_rows}) || ':' || string_agg(v::VARCHAR, ',' ORDER BY p)) AS bucket
  FROM sig WHERE p < {n_bands * n_rows} GROUP BY id, p // {n_rows}
)"""


def likeness(settings: NearDupSettings) -> str:
    """CTEs up to `alike(a, b)`: colliding rows whose shingle sets are as similar as
    the threshold, a before b."""
    return f"""
met AS (SELECT DISTINCT a.id AS a, b.id AS b FROM band a JOIN band b ON a.bucket = b.bucket AND a.id < b.id AND a.id > 0),
gram AS MATERIALIZED (
  SELECT DISTINCT id, unnest(CASE WHEN len(t) < {settings.shingle_size} THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - {settings.shingle_size - 2}),
      lambda i: array_to_string(t[i:i + {settings.shingle_size - 1}], ' ')) END) AS gram
  FROM tokens WHERE len(t) > 0
),
gram_count AS (SELECT id, count(*) AS n FROM gram GROUP BY id),
first_grams AS MATERIALIZED (SELECT m.a, m.b, x.gram FROM met m JOIN gram x ON x.id = m.a),
alike AS (
  SELECT a, b FROM (
    SELECT f.a, f.b, count(*) AS c FROM first_grams f JOIN gram y ON y.id = f.b AND y.gram = f.gram GROUP BY ALL
  ) JOIN gram_count x ON x.id = a JOIN gram_count y ON y.id = b WHERE c / (x.n + y.n - c) >= {settings.threshold}
)"""


def greedy(rows: str, settings: NearDupSettings) -> str:
    """CTEs up to `near(id)`: rows of `rows(id, text)` that the greedy rule drops;
    `id` is the place in quality order, from 1. Rows below are left alone."""
    if settings.verify:
        start = bands(rows, settings) + "," + likeness(settings) + """,
better AS (SELECT b AS id, list(a) AS earlier FROM alike GROUP BY b)"""
    else:
        start = bands(rows, settings) + """,
better AS (
  SELECT b.id, list(DISTINCT a.id) AS earlier
  FROM band a JOIN band b ON a.bucket = b.bucket AND a.id < b.id AND a.id > 0 GROUP BY b.id
)"""
    return start + """,
contested AS (SELECT *, row_number() OVER (ORDER BY id) AS step FROM better),
walk(step, dropped) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT c.step, CASE WHEN len(list_filter(c.earlier, lambda e: NOT list_contains(w.dropped, e))) > 0
    THEN list_append(w.dropped, c.id) ELSE w.dropped END
  FROM walk w JOIN contested c ON c.step = w.step + 1
),
near AS (
  SELECT unnest(arg_max(dropped, step)) AS id FROM walk
  UNION
  SELECT id FROM tokens WHERE len(t) = 0 AND id > 0
)"""


PLACE = "row_number() OVER (ORDER BY score DESC NULLS LAST, md5(source || chr(31) || source_id), source, source_id)"

LATE = f"""CASE WHEN {OFFENSIVE} THEN 'offensive' WHEN contains(lower(text), 'license') THEN 'meta' END"""


def cleaned(filters_first: bool = False) -> str:
    """CTEs of a run up to `rest`, whose rows without a `late` reason stay."""
    reason, late = row_reason("text"), LATE
    if filters_first:
        reason, late = f"coalesce({reason}, {LATE})", "NULL"
    return f"""
{CORPUS.strip()},
judged AS (
  SELECT * REPLACE (text AS text), {reason} AS reason
  FROM (SELECT source_id, {normalised("text")} AS text, score, source FROM corpus)
),
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC NULLS LAST, source, source_id) AS rn
    FROM judged WHERE reason IS NULL
  ) WHERE rn = 1
),
placed AS (SELECT *, {PLACE} AS id FROM best),
{greedy("placed", NEAR_DUP).strip()},
rest AS (SELECT *, {late} AS late FROM placed WHERE id NOT IN (SELECT id FROM near))"""


CLEANED = cleaned()


def drops(stages) -> str:
    """CTE `drops(step, stage, n)` after `cleaned`, the stages in the given order."""
    counts = {
        "exact_dup": "(SELECT count(*) FROM judged WHERE reason IS NULL) - (SELECT count(*) FROM best)",
        "near_dup": "(SELECT count(*) FROM near)",
    }
    by_reason = "(SELECT count(*) FROM judged WHERE reason = '{0}') + (SELECT count(*) FROM rest WHERE late = '{0}')"
    rows = " UNION ALL ".join(
        f"SELECT {step}, '{stage}', {counts.get(stage, by_reason.format(stage))}" for step, stage in enumerate(stages, 1)
    )
    return f"""
drops(step, stage, n) AS (
  {rows} UNION ALL SELECT {len(stages) + 1}, 'final', (SELECT count(*) FROM rest WHERE late IS NULL)
)"""


def funnel(stages, filters_first: bool = False) -> str:
    """The funnel of a run."""
    return f"""
WITH RECURSIVE {cleaned(filters_first).strip()}, {drops(stages).strip()},
running AS (
  SELECT step, stage, n, sum(n) OVER () AS total, sum(n) OVER (ORDER BY step) AS gone FROM drops
)
SELECT step::INTEGER AS step, stage,
  (CASE WHEN stage = 'final' THEN 0 ELSE n END)::BIGINT AS dropped,
  (CASE WHEN stage = 'final' THEN n ELSE total - gone END)::BIGINT AS remaining,
  round(100.0::DOUBLE * (CASE WHEN stage = 'final' THEN n ELSE total - gone END) / total, 1) AS percent_of_raw
FROM running"""


def embedding_tags(rows: str) -> str:
    """CTEs up to `embedded(source_id, context)` for all of `rows`."""
    prompts = ", ".join(
        f"({i}, {text_literal(label)}, {text_literal(EMBEDDING.label_prompt.format(label=label))})"
        for i, label in enumerate(lexicons.LABELS)
        if label != lexicons.FALLBACK_LABEL
    )
    vector = r"""
    SELECT {0}, ('0x' || substr(md5(w), 1, 2))::INTEGER % 64 AS dim, count(*)::DOUBLE AS n
    FROM (SELECT {0}, unnest(regexp_extract_all(lower({1}), '[\p{{L}}\p{{N}}_]+')) AS w FROM {2})
    GROUP BY ALL"""
    return f"""
prompt(ord, label, words) AS (VALUES {prompts}),
label_vec AS ({vector.format("ord", "words", "prompt")}),
text_vec AS ({vector.format("source_id", "text", rows)}),
label_len AS (SELECT ord, sqrt(sum(n * n)) AS len FROM label_vec GROUP BY ord),
text_len AS (SELECT source_id, sqrt(sum(n * n)) AS len FROM text_vec GROUP BY source_id),
dots AS (
  SELECT source_id, ord, sum(t.n * l.n) AS dot FROM text_vec t JOIN label_vec l USING (dim) GROUP BY ALL
),
cosines AS (
  SELECT r.source_id, p.ord, p.label, round(coalesce(dot / (tl.len * ll.len), 0), 6) AS cosine
  FROM {rows} r CROSS JOIN prompt p LEFT JOIN dots d ON d.source_id = r.source_id AND d.ord = p.ord
  LEFT JOIN text_len tl ON tl.source_id = r.source_id LEFT JOIN label_len ll ON ll.ord = p.ord
),
embedded AS (
  SELECT source_id, CASE WHEN max(cosine) >= {EMBEDDING.floor}
    THEN first(label ORDER BY cosine DESC, ord) ELSE '{lexicons.FALLBACK_LABEL}' END AS context
  FROM cosines GROUP BY source_id
)"""


def split_sql(rows: str, label: str, key: str, share: float = 0.05, seed: int = 42) -> str:
    """SELECT that adds `split` to `rows`."""
    return f"""
SELECT * EXCLUDE (rk, quota) REPLACE (split AS split) FROM (
  SELECT r.*, quota, row_number() OVER (
      PARTITION BY r.{label} ORDER BY md5('{seed}' || chr(31) || {key}), {key}) AS rk,
    CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split
  FROM {rows} r JOIN (
    SELECT {label}, n - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, {label}) <= spare
      THEN 1 ELSE 0 END AS quota
    FROM (
      SELECT *, n_train - sum(whole) OVER () AS spare FROM (
        SELECT {label}, n, n_train, (n_train * n) // total AS whole, (n_train * n) % total AS rest
        FROM (
          SELECT {label}, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total,
            (total - ceil({share} * total))::BIGINT AS n_train
          FROM {rows} GROUP BY {label}
        )
      )
    )
  ) q ON q.{label} = r.{label}
)"""


FALLBACK_ROWS = f"""
{CORPUS.strip()},
tagged AS (
  SELECT source_id, text, score, source,
    CASE WHEN tag = '' THEN '{lexicons.FALLBACK_LABEL}' ELSE tag END AS context
  FROM {keyword_tags("corpus")}
)"""

TWO_PASS = f"""
{CORPUS.strip()},
by_keyword AS {keyword_tags("corpus")},
{embedding_tags("corpus").strip()},
tagged AS (
  SELECT k.source_id, k.text, k.source, CASE WHEN tag = '' THEN context ELSE tag END AS context
  FROM by_keyword k JOIN embedded e ON e.source_id = k.source_id
)"""


def dimension_means() -> str:
    means = ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65))
    return f"SELECT label, [{means}] AS mean FROM embeddings GROUP BY label"


def on_messy(expression: str, name: str = "text") -> str:
    return f"WITH {MESSY.strip()} SELECT doc_id, {expression} AS {name} FROM messy"


DOCUMENT_ROWS = "(SELECT doc_id AS id, text FROM documents)"
CORPUS_PLACED = f"""
{CORPUS.strip()},
placed AS (SELECT *, {PLACE} AS id FROM corpus)"""

OWN_KEYWORD = (
    "CASE context "
    + " ".join(
        f"WHEN {text_literal(label)} THEN {has_word('text', kws)}"
        for label, kws in lexicons.CONTEXT_KEYWORDS
    )
    + " END"
)

SPLIT_LINE = f"""
SELECT context, text AS joke, '<context> ' || context || ' <joke> ' || trim(text, E' \\t\\n\\r') || '<|endoftext|>' AS text,
  CAST(score AS BIGINT) AS score, source, split
FROM ({split_sql("tagged", "context", "source || chr(31) || source_id")})"""

def length_sql(x: str) -> str:
    n = f"{n_words(x)}::DOUBLE"
    return f"CASE WHEN {n} < 8 THEN {n} / 8 WHEN {n} <= 40 THEN 1.0::DOUBLE ELSE greatest(0, 1 - ({n} - 40) / 40) END"


ANSWERS = f"(SELECT conv_id, turn, {length_sql('text')} AS score FROM conversations WHERE role = 'assistant')"

RELEVANCE_TO_LABEL = f"""
WITH numbered AS (SELECT doc_id::VARCHAR AS source_id, text FROM documents),
{embedding_tags("numbered").strip()}
SELECT c.source_id::BIGINT AS doc_id, CASE WHEN tl.len > 0 THEN cosine END AS relevance
FROM cosines c LEFT JOIN text_len tl USING (source_id) WHERE c.ord = c.source_id::BIGINT % (SELECT count(*) FROM prompt)"""

NOVELTY = f"""
WITH {CORPUS_PLACED.strip()},
both_sides AS (SELECT id, text FROM placed UNION ALL SELECT -1 - item_id, text FROM benchmark),
{bands("both_sides", NEAR_DUP).strip()},
grams AS (
  SELECT id, CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS g
  FROM tokens WHERE len(t) > 0
),
alike AS (
  SELECT x.id, max(len(list_intersect(x.g, y.g))::DOUBLE / len(list_distinct(x.g || y.g))) AS most
  FROM grams x JOIN grams y ON x.id < 0 AND y.id > 0 GROUP BY x.id
)
SELECT item_id::VARCHAR AS source_id, round(CASE WHEN most >= 0.85 THEN 0 ELSE 1 - coalesce(most, 0) END, 6)::DOUBLE AS novelty
FROM benchmark LEFT JOIN alike ON alike.id = -1 - item_id"""

ORACLES: dict[str, str] = {
    "min_score_filter": "SELECT doc_id FROM documents WHERE n_chars >= 5000",
    "nsfw_filter": "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0",
    "sample_per_label": """
SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42' || chr(31) || doc_id)) <= 20""",
    "balance_labels": """
WITH sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42' || chr(31) || doc_id))
  <= (SELECT n FROM sizes ORDER BY n DESC LIMIT 1 OFFSET 1)""",
    "approx_split": f"""
SELECT doc_id, CASE WHEN ('0x' || substr(md5('42' || chr(31) || doc_id), 1, 8))::BIGINT < {int(0.05 * (1 << 32))}
  THEN 'test' ELSE 'train' END AS split FROM documents""",
    "similarity_floor_sweep": f"""
WITH means AS ({dimension_means()}),
best AS (
  SELECT vec_id, first(label ORDER BY cosine DESC, label)::VARCHAR AS label, max(cosine) AS similarity FROM (
    SELECT vec_id, m.label, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS cosine
    FROM embeddings CROSS JOIN means m) GROUP BY vec_id
)
SELECT label, floor, count(*) FILTER (similarity >= floor) AS n_rows
FROM best, (VALUES {", ".join(f"({f}::DOUBLE)" for f in FLOORS)}) f(floor) GROUP BY label, floor""",
    "length_score": f"SELECT doc_id, {length_sql('text')} AS length FROM documents",
    "relevance_score": f"""
WITH means AS ({dimension_means()})
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS relevance
FROM embeddings JOIN means USING (label)""",
    "bucket_novelty_score": f"""
WITH RECURSIVE {CORPUS_PLACED.strip()},
both_sides AS (SELECT id, text FROM placed UNION ALL SELECT -1 - item_id, text FROM benchmark),
{greedy("both_sides", NEAR_DUP).strip()},
grams AS (
  SELECT id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS g
  FROM tokens
),
alike AS (
  SELECT c.id, max(len(list_intersect(x.g, y.g))::DOUBLE / len(list_distinct(x.g || y.g))) AS most
  FROM (SELECT DISTINCT c.id, k.id AS kept FROM band c JOIN band k USING (bucket)
    WHERE c.id < 0 AND k.id > 0 AND k.id NOT IN (SELECT id FROM near)) c
  JOIN grams x ON x.id = c.id JOIN grams y ON y.id = c.kept GROUP BY c.id
)
SELECT item_id::VARCHAR AS source_id, round(CASE WHEN most >= 0.85 THEN 0 ELSE 1 - coalesce(most, 0) END, 6)::DOUBLE AS novelty
FROM benchmark LEFT JOIN alike ON alike.id = -1 - item_id""",
    "novelty_score": NOVELTY,
    "exact_novelty_score": NOVELTY,
    "group_relative_score": f"""
SELECT conv_id, turn, CASE WHEN x = 0 THEN 0 ELSE x END AS relative
FROM (SELECT conv_id, turn, round(score - avg(score) OVER (PARTITION BY conv_id), 6) AS x FROM {ANSWERS})""",
    "best_of_n": f"""
SELECT conv_id, turn, score FROM {ANSWERS}
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1""",
    "distinct_n": r"""
WITH tokens AS (SELECT lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
grams AS (
  SELECT lang, n, unnest(CASE WHEN len(t) >= n
    THEN list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' ')) ELSE [] END) AS g
  FROM tokens, (VALUES (1), (2), (3)) s(n)
)
SELECT lang, n::INTEGER AS n, count(*) AS n_grams, count(DISTINCT g) AS n_distinct,
  round(count(DISTINCT g)::DOUBLE / count(*), 6) AS distinct_share FROM grams GROUP BY lang, n""",
    "arm_comparison_held_out": rf"""
WITH rated AS (
  SELECT lang AS arm, unnest([source, NULL]) AS context, {length_sql("text")} AS length, n_chars / 1000::DOUBLE AS size,
    regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t
  FROM documents WHERE source IN ({", ".join(map(text_literal, HELD_OUT))}) AND lang IN ({", ".join(map(text_literal, ARMS))})
),
grams AS (
  SELECT context, arm, n, unnest(CASE WHEN len(t) >= n
    THEN list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' ')) ELSE [] END) AS g
  FROM rated, (VALUES (1), (2), (3)) s(n)
),
metrics AS (
  SELECT context, arm, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM rated GROUP BY ALL
  UNION ALL SELECT context, arm, 'mean_length', round(avg(length), 6) FROM rated GROUP BY ALL
  UNION ALL SELECT context, arm, 'mean_size', round(avg(size), 6) FROM rated GROUP BY ALL
  UNION ALL SELECT context, arm, 'distinct_' || n, round(count(DISTINCT g)::DOUBLE / count(*), 6) FROM grams GROUP BY context, arm, n
)
SELECT context, metric, {", ".join(f"max(value) FILTER (arm = '{arm}') AS {arm}" for arm in ARMS)}
FROM metrics GROUP BY context, metric""",
    "relevance_to_label": RELEVANCE_TO_LABEL,
    "arm_comparison": f"""
SELECT source, lang, count(*) AS n_rows, round(avg({length_sql("text")}), 6) AS mean_length,
  round(avg(n_chars / 1000::DOUBLE), 6) AS mean_size
FROM documents GROUP BY GROUPING SETS ((source, lang), (source))""",
    "funnel_report": funnel(STAGES),
    "funnel_filters_first": funnel(FILTERS_FIRST, filters_first=True),
    "clean_filters_first": f"""
WITH RECURSIVE {cleaned(filters_first=True).strip()} SELECT source, source_id, score, text FROM rest""",
    "clean_corpus": f"""
WITH RECURSIVE {CLEANED.strip()},
final AS (SELECT source, source_id, score, text FROM rest WHERE late IS NULL),
by_keyword AS {keyword_tags("final")},
{embedding_tags("final").strip()}
SELECT k.source, k.source_id, k.score, CASE WHEN tag = '' THEN context ELSE tag END AS context, k.text
FROM by_keyword k JOIN embedded e USING (source_id)""",
    "drop_reason": f"""
WITH {MESSY.strip()}, n AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, {normalised("text")} AS text FROM messy)
SELECT source_id, {row_reason("text")} AS reason FROM n""",
    "read_wide_csv": f"WITH {CORPUS.strip()} SELECT * FROM corpus",
    "read_corpus_csv": f"WITH {CORPUS.strip()} SELECT * FROM corpus",
    "read_corpus_parquet": f"WITH {CORPUS.strip()} SELECT * FROM corpus",
    "skip_missing_source": f"WITH {CORPUS.strip()} SELECT * FROM corpus",
    "limit_per_source": f"""
WITH {CORPUS.strip()}, single AS ({SINGLE}), double_field AS ({TWO_FIELD})
(SELECT * FROM corpus ORDER BY source, source_id LIMIT 25)
UNION ALL (SELECT * FROM single ORDER BY source, source_id LIMIT 25)
UNION ALL (SELECT * FROM double_field ORDER BY source, source_id LIMIT 25)""",
    "unify_single_field_source": SINGLE,
    "unify_two_field_source": TWO_FIELD,
    "union_sources": f"WITH {UNION.strip()} SELECT * FROM everything",
    "top_n_by_score": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 100",
    "nsfw_flag": "SELECT doc_id, coalesce(toxic = 1, false) AS nsfw FROM documents LEFT JOIN labels USING (doc_id)",
    "write_raw_cached": f"WITH {CORPUS.strip()} SELECT * FROM corpus",
    "write_training_jsonl": f"WITH {FALLBACK_ROWS.strip()} {SPLIT_LINE}",
    "write_report_json": f"""
WITH RECURSIVE {CLEANED.strip()}, {drops(STAGES).strip()},
final AS (
  SELECT source, score, CASE WHEN tag = '' THEN '{lexicons.FALLBACK_LABEL}' ELSE tag END AS context
  FROM {keyword_tags("(SELECT * FROM rest WHERE late IS NULL)")}
)
SELECT 'stats' AS part, CASE WHEN stage = 'final' THEN stage ELSE 'dropped_' || stage END AS name, n::BIGINT AS n FROM drops
UNION ALL SELECT 'stats', 'raw', sum(n)::BIGINT FROM drops
UNION ALL SELECT 'context_distribution', context, count(*) FROM final GROUP BY context
UNION ALL SELECT 'source_distribution', source, count(*) FROM final GROUP BY source
UNION ALL SELECT 'with_scores', '', count(score) FROM final""",
    "null_to_empty": "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN text ELSE '' END AS text FROM documents",
    "unescape_entities": f"SELECT page_id, {unescaped('html')} AS html FROM pages",
    "fold_unicode": "SELECT doc_id, text FROM documents",
    "strip_invisible": r"SELECT doc_id, replace(text, E'\n', ' ') AS text FROM documents",
    "strip_urls": on_messy(without_urls("text")),
    "strip_edit_note": on_messy(without_edit("text")),
    "strip_edit_note_strict": on_messy(without_strict_edit("'Credit: ' || text")),
    "cap_repeated_punct": on_messy(capped("text")),
    "collapse_whitespace": on_messy(collapsed("text")),
    "normalise_text": on_messy(normalised("text")),
    "normalise_pages": f"SELECT page_id, {normalised('html')} AS text FROM pages",
    "word_count": f"SELECT doc_id, {n_words('text')}::INTEGER AS n_words, length(text)::INTEGER AS n_chars FROM documents",
    "format_prompt": "SELECT doc_id, '<context> ' || lower(lang) || ' <joke> ' AS prompt FROM documents",
    "format_example": r"""
SELECT doc_id, '<context> ' || lower(lang) || ' <joke> ' || trim(text, E' \t\n\r') || '<|endoftext|>' AS line FROM documents""",
    "score_to_int": "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN n_chars // 3 END AS score FROM documents",
    "is_tombstone": on_messy(r"regexp_matches(text, '(?i)\[(removed|deleted)\]')", "dead"),
    "is_empty": "SELECT doc_id, doc_id % 3 = 0 OR trim(text) = '' AS is_empty FROM documents",
    "length_filter": f"SELECT doc_id FROM documents WHERE {in_bounds('text', 4, 60, 400)}",
    "length_filter_wide": f"SELECT doc_id FROM documents WHERE {in_bounds('text', *WIDE)}",
    "wordlist_filter_whole_words": f"SELECT doc_id FROM documents WHERE {has_closed_word('text', BLOCKLIST)}",
    "wordlist_filter_marked": "SELECT doc_id FROM documents WHERE {}".format(has_closed_word(
        "text", [w.strip() for w in MARKED_WORDS if w != w.strip()], [w for w in MARKED_WORDS if w == w.strip()]
    )),
    "keyword_hits_whole_words": "SELECT doc_id, {} FROM documents".format(
        ", ".join(f"{count_closed_words('text', words)}::INTEGER AS {name}" for name, words in WHOLE_WORDS)
    ),
    "wordlist_filter": f"SELECT doc_id FROM documents WHERE {has_word('text', BLOCKLIST)}",
    "obfuscation_filter": f"SELECT doc_id FROM documents WHERE {has_word('text', BLOCKLIST)}",
    "meta_post_filter": "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')",
    "meta_post_filter_default": f"""
SELECT doc_id FROM (
  SELECT doc_id, lower(text || ' ' || ([{", ".join(map(text_literal, META_TALK))}])[doc_id % {len(META_TALK)} + 1]) AS t
  FROM documents
) WHERE {" OR ".join(f"contains(t, {text_literal(p)})" for p in lexicons.META_PHRASES)}
  OR regexp_matches(t, 'this sub(reddit)?($|{NOT_WORD})|karma($|{NOT_WORD})|rule \\p{{Nd}}')""",
    "exact_dedup_keep_best": f"""
WITH {CORPUS.strip()}
SELECT source_id, text, score, source, copies FROM (
  SELECT *, count(*) OVER (PARTITION BY text) AS copies,
    row_number() OVER (PARTITION BY text ORDER BY score DESC NULLS LAST, source, source_id) AS rn
  FROM corpus
) WHERE rn = 1""",
    "word_shingles": r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents
),
grams AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS g
  FROM tokens
)
SELECT doc_id, len(g)::INTEGER AS n_shingles, md5(array_to_string(list_sort(g), '|')) AS digest FROM grams""",
    "minhash_signature": f"""
WITH {signatures(DOCUMENT_ROWS, NearDupSettings()).strip()}
SELECT t.id AS doc_id, string_agg(v::VARCHAR, ',' ORDER BY p) AS signature
FROM tokens t LEFT JOIN sig s ON s.id = t.id GROUP BY t.id""",
    "lsh_band_keys": f"WITH {bands(DOCUMENT_ROWS, NEAR_DUP).strip()} SELECT id AS doc_id, band, bucket FROM band",
    "lsh_buckets": f"""
WITH {CORPUS_PLACED.strip()}, {bands("placed", NEAR_DUP).strip()}
SELECT bucket, n_rows, source AS head_source, source_id AS head_source_id
FROM (SELECT bucket, count(*) AS n_rows, min(id) AS id FROM band GROUP BY bucket HAVING count(*) > 1)
JOIN placed USING (id)""",
    "near_dup_keep_first": f"""
WITH RECURSIVE {CORPUS_PLACED.strip()}, {greedy("placed", NEAR_DUP).strip()}
SELECT source, source_id FROM placed WHERE id NOT IN (SELECT id FROM near)""",
    "jaccard_verify": f"""
WITH RECURSIVE {CORPUS_PLACED.strip()}, {greedy("placed", replace(NEAR_DUP, verify=True)).strip()}
SELECT source, source_id FROM placed WHERE id NOT IN (SELECT id FROM near)""",
    "near_dup_clusters": f"""
WITH RECURSIVE {CORPUS_PLACED.strip()}, {bands("placed", NEAR_DUP).strip()},
edge AS (SELECT DISTINCT a.id AS x, b.id AS y FROM band a JOIN band b USING (bucket)),
reached(id, other) AS (
  SELECT id, id FROM placed UNION SELECT r.id, e.y FROM reached r JOIN edge e ON e.x = r.other
),
root AS (SELECT id, min(other) AS best, count(*) AS n_rows FROM reached GROUP BY id)
SELECT p.source, p.source_id, b.source AS best_source, b.source_id AS best_source_id, n_rows
FROM placed p JOIN root USING (id) JOIN placed b ON b.id = root.best""",
    "keyword_hits": "SELECT doc_id, {} FROM documents".format(
        ", ".join(
            f"{hits}::INTEGER AS {label.replace(' ', '_')}"
            for hits, (label, _) in zip(HITS, lexicons.CONTEXT_KEYWORDS)
        )
    ),
    "tag_by_keywords": f"WITH {CORPUS.strip()} SELECT source_id, tag AS context FROM {keyword_tags('corpus')}",
    "tag_by_embedding": f"""
WITH means AS ({dimension_means()}),
cosines AS (
  SELECT vec_id, m.label, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS cosine
  FROM embeddings CROSS JOIN means m
)
SELECT vec_id, CASE WHEN max(cosine) >= 0.25 THEN first(label ORDER BY cosine DESC, label)::VARCHAR
  ELSE 'general' END AS label, max(cosine) AS similarity
FROM cosines GROUP BY vec_id""",
    "tag_two_pass": f"WITH {TWO_PASS.strip()} SELECT source_id, context FROM tagged",
    "encode_batch": r"""
SELECT doc_id, array_to_string(list_transform(range(64), lambda i: len(list_filter(dims, lambda d: d = i))), ',') AS vector
FROM (
  SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'),
    lambda w: ('0x' || substr(md5(w), 1, 2))::INTEGER % 64) AS dims
  FROM documents
)""",
    "tag_coverage": f"""
WITH {CORPUS.strip()}
SELECT count(*) FILTER (tag <> '') AS n_tagged, count(*) AS n_rows,
  round(100.0::DOUBLE * count(*) FILTER (tag <> '') / count(*), 1) AS percent_tagged
FROM {keyword_tags("corpus")}""",
    "tag_precision_report": f"""
WITH {TWO_PASS.strip()}
SELECT context, count(*) AS n_rows, round(100 * avg(CASE WHEN {OWN_KEYWORD} THEN 1.0::DOUBLE ELSE 0 END), 1) AS percent_confirmed
FROM tagged WHERE context <> '{lexicons.FALLBACK_LABEL}' GROUP BY context""",
    "label_distribution": f"WITH {FALLBACK_ROWS.strip()} SELECT context, count(*) AS n_rows FROM tagged GROUP BY context",
    "source_distribution": f"WITH {UNION.strip()} SELECT source, count(*) AS n_rows FROM everything GROUP BY source",
    "source_summary": f"""
WITH {UNION.strip()} SELECT source, count(*) AS n_rows, count(score) AS n_scored FROM everything GROUP BY ROLLUP (source)""",
    "count_with_scores": f"WITH {CORPUS.strip()} SELECT count(score) AS with_scores FROM corpus",
    "score_quantiles": """
SELECT count(*) AS n_scored, quantile_cont(n_chars::DOUBLE, 0.5) AS p50, quantile_cont(n_chars::DOUBLE, 0.9) AS p90,
  quantile_cont(n_chars::DOUBLE, 0.95) AS p95, max(n_chars)::DOUBLE AS highest,
  count(*) FILTER (n_chars >= 5000) AS n_positive,
  round(100.0::DOUBLE * count(*) FILTER (n_chars >= 5000) / count(*), 1) AS percent_positive
FROM documents""",
    "stratified_split": "SELECT doc_id, lang, split FROM ({})".format(
        split_sql("documents", "lang", "doc_id")
    ),
}
