"""Quality rules as a short-circuit cascade.

Base figures of a text are always worked out. Of the rules on top, a text meets
one after the other until one rejects it. Their order is chosen on a sample: how
much work a rule is per text, and how many of the texts that are still there it
rejects; the rule with most rejections per work comes first. The order decides
what a run costs, and which rule a rejected text is charged to, but not which
texts are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.sampling import in_share

SPACES = r"[\x20\x09-\x0D]"
WORD_BREAK = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Words in windows of three that occur twice or more in the text. Sorted pairs
# hold the hash of a window and its place, so equal windows are neighbours; the words
# themselves are compared too. Texts in which all hashes differ are done before
# anything is sorted.
REPEATED = """
case when size(_parts.words) < 4 then 0 else
  transform(array(transform(sequence(0, size(_parts.words) - 3),
                            i -> xxhash64(_parts.words[i], _parts.words[i + 1], _parts.words[i + 2]))),
    hashes -> case when size(array_distinct(hashes)) = size(hashes) then 0 else
      transform(array(sort_array(transform(hashes, (x, i) -> named_struct('hash', x, 'at', i)))),
        keys -> aggregate(
          transform(
            array(sort_array(transform(
              filter(keys, (x, j) ->
                (j > 0 and x.hash = get(keys, j - 1).hash and {same_before})
                or (j + 1 < size(keys) and x.hash = get(keys, j + 1).hash and {same_after})),
              x -> x.at))),
            places -> transform(places, (p, j) -> least(3, coalesce(get(places, j + 1), p + 3) - p)))[0],
          0, (a, x) -> a + x))[0]
    end)[0]
end
"""


def _same_window(x: str, y: str) -> str:
    return " and ".join(f"_parts.words[{x}.at + {k}] = _parts.words[{y}.at + {k}]" for k in range(3))


@dataclass(frozen=True)
class Rule:
    """`rejects` is the condition, `work` the steps it takes on one text; both are
    SQL over `_figures` and `_parts`."""

    name: str
    rejects: str
    work: str


@dataclass(frozen=True)
class QualitySettings:
    # The base test: fewer words, or a larger percentage of repeated words, fails.
    least_words: int = 50
    most_repeated: int = 50
    # Rows on which rules are measured.
    sample_rows: int = 2_000
    rules: tuple[Rule, ...] = (
        Rule("symbols", "10 * _figures.n_symbols > _figures.n_words", "1"),
        Rule("word_length", "_figures.word_chars < 2 * _figures.n_words or _figures.word_chars > 15 * _figures.n_words", "2"),
        Rule("duplicate_lines", "2 * _figures.n_dup_lines > size(_parts.lines)", "2"),
        Rule("letters", "2 * size(filter(_parts.words, w -> w rlike '\\\\p{L}')) < _figures.n_words", "4 * _figures.n_words"),
        Rule(
            "capitals",
            "10 * regexp_count(_parts.text, '\\\\p{Lu}') > 7 * regexp_count(_parts.text, '\\\\p{L}')",
            "2 * char_length(_parts.text)",
        ),
        Rule("few_words", "20 * size(array_distinct(_parts.words)) < _figures.n_words", "8 * _figures.n_words"),
    )


def _once(name: str, **fields: Column) -> Column:
    """A struct that is worked out once per row. As the one element of an exploded
    array it is a step of the plan, past which a later filter is not moved; a
    plain column would be worked out again inside such a filter."""
    return F.explode(F.array(F.struct(*[value.alias(key) for key, value in fields.items()]))).alias(name)


def with_figures(df: DataFrame, text: str, settings: QualitySettings) -> DataFrame:
    """`df` with `_parts` (text, words, lines) and `_figures` (the base figures and
    `base_failed`). `df` must have no columns of these names."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(body, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(HAS_WORD))
    parts = df.select("*", _once("_parts", text=body, words=words, lines=lines))
    repeated = REPEATED.format(
        same_before=_same_window("x", "get(keys, j - 1)"), same_after=_same_window("x", "get(keys, j + 1)")
    )
    n_words, all_lines, whole = F.size("_parts.words"), F.col("_parts.lines"), F.col("_parts.text")
    figures = parts.select(
        "*",
        _once(
            "_figures",
            n_words=n_words.cast("long"),
            word_chars=(F.char_length(whole) - F.regexp_count(whole, F.lit(SPACES))).cast("long"),
            n_symbols=F.regexp_count(whole, F.lit(SYMBOL)).cast("long"),
            n_dup_lines=(F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long"),
            n_repeat_words=F.expr(repeated).cast("long"),
        ),
    )
    words_, repeat = F.col("_figures.n_words"), F.col("_figures.n_repeat_words")
    failed = (words_ < settings.least_words) | (100 * repeat > settings.most_repeated * words_)
    return figures.withColumn("_figures", F.col("_figures").withField("base_failed", failed))


def rule_order(df: DataFrame, text: str, settings: QualitySettings) -> list[Rule]:
    """The rules by rejections per work on the texts that earlier rules leave.

    One job over about `sample_rows` rows; the driver sees one row per
    combination of rejecting rules.
    """
    rules = list(settings.rules)
    n_rows = df.agg(F.count(F.lit(1))).first()[0]
    share = min(1.0, settings.sample_rows / max(n_rows, 1))
    figures = with_figures(df.where(in_share(F.xxhash64(text), share)), text, settings).where("NOT _figures.base_failed")
    judged = figures.groupBy(*[F.expr(r.rejects).alias(f"r{i}") for i, r in enumerate(rules)]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(r.work)).alias(f"w{i}") for i, r in enumerate(rules)]
    )
    left, order, rest = judged.collect(), [], list(range(len(rules)))

    def rank(i: int) -> tuple[float, float, int]:
        rejected = sum(row["n"] for row in left if row[f"r{i}"])
        work = sum(row[f"w{i}"] for row in left)
        return rejected / max(work, 1), -work, -i

    while rest:
        best = max(rest, key=rank)
        order.append(rules[best])
        rest.remove(best)
        left = [row for row in left if not row[f"r{best}"]]
    return order


def judged(df: DataFrame, text: str = "text", settings: QualitySettings = QualitySettings()) -> DataFrame:
    """`df` with the struct `_quality`: the base figures, `base_failed`, `kept` and
    `failed_rule`, the first rule of the cascade that rejects. Runs one job.

    A null or empty text has no words and fails the base test. Each row is judged
    on its own, so repeated rows are judged alike; no row is dropped, and no rows give
    no rows. Texts of any length are judged whole. `df` keeps its columns, of which none
    may be named `_quality`, `_parts` or `_figures`.
    """
    order = rule_order(df, text, settings)
    first = F.when(F.col("_figures.base_failed"), F.lit("base"))
    for rule in order:
        first = first.when(F.expr(rule.rejects), F.lit(rule.name))
    columns = [F.col(f"`{c}`") for c in df.columns]
    rated = with_figures(df, text, settings).select(*columns, "_figures", first.alias("failed_rule"))
    return rated.select(
        *columns,
        F.struct("_figures.*", "failed_rule", F.col("failed_rule").isNull().alias("kept")).alias("_quality"),
    )
