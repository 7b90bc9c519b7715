"""Mix sources to target weights by pivotal dependent rounding.

Each document should be taken `target / size of its source` times, on average:
some whole copies and a fraction of one. The fractions are settled in pairs. Words
are moved at random from one document of a pair to the other until one of them
is taken whole or not at all; the other goes on to the next pair. The direction is
drawn so that each document keeps its average, and the words of a source stay
what they are in each step, so a source misses its target by less than one
document. Blocks of documents are settled in parallel; what each leaves over,
one document, goes to the blocks of the next level, as in a reduction tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.numbered import numbered
from sievework.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSettings:
    # Weights of the sources in code-point order, repeating.
    weights: tuple[int, ...] = (3, 1, 2)
    # Words of the mix per word there is, and most copies of one document.
    volume: float = 1.5
    most_copies: int = 2
    # Documents of a block, settled one after the other in one task.
    block: int = 256
    seed: int = 42


def source_targets(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """`source, source_size, target` of each source of `sized(source, size)`.

    The words of the mix are shared by weight. A source stops at `most_copies`
    times its size, and what is above is shared again among the others, until
    none is above; the driver holds two sums per round.
    """
    s = settings
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sizes, "rank", [F.col("source").asc_nulls_last()])
    weights = F.array(*[F.lit(w) for w in s.weights])
    weighed = materialise(
        ranked.select(
            "source", "source_size",
            (F.lit(s.most_copies) * F.col("source_size")).alias("most"),
            F.get(weights, F.pmod("rank", F.lit(len(s.weights))).cast("int")).alias("weight"),
        ),
        "sources",
    )
    volume = s.volume * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    unit, n_full = 0.0, -1
    while True:
        full = F.col("most") < unit * F.col("weight")
        row = weighed.agg(
            F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if row[0] == n_full or not row[2]:
            break
        n_full, unit = row[0], (volume - (row[1] or 0)) / row[2]
    target = F.least(F.col("most").cast("double"), F.lit(unit) * F.col("weight"))
    return materialise(weighed.select("source", "source_size", target.alias("target")), "targets")


# The pair step. `words` is what is taken of a document so far. Up: words move from
# x to the carry c until c is whole or x is out of the mix; down: the other way.
SETTLE = """
aggregate(
  slice(units, 2, greatest(size(units) - 1, 0)),
  named_struct('carry', units[0], 'done', cast(array() as array<{unit}>)),
  (s, x) -> transform(
    array(named_struct(
      'c', s.carry, 'x', x,
      'up', least(s.carry.size - s.carry.words, x.words),
      'down', least(s.carry.words, x.size - x.words),
      'u', pmod(xxhash64({seed}, s.carry.hash, x.hash), 1048576L) / 1048576D)),
    p -> if(
      p.u * (p.up + p.down) < p.down,
      if(p.c.size - p.c.words <= p.x.words,
        {c_done_up},
        {x_done_up}),
      if(p.c.words <= p.x.size - p.x.words,
        {c_done_down},
        {x_done_down}))
  )[0])
"""
UNIT = "struct<minus:bigint,hash:bigint,id:bigint,digest:bigint,size:bigint,copy:int,words:double>"


def _unit(name: str, words: str) -> str:
    kept = ", ".join(f"'{f}', p.{name}.{f}" for f in ("minus", "hash", "id", "digest", "size", "copy"))
    return f"named_struct({kept}, 'words', cast({words} as double))"


def _step(done: str, carry: str) -> str:
    return f"named_struct('carry', {carry}, 'done', array_append(s.done, {done}))"


def _settle(seed: int) -> Column:
    return F.expr(
        SETTLE.format(
            unit=UNIT,
            seed=seed,
            c_done_up=_step(_unit("c", "p.c.size"), _unit("x", "p.x.words - p.up")),
            x_done_up=_step(_unit("x", "0"), _unit("c", "p.c.words + p.up")),
            c_done_down=_step(_unit("c", "0"), _unit("x", "least(p.x.words + p.down, p.x.size)")),
            x_done_down=_step(_unit("x", "p.x.size"), _unit("c", "p.c.words - p.down")),
        )
    )


def _level(units: DataFrame, level: int, settings: MixSettings) -> DataFrame:
    """Settle blocks of units; `source, blocks, settled` with the block's carry."""
    n_blocks = units.groupBy("source").agg(
        F.ceil(F.count(F.lit(1)) / settings.block).cast("long").alias("blocks")
    )
    block = F.pmod(F.xxhash64(F.lit(settings.seed + level), "unit.hash"), F.col("blocks"))
    grouped = (
        units.alias("a").join(n_blocks.alias("b"), F.expr("a.source <=> b.source"))
        .select("a.source", "unit", "blocks", block.alias("block"))
        .groupBy("source", "blocks", "block")
        .agg(F.array_sort(F.collect_list("unit")).alias("units"))
    )
    return grouped.select("source", "blocks", _settle(settings.seed + level).alias("settled"))


def copies(sized: DataFrame, targets: DataFrame, settings: MixSettings) -> DataFrame:
    """`id, source, digest, size, copy, copies`: how often each of the rows is
    taken. Repeated rows of `sized(id, source, size, digest)` are told apart by
    their number `copy`, from 1."""
    repeated = sized.groupBy("id", "source", "digest", "size").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rate = F.least(F.try_divide("target", "source_size"), F.lit(float(settings.most_copies)))
    rows = materialise(
        repeated.alias("r")
        .join(targets.alias("t"), F.expr("r.source <=> t.source"))
        .select(
            "id", "r.source", "digest", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"),
            F.explode(F.sequence(F.lit(1), "n")).alias("copy"),
        )
        .withColumn("whole", F.floor("rate")),
        "rates",
    )
    fraction = F.col("rate") - F.col("whole")
    unit = F.struct(
        (-F.col("size")).alias("minus"),
        F.xxhash64(F.lit(settings.seed), "id", "digest", "size", "copy").alias("hash"),
        "id", "digest", "size", "copy", (fraction * F.col("size")).alias("words"),
    ).cast(UNIT)
    # A document without words counts nowhere, so its fraction is rounded down.
    units = rows.where((F.col("size") > 0) & (fraction > 0)).select("source", unit.alias("unit"))
    taken, level = [], 0
    while True:
        settled = materialise(_level(units, level, settings), "settled")
        taken.append(settled.select("source", F.explode("settled.done").alias("unit")))
        carries = settled.select("source", F.col("settled.carry").alias("unit"), "blocks")
        last = carries.where("blocks = 1").select("source", "unit")
        # The one document a source has left over goes to the nearer end.
        taken.append(last.withColumn(
            "unit",
            F.col("unit").withField("words", F.expr("if(2 * unit.words >= unit.size, double(unit.size), 0D)")),
        ))
        units, level = carries.where("blocks > 1").select("source", "unit"), level + 1
        if units.isEmpty():
            break
    extra = taken[0]
    for more in taken[1:]:
        extra = extra.unionByName(more)
    # The settled rows hold all there is to know, so nothing is joined back.
    done = extra.select(
        F.col("unit.id").alias("id"), "source", F.col("unit.digest").alias("digest"),
        F.col("unit.size").alias("size"), F.col("unit.copy").alias("copy"),
        (F.col("unit.words") > 0).cast("long").alias("extra"),
    )
    rest = rows.where((F.col("size") <= 0) | (fraction <= 0)).select(
        "id", "source", "digest", "size", "copy", F.lit(0).cast("long").alias("extra")
    )
    whole = targets.select(
        "source", "source_size", "target",
        F.floor(F.coalesce(rate, F.lit(0.0))).cast("long").alias("whole"),
    )
    every = done.unionByName(rest)
    return (
        every.alias("e").join(whole.alias("w"), F.expr("e.source <=> w.source"))
        .select("id", "e.source", "digest", "size", "copy", "source_size", "target",
                (F.col("whole") + F.col("extra")).alias("copies"))
    )


def sizes(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """`id, source, size, digest` of each row; the size is the number of words."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(id).cast("long").alias("id"), F.col(source).cast("string").alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(text)).alias("digest"),
    )


def mix(
    df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    settings: MixSettings = MixSettings(),
) -> DataFrame:
    """Per row its id, `size` in words, `source_size` and `target` of its source,
    the words `taken` of it, `source` and `copies`. Runs jobs.

    Null texts have size 0; a null source is a source, the last. The same rows
    give the same mix in any order and partitioning; of repeated rows any may be
    the one that is taken. A text of any length is taken whole or not at all.
    Other columns are not read, whatever their names; no rows give no rows.
    """
    sized = materialise(sizes(df, id, text, source), "sizes")
    targets = source_targets(sized, settings)
    return copies(sized, targets, settings).select(
        F.col("id").alias(id), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), F.col("source").alias(source), "copies",
    )


def mixed_documents(
    df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    settings: MixSettings = MixSettings(),
) -> DataFrame:
    """The rows of `df`, with all columns of any name, each as many times as the mix
    takes it. Runs jobs. No rows give no rows."""
    sized = materialise(sizes(df, id, text, source), "sizes")
    taken = copies(sized, source_targets(sized, settings), settings)
    # Equal rows, of which there may be several, get the copies in any order.
    lists = taken.groupBy("id", "source", "digest").agg(F.collect_list("copies").alias("_copies"))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.col(id).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"),
        F.xxhash64(F.col(text)).alias("_digest"),
    )
    same = F.expr("_id <=> id AND _source <=> source AND _digest = digest")
    joined = rows.join(lists.where("exists(_copies, n -> n > 0)"), same)
    # Nearly all lists hold one number; only the others need a row number.
    one = joined.where("size(_copies) = 1").select("_row", F.col("_copies")[0].alias("_n"))
    at = F.row_number().over(Window.partitionBy("_id", "_source", "_digest").orderBy(F.lit(1)))
    many = joined.where("size(_copies) > 1").withColumn("_at", at)
    many = many.select("_row", F.col("_copies")[F.col("_at") - 1].alias("_n"))
    times = F.sequence(F.lit(1), F.col("_n").cast("int"))
    return (
        one.unionByName(many)
        .where("_n > 0")
        .select("_row", F.explode(times).alias("_copy"))
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
    )
