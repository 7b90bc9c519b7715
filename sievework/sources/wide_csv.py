"""Read CSV files with quoted line breaks in many tasks per file.

A line break ends a record only outside quotes, and whether a place is inside
depends on all quotes before it. So a first pass counts the quotes of each split of
a file; sums of these small counts tell whether a split begins inside a quoted cell.
With that each split cuts its own lines into records in a second pass, as they come,
without a shuffle. Of a record that goes on in later splits each has a fragment;
only fragments, at most two per split, are brought together.

Quotes must only stand around cells, and doubled inside them, as writers of CSV put
them. A quote inside an unquoted cell would be taken for the begin of a quoted one.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
# What a row of the second pass is: a whole record, the end of one that began in an
# earlier split, or the begin of one that ends in a later split.
WHOLE, TAIL, HEAD = 0, 1, 2
PARTS = "file string, block long, kind int, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """`value, file, block`: lines with the split they are of."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def split_parities(lines: DataFrame) -> DataFrame:
    """`file, block, inside`: whether a split begins inside a quoted cell. One row
    per split of the input, and one sort of a file's splits."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Split:
    """The lines of one split, put together to records as they come."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        # Whether what is being put together began in an earlier split.
        self.tail, self.open, self.first = inside, [], block == 0

    def _made(self, kind: int) -> tuple:
        row = (self.file, self.block, kind, self.first and kind != TAIL, "\n".join(self.open))
        self.first, self.tail, self.open = False, False, []
        return row

    def add(self, lines: list[str], quotes: list[int]) -> Iterator[tuple]:
        for line, n in zip(lines, quotes):
            self.open.append(line)
            self.inside ^= bool(n % 2)
            if not self.inside:
                yield self._made(TAIL if self.tail else WHOLE)

    def end(self) -> Iterator[tuple]:
        """What goes on in the next split; a split wholly inside a cell has a part
        that neither begins nor ends a record."""
        if self.open:
            yield self._made(TAIL if self.tail else HEAD)


def record_parts(lines: DataFrame) -> DataFrame:
    """PARTS of the records of `lines(value, file, block, inside)`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = None
        names = [part.split()[0] for part in PARTS.split(", ")]
        for batch in batches:
            rows = []
            # Splits come one after the other, each in the order of its lines.
            runs = (batch["block"].ne(batch["block"].shift()) | batch["file"].ne(batch["file"].shift())).cumsum()
            for _, part in batch.groupby(runs, sort=False):
                file, block = part["file"].iloc[0], int(part["block"].iloc[0])
                if split is None or (split.file, split.block) != (file, block):
                    rows += split.end() if split else ()
                    split = _Split(file, block, bool(part["inside"].iloc[0]))
                rows += split.add(part["value"].to_list(), part["value"].str.count(QUOTE).to_list())
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if split and (rows := list(split.end())):
            yield pd.DataFrame(rows, columns=names)

    return lines.mapInPandas(run, PARTS)


def _joined_fragments(parts: DataFrame) -> DataFrame:
    """`first, record` of the records that lie in several splits."""
    fragments = parts.where(F.col("kind") != WHOLE)
    # In a split the end of an earlier record comes before the begin of a new one.
    order = Window.partitionBy("file").orderBy("block", "kind")
    numbered = fragments.withColumn("number", F.sum((F.col("kind") == HEAD).cast("int")).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("block", "kind", "record")))
    return numbered.groupBy("file", "number").agg(F.max("first").alias("first"), pieces.alias("pieces")).select(
        "first", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record")
    )


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in the header row; of several files, of one of them."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", QUOTE).csv(path).columns
    return [name.lstrip("\ufeff") for name in names]


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV with a header row, as strings: the same rows as Spark's
    `multiLine` reader gives, in as many tasks as the files have splits.

    All files must have the same header. Reads the input twice. What is broadcast is
    one row per split of the input.
    """
    lines = _lines(spark, path)
    parities = split_parities(lines)
    # A broadcast join leaves the lines in the order of the file.
    parts = record_parts(lines.join(F.broadcast(parities), ["file", "block"]))
    whole = parts.where(F.col("kind") == WHOLE).select("first", "record")
    records = whole.unionByName(_joined_fragments(parts))
    names = header_of(spark, path)
    return records.where(~_is_header(F.col("first"), F.col("record"), names)).select(
        # A line break may be of two characters, of which the first is still there.
        F.regexp_replace("record", "\r$", "").alias("record")
    ).where("record <> ''").select(_cells(F.col("record"), len(names)).alias("cells")).select(
        *[F.col(f"cells._{i}").alias(name) for i, name in enumerate(names)]
    )


def _cells(record: Column, n: int) -> Column:
    schema = ", ".join(f"_{i} string" for i in range(n))
    return F.from_csv(record, schema, {"escape": QUOTE, "multiLine": "true"})


def _is_header(first: Column, record: Column, names: list[str]) -> Column:
    """Whether this is the first record of a file, which must be its header."""
    plain = F.regexp_replace(F.regexp_replace(record, "^\ufeff", ""), "\r$", "")
    wanted = list(dict.fromkeys([",".join(names), *_written(names)]))
    wrong = F.raise_error(F.concat(F.lit(f"expected the header {','.join(names)!r}, not "), plain))
    return F.when(~first, False).when(plain.isin(wanted), True).otherwise(wrong.cast("boolean"))


def _written(names: list[str]) -> list[str]:
    """The header as writers quote it: where needed, and always."""
    class Lines(list):
        write = list.append

    out = Lines()
    for quoting in (csv.QUOTE_MINIMAL, csv.QUOTE_ALL):
        csv.writer(out, quoting=quoting, lineterminator="").writerow(names)
    return list(out)
