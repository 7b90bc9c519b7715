"""Find secrets in texts: by their form, and by the entropy of sliding windows.

Three kinds have a fixed form: assignments to a name such as "password", access
keys and long hexadecimal numbers. Of all other long runs of key characters, the
candidates, each is of the narrowest class of characters that holds it. A window
of the class's width slides over the candidate, with one count per character: a
step adds one to the count of the character that enters, takes one from that of the
one that leaves, and changes the window's entropy by these two terms alone. Windows
at or above the class's least entropy, where they overlap, are one span. Candidates
that look like something harmless, as the allow-list says, have no such spans.

All of it is Column expressions over one row, without a shuffle. A match is found
with its place by writing marks around all matches and adding up what lies between
the marks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.expr import let



def either_case(pattern: str) -> str:
    """The pattern with its small letters in either case, and no other signs: what
    engines take for the same letter differs beyond ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


# The forms of the three kinds, and the least number of characters.
NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = f"({either_case(NAMES)})" + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy")

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
# Signs around a match; a text's own are read as another control character.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
# Pieces between matches that are added up at a time: a text of n matches takes
# some n * BLOCK steps, not n * n.
BLOCK = 256
SPAN = "struct<start:bigint,stop:bigint,value:string>"
# Terms of an entropy are whole numbers, so that adding and taking away is exact.
UNIT = 1_000_000


@dataclass(frozen=True)
class CharClass:
    """A window over characters of `alphabet` has at least `bits` of entropy per
    character to be a secret."""

    name: str
    pattern: str
    alphabet: str
    window: int
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of n * log2(n) over the counts n of such a window."""
        return math.floor(UNIT * self.window * (math.log2(self.window) - self.bits))


@dataclass(frozen=True)
class SecretSettings:
    # The narrowest class first; capital hexadecimal digits count as small ones.
    classes: tuple[CharClass, ...] = (
        CharClass("hex", "^[0-9A-Fa-f]+$", DIGITS + "abcdef", 24, 3.0),
        CharClass("alnum", "^[A-Za-z0-9]+$", DIGITS + LOWER + LOWER.upper(), 20, 3.75),
        CharClass("base64", "^[A-Za-z0-9+/_-]+$", DIGITS + LOWER + LOWER.upper() + "+/_-", 20, 3.85),
    )
    # Candidates with one of these are no secrets: no digit or no letter, words and
    # numbers with signs between them, identifiers in groups, stand-ins, characters
    # in order, digests of known files.
    allowed: tuple[str, ...] = (
        r"^[^0-9]+$",
        r"^[^A-Za-z]+$",
        r"^(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15}|[0-9]{1,8})(?:[+/_-]+(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15}|[0-9]{1,8}))*[+/_-]*$",
        r"^(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$",
        r"(?i:example|sample|placeholder|dummy|changeme|xxxxxx|redacted)",
        r"(?i:abcdefgh|01234567|12345678|qwertyui)",
        r"^sha(?:1|256|384|512)-",
    )


def term(n: int) -> int:
    return round(UNIT * n * math.log2(n)) if n else 0


def _marked(text: Column, pattern: str) -> Column:
    """The text cut before each match of the pattern, which CLOSE ends."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)


def _spans(pieces: Column) -> Column:
    """Start, stop and value of all matches, in code points, from `_marked`."""
    none = F.array().cast(f"array<{SPAN}>")

    def value(piece: Column) -> Column:
        return F.substring_index(piece, CLOSE, 1)

    def add(state: Column, piece: Column) -> Column:
        at = state["at"]
        span = F.struct(
            at.alias("start"), (at + F.length(value(piece))).alias("stop"), value(piece).alias("value")
        )
        return F.struct(
            (at + F.length(piece) - 1).alias("at"), F.array_append(state["spans"], span).alias("spans")
        )

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct((x["start"] + by).alias("start"), (x["stop"] + by).alias("stop"), x["value"].alias("value")),
        )

    n = F.size(pieces) - 1
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(
            F.slice(pieces, b * BLOCK + 2, F.lit(BLOCK)),
            F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
            add,
        ),
    )
    whole = F.aggregate(
        blocks,
        F.struct(F.length(pieces[0]).cast("long").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("spans")),
        lambda state, block: F.struct(
            (state["at"] + block["at"]).alias("at"),
            F.array_append(state["spans"], shifted(block["spans"], state["at"])).alias("spans"),
        ),
        lambda state: F.flatten(state["spans"]),
    )
    return F.when(n > 0, whole).otherwise(none)


def _class_of(body: Column, settings: SecretSettings) -> Column:
    """Alphabet, width and largest sum of the narrowest class."""
    chosen = None
    for c in settings.classes:
        fields = F.struct(
            F.lit(c.alphabet).alias("alphabet"), F.lit(c.window).alias("window"), F.lit(c.most).cast("long").alias("most")
        )
        chosen = F.when(body.rlike(c.pattern), fields) if chosen is None else chosen.when(body.rlike(c.pattern), fields)
    return chosen


def _hot_runs(body: Column, kind: Column, settings: SecretSettings) -> Column:
    """Starts and stops in `body` of the windows of high entropy, where they
    overlap as one."""
    widest = max(c.window for c in settings.classes)
    terms = F.array(*[F.lit(term(n)).cast("long") for n in range(widest + 2)])
    run = "struct<start:bigint,stop:bigint>"
    hexadecimal = F.length(kind["alphabet"]) == 16
    signs = F.when(hexadecimal, F.lower(body)).otherwise(body)
    codes = F.transform(F.split(signs, ""), lambda c: F.instr(kind["alphabet"], c) - 1)
    width = kind["window"]

    def step(codes: Column):
        def merge(state: Column, i: Column) -> Column:
            # The window that ends before this character; what enters and leaves then.
            begin = (i - 1 - width).cast("long")
            hot = (begin >= 0) & (state["sum"] <= kind["most"])
            apart = hot & (state["stop"] < begin)
            enters, leaves = F.get(codes, i - 1), F.when(begin >= 0, F.get(codes, begin.cast("int")))
            more, less = F.get(state["counts"], enters), F.get(state["counts"], leaves)
            change = F.when(enters.eqNullSafe(leaves), F.lit(0).cast("long")).otherwise(
                F.coalesce(F.get(terms, more + 1) - F.get(terms, more), F.lit(0))
                + F.coalesce(F.get(terms, less - 1) - F.get(terms, less), F.lit(0))
            )
            pending = F.struct(state["start"].alias("start"), state["stop"].alias("stop"))
            return F.struct(
                F.transform(
                    state["counts"],
                    lambda n, k: n + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0),
                ).alias("counts"),
                (state["sum"] + change).alias("sum"),
                F.when(apart, begin).otherwise(state["start"]).alias("start"),
                F.when(hot, (i - 1).cast("long")).otherwise(state["stop"]).alias("stop"),
                F.when(apart & (state["stop"] >= 0), F.array_append(state["runs"], pending))
                .otherwise(state["runs"]).alias("runs"),
            )

        first = F.struct(
            F.array_repeat(F.lit(0), F.length(kind["alphabet"])).alias("counts"),
            F.lit(0).cast("long").alias("sum"),
            F.lit(-1).cast("long").alias("start"),
            F.lit(-1).cast("long").alias("stop"),
            F.array().cast(f"array<{run}>").alias("runs"),
        )
        # One step more than there are characters, to judge the last window.
        return F.aggregate(
            F.sequence(F.lit(1), F.size(codes) + 1), first, merge,
            lambda s: F.when(
                s["stop"] >= 0, F.array_append(s["runs"], F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
            ).otherwise(s["runs"]),
        )

    return let(codes, step)


def _entropy_spans(candidates: Column, base: Column, settings: SecretSettings) -> Column:
    """Spans of high entropy that meet no span of `base`."""

    def of(candidate: Column) -> Column:
        body = F.rtrim(candidate["value"], F.lit("="))
        runs = let(_class_of(body, settings), lambda kind: _hot_runs(body, kind, settings))
        return F.transform(
            runs,
            lambda r: F.struct(
                (candidate["start"] + r["start"]).alias("start"),
                (candidate["start"] + r["stop"]).alias("stop"),
                F.substring(body, (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int")).alias("value"),
            ),
        )

    def harmless(value: Column) -> Column:
        found = F.lit(False)
        for pattern in settings.allowed:
            found = found | value.rlike(pattern)
        return found

    left = F.filter(candidates, lambda c: ~harmless(c["value"]))
    # A candidate inside a base span is known already.
    left = F.filter(left, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["stop"] >= c["stop"])))
    return F.filter(
        F.flatten(F.transform(left, of)),
        lambda e: ~F.exists(base, lambda b: (b["start"] < e["stop"]) & (b["stop"] > e["start"])),
    )


def _once(name: str, **fields: Column) -> Column:
    """A struct that is worked out once per row, as a step of the plan."""
    return F.explode(F.array(F.struct(*[value.alias(key) for key, value in fields.items()]))).alias(name)


def secret_spans(
    df: DataFrame, id: str = "doc_id", text: str = "text", settings: SecretSettings = SecretSettings()
) -> DataFrame:
    """Per row its id and `spans`: kind, start, stop (code points, end exclusive)
    and value of all secrets, by start and then in the order of KINDS. One pass
    without a shuffle or Python.

    A null or empty text has none. A row with a null id and repeated rows are rows
    like any other; other columns are not read; no rows give no rows. Texts are
    scanned whole; a text of n matches takes some n * BLOCK steps to place them.
    """
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(OPEN), F.lit(OTHER))
    body = F.replace(body, F.lit(CLOSE), F.lit(OTHER))
    rows = df.select(F.col(id).alias("id"), _once("given", text=body))
    whole = F.col("given.text")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    cut = rows.select("id", _once("cut", **{kind: _marked(whole, p) for kind, p in patterns.items()}))
    placed = cut.select("id", _once("placed", **{kind: _spans(F.col(f"cut.{kind}")) for kind in patterns}))
    assign = F.filter(
        F.col("placed.assign"), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_LEAST
    )
    known = placed.select(
        "id", _once("known", assign=assign, access=F.col("placed.access"), hex=F.col("placed.hex"),
                    candidate=F.col("placed.candidate")),
    )
    base = F.concat("known.assign", "known.access", "known.hex")
    found = known.select(
        "id", "known", _once("found", entropy=_entropy_spans(F.col("known.candidate"), base, settings))
    )

    def ordered(kind: str, spans: str) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), x["stop"].alias("stop"),
                F.lit(kind).alias("kind"), x["value"].alias("value"),
            ),
        )

    every = F.concat(
        ordered("assign", "known.assign"), ordered("access", "known.access"), ordered("hex", "known.hex"),
        ordered("entropy", "found.entropy"),
    )
    spans = F.transform(
        F.sort_array(every), lambda x: F.struct(*[x[name].alias(name) for name in ("kind", "start", "stop", "value")])
    )
    return found.select(F.col("id").alias(id), spans.alias("spans"))


def redacted(text: Column, spans: Column, sign: str = "[secret]") -> Column:
    """The text with `sign` in place of all characters that `spans` cover."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(s: Column, x: Column) -> Column:
        before = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        # A span that begins in the one before goes on with its sign.
        part = F.when((x["start"] < s["at"]), F.lit("")).otherwise(F.concat(before, F.lit(sign)))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.array_append(s["parts"], part).alias("parts"))

    return F.aggregate(
        spans, state, add,
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )


def with_digests(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Numbers of base spans, the digest of them, and all spans in writing."""

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select(
        id, *[number(kind) for kind in KINDS[:3]], F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
