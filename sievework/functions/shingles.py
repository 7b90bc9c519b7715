"""Word shingles, MinHash signatures and LSH band keys."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sievework.functions.expr import let
from sievework.functions.text import words

# Shingles reduced at a time, so one long text needs little memory.
BLOCK = 512
# Characters worked on at a time, so a batch of any size needs little memory: only
# its Arrow columns are there as a whole.
PORTION = 500_000
# Rows taken out of Arrow at a time.
ROWS = 256
# Words whose numbers are kept, some 10 MB.
KEPT_WORDS = 50_000
# Fixed value: multiplier of the published 64-bit murmur finaliser.
MIX = 0xFF51AFD7ED558CCD
WORD_RUN = re.compile(r"\w+")


def word_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of `k` lower-cased words. A shorter text is one shingle, a
    text without words has none."""

    def grams(tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (k - 1), F.lit(1)))
        runs = F.transform(starts, lambda at: F.array_join(F.slice(tokens, at, k), " "))
        return F.when(F.size(tokens) > 0, F.array_distinct(runs)).otherwise(
            F.array().cast("array<string>")
        )

    return let(words(text), grams)


def odd_numbers(name: str, n: int) -> np.ndarray:
    """`n` odd 64-bit multipliers, from the MD5 of their name and number."""
    digests = (hashlib.md5(f"{name}:{i}".encode()).hexdigest() for i in range(n))
    return np.array([int(d[:16], 16) | 1 for d in digests], dtype=np.uint64)


class _WordHashes(dict):
    """First eight bytes of a word's MD5, worked out once per word, as long as it is
    one of the last KEPT_WORDS."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        digest = hashlib.md5(word.encode()).digest()
        self[word] = value = int.from_bytes(digest[:8], "big")
        return value


def _shingle_hashes(
    words_of: list[np.ndarray], places: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """One number per shingle of all texts in a row, and where each text begins
    in it, from the word hashes of the texts; every text has a word.

    The number is the sum of the word hashes, each times the multiplier of its
    place, then mixed.
    """
    sizes = np.fromiter(map(len, words_of), np.int64, len(words_of))
    hashes = np.concatenate(words_of)
    n_grams = np.maximum(sizes - len(places) + 1, 1)
    edges = np.concatenate(([0], np.cumsum(n_grams)))
    ends = np.repeat(np.cumsum(sizes), n_grams)
    first = np.arange(edges[-1]) + np.repeat(np.cumsum(sizes) - sizes - edges[:-1], n_grams)
    total = np.zeros(edges[-1], dtype=np.uint64)
    for j, multiplier in enumerate(places):
        # Only a text of fewer words than a shingle runs out of words.
        word = hashes[np.minimum(first + j, len(hashes) - 1)]
        total += np.where(first + j < ends, word, np.uint64(0)) * multiplier
    total ^= total >> np.uint64(33)
    total *= np.uint64(MIX)
    return total ^ (total >> np.uint64(33)), edges


def _lowest(hashes: np.ndarray, edges: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Per text and multiplier the high half of the lowest product modulo 2^64."""
    lowest = np.empty((len(edges) - 1, len(multipliers)), dtype=np.uint64)
    text = 0
    while text < len(lowest):
        begin = edges[text]
        stop = max(int(np.searchsorted(edges, begin + BLOCK, side="right")) - 1, text + 1)
        products = hashes[begin : min(edges[stop], begin + BLOCK), None] * multipliers
        lowest[text:stop] = np.minimum.reduceat(products, edges[text:stop] - begin, axis=0)
        # What a single long text has beyond the first block.
        for start in range(begin + BLOCK, edges[stop], BLOCK):
            products = hashes[start : min(edges[stop], start + BLOCK), None] * multipliers
            np.minimum(lowest[text], products.min(axis=0), out=lowest[text])
        text = stop
    return (lowest >> np.uint64(32)).astype(np.int64)


def _word_portions(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """The word hashes of each text, none for a null, a portion of the texts at a
    time. Words are Python objects for one text at a time only."""
    hash_of = _WordHashes()
    part, n_chars = [], 0
    for row in range(0, len(texts), ROWS):
        for text in texts.slice(row, ROWS):
            text = (text.as_py() or "").lower()
            found = WORD_RUN.findall(text) if len(text) <= PORTION else (m.group() for m in WORD_RUN.finditer(text))
            part.append(np.fromiter(map(hash_of.__getitem__, found), np.uint64))
            n_chars += len(text)
            if n_chars >= PORTION:
                yield part
                part, n_chars = [], 0
    if part:
        yield part


def _lists(texts: pa.Array, k: int, *wanted: tuple) -> list[pa.Array]:
    """For each `(type, convert)` a list per text, null without words. `convert` makes
    of the shingles of some texts, and where each begins, all values and the number of
    each text's."""
    places = odd_numbers("place", k)
    lists = [[pa.array([], pa.list_(element))] for element, _ in wanted]
    for part in _word_portions(texts):
        worded = np.fromiter(map(len, part), np.int64, len(part)) > 0
        shingles = _shingle_hashes([words for words in part if len(words)], places) if worded.any() else None
        for (element, convert), found in zip(wanted, lists):
            sizes, values = np.zeros(len(part), dtype=np.int64), []
            if shingles is not None:
                values, sizes[worded] = convert(*shingles)
            edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            found.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(values, element), mask=pa.array(~worded)))
    return [pa.concat_arrays(found) for found in lists]


def _sets() -> tuple:
    """The distinct shingles of each text, for `_lists`."""

    def sets(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[int]]:
        found = [np.unique(hashes[begin:end].view(np.int64)) for begin, end in zip(edges[:-1], edges[1:])]
        return np.concatenate(found), [len(grams) for grams in found]

    return pa.int64(), sets


def _keys(bands: int, rows: int, num_perm: int) -> tuple:
    """The LSH bucket keys of each text, for `_lists`."""
    multipliers = odd_numbers("permutation", num_perm)

    def keys(hashes: np.ndarray, edges: np.ndarray) -> tuple[list[bytes], int]:
        found = []
        for signature in _lowest(hashes, edges, multipliers):
            values = [str(value) for value in signature[: bands * rows].tolist()]
            parts = (f"{i}:{','.join(values[i * rows : (i + 1) * rows])}" for i in range(bands))
            found += [hashlib.md5(part.encode()).digest() for part in parts]
        return found, bands

    return pa.binary(), keys


def shingle_hashes(text: Column, k: int = 3) -> Column:
    """The set of word shingles of `text` as sorted 64-bit numbers, those that its
    MinHash signature is made of; null for a text without words."""

    @arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return _lists(texts, k, _sets())[0]

    return run(text)


def minhash_signature(text: Column, num_perm: int = 128, k: int = 3) -> Column:
    """MinHash over the word shingles of `text`; null for a text without words.

    Words are hashed once each; shingles and permutations are array arithmetic
    over many texts at a time.
    """
    multipliers = odd_numbers("permutation", num_perm)

    def signatures(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, int]:
        return _lowest(hashes, edges, multipliers).ravel(), num_perm

    @arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return _lists(texts, k, (pa.int64(), signatures))[0]

    return run(text)


def lsh_keys(text: Column, bands: int, rows: int, num_perm: int = 128, k: int = 3) -> Column:
    """The LSH bucket keys of `text`: per band the MD5 of its number and its
    part of the MinHash signature; null for a text without words."""

    @arrow_udf(T.ArrayType(T.BinaryType()))
    def run(texts: pa.Array) -> pa.Array:
        return _lists(texts, k, _keys(bands, rows, num_perm))[0]

    return run(text)


def lsh_keys_and_shingles(text: Column, bands: int, rows: int, num_perm: int = 128, k: int = 3) -> Column:
    """`bands`, as of `lsh_keys`, and `grams`, as of `shingle_hashes`: words are
    looked for once for both."""

    @arrow_udf("bands array<binary>, grams array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_lists(texts, k, _keys(bands, rows, num_perm), _sets()), ["bands", "grams"])

    return run(text)


@lru_cache
def optimal_bands(threshold: float, num_perm: int, steps: int = 1000) -> tuple[int, int]:
    """Bands and rows per band with the least equal-weight sum of the expected
    false positives below and false negatives above the threshold."""
    below = (np.arange(steps) + 0.5) / steps * threshold
    above = threshold + (np.arange(steps) + 0.5) / steps * (1 - threshold)

    def error(bands: int, rows: int) -> float:
        false_pos = threshold * np.mean(1 - (1 - below**rows) ** bands)
        false_neg = (1 - threshold) * np.mean((1 - above**rows) ** bands)
        return false_pos + false_neg

    shapes = (
        (bands, rows)
        for bands in range(1, num_perm + 1)
        for rows in range(1, num_perm // bands + 1)
    )
    return min(shapes, key=lambda shape: error(*shape))
