"""Byte-level BPE over arrays: all pre-tokens of many texts at a time.

A text is split into pre-tokens by array operations on its code points, which
repeat the rule of the vocabulary's own splitter: contractions, runs of letters,
of digits and of other signs, each with one blank before it, and white space.
Distinct pre-tokens are then merged together, round by round: in every sequence
the pair of lowest rank is merged, in all sequences at once, until none has a
pair left. What a pre-token becomes is kept for the next texts.
"""

from __future__ import annotations

import json
import re

import numpy as np

from sievework.llm import ragged

SPACE, LETTER, NUMBER, OTHER, END, UNKNOWN = range(6)
NO_RANK = np.int64(1 << 62)
# What follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
# Code points worked on at a time.
PORTION = 1_000_000
# Distinct pre-tokens kept, some 60 bytes each; beyond it the store starts anew.
KEPT = 1_000_000


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary:
    itself where it is printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, extra = {}, 256
    for byte in range(256):
        if byte in plain:
            signs[byte] = chr(byte)
        else:
            signs[byte], extra = chr(extra), extra + 1
    return [signs[byte] for byte in range(256)]


class Merges:
    """The merge rules as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.made = made
        self.rank_of = ragged.Index(self._key(left, right))
        self.byte_ids = np.array([vocab[sign] for sign in byte_signs()], dtype=np.int64)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ragged.mix((left << 32 | right).astype(np.uint64))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, and the symbol it becomes."""
        rank = self.rank_of.find(self._key(left, right))
        return np.where(rank < 0, NO_RANK, rank), self.made[rank]

    def merge(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all sequences and where each begins. `begins` holds the end too;
        no sequence is empty."""
        n = len(begins) - 1
        ids = self.byte_ids[data]
        sequence = np.repeat(np.arange(n), np.diff(begins))
        last = np.zeros(len(ids), dtype=bool)
        last[begins[1:] - 1] = True
        rank, made = self._rank(ids, np.append(ids[1:], 0))
        rank[last] = NO_RANK
        sizes = np.zeros(n, dtype=np.int64)
        done_ids, done_sequences = [], []
        while len(ids):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(ids)))
            open_ = lowest < NO_RANK
            if not open_.all():
                # Sequences without a pair are finished and leave the arrays.
                stay = np.repeat(open_, length)
                done_ids.append(ids[~stay])
                done_sequences.append(sequence[~stay])
                ids, sequence, last = ids[stay], sequence[stay], last[stay]
                rank, made = rank[stay], made[stay]
                lowest, length = lowest[open_], length[open_]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, length))
            # Of hits in a row, as in "aaa", every second one counts.
            new_run = np.append(True, np.diff(hits) != 1)
            run_start = hits[new_run][np.cumsum(new_run) - 1]
            hits = hits[(hits - run_start) % 2 == 0]
            ids[hits] = made[hits]
            last[hits] = last[hits + 1]
            gone = np.zeros(len(ids), dtype=bool)
            gone[hits + 1] = True
            stay = ~gone
            at = (np.cumsum(stay) - 1)[hits]
            ids, sequence, last = ids[stay], sequence[stay], last[stay]
            rank, made = rank[stay], made[stay]
            # Only pairs that hold a merged symbol have another rank now.
            touched = np.concatenate((at, at[at > 0] - 1))
            rank[touched], made[touched] = self._rank(
                ids[touched], ids[np.minimum(touched + 1, len(ids) - 1)]
            )
            rank[last] = NO_RANK
        if done_ids:
            ids, sequence = np.concatenate(done_ids), np.concatenate(done_sequences)
            order = np.argsort(sequence, kind="stable")
            ids = ids[order]
            sizes = np.bincount(sequence, minlength=n)
        return ids, np.concatenate(([0], np.cumsum(sizes)))


class Encoder:
    """Token ids of texts, as the tokenizers library gives them for the same
    byte-level vocabulary file without added special tokens. Strings of special
    tokens inside a text are these tokens, or plain text without `specials`."""

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        # The class of a code point is asked of the splitter itself, once.
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        added = {t["content"]: t["id"] for t in stored["added_tokens"]} if specials else {}
        longest_first = sorted(added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if added else None
        self.special_ids = added
        self._forget()

    def _forget(self) -> None:
        """An empty store, but for the special tokens, which come first."""
        self.special_at = {text: i for i, text in enumerate(self.special_ids)}
        self.store = ragged.Index()
        self.pool = np.array(list(self.special_ids.values()), dtype=np.uint32)
        self.begins = np.arange(len(self.pool) + 1)

    def _classify(self, codes: np.ndarray) -> None:
        for code in np.unique(codes).tolist():
            sign = chr(code)
            probes = ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
            kinds = [kind for kind, before in probes if len(self.split(before + sign)) == 1]
            self.classes[code] = kinds[0] if kinds else SPACE

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.classes[codes]
        unknown = kinds == UNKNOWN
        if unknown.any():
            self._classify(codes[unknown])
            kinds = self.classes[codes]
        return kinds

    def _pretokens(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens. `ends` are places of a sign that
        closes a text and belongs to none."""
        kinds = self._kinds(codes)
        kinds[ends] = END
        start = np.append(True, kinds[1:] != kinds[:-1])
        start[ends] = True
        # The last of some white space stands alone, or before the next run if
        # it is a blank; at the end of a text all of it is one.
        before_run = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != END))
        start[before_run] = True
        start[before_run[codes[before_run] == ord(" ")] + 1] = False
        quotes = np.flatnonzero((codes == ord("'")) & start & (kinds == OTHER))
        for tail in CONTRACTIONS:
            places = quotes[quotes + len(tail) < len(codes)]
            same = np.ones(len(places), dtype=bool)
            for i, sign in enumerate(tail, 1):
                same &= (codes[places + i] == ord(sign)) & (kinds[places + i] != END)
            places = places[same]
            start[places + 1] = False
            start[places + 1 + len(tail)] = True
        places = np.flatnonzero(start)
        real = kinds[places] != END
        stops = np.append(places[1:], len(codes))
        return places[real], stops[real]

    def _entries(self, codes: np.ndarray, text: str, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Where the ids of each pre-token are in the store."""
        hashes = ragged.span_hashes(codes, starts, stops)
        entries = self.store.find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            pieces = [text[a:b].encode("utf-8") for a, b in zip(starts[first].tolist(), stops[first].tolist())]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            ids, begins = self.merges.merge(data, np.concatenate(([0], np.cumsum(sizes))))
            self.store.add(new, np.arange(len(new)) + len(self.begins) - 1)
            self.begins = np.concatenate((self.begins, begins[1:] + len(self.pool)))
            self.pool = np.concatenate((self.pool, ids.astype(np.uint32)))
            entries[missing] = self.store.find(hashes[missing])
        return entries

    def _portion(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Store entries of all tokens of all texts, and where each text begins."""
        segments, owners, specials = [], [], []
        for i, text in enumerate(texts):
            found = self.special.findall(text) if self.special else ()
            parts = self.special.split(text) if found else (text,)
            for j, part in enumerate(parts):
                segments.append(part)
                owners.append(i)
                if j < len(found):
                    specials.append((len(segments), self.special_at[found[j]]))
        text = "\0".join(segments) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
        starts, stops = self._pretokens(codes, ends)
        entries = self._entries(codes, text, starts, stops)
        # First token of each segment, and of each text.
        firsts = np.concatenate(([0], np.searchsorted(starts, ends)))
        owners = np.array(owners)
        text_firsts = firsts[np.searchsorted(owners, np.arange(len(texts) + 1))]
        if specials:
            segment, entry = map(np.array, zip(*specials))
            entries = np.insert(entries, firsts[segment], entry)
            text_firsts = text_firsts + np.searchsorted(
                owners[segment - 1], np.arange(len(texts) + 1)
            )
        return entries, text_firsts

    def portions(self, texts: list[str]):
        """Portions of `texts` as (first text, entries, first entry of each text)."""
        sizes = np.concatenate(([0], np.cumsum([len(text) for text in texts], dtype=np.int64)))
        for first, last in ragged.portions(sizes, PORTION):
            if self.store.count > KEPT:
                self._forget()
            yield first, *self._portion(texts[first:last])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text: symbols that survive all merges."""
        counts = [
            ragged.sums_by(np.diff(self.begins)[entries], firsts)
            for _, entries, firsts in self.portions(texts)
        ]
        return np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def encode(self, texts: list[str]):
        """Per portion its first text, the ids of its texts one after the other,
        and where each text begins."""
        for first, entries, firsts in self.portions(texts):
            sizes = np.diff(self.begins)[entries]
            ids = self.pool[ragged.ranges(self.begins[entries], sizes)]
            edges = np.concatenate(([0], np.cumsum(sizes)))
            yield first, ids, edges[firsts]
