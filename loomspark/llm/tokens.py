"""Token ids of whole Arrow batches.

For a byte-level tokenizer with the usual pattern, texts are cut where the pattern cuts them whatever
comes before and behind: between letters, digits, punctuation and white space as far as their class
is plain from the bytes. The ids of a text are then those of its pieces in a row. Pieces are found,
hashed and compared as bytes in numpy; each different piece is encoded once for as long as it stays
in a worker's table. For any other tokenizer whole texts are encoded.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from .words import U, blocks, blocks_hash

#: Pieces that a worker remembers; the table is emptied when it is full.
REMEMBERED = 1 << 17
_SLOT_BITS = 18
_SLOTS = 1 << _SLOT_BITS
#: Bytes of text to encode at once: what numpy holds for them is some 80 times as much.
CHUNK = 1 << 18

# Classes of characters; OTHER is what the first bytes don't tell, DARK is no white space for sure.
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, BLANK, FEED, DARK = range(8)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[39, 32]] = APOSTROPHE, BLANK
_CLASS[9:14] = FEED
#: First bytes of two-byte characters that are all letters (C3 but for two of them), and of longer ones without white space.
_TWO, _LONG = np.zeros(256, bool), np.zeros(256, bool)
_TWO[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
_LONG[[*range(0xE4, 0xEF), 0xF0]] = True
#: Whether there is a cut between two classes.
_CUT = np.zeros((8, 8), bool)
_CUT[np.ix_([LETTER, DIGIT, MARK, APOSTROPHE, DARK], [BLANK, FEED])] = True
_CUT[LETTER, [DIGIT, MARK, APOSTROPHE]] = True
_CUT[DIGIT, [LETTER, MARK, APOSTROPHE]] = True
_CUT[MARK, [LETTER, DIGIT]] = True
_CUT[APOSTROPHE, DIGIT] = True
_CUT[FEED, [LETTER, DIGIT, MARK, APOSTROPHE, DARK]] = True
_CUT = _CUT.ravel()
#: What the cuts need of a tokenizer file.
_PATTERN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character of each byte."""
    kind = _CLASS[data]
    high = np.flatnonzero(data >= 0xC2)
    if len(high):
        lead = data[high]
        after = lambda j: data[np.minimum(high + j, len(data) - 1)]
        two = high[_TWO[lead] & ~((lead == 0xC3) & np.isin(after(1), (0x97, 0xB7)))]
        kind[two] = kind[two + 1] = LETTER
        dash = (lead == 0xE2) & (after(1) == 0x80) & (after(2) >= 0x90) & (after(2) < 0xA8)  # dashes, quotes, bullets
        for j in range(3):
            kind[high[_LONG[lead] | dash] + j] = DARK
        kind[high[lead == 0xF0] + 3] = DARK
    return kind


def piece_starts(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte, from the classes of the bytes."""
    starts = np.zeros(len(kind) + 1, bool)
    starts[1:-1] = _CUT[(kind[:-1] << 3) | kind[1:]]
    # the last of several characters of white space goes apart, with what is behind it if it is a blank
    gap = (kind == BLANK) | (kind == FEED)
    dark = ~gap & (kind != OTHER)
    edge = np.zeros(len(kind) + 1, bool)
    edge[offsets] = True
    starts[2:-1] &= ~((kind[:-2] == OTHER) & (kind[1:-1] == FEED))  # what comes before may be white space too
    starts[1:-2] |= gap[:-2] & gap[1:-1] & dark[2:] & ~edge[2:-1]
    starts[offsets] = True
    return starts[:-1]


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE puts in place of each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Lists:
    """Arrays of different lengths, one behind the other."""

    def __init__(self, dtype):
        self.flat, self.at, self.n = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.at[self.n])
        if used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used + len(values), self.flat.dtype)])
        if self.n + len(sizes) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(self.n + len(sizes) + 1, np.int64)])
        self.flat[used : used + len(values)] = values
        self.at[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays ``which`` in a row, and their lengths."""
        size = self.at[which + 1] - self.at[which]
        ends = np.cumsum(size)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[which] - ends + size, size)], size


class Encoder:
    """Encodes with one tokenizer file; one for each worker process."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        plain = spec["normalizer"] is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.by_piece = plain and all(pre.get(k) == v for k, v in _PATTERN.items())
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def clear(self) -> None:
        self.table = np.full(_SLOTS, -1, np.int32)  # numbers of pieces, by hash and then the next free slot
        self.keys, self.bytes, self.ids = _Lists(U), _Lists(U), _Lists(np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, -1 for none."""
        at, found, left = (h >> U(64 - _SLOT_BITS)).astype(np.int64), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(left):
            k = self.table[at[left]]
            hit = (k >= 0) & (self.keys.flat[k] == h[left])
            found[left[hit]] = k[hit]
            left = left[(k >= 0) & ~hit]
            at[left] = (at[left] + 1) & (_SLOTS - 1)
        return found

    def _learn(self, h: np.ndarray, eights: np.ndarray, counts: np.ndarray, pieces: list[bytes], whole: np.ndarray) -> None:
        """Enter new pieces, whose hashes differ from each other and from those known; those that are
        ``whole`` have one class of characters, so they go to the merges as they are."""
        number = self.keys.n + np.arange(len(h))
        self.keys.add(h, np.ones(len(h), np.int64))
        self.bytes.add(eights, counts)
        got = [[t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.letters))] if w else None for p, w in zip(pieces, whole.tolist())]
        rest = np.flatnonzero(~whole).tolist()
        for i, ids in zip(rest, self._encoded([pieces[i].decode() for i in rest])):
            got[i] = ids
        self.ids.add(np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))
        at, left = (h >> U(64 - _SLOT_BITS)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.table[at[left]] < 0]
            slots, first = np.unique(at[free], return_index=True)
            self.table[slots] = number[free[first]]
            left = np.setdiff1d(left, free[first], assume_unique=True)
            at[left] = (at[left] + 1) & (_SLOTS - 1)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8 in ``data`` between ``offsets``) in a row, and the number of ids of each."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if not self.by_piece:
            got = self._encoded([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])])
            return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        kind = classes(data)
        starts = piece_starts(kind, offsets)
        special = np.zeros(len(data), bool)
        for token in self.added:  # a text with an added token stays in one piece
            at, blob = -1, data.tobytes()
            while (at := blob.find(token, at + 1)) >= 0:
                k = np.searchsorted(offsets, at, "right")
                starts[offsets[k - 1] + 1 : offsets[k]] = False
                special[offsets[k - 1]] = True
                at = int(offsets[k]) - 1
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(data))
        eights, nth, first = blocks(data, start, end)
        h, counts = blocks_hash(eights, nth, first, end - start), np.diff(np.append(first, len(eights)))
        if self.keys.n > REMEMBERED:
            self.clear()
        which = self._find(h)
        new = np.flatnonzero(which < 0)
        for i in range(0, len(new), REMEMBERED // 8):  # a bound on what one text adds before the next look
            part = new[i : i + REMEMBERED // 8]
            part = part[self._find(h[part]) < 0]
            one = part[np.unique(h[part], return_index=True)[1]]
            mine = np.arange(int(counts[one].sum())) + np.repeat(first[one] - np.cumsum(counts[one]) + counts[one], counts[one])
            if self.keys.n + len(one) > _SLOTS // 2 + REMEMBERED // 4:  # one text of very many different pieces
                return self._apart(data, offsets)
            odd = np.concatenate([[0], np.cumsum((kind == OTHER) | (kind == APOSTROPHE) | (kind == DARK) | (kind == FEED) | ((kind == BLANK) & ~starts))])
            self._learn(h[one], eights[mine], counts[one], [data[start[k] : end[k]].tobytes() for k in one], (odd[end[one]] == odd[start[one]]) & (kind[end[one] - 1] != BLANK) & ~special[start[one]])
        which[new] = self._find(h[new])
        ids, size = self.ids.take(which)
        # what has the same hash must be the same bytes
        have, have_counts = self.bytes.take(which)
        same = np.array_equal(have_counts, counts) and np.array_equal(have, eights)
        if not same:
            return self._apart(data, offsets)
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(ends[np.searchsorted(start, offsets)])

    def _apart(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that the table doesn't serve: each text as a whole."""
        self.clear()
        got = self._encoded([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])])
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))


def default_tokenizer() -> str:
    """The public tokenizer file that queries and pipeline use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
