"""Token ids of whole texts, by the public word-level BPE vocabulary.

The vocabulary's tokenizer drops white space and splits a word into pieces
(letters, one digit, other signs) that tokens never cross.  So a text's ids are
its pieces' ids in order.  Pieces are found and looked up for a block of text
at once, in a bounded table of the worker process; only new pieces reach the
tokenizer.  Words that hold anything but ASCII and Latin-1 letters, digits and
plain signs (apostrophes among them) are one piece and go there as they are.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np

from marlstone.llm.hashing import _LOWER, _SPACE, U64, separated, span_hashes, text_blocks, word_blocks

VOCABULARY = "word_bpe_49k.json"
#: Pieces that a worker's table holds before it is begun anew.
KNOWN = 1_500_000

#: Classes of bytes: 0 white space, 1 letters, 2 digits, 3 plain signs, 4 a byte whose word stays whole.
_CLASS = np.full(256, 4, dtype=np.int8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[0x80:0xC0] = _CLASS[0xC3] = 1
_CLASS[39] = 4
_CLASS[np.flatnonzero(_SPACE)] = 0


def vocabulary_path(name: str) -> str:
    """A path as it is, a bare name among the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a block of UTF-8 text, and its bytes in lower case but for words that stay whole."""
    kind = _CLASS[raw]
    odd = kind == 4
    odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    odd[1:] |= (raw[:-1] == 60) & (raw[1:] == 124)  # a special token may begin here
    data = _LOWER[raw]
    if odd.any():
        word = np.cumsum(kind == 0)
        whole = np.zeros(int(word[-1]) + 1, dtype=bool)
        whole[word[odd]] = True
        whole = whole[word] & (kind != 0)
        kind[whole] = 4
        data[whole] = raw[whole]
    begins = np.ones(len(raw), dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(raw))
    real = kind[starts] != 0
    return starts[real], ends[real], data


class PieceTable:
    """Ids of pieces, by an open-addressed table of their 64-bit hashes."""

    def __init__(self, vocabulary: str = VOCABULARY, known: int = KNOWN):
        self.bpe, self.known = tokenizer(vocabulary), known
        self.bits = max(4, (2 * known).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=U64)
        self.slot = np.zeros(1 << self.bits, dtype=np.int32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.sizes = np.zeros(1 << 12, dtype=np.int32)
        self.flat = np.zeros(1 << 14, dtype=np.int32)
        self.n = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 for new ones."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        at = (hashes >> U64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            keys = self.keys[at[left]]
            hit = keys == hashes[left]
            out[left[hit]] = self.slot[at[left[hit]]]
            left = left[~hit & (keys != 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        at = (hashes >> U64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]] = hashes[won]
            self.slot[at[won]] = rows[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _grow(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), dtype=old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _learn(self, hashes: np.ndarray, names: list[str]) -> None:
        coded = [x.ids for x in self.bpe.encode_batch_fast(names, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        total, end = int(sizes.sum()), self.n + len(names)
        self._grow("starts", end)
        self._grow("sizes", end)
        self._grow("flat", self.used + total)
        self.starts[self.n : end] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : end] = sizes
        self.flat[self.used : self.used + total] = np.fromiter((i for x in coded for i in x), np.int32, total)
        self._put(hashes, np.arange(self.n, end))
        self.n, self.used = end, self.used + total

    def _rows(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a block's pieces, and where the pieces start."""
        starts, ends, data = pieces(raw)
        if not len(starts):
            return starts, starts
        hashes = span_hashes(data, starts, ends)
        hashes[hashes == 0] = 1
        rows = self.find(hashes)
        if (rows < 0).any():
            new, first = np.unique(hashes[rows < 0], return_index=True)
            if self.n + len(new) > self.known:
                self.clear()
                new, first = np.unique(hashes, return_index=True)
            else:
                first = np.flatnonzero(rows < 0)[first]
            self._learn(new, [data[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            rows = self.find(hashes)
        return rows, starts

    def encoded(self, column, want_ids: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """For each run of rows of an Arrow string column: the rows' numbers of ids, and the ids one after another.

        Runs hold one row where it is longer than a block, else about a block.
        """
        for _, _, raw, offsets in text_blocks(column):
            raw, offsets = separated(raw, offsets)
            counts, ids = np.zeros(len(offsets) - 1, dtype=np.int64), []
            for at, end in word_blocks(raw):
                rows, starts = self._rows(raw[at:end])
                sizes = self.sizes[rows].astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(sizes)])
                bounds = np.searchsorted(starts, offsets - at)
                counts += np.diff(sums[bounds])
                if want_ids:
                    ids.append(self.flat[np.repeat(self.starts[rows] - sums[:-1], sizes) + np.arange(sums[-1])])
            yield counts, (np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)) if want_ids else None

    def texts(self, column) -> Iterator[np.ndarray]:
        """Ids of each row."""
        for counts, ids in self.encoded(column):
            yield from np.split(ids, np.cumsum(counts)[:-1])

    def counts(self, column) -> np.ndarray:
        """Numbers of ids of all rows."""
        return np.concatenate([np.zeros(0, dtype=np.int64), *(c for c, _ in self.encoded(column, want_ids=False))])


@functools.lru_cache(maxsize=2)
def piece_table(vocabulary: str = VOCABULARY) -> PieceTable:
    """The table of this worker process; later tasks find it filled."""
    return PieceTable(vocabulary)
