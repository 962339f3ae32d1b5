"""Encoding texts by a byte-level BPE tokenizer, each distinct word once.

Byte-level BPE cuts a text into pre-tokens before merging, and a pre-token never spans a space followed by a
visible character: the space opens the next pre-token, and a run of white space before it ends there. Nor does
it span a letter followed by a punctuation mark. So texts may be cut at these places, and equal pieces get equal
ids. The string of a special token is a piece of its own, as the tokenizer takes it out before all else. A worker encodes a
piece when it first meets it and keeps its ids; all else is array arithmetic. ``tests/llm`` compares this with plain encoding.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from hostloom.llm.text import span_hashes

CACHED_PIECES = 1_000_000

# Bytes after a space at which a text is not cut: white space, control characters, and the first
# bytes of the characters beyond ASCII that count as white space.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[:0x21] = True
_NO_CUT[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# A letter ends a pre-token in front of a punctuation mark other than the apostrophe.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class _Pool:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 16, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given spans, one span after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


class Encoder:
    """Ids of texts, as the ``tokenizers`` library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        longest = sorted(added, key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in longest)) if added else None
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.ids, self.bytes = _Pool(self.dtype), _Pool(np.uint8)
        # Of every known piece: place and length of its ids and of its bytes.
        self.id_start, self.id_count, self.byte_start, self.byte_count = (_Pool(np.int64) for _ in range(4))
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode pieces; their numbers."""
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        first = self.id_start.used
        self.id_start.extend(self.ids.used + np.cumsum(counts) - counts)
        self.id_count.extend(counts)
        self.ids.extend(np.fromiter(chain.from_iterable(lists), self.dtype, int(counts.sum())))
        lengths = ends - starts
        self.byte_start.extend(self.bytes.used + np.cumsum(lengths) - lengths)
        self.byte_count.extend(lengths)
        self.bytes.extend(data[_spread(starts, lengths)])
        return np.arange(first, first + len(pieces))

    def _known(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of pieces with distinct, sorted hashes. Equal hashes are not taken on trust."""
        if len(self.hashes) > CACHED_PIECES:
            self._forget()
        place = np.searchsorted(self.hashes, hashes)
        near = np.minimum(place, max(len(self.hashes) - 1, 0))
        there = self.hashes[near] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        numbers = np.full(len(hashes), -1)
        numbers[there] = self.numbers[near[there]]
        lengths, known = (ends - starts)[there], numbers[there]
        same = self.byte_count.data[known] == lengths
        if same.all():
            equal = data[_spread(starts[there], lengths)] == self.bytes.data[_spread(self.byte_start.data[known], lengths)]
            if not equal.all():
                same = np.logical_and.reduceat(equal, np.cumsum(lengths) - lengths)
        numbers[np.flatnonzero(there)[~same]] = -1
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._learn(data, starts[new], ends[new])
            added = new[~there[new]]
            self.hashes = np.insert(self.hashes, place[added], hashes[added])
            self.numbers = np.insert(self.numbers, place[added], numbers[added])
        return numbers

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where strings of special tokens lie, each inside one text."""
        spans: list[tuple[int, int]] = []
        raw = data.tobytes()
        found = self.special.search(raw) if self.special else None
        while found:
            start, end = found.span()
            inside = np.searchsorted(offsets, start, side="right") == np.searchsorted(offsets, end - 1, side="right")
            if inside:
                spans.append((start, end))
            found = self.special.search(raw, end if inside else start + 1)
        return spans

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Number of every piece, and each text's first piece."""
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & ~_NO_CUT[data[1:]]
        cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        for start, end in self._special_spans(data, offsets):
            cut[start:end] = False
            cut[[start, end]] = True
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = np.unique(
            span_hashes(data, starts, ends), return_index=True, return_inverse=True
        )
        stands, lengths = first[inverse], ends - starts
        same = np.array_equal(lengths, lengths[stands]) and np.array_equal(data[_spread(starts[stands], lengths)], data)
        if same:
            numbers = self._known(hashes, data, starts[first], ends[first])[inverse]
        else:  # two different pieces of this chunk share a hash
            numbers = self._learn(data, starts, ends)
        return numbers, np.searchsorted(starts, offsets)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of every text."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        pieces, first = self._pieces(data, offsets)
        total = np.concatenate(([0], np.cumsum(self.id_count.data[pieces])))
        return np.diff(total[first])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None):
        """Ids of all texts one after the other, each followed by ``end_id``, and each text's offset."""
        if len(data):
            pieces, first = self._pieces(data, offsets)
            lengths = self.id_count.data[pieces]
            total = np.concatenate(([0], np.cumsum(lengths)))
            ids = self.ids.data[_spread(self.id_start.data[pieces], lengths)]
            bounds = total[first]
        else:
            ids, bounds = np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        if end_id is None:
            return ids, bounds
        out = np.full(len(ids) + len(offsets) - 1, end_id, self.dtype)
        texts = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        out[np.arange(len(ids)) + texts] = ids
        return out, bounds + np.arange(len(offsets))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
