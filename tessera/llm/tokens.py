"""Exact token ids of whole texts with a public tokenizer, and a memo for its pieces.

The tokenizer drops white space and splits what is left into runs of letters, single digits and runs of other
signs, each of which it encodes alone; letters are lower-cased first.  Corpus words repeat, so a block of
texts is cut into such pieces with NumPy, pieces are hashed, and only pieces that the memo doesn't hold go
through the model.  Stretches with anything that needs the tokenizer's own rules (apostrophes, ``<``,
control characters, letters outside Latin-1) go through the tokenizer whole.  The memo has a fixed number of
entries, whatever the input's size.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np

from tessera.llm.textblocks import BLOCK_BYTES, SPACE, mix, prefix_hashes, runs, span_hashes

assert sys.byteorder == "little" and array("I").itemsize == 4

#: Pieces that a worker process remembers: about 35 bytes each.
MEMO_ENTRIES = 500_000
_LETTER, _SIGN, _DIGIT, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[39, 60]] = _ODD  # ' begins contractions, < begins special tokens
_KIND[SPACE] = 0
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _alphabet() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 up, in order."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    others = sorted(set(range(256)) - plain)
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _alphabet()
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _piece(self, raw: bytes) -> list[int]:
        text = raw.decode("ascii") if raw.isascii() else "".join([self.alphabet[b] for b in raw])
        return [t.id for t in self.model.tokenize(text)]

    def _learn(self, where: np.ndarray, hashes: np.ndarray, pieces: list[bytes], odd: list[bool]) -> None:
        ids, at = array("I"), [0]
        for raw, whole in zip(pieces, odd):
            ids.extend(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids if whole else self._piece(raw))
            at.append(len(ids))
        bounds = np.array(at, np.int64)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(ids) + len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = np.frombuffer(ids, np.uint32)
        self.hashes = np.insert(self.hashes, where, hashes)
        self.at = np.insert(self.at, where, bounds[:-1] + self.used)
        self.length = np.insert(self.length, where, np.diff(bounds))
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (uint32) of the texts data[offsets[i]:offsets[i+1]], end to end, and their offsets.

        A block's one long text is cut at white space, where the tokenizer cuts it, too.
        """
        n, parts, a = len(data), [], 0
        if n <= 2 * BLOCK_BYTES or len(offsets) > 2:
            return self._block(data, offsets)
        while a < n:
            b = min(a + BLOCK_BYTES, n)
            spaces = np.flatnonzero(SPACE[data[a:b]])
            if b < n and len(spaces):
                b = a + int(spaces[-1]) + 1
            while b < n and not SPACE[data[b - 1]]:  # a stretch without white space stays whole
                more = np.flatnonzero(SPACE[data[b : b + BLOCK_BYTES]])
                b = b + int(more[0]) + 1 if len(more) else min(b + BLOCK_BYTES, n)
            parts.append(self._block(data[a:b], np.array([0, b - a]))[0])
            a = b
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind, low = _KIND[data], _LOW[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] |= np.where(data[lead + 1] != 0x9F, 0x20, 0).astype(np.uint8)
        solid = kind != 0
        first, last = runs(solid, offsets)
        begin = np.zeros(n + 1, bool)
        begin[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begin[:n] &= solid
        begin[first] = True
        strange = np.zeros(n, bool)
        if (kind == _ODD).any():
            total = np.concatenate([[0], np.cumsum(kind == _ODD)])
            bad = np.flatnonzero(total[last] > total[first])
            edge = np.zeros(n + 1, np.int8)
            np.add.at(edge, first[bad], 1)
            np.add.at(edge, last[bad], -1)
            strange = np.cumsum(edge[:n]).astype(bool)
            begin[:n] &= ~strange
            begin[first[bad]] = True
            low[strange] = data[strange]
        start = np.flatnonzero(begin)
        end = np.minimum(np.append(start[1:], n), last[np.searchsorted(first, start, "right") - 1])
        own = span_hashes(prefix_hashes(low), start, end)
        own[strange[start]] = mix(own[strange[start]] + np.uint64(1))
        keys, example, which = np.unique(own, return_index=True, return_inverse=True)
        if len(self.hashes) + len(keys) > MEMO_ENTRIES:
            self.forget()
        where = np.searchsorted(self.hashes, keys)
        new = np.ones(len(keys), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(where, len(self.hashes) - 1)] != keys
        if new.any():
            raw, e = low.tobytes(), example[new]
            self._learn(where[new], keys[new], [raw[a:b] for a, b in zip(start[e].tolist(), end[e].tolist())], strange[start[e]].tolist())
            where = np.searchsorted(self.hashes, keys)
        length, at = self.length[where][which], self.at[where][which]
        done = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(at - done[:-1], length) + np.arange(done[-1])]
        return ids, done[np.searchsorted(start, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that its tasks share the memo."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
