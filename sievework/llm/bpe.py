"""Byte-level BPE over whole slices of texts: the same ids as the tokenizers library gives for each text.

A byte-level pre-tokenizer never joins what stands before a white-space
character to that character unless that, too, is white space. So a text can be
cut before each such character, and what a cut-off piece encodes to does not
depend on its surroundings. Most pieces are words that come again and again.
The pieces of a slice are found at once in its UTF-8 bytes; pieces of up to 15
bytes are two 64-bit numbers, looked up by numpy in an open-addressing table
of a fixed size, and new ones go to the library many at a time.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

# Unicode white space, and the split pattern of byte-level BPE vocabularies.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_TOKEN = regex.compile(SPLIT)
SLICE = 1 << 19  # bytes of text that are encoded at once
SHORT = 15  # bytes of a piece that fits the table
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
MOST_PIECES = 1 << 20  # in the table, before a slice that has at most SLICE / 2 pieces
TOGETHER = 4096  # new pieces that the library encodes in one call
MEMO_BYTES = 8 << 20  # of the long pieces, and of the tokens, that are remembered

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(0x09, 0x0E), 0x20]] = True
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], np.uint64)
_HIGH = np.array([(1 << 8 * max(0, n - 8)) - 1 for n in range(SHORT + 1)], np.uint64)


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its texts start and end; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    return buf, ends - ends[0]


def slices(ends: np.ndarray, limit: int = SLICE):
    """(from, to) of texts so that each slice has at most `limit` bytes or is one text."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def cut_places(buf: np.ndarray) -> np.ndarray:
    """At which bytes does ASCII white space follow something that is not white space of any kind?"""
    space = _IS_SPACE[buf]
    out = np.zeros(len(buf), bool)
    if len(buf) > 1:
        last = space[:-1].copy()
        high = buf >= 0x80
        if high.any():
            last |= _odd_space_ends(buf)[:-1]
        out[1:] = space[1:] & ~last
    return out


def _odd_space_ends(buf: np.ndarray) -> np.ndarray:
    """The last bytes of white-space characters beyond ASCII."""
    out = np.zeros(len(buf), bool)
    two = np.flatnonzero(buf[:-1] == 0xC2)
    two = two[(buf[two + 1] == 0x85) | (buf[two + 1] == 0xA0)]
    out[two + 1] = True
    three = np.flatnonzero((buf[:-2] >= 0xE1) & (buf[:-2] <= 0xE3))
    if len(three):
        a, b, c = buf[three].astype(int), buf[three + 1], buf[three + 2]
        odd = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        out[three[odd] + 2] = True
    return out


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches pool[start : start + size], one after the other."""
    total = np.cumsum(size)
    n = int(total[-1]) if len(total) else 0
    return pool[np.repeat(start - (total - size), size) + np.arange(n)]


class _Memo(dict):
    """Remembers what `make` gives for strings; starts anew when it has about `most` bytes."""

    def __init__(self, make, most: int = MEMO_BYTES):
        super().__init__()
        self.make, self.most, self.size = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        cost = 2 * len(key) + len(value) + 200
        if cost < self.most // 64:
            self.size += cost
            if self.size > self.most:
                self.clear()
                self.size = cost
            self[key] = value
        return value


class Table:
    """What short pieces encode to: slot of a piece -> place and number of its ids in a pool."""

    def __init__(self, code: str):
        self.keys = np.zeros((SLOTS, 2), np.uint64)  # the second is never 0 for a piece
        self.where = np.zeros(SLOTS, np.int64)  # place << 8 | number of ids
        self.pool = np.zeros(1 << 16, code)
        self.used = self.pieces = 0

    def clear(self) -> None:
        self.keys[:] = 0
        self.used = self.pieces = 0

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        x = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 where it is not in the table."""
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where((there == keys).all(axis=1), at, -1)
        left = np.flatnonzero((out < 0) & (there[:, 1] != 0))
        while len(left):
            at[left] = (at[left] + 1) & (SLOTS - 1)
            there = self.keys[at[left]]
            good = (there == keys[left]).all(axis=1)
            out[left[good]] = at[left[good]]
            left = left[~good & (there[:, 1] != 0)]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Different new pieces, with the ids of all and each one's number of them."""
        where = (self.used + np.cumsum(count) - count) << 8 | count
        self.put(self.used, ids)
        self.used += len(ids)
        self.pieces += len(keys)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left], 1] == 0
            self.keys[at[left[free]]] = keys[left[free]]  # of several the last one stays
            mine = (self.keys[at[left]] == keys[left]).all(axis=1)
            self.where[at[left[mine]]] = where[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & (SLOTS - 1)

    def put(self, at: int, ids) -> None:
        while at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[at : at + len(ids)] = ids


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        conf = json.loads(self.tokenizer.to_str())
        added = [x["content"] for x in conf["added_tokens"]]
        pre = conf["pre_tokenizer"] or {}
        #: Can texts be cut into pieces? Else the library encodes whole texts.
        self.splits = (
            conf["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and conf["model"]["type"] == "BPE"
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in conf["added_tokens"])
            and not any(c in x for x in added for c in SPACE)
        )
        self.added = [x.encode() for x in added]
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.code = "H" if size <= 1 << 16 else "I"
        chars = byte_chars()
        self._to_chars = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        own = [b""] * size
        for token, i in vocab.items():
            own[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.token_size = np.array([len(x) for x in own], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(own), np.uint8)
        digits = [f"{i},".encode() for i in range(size)]
        wide = len(digits[-1])
        self.digits = np.frombuffer(b"".join(x.ljust(wide) for x in digits), np.uint8).reshape(size, wide)
        self.digit_size = np.array([len(x) for x in digits], np.int64)
        self._tokens = _Memo(self._token)
        self._long = _Memo(self.piece)
        self.table = Table(self.code)

    def whole(self, text: str) -> array:
        """The ids of a text, by the library alone."""
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _token(self, token: str) -> array:
        if token.isascii() and token.isprintable():
            chars = token.replace(" ", self._to_chars[32])
        else:
            chars = token.encode().decode("latin-1").translate(self._to_chars)
        return array(self.code, [x.id for x in self.model.tokenize(chars)])

    def piece(self, piece: bytes) -> array:
        """The ids of a piece that is cut off at sure places."""
        text = piece.decode()
        if max(text) >= chr(0x250):
            return self.whole(text)
        out = array(self.code)
        for token in _TOKEN.findall(text):
            out += self._tokens[token]
        return out

    def encode(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, and where each text's ids start and end."""
        ids, _, _, bounds = self.pieces(buf, ends)
        return ids, bounds

    def pieces(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, the pieces' first bytes, their numbers of ids, and where each text's ids start and end."""
        n = len(buf)
        if not n:
            return np.empty(0, self.code), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(ends), np.int64)
        cut_here = cut_places(buf) if self.splits else np.zeros(n, bool)
        cut = cut_here.copy()
        cut[ends[:-1][ends[:-1] < n]] = True
        raw = buf.tobytes()
        whole = set()
        if not self.splits or any(x in raw for x in self.added):
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if b > a and (not self.splits or any(x in raw[a:b] for x in self.added)):
                    cut[a + 1 : b] = False
                    whole.add(a)
        start = np.flatnonzero(cut)
        size = np.diff(start, append=n)
        table = self.table
        if table.pieces > MOST_PIECES:
            table.clear()
        is_short = size <= SHORT
        if whole:
            is_short[np.searchsorted(start, sorted(whole))] = False
        place, count = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        short = np.flatnonzero(is_short)
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        view = np.ndarray((n + 9,), "<u8", buffer=padded, strides=(1,))
        own = size[short]
        keys = np.empty((len(short), 2), np.uint64)
        keys[:, 0] = view[start[short]] & _LOW[own]
        keys[:, 1] = view[start[short] + 8] & _HIGH[own] | own.astype(np.uint64) << np.uint64(56)
        at = table.find(keys)
        if len(missing := np.flatnonzero(at < 0)):
            order = missing[np.lexsort((keys[missing, 0], keys[missing, 1]))]
            first = np.ones(len(order), bool)
            first[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
            new = order[first]
            order, ids, counts = self._encode_new(buf, raw, cut_here, start[short[new]], own[new])
            table.add(keys[new[order]], ids, counts)
            at[missing] = table.find(keys[missing])
        place[short], count[short] = table.where[at] >> 8, table.where[at] & 255
        used = table.used
        for k in np.flatnonzero(~is_short).tolist():
            a, b = int(start[k]), int(start[k] + size[k])
            ids = self.whole(raw[a:b].decode()) if a in whole else self._long[raw[a:b]]
            table.put(used, ids)
            place[k], count[k] = used, len(ids)
            used += len(ids)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = gather(table.pool, place, count)
        if len(table.pool) > 1 << 24:  # a very long text: don't keep its room
            table.pool = table.pool[: max(1 << 16, table.used)].copy()
        return ids, start, count, total[np.searchsorted(start, ends)]

    def _encode_new(self, buf: np.ndarray, raw: bytes, cut: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In what order the pieces come, the ids of all, and each one's number of them.

        Pieces between two sure cuts are themselves text that can be cut
        between them, so the library encodes many of them in one call; the
        bytes of the tokens say where each piece ends.
        """
        end = start + size
        joins = cut[start] & (end < len(buf)) & cut[np.minimum(end, len(buf) - 1)]
        many, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        ids, counts = [np.empty(0, self.code)], [np.empty(0, np.int64)]
        for a in range(0, len(many), TOGETHER):
            some = many[a : a + TOGETHER]
            got = np.array(self.whole(gather(buf, start[some], size[some]).tobytes().decode()), self.code)
            ends, want = np.cumsum(self.token_size[got]), np.cumsum(size[some])
            at = np.searchsorted(ends, want)
            if not len(got) or at[-1] != len(got) - 1 or (ends[at] != want).any():
                raise ValueError("the vocabulary's tokens don't give the text back")
            ids.append(got)
            counts.append(np.diff(at, prepend=-1))
        for k in alone.tolist():
            ids.append(np.array(self.piece(raw[start[k] : end[k]]), self.code))
            counts.append(np.array([len(ids[-1])]))
        return np.concatenate([many, alone]), np.concatenate(ids), np.concatenate(counts)

    def ids(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of the texts that the ids stand for, special tokens too, and where they start and end."""
        size = self.token_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return gather(self.token_bytes, self.token_start[ids], size), total[bounds]

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids as decimals with a comma after each, and where each text's start and end."""
        size = self.digit_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.digits[ids][np.arange(self.digits.shape[1]) < size[:, None]], total[bounds]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: its table serves all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
