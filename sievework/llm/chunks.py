"""BPE encoding and decoding with content-defined chunks (operator 7).

A rolling hash over the last bytes says where a text is cut, so that equal
passages fall into equal chunks wherever they stand. What a chunk encodes to
is kept in a bounded cache of the worker: a chunk shared by documents is
encoded once there. Then the joins are repaired: a window around each, from
the last whole pieces of the chunk before it to the first ones of the chunk
after it, is encoded again, and its first and last piece must have the ids
that the chunks have for them; from there on the ids agree with those of the
whole text. A window that does not agree grows to the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import own_name, ship, tidy

WINDOW = 16  # bytes that the rolling hash sees; a power of two
MASK_BITS = 11  # one byte in 2**11 is a cut
LEAST_BYTES = 128
PIECES = 3  # sure cuts that a chunk must have inside, so that the windows of its two joins don't meet
CACHE_BYTES = 16 << 20  # of each of the cache's two generations
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the WINDOW bytes that end there."""
    h, step = _GEAR[buf], 1
    while step < WINDOW:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    return h


def cuts(buf: np.ndarray, ends: np.ndarray, sure: np.ndarray, whole: set[int] = frozenset()) -> list[list[int]]:
    """Where the chunks of each text start and end, in bytes.

    Cuts are between characters, by the bytes before them alone. One is left
    out where a chunk beside it would be short, or would have fewer than PIECES
    of the `sure` places where pieces start; so are all cuts of `whole` texts.
    """
    at = np.flatnonzero(gear(buf) >> np.uint32(32 - MASK_BITS) == 0) + 1
    at = at[at < len(buf)]
    while len(late := np.flatnonzero(buf[at] & 0xC0 == 0x80)):  # to the start of a character
        at[late] += 1
        at = at[at < len(buf)]
    at = np.unique(at)
    before = np.searchsorted(sure, at)  # sure places before each cut
    low, high = np.searchsorted(at, ends[:-1] + max(WINDOW, LEAST_BYTES)), np.searchsorted(at, ends[1:] - LEAST_BYTES)
    first, last = np.searchsorted(sure, ends[:-1], side="right"), np.searchsorted(sure, ends[1:])
    at, before = at.tolist(), before.tolist()
    out = []
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        own, seen = [a], int(first[k])
        if k not in whole:
            for i in range(int(low[k]), int(high[k])):
                after = before[i + 1] if i + 1 < int(high[k]) else int(last[k])
                if at[i] - own[-1] >= LEAST_BYTES and before[i] - seen >= PIECES and after - before[i] > PIECES:
                    own.append(at[i])
                    seen = before[i] + 1  # a sure place at the cut itself does not count
        out.append([*own, b] if b > a else [a])
    return out


class Chunk:
    """Ids, and the number of them up to the start and the end of the second piece, and of the last piece but one."""

    __slots__ = ("ids", "head", "second", "tail", "last")

    def __init__(self, ids, head, second, tail, last):
        self.ids, self.head, self.second, self.tail, self.last = ids, head, second, tail, last


class Reuse:
    """Chunks by their bytes, in two generations: what was not asked for again goes first."""

    def __init__(self, coder: bpe.Encoder, most: int = CACHE_BYTES):
        self.coder, self.most, self.young, self.old, self.size = coder, most, {}, {}, 0
        self.hits = self.misses = self.hit_bytes = self.bytes = 0

    def get(self, texts: list[bytes]) -> list[Chunk]:
        """The chunks of these texts; those that aren't there are encoded together, each once."""
        found: dict[bytes, Chunk | None] = {}
        for t in texts:
            self.bytes += len(t)
            if t in found:
                self.hits += 1
                self.hit_bytes += len(t)
                continue
            c = self.young.get(t) or self.old.get(t)
            found[t] = c
            if c is None:
                self.misses += 1
            else:
                self.hits += 1
                self.hit_bytes += len(t)
        new = [t for t, c in found.items() if c is None]
        for t, c in zip(new, self._encode(new), strict=True):
            found[t] = c
        for t, c in found.items():
            if t not in self.young and len(t) < self.most // 64:
                self.size += len(t) + c.ids.nbytes + 300
                self.young[t] = c
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        return [found[t] for t in texts]

    def _encode(self, texts: list[bytes]):
        ends = np.cumsum([0, *map(len, texts)])
        ids, start, count, bounds = self.coder.pieces(np.frombuffer(b"".join(texts), np.uint8), ends)
        total = np.concatenate([[0], np.cumsum(count)])
        first = np.searchsorted(start, ends)
        for k in range(len(texts)):
            a, b, zero = first[k], first[k + 1], bounds[k]
            at = [int(total[min(max(x, a), b)] - zero) for x in (a + 1, a + 2, b - 2, b - 1)]
            yield Chunk(ids[zero : bounds[k + 1]].copy(), *at)


def encode(cache: Reuse, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a slice, from chunks, and where each text's ids start and end."""
    coder = cache.coder
    if not coder.splits or not len(buf):
        return coder.encode(buf, ends)
    raw = buf.tobytes()
    whole = {k for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if any(x in raw[a:b] for x in coder.added)} if any(x in raw for x in coder.added) else set()
    sure = np.flatnonzero(bpe.cut_places(buf))
    places = cuts(buf, ends, sure, whole)
    parts = cache.get([raw[a:b] for own in places for a, b in zip(own, own[1:], strict=False)])
    joins = np.array([x for own in places for x in own[1:-1]], np.int64)
    # A window has two pieces on each side; the outer ones must have the ids that they have in the chunks.
    low, high = sure[np.searchsorted(sure, joins) - 2], sure[np.searchsorted(sure, joins, side="right") + 1] if len(joins) else joins
    sizes = high - low
    window_ids, at = coder.encode(bpe.gather(buf, low, sizes), np.concatenate([[0], np.cumsum(sizes)]))
    out, total, bounds, seam, n = [np.empty(0, coder.code)], 0, [0], 0, 0
    for k, own in enumerate(places):
        texts_parts = []
        chunks = parts[n : n + len(own) - 1]
        n += len(chunks)
        agreed = True
        for i, c in enumerate(chunks):
            first, last = i == 0, i + 1 == len(chunks)
            texts_parts.append(c.ids[0 if first else c.second : len(c.ids) if last else c.tail])
            if not last:
                w, right = window_ids[at[seam] : at[seam + 1]], chunks[i + 1]
                left_ids, right_ids = c.ids[c.tail : c.last], right.ids[right.head : right.second]
                agreed &= w[: len(left_ids)].tobytes() == left_ids.tobytes() and w[len(w) - len(right_ids) :].tobytes() == right_ids.tobytes()
                texts_parts.append(w)
                seam += 1
        if not agreed:
            texts_parts = [np.array(coder.whole(raw[own[0] : own[-1]].decode()), coder.code)]
        out += texts_parts
        total += sum(map(len, texts_parts))
        bounds.append(total)
    return np.concatenate(out), np.array(bounds)


_CACHES: dict[str, Reuse] = {}


def _cache(path: str) -> Reuse:
    if path not in _CACHES:
        _CACHES[path] = Reuse(bpe.encoder(path))
    return _CACHES[path]


def round_trip(column: pa.Array, path: str):
    """Slices of a string column, as (from, to, ids, bounds, decoded, bounds): a null text is an empty one."""
    cache = _cache(path)
    buf, ends = bpe.utf8(column)
    for a, b in bpe.slices(ends):
        ids, bounds = encode(cache, buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        if cache.coder.splits:
            yield a, b, ids, bounds, *cache.coder.decode(ids, bounds)
        else:
            back = [cache.coder.tokenizer.decode(ids[x:y].tolist(), skip_special_tokens=False).encode() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield a, b, ids, bounds, np.frombuffer(b"".join(back), np.uint8), np.cumsum([0, *map(len, back)])


def _hashes(buf: np.ndarray, bounds: np.ndarray, last: int = 0) -> pa.Array:
    """The sha256 of each stretch without its `last` bytes."""
    return pa.array([hashlib.sha256(buf[a : max(a, b - last)]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", digests: bool = True) -> DataFrame:
    """docs with what their texts encode to and decode to again.

    Adds n_tokens, and ids_sha256 and decoded_sha256 (of the comma-joined
    decimal ids and of the decoded UTF-8) or, without `digests`, ids
    (array<int>) and decoded. A null or empty text has no ids and decodes to
    the empty text. Repeated rows stay; other columns stay as they are, and
    columns of docs with the names of added ones give way to these; an empty
    table stays empty. A text of any length is encoded whole. Memory holds one
    slice of a batch besides the batch.
    """
    ship(docs.sparkSession)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    made = [x.split()[0] for x in schema.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(own := own_name(docs, "_text")))
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema), schema])

    def run(batches):
        for batch in batches:
            for a, b, ids, bounds, decoded, ends in round_trip(batch.column(own), tokenizer):
                left = [batch.column(c)[a:b] for c in keep]
                if digests:
                    decimal, at = bpe.encoder(tokenizer).decimals(ids, bounds)
                    more = [_hashes(decimal, at, 1), _hashes(decoded, ends)]
                else:
                    more = [
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.StringArray.from_buffers(b - a, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(decoded))),
                    ]
                yield pa.RecordBatch.from_arrays([*left, pa.array(np.diff(bounds)), *more], names=[*keep, *made])

    return docs.mapInArrow(tidy(run), full)
