"""Benchmark decontamination by pigeonhole edit matching (operator 6).

An item of n words may be changed by e = n * SHARE words. Cut into e + 1
pieces, at least one piece survives e edits unchanged; so exact hits of the
pieces find every candidate. Where a piece hits, the item is aligned with the
text around it and Myers' bit-parallel algorithm gives the edit distance of
the item to the closest stretch of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import grams, pieces, scratch, ship, tidy, word_hashes, written

SHARE = 0.15  # of an item's words that may be changed
GRAM = 5  # words of a piece that are looked up; shorter pieces are looked up whole
BLOCK_BYTES = 8 << 20  # of the items that are sent to the workers at once
SEEN_BYTES = 8 << 20  # of windows whose distances are remembered


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the whole pattern to any stretch of text, and where the first such stretch ends."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, w in enumerate(text.tolist(), 1):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Items:
    """The items' words, their edit budgets and their pieces, ready for search."""

    def __init__(self, ids: list, texts: list[str | None], share: float = SHARE):
        h, ends = word_hashes(texts)
        self.share = share
        self.items = [(i, h[a:b]) for i, a, b in zip(ids, np.concatenate([[0], ends[:-1]]), ends, strict=True) if b > a]
        self.budget = [int(len(w) * share) for _, w in self.items]
        #: For each number of words: the sorted hashes of pieces' first words, with (item, place) of each.
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for k, ((_, w), e) in enumerate(zip(self.items, self.budget, strict=True)):
            bounds = [len(w) * p // (e + 1) for p in range(e + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                n = min(GRAM, b - a)
                found.setdefault(n, []).append((int(grams(w[a : a + n], n)[0]), k, a, b - a))
        self.tables = {}
        for n, rows in found.items():
            rows.sort()
            self.tables[n] = (np.array([r[0] for r in rows], np.uint64), [r[1:] for r in rows])
        self.seen: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.seen_bytes = 0

    def _distance(self, k: int, window: np.ndarray) -> tuple[int, int]:
        key = (k, window.tobytes())
        if key not in self.seen:
            found = myers(self.items[k][1], window)
            if window.nbytes > SEEN_BYTES // 64:
                return found
            self.seen_bytes += window.nbytes + 200
            if self.seen_bytes > SEEN_BYTES:
                self.seen.clear()
                self.seen_bytes = window.nbytes + 200
            self.seen[key] = found
        return self.seen[key]

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text: item number -> (edit distance, word at which the closest stretch ends)."""
        h, ends = word_hashes(texts)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        candidates: set[tuple[int, int, int]] = set()
        for n, (keys, rows) in self.tables.items():
            g = grams(h, n)
            at = np.searchsorted(keys, g)
            hits = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == g)
            doc = np.searchsorted(ends, hits, side="right")
            for p, d in zip(hits.tolist(), doc.tolist(), strict=True):
                k = int(at[p])
                while k < len(keys) and keys[k] == g[p]:
                    item, a, size = rows[k]
                    w = self.items[item][1]
                    if p + size <= ends[d] and np.array_equal(h[p : p + size], w[a : a + size]):
                        candidates.add((d, item, p - a))
                    k += 1
        for d, item, start in sorted(candidates):
            w, e = self.items[item][1], self.budget[item]
            low = max(start - e, int(ends[d - 1]) if d else 0)
            high = min(start + len(w) + e, int(ends[d]))
            distance, end = self._distance(item, h[low:high])
            old = out[d].get(item)
            if distance <= e and (old is None or distance < old[0]):
                out[d][item] = (distance, low + end - (int(ends[d - 1]) if d else 0))
        return out


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int, share: float):
    """(how many, the items of each block, broadcast); the next block is fetched when the one before it is done with."""
    spark = items.sparkSession
    ship(spark)
    rows = items.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        own = (rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k) if n > 1 else rows).orderBy("item_id", "text").collect()
        if own:
            sent = spark.sparkContext.broadcast(Items([r[0] for r in own], [r[1] for r in own], share))
            yield n, sent
            if n > 1:
                sent.destroy()


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, end_word): the benchmark items that whole texts hold, with at most share * words edits.

    Texts are compared by lower-cased words, so case, punctuation and white
    space don't count. One row for each row of docs and item: the closest
    place, of equally close ones the first. Null, empty and wordless texts and
    items match nothing. Repeated documents each give their rows; repeated
    items each match; empty tables give no rows. Further columns, of whatever
    name, are not used. Any number of items can be given: they go to the
    workers in blocks of about block_bytes, one after the other, one pass over
    docs for each; the rows of each pass are written to the shared folder, so
    driver and workers never hold more than one block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, distance int, end_word long"
    kinds = [to_arrow_type(rows.schema["doc_id"].dataType), to_arrow_type(items.schema[item_id].dataType), pa.int32(), pa.int64()]
    path, several = scratch(spark, "leaks"), False
    for n, sent in _blocks(items, item_id, item_text, block_bytes, share):

        def run(batches, sent=sent):
            own = sent.value
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                found = []
                for a, b in pieces(texts):
                    for i, got in zip(ids[a:b], own.matches(texts[a:b]), strict=True):
                        found += [(i, own.items[k][0], d, end) for k, (d, end) in sorted(got.items())]
                columns = zip(*found, strict=True) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "end_word"])

        part = rows.mapInArrow(tidy(run), schema)
        if n == 1:
            return part
        part.write.mode("append").parquet(path)
        several = True
    return spark.read.schema(schema).parquet(path) if several else spark.createDataFrame([], schema)


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose texts hold no benchmark item within the edit budget.

    Null, empty and wordless texts stay. Where the items are several blocks,
    what each pass leaves is written to the shared folder.
    """
    names = docs.columns
    for n, sent in _blocks(items, item_id, item_text, block_bytes, share):

        def run(batches, sent=sent):
            for batch in batches:
                texts = batch.column(names.index(text)).to_pylist()
                keep = [not got for a, b in pieces(texts) for got in sent.value.matches(texts[a:b])]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
        docs = written(docs, "leakless") if n > 1 else docs
    return docs
