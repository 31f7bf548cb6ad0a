"""Language-model scores (operator 9): log-bilinear models trained in numpy with noise-contrastive estimation.

A token's probability is that of its class in its context, times that of the
word among the words of its class. The most frequent words are classes of
their own, the others one by their last letters, words not seen in training
one together. One log-bilinear model predicts the class from the classes of
the two tokens before it: position-wise context vectors are added, and their
product with the class vectors, plus a bias, is the class's score. A second
one has a vector for each of the LISTED most frequent other words and predicts
the word, among those of its class, from the class before it. Batched matrix
products over all contexts and a softmax give normalised log probabilities.
Rarer words have their add-one share of their class, so the probabilities of
all words and of the one unseen word sum to 1 in every context.

Word counts, class trigrams and the words beside each class are gathered from
all training documents. No table of the whole vocabulary goes to one place:
documents are dealt into blocks, each block asks for the counts of its words
beyond the listed ones, and is scored together with the answers.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pieces, ship, written

CLASSES = 128
FREQUENT = 95  # words with a class of their own
SUFFIXES = CLASSES - FREQUENT - 2  # classes of other words
END, UNSEEN = 0, CLASSES - 1  # the end token, also the context before a text; words not seen
LISTED = 16_384  # further words with a vector of their own
DIMENSIONS = 24
#: Rows of a block, by the bytes that a text of it has at most: a block never has more than about 64 MB or one text.
BLOCKS = [(16 << 10, 4096), (64 << 10, 1024), (256 << 10, 256)]
#: Noise samples for each token, passes over all counts of the classes and of the words.
NOISE, STEPS, WORD_STEPS = 12, 600, 150


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the six ASCII white-space characters."""
    return (text or "").encode().lower().split()


def suffix_class(word: bytes) -> int:
    return FREQUENT + 1 + zlib.crc32(word.decode()[-2:].encode()) % SUFFIXES


class Surface(dict):
    """Class + CLASSES * (number of the listed word + 1) of a word, by its surface alone; kept for short words."""

    def __init__(self, frequent: list[bytes], listed: list[bytes]):
        super().__init__({b"": END} | {w: i + 1 for i, w in enumerate(frequent)} | {w: suffix_class(w) + CLASSES * (i + 1) for i, w in enumerate(listed)})
        self.first = dict(self)

    def __missing__(self, word: bytes) -> int:
        c = suffix_class(word)
        if len(self) > 500_000:
            self.clear()
            self.update(self.first)
        if len(word) <= 32:
            self[word] = c
        return c


@dataclass
class Model:
    frequent: list[bytes]
    listed: list[bytes]
    counts: np.ndarray  # of the end token, the frequent and the listed words
    tokens: int  # N
    kinds: int  # V
    mass: np.ndarray  # of each class: the sum of count + 1 over its words
    table: np.ndarray  # log10 probabilities: class before the last one, last class, class
    words: np.ndarray  # log10 of a listed word's share of its class: last class, word

    def share(self, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the share that a word that is not listed has of its class."""
        return np.where(cls == UNSEEN, 0.0, np.log10((counts + 1) / self.mass[cls]))


def with_block(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, block): blocks are of rows that stand together in a file, and of a bounded size."""
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0))
    at = F.col("_metadata.row_index")
    kind = F.lit(len(BLOCKS))
    for k, (most, rows) in reversed(list(enumerate(BLOCKS))):
        at = F.when(size <= most, F.floor(F.col("_metadata.row_index") / rows)).otherwise(at)
        kind = F.when(size <= most, F.lit(k)).otherwise(kind)
    columns = [F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")]
    block = F.xxhash64("_metadata.file_path", kind, at).alias("block")
    try:
        return docs.select(*columns, block)
    except AnalysisException as e:  # a frame without files has no such column
        if "UNRESOLVED_COLUMN" not in str(e):
            raise
    return with_block(written(docs.select(*columns), "lm-documents"), "doc_id", "text")


def block_words(docs: DataFrame) -> DataFrame:
    """(word, block, n): the words of each block, with their count in its training documents; "" is the end token."""

    def flush(block, counts, others):
        for w in others:
            counts.setdefault(w, 0)
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(np.full(len(counts), block)), pa.array(list(counts.values()), pa.int64())], names=["word", "block", "n"])

    def run(batches):
        # Rows of one size stand together by block, so few blocks are open at once: the one that waits longest goes.
        still: dict[int, tuple[Counter, set]] = {}
        for batch in batches:
            for block, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts, others = still.pop(block, None) or (Counter(), set())
                own = words(text)
                own.append(b"")
                if held:
                    others.update(own)
                else:
                    counts.update(own)
                still[block] = counts, others
                if len(still) > len(BLOCKS) + 1 or len(counts) + len(others) > 1_500_000:
                    gone = next(iter(still)) if len(still) > len(BLOCKS) + 1 else block
                    yield flush(gone, *still.pop(gone))
        for block, (counts, others) in still.items():
            yield flush(block, counts, others)

    return docs.select("block", "held_out", "text").mapInArrow(run, "word string, block long, n long")


def class_counts(docs: DataFrame, frequent: list[bytes], listed: list[bytes]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(code, n) of all class trigrams, and of all listed words after each class, in the training documents.

    At most CLASSES**3 and CLASSES * LISTED rows come to the driver.
    """
    size = CLASSES**3

    def count(texts, surface, total):
        codes, sizes = [], []
        for text in texts:
            own = words(text)
            codes += [END, END, *map(surface.__getitem__, own), END]
            sizes.append(len(own) + 3)
        if codes:
            c, word = np.array(codes) % CLASSES, np.array(codes) // CLASSES - 1
            code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            ends = np.cumsum(sizes)[:-1]
            total[:size] += np.bincount(np.delete(code, [*(ends - 2), *(ends - 1)]), minlength=size)  # without what spans two texts
            at = np.flatnonzero(word >= 0)
            total[size:] += np.bincount(c[at - 1] * max(1, len(listed)) + word[at], minlength=len(total) - size)

    def run(batches):
        surface, total = Surface(frequent, listed), np.zeros(size + CLASSES * max(1, len(listed)), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in pieces(texts):
                count(texts[a:b], surface, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    rows = docs.where("not held_out").select("text").mapInArrow(run, "code int, n long")
    got = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values("code")
    return got[got.code < size], got[got.code >= size].assign(code=got.code - size)


def descend(params: list[np.ndarray], steps: int, gradients) -> None:
    """Adam with a falling rate, in place."""
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(steps):
        rate = 0.03 * (1 - step / steps) + 0.001
        for p, g, (m1, m2) in zip(params, gradients(), moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= rate * (m1 / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2 / (1 - 0.99 ** (step + 1))) + 1e-15)


def train_words(pairs: pd.DataFrame, cls: np.ndarray, counts: np.ndarray, mass: np.ndarray, seed: int = 4) -> np.ndarray:
    """log10 of the share that each listed word has of its class, after each class: (CLASSES, words).

    A log-bilinear model fitted to all (last class, word) counts by
    noise-contrastive estimation, with the noise, a class's words by their
    counts, taken by its expectation. It is normalised among the listed words
    of a class, which have together their add-one share of the class.
    """
    if not len(cls):
        return np.zeros((CLASSES, 0), np.float32)
    order = np.argsort(cls, kind="stable")
    begins = np.flatnonzero(np.diff(cls[order], prepend=-1))
    which = np.cumsum(np.isin(np.arange(len(cls)), begins)) - 1  # the place, among the classes that have words, of each word's
    own = (counts + 1.0)[order]
    total = np.add.reduceat(own, begins)
    noise = (own / total[which]).astype(np.float32)
    rng = np.random.default_rng(seed)
    last, vectors = (rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32) for n in (CLASSES, len(cls)))
    bias = np.log(noise)
    if len(pairs):
        code, n = pairs["code"].to_numpy(), pairs["n"].to_numpy()
        true = np.bincount(code, n / n.sum(), CLASSES * len(cls)).astype(np.float32).reshape(CLASSES, -1)[:, order]
        both = true + NOISE * np.add.reduceat(true, begins, axis=1)[:, which] * noise
        log_noise = np.log(NOISE * noise)

        def gradients():
            score = last @ vectors.T
            score += bias - log_noise
            np.clip(score, -30, 30, out=score)
            np.negative(score, out=score)
            np.exp(score, out=score)
            score += 1
            error = both / score
            error -= true
            return error @ vectors, error.T @ last, error.sum(axis=0)

        descend([last, vectors, bias], WORD_STEPS, gradients)
    logits = (last @ vectors.T + bias).astype(np.float64)
    logits -= np.maximum.reduceat(logits, begins, axis=1)[:, which]
    logits -= np.log(np.add.reduceat(np.exp(logits), begins, axis=1))[:, which]
    out = np.empty((CLASSES, len(cls)), np.float32)
    out[:, order] = logits / math.log(10) + np.log10(total / mass[cls[order]][begins])[which]
    return out


def train(trigrams: pd.DataFrame, mass: np.ndarray, unseen: float, seed: int = 3) -> np.ndarray:
    """The table of log10 probabilities of a log-bilinear model fitted to the trigram counts by noise-contrastive estimation.

    Each step is over all counts and takes the noise by its expectation, so
    nothing is drawn and every token counts in every step, at any size.
    """
    rng = np.random.default_rng(seed)
    noise = mass / mass.sum()
    bias = np.log(noise).astype(np.float32)
    before, last, vectors = (rng.normal(0, 0.1, (CLASSES, DIMENSIONS)).astype(np.float32) for _ in range(3))
    code, n = trigrams["code"].to_numpy(), trigrams["n"].to_numpy()
    if len(code):
        # Of each context and class: its share of all tokens, and the expected noise beside the context's tokens.
        true = np.bincount(code, n / n.sum(), CLASSES**3).astype(np.float32).reshape(-1, CLASSES)
        both = true + NOISE * true.sum(axis=1, keepdims=True) * noise.astype(np.float32)
        log_noise = np.log(NOISE * noise).astype(np.float32)

        def gradients():
            context = (before[:, None] + last[None]).reshape(-1, DIMENSIONS)
            score = context @ vectors.T
            score += bias - log_noise
            np.clip(score, -30, 30, out=score)
            error = both / (1 + np.exp(-score)) - true
            to_context = (error @ vectors).reshape(CLASSES, CLASSES, DIMENSIONS)
            return to_context.sum(axis=1), to_context.sum(axis=0), error.T @ context, error.sum(axis=0)

        descend([before, last, vectors, bias], STEPS, gradients)
    vectors[UNSEEN] = 0
    bias[UNSEEN] = math.log(unseen)
    context = (before[:, None] + last[None]).reshape(-1, DIMENSIONS).astype(np.float64)
    logits = context @ vectors.T + bias
    top = logits.max(axis=1, keepdims=True)
    logits -= top + np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
    return (logits / math.log(10)).astype(np.float32).reshape(CLASSES, CLASSES, CLASSES)


def score_block(model: Model, texts: list[str | None], known: list[bytes], counts: np.ndarray) -> list[tuple]:
    """Of each text: n_tokens, n_known, base_score and score. known: its words beyond those of the model, with their counts; some may be there twice."""
    top = [b"", *model.frequent, *model.listed]
    vocabulary = {w: i for i, w in enumerate([*top, *known])}
    surface = np.concatenate([np.arange(1 + len(model.frequent)), np.fromiter(map(suffix_class, [*model.listed, *known]), np.int64, len(model.listed) + len(known))])
    number = np.concatenate([np.full(1 + len(model.frequent), -1), np.arange(len(model.listed)), np.full(len(known), -1)])
    counts = np.concatenate([model.counts, counts])
    target = np.where(counts > 0, surface, UNSEEN)
    base = np.log10((counts + 1) / (model.tokens + model.kinds + 1))
    share = model.share(target, counts)
    out = []
    for text in texts:
        at = np.array([*map(vocabulary.__getitem__, words(text)), 0])
        c = np.concatenate([[END, END], surface[at]])
        listed = number[at]
        own = np.where(listed >= 0, model.words[c[1:-1], listed] if len(model.listed) else 0.0, share[at])
        score = model.table[c[:-2], c[1:-1], target[at]].sum(dtype=np.float64) + own.sum(dtype=np.float64)
        out.append((len(at), int((counts[at] > 0).sum()), float(base[at].sum()), float(score)))
    return out


def fit(rows: DataFrame, totals: DataFrame) -> Model:
    """The model of (text, held_out) rows, whose words have the counts (word, c) in training rows; "" is the end token."""
    seen = totals.where("c > 0")
    top = [(r[0].encode(), r[1]) for r in seen.where("word != ''").orderBy(F.desc("c"), "word").limit(FREQUENT + LISTED).collect()]
    frequent, listed = [w for w, _ in top[:FREQUENT]], [w for w, _ in top[FREQUENT:]]
    end = sum(r[0] for r in seen.where("word = ''").select("c").collect())
    cls = FREQUENT + 1 + F.crc32(F.right("word", F.lit(2))) % SUFFIXES
    sums = seen.where("word != ''").groupBy(cls.alias("cls")).agg(F.sum(F.col("c") + 1).alias("mass"), F.count("*").alias("kinds"), F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("once")).collect()
    mass = np.ones(CLASSES)
    for r in sums:
        mass[int(r["cls"])] = r["mass"]
    mass[END] = end + 1
    for k, (w, c) in enumerate(top[:FREQUENT]):  # out of their last letters' class into their own
        mass[suffix_class(w)] -= c + 1
        mass[k + 1] = c + 1
    mass = np.maximum(mass, 1)
    tokens = sum(r["tokens"] for r in sums) + end
    kinds = sum(r["kinds"] for r in sums) + (end > 0)
    once = sum(r["once"] for r in sums)
    trigrams, pairs = class_counts(rows, frequent, listed)
    table = train(trigrams, mass, max(once, 1) / max(tokens, 1) if tokens else 1.0)
    counts = np.array([end, *(c for _, c in top)], np.int64)
    by_word = train_words(pairs, np.array([suffix_class(w) for w in listed], int), counts[1 + len(frequent) :], mass)
    return Model(frequent, listed, counts, tokens, kinds, mass, table, by_word)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learns from the rows whose crc32(id as text) mod 7 is not 2, the others and
    those with a null id are held out. A null text is an empty one: it has the
    end token alone. Repeated rows count, and are scored, each. Without
    training rows every token is unseen; an empty table gives no rows. Further
    columns are not used. A frame that is no scan of files is written to the
    shared folder first, so that its blocks stay the same.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(True))
    rows = with_block(docs, doc_id, text).withColumn("held_out", held)
    asked = written(block_words(rows), "words")
    totals = written(asked.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    model = fit(rows, totals)
    sent = spark.sparkContext.broadcast(model)
    # The frequent words, which each block has, come with the model, so no word asked for is a hot key.
    top = spark.createDataFrame([(w.decode(),) for w in [b"", *model.frequent, *model.listed]], "word string")
    answers = asked.select("word", "block").join(F.broadcast(top), "word", "left_anti").join(totals, "word").select("block", "word", "c")
    kind = rows.schema["doc_id"].dataType
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [to_arrow_type(kind), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        known = [w.encode() for w in answers.column("word").to_pylist()]
        ids, held, texts = (own.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))
        got = score_block(sent.value, texts, known, answers.column("c").to_numpy())
        n, seen_n, base, score = ([x[k] for x in got] for k in range(4))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip((ids, held, n, seen_n, [sent.value.tokens] * len(n), base, score), types, strict=True)], names=names)

    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
