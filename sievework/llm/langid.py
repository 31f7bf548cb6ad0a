"""Language identification (operator 4): multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name, pieces, ship, tidy

ORDERS = (1, 2, 3)
BITS = 15  # of the hashed features of each order
UNKNOWN = "und"
MOST_TRAINING_ROWS = 20_000
LEAST_TRAINING_ROWS = 500  # of a language that has as many
LEAST_SCORE = 0.5
SMOOTHING = 0.1
MOST_LANGUAGES = 256  # the model has 384 KB for each

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_BLANK = np.uint32(32)


def _char_table() -> np.ndarray:
    """Of each character up to U+FFFF: itself if it is a letter, else a blank."""
    out = np.full(1 << 16, _BLANK, np.uint32)
    letters = [c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    out[letters] = letters
    out[0] = 0
    return out


_TABLE: list[np.ndarray] = []


def has_letter(text: str | None) -> bool:
    return text is not None and next((True for c in text if c.isalpha()), False)


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the feature of each place of all texts (-1: none), and where each text ends."""
    if not _TABLE:
        _TABLE.append(_char_table())
    chars = np.frombuffer("".join(f" {t.lower().replace(chr(0), ' ')} \0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(chars == 0) + 1
    small = chars < 1 << 16
    chars = np.where(small, _TABLE[0][np.where(small, chars, 0)], chars)
    if len(ends):
        chars[ends - 1] = 0
    out = []
    bad = chars == 0
    for n in ORDERS:
        size = max(0, len(chars) - n + 1)
        h = np.zeros(size, np.uint32)
        off = np.zeros(size, bool)
        for k in range(n):
            h = (h ^ chars[k : k + size]) * _MULT[k]
            h ^= h >> np.uint32(15)
            off |= bad[k : k + size]
        f = np.full(len(chars), -1, np.int32)
        f[:size] = np.where(off, -1, (h >> np.uint32(32 - BITS)).astype(np.int32))
        out.append(f)
    return out, ends


class Model:
    """Languages, their log priors, and for each order a (languages, features + 1) matrix of log probabilities."""

    def __init__(self, languages: list[str], docs: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: of each language its features, ascending, and how often they are there."""
        self.languages = languages
        self.prior = np.log(docs / max(1, docs.sum())) if len(languages) else np.zeros(0)
        self.logs = np.zeros((len(languages), len(ORDERS), (1 << BITS) + 1), np.float32)  # the last: nothing
        for logs, (features_, n) in zip(self.logs, counts, strict=True):
            own = np.full(len(ORDERS) << BITS, SMOOTHING)
            own[features_] += n
            own = own.reshape(len(ORDERS), -1)
            logs[:, :-1] = np.log(own / own.sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text; `und` and 0 for a text that is null or has no letter."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found, ends = features([t or "" for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        total = np.tile(self.prior, (len(texts), 1))
        for n, f in enumerate(found):
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.logs[k, n][f], starts, dtype=np.float64)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [(self.languages[b], float(s)) if has_letter(t) else (UNKNOWN, 0.0) for t, b, s in zip(texts, best, score, strict=True)]


def quota(counts, most_rows: int) -> int:
    """The rows that a language gives at most, so that all give about most_rows; LEAST_TRAINING_ROWS at least."""
    left = most_rows
    for i, n in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if n > share:
            return max(share, LEAST_TRAINING_ROWS)
        left -= n
    return max(counts, default=0)


def draw(rows: DataFrame, per: dict[str, int], most_rows: int, by=None) -> DataFrame:
    """All rows of a language with no more than the quota, of another about as many as the quota, by a hash of `by`, or at random where copies are all there is."""
    most = quota(per.values(), most_rows)
    rates = [(x, -(-(most << 40) // n)) for x, n in per.items() if n > most]
    if not rates:
        return rows
    at = F.xxhash64(*by).bitwiseAND(F.lit((1 << 40) - 1)) if by else F.floor(F.rand(4) * (1 << 40))
    rates = rows.sparkSession.createDataFrame(rates, f"lang {rows.schema['lang'].dataType.simpleString()}, _rate long")
    return rows.join(F.broadcast(rates), "lang", "left").where(F.col("_rate").isNull() | (at < F.col("_rate"))).drop("_rate")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most_rows: int = MOST_TRAINING_ROWS, seed: str | None = None) -> Model:
    """Learn from rows with a language: all of them, or about most_rows drawn by a quota for each language.

    Rows are drawn by a hash of their id (doc_id, if there is one) and text, so
    copies do not go together. Priors are from all rows. Rows with a null text
    or language are left out. The counts are summed on the workers; the driver
    gets one number for each feature that a language has. More than
    MOST_LANGUAGES different values of `lang` raise: the model would not be
    small, and a column of so many values hardly names languages.
    """
    ship(docs.sparkSession)
    key = [F.col("doc_id").alias("doc_id")] if "doc_id" in docs.columns else []
    rows = docs.select(*key, F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null and text is not null")
    per = dict(rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect())
    if len(per) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} different values")
    drawn = draw(rows, per, most_rows, [c for c in rows.columns if c != "lang"])
    languages = sorted(per)
    where = {x: i for i, x in enumerate(languages)}
    width = len(ORDERS) << BITS

    def run(frames):
        counts: dict[int, np.ndarray] = {}
        docs_of = np.zeros(len(languages), np.int64)
        for f in frames:
            for name, g in f.groupby("lang"):
                i = where[name]
                docs_of[i] += len(g)
                own = counts.setdefault(i, np.zeros(width, np.int64))
                texts = g["text"].tolist()
                for a, b in pieces(texts):
                    for n, x in enumerate(features(texts[a:b])[0]):
                        own[n << BITS : (n + 1) << BITS] += np.bincount(x[x >= 0], minlength=1 << BITS)
        for i, own in counts.items():
            j = np.flatnonzero(own)
            yield pd.DataFrame({"lang": i, "feature": j, "n": own[j]})
        yield pd.DataFrame({"lang": np.arange(len(languages)), "feature": -1, "n": docs_of})

    none = np.empty(0, np.int64)
    counts, docs_of = [(none, none)] * len(languages), np.zeros(len(languages))

    def learn(some):
        got = some.select("text", "lang").mapInPandas(run, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
        for i, g in got[got.feature >= 0].groupby("lang"):
            counts[i] = (g.feature.to_numpy(), g.n.to_numpy())
        head = got[got.feature < 0]
        docs_of[head.lang] += head.n

    learn(drawn)
    if missing := [x for x, n in zip(languages, docs_of, strict=True) if not n]:  # all rows of such a language are the same
        learn(draw(rows.where(F.col("lang").isin(missing)), {x: per[x] for x in missing}, most_rows))
    return Model(languages, np.array([per[x] for x in languages], float), counts)


def predict(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its posterior; columns of these names give way.

    A null text, or one without a letter, is `und` with score 0; so is every
    text if nothing was learned. Ties go to the language first in the alphabet.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    left = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema), f"`{lang_out}` string, `{score_out}` double"])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(own := own_name(docs, "_text")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(own).to_pylist()
            for a, b in pieces(texts):
                got = sent.value.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in keep), pa.array([x[0] for x in got]), pa.array([x[1] for x in got], pa.float64())], names=[*keep, lang_out, score_out])

    return rows.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learned without the held-out quarter, crc32 of the id as text mod 4 = 2, nor null ids."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = train(docs.where(~fold))
    return predict(docs.select("doc_id", fold.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with their columns, whose text has a language: not `und`, and a posterior of least_score or more.

    If no row names a language, there is nothing to learn from, and only texts
    without letters go.
    """
    model = train(docs)
    name, score = own_name(docs, "_lang"), own_name(docs, "_score")
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return predict(docs, model, lang_out=name, score_out=score).where((F.col(name) != UNKNOWN) & (F.col(score) >= least_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
