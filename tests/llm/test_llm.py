"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import bpe, chat, chunks, decontaminate, langid, licenses, lm, minhash, orc_ids, registry, sharding, topk

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "abcdefghij" * 20_000
PROSE = "the quick brown fox jumps over the lazy dog while nobody watches from the old garden wall near the river bank at noon"
TEXTS = [None, "", " ", "\n\n", "word", "word", PROSE, PROSE, PROSE + " again", LONG, "123 456", "é ß <|endoftext|> 漢字 😀\t\n x", "All rights reserved. CC-BY cc by", "a\x00b"]


def frame(spark, texts=TEXTS, lang="en"):
    return spark.createDataFrame([(i, t, lang, "src", len(t) if t else None) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def random_text(rng, n):
    parts = ["a", "b", "word", "é", "ß", " ", " ", "\n", "\t", chr(0xA0), "'s", "<|endoftext|>", "12", "!!", ".", ",", "漢", chr(0x2003), "😀", "\x1c", "\r\n", "   "]
    return "".join(rng.choice(parts) for _ in range(n))


# ---------------------------------------------------------------- SQL


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(round(r[k], 3) if isinstance(r[k], float) else r[k] for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_gives_the_same_rows(spark, monkeypatch, name):
    import duckdb

    monkeypatch.setattr(lm, "STEPS", 5)
    monkeypatch.setattr(lm, "WORD_STEPS", 5)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


# ---------------------------------------------------------------- 1


def plain_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.array([0, 1, 2, 3, 255, 10**12, -1, -(2**63)], np.int64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards_by_key(spark, docs):
    rows = sharding.shard_documents(docs, 40).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.shard, r.grown_shard, r.size, r.text_crc32, r.law) == (plain_jump(r.doc_id, 40), plain_jump(r.doc_id, 41), len(data) + 16, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 40)
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_shards_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, 1), (None, "x", 2), (5, "", 3), (5, "", 3), (6, "é", 4)], "doc_id long, text string, shard int")
    got = sharding.shard_documents(rows, 3).collect()
    assert len(got) == 5
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert {r.size for r in got if r.doc_id == 6} == {18}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(rows.where("false"), 3).count() == 0
    assert sharding.with_shard(spark.createDataFrame([("a",), (None,)], "k string"), "k", 7).where("shard between 0 and 6").count() == 2


# ---------------------------------------------------------------- 2


def base_by_hand(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases(spark, docs):
    texts = [*TEXTS, "cc", "by cc by cc BY", "rights reserved all", "General-Public License; general public\nLICENSE", "all rights", "reserved", "Acc by ccc by", "ÀLL rights reserved"]
    for df in (frame(spark, texts), docs, frame(spark, ["cc by"] * 3), frame(spark, ["all rights", "reserved"])):
        by = {r.doc_id: r.text for r in df.collect()}
        got = licenses.scan_licenses(df).collect()
        assert len(got) == len(by)
        for r in got:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(by[r.doc_id])
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_license_templates(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    texts = [filler] * 30 + [
        f"{filler} Released under the MIT License. {filler}",
        f"{filler} This work is licensed under the GNU General Public License, version 3. {filler}",
        f"{filler} Licensed, under the Apache License: Version 2.0 {filler}",
        f"{filler} license apache the under licensed {filler}",
        f"{filler} Redistribution and use in source and binary forms, with or without any modification are permitted provided that {filler}",
    ]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i] for i in (0, 30, 31, 32, 33, 34)] == ["", "mit", "gpl,gpl-3.0", "apache-2.0", "", "bsd"]


@pytest.mark.parametrize("others", [0, 2, 30])
def test_license_labels_do_not_depend_on_other_rows(spark, others):
    notices = {"apache-2.0": "Licensed under the Apache License, Version 2.0", "mit": "Released under the MIT License.", "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."}
    for label, notice in notices.items():
        for copies in (1, 15, 40):
            texts = [f"some words {notice} of file {i}" for i in range(copies)] + ["plain prose"] * others
            got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame(spark, texts)).collect()}
            assert got == {i: label if i < copies else "" for i in range(copies + others)}


def test_all_notices_of_a_file(spark):
    bsd = next(t for label, t, _ in licenses.TEMPLATES if label == "bsd")
    long_mit = next(t for label, t, _ in licenses.TEMPLATES if label == "mit" and t.startswith("permission"))
    texts = [f"{bsd}. Released under the MIT License.", f"{long_mit} {bsd} Licensed under the Apache License, Version 2.0"] + ["Released under the MIT License."] * 20 + ["Licensed under the Apache License, Version 2.0"] * 20
    texts.append(" ".join(t for _, t, _ in licenses.TEMPLATES))
    texts.append("the mit license of " * 30_000 + bsd)  # more places than are looked at together
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    everything = {label for label, _, _ in licenses.TEMPLATES}
    assert got[0] == "bsd,mit" and got[1] == "apache-2.0,bsd,mit" and everything <= set(got[42].split(",")) and got[43] == "bsd,mit"


WHOLE = {
    "mit": """MIT License  Copyright (c) 2020 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at  http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "gpl,gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}


def test_whole_texts_have_their_label_alone(spark):
    """Each sentence of a text is enough for its label, and none of another's is in it."""
    texts = list(WHOLE.values())
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(WHOLE)
    assert len({label for label, _, _ in licenses.TEMPLATES}) >= 25
    # A text that is cut anywhere in its middle keeps it.
    cut = ["... " + t[len(t) // 3 :] for label, t in WHOLE.items() if label in ("mit", "apache-2.0", "zlib", "isc")]
    assert [r.labels for r in licenses.scan_licenses(frame(spark, cut)).orderBy("doc_id").collect()] == ["mit", "apache-2.0", "zlib", "isc"]


def labels_by_hand(text):
    """Each template at each place of a text, word by word."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = {}
    for label, template, keys in licenses.TEMPLATES:
        t = template.split()
        if not all(k in " ".join(words) for k in keys):
            continue
        for start in range(-len(t), len(words) + len(t)):
            at = lambda i: words[i] if 0 <= i < len(words) else None
            there = [[at(start + j + d) == w for d in (-2, -1, 0, 1, 2)] for j, w in enumerate(t)]
            share = sum(map(any, there)) / len(t)
            near = range(max(0, start - 2), start + len(t) + 3)
            if share >= 0.6 and any(x[2] for x in there) and all(any(words[i : i + len(k.split())] == k.split() for i in near) for k in keys):
                found[label] = max(found.get(label, 0), share)
    return found


def test_labels_and_scores_by_hand(spark, docs):
    rng = random.Random(12)
    texts = [r.text for r in docs.collect() if r.text and "licen" in r.text.lower()][:40] + ["The MIT license", "cc by 4.0", "licensed CC BY-NC 4.0 under", ""]
    for _, template, _ in licenses.TEMPLATES:
        for _ in range(3):  # notices with words changed, left out and put in
            w = template.split()
            for _ in range(rng.randint(0, len(w) // 3)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice([["x"], [], [rng.choice(w)]])
            texts.append("Some words before. " + " ".join(w) + ", and after it.")
    df = frame(spark, texts).withColumn("labels", F.lit("clash")).withColumn("score", F.lit("clash"))
    for r in licenses.scan_licenses(df).collect():
        want = labels_by_hand(texts[r.doc_id])
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == base | set(want), texts[r.doc_id]
        assert r.score == pytest.approx(1.0 if base else max(want.values(), default=0.0))


# ---------------------------------------------------------------- 3


def check_top_k(rows, got, k):
    """Against all pairs in exact integers: rows are (id, whole components); the ids of queries are divisible by 20."""
    want = Counter()
    for n, (q, x) in enumerate(rows):
        if q % 20 == 0:
            found = sorted(((sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(rows) if m != n), key=lambda s: (-s[0], s[1]))[:k]
            want.update((q, r + 1, i, s) for r, (s, i) in enumerate(found))
    assert Counter(map(tuple, got)) == want


def test_top_k_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, -0.01, 0.0, 0.03, 0.4]) for _ in range(6)]) for i in range(90)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (260, [float("inf")] * 6), (280, [0.1] * 3), (7, [0.9] * 6), (None, [0.9] * 6)]
    rows += [(20, [0.7] * 6), (20, [0.7] * 6), (40, rows[40][1]), (300, [])]  # repeated ids, and a repeated row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("q", F.lit(1)).repartition(5)
    v = topk.whole_vectors(df, "vec_id", "embedding")
    whole = [(r.vec_id, [int(x) for x in r.v]) for r in v.collect()]
    assert len(whole) == len(rows) - 5
    check_top_k(whole, topk.top_k(v, v.where("vec_id % 20 = 0"), 20).collect(), 20)
    assert topk.top_k(v.where("false"), v.where("false"), 3).count() == 0
    assert topk.top_k(v.where("vec_id < 3"), v.where("vec_id = 0"), 20).count() == 2


def test_top_k_of_large_components(spark):
    rng = random.Random(2)
    for size in (1e4, 1e8, 3e9 / 64):
        rows = [(i, [float(rng.randint(-9, 9)) * size for _ in range(8)]) for i in range(60)]
        v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
        whole = [(r.vec_id, [int(x) for x in r.v]) for r in v.collect()]
        if size > 1e9:
            assert max(abs(x) for _, y in whole for x in y) > 2**31
        try:
            check_top_k(whole, topk.top_k(v, v.where("vec_id % 20 = 0"), 20).collect(), 20)
        except Exception as e:
            assert "beyond 64 bits" in str(e) and size > 1e7
    huge = topk.whole_vectors(spark.createDataFrame([(0, [1e300]), (1, [1e5]), (2, [float("1e308")])], "vec_id long, e array<double>"), "vec_id", "e")
    assert [r.v[0] for r in huge.orderBy("vec_id").collect()] == [64e300, 64e5]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(huge, huge.where("vec_id = 0"), 3).collect()
    q, r = np.array([[2.0**40, -3.0]]), np.array([[2.0**40, 5.0], [-(2.0**50), 1.0]])
    assert topk.scores(q, r).tolist() == [[2**80 - 15, -(2**90) - 3]]


def test_top_k_in_query_blocks(spark, monkeypatch):
    v = topk.whole_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    whole = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0"), 20).collect()))
    monkeypatch.setattr(topk, "QUERY_BYTES", 4096)
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0"), 20).collect())) == whole


# ---------------------------------------------------------------- 4


def test_language_of_held_out_texts(spark, docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_bayes_by_hand(spark):
    model = langid.train(spark.createDataFrame([("the cat sat", "en"), ("the dog", "en"), ("der hund", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model.languages == ["de", "en"]
    text = "the hund"
    want = []
    for i, _ in enumerate(model.languages):
        total = math.log([1, 2][i] / 3)
        found, _ = langid.features([text])
        for n, f in enumerate(found):
            total += sum(float(model.logs[i, n, x]) for x in f if x >= 0)
        want.append(total)
    label, score = model.predict([text])[0]
    assert label == model.languages[int(np.argmax(want))]
    assert score == pytest.approx(1 / sum(math.exp(x - max(want)) for x in want), rel=1e-6)


def bayes_in_plain_python(rows):
    """{doc_id: (language, posterior)} of rows (doc_id, text, lang), from the definition: n-grams, hashes, counts, smoothing."""
    mult = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

    def grams(text):
        chars = [ord(c) if ord(c) > 0xFFFF or c.isalpha() else 32 for c in " " + text.replace("\0", " ").lower() + " "]
        found = []
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                h = 0
                for k in range(n):
                    h = (h ^ chars[i + k]) * mult[k] % 2**32
                    h ^= h >> 15
                found.append((n, h >> 17))
        return Counter(found)

    own = {i: grams(t or "") for i, t, _ in rows}
    learned = [(i, lang) for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    docs_of, counts, sums = Counter(lang for _, lang in learned), {}, Counter()
    for i, lang in learned:
        counts.setdefault(lang, Counter()).update(own[i])
        for (n, _), k in own[i].items():
            sums[lang, n] += k
    out = {}
    for i, text, _ in rows:
        total = {}
        for lang in sorted(docs_of):
            c = counts[lang]
            total[lang] = math.log(docs_of[lang] / len(learned)) + sum(k * math.log((c[g] + 0.1) / (sums[lang, g[0]] + 0.1 * 2**15)) for g, k in own[i].items())
        best = max(total, key=total.get, default=None)
        letters = any(c.isalpha() for c in text or "")
        out[i] = (best, 1 / sum(math.exp(x - total[best]) for x in total.values())) if letters and total else ("und", 0.0)
    return out


def test_languages_of_all_documents_in_plain_python(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    rows += [(10_000 + i, t, None) for i, t in enumerate(["der", "Straße", "the", "zz", "😀", "ab\0cd", "Ǆ x", "", None, "12"])]
    want = bayes_in_plain_python(rows)
    df = spark.createDataFrame([(*r, "s", None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0]
        assert r.score == pytest.approx(want[r.doc_id][1], abs=1e-3)


def test_many_languages(spark):
    some = spark.range(3000).selectExpr("id doc_id", "concat('text ', id) text", "concat('l', id % 200) lang")
    assert len(langid.train(some).languages) == 200
    with pytest.raises(ValueError, match="different values"):
        langid.train(spark.range(10_000).selectExpr("id doc_id", "'text' text", "concat('l', id) lang"))


def test_languages_are_drawn_by_quota(spark):
    hot = spark.range(30_000).selectExpr("id doc_id", "'the very same text' text", "'en' lang")
    rare = spark.createDataFrame([(-i, f"der hund nummer {i}", "de") for i in range(1, 4)], hot.schema)
    same = spark.range(4_000).selectExpr("1L doc_id", "'le chat' text", "'fr' lang")
    rows = hot.unionAll(rare).unionAll(same)
    for df in (rows, rows.drop("doc_id")):
        model = langid.train(df, most_rows=1000)
        assert model.languages == ["de", "en", "fr"]
        assert np.exp(model.prior) == pytest.approx(np.array([3, 30_000, 4_000]) / 34_003)
        assert [x for x, _ in model.predict(["der hund", "the text", "le chat"])] == ["de", "en", "fr"]
    drawn = Counter(r.lang for r in langid.draw(hot.unionAll(rare), {"en": 30_000, "de": 3}, 1000, ["doc_id", "text"]).collect())
    assert drawn["de"] == 3 and 850 < drawn["en"] < 1150
    assert [langid.quota(x, 20_000) for x in ([5, 7], [10, 10**6, 10**9], [10**6] * 1000)] == [7, 9995, 500]


def test_language_of_odd_texts(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i in (0, 1, 2, 3, 10):
        assert got[i] == ("und", 0.0)
    assert {r.lang_pred for r in langid.identify(frame(spark, lang=None)).collect()} == {"und"}
    assert langid.identify(frame(spark, [])).count() == 0
    kept = langid.keep_identified(frame(spark).withColumn("_score", F.lit(1)).withColumn("_lang", F.lit("x")))
    assert {r.doc_id for r in kept.collect()} == set(range(len(TEXTS))) - {0, 1, 2, 3, 10}


# ---------------------------------------------------------------- 5


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def check_chats(rows, got):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert {r.conv_id for r in got} == set(by)
    for r in got:
        turns = sorted(by[r.conv_id])
        said = "".join(t for *_, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest(f"{a}\n{t}\n" for *_, a, t in turns), len(said), digest(said))


def test_chats_come_back(spark):
    odd = r"\### Assistant: </turn> ok"
    rows = [
        (-7, 0, "user", odd), (-7, 1, "assistant", odd), (1, 1, "assistant", "### user: a </turn>\n"), (1, 0, "user", "\\"), (1, 2, "we:ird\\\n### ", " </turn>\n"),
        (2, 0, "assistant", None), (2, 1, None, "x"), (None, None, "user", ""), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", LONG), (4, 1, "assistant", LONG),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = chat.read_back(chat.format_chats(df)).collect()
    check_chats(rows, got)
    assert {r.conv_id: r.valid for r in got} == {-7: True, 1: False, 2: False, None: False, 3: False, 4: True}
    chars = chat.format_chats(df).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert {r.conv_id: r.n for r in chars} == {r.conv_id: r.formatted_chars for r in got}
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


def test_all_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    check_chats([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], chat.read_back(chat.format_chats(df)).collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\#</turn> :\na", max_size=40))
def test_escape_is_reversible(text):
    coded = chat.escape(text, chat.TEMPLATE["controls"])
    assert chat.unescape(coded) == text
    assert not re.search(r"(?:^|[^\\])(?:\\\\)*(###|</turn>)", coded)


# ---------------------------------------------------------------- 6


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=80))
def test_myers(pattern, text):
    assert decontaminate.myers(np.array(pattern), np.array(text, int))[0] == plain_distance(pattern, text)


def test_leaks_by_hand(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, items).collect()}
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    pool = {r.doc_id: words(r.text) for r in docs.collect()}
    want = {}
    for r in items.collect():
        w = words(r.text)
        grams = {tuple(w[i : i + 2]) for i in range(len(w) - 1)}
        for i, t in pool.items():
            # Edits of a share this low leave most pairs of words: others needn't be aligned.
            if len(grams & set(zip(t, t[1:]))) >= len(grams) * (1 - 3 * decontaminate.SHARE):
                d = plain_distance(w, t)
                if d <= int(len(w) * decontaminate.SHARE):
                    want[i, r.item_id] = d
    assert got == want and want


def test_changed_passages_are_found(spark):
    rng = random.Random(2)
    item = [f"w{i}" for i in range(40)]
    filler = [f"f{i}" for i in range(500)]
    texts = []
    for edits in (0, 3, 6, 7):
        w = list(item)
        for k in rng.sample(range(40), edits):
            w[k] = f"x{k}"
        texts.append(" ".join([*filler[:200], *w, *filler[200:]]).upper().replace(" ", ",\n"))
    texts += [None, "", LONG, " ".join(item[:20]), " ".join(item)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (1, " ".join(item))], "item_id long, text string")
    df = frame(spark, texts).withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.distance) for r in decontaminate.find_leaks(df, items).collect()}
    assert got == {(0, 0), (1, 3), (2, 6), (8, 0)}
    for size in (1 << 20, 10):
        assert {r.doc_id for r in decontaminate.remove_leaks(df, items, block_bytes=size).collect()} == {3, 4, 5, 6, 7}
    assert decontaminate.find_leaks(df, items.where("false")).count() == 0
    assert decontaminate.remove_leaks(df, items.where("false")).count() == len(texts)
    assert decontaminate.remove_leaks(df.where("false"), items).count() == 0


# ---------------------------------------------------------------- 7


def coded(texts):
    buf, ends = bpe.utf8(pa.array(texts, pa.string()))
    return bpe.encoder(BPE).encode(buf, ends)


def test_table_encoder_gives_the_library_s_ids(tokenizer, docs):
    rng = random.Random(3)
    texts = [random_text(rng, rng.randint(0, 40)) for _ in range(3000)] + [r.text for r in docs.limit(50).collect()] + [t for t in TEXTS if t] + ["a", "a\x00", "a\x00\x00", ""]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new pieces, then known ones
        ids, bounds = coded(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


def test_full_table_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 20)
    coder, rng = bpe.Encoder(BPE), random.Random(11)
    for _ in range(20):
        text = " ".join(f"w{rng.randint(0, 60)}" for _ in range(50))
        assert coder.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.table.pieces <= 20 + 50


def round_trips(texts):
    out = []
    for a, b, ids, bounds, decoded, ends in chunks.round_trip(pa.array(texts, pa.string()), BPE):
        out += [(ids[bounds[k] : bounds[k + 1]].tolist(), bytes(decoded[ends[k] : ends[k + 1]]).decode()) for k in range(b - a)]
    return out


@pytest.mark.parametrize("bits, least", [(3, 1), (6, 1), (11, 128)])
def test_chunked_ids_are_those_of_whole_texts(tokenizer, monkeypatch, bits, least):
    monkeypatch.setattr(chunks, "MASK_BITS", bits)
    monkeypatch.setattr(chunks, "LEAST_BYTES", least)
    monkeypatch.setattr(chunks, "_CACHES", {})
    rng = random.Random(4)
    shared = random_text(rng, 200).replace("<|endoftext|>", "")
    texts = [random_text(rng, rng.randint(0, 300)) + shared + random_text(rng, 50) for _ in range(60)]
    texts += [t.replace("<|endoftext|>", "") for t in texts] + [*TEXTS, "x" * 30_000, "漢" * 9000, "ab cd " * 5000, "a b"]
    got = round_trips(texts)
    assert len(got) == len(texts)
    for t, (ids, back) in zip(texts, got, strict=True):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert ids == want and back == tokenizer.decode(want, skip_special_tokens=False) == (t or "")


def test_windows_that_disagree_grow(tokenizer, monkeypatch):
    monkeypatch.setattr(chunks, "_CACHES", {})
    made = chunks.Reuse._encode

    def wrong(self, texts):
        for c in made(self, texts):
            c.ids = c.ids + 1  # no window can agree with these
            yield c

    monkeypatch.setattr(chunks.Reuse, "_encode", wrong)
    rng = random.Random(5)
    text = " ".join(f"word{rng.randint(0, 999)}" for _ in range(3000))
    assert round_trips([text])[0][0] == tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_are_shared(monkeypatch):
    monkeypatch.setattr(chunks, "_CACHES", {})
    rng = random.Random(5)
    passage = " ".join(f"word{rng.randint(0, 999)}" for _ in range(4000))
    round_trips([f"start {k} {passage} end {k}" for k in range(3)])
    cache = chunks._CACHES[BPE]
    assert cache.hits > cache.misses and cache.hit_bytes > 0.5 * cache.bytes


def test_encode_decode_frame(spark, tokenizer):
    df = frame(spark).withColumn("N_Tokens", F.lit("clash")).withColumn("_text", F.lit(1))
    got = chunks.encode_decode(df, BPE).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = chunks.encode_decode(frame(spark), BPE, digests=False).collect()
    assert all(r.decoded == (r.text or "") and len(r.ids) == r.n_tokens for r in whole)
    assert chunks.encode_decode(frame(spark, []), BPE).count() == 0


# ---------------------------------------------------------------- 8


def plain_sets(texts, idf):
    out = []
    for t in texts:
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        own = {w: float(idf[int(minhash.word_hashes([w])[0][0]) >> (64 - minhash.DF_BITS)]) for w in set(words)}
        n = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])
        out.append({s: k * round(sum(own[w] for w in s) / len(s), 3) for s, k in n.items()})
    return out


def plain_similarity(a, b):
    low = sum(min(a.get(s, 0), b.get(s, 0)) for s in a)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def test_weighted_jaccard_and_samples():
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts += [t + " " + t[:20] for t in texts]
    idf = np.linspace(1, 2, 1 << minhash.DF_BITS).astype(np.float32)
    mine, plain = minhash.shingles(texts, idf), plain_sets(texts, idf)
    agree, expected = 0, 0.0
    for a in range(0, 60, 7):
        for b in range(60):
            assert minhash.similarity(mine[a], mine[b]) == pytest.approx(plain_similarity(plain[a], plain[b]), abs=2e-3)
    # Bands agree as often as the similarity says, over many pairs.
    for a in range(30):
        s = minhash.similarity(mine[a], mine[a + 30])
        agree += (minhash.sample(*mine[a]) == minhash.sample(*mine[a + 30])).mean()
        expected += s**minhash.ROWS
    assert agree == pytest.approx(expected, abs=3.0)


def test_links_span_all_components():
    rng = np.random.default_rng(7)
    base = rng.integers(1, 1 << 60, (6, 200)).astype(np.uint64)
    sets = []
    for k in range(60):
        own = base[k % 6].copy()
        own[rng.integers(0, 200, 8)] = rng.integers(1, 1 << 60, 8)
        sets.append((np.unique(own), np.ones(len(np.unique(own)), np.float32)))
    want = [(a, b) for a in range(60) for b in range(a) if minhash.similarity(sets[a], sets[b]) >= 0.8]

    def roots(edges):
        r = list(range(60))
        for _ in range(60):
            for a, b, *_ in edges:
                r[a] = r[b] = min(r[a], r[b])
        return r

    found = minhash.links(list(range(60)), sets)
    assert roots(found) == roots(want)
    assert all(s >= 0.8 for *_, s in found) and len(found) < 60


def made_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    groups = [[word() for _ in range(200)] for _ in range(8)]
    texts, truth = [], []
    for g, w in enumerate(groups):
        for k in range(10):
            own = list(w)
            if k:
                own[rng.randrange(200)] = "changed"
            texts.append(" ".join(own))
            truth.append(g)
    passage = [word() for _ in range(60)]
    for k in range(20):  # a shared passage makes no near-duplicates
        texts.append(" ".join([word() for _ in range(100)] + passage + [word() for _ in range(100)]))
        truth.append(100 + k)
    texts += [None, None, "", "", " ", "short text", "short text", "Short text!"]
    truth += [200, 201, 202, 202, 203, 204, 204, 204]
    return texts, truth


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts, truth = made_texts()
    df = frame(spark, texts)
    for c in ("id", "bands", "digest", "node", "root", "row", "k_id", "word"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    want = {i: truth.index(g) for i, g in enumerate(truth)}
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i: r.copy_id for i, r in got.items()} == {i: texts.index(t) if t is not None else i for i, t in enumerate(texts)}
    kept = minhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert set(kept[0].asDict()) == set(df.columns)


def chains(texts, links):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(texts))]


@pytest.mark.parametrize("block", [3, 5])
def test_buckets_of_several_classes_lose_no_link(spark, monkeypatch, block):
    """Blocks of a few texts, and bands of one sample, so that texts of many classes share each bucket."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "sample", lambda ids, weights: np.array([7], np.int64) if len(ids) else np.empty(0, np.int64))
    rng = random.Random(3)
    texts = []
    for g in range(5):
        own = [f"g{g}w{i}" for i in range(120)]
        for _ in range(14):  # each is a little further from the first one: chains
            texts.append(" ".join(own))
            own[rng.randrange(120)] = f"x{rng.random()}"
    idf = minhash.idf_table(frame(spark, texts))
    sets = plain_sets(texts, idf)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if plain_similarity(sets[a], sets[b]) >= 0.8]
    df = frame(spark, texts)
    real = df.selectExpr("doc_id id", "text")
    signed = minhash.signatures(real, idf)
    bodies = real.select(minhash.digest().alias("digest"), "text")
    nodes = signed.withColumn("copy_id", F.col("id")).select("digest", minhash.node().alias("node"), "words", F.array(F.lit(7)).cast("array<long>").alias("bands"))
    members = minhash.bucket_members(nodes)
    found = minhash.written(minhash.compare(minhash.first_tasks(members), bodies, idf), "test").select("src", "dst")
    roots = minhash.components(found)
    more = minhash.compare(minhash.later_tasks(members, roots), bodies, idf).select("src", "dst")
    got = {r.id.copy_id: r.root.copy_id for r in minhash.components(found.unionAll(more)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == chains(texts, links)


def test_near_duplicates_of_documents_against_all_pairs(spark, docs):
    """Every pair of `documents` by brute force: links of 0.8 and more are found, and no class has others."""
    rows = {r.doc_id: r.text for r in docs.collect() if r.text}
    ids = sorted(rows)
    idf = minhash.idf_table(docs)
    sets = plain_sets([rows[i] for i in ids], idf)
    links = []
    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and (rows[ids[a]] == rows[ids[b]] or plain_similarity(sets[a], sets[b]) >= 0.8):
                links.append((a, b))
    want = chains(ids, links)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    found = [(a, b) for a, b in links if got[ids[a]] == got[ids[b]]]
    assert links and len(found) >= 0.9 * len(links)
    for k, i in enumerate(ids):  # classes are unions of parts of the true ones
        assert want[ids.index(got[i])] == want[k]


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.keep_one(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE), (2, "x"), (None, None), (3, LONG), (3, "other"), (None, "no id"), (5, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.copy_id, r.class_id) for r in minhash.near_duplicates(rows).collect())
    assert got == Counter([(1, 1, 1)] * 2 + [(None, 1, 1), (2, 2, 2), (None, None, None), (3, 3, 3), (3, 3, 3), (None, None, None), (5, 5, 5)])
    kept = Counter(map(tuple, minhash.keep_one(rows).collect()))
    assert kept == Counter([(1, PROSE), (2, "x"), (None, None), (3, LONG), (3, "other"), (None, "no id"), (5, None)])
    named = rows.selectExpr("cast(doc_id as string) || 'a' as key", "text body", "1 n")
    assert {r.class_id for r in minhash.near_duplicates(named, "key", "body").collect()} == {"1a", "2a", "3a", "5a", None}
    same = spark.createDataFrame([(1, PROSE, "b"), (1, PROSE, "a")], "doc_id long, text string, lang string")
    assert [r.lang for r in minhash.keep_one(same).collect()] == ["a"]


# ---------------------------------------------------------------- 9


def test_lm_base_scores(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    counts = Counter()
    for i, t in rows.items():
        if not held[i]:
            counts.update([*words(t), ""])
    n, v = sum(counts.values()), len(counts)
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [*words(rows[r.doc_id]), ""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    gain = sum(r.score - r.base_score for r in got if r.held_out)
    assert gain > 0


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(9)
    import pandas as pd

    code = np.unique(rng.integers(0, 20, 3000) * lm.CLASSES**2 + rng.integers(0, 20, 3000) * lm.CLASSES + rng.integers(0, 20, 3000))
    table = lm.train(pd.DataFrame({"code": code, "n": rng.integers(1, 50, len(code))}), np.ones(lm.CLASSES), 0.01)
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=2), 1, atol=1e-4)
    cls = np.array([100, 101, 100, 103])
    mass = np.full(lm.CLASSES, 40.0)
    words = lm.train_words(pd.DataFrame({"code": [0, 3, 4, 6], "n": [9, 1, 4, 4]}), cls, np.array([5, 2, 13, 9]), mass)
    shares = 10.0 ** words.astype(float)
    assert np.allclose(shares[:, [0, 2]].sum(axis=1), 20 / 40) and np.allclose(shares[:, 1], 3 / 40) and np.allclose(shares[:, 3], 10 / 40)
    assert shares[1, 0] > shares[1, 2] * 0.9 and shares[0, 0] > shares[0, 2]  # after class 0 the first word was more frequent than the third


def test_lm_score_by_hand(spark, docs, monkeypatch):
    """Each text's score from the model's tables, token by token; in any context the probabilities of all words and of an unseen one sum to 1."""
    monkeypatch.setattr(lm, "STEPS", 30)
    monkeypatch.setattr(lm, "LISTED", 300)
    rows = lm.with_block(docs, "doc_id", "text").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    totals = lm.block_words(rows).groupBy("word").agg(F.sum("n").alias("c"))
    model = lm.fit(rows, totals)
    counts = {r.word: r.c for r in totals.collect()}
    tops = sorted((w for w in counts if w and counts[w]), key=lambda w: (-counts[w], w))
    assert model.frequent == [w.encode() for w in tops[: lm.FREQUENT]] and model.listed == [w.encode() for w in tops[lm.FREQUENT :][:300]]
    own = {w: i + 1 for i, w in enumerate(tops[: lm.FREQUENT])} | {"": 0}
    listed = {w: i for i, w in enumerate(tops[lm.FREQUENT :][:300])}
    surface = lambda w: own[w] if w in own else lm.FREQUENT + 1 + zlib.crc32(w[-2:].encode()) % lm.SUFFIXES
    mass = Counter()
    for w, c in counts.items():
        if c:
            mass[surface(w)] += c + 1

    def chance(a, b, w):
        if not counts.get(w):
            return float(model.table[a, b, lm.UNSEEN])
        inside = float(model.words[b, listed[w]]) if w in listed else math.log10((counts[w] + 1) / mass[surface(w)])
        return float(model.table[a, b, surface(w)]) + inside

    for a, b in [(0, 0), (0, 5), (110, 3), (7, 120)]:
        known = sum(10 ** chance(a, b, w) for w, c in counts.items() if c)
        missing = sum(10 ** float(model.table[a, b, k]) for k in range(lm.CLASSES) if k != lm.UNSEEN and not mass[k])
        assert known + missing + 10 ** chance(a, b, "never seen") == pytest.approx(1, abs=1e-3)
    got = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    for r in docs.limit(60).collect():
        tokens = [w.decode() for w in lm.words(r.text)] + [""]
        a, b, total = 0, 0, 0.0
        for w in tokens:
            total += chance(a, b, w)
            a, b = b, surface(w)
        assert got[r.doc_id] == pytest.approx(total, rel=1e-4)


def test_lm_learns_from_all_counts():
    import pandas as pd

    at = lambda a, b, c: (a * lm.CLASSES + b) * lm.CLASSES + c
    n = {at(1, 2, 3): 10**9, at(1, 2, 4): 10**9, at(40, 41, 42): 100}
    mass = np.ones(lm.CLASSES)
    for code, x in n.items():
        mass[code % lm.CLASSES] += x
    table = lm.train(pd.DataFrame({"code": sorted(n), "n": [n[x] for x in sorted(n)]}), mass, 0.01)
    assert table[40, 41, 42] > -1 and table[1, 2, 3] == pytest.approx(math.log10(0.5), abs=0.05)


def test_lm_learns_an_order(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 150)
    texts = ["a b c d " * 50] * 40
    got = lm.score_documents(frame(spark, texts)).collect()
    assert all(r.score > 0.5 * r.base_score for r in got)


def test_lm_learns_words_after_words(spark, monkeypatch):
    """Words of one class, each always after another frequent one: only a model of words tells them apart."""
    monkeypatch.setattr(lm, "STEPS", 60)
    rng = random.Random(1)
    common = [f"f{i}" for i in range(200)]
    pairs = {"f1": "oneing", "f2": "twoing"}  # the same last letters
    texts = []
    for _ in range(300):
        words = [rng.choice(common) for _ in range(60)]
        for k in range(0, 60, 6):
            words[k] = rng.choice(["f1", "f2"])
            words[k + 1] = pairs[words[k]]
        texts.append(" ".join(words))
    monkeypatch.setattr(lm, "FREQUENT", 2)
    monkeypatch.setattr(lm, "SUFFIXES", lm.CLASSES - 4)
    right, wrong = "f1 oneing f2 twoing", "f1 twoing f2 oneing"
    got = lm.score_documents(frame(spark, texts + [right, wrong])).orderBy("doc_id").collect()
    assert got[-2].base_score == got[-1].base_score and got[-2].score > got[-1].score + 1


def test_lm_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "WORD_STEPS", 10)
    monkeypatch.setattr(lm, "BLOCKS", [(10, 4), (200, 2)])
    odd = frame(spark).withColumn("block", F.lit("clash")).withColumn("word", F.lit("clash"))
    got = {r.doc_id: r for r in lm.score_documents(odd).collect()}
    assert len(got) == len(TEXTS)
    assert got[0].n_tokens == got[1].n_tokens == got[2].n_tokens == 1
    assert all(math.isfinite(r.score) for r in got.values())
    renamed = {r.doc_id: (r.score, r.base_score) for r in lm.score_documents(odd.drop("doc_id").selectExpr("n_chars as text_", "text body", "cast(monotonically_increasing_id() as string) id"), "id", "body").collect()}
    assert len(renamed) == len(TEXTS)
    assert lm.score_documents(frame(spark, [])).count() == 0
    only = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [(r.n_known, r.train_tokens) for r in lm.score_documents(only).collect()] == [(0, 0)] * 2


# ---------------------------------------------------------------- 10


def check_ids(df, tokenizer, got):
    """Places have no gaps, ids of documents ascend along them, and each row of df is there."""
    rows = Counter((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in df.collect())
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, ids), n in rows.items() for _ in range(n))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, (False, 0)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is not None, r.doc_id or 0) >= last
        at, last = at + r.n_tokens, (r.doc_id is not None, r.doc_id or 0)


def test_ids_come_back_from_orc(spark, docs, tokenizer):
    check_ids(docs, tokenizer, orc_ids.ids_file(docs, BPE).collect())
    odd = frame(spark).withColumn("ids", F.lit("clash")).withColumn("part", F.lit("clash")).withColumn("at", F.lit("clash"))
    check_ids(odd, tokenizer, orc_ids.ids_file(odd, BPE).collect())
    assert orc_ids.ids_file(frame(spark, []), BPE).count() == 0


def test_places_of_repeated_ids_are_those_in_the_files(spark, tokenizer):
    rows = [(1, "b"), (1, "a a a a a"), (1, "b"), (2, "c d"), (None, "n"), (None, "n n"), (1, None)] + [(7, f"hot {k % 3}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = orc_ids.scratch(spark, "test")
    orc_ids.write_ids(df, path, BPE, files=5)
    read = orc_ids.read_ids(spark, path)
    assert read.where("doc_id = 7").select("part").distinct().count() > 1  # one id is not one task's
    stream = [i for _, _, ids in sorted((r.part, r.at, r.ids) for r in read.collect()) for i in ids]
    got = orc_ids.positions(orc_ids.digests(read)).collect()
    check_ids(df, tokenizer, got)
    for r in got:
        assert zlib.crc32(np.array(stream[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32


def test_orc_files_prune(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    orc_ids.write_ids(docs, path, BPE, files=4)
    rows = orc_ids.read_ids(spark, path)
    spans = rows.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("part").collect()
    assert len(spans) == 4 and all(a.high < b.low for a, b in zip(spans, spans[1:]))
    one = orc_ids.read_ids(spark, path, "doc_id = 17")
    assert one.count() == 1
    assert "EqualTo(doc_id,17)" in one._jdf.queryExecution().toString()


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, now = docs.columns, docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, SF), "test")
        assert now.columns == names
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    every = {r.doc_id for r in docs.collect()}
    assert kept[0] == every - {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    classes = minhash.near_duplicates(docs.where(F.col("doc_id").isin(list(kept[0])))).collect()
    assert kept[1] == {r.class_id for r in classes}
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept[2] == kept[1] - leaks
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept[2]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded == text[r.doc_id] for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
