"""License scans with a positional index of rare words (operator 2).

The index holds the words of the license templates with their positions. Document frequencies of these words are counted over all
documents and only order the words. For each template, the word of highest IDF
of a mandatory key phrase is looked up in a file, however common it is; where
the phrase stands, the template's other words are intersected at each position
that the template can have there. A template counts only if all its key
phrases stand there too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, word_hashes

# Phrases whose every place counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Words of public license texts and notices, sentence by sentence, with the phrases that must stand in them.
TEMPLATES = [
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license"]),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", ["gnu affero general public license version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", ["www apache org licenses license 2 0"]),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ["apache license version 2 0 january 2004"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["agreed to in writing software distributed under the license", "distributed on an as is basis"]),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license", ["specific language governing permissions and limitations"]),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", ["irrevocable copyright license to reproduce"]),
    ("apache-2.0", "patent license to make have made use offer to sell sell import and otherwise transfer the work", ["patent license to make have made use offer to sell sell import"]),
    ("artistic-2.0", "the artistic license 2 0 copyright c 2000 2006 the perl foundation", ["artistic license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ["provided by the copyright holders and contributors as is"]),
    ("bsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability", ["exemplary or consequential damages", "procurement of substitute goods or services loss of use data or profits"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "endorse or promote products"]),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", ["all advertising materials mentioning features or use of this software"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003", ["boost software license version 1 0"]),
    ("bsl-1.0", "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software", ["this entire statement including the above license grant"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nc-sa-4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike 4 0"]),
    ("cc-by-nd-4.0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc0-1.0", "cc0 1 0 universal creative commons corporation is not a law firm and does not provide legal services", ["cc0 1 0 universal"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("epl-2.0", "the accompanying program is provided under the terms of this eclipse public license agreement", ["terms of this eclipse public license"]),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published", "either version 2 of the license"]),
    ("gpl-2.0", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", ["gnu general public license version 2 june 1991"]),
    ("gpl-2.0", "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa", ["gnu general public license along with this program if not write to the free software foundation"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published", "either version 3 of the license"]),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007 copyright 2007 free software foundation inc", ["gnu general public license version 3 29 june 2007"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["author disclaims all warranties with regard to this software"]),
    ("isc", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action", ["negligence or other tortious action"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("lgpl", "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc", ["gnu lesser general public license version 2 1"]),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ["gnu lesser general public license version 3"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "associated documentation files"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"]),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["to deal in the software without restriction", "publish distribute sublicense and or sell copies"]),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["authors or copyright holders be liable for any claim"]),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license", ["mozilla public license version 1 1"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["copy of the mpl was not distributed"]),
    ("mpl-2.0", "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software", ["mozilla public license version 2 0"]),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software", ["this license governs use of the accompanying software"]),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", ["this paragraph and the following two paragraphs"]),
    ("psf-2.0", "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation", ["python software foundation psf"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy modify publish use compile sell or distribute this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["origin of this software must not be misrepresented"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions must be plainly marked"]),
    ("zlib", "this notice may not be removed or altered from any source distribution", ["may not be removed or altered from any source distribution"]),
]
STARTS = 4096  # places of a template that are looked at together
LEAST_SHARE = 0.6  # of a template's words that must be in place
DRIFT = 2  # words by which a place may be off


class Index:
    """Positions of the template words; a plain object of fixed size that goes to the workers."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, text.split(), [k.split() for k in keys]) for label, text, keys in templates]
        self.phrases = [(words.split(), label) for words, label in phrases.items()]
        self.words = sorted({w for _, t, keys in self.templates for w in [*t, *(x for k in keys for x in k)]} | {w for p, _ in self.phrases for w in p})
        ids = {w: i for i, w in enumerate(self.words)}
        hashes = word_hashes(self.words)[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.templates = [(label, np.array([ids[w] for w in t]), [np.array([ids[w] for w in k]) for k in keys]) for label, t, keys in self.templates]
        self.phrases = [(np.array([ids[w] for w in p]), label) for p, label in self.phrases]
        self.idf = np.zeros(len(self.words))

    def occurrences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (counted over all texts) and ids of license words, and where each text's words end."""
        h, ends = word_hashes(texts, ascii_only=True)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == h)
        return places, self.order[at[places]], ends


def _consecutive(places, ids, words, starts):
    """Which starts have all the words one after the other?"""
    good = np.ones(len(starts), bool)
    for j, w in enumerate(words):
        k = np.searchsorted(places, starts + j)
        inside = k < len(places)
        k = np.minimum(k, max(0, len(places) - 1))
        good &= inside & (places[k] == starts + j) & (ids[k] == w) if len(places) else False
    return good


def _phrase_places(index: Index, places, ids, begins, ends):
    """(start, label number) of each place of each base phrase, within one text."""
    found = []
    for n, (words, _) in enumerate(index.phrases):
        anchor = int(np.argmax(index.idf[words]))
        starts = places[ids == words[anchor]] - anchor
        starts = starts[_consecutive(places, ids, words, starts)]
        text = np.searchsorted(ends, starts, side="right")
        starts = starts[starts + len(words) <= ends[text]] if len(starts) else starts
        found.append((starts, np.full(len(starts), n)))
    starts, labels = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], labels[order]


def _key_places(index: Index, keys, places, ids):
    """Where the rarest of a template's key phrases stands, looked up by its rarest word."""
    key = max(keys, key=lambda k: index.idf[k].max())
    anchor = int(np.argmax(index.idf[key]))
    at = places[ids == key[anchor]] - anchor
    return at[_consecutive(places, ids, key, at)]


def _starts(index: Index, t: int, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where template t can start in one text.

    With key phrases: near each place of the rarest of them, which must be
    there. Without: as many of the rarest words vote that a match has one of
    them at least.
    """
    _, words, keys = index.templates[t]
    if keys:
        at = _key_places(index, keys, places, ids)
        return np.unique(at[:, None] - np.arange(-DRIFT, len(words) + DRIFT + 1))
    enough = len(words) - math.ceil(LEAST_SHARE * len(words)) + 1
    rare = np.argsort(-index.idf[words], kind="stable")[:enough]
    return np.unique(np.concatenate([(places[ids == words[q]] - q)[:, None] + np.arange(-DRIFT, DRIFT + 1) for q in rare.tolist()]))


def match_templates(index: Index, places: np.ndarray, ids: np.ndarray) -> dict[str, float]:
    """Labels of the templates in one text, with the share of their words in place."""
    found: dict[str, float] = {}
    for t, (label, words, keys) in enumerate(index.templates):
        starts = _starts(index, t, places, ids)
        for a in range(0, len(starts), STARTS):
            some = starts[a : a + STARTS]
            near = np.arange(-DRIFT, DRIFT + 1)
            want = some[:, None, None] + np.arange(len(words))[:, None] + near
            k = np.minimum(np.searchsorted(places, want), len(places) - 1)
            there = (places[k] == want) & (ids[k] == words[:, None])
            share = there.any(axis=2).sum(axis=1) / len(words)
            good = (share >= LEAST_SHARE) & there[:, :, DRIFT].any(axis=1)  # one word at least is exactly in place
            for i in np.flatnonzero(good)[np.argsort(-share[good], kind="stable")].tolist():
                if share[i] <= found.get(label, 0):
                    break
                around = np.arange(some[i] - DRIFT, some[i] + len(words) + DRIFT + 1)
                if all(_consecutive(places, ids, x, around).any() for x in keys):
                    found[label] = float(share[i])
                    break
    return found


def _keyed(index: Index, places, ids, ends):
    """Which texts may have a template: those with one of its key phrases, or all that have a word if it has none."""
    found = [places[:0]]
    for _, words, keys in index.templates:
        found.append(_key_places(index, keys, places, ids) if keys else places[np.isin(ids, words)])
    return np.bincount(np.searchsorted(ends, np.concatenate(found), side="right"), minlength=len(ends)) > 0


def scan_texts(index: Index, texts: list[str | None]) -> list[tuple]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of each text."""
    places, ids, ends = index.occurrences(texts)
    begins = np.concatenate([[0], ends[:-1]])
    starts, kinds = _phrase_places(index, places, ids, begins, ends)
    a, b = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
    c, d = np.searchsorted(places, begins), np.searchsorted(places, ends)
    keyed = _keyed(index, places, ids, ends)
    out = []
    for i in range(len(texts)):
        own = starts[a[i] : b[i]] - begins[i]
        base = {index.phrases[k][1] for k in kinds[a[i] : b[i]].tolist()}
        more = match_templates(index, places[c[i] : d[i]], ids[c[i] : d[i]]) if keyed[i] else {}
        score = 1.0 if base else max(more.values(), default=0.0)
        out.append((int(ends[i] - begins[i]), len(own), int(own[0]) if len(own) else None, int(own[-1]) if len(own) else None, ",".join(sorted(base)), ",".join(sorted(base | set(more))), score))
    return out


def document_frequencies(docs: DataFrame, text: str, index: Index) -> tuple[np.ndarray, int]:
    """In how many of all documents each license word is, and how many documents there are."""

    def run(batches):
        df, n = np.zeros(len(index.words), np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for a, b in pieces(texts):
                places, ids, ends = index.occurrences(texts[a:b])
                pair = np.unique(np.searchsorted(ends, places, side="right") * len(index.words) + ids)
                df += np.bincount(pair % len(index.words), minlength=len(index.words))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate([[n], df]))], names=["word", "n"])

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = dict(counted.collect())  # a row for each word of the templates
    return np.array([got.get(i, 0) for i in range(len(index.words))]), got.get(-1, 0)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    Whole texts are scanned, of any length; a null text counts as empty (no
    words, no labels, score 0). n_base counts every place of a phrase. score is
    1 with a base label, else the best template's share of words in place.
    Repeated rows give repeated results, an empty table none; further columns,
    of whatever name, are not used. What a text gets does not depend on other
    rows: document frequencies only say which word is looked up first.
    """
    ship(docs.sparkSession)
    index = Index(templates, phrases)
    df, n = document_frequencies(docs, text, index)
    index.idf = np.array([math.log((n + 1) / (x + 1)) for x in df])
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                got = list(zip(*scan_texts(index, texts[a:b]), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
