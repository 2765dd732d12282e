"""Licence scans with a positional index of rare words.

The index holds the words of the notices below with their places. Of a text's words that the index knows, all that aren't
function words and stand in fewer than half of the notices are looked up; each pair of a place in the text and a place in a
notice votes for the notice at their difference, votes of neighbouring differences count together, and at each one with two votes
or more the notice's words are compared with the text. A notice is found if at one of them enough of its words are there and each
of its key phrases stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import NOT_ALNUM, U64, Words, slices, windows

# The base phrases with their labels, and notices of public licences with theirs: label, key phrases, text.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("mit", ("permission is hereby granted free of charge",), "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", ("mit license",), "licensed under the mit license"),
    ("mit", ("mit license",), "released under the mit license"),
    ("apache", ("apache license",), "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at"),
    ("apache", ("apache license",), "licensed under the apache license, version 2.0"),
    ("gpl", ("general public license",), "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("gpl", ("general public license",), "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details"),
    ("gpl", ("gnu general public license",), "licensed under the gnu general public license"),
    ("lgpl", ("lesser general public license",), "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", ("affero general public license",), "under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license"),
    ("bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", ("bsd license",), "licensed under the bsd license"),
    ("isc", ("permission to use copy modify and",), "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("epl", ("eclipse public license",), "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", ("provided as is without any express or implied warranty",), "this software is provided as-is, without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", ("boost software license",), "distributed under the boost software license, version 1.0"),
    ("cc-by", ("creative commons attribution",), "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc0", ("cc0 1 0 universal",), "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under cc0 1.0 universal"),
    # Whole texts.
    ("mit", ("permission is hereby granted free of charge",), "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("apache", ("apache license",), "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"),
    ("isc", ("permission to use copy modify and",), "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"),
    ("zlib", ("provided as is without any express or implied warranty",), "this software is provided as-is, without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. this notice may not be removed or altered from any source distribution"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
)

# Function words, which no notice is told by.
FUNCTION_WORDS = frozenset("a all and any are as at be been but by can for from has have if in into is it may more must no not of on one or see so that the their these this those to under was will with you your".split())

#: Differences that count as one, and the share of a notice's words that must be there.
SLACK, LEAST = 4, 0.6
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _hashes(words: list[str]) -> np.ndarray:
    return Words(pa.array([" ".join(words)]), NOT_ALNUM).hashes


class Index:
    def __init__(self, notices: tuple = NOTICES, phrases: tuple = PHRASES):
        self.labels = [x[0] for x in notices]
        self.notices = [_hashes(words_of(x[2])) for x in notices]
        self.keys = [[_hashes(words_of(p)) for p in x[1]] for x in notices]
        self.phrases = [(_hashes(words_of(p)), label) for p, label in phrases]
        postings: dict[int, list[tuple[int, int]]] = {}
        for k, x in enumerate(self.notices):
            for i, h in enumerate(x.tolist()):
                postings.setdefault(h, []).append((k, i))
        self.words = np.array(sorted(postings), U64)
        self.postings = [np.array(postings[h], np.int64) for h in self.words.tolist()]
        self.weights = np.array([np.bincount(np.searchsorted(self.words, x), minlength=len(self.words)) for x in self.notices])
        held_by = np.array([len(set(x[:, 0].tolist())) for x in self.postings])
        names = sorted(FUNCTION_WORDS)
        common = np.isin(self.words, np.concatenate([_hashes([x]) for x in names]))
        self.rare = ~common & (2 * held_by < len(notices))  # words of fewer than half of the notices
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.words[self.rare] & U64(0xFFFF)] = True

    def base(self, w: Words) -> list[tuple[np.ndarray, str]]:
        """Where each base phrase starts, as places among the slice's words."""
        out, last = [], w.last
        for h, label in self.phrases:
            n = len(h)
            runs = np.flatnonzero(windows(w.hashes, n) == windows(h, n)[0])
            out.append((runs[runs + n <= last[runs]], label))
        return out

    def _held(self, notice: int, places: np.ndarray, which: np.ndarray, width: int, n: int) -> np.ndarray:
        """How many of a notice's words stand in each run of `width` words of a text of n, the first of which starts `width` words
        before it; runs may stick out. places and which are the text's known words, in the order of word and place."""
        weights = self.weights[notice][which]
        own = np.flatnonzero(weights)
        at, word, weight = places[own], which[own], weights[own]
        # A place p is in the runs that start from p - width + 1 to p; those with an earlier place of the same word count there.
        since = at - width + 1
        same = np.flatnonzero(word[1:] == word[:-1]) + 1
        since[same] = np.maximum(since[same], at[same - 1] + 1)
        change = np.bincount(since + width, weight, n + width + 1) - np.bincount(at + 1 + width, weight, n + width + 1)
        return np.cumsum(change)

    def scan(self, doc: np.ndarray) -> tuple[dict[str, float], float]:
        """Labels found in one text's word hashes, each with the largest share of a notice's words, and the largest share of all."""
        maybe = np.flatnonzero(self.bits[doc & U64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.words, doc[maybe]), len(self.words) - 1)
        known = self.words[at] == doc[maybe]
        places, which = maybe[known], at[known]
        rare = self.rare[which]
        places, which = places[rare], which[rare]
        if len(places) < 2:
            return {}, 0.0
        own = np.unique(which)
        if len(own) < 2:
            return {}, 0.0
        votes: dict[int, list[np.ndarray]] = {}
        for k in own.tolist():
            here = places[which == k]
            for notice, i in self.postings[k].tolist():
                votes.setdefault(notice, []).append(here - i)
        found: dict[str, float] = {}
        most = 0.0
        every = None  # the text's words that the index knows, function words too
        runs: dict[bytes, np.ndarray] = {}  # key phrases' starts in the text
        for notice, lists in votes.items():
            gaps, counts = np.unique(np.concatenate(lists), return_counts=True)
            total = np.concatenate([[0], np.cumsum(counts)])
            near = total[np.searchsorted(gaps, gaps + SLACK, "right")] - total[np.arange(len(gaps))]
            starts = gaps[near >= 2]
            if not len(starts):
                continue
            if every is None:
                at = np.minimum(np.searchsorted(self.words, doc), len(self.words) - 1)
                places = np.flatnonzero(self.words[at] == doc)
                places = places[np.argsort(at[places], kind="stable")]
                every = places, at[places]
            size = len(self.notices[notice])
            shares = self._held(notice, *every, size + SLACK, len(doc))[starts + size + SLACK] / size
            keys = np.ones(len(starts), bool)
            for k in self.keys[notice]:
                if (name := k.tobytes()) not in runs:
                    runs[name] = np.flatnonzero(windows(doc, len(k)) == windows(k, len(k))[0])
                after = np.searchsorted(runs[name], starts + size + SLACK - len(k), "right")
                keys &= after > np.searchsorted(runs[name], starts)
            whole = shares[keys & (shares >= LEAST)]
            if len(whole):
                found[self.labels[notice]] = max(found.get(self.labels[notice], 0.0), float(whole.max()))
            most = max(most, float(np.where(keys, shares, shares / 2).max()))
        return found, most


def license_scan(docs: DataFrame, notices: tuple = NOTICES, phrases: tuple = PHRASES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no label and score 0; an empty table gives no row; texts are read whole, however long; other
    columns are ignored. The score is 1 where a base phrase stands or a notice is whole, else the share
    of the best notice's words, halved if a key phrase of it is missing. Repeated rows and null ids are rows like others.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(notices, phrases)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), NOT_ALNUM, lower=True)
                n = part.num_rows
                count, first, last = np.zeros(n, np.int64), np.full(n, len(w) + 1), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for places, label in index.base(w):
                    doc = w.document[places]
                    np.add.at(count, doc, 1)
                    np.minimum.at(first, doc, places - w.offsets[doc])
                    np.maximum.at(last, doc, places - w.offsets[doc])
                    for i in set(doc.tolist()):
                        labels[i].add(label)
                rows = []
                keys, counts, offsets, h = part.column("doc_id").to_pylist(), w.counts.tolist(), w.offsets.tolist(), w.hashes
                for i in range(n):
                    found, most = index.scan(h[offsets[i] : offsets[i + 1]])
                    own = bool(count[i])
                    rows.append((keys[i], counts[i], int(count[i]), int(first[i]) if own else None, int(last[i]) if own else None, ",".join(sorted(labels[i])), ",".join(sorted(labels[i] | set(found))), 1.0 if own else most))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(look, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
