"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import chunks, member, strings, word_hashes

# Phrases whose exact places give a base label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Sentences and paragraphs of well-known licenses, headers and notices, in words, each with its label.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "this software is released under the mit license": "mit",
    "spdx license identifier mit": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2",
    "spdx license identifier apache 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "spdx license identifier gpl 3 0": "gpl-3",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2",
    "spdx license identifier gpl 2 0": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "this source code is subject to the terms of the mozilla public license": "mpl-2",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution sharealike license": "cc-by-sa",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under a creative commons attribution license": "cc-by",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is available under cc by nc": "cc-by-nc",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}
#: Templates are looked for by length: one of up to so many words in blocks of twice as many. A short template in a long
#: block would be met by words from anywhere.
SIZES = (6, 12, 20, 40, 80)

#: Bytes that are not part of a word: ASCII but for digits and letters.
SEPARATES = np.array([b < 0x80 and not (chr(b).isalnum()) for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_SEED = 21


class _Tokens(shared.Words):
    """Lower-cased words between separators."""

    def __init__(self, data, off):
        data = np.where(SEPARATES[data], np.uint8(0x20), LOWER[data])
        super().__init__(data, off)


def _hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(_Tokens(raw, np.array([0, len(raw)])), _SEED)


@dataclass
class _Template:
    label: str
    tokens: list[int]  # token numbers, rarest first
    need: int  # tokens that a block must share
    size: int  # words that it may have, see ``SIZES``

    @property
    def prefix(self) -> list[int]:
        """A block that shares ``need`` tokens has at least one of these."""
        return self.tokens[: len(self.tokens) - self.need + 1]


def token_frequencies(docs: DataFrame, tokens: np.ndarray) -> dict[int, int]:
    """In how many documents each template token stands. Only template tokens count: their number bounds what is
    collected."""

    def run(batches):
        seen = np.zeros(len(tokens), np.int64)
        for b in batches:
            data, off = strings(b.column("text"))
            for lo, hi in chunks(off):
                w = _Tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                h = word_hashes(w, _SEED)
                hit = member(tokens, h)
                doc = np.repeat(np.arange(hi - lo), np.diff(w.first))[hit]
                pair = np.unique(doc * len(tokens) + np.searchsorted(tokens, h[hit]))
                seen += np.bincount(pair % len(tokens), minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens)), pa.int64()), pa.array(seen, pa.int64())], ["token", "n"])

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Per document: n_words, the places of base phrases, and every text block that contains a template.

    Blocks are cut over the document's words, whatever its lines. For the templates of up to ``size`` words, each of
    ``sizes`` in turn, blocks have twice ``size`` words and begin at every ``size``-th, so that a text of a template's
    length lies within one block wherever it stands. A block meets a template when it has the share ``threshold`` of the
    template's distinct words. The join is exact: tokens are put in the global order of their document frequency, a block
    is a candidate only if it has a token of a template's prefix (the rarest ``size - need + 1``), if it has enough words,
    and if the place of its first common token leaves enough tokens to come; candidates are then counted in full.

    Needs ``doc_id`` and ``text`` (null: empty); other columns are ignored, whatever their names; repeated rows give equal
    rows; an empty table gives no rows; very long texts are scanned whole. Returns doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score and matches (array of block start word, words, template, containment; every
    template that the block meets). ``labels`` adds to the base labels those of the templates met; of templates that have half their words in common and are met in
    overlapping blocks only the one of best containment, then of most words, counts. ``score`` is 1
    with a base label, else the best containment.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    sets = {t: np.unique(_hashed(t)) for t in templates}
    tokens = np.unique(np.concatenate(list(sets.values())))
    often = token_frequencies(docs, tokens)
    order = sorted(range(len(tokens)), key=lambda i: (often.get(i, 0), int(tokens[i])))
    place = np.empty(len(tokens), np.int64)
    place[order] = np.arange(len(tokens))
    made = []
    for text, label in templates.items():
        own = sorted(int(place[i]) for i in np.searchsorted(tokens, sets[text]))
        made.append(_Template(label, own, math.ceil(threshold * len(own) - 1e-9), next(z for z in sizes if z >= len(text.split()))))
    names = list(templates)
    # Templates that have half their words in common are versions of each other: of those that overlap the best counts.
    rivals = [{i for i, u in enumerate(made) if u.label != t.label and 2 * len(set(u.tokens) & set(t.tokens)) >= min(len(u.tokens), len(t.tokens))} for t in made]
    by_prefix: dict[tuple[int, int], list[int]] = {}
    is_prefix = {z: np.zeros(len(tokens), bool) for z in sizes}
    for j, t in enumerate(made):
        for token in t.prefix:
            by_prefix.setdefault((t.size, token), []).append(j)
            is_prefix[t.size][token] = True
    base = [(f" {p} ".encode(), p.count(" ") + 1, label) for p, label in phrases.items()]

    def matches(places: np.ndarray, size: int, begin: int, n: int) -> list[tuple]:
        """``places``: the order of the template tokens of a block."""
        have, found = set(places.tolist()), []
        for j in sorted({j for p in have for j in by_prefix.get((size, p), ())}):
            t = made[j]
            if n < t.need:
                continue
            first = next(i for i, x in enumerate(t.tokens) if x in have)
            if len(t.tokens) - first < t.need:
                continue
            both = sum(x in have for x in t.tokens)
            if both >= t.need:
                found.append((begin, n, j, both / len(t.tokens)))
        return found

    def one(norm: bytes, start: np.ndarray, at: np.ndarray, places: np.ndarray, n: int):
        """Of one document: base places, and the blocks that match. ``at``: which of its words are template tokens."""
        spots: list[tuple[int, str]] = []
        padded = b" " + norm
        for phrase, _, label in base:
            i = padded.find(phrase)
            while i >= 0:
                spots.append((int(np.searchsorted(start, i)), label))
                i = padded.find(phrase, i + 1)
        found = []
        for size in sizes:
            rare = at[is_prefix[size][places]]
            # Each word stands in the block that begins in its step, and in the one before.
            starts = np.unique(np.concatenate((rare // size, rare // size - 1))) * size
            starts = starts[(starts >= 0) & (starts < max(1, n - size))]
            for lo, a, z in zip(starts.tolist(), np.searchsorted(at, starts).tolist(), np.searchsorted(at, starts + 2 * size).tolist()):
                found += matches(places[a:z], size, lo, min(n, lo + 2 * size) - lo)
        return spots, found

    found_type = "array<struct<word:long,n:long,template:string,containment:double>>"
    schema = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {found_type}"
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            data, off = strings(b.column("text"))
            for lo, hi in chunks(off):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                w = _Tokens(part, at)
                h = word_hashes(w, _SEED)
                hit = member(tokens, h)
                at_hit = np.flatnonzero(hit)
                places = place[np.searchsorted(tokens, h[at_hit])]
                norm, ends = w.norm, w.start + w.length + 1
                hits = np.concatenate(([0], np.cumsum(hit)))
                rows = []
                for d in range(hi - lo):
                    a, z = int(w.first[d]), int(w.first[d + 1])
                    if hits[z] == hits[a]:
                        rows.append((z - a, 0, None, None, "", "", 0.0, []))
                        continue
                    s0 = int(w.start[a])
                    mine = slice(hits[a], hits[z])
                    spots, found = one(norm[s0 : int(ends[z - 1])].tobytes(), w.start[a:z] - s0, at_hit[mine] - a, places[mine], z - a)
                    labels = {x for _, x in spots}
                    every = labels | {made[j].label for word, n, j, c in found if not any(i in rivals[j] and lo < word + n and word < lo + m and (best, len(made[i].tokens)) > (c, len(made[j].tokens)) for lo, m, i, best in found)}
                    score = 1.0 if spots else max((c for *_, c in found), default=0.0)
                    words = [x for x, _ in spots]
                    rows.append((z - a, len(spots), min(words, default=None), max(words, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, [{"word": x, "n": n, "template": names[j], "containment": c} for x, n, j, c in found]))
                cols = list(zip(*rows))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("template", pa.string()), ("containment", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the scan of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
