"""Licence scan by a positional index of rare words: look up, align by relative position, verify key phrases."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A passage that shows a licence: its words, the key phrases it must hold, and the share of words to agree."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = 0.8

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, UPPER.lower())))

    @property
    def least(self) -> int:
        """How many words must stand in position."""
        return math.ceil(self.share * len(self.words) - 1e-9)

    @property
    def agree(self) -> int:
        """How many looked-up words must propose the same start."""
        return 1 if self.share >= 1.0 else min(self.least, math.ceil(len(self.words) / 8) + 1)

    def anchors(self, idf: dict[str, float]) -> list[int]:
        """The positions that are looked up, rarest words first.

        A place may differ in len - least words, so of that many looked-up positions and ``agree`` more,
        ``agree`` at least stand at every place: none is lost.
        """
        w = self.words
        return sorted(range(len(w)), key=lambda i: (-idf[w[i]], i))[: len(w) - self.least + self.agree]


#: Phrases whose every place counts.
BASE = (
    Template("mit", "mit license", share=1.0),
    Template("apache-2", "apache license version 2", share=1.0),
    Template("cc-by-nc", "cc by nc", share=1.0),
)
#: Notices of well-known licences; a place needs most words in position and all key phrases.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "copy of this software")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ("attribution noncommercial",)),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international", ("attribution sharealike",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    # the paragraphs that name what is granted, in full
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("hereby granted free of charge", "sublicense and or sell copies"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("with or without fee", "appear in all copies"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("endorse or promote products derived from this software",),
    ),
    Template(
        "zlib",
        "In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("alter it and redistribute it freely",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software", "into the public domain"),
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0", "governing permissions and limitations"),
    ),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("gnu general public license", "either version 2 of the license"),
    ),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license", "either version 3 of the license"),
    ),
    Template(
        "lgpl-2",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("gnu lesser general public license", "either version 2 1 of the license"),
    ),
    Template(
        "agpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu affero general public license", "either version 3 of the license"),
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        ("any person or organization", "prepare derivative works of the software"),
    ),
    Template(
        "epl-2",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        ("eclipse public license 2 0",),
    ),
    Template(
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
)


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z: runs of letters, digits and all that is not ASCII."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def inverse_frequency(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, float]:
    """ln((documents + 1) / (documents with the word + 1)) of each word, over all documents: one row per word."""
    held = F.array_intersect(words_of(F.col(text_col)), F.array(*[F.lit(w) for w in vocabulary]))
    # the empty word stands for the document itself
    hits = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in hits.collect()}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _proposed(template: Template, idf: dict[str, float]) -> Column:
    """The sorted starts that the looked-up words of a template propose, from ``hits`` and ``words``; equal ones repeat."""
    t, postings = template.words, {}
    for i in template.anchors(idf):
        postings.setdefault(t[i], []).append(i)
    index = F.create_map(*[x for w, at in postings.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
    own = F.filter("hits", lambda h: h["word"].isin(list(postings)))
    starts = F.flatten(F.transform(own, lambda h: F.transform(F.element_at(index, h["word"]), lambda i: h["at"] - i)))
    return F.array_sort(F.filter(starts, lambda o: (o >= 0) & (o + len(t) <= F.size("words"))))


def _agreed(template: Template, proposed: Column) -> Column:
    """The starts that ``agree`` looked-up words propose: in a sorted array such a start comes again so many places on."""
    rest = F.greatest(F.size(proposed) - (template.agree - 1), F.lit(0))
    again = F.zip_with(F.slice(proposed, 1, rest), F.slice(proposed, template.agree, rest), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.array_compact(again))


def _places(template: Template, starts: Column) -> Column:
    """Of the ``starts`` those where the template stands in ``words``, as array of (start, share): words in position and keys hold."""
    t, words = template.words, F.col("words")

    def holding(starts: Column, i: int, phrase: Sequence[str]) -> Column:
        """The starts at which the phrase stands i words on."""
        return F.filter(starts, lambda o: F.slice(words, o + (i + 1), len(phrase)) == _strings(phrase))

    def share(o: Column) -> Column:
        equal = F.zip_with(F.slice(words, o + 1, len(t)), _strings(t), lambda a, b: a == b)
        return F.size(F.filter(equal, lambda x: x)) / float(len(t))

    good = starts
    for key in template.keys:
        k = key.split()
        at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        good = holding(good, at, k)
    if template.share >= 1.0:
        return F.transform(holding(good, 0, t), lambda o: F.struct(o.alias("start"), F.lit(1.0).alias("share")))
    placed = F.transform(good, lambda o: F.struct(o.alias("start"), share(o).alias("share")))
    return F.filter(placed, lambda p: p["share"] >= template.least / len(t) - 1e-12)


def scan_licenses(
    docs: DataFrame,
    base: Sequence[Template] = BASE,
    templates: Sequence[Template] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Word rarity (inverse document frequency) is counted over all documents first. The index holds the postings
    (template, position) of each template's rarest words, as many as must agree at any place in spite of the words
    that may differ. A document's words are looked up in it; each hit proposes starts of templates, where enough of
    them propose the same start the key phrases and then all words in position are verified. A base phrase is looked
    up by its rarest word alone, which every one of its places holds. So no place is lost.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest
    start (null if there is none); labels are distinct, sorted and joined by commas; ``score`` is the largest share of
    words in position over all verified places, else 0.

    The index is as large as the templates, and all work on a document stays in its row and grows with its hits, also
    in a very long text of licence words. Null and empty texts have no words; repeated rows each get their row; an
    empty table gives an empty result; extra columns are ignored.
    """
    every = [*base, *templates]
    idf = inverse_frequency(docs, sorted({w for t in every for w in t.words}), text_col)
    looked_up = sorted({t.words[i] for t in every for i in t.anchors(idf)})
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    hit = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))),
        lambda h: h["word"].isin(looked_up),
    )
    rows = rows.withColumn("hits", F.when(F.arrays_overlap("words", _strings(looked_up)), hit))
    # an array that is used more than once is a column of its own, so that it is made once
    rows = rows.withColumns({f"p{i}": F.when(F.col("hits").isNotNull(), _proposed(t, idf)) for i, t in enumerate(every)})
    rows = rows.withColumns({f"t{i}": _places(t, _agreed(t, F.col(f"p{i}"))) for i, t in enumerate(every)})
    none = F.array().cast("array<struct<start:int,share:double>>")
    found = [F.coalesce(F.col(f"t{i}"), none) for i in range(len(every))]
    starts = F.transform(F.flatten(F.array(*found[: len(base)])), lambda p: p["start"])

    def labels(upto: int) -> Column:
        own = [F.when(F.size(found[i]) > 0, F.lit(every[i].label)) for i in range(upto)]
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*own)))))

    score = F.coalesce(F.array_max(F.transform(F.flatten(F.array(*found)), lambda p: p["share"])), F.lit(0.0))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(len(base)).alias("base_labels"),
        labels(len(every)).alias("labels"),
        score.alias("score"),
    )
