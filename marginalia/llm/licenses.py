"""License scans by diagonal voting.

Word k-grams that a notice template holds are joined with the template's positions; a match votes for its diagonal
(place in the text minus place in the template). Neighbouring diagonals, as insertions and deletions make them, are
merged, and a merged span is kept where it covers enough of the template's k-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import stored

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording of public licence notices and of whole short licences, by label.
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.

        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.""",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "either version 3 of the license or at your option any later version",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.

        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "reserved": ["copyright all rights reserved"],
}
K = 3
#: Bytes below 0x80 outside words become spaces; letters A-Z become small; all bytes from 0x80 on belong to words.
_FOLD = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Vocabulary:
    """Numbers of the words of templates and phrases; a k-gram's code is exact, its words' numbers in base ``size``."""

    def __init__(self, phrases: list[str]):
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for p in phrases for w in words(p)}))}
        self.size = len(self.number) + 1

    def codes(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Rolling codes of all k-grams; 0 where a word is in no template."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            part = ids[j : j + n]
            out = out * self.size + part
            known &= part > 0
        return np.where(known, out, 0)

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, k: int = K, shift: int = 2, least_cover: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: word count, base places, labels, score and verified spans.

    ``least_cover`` is the share of a template's k-grams that a span's diagonals (merged within ``shift``) must hold.
    The score is 1 where a base phrase stands, else the best span's cover, else 0. Null or empty texts have no words and
    no labels; repeated rows are scanned each on their own (rows are numbered, so equal ids do not mix).
    """
    templates, phrases = templates or TEMPLATES, phrases or BASE_PHRASES
    listed = [(label, t) for label, ts in templates.items() for t in ts]
    vocab = Vocabulary([*phrases, *(t for _, t in listed)])
    base = [(len(words(p)), int(vocab.codes(vocab.numbers(words(p)), len(words(p)))[0]), label) for p, label in phrases.items()]
    grams = [(t, label, pos, int(c)) for t, (label, text) in enumerate(listed) for pos, c in enumerate(vocab.codes(vocab.numbers(words(text)), k))]
    wanted = np.unique([g[3] for g in grams])
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<pos:long,gram:long>>"

    def run(batches):
        hit = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())]))
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = vocab.numbers(ws := words(text or ""))
                found = {label: np.flatnonzero(vocab.codes(ids, n) == code) for n, code, label in base}
                at = np.concatenate(list(found.values()))
                codes = vocab.codes(ids, k)
                pos = np.flatnonzero(codes)
                pos = pos[np.isin(codes[pos], wanted)]
                rows.append((len(ws), at.size, int(at.min()) if at.size else None, int(at.max()) if at.size else None, sorted(x for x, y in found.items() if y.size), [{"pos": p, "gram": g} for p, g in zip(pos.tolist(), codes[pos].tolist(), strict=True)]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), hit)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits"])

    spark = docs.sparkSession
    scanned = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "licenses")
    places = spark.createDataFrame([(c, t, label, p) for t, label, p, c in grams], "gram long, template int, label string, tpos long")
    sizes = {t: sum(g[0] == t for g in grams) for t in range(len(listed))}
    size = F.create_map(*(x for t, n in sizes.items() for x in (F.lit(t), F.lit(n))))
    votes = (
        scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.gram")
        .join(F.broadcast(places), "gram")  # as many rows as the templates have words
        .groupBy("row", "template", "label", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("held"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > shift, F.lit(True))
    merged = (
        votes.withColumn("run", F.sum(new.cast("int")).over(order))
        .groupBy("row", "template", "label", "run")
        .agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("cover", F.size("held") / F.element_at(size, F.col("template")))
        .where(F.col("cover") >= least_cover)
    )
    spans = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "cover"))).alias("spans"))
    r = scanned.drop("hits").join(spans, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.col("spans.label"), F.array().cast("array<string>")))))
    return r.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.cover"), F.lit(0.0))).alias("score"),
        "spans",
    )
