"""License scan by diagonal voting.

Templates (names and notices of licenses) and documents become words: A-Z in lower case, runs of digits, letters and
everything beyond ASCII. All rolling k-word grams of a document are hashed (k = 4, or the length of a shorter template);
those whose hash no template has are dropped in the task, the rest goes with place and exact words into a Spark join with the template
positions. Each match votes for the diagonal (template, place in the document - place in the template). Votes
are added up per diagonal, diagonals at most ``shift`` apart are merged into one span (words put in or left out move the diagonal), and a
span is verified by words: the lesser of the share of the template's words and of the span's own words that stand in matching grams. A gram
matches by its words, not by its hash, so no verified word is a guess.

Scale: texts are read once and never shuffled; only matching grams are, some bytes each. Grams of templates travel to the tasks in blocks of
``block_grams`` at most, a stated bound; more templates take more passes. Votes have partial sums and keys of document, template and diagonal,
so a license that a third of all documents hold, or one document full of notices, is spread like any other.

Edge cases: a null or empty text has no words, no spans, null places and score 0. Results depend on the text alone: rows that repeat a doc_id
get one row each, equal rows equal results, and rows without doc_id are scanned like all others. Templates without a word are ignored. An empty table gives
no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.llm.words import slices, word_hashes
from repoloom.session import cut_lineage

K = 4
_U = np.uint64
# Lower case for A-Z; digits, letters and bytes of other scripts stay; all else separates words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


# The phrases of the base labels, and names and notices as their publishers word them.
BASE_PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
NAMES = [
    Template("agpl", "gnu affero general public license"),
    Template("bsd", "bsd license"),
    Template("bsl", "boost software license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
    Template("epl", "eclipse public license"),
    Template("isc", "isc license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
]
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
TEMPLATES = BASE_PHRASES + NAMES + NOTICES


def words_of_text(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(_BYTES).split()]


def template_grams(templates: list[Template], k: int = K) -> list[tuple]:
    """(gram, template, label, base, pos, n_words, k) of every gram of every template."""
    rows = []
    for number, t in enumerate(templates):
        words = words_of_text(t.text)
        size = min(k, len(words))
        if words:
            rows += [(" ".join(words[i : i + size]), number, t.label, t.base, i, len(words), size) for i in range(len(words) - size + 1)]
    return rows


def _rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` words."""
    out = np.zeros(max(len(words) - k + 1, 0), _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _U(0x9E3779B97F4A7C15) + words[i : i + len(out)]
    return out


def _known_hashes(grams: list[tuple]) -> dict[int, np.ndarray]:
    known: dict[int, list] = {}
    for gram, *_, size in grams:
        known.setdefault(size, []).append(_rolling(word_hashes(gram.encode())[1], size)[0])
    return {size: np.unique(np.array(h, _U)) for size, h in known.items()}


def _matches(data: bytes, starts: np.ndarray, hashes: np.ndarray, owner: np.ndarray, known: dict[int, np.ndarray]) -> Iterator[tuple[int, str]]:
    """Number of the first word and words of each window whose hash a template has."""
    for size, wanted in sorted(known.items()):
        rolled = _rolling(hashes, size)
        place = np.minimum(np.searchsorted(wanted, rolled), len(wanted) - 1)
        for i in np.flatnonzero((wanted[place] == rolled) & (owner[: len(rolled)] == owner[size - 1 :])).tolist():
            end = int(starts[i + size]) if i + size < len(starts) else len(data)
            yield i, b" ".join(data[int(starts[i]) : end].split()).decode()


def rolling_matches(docs: DataFrame, grams: list[tuple]) -> DataFrame:
    """Per document a row (doc_id, key, n_words, null, null), per matching gram a row (doc_id, key, null, place, gram)."""
    known = docs.sparkSession.sparkContext.broadcast(_known_hashes(grams))

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "key", "n_words", "place", "gram"]
        for batch in batches:
            ids = batch.column(0)
            for lo, hi in slices(batch.column(1).to_pylist()):
                texts = [(t or "").encode() for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                keys = [hashlib.md5(t).digest() for t in texts]
                data = b"\n".join(t.translate(_BYTES) for t in texts)
                offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
                starts, hashes = word_hashes(data)
                owner = np.searchsorted(offsets, starts, side="right") - 1
                counts = np.bincount(owner, minlength=len(texts))
                first = np.concatenate(([0], np.cumsum(counts)))
                found = list(_matches(data, starts, hashes, owner, known.value))
                own = [int(owner[i]) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([lo + d for d in (*range(len(texts)), *own)], pa.int64())),
                        pa.array([*keys, *(keys[d] for d in own)], pa.binary()),
                        pa.array([*counts.tolist(), *[None] * len(own)], pa.int64()),
                        pa.array([*[None] * len(texts), *(i - int(first[d]) for (i, _), d in zip(found, own))], pa.int64()),
                        pa.array([*[None] * len(texts), *(g for _, g in found)], pa.string()),
                    ],
                    names,
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, n_words long, place long, gram string")


def _covered(places: Column, k: Column) -> Column:
    """Words under windows of ``k`` words at these distinct places."""
    s = F.array_sort(places)
    return F.aggregate(F.transform(s, lambda x, i: F.least(k, F.coalesce(F.get(s, i + 1) - x, k))), F.lit(0).cast("long"), lambda a, x: a + x)


def spans(matches: DataFrame, grams: list[tuple], shift: int, least: float) -> DataFrame:
    """doc_id, key, template, label, base, start_word, end_word, share, verified: one row per merged span."""
    spark = matches.sparkSession
    table = spark.createDataFrame(grams, "gram string, template int, label string, base boolean, pos long, size long, k long")
    # Rows that repeat id and text give the same grams: each place votes once.
    hits = matches.filter("gram is not null").select("doc_id", "key", "place", "gram").distinct()
    votes = hits.join(F.broadcast(table), "gram").withColumn("diagonal", F.col("place") - F.col("pos"))
    document = ["doc_id", "key", "template"]
    # A diagonal is no longer than its template, so the sets of its places are bounded.
    diagonals = votes.groupBy(*document, "label", "base", "size", "k", "diagonal").agg(
        F.min("place").alias("lo"), F.max(F.col("place") + F.col("k")).alias("hi"), F.collect_set("pos").alias("pos"), F.collect_set("place").alias("places")
    )
    order = Window.partitionBy(*document).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("size") > F.col("k"), F.lit(shift)).otherwise(F.lit(0)), F.lit(True))
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("long")).over(order))
    merged = merged.groupBy(*document, "label", "base", "size", "k", "span").agg(
        F.min("lo").alias("start_word"),
        F.max("hi").alias("end_word"),
        F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
    )
    k = F.col("k")
    share = F.least(_covered(F.col("pos"), k) / F.col("size"), _covered(F.col("places"), k) / (F.col("end_word") - F.col("start_word")))
    # Phrases of the base labels must stand word by word.
    needed = F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(least))
    return merged.select(*document, "label", "base", "start_word", "end_word", share.alias("share")).withColumn("verified", F.col("share") >= needed)


def license_scan(docs: DataFrame, templates: list[Template] = TEMPLATES, k: int = K, shift: int = 3, least: float = 0.8, block_grams: int = 100_000) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_spans, score for every row."""
    rows, found = license_spans(docs, templates, k, shift, least, block_grams)
    sure, base = F.col("verified"), F.col("verified") & F.col("base")
    named = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    told = found.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start_word"))).alias("first_word"),
        F.max(F.when(base, F.col("start_word"))).alias("last_word"),
        named(base).alias("base_labels"),
        named(sure).alias("labels"),
        F.sum(sure.cast("long")).alias("n_spans"),
        F.max("share").alias("score"),
    )
    told = rows.join(told, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return told.select(
        "doc_id", "n_words", zero("n_base"), "first_word", "last_word", none("base_labels"), none("labels"), zero("n_spans"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def license_spans(
    docs: DataFrame, templates: list[Template] = TEMPLATES, k: int = K, shift: int = 3, least: float = 0.8, block_grams: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """One row per document (doc_id, key, n_words), and the spans of all templates."""
    blocks, size = [[]], 0
    grams = template_grams(templates, k)
    for number in range(len(templates)):
        mine = [g for g in grams if g[1] == number]
        if size and size + len(mine) > block_grams:
            blocks.append([])
            size = 0
        blocks[-1] += mine
        size += len(mine)
    rows = found = None
    for block in blocks:
        # Read by the document rows and by the votes: the scan runs once, its rows are small.
        matches = cut_lineage(rolling_matches(docs, block))
        rows = matches.filter("gram is null").select("doc_id", "key", "n_words") if rows is None else rows
        mine = spans(matches, block, shift, least)
        found = mine if found is None else found.unionByName(mine)
    return rows, found


def oracle(templates: list[Template] = TEMPLATES, k: int = K, shift: int = 3, least: float = 0.8) -> str:
    """DuckDB SQL of ``license_scan`` over ``documents``."""
    values = ",\n  ".join(f"({i}, '{t.label}', {str(t.base).lower()}, '{t.text.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(templates))
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    covered = lambda c: f"list_sum(list_transform(list_sort(list_distinct({c})), lambda x, i: least(k, coalesce(list_sort(list_distinct({c}))[i + 1] - x, k))))"
    return f"""
with t(template, label, base, text) as (values
  {values}),
tw as (select template, label, base, {words} as words, len({words}) as size, least({k}, len({words})) as k from t),
tg as (select template, label, base, size, k, pos, array_to_string(words[pos + 1:pos + k], ' ') as gram
  from (select *, unnest(range(0, size - k + 1)) as pos from tw where size > 0)),
d as (select row_number() over () as key, doc_id, coalesce(text, '') as text from documents),
dw as (select key, doc_id, {words} as words, len({words}) as n_words from d),
dg as (select key, place, k, array_to_string(words[place + 1:place + k], ' ') as gram
  from (select key, words, k, unnest(range(0, n_words - k + 1)) as place from dw, (select distinct k from tg))),
v as (select dg.key, place, place - pos as diagonal, pos, template, label, base, size, tg.k from dg join tg on dg.gram = tg.gram and dg.k = tg.k),
g as (select key, template, label, base, size, k, diagonal, min(place) as lo, max(place + k) as hi, list(pos) as pos, list(place) as places from v group by all),
a as (select *, coalesce(diagonal - lag(diagonal) over (partition by key, template order by diagonal) > case when size > k then {shift} else 0 end, true)::int as apart from g),
n as (select *, sum(apart) over (partition by key, template order by diagonal rows unbounded preceding) as span from a),
m as (select key, template, label, base, size, k, span, min(lo) as start_word, max(hi) as end_word, flatten(list(pos)) as pos, flatten(list(places)) as places from n group by all),
s as (select *, least({covered("pos")} / size, {covered("places")} / (end_word - start_word)) as share from m),
f as (select *, share >= case when base then 1.0 else {least} end as verified from s),
r as (select key, count(*) filter (verified and base) as n_base, min(start_word) filter (verified and base) as first_word, max(start_word) filter (verified and base) as last_word,
    array_to_string(list_sort(list(distinct label) filter (verified and base)), ',') as base_labels, array_to_string(list_sort(list(distinct label) filter (verified)), ',') as labels,
    count(*) filter (verified) as n_spans, max(share) as score from f group by key)
select doc_id, n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(n_spans, 0) as n_spans, coalesce(score, 0.0)::double as score
from dw left join r using (key)
"""
