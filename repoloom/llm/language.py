"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams are pairs and triples of lower-cased code points, hashed into ``buckets`` columns. Counts are
taken on the executors over a bounded sample of labelled documents (``docs_per_lang`` for each language, a
documented bound) and come to the driver as languages x buckets numbers. The smoothed
log-probability matrix of that fixed size is broadcast; each task scores whole texts as sparse (n-gram) sums
of its rows, in slices, so a very long text needs constant memory beyond itself.

Edge cases: a null text and one without any letter are ``und`` with score 0, as is every text when nothing could be
learned. Ties go to the language that sorts first. Repeated rows are scored each; null languages are not
learned from. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.llm.sampling import per_class

CHUNK = 1 << 19  # code points scored at a time


def _gram_ids(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pair and the triple that begin at each code point but the last two."""
    mask = np.uint32(buckets - 1)
    with np.errstate(over="ignore"):
        pair = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77)
        triple = pair * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
        pair ^= pair >> np.uint32(15)
        triple ^= triple >> np.uint32(15)
    return pair & mask, triple & mask


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _chunks(texts: list[str]):
    """(numbers of texts, their code points one after the other, bounds); one very long text comes in several chunks."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        codes = _codes(text)
        for lo in range(0, max(1, len(codes) - 2), CHUNK):
            part = codes[lo : lo + CHUNK + 2]
            if size and size + len(part) > CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Languages and their log-probabilities by bucket."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        if not able:
            return lang, score
        total = np.tile(self.prior, (len(able), 1))
        buckets = self.weights.shape[1]
        for owners, parts in _chunks([texts[i] for i in able]):
            codes = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            pair, triple = _gram_ids(codes, buckets)
            cuts = np.stack((starts, ends - 2), 1).ravel()  # windows over the seam of two texts are in the odd segments
            cuts = cuts[:-1] if cuts[-1] >= len(pair) else cuts
            for k, w in enumerate(self.weights):
                np.add.at(total[:, k], owners, np.add.reduceat(w[pair] + w[triple], cuts)[::2])
        best = total.argmax(1)
        top = total[np.arange(len(able)), best]
        p = 1.0 / np.exp(total - top[:, None]).sum(1)
        for i, b, s in zip(able, best, p):
            lang[i], score[i] = self.langs[b], float(s)
        return lang, score


def fit(rows: DataFrame, docs_per_lang: int = 2000, buckets: int = 1 << 16, smoothing: float = 0.5) -> Model:
    """Learn from columns ``doc_id``, ``text`` and ``lang``."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = per_class(rows.select("doc_id", "text", "lang"), "lang", "doc_id", docs_per_lang)

    def count(batches):
        import pyarrow as pa

        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                if not has_letter(text):
                    continue
                mine = seen.setdefault(lang, np.zeros(buckets, np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for _, parts in _chunks([text]):
                    for part in parts:
                        for ids in _gram_ids(part, buckets):
                            mine += np.bincount(ids, minlength=buckets)
        for lang, mine in seen.items():
            used = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array([-1, *used.tolist()], pa.int32()), pa.array([docs[lang], *mine[used].tolist()], pa.int64())],
                ["lang", "bucket", "n"],
            )

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, bucket, n = counts["lang"].to_numpy(), counts["bucket"].to_numpy(), counts["n"].to_numpy()
    langs = sorted(set(names.tolist()))
    weights, prior = np.full((len(langs), buckets), smoothing), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        mine = names == lang
        grams = mine & (bucket >= 0)
        weights[k, bucket[grams]] += n[grams]
        prior[k] = n[mine & (bucket < 0)].sum()
    if langs:
        weights = np.log(weights / weights.sum(1, keepdims=True))
        prior = np.log(prior / prior.sum())
    return Model(langs, weights, prior)


def identify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; ``held_out`` is carried through."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.prior))

    def run(batches):
        import pyarrow as pa

        own = Model(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lang, score = own.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
                )

    rows = docs.select(F.col("doc_id").cast(T.LongType()), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast(T.StringType()))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
