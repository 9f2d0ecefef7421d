"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and decoding.

A text becomes the model's normal form (spaces as U+2581, one more in front). No piece holds a U+2581 after
another character, so the piece lattice falls apart at every word, and inside a word wherever no piece holds two neighbouring characters
together; these parts are the lattices here and repeat often, so each task remembers them. In a lattice a forward Viterbi pass gives the best score up to every position; these are the exact
heuristic of an A* search that runs backwards from the end and pops complete segmentations in
order of score. The n best of a text combine those of its words: at most n - 1 words can
differ from their best, those whose second-best segmentation loses least, so A* runs for them alone.

The score of a segmentation is the sum of its pieces' scores in the model file. A character that no piece covers is
spelled in byte pieces at ``fallback`` score. Control and unknown pieces are not used.

Edge cases: a null text has no rows; an empty one has one segmentation without pieces and score 0. If there are fewer than
n segmentations, all are returned. Ties keep a fixed order (the text's earlier words differ first). Repeated rows are segmented
each. A U+2581 in a text reads as a space. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*")
WORD_CACHE = 800_000


class Lattice:
    """Segmentation of single words by one vocabulary."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], fallback: float):
        self.pieces, self.byte_ids, self.fallback = pieces, byte_ids, fallback
        # Also what only begins a piece, so that a search stops where no piece goes on.
        self.begun: dict[str, tuple[int, float]] = {p[:n]: (-1, 0.0) for p in pieces for n in range(1, len(p))} | pieces
        # Two neighbouring characters that no piece holds together are a seam of every segmentation.
        self.together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    @classmethod
    def load(cls, model_file: str) -> Lattice:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, byte_ids = {}, [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = (i, sp.get_score(i))
        return cls(pieces, byte_ids, min(s for _, s in pieces.values() if s > -1e8) - 10.0)

    def cut(self, word: str) -> list[str]:
        """Parts of a word between its seams."""
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.together]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])] if at else [word]

    def arcs(self, word: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """(start, end, score, ids) of all pieces in the word, by start."""
        n, get, out = len(word), self.begun.get, []
        for a in range(n):
            hit = False
            for b in range(a + 1, n + 1):
                found = get(word[a:b])
                if found is None:
                    break
                if found[0] >= 0:
                    out.append((a, b, found[1], found[:1]))
                    if b == a + 1:
                        hit = True
            if not hit:
                raw = word[a].encode("utf-8", "surrogatepass")
                out.append((a, a + 1, self.fallback * len(raw), tuple([self.byte_ids[x] for x in raw])))
        return out

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every end position: (start, score, ids) of the pieces that end there."""
        into: list[list] = [[] for _ in range(len(word) + 1)]
        for a, b, s, ids in self.arcs(word):
            into[b].append((a, s, ids))
        return into

    def best(self, word: str) -> tuple[float, tuple[int, ...], float]:
        """Best score, its ids, and how much less the second-best segmentation scores (infinity if there is none).

        One pass keeps the two best scores up to every position: those of an earlier position and a piece, in order of the pieces' starts.
        """
        n, get, none = len(word), self.begun.get, float("-inf")
        front, second, back = [0.0] + [none] * n, [none] * (n + 1), [None] * (n + 1)
        for a in range(n):
            one, two, hit = front[a], second[a], False
            for b in range(a + 1, n + 1):
                found = get(word[a:b])
                if found is None:
                    break
                piece, score = found
                if piece < 0:
                    continue
                if b == a + 1:
                    hit = True
                v, top = one + score, front[b]
                if v > top:
                    other = two + score
                    second[b] = top if top > other else other
                    front[b] = v
                    back[b] = (a, piece)
                elif v > second[b]:
                    second[b] = v
            if not hit:
                raw = word[a].encode("utf-8", "surrogatepass")
                score, b = self.fallback * len(raw), a + 1
                v, top = one + score, front[b]
                if v > top:
                    second[b] = max(top, two + score)
                    front[b] = v
                    back[b] = (a, tuple([self.byte_ids[x] for x in raw]))
                elif v > second[b]:
                    second[b] = v
        ids, at = [], n
        while at:
            at, piece = back[at]
            if piece.__class__ is int:
                ids.append(piece)
            else:
                ids.extend(piece[::-1])
        ids.reverse()
        return front[n], tuple(ids), front[n] - second[n]

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations in order: A* from the end, guided by the exact forward scores."""
        into = self.edges(word)
        front = [0.0] * (len(word) + 1)
        for b in range(1, len(word) + 1):
            front[b] = max(front[a] + s for a, s, _ in into[b])
        # Agenda: (-(forward score + score behind), position, number, score behind, linked ids)
        agenda, number, out = [(-front[-1], len(word), 0, 0.0, None)], 0, []
        while agenda and len(out) < n:
            _, at, _, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            for a, s, piece in into[at]:
                number += 1
                heapq.heappush(agenda, (-(front[a] + s + behind), a, number, s + behind, (piece, path)))
        return out


def normal_form(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


class Segmenter:
    """N-best segmentation of whole texts, with a bounded memory of words."""

    def __init__(self, lattice: Lattice, n: int):
        self.lattice, self.n, self.known = lattice, n, {}

    def _learn(self, words: set[str]) -> dict:
        if len(self.known) + len(words) > WORD_CACHE:
            self.known.clear()
        known, lattice = self.known, self.lattice
        for w in words:
            parts = []
            for p in lattice.cut(w):
                found = known.get(p)
                if found is None:
                    score, ids, gap = lattice.best(p)
                    found = known[p] = (array("I", ids).tobytes(), score, gap)
                parts.append(found)
            known[w] = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), sum(p[1] for p in parts), min(p[2] for p in parts))
        return known

    def segment(self, text: str) -> Iterator[tuple[float, bytes]]:
        """(score, little-endian unsigned 32-bit ids) in descending order of score."""
        for score, ids, _ in self.with_changes(text):
            yield score, ids

    def with_changes(self, text: str) -> Iterator[tuple[float, bytes, list[tuple[bytes, bytes]]]]:
        """(score, little-endian unsigned 32-bit ids, ids of the words that differ from the best: its and theirs) in descending order of score."""
        import numpy as np

        units = UNITS.findall(normal_form(text))
        if not units:
            yield 0.0, b"", []
            return
        found = list(map(self.known.get, units))
        if None in found:
            fresh = {u for u, f in zip(units, found) if f is None}
            known = self._learn(fresh) if len(fresh) < WORD_CACHE else None
            if known is not None:
                kept = {u: f for u, f in zip(units, found) if f is not None}
                found = [f if f is not None else known[u] for u, f in zip(units, found)]
                del kept
            else:
                found = [f or self._learn({u})[u] for u, f in zip(units, found)]
        ids, scores, gaps = zip(*found)
        total, whole = float(sum(scores)), b"".join(ids)
        yield total, whole, []
        if self.n == 1:
            return
        gaps = np.array(gaps)
        m = min(self.n - 1, len(gaps))
        bound = np.partition(gaps, m - 1)[m - 1]
        places = [*np.flatnonzero(gaps < bound).tolist(), *np.flatnonzero(gaps == bound).tolist()][:m]
        places = sorted(p for p in places if gaps[p] != np.inf)
        options = {p: self.lattice.n_best(units[p], self.n) for p in places}
        offsets = {p: sum(map(len, ids[:p])) for p in places}
        # Best-first over the choices at these words.
        start = (0,) * len(places)
        agenda, seen, emitted = [(0.0, start)], {start}, 0
        while agenda and emitted < self.n:
            loss, choice = heapq.heappop(agenda)
            if emitted:
                spliced, changed, last = [], [], 0
                for p, c in zip(places, choice):
                    if c:
                        other = np.array(options[p][c][1], "<u4").tobytes()
                        spliced += [whole[last : offsets[p]], other]
                        last = offsets[p] + len(ids[p])
                        changed.append((ids[p], other))
                yield total - loss, b"".join([*spliced, whole[last:]]), changed
            emitted += 1
            for k, p in enumerate(places):
                if choice[k] + 1 < len(options[p]):
                    following = choice[:k] + (choice[k] + 1,) + choice[k + 1 :]
                    if following not in seen:
                        seen.add(following)
                        lost = sum(options[q][0][0] - options[q][c][0] for q, c in zip(places, following))
                        heapq.heappush(agenda, (lost, following))


class Decoder:
    """Text of piece ids."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i).replace(MARK, " ").encode("utf-8", "surrogatepass") for i in range(size)]
        for i in range(size):
            if sp.is_byte(i):
                self.texts[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
            elif sp.is_control(i):
                self.texts[i] = b""

    def raw(self, ids) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))

    def decode(self, ids) -> str:
        raw = self.raw(ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def worker_memory(model_file: str, n: int) -> tuple[Segmenter, Decoder]:
    """The vocabulary and the words met so far, one of each for all tasks of a worker process.

    Task functions travel by value, so what outlives a task hangs on a module that does not.
    """
    import sys

    kept = sys.__dict__.setdefault("_repoloom_n_best", {})
    if (model_file, n) not in kept:
        kept.clear()
        kept[model_file, n] = Segmenter(Lattice.load(model_file), n), Decoder(model_file)
    return kept[model_file, n]


def encode_n_best(docs: DataFrame, model_file: str, n: int = 4, with_ids: bool = True) -> DataFrame:
    """One row per document and segmentation: doc_id, rank (from 1), score, n_pieces, ids_crc32, round_trip and, if asked for, ids.

    ``round_trip`` says that decoding the ids gives the text again.
    """
    schema = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        segmenter, decoder = worker_memory(model_file, n)
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()] + ([pa.list_(pa.int32())] if with_ids else [])
        names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip", "ids"][: len(kinds)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                part = batch.slice(lo, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py()
                    if text is None:
                        continue
                    plain = text.replace(MARK, " ")
                    for rank, (score, raw, changed) in enumerate(segmenter.with_changes(text), 1):
                        ids = np.frombuffer(raw, "<u4")
                        # Words that are spelled alike decode alike, whatever stands around them.
                        if rank == 1 or not all(decoder.raw(array("I", x)) == decoder.raw(array("I", y)) for x, y in changed):
                            same = decoder.decode(ids.tolist()) == plain
                            best = same if rank == 1 else best
                        else:
                            same = best
                        rows.append((doc_id, rank, score, len(ids), zlib.crc32(raw), same) + ((ids.astype(np.int32),) if with_ids else ()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast(T.LongType()), F.col("text").cast(T.StringType())).mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """Add the text of a column of piece ids; null ids have a null text, ids outside the vocabulary raise."""

    def text_of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(model_file)
        for column in columns:
            yield column.map(lambda x: None if x is None else decoder.decode(x.tolist()))

    return rows.withColumn(name, F.pandas_udf(text_of, T.StringType())(F.col(ids)))
