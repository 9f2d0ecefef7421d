"""Cost-balanced packing of tokenized documents into sequences of bounded length.

Every task packs the documents of its own input split as a stream: no shuffle, no
global state. A document's full pieces of ``capacity`` tokens are sequences already. What is left
of each document waits in a buffer; when the buffer is full (``window`` pieces), its pieces
are taken in descending estimated cost (linear in tokens plus quadratic for attention),
and each goes to the open sequence with the lowest cost that still has room. A piece that fits
in none of the cheapest open sequences is cut, so sequences are filled to the last token; what
is over goes to the next buffer. The last, partly filled sequence of a task is cut at powers of two,
which need no padding.

``sequence_id`` is the task's partition number (high bits) and a counter, so it is unique
without any exchange, and a retried task gives the same numbers for the same rows.

Edge cases: a null or empty text is one token, the end id. A row is packed as often as it
occurs; null doc_ids are carried through. An empty table gives no rows. Other input columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.llm.words import slices

UNIT_CACHE = 400_000


def text_slices(text: str, limit: int = 1_000_000) -> Iterator[str]:
    """Slices that begin at a single space before a visible character: no token of a byte-level vocabulary spans such a place."""
    pos, n = 0, len(text)
    while n - pos > limit:
        cut = pos + limit
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                cut = n
                break
            if not text[cut + 1].isspace():
                break
            cut += 1
        yield text[pos:cut]
        pos = cut
    if pos < n:
        yield text[pos:]


LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SIGNS = r"0-9,.;:!?()\[\]{}\"#$%&*+\-/=@_"
CUTTABLE = re.compile(rf" ?[{LATIN}{SIGNS}]*(?:\n[{LATIN}{SIGNS}]+)*\n?")
PARTS = re.compile(rf" ?[{LATIN}]+|[^{LATIN}]+")
BLANK_AFTER_SPACE = re.compile(r" (?=\s)")


WORD = re.compile(rf"([{LATIN}]+)([{SIGNS}]*\n?)")


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if it can be printed, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def word_model(model) -> Callable[[str], list[int]]:
    """Ids of one word with a space in front, which is a single pre-token: the merges of the model are all it takes."""
    letters = byte_letters()
    space, tokenize = letters[0x20], model.tokenize
    return lambda word: [t.id for t in tokenize(space + (word if word.isascii() else word.encode().decode("latin-1").translate(letters)))]


def unit_encoder(
    encode_batch: Callable[[list[str]], list[list[int]]], encode_word: Callable[[str], list[int]], cache_size: int = UNIT_CACHE
) -> Callable[[list[str]], list[bytes]]:
    """Encode texts as unsigned 32-bit ids in the machine's (little-endian) order, remembering the ids of each space-separated unit.

    In byte-level pre-tokenization a token never runs from a character into a following space
    that precedes a visible character, so units cut there are encoded independently. A unit of Latin letters and ASCII
    without apostrophes or runs of white space is cut again where letters begin and end, which are token ends, too.
    """
    known: dict[str, bytes] = {}  # of a unit as it stands after a space, which it has in front
    parts_known: dict[str, bytes] = {}

    def learn(units: set[str]) -> None:
        if len(known) + len(units) > cache_size:
            known.clear()
            parts_known.clear()
        words, others = [], {}
        for u in units:
            if u.isascii() and u.isalpha():
                known[u] = array("I", encode_word(u)).tobytes()
                continue
            m = WORD.fullmatch(u)
            if m is None:
                others[u] = PARTS.findall(" " + u) if CUTTABLE.fullmatch(u) else [" " + u]
            else:
                words.append((u, *m.groups()))
        fresh = list({w[2] for w in words if w[2]}.union(*others.values()).difference(parts_known))
        for p, ids in zip(fresh, encode_batch(fresh) if fresh else ()):
            parts_known[p] = array("I", ids).tobytes()
        for u, head, tail in words:
            ids = known.get(head)
            if ids is None:
                ids = known[head] = array("I", encode_word(head)).tobytes()
            if tail:
                known[u] = ids + parts_known[tail]
        for u, ps in others.items():
            known[u] = b"".join([parts_known[p] for p in ps])

    def units_of(text: str) -> list[str]:
        head, *rest = text.split(" ")
        if BLANK_AFTER_SPACE.search(text) or text.endswith(" "):
            merged = []
            for r in rest:
                if not r or r[0].isspace():
                    if merged:
                        merged[-1] += " " + r
                    else:
                        head += " " + r
                else:
                    merged.append(r)
            rest = merged
        return [head, *rest]

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for lo, hi in slices(texts, 500_000):
            pieces = [[units_of(s) for s in text_slices(t)] if t else [] for t in texts[lo:hi]]
            missing = set().union(*[u[1:] for p in pieces for u in p]).difference(known)
            heads = list({h for p in pieces for u in p if (h := u[0])})
            first = dict(zip(heads, encode_batch(heads))) if heads else {}
            if missing:
                learn(missing)
            for p in pieces:
                row = []
                for u in p:
                    if u[0]:
                        row.append(array("I", first[u[0]]).tobytes())
                    try:
                        row.append(b"".join(map(known.__getitem__, u[1:])))
                    except KeyError:  # the memory was emptied meanwhile
                        learn(set(u[1:]))
                        row.append(b"".join(map(known.__getitem__, u[1:])))
                out.append(b"".join(row))
        return out

    return encode


# Fixed value: the word pattern of byte-level pre-tokenization.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_ranks(vocabulary: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ids of byte strings and of special tokens of a tokenizer file, where merging by id is merging by the file's rules; else None.

    That holds for byte-level pairs without a normalizer or prefix, if every piece is a byte or the product of a merge, and products come in the order of their ids.
    """
    model, words = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    odd = vocabulary.get("normalizer") or vocabulary.get("truncation") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    special = vocabulary.get("added_tokens", [])
    if model.get("type", "BPE") != "BPE" or not plain or odd or any(t.get(k) for t in special for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    letters = {c: b for b, c in byte_letters().items()}
    named = {t["content"]: t["id"] for t in special}
    pieces = {p: i for p, i in model["vocab"].items() if p not in named}
    products = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    ids = [pieces.get(p, -1) for p in products]
    singles = [p for p in pieces if len(p) == 1]
    if ids != sorted(ids) or -1 in ids[:1] or set(products) | set(singles) != set(pieces) or len(singles) != 256 or (ids and ids[0] < max(pieces[p] for p in singles)):
        return None
    return {bytes(letters[c] for c in p): i for p, i in pieces.items()}, named


def whole_text_encoder(path: str, encode_batch: Callable[[list[str]], list[list[int]]]) -> Callable[[list[str]], list[bytes]] | None:
    """Encode texts by the merges of a byte-level vocabulary as a whole, with the ids that its tokenizer gives; None for another vocabulary.

    Texts that the pattern engine gives up on (very long runs of white space) go to the tokenizer itself.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        found = byte_level_ranks(json.load(f))
    if found is None:
        return None
    ranks, special = found
    encoding = tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens=special)

    def one(text: str) -> bytes:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:
            return array("I", encode_batch([text])[0]).tobytes()

    return lambda texts: [one(t) if t else b"" for t in texts]


def assign(lengths: list[int], rooms: list[int], linear: float, quadratic: float, tries: int = 16) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Fill ``rooms`` (token capacities of open sequences) with items of the given lengths.

    Returns pieces (item, start in item, length, room) in order of assignment, and for items not
    wholly assigned (item, start of the rest).
    """
    pieces, over = [], []
    room = list(rooms)
    heap = [(0.0, s) for s in range(len(room)) if room[s] > 0]
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left and heap:
            aside, chosen = [], None
            while heap and len(aside) < tries:
                cost, s = heapq.heappop(heap)
                if room[s] >= left:
                    chosen = (cost, s)
                    break
                aside.append((cost, s))
            if chosen is None:  # fits in none of the cheapest: cut
                chosen = aside.pop(0)
            for entry in aside:
                heapq.heappush(heap, entry)
            cost, s = chosen
            n = min(left, room[s])
            pieces.append((item, start, n, s))
            room[s] -= n
            start, left = start + n, left - n
            if room[s]:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, s))
        if left:
            over.append((item, start))
    return pieces, over


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 0,
    window: int = 4096,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema = fields + (", ids array<int>" if with_ids else "")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        slow = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        encode = whole_text_encoder(tokenizer_path, slow) or unit_encoder(slow, word_model(tokenizer.model))
        end = np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        kinds = [pa.int64()] * 7 + ([pa.list_(pa.int32())] if with_ids else [])
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(kinds)]
        rows: list[tuple] = []
        waiting: list[tuple] = []  # doc_id, start, tokens of the document, ids

        def add(doc_id, start, ids, tokens, sequence, offset):
            row = (doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset)
            rows.append(row + ((np.frombuffer(ids, "<i4"),) if with_ids else ()))

        def flush(last: bool):
            nonlocal waiting, next_id
            full, rest = divmod(sum(len(w[3]) for w in waiting) // 4, capacity)
            rooms = [capacity] * full
            if last and rest:
                rooms += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
            pieces, over = assign([len(w[3]) // 4 for w in waiting], rooms, linear, quadratic)
            filled = [0] * len(rooms)
            for item, start, n, s in pieces:
                doc_id, base, tokens, ids = waiting[item]
                add(doc_id, base + start, ids[4 * start : 4 * (start + n)], tokens, next_id + s, filled[s])
                filled[s] += n
            next_id += len(rooms)
            waiting = [(w[0], w[1] + start, w[2], w[3][4 * start :]) for w, start in ((waiting[i], s) for i, s in over)]

        def out():
            nonlocal rows
            columns, rows = list(zip(*rows)), []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def encoded(batch):
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    yield doc_id, ids + end

        for batch in batches:
            for doc_id, ids in encoded(batch):
                tokens = len(ids) // 4
                whole = tokens - tokens % capacity
                for start in range(0, whole, capacity):
                    add(doc_id, start, ids[4 * start : 4 * (start + capacity)], tokens, next_id, 0)
                    next_id += 1
                if whole < tokens:
                    waiting.append((doc_id, whole, tokens, ids[4 * whole :]))
                    if len(waiting) >= window:
                        flush(False)
                if len(rows) >= 20_000:
                    yield out()
        flush(True)
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast(T.LongType()), F.col("text").cast(T.StringType())).mapInArrow(run, schema)
