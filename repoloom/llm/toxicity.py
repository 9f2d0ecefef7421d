"""Toxicity by a weighted finite-state grammar over clauses.

Every token of a text has a symbol: insult, threat, target (who is addressed), negation, speech (a report of what others say), clause
end, other, or a word of one of the built-in phrases, which keeps its kind. Five small transducers read these symbols: two match the
phrases of insults and threats, negation and speech put a factor on the words and phrases that follow, and the target one puts a factor
on what the clause held when it ends, wherever in the clause the target is. Their composition is one product automaton, compiled to tables over the
states that can be reached. A clause holds its heaviest insult and its heaviest threat until its end: a negated or
reported one weighs less, an addressed insult more, and a threat needs somebody to be addressed in the clause. A clause gives one weight, the larger of the
two; a clause that repeats an earlier one word for word counts once. The score of a text is the noisy-or of its
clauses over the share of toxic texts without any match.

The lexicon of insults is learned: words and word beginnings whose share of toxic texts is significantly higher than
the average (binomial tail with Bonferroni's correction) and high in itself, counted once per group of near copies.
Their weight is the lower confidence bound of that share. A threat word with a learned weight is an insult of that weight too.
Learning uses a bounded sample of labelled
rows (``docs_per_class`` of each label, texts of at most ``max_chars`` characters); scoring reads every whole text.

Edge cases: a null or empty text has the score of a text without match. Rows with the same doc_id are scored each; of
several labels of a document the highest counts, null labels and ids do not. Without labelled rows the lexicon is the built-in one.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoloom.llm.sampling import per_class

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”«»]")
INSULT, THREAT, TARGET, NEGATION, SPEECH, END, OTHER = range(7)

INSULTS = ("idiot", "idiots", "moron", "imbecile", "scumbag")
THREATS = ("kill", "murder", "strangle", "töten", "umbringen", "tuer", "matar", "asesinar")
TARGETS = ("you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "euch", "tu", "toi", "vous", "ti", "usted", "ustedes", "vosotros")
NEGATIONS = ("not", "never", "no", "isn", "aren", "nicht", "kein", "keine", "niemals", "ne", "pas", "jamais", "nunca", "jamás")
SPEECHES = ("said", "says", "wrote", "called", "claimed", "reported", "quoted", "sagte", "schrieb", "nannte", "disait", "écrivit", "dijo", "escribió")
MARKS = "\"“”«»"
INSULT_PHRASES = ("piece of trash", "piece of garbage", "piece of filth", "waste of space", "waste of air", "stück dreck", "pedazo de basura")
THREAT_PHRASES = ("break your neck", "break your legs", "break your bones", "cut your throat", "slit your throat", "burn your house", "beat you up", "bring dich um")


def _symbols() -> tuple[dict[str, int], list[int]]:
    """Number of every fixed word, and the kind of every number: the kinds themselves, then each word of a phrase apart."""
    symbols: dict[str, int] = {}
    for words, kind in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (SPEECHES, SPEECH), (MARKS, SPEECH), (".!?;\n", END), (THREATS, THREAT)):
        symbols.update(dict.fromkeys(words, kind))
    kinds = list(range(7))
    for word in sorted({w for p in (*INSULT_PHRASES, *THREAT_PHRASES) for w in p.split()}):
        kinds.append(symbols.get(word, OTHER))
        symbols[word] = len(kinds) - 1
    return symbols, kinds


SYMBOLS, KINDS = _symbols()
NOTHING = (OTHER, 0.0, 0.0)


class Transducer:
    """States from 0, a step function, the factor put on a match of ``n`` words ending in a state, the factor put on what a
    clause held when it ends in a state, and the (kind, weight, n) of the patterns that a symbol completes."""

    def __init__(
        self,
        states: int,
        step: Callable[[int, int], int],
        factor: Callable[[int, int, int], float] = lambda s, c, n: 1.0,
        final: Callable[[int, int], float] = lambda s, c: 1.0,
        found: Callable[[int, int], list[tuple[int, float, int]]] = lambda s, c: [],
    ):
        self.states, self.step, self.factor, self.final, self.found = states, step, factor, final, found


def window(trigger: int, length: int, factor: float, on: tuple[int, ...] = (INSULT, THREAT), longest: int = 1) -> Transducer:
    """``factor`` on matches of at most ``longest`` words that begin within ``length`` tokens after a trigger in the same clause."""
    top = length + longest - 1

    def step(s: int, c: int) -> int:
        return top if KINDS[c] == trigger else 0 if c == END else max(0, s - 1)

    return Transducer(top + 1, step, lambda s, c, n: factor if s > longest - n and c in on else 1.0)


def until_end(trigger: int, factor: float) -> Transducer:
    """``factor`` from a trigger to the end of its clause."""
    return Transducer(2, lambda s, c: 0 if c == END else int(s or KINDS[c] == trigger), lambda s, c, n: factor if s and c in (INSULT, THREAT) else 1.0)


def anywhere(trigger: int, with_it: dict[int, float], without: dict[int, float]) -> Transducer:
    """Factors by kind on what a clause held, with and without a trigger before or behind it in the clause."""
    return Transducer(2, lambda s, c: 0 if c == END else int(s or KINDS[c] == trigger), final=lambda s, c: (with_it if s else without)[c])


def patterns(kind: int, phrases: Iterable[str], weight: float) -> Transducer:
    """``kind`` wherever one of the phrases ends; the states are their beginnings."""
    wanted = {tuple(SYMBOLS[w] for w in p.split()) for p in phrases}
    heads = sorted({p[:n] for p in wanted for n in range(len(p))} | {()}, key=lambda x: (len(x), x))
    number = {h: i for i, h in enumerate(heads)}

    def ends(s: int, c: int) -> list[tuple[int, ...]]:
        read = (*heads[s], c)
        return [read[i:] for i in range(len(read) + 1)]

    return Transducer(
        len(heads),
        lambda s, c: next(number[x] for x in ends(s, c) if x in number),
        found=lambda s, c: [(kind, weight, len(x)) for x in ends(s, c) if x in wanted],
    )


def _reached(parts: tuple[Transducer, ...]) -> list[tuple[int, ...]]:
    """States of the product that can be reached, the first one in front."""
    states = {(0,) * len(parts): None}
    todo = list(states)
    while todo:
        s = todo.pop()
        for c in range(len(KINDS)):
            t = tuple(p.step(x, c) for p, x in zip(parts, s))
            if t not in states:
                states[t] = None
                todo.append(t)
    return list(states)


def compose(*parts: Transducer) -> tuple[list[list[int]], list[list[float]]]:
    """Product automaton: next state and factor (of a match of one word) for every (state, symbol)."""
    states = _reached(parts)
    number = {s: i for i, s in enumerate(states)}
    symbols = range(len(KINDS))
    step = [[number[tuple(p.step(x, c) for p, x in zip(parts, s))] for c in symbols] for s in states]
    factor = [[math.prod(p.factor(x, KINDS[c], 1) for p, x in zip(parts, s)) for c in symbols] for s in states]
    return step, factor


class Grammar:
    """The composed tables: ``step``, ``factor``, ``final`` (of insult and threat) and ``found`` (weight of insult and threat) of a state."""

    def __init__(self, *parts: Transducer):
        states = _reached(parts)
        self.step, self.factor = compose(*parts)
        self.final = [tuple(math.prod(p.final(x, k) for p, x in zip(parts, s)) for k in (INSULT, THREAT)) for s in states]
        self.found: dict[tuple[int, int], tuple[float, float]] = {}
        for i, s in enumerate(states):
            for c in range(len(KINDS)):
                best = [0.0, 0.0]
                for kind, weight, n in itertools.chain(*[p.found(x, c) for p, x in zip(parts, s)]):
                    best[kind] = max(best[kind], weight * math.prod(p.factor(x, kind, n) for p, x in zip(parts, s)))
                if any(best):
                    self.found[i, c] = best[0], best[1]
        self.last = {c for _, c in self.found}  # symbols that complete a pattern


def grammar(negated: float = 0.3, reported: float = 0.6, addressed: float = 1.1) -> Grammar:
    return Grammar(
        patterns(INSULT, INSULT_PHRASES, 0.9),
        patterns(THREAT, THREAT_PHRASES, 0.8),
        window(NEGATION, 2, negated, longest=max(len(p.split()) for p in (*INSULT_PHRASES, *THREAT_PHRASES))),
        until_end(SPEECH, reported),
        anywhere(TARGET, {INSULT: addressed, THREAT: 1.0}, {INSULT: 1.0, THREAT: 0.0}),
    )


class Scorer:
    """Clause scores of texts by a lexicon and a compiled grammar."""

    def __init__(self, lexicon: dict[str, float], base: float, compiled: Grammar | None = None, memory: int = 300_000):
        self.lexicon, self.base, self.memory = lexicon, base, memory
        self.grammar = compiled or grammar()
        self.shortest = min(map(len, lexicon), default=1)
        self.longest = max(map(len, lexicon), default=0)
        self.fixed = {}
        for token, symbol in SYMBOLS.items():
            kind = KINDS[symbol]
            # A threat word is an insult too where one was learned, and a learned weight is at least the weight of the threat.
            learned = self.learned(token) if kind in (THREAT, OTHER) else self.lexicon.get(token + "$", 0.0)
            self.fixed[token] = symbol, learned, max(0.8, learned) if kind == THREAT else 0.0
        self.known = dict(self.fixed)

    def learned(self, token: str) -> float:
        found = self.lexicon.get(token + "$", 0.0)
        for n in range(self.shortest, min(len(token), self.longest) + 1):
            found = max(found, self.lexicon.get(token[:n], 0.0))
        return found

    def classify(self, token: str) -> tuple[int, float, float]:
        """Symbol, weight as an insult and weight as a threat."""
        found = self.learned(token)
        return (INSULT, found, 0.0) if found else NOTHING

    def matches(self, text: str) -> list[float]:
        """Weights of the distinct clauses that hold a match: the largest of a clause, in its context."""
        tokens = TOKEN.findall(text.lower())
        classes = list(map(self.known.get, tokens))
        if None in classes:
            if len(self.known) > self.memory:
                self.known = dict(self.fixed)
            for i, c in enumerate(classes):
                if c is None:
                    t = tokens[i]
                    c = self.known.get(t)
                    if c is None:
                        c = self.known[t] = self.classify(t)
                    classes[i] = c
        g = self.grammar
        if not any(insult or threat or symbol in g.last for symbol, insult, threat in set(classes)):
            return []
        step, factor, found = g.step, g.factor, g.found
        out: dict[tuple[str, ...], float] = {}  # by the words of the clause
        state, first, held, pending = 0, 0, 0.0, 0.0
        for i, (symbol, insult, threat) in enumerate(itertools.chain(classes, [(END, 0.0, 0.0)])):
            if symbol == END:
                if held or pending:
                    by_insult, by_threat = g.final[state]
                    w = max(held * by_insult, pending * by_threat)
                    if w:
                        out.setdefault(tuple(tokens[first:i]), min(w, 0.99))
                    held = pending = 0.0
                first = i + 1
            else:
                # The last word of a phrase counts in the context of the phrase.
                by_phrase, threat_phrase = found.get((state, symbol), (0.0, 0.0)) if symbol >= 7 else (0.0, 0.0)
                held = max(held, by_phrase or insult * factor[state][INSULT])
                pending = max(pending, threat_phrase or threat * factor[state][THREAT])
            state = step[state][symbol]
        return list(out.values())

    def score(self, text: str | None) -> float:
        clean = 1.0 - self.base
        for w in self.matches(text) if text else ():
            clean *= 1.0 - w
            if clean < 1e-9:
                break
        return 1.0 - clean


def _significant(bad: Counter, all_: Counter, rate: float, precision: float, clean_weight: float, z: float = 2.6) -> dict[str, float]:
    """Features that toxic texts have significantly more often, with Wilson's lower bound of their share."""
    out, limit = {}, math.log(0.05 / max(1, len(all_)))
    for f, t in bad.items():
        n = t + (all_[f] - t) * clean_weight
        q = t / n
        if t >= 3 and q >= precision and _log_tail(t, all_[f], rate) < limit:
            out[f] = (q + z * z / 2 / n - z * math.sqrt(q * (1 - q) / n + z * z / 4 / n / n)) / (1 + z * z / n)
    return out


def _first_copies(texts: list[str]) -> list[bool]:
    """Whether no earlier text shares one of three minimal word-triple hashes, as near copies do."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        triples = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        hashes = [zlib.crc32(t) for t in triples]
        keys = {(k, min(h * f & 0xFFFFFFFF for h in hashes)) for k, f in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))}
        out.append(not keys & seen)
        seen |= keys
    return out


def _log_tail(t: int, n: int, p: float) -> float:
    """Upper bound of the log-probability that at least ``t`` of ``n`` are toxic (Chernoff)."""
    q = t / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def learn(
    texts: list[str], toxic: list[int], precision: float = 0.75, lengths: range = range(3, 9), clean_weight: float = 1.0
) -> tuple[dict[str, float], float]:
    """Lexicon (word or beginning -> weight) and share of toxic texts without any match.

    ``clean_weight`` is the number of clean rows that one in the sample stands for, per toxic row.
    """
    first = _first_copies(texts)
    pairs = [(t, y) for t, y, f in zip(texts, toxic, first) if f]
    lexicon = {w + "$": 0.9 for w in INSULTS}
    total = len(pairs)
    positive = sum(y for _, y in pairs)
    if positive and positive < total:
        rate = positive / total
        own = [(set(re.findall(r"[^\W\d_]+", t.lower())), y) for t, y in pairs]
        bad, all_ = Counter(), Counter()
        for words, y in own:
            all_.update(words)
            if y:
                bad.update(words)
        lexicon.update((w + "$", p) for w, p in _significant(bad, all_, rate, precision, clean_weight).items())
        # A beginning counts by the words that are not in the lexicon themselves, of which there must be three.
        spread: dict[str, set[str]] = {}
        bad, all_ = Counter(), Counter()
        for words, y in own:
            stems = {w[:n] for w in words if w + "$" not in lexicon for n in lengths if len(w) > n}
            all_.update(stems)
            if y:
                bad.update(stems)
        stems = _significant(bad, all_, rate, precision, clean_weight)
        for words, y in own:
            for w in words:
                for n in lengths:
                    if w[:n] in stems and w + "$" not in lexicon:
                        spread.setdefault(w[:n], set()).add(w)
        lexicon.update((p, q) for p, q in stems.items() if len(spread.get(p, ())) >= 3)
    scorer = Scorer(lexicon, 0.0)
    missed = [y for t, y in pairs if not scorer.matches(t)]
    clean = (len(missed) - sum(missed)) * clean_weight
    return lexicon, (sum(missed) + 0.5) / (sum(missed) + clean + 10.0) if missed else 0.05


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 3000, max_chars: int = 50_000) -> Scorer:
    """Learn from documents with a label: columns ``doc_id``, ``text``; ``doc_id``, ``toxic``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = per_class(known, "toxic", "doc_id", docs_per_class)  # at most about 2 x docs_per_class rows, so it may be broadcast
    rows = (
        docs.select("doc_id", "text")
        .filter(F.length("text") <= max_chars)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", "toxic")
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .toArrow()
    )
    share = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    # The sample holds more toxic rows than the corpus does.
    sampled = Counter(rows["toxic"].to_pylist())
    weight = 1.0
    if share.get(1) and share.get(0) and sampled[1] and sampled[0]:
        weight = max(1.0, (share[0] / share[1]) / (sampled[0] / sampled[1]))
    lexicon, base = learn(rows["text"].to_pylist(), rows["toxic"].to_pylist(), clean_weight=weight)
    return Scorer(lexicon, min(base, 0.5))


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns (a kept text comes last of them), score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.lexicon, scorer.base, scorer.grammar))
    carried = docs.select(*[F.col(f"`{c}`") for c in keep if c != "text"], F.col("text").cast(T.StringType()))
    kept = carried.schema.fields if "text" in keep else carried.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    n_kept = len(kept)
    out_names = schema.names

    def run(batches):
        import pyarrow as pa

        own = Scorer(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                scores = [own.score(t.as_py()) for t in part.column(part.num_columns - 1)]
                marks = [int(s >= threshold) for s in scores]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], pa.array(scores, pa.float64()), pa.array(marks, pa.int32())], out_names)

    return carried.mapInArrow(run, schema)


def with_held_out(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
