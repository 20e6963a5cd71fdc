"""Toxicity by a lexicon met through Levenshtein automata, with context windows.

Lexicon.  Terms are learned from labelled rows: words (runs of letters, lowered) and
stems (word prefixes of ``STEMS`` letters) that many toxic and hardly any other
labelled texts hold; so many that, dealt by chance, fewer than ``CHANCE`` terms of the
whole lexicon would get there.  The training rows are a bounded, documented sample of
at most ``FIT_ROWS`` toxic and ``FIT_CLEAN`` other labelled texts, of at most
``FIT_CHARS`` characters.

Matching.  The terms form a trie; the Levenshtein automaton of distance 1 (terms of
``FUZZY_FROM`` letters and more; swapped neighbours are one edit) is intersected with it
by determinising the product (trie node, edits).  A lexicon whose product has over
``MAX_STATES`` states is halved into several automata, so none of its terms is left out.
A word ends with the nearest term it spells; stem terms accept any ending and no edits.
All words of a block run through the automaton together, one character a step.  A misspelled term counts only if its spellings kept
``PURITY`` on the training rows, so that common words one edit away are no evidence.

Context.  A match is quoted if one of the ``WINDOW`` characters before and after it is
a quotation mark or one of the ``WINDOW_WORDS`` words before it is a cue; quoted and
plain matches are separate features.  Cues are learned, in whatever language: words
that stand before at least ``CUE_HITS`` counted matches of clean texts and, rate for
rate, at least ``CUE_RATIO`` times as often there as before those of toxic texts.

Score.  Logistic regression on the counts of plain and quoted, exact and misspelled
matches.  Edge cases: null and empty texts get the score of a text without matches;
without labelled rows of both kinds every score is 0; repeated rows score alike; ids and
other columns may be null and are passed through; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import bands, doc_shingles

FIT_ROWS, FIT_CLEAN, FIT_CHARS = 1200, 4800, 10_000
STEMS, MIN_DOCS, PURITY, FUZZY_FROM = (4, 5, 6), 4, 0.97, 4
MAX_STATES = 100_000
CUE_HITS, CUE_RATIO, CHANCE = 3, 4.0, 1.0
WINDOW, WINDOW_WORDS = 2, 3
QUOTES = "\"'“”«»‘’`"


@dataclass
class Matcher:
    """Deterministic automaton over letters: trie of the terms crossed with edits."""

    moves: np.ndarray  # state x letter class -> state (0 is dead)
    letters: np.ndarray  # sorted code points; class 0 is any other character
    final: np.ndarray  # state -> 1 + 2 * term + misspelled, 0 if none


class TooManyStates(ValueError):
    """The product of these terms is too large for one automaton."""


def build(terms: list[tuple[str, bool]], fuzzy_from: int = FUZZY_FROM, first: int = 0, max_states: int = MAX_STATES) -> Matcher:
    """Terms are (letters, is stem), numbered from ``first``.  Edits are single characters; accented letters count as one.

    NFA states are (term, letters read, edits), with edits = SWAP where the next letter was
    read and this one has to follow; sets of them become DFA states.
    """
    swap = 2
    letters = sorted({c for t, _ in terms for c in t})
    symbol = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
    edits = [not stem and len(word) >= fuzzy_from for word, stem in terms]

    def closure(items) -> frozenset:
        best: dict[tuple[int, int, bool], int] = {}
        stack = list(items)
        while stack:
            t, p, e = stack.pop()
            if best.get((t, p, e == swap), 9) <= e:
                continue
            best[(t, p, e == swap)] = e
            if e < 1 and edits[t] and p < len(terms[t][0]):
                stack.append((t, p + 1, e + 1))  # a letter is missing
        return frozenset((t, p, e) for (t, p, _), e in best.items())

    def move(state: frozenset, s: int) -> frozenset:
        out = []
        for t, p, e in state:
            word, stem = terms[t]
            if p == len(word):
                if stem:
                    out.append((t, p, e))
                elif e < 1 and edits[t]:
                    out.append((t, p, e + 1))
                continue
            if e == swap:
                if symbol[word[p]] == s:
                    out.append((t, p + 2, 1))
                continue
            if symbol[word[p]] == s:
                out.append((t, p + 1, e))
            if e < 1 and edits[t]:
                out += [(t, p, e + 1), (t, p + 1, e + 1)]
                if p + 1 < len(word) and symbol[word[p + 1]] == s:
                    out.append((t, p, swap))
        return closure(out)

    start = closure((t, 0, 0) for t in range(len(terms)))
    ids = {frozenset(): 0, start: 1}
    order, rows, final = [frozenset(), start], [[0] * (len(letters) + 1)], [0, 0]
    at = 1
    while at < len(order):
        row = []
        for s in range(len(letters) + 1):
            after = move(order[at], s)
            if after not in ids:
                if len(ids) > max_states:
                    raise TooManyStates(f"{len(terms)} terms")
                ids[after] = len(order)
                order.append(after)
                ends = sorted((e, t) for t, p, e in after if p == len(terms[t][0]))
                final.append(1 + 2 * (first + ends[0][1]) + ends[0][0] if ends else 0)
            row.append(ids[after])
        rows.append(row)
        at += 1
    return Matcher(np.array(rows, dtype=np.int32), np.array([ord(c) for c in letters], dtype=np.uint32), np.array(final, dtype=np.int32))


def build_all(terms: list[tuple[str, bool]], max_states: int = MAX_STATES) -> list[Matcher]:
    """Automata that hold all terms between them."""
    todo, out = [(0, len(terms))] if terms else [], []
    while todo:
        lo, hi = todo.pop()
        try:
            out.append(build(terms[lo:hi], first=lo, max_states=max_states if hi - lo > 1 else 1 << 30))
        except TooManyStates:
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
    return out


def points(text: str) -> np.ndarray:
    """Lowered code points (one each, so that positions stay)."""
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_KIND = np.array([chr(c).isalpha() for c in range(0x3000)])


def word_spans(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters."""
    inside = _KIND[np.minimum(p, 0x2FFF)]
    high = np.flatnonzero(p >= 0x3000)
    if len(high):
        some, back = np.unique(p[high], return_inverse=True)
        inside[high] = np.array([chr(c).isalpha() for c in some])[back]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def match(m: Matcher, p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``final`` of each word; words leave the loop as soon as their state is dead."""
    at = np.searchsorted(m.letters, p)
    symbols = np.where(m.letters[np.minimum(at, len(m.letters) - 1)] == p, at + 1, 0)
    state = np.ones(len(starts), dtype=np.int32)
    live, at = np.arange(len(starts)), 0
    while len(live):
        live = live[ends[live] - starts[live] > at]
        state[live] = m.moves[state[live], symbols[starts[live] + at]]
        live = live[state[live] > 0]
        at += 1
    return m.final[state]


def nearest(matchers: list[Matcher], p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best ``final`` of each word over all automata: exact before misspelled, then the smaller term."""
    best = match(matchers[0], p, starts, ends)
    for m in matchers[1:]:
        other = match(m, p, starts, ends)
        rank = lambda f: np.where(f > 0, ((f - 1) % 2).astype(np.int64) * (1 << 40) + f, 1 << 60)
        best = np.where(rank(other) < rank(best), other, best)
    return best


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    matchers: list[Matcher] = field(default_factory=list)
    cues: frozenset[str] = frozenset()
    allowed: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # by ``final``
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    empty: bool = True

    def hits(self, texts: list[str]) -> list[list[tuple[int, bool, set[str]]]]:
        """(final, quoted, the words before it) of each matched word of each text."""
        p = np.concatenate([np.append(points(t), np.uint32(10)) for t in texts])
        starts, ends = word_spans(p)
        row_end = np.cumsum([len(t) + 1 for t in texts])
        found = nearest(self.matchers, p, starts, ends)
        out: list[list] = [[] for _ in texts]
        for w in np.flatnonzero(found):
            row = int(np.searchsorted(row_end, starts[w], "right"))
            base = int(row_end[row - 1]) if row else 0
            s, e = int(starts[w]) - base, int(ends[w]) - base
            text = texts[row]
            quoted = any(c in QUOTES for c in text[max(0, s - WINDOW) : s] + text[e : e + WINDOW])
            before = set()
            for back in range(1, WINDOW_WORDS + 1):
                if w - back < 0 or starts[w - back] < base:
                    break
                before.add(text[int(starts[w - back]) - base : int(ends[w - back]) - base].lower())
            out[row].append((int(found[w]), quoted or bool(before & self.cues), before))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """1, plain exact, plain misspelled, quoted exact, quoted misspelled (presence; log counts of misspellings)."""
        out = np.zeros((len(texts), 5))
        out[:, 0] = 1
        if self.matchers:
            for row, hits in zip(out, self.hits(texts), strict=True):
                for final, quoted, _ in hits:
                    if self.allowed[final]:
                        row[1 + (final - 1) % 2 + 2 * quoted] += 1
            out[:, 1::2] = np.minimum(out[:, 1::2], 1)
            out[:, 2::2] = np.log1p(out[:, 2::2])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text; long runs of texts go in blocks."""
        out = np.zeros(len(texts))
        if self.empty:
            return out
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 1 << 20):
                size += len(texts[hi] or "")
                hi += 1
            out[lo:hi] = 1 / (1 + np.exp(-self.features([t or "" for t in texts[lo:hi]]) @ self.weights))
            lo = hi
        return out


def distinct(texts: list[str]) -> list[int]:
    """Rows without near copies of earlier rows (a shared signature band), so that copies don't make terms."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, found in enumerate(doc_shingles(pa.array(texts, pa.string()), 3)):
        keys = set(enumerate(bands(found).tolist())) if len(found) else {(-1, 0)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def fit(texts: list[str], labels: list[int]) -> Model:
    """Lexicon, trusted misspellings and weights from labelled texts."""
    model = Model()
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return model
    model.empty = False
    toxic, clean, halves = Counter(), Counter(), Counter()
    kept = distinct(texts)
    for k in sorted(kept, key=lambda k: -labels[k]):
        text, label = texts[k], labels[k]
        p = points(text)
        lowered = p.tobytes().decode("utf-32-le", "surrogatepass")
        words = {lowered[s:e] for s, e in zip(*word_spans(p), strict=True)}
        found = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) >= n}
        if not label:
            clean.update(found & toxic.keys())  # other words can't become terms
        else:
            toxic.update(found)
            halves.update((key, zlib.crc32(text.encode("utf-8", "replace")) % 2) for key in found)
    n_toxic, n_clean = max(1, y[kept].sum()), max(1, len(kept) - y[kept].sum())
    # k of k texts are toxic by chance with the k-th power of the toxic share
    least = max(MIN_DOCS, math.log(max(len(toxic), 1) / CHANCE) / -math.log(n_toxic / (n_toxic + n_clean)))

    def pure(key) -> bool:
        a, b = toxic[key] / n_toxic, clean[key] / n_clean
        return toxic[key] >= least and a >= PURITY * (a + b) and all(halves[key, i] > 1 for i in (0, 1))

    good = {k for k in toxic if pure(k)}
    # a stem gives way to a longer one that nearly all its texts hold; then the shortest pure
    # stem stands for its words, and a word stands alone where no stem does
    stems = {w for w, stem in good if stem}
    longest: dict[str, int] = {}
    for (w, stem), n in toxic.items():
        if stem:
            for k in STEMS:
                if k < len(w):
                    longest[w[:k]] = max(longest.get(w[:k], 0), n)
    stems = {w for w in stems if longest.get(w, 0) < 0.9 * toxic[w, True]}
    stems = {w for w in stems if not any(w[:n] in stems for n in range(1, len(w)))}
    inflected = {w for w in stems if sum(1 for x, s in toxic if not s and x.startswith(w)) > 3}
    words = {w for w, stem in good if not stem and not any(w.startswith(s) for s in inflected)}
    ranked = sorted([(-toxic[(w, True)], w, True) for w in inflected] + [(-toxic[(w, False)], w, False) for w in words])
    model.terms = [(w, stem) for _, w, stem in ranked]
    if model.terms:
        model.matchers = build_all(model.terms)
        held, met, size = Counter(), [], 1 + 2 * len(model.terms)
        model.allowed = np.ones(size, dtype=bool)
        for lo in range(0, len(texts), 200):
            for label, hits in zip(labels[lo : lo + 200], model.hits(texts[lo : lo + 200]), strict=True):
                held.update((f, bool(label)) for f in {h[0] for h in hits})
                met += [(bool(label), f, words) for f, _, words in hits]
        for f in range(2, size, 2):
            a, b = held[f, True] / n_toxic, held[f, False] / n_clean
            # spellings never met in training are trusted; met ones must be pure
            model.allowed[f] = a >= PURITY * (a + b)
        before = Counter((w, label) for label, f, words in met if model.allowed[f] for w in words)
        model.cues = frozenset(w for w, label in before if not label and before[w, False] >= CUE_HITS and before[w, False] / n_clean >= CUE_RATIO * before[w, True] / n_toxic)
    x = np.concatenate([model.features(texts[lo : lo + 200]) for lo in range(0, len(texts), 200)])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    w = np.zeros(5)
    ridge = np.diag([1e-6, 0.05, 0.05, 0.05, 0.05])
    for _ in range(50):  # Newton steps
        q = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + ridge + 1e-9 * np.eye(5), x.T @ (weight * (y - q)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    # misspellings hardly occur without exact matches in a sample; unless they speak against it there,
    # two of them weigh more than half an exact match
    for exact, near in ((1, 2), (3, 4)):
        lone = (x[:, near] > 0) & (x[:, exact] == 0)
        if not lone.any() or y[lone].mean() >= 0.5:
            w[near] = max(w[near], 0.6 * w[exact] / np.log(3))
    model.weights = w
    return model


def sample(docs: DataFrame, labels: DataFrame, training: Column, rows: int = FIT_ROWS, clean: int = FIT_CLEAN, max_chars: int = FIT_CHARS) -> tuple[list[str], list[int]]:
    """At most ``rows`` toxic and ``clean`` other training texts, by the smallest id hash."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & training).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    h = F.xxhash64("doc_id").bitwiseAND(F.lit(2**62 - 1))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [], []
    cut = F.when(F.col("toxic") == 1, F.lit(int(2**62 * min(1.0, (1.5 * rows + 50) / counts[1])))).otherwise(F.lit(int(2**62 * min(1.0, (1.5 * clean + 50) / counts[0]))))
    found: dict[int, list] = {0: [], 1: []}
    for r in marked.withColumn("h", h).where(F.col("h") < cut).distinct().collect():
        found[r["toxic"]].append((r["h"], r["doc_id"]))
    label = {i: t for t in (0, 1) for _, i in sorted(found[t])[: rows if t else clean]}
    # at most ``rows`` + ``clean`` ids: the bound of the sample
    wanted = docs.sparkSession.createDataFrame([(i,) for i in label], docs.select("doc_id").schema)
    kept = docs.where(F.length("text").between(1, max_chars)).select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi").distinct().collect()
    kept = sorted((r["doc_id"], r["text"]) for r in kept)
    return [t for _, t in kept], [label[i] for i, _ in kept]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """The ``keep`` columns and the score of each text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                scores = held.value.score(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", score double"
    return slim.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array(held.value.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
