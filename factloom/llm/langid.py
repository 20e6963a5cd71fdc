"""Language identification with a blended-spectrum string kernel.

Kernel.  A text's features are the distinct character n-grams (n = 1..3) it holds
among those that occur in the landmarks; the kernel of two texts is the size of the
common set over the root of the product of the set sizes.  Nystroem features come
from ``LANDMARKS`` training texts (one a language at least), then one ridge regression a
language (one versus rest) is fitted on them.  Letters are lowered; runs of other
characters are one separator; every letter of the training sample is a class of its own,
letters never seen there share one.

Because the kernel against every landmark is linear in a text's presence vector, the
landmark matrix, the Nystroem whitening and the ridge weights fold into one matrix;
a block of texts is scored by one product of its presence matrix with it.

Fit.  Only training rows with a language and 1 to ``MAX_CHARS`` characters are used,
at most ``PER_LANGUAGE`` of each language, those of the smallest hash of the id (fewer,
but one at least, where more than ``FIT_TEXTS`` would come together): a bounded,
documented sample.  Every text is scored whole, in pieces of ``CHARS`` characters that
carry the last two classes over, so a cut adds no separator.

Edge cases: null texts and texts without a letter are ``und`` with score 0; so is all
if nothing could be learned.  Ties go to the smaller language name.  Repeated rows get
equal answers; null ids are passed through; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_LANGUAGE, FIT_TEXTS, MAX_CHARS, LANDMARKS, RIDGE = 300, 20_000, 20_000, 240, 1e-3
#: Up to so many possible n-grams are looked up in a flat table, more in a sorted list.
FLAT = 1 << 22
#: Texts and characters scored at once.
ROWS, CHARS = 256, 1 << 20


def _codes(text: str, classes: dict[int, int], table: np.ndarray) -> np.ndarray:
    """Class of each character: 0 separator, 1 unknown letter, 2.. the alphabet."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = table[np.minimum(points, len(table) - 1)]
    high = np.flatnonzero(points >= len(table) - 1)
    if len(high):
        out = out.copy()
        out[high] = [classes.get(int(p), 1 if chr(p).isalpha() else 0) for p in points[high]]
    return out


def _grams(c: np.ndarray, base: int) -> np.ndarray:
    """Ids of the n-grams of orders 1 to 3 of classes without repeated separators."""
    two = c[:-1] * base + c[1:]
    three = two[:-1] * base + c[2:]
    return np.concatenate([c, two + base, three + base + base * base])


def _pieces(text: str, classes: dict[int, int], table: np.ndarray) -> Iterator[np.ndarray]:
    """The classes of a text between two separators, runs of separators once, piece by piece with two classes carried over."""
    carry = np.zeros(1, dtype=np.int64)
    for lo in range(0, len(text) + 1, CHARS):
        last = lo + CHARS > len(text)
        codes = _codes(text[lo : lo + CHARS], classes, table).astype(np.int64)
        c = np.concatenate([carry, codes, np.zeros(int(last), np.int64)])
        c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
        yield c
        carry = c[-2:]


@dataclass
class Model:
    """Everything a scorer needs: a few megabytes, bounded by the parameters."""

    classes: dict[int, int]
    table: np.ndarray
    base: int
    found: np.ndarray  # the landmarks' n-grams, sorted
    weights: np.ndarray
    languages: list[str]
    flat: np.ndarray | None = None  # column of each possible n-gram

    def columns(self, text: str) -> Iterator[np.ndarray]:
        """Columns of the landmark n-grams that a text holds (the number of columns for other n-grams)."""
        for piece in _pieces(text, self.classes, self.table):
            grams = _grams(piece, self.base)
            if self.flat is not None:
                yield self.flat[grams]
                continue
            grams = np.unique(grams)
            at = np.minimum(np.searchsorted(self.found, grams), max(len(self.found) - 1, 0))
            yield at[self.found[at] == grams]

    def presence(self, texts: list[str]) -> np.ndarray:
        """0/1 rows over the landmark n-grams, divided by the root of their sums."""
        width = len(self.found)
        out = np.zeros((len(texts), width + 1), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for at in self.columns(text):
                row[at] = 1
        out = out[:, :width]
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for lo in range(0, len(live), ROWS):
            rows = live[lo : lo + ROWS]
            margins = self.presence([texts[i] for i in rows]).astype(np.float64) @ self.weights
            best = margins.argmax(axis=1)
            for i, b, m in zip(rows, best, margins.max(axis=1), strict=True):
                names[i] = self.languages[b]
                scores[i] = min(1.0, max(0.0, float(m)))
        return names, scores


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on a bounded sample; ``texts`` in a fixed order make the model deterministic."""
    names = sorted(set(languages))
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
    classes = {ord(c): i + 2 for i, c in enumerate(letters)}
    table = np.array([classes.get(p, 1 if chr(p).isalpha() else 0) for p in range(0x3000)], dtype=np.int32)
    base = len(letters) + 2
    model = Model(classes, table, base, np.zeros(0, np.int64), np.zeros((0, len(names))), names)
    if not texts:
        return model
    # landmarks: the first texts of each language in turn
    turn = Counter()
    order = sorted(range(len(texts)), key=lambda i: (turn.update([languages[i]]) or turn[languages[i]], languages[i], i))
    chosen = order[: max(landmarks, len(names))]
    model.found = np.unique(np.concatenate([_grams(c, base) for i in chosen for c in _pieces(texts[i], classes, table)]))
    if base + base * base + base**3 <= FLAT:
        model.flat = np.full(base + base * base + base**3, len(model.found), dtype=np.int32)
        model.flat[model.found] = np.arange(len(model.found), dtype=np.int32)
    model.weights = np.zeros((len(model.found), len(names)))
    marks = model.presence([texts[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    gram, answer = np.zeros((whiten.shape[1],) * 2), np.zeros((whiten.shape[1], len(names)))
    for lo in range(0, len(texts), ROWS):
        part = model.presence(texts[lo : lo + ROWS]).astype(np.float64) @ marks.T @ whiten
        gram += part.T @ part
        answer += part.T @ np.array([[float(x == y) for y in names] for x in languages[lo : lo + ROWS]])
    solved = np.linalg.solve(gram + ridge * len(texts) * np.eye(len(gram)), answer)
    model.weights = marks.T @ (whiten @ solved)
    return model


def sample(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS, fit_texts: int = FIT_TEXTS) -> tuple[list[str], list[str]]:
    """At most ``per_language`` training texts of each language, by the smallest id hash."""
    spark = docs.sparkSession
    usable = docs.where(training & F.col("lang").isNotNull() & F.length("text").between(1, max_chars)).select("doc_id", "lang", "text")
    counts = [(r["lang"], r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not counts:
        return [], []
    per_language = max(1, min(per_language, fit_texts // len(counts)))
    # a cut on the hash passes about twice the rows wanted of each language; the smallest of them are taken
    cuts = spark.createDataFrame([(lang, int(2**62 * min(1.0, (2 * per_language + 50) / n))) for lang, n in counts], "lang string, cut long")
    h = F.xxhash64("doc_id").bitwiseAND(F.lit(2**62 - 1))
    by_language: dict[str, list] = {}
    for row in usable.select("doc_id", "lang", h.alias("h")).join(F.broadcast(cuts), "lang").where("h < cut").select("lang", "h", "doc_id").collect():
        by_language.setdefault(row["lang"], []).append((row["h"], row["doc_id"]))
    picked = sorted({i for rows in by_language.values() for _, i in sorted(rows)[:per_language]})
    # at most ``fit_texts`` ids (or one a language): the bound of the sample
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in picked], usable.select("doc_id").schema))
    rows = usable.join(wanted, "doc_id", "left_semi").select("doc_id", "lang", "text").collect()
    seen: Counter = Counter()
    texts, languages = [], []
    for row in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        seen[row["lang"]] += 1
        if seen[row["lang"]] <= per_language:
            texts.append(row["text"])
            languages.append(row["lang"])
    return texts, languages


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, text) to (doc_id, held_out, lang_pred, score)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                names, scores = held.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
