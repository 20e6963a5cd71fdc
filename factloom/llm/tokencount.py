"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

A word is split greedily: the longest initial piece that starts it, then the longest
continuation piece at each later point.  The automaton is a trie with failure links:
``link[v]`` is the state reached after the longest pieces of ``v``'s string are taken
off, ``popped[v]`` the number of pieces taken.  One pass over a word therefore gives
its number of pieces without building any.  A word that cannot be split counts as one
unknown token.  Words are the runs of bytes outside 0x20 and 0x09-0x0D.

All words of a block run through the automaton together, one byte position a step;
each distinct word of a block is matched once (equal fingerprints are settled by the
words' bytes).  What is broadcast is the vocabulary, a file that the caller chooses and
that does not grow with the data.  The file is read on the driver: through Spark's
readers where the path names a scheme, else as a local file.

Edge cases: null, empty and blank texts have 0 tokens; a null id is passed through;
repeated rows are counted separately; an empty table gives no rows; other columns are
never read, whatever they are called.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk


def read_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuation pieces of a rank file (base64 piece, space, rank a line).

    Pieces that start with a space are initial, those without white space continue a
    word; single bytes are both, so every word can be split.
    """
    if "://" in path:
        lines = [r["value"] for r in SparkSession.active().read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as file:
            lines = file.readlines()
    initial, later = set(), set()
    for line in filter(str.strip, lines):
        piece = base64.b64decode(line.split()[0])
        if piece.startswith(b" ") and len(piece) > 1 and b" " not in piece[1:]:
            initial.add(piece[1:])
        elif piece and not piece.strip(b" \t\n\r\x0b\x0c") != piece:
            later.add(piece)
    single = {bytes([b]) for b in range(256)}
    return initial | single, later | single


class Automaton:
    """Trie with failure links and popped-piece counts, as flat arrays."""

    ROOT, REST, DEAD = 0, 1, -1

    def __init__(self, initial: Iterable[bytes], later: Iterable[bytes]) -> None:
        initial, later = set(initial), set(later)
        children: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((self.ROOT, initial), (self.REST, later)):
            for piece in sorted(pieces):
                at = root
                for byte in piece:
                    after = children[at].get(byte)
                    if after is None:
                        after = len(children)
                        children[at][byte] = after
                        children.append({})
                        whole.append(False)
                    at = after
                whole[at] = True
        link, popped = [self.DEAD] * len(children), [0] * len(children)
        queue = deque([self.ROOT, self.REST])
        while queue:
            u = queue.popleft()
            for byte, v in children[u].items():
                queue.append(v)
                if whole[v]:
                    link[v], popped[v] = self.REST, 1
                    continue
                z, taken = link[u], popped[u]
                while z != self.DEAD and byte not in children[z]:
                    taken += popped[z]
                    z = link[z]
                if z != self.DEAD:
                    link[v], popped[v] = children[z][byte], taken
        # what a word still owes when it ends in a state; -1: it can't be split
        owed = [0] * len(children)
        for v in range(len(children)):
            z, taken = v, 0
            while z not in (self.ROOT, self.REST, self.DEAD):
                taken += popped[z]
                z = link[z]
            owed[v] = -1 if z == self.DEAD else taken
        keys = np.array([u << 8 | b for u, down in enumerate(children) for b in down], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.targets = np.array([v for down in children for v in down.values()], dtype=np.int32)[order]
        self.link, self.popped, self.owed = (np.array(x, dtype=np.int32) for x in (link, popped, owed))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each state, or -1."""
        key = state.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word (1 for an unknown one)."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        state = np.zeros(len(order), dtype=np.int32)
        total = np.zeros(len(order), dtype=np.int64)
        position, alive = 0, len(order)
        while True:
            alive = int(np.searchsorted(-length[:alive], -position, "left"))
            if not alive:
                break
            open_ = np.flatnonzero(state[:alive] >= 0)
            byte = data[starts[open_] + position]
            while len(open_):
                after = self.step(state[open_], byte)
                state[open_[after >= 0]] = after[after >= 0]
                open_, byte = open_[after < 0], byte[after < 0]
                total[open_] += self.popped[state[open_]]
                state[open_] = self.link[state[open_]]
                byte, open_ = byte[state[open_] >= 0], open_[state[open_] >= 0]
            position += 1
        left = np.where(state >= 0, self.owed[np.maximum(state, 0)], -1)
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.where(left < 0, 1, total + left)
        return out


def count_tokens(automaton: Automaton, column: pa.Array) -> np.ndarray:
    """Tokens of each text of an Arrow string column."""
    out = np.zeros(len(column), dtype=np.int64)
    for lo, hi, data, offsets in tk.chunks(column, 1 << 23):
        starts, ends = tk.spans(data, offsets)
        if not len(starts):
            continue
        _, first, back = np.unique(tk.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        pieces = automaton.count(data, starts[first], ends[first])[back]
        # words that only share a fingerprint are counted by themselves
        odd = np.flatnonzero(~tk.same_spans(data, starts, ends, first[back]))
        if len(odd):
            pieces[odd] = automaton.count(data, starts[odd], ends[odd])
        running = np.concatenate([[0], np.cumsum(pieces)])
        cut = np.searchsorted(starts, offsets)
        out[lo:hi] = running[cut[1:]] - running[cut[:-1]]
    return out


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the ``keep`` columns and n_tokens of every text."""
    held = docs.sparkSession.sparkContext.broadcast(Automaton(*read_vocabulary(vocabulary)))
    slim = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens(held.value, batch.column(batch.num_columns - 1))
            columns = batch.columns[:-1] + [pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", n_tokens long"
    return slim.mapInArrow(run, schema)
