"""Token counts against a greedy splitter that builds the pieces."""

import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm.tokencount import Automaton, count_tokens


def greedy(word: bytes, initial: set[bytes], later: set[bytes]) -> int:
    at, n = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def brute(text: str | None, initial, later) -> int:
    return sum(greedy(w, initial, later) for w in (text or "").encode().split())


@pytest.mark.parametrize("seed", range(30))
def test_random_vocabularies(seed):
    r = random.Random(seed)
    letters = "abc"
    word = lambda n: "".join(r.choice(letters) for _ in range(r.randint(1, n)))
    initial = {word(5).encode() for _ in range(8)}
    later = {word(4).encode() for _ in range(8)}
    if seed % 2:
        initial |= {c.encode() for c in letters}
        later |= {c.encode() for c in letters}
    texts = [" ".join(word(12) for _ in range(r.randint(0, 20))) for _ in range(40)] + [None, "", "  ", "abz é", "a" * 500]
    got = count_tokens(Automaton(initial, later), pa.array(texts))
    assert got.tolist() == [brute(t, initial, later) for t in texts]


def test_long_text_and_sliced_arrays():
    a = Automaton({b"a", b"ab"}, {b"b", b"a"})
    texts = pa.array(["ab ab", None, "abab " * 300_000, "b"]).slice(1)
    assert count_tokens(a, texts).tolist() == [0, 3 * 300_000, 1]
    assert count_tokens(a, pa.array([], pa.string())).tolist() == []
    assert isinstance(count_tokens(a, texts), np.ndarray)
