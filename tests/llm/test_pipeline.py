"""The corpus pipeline against a plain-Python version of its decisions."""

import random
import re

import pytest

import corpus_pipeline
from factloom.llm import tokencount
from factloom.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY
from tests.llm.test_operators import ASSIGN, components_of, words7

BAD = ["blockhead", "nitwit", "scoundrel"]


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(11)
    words = ["".join(r.choice("abdegilnorstu") for _ in range(r.randint(3, 8))) for _ in range(900)]
    line = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(line(14))) for i in range(4)]
    docs, labels = [], []
    for i in range(320):
        w = line(r.randint(20, 60))
        if i % 5 == 0:
            w[r.randrange(len(w))] = r.choice(BAD)
        if i % 17 == 3:
            w[5:5] = items[i % 4][1].split()
        if i % 13 == 2:
            w.append(f"token={r.getrandbits(128):032x}")
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(320, 340):  # near copies of clean documents
        w = docs[(i - 319) * 7 + (1 if (i - 319) * 7 % 5 == 0 else 0)][1].split()
        w[-1] = "changed"
        docs.append((i, " ".join(w), "en", "s0", 0))
    docs += [(340, None, None, None, None), (341, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def test_pipeline(spark, folder):
    path, docs, items = folder
    out = corpus_pipeline.run(spark, path).collect()
    clean = [d for d in docs if not set((d[1] or "").split()) & set(BAD)]
    sets = {}
    for i, t, *_ in clean:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = components_of(sets)
    grams = {tuple(v[k : k + 10]) for v in (words7(t) for _, t in items) for k in range(len(v) - 9)}
    left = {i: t or "" for i, t, *_ in clean if low[i] == i and not any(tuple(words7(t)[k : k + 10]) in grams for k in range(len(words7(t)) - 9))}
    assert {r["doc_id"] for r in out} == set(left)
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    redacted = {i: ASSIGN.sub("[SECRET]", t) for i, t in left.items()}
    assert any("[SECRET]" in t for t in redacted.values())
    counted = tokencount.token_counts(spark.createDataFrame(list(redacted.items()), "doc_id long, text string"), VOCABULARY).collect()
    assert total == {r["doc_id"]: r["n_tokens"] for r in counted}
    full = [r for r in out if r["bin"] is not None]
    for b in {r["bin"] for r in full}:
        assert sum(r["length"] for r in full if r["bin"] == b) <= 2048


def test_stages_keep_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert (out.columns, out.schema["text"].dataType) == (docs.columns, docs.schema["text"].dataType)
        empty = stage(spark, docs.limit(0), path)
        assert empty.count() == 0


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5
