"""Graph operators against small fixtures and sequential references."""

import json
import random
from collections import deque

import pytest

from factloom.operators import align, claims, compare, emit, explore, flows, metrics, project, semantics, traverse, validate
from factloom.schema import EvidenceGraph
from factloom.sources import configs, documents, repository, traces


def node(i, level="operation", kind="operation", identity="definition", label=None, **more):
    return {"id": i, "level": level, "kind": kind, "identity_kind": identity, "label": label or i} | more


def edge(i, s, t, kind="data"):
    return {"id": i, "source": s, "target": t, "kind": kind}


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


# -- traversal ------------------------------------------------------------------------


def sequential(flow, origins, max_depth, max_nodes):
    """A queue, one node at a time: the reference for the ordered, bounded walk."""
    out = {}
    for e in sorted(flow, key=lambda e: (e[3], e[0])):
        out.setdefault(e[1], []).append(e)
    seen, edges, queue = {o: 0 for o in sorted(origins)}, set(), deque(sorted(origins))
    while queue:
        at = queue.popleft()
        if seen[at] == max_depth:
            continue
        for e in out.get(at, []):
            edges.add(e[0])
            if e[2] not in seen:
                if len(seen) >= max_nodes:
                    return set(seen), edges, True
                seen[e[2]] = seen[at] + 1
                queue.append(e[2])
    return set(seen), edges, False


@pytest.mark.parametrize("seed", range(4))
def test_bounded_lineage(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    flow = [(f"e{i:03d}", r.choice(names), r.choice(names), r.choice(["data", "next", "alias"])) for i in range(30)]
    origins, depth, bound = r.sample(names, 2), r.randint(1, 5), r.choice([4, 7, 50])
    nodes, edges, cut = traverse.bounded_lineage(spark.createDataFrame(flow, "edge_id string, src string, dst string, kind string"), spark.createDataFrame([(o,) for o in origins], "id string"), depth, bound)
    assert (set(ids(nodes)), set(ids(edges, "edge_id")), cut) == sequential(flow, origins, depth, bound)


def test_paths_and_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "y"), ("y", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert traverse.shortest_path(edges, "a", "d") == ["a", "b", "c", "d"]
    assert traverse.shortest_path(edges, "d", "a") == [] and traverse.shortest_path(edges, "a", "a") == ["a"]
    assert ids(traverse.khop(edges, spark.createDataFrame([("d",)], "id string"), 1)) == ["c", "d"]
    assert {r["id"]: r["depth"] for r in traverse.reach(edges, spark.createDataFrame([("a",)], "id string")).collect()} == {"a": 0, "b": 1, "x": 1, "c": 2, "y": 2, "d": 3}
    with pytest.raises(ValueError):
        traverse.bounded_lineage(edges, edges, 1, 0)


def test_hierarchy_and_expand(spark):
    g = EvidenceGraph.of(
        spark,
        nodes=[node("s", "semantic", "semantic_component", "group", attributes_json=json.dumps({"member_ids": ["m", "ghost"]})), node("m", "module"), node("o1", parent_ids=["m"]), node("o2", parent_ids=["m", "s"]), node("o3"), node("v", kind="tensor", identity="value")],
        edges=[edge("c1", "s", "o1", "contains"), edge("f1", "o3", "v", "produces"), edge("x", "m", "o1", "contains")],
    )
    assert sorted(map(tuple, g.hierarchy().collect())) == [("m", "o1"), ("m", "o2")]
    assert sorted(map(tuple, g.membership().collect())) == [("s", "m"), ("s", "o1")]
    assert sorted(map(tuple, explore.top_members(g.membership(), g.hierarchy()).collect())) == [("s", "m")]
    children = sorted(map(tuple, explore.children_of(g).select("parent", "child").collect()))
    assert children == [("m", "o1"), ("m", "o2"), ("o3", "v"), ("s", "m"), ("v", "o3")]
    assert [(r["child"], r["child_count"], r["truncated"]) for r in explore.expand(g.hierarchy(), 1).collect()] == [("o1", 2, True)]
    crumbs = traverse.breadcrumbs(g.hierarchy(), g.membership(), spark.createDataFrame([("o2",)], "id string"))
    assert [r["crumb"] for r in crumbs.orderBy("position").collect()] == ["s", "m", "o2"]
    shown, inner = traverse.visible(g.hierarchy(), spark.createDataFrame([("m",)], "id string"), spark.createDataFrame([("m",)], "id string"), g.edges)
    assert ids(shown) == ["m", "o1", "o2"] and inner.count() == 0


def test_search(spark):
    g = EvidenceGraph.of(spark, nodes=[node(f"node.{i}", label=f"Operator{i}", run_id="a" if i % 2 else None) for i in range(300)] + [node("z", label="x", attributes_json='{"note":"Operator9 deep","list":["Operator9"]}')])
    found = explore.search(g.nodes, " operator299 ").collect()
    assert [(r["id"], r["score"]) for r in found] == [("node.299", 110)]
    assert explore.search(g.nodes, "operator299", run_id="b").count() == 0
    assert explore.search(g.nodes, "  ").count() == 0
    top = explore.search(g.nodes, "operator9", limit=3).collect()
    assert [r["score"] for r in top] == [110, 80, 80] and top[0]["key"] == "operation:node.9"
    assert explore.search(g.nodes, "deep operator9").first()["id"] == "z"
    with pytest.raises(ValueError):
        explore.search(g.nodes, "x", limit=0)


# -- integrity, merge, alignment -------------------------------------------------------


def test_violations(spark):
    ok = EvidenceGraph.of(spark, nodes=[node("d"), node("o", identity="occurrence", definition_id="d", run_id="r", occurrence_index=0)], runs=[{"id": "r"}], edges=[edge("e", "d", "o")])
    validate.require_valid(ok)
    bad = EvidenceGraph.of(
        spark,
        nodes=[node("d", identity="value", source=[("p.py", 3, 2, 0, 0, None)]), node("o", identity="occurrence", definition_id="d", occurrence_index=0), node("r")],
        runs=[{"id": "r"}], edges=[edge("e", "d", "gone", "odd")],
        claims=[{"id": "c", "subject_id": "d", "predicate": "p", "confidence": 2.0}],
        conflicts=[{"id": "k", "claim_ids": ["c", "c"], "kind": "other", "status": "resolved"}],
        coverage=[{"id": "v", "subject_id": "d", "status": "sometimes_observed", "considered_run_ids": ["r"], "observed_run_ids": ["r"]}],
    )
    rules = {r["rule"] for r in validate.violations(bad).collect()}
    assert rules >= {"span_order", "occurrence_without_run", "definition_kind", "duplicate_id", "edge_target", "domain_edge_kind", "claim_object_xor_value", "confidence_range", "conflict_claims", "conflict_resolution", "coverage_sometimes"}
    with pytest.raises(ValueError):
        validate.require_valid(bad)


def test_reconcile(spark):
    span = lambda p, a, b, s: [(p, a, b, None, None, s)]
    static = EvidenceGraph.of(spark, nodes=[node("s.left", "source", "other", "source", "forward", source=span("left/model.py", 2, 3, "Tiny.forward")), node("s.right", "source", "other", "source", "forward", source=span("right/model.py", 2, 3, "Tiny.forward"))])
    runtime = EvidenceGraph.of(
        spark, runs=[{"id": "run.0"}, {"id": "run.1"}],
        nodes=[node("rt", source=span("/workspace/right/model.py", 2, 3, "Tiny.forward")), node("occ", identity="occurrence", definition_id="rt", run_id="run.0", occurrence_index=0)],
    )
    merged = align.reconcile(static, runtime)
    alias = merged.edges.where("kind = 'alias'").collect()
    assert [(e["source"], e["target"]) for e in alias] == [("rt", "s.right")]
    cover = merged.coverage.collect()
    assert [(c["status"], c["observed_run_ids"], c["considered_run_ids"]) for c in cover] == [("sometimes_observed", ["run.0"], ["run.0", "run.1"])]
    validate.require_valid(merged)
    assert align.merge(static, static).nodes.count() == 2
    with pytest.raises(ValueError):
        align.merge(static, static.with_tables(nodes=EvidenceGraph.of(spark, nodes=[node("s.left")]).nodes))


# -- semantics and claims ---------------------------------------------------------------


def chain(spark, labels, links, kind="module"):
    nodes = [node(f"n{i}", "module", kind, label=l, source=[(f"models/n{i}.py", i + 1, i + 1, None, None, None)]) for i, l in enumerate(labels, 1)]
    return EvidenceGraph.of(spark, nodes=nodes, edges=[edge(f"edge.data.{k}", f"n{a}", f"n{b}") for k, (a, b) in enumerate(links)])


def roles(g):
    return {r["role"] for r in g.nodes.where("level = 'semantic'").collect()}


def test_recover_and_project(spark):
    g, rest = semantics.recover(chain(spark, ["VisionEncoder", "LanguageEncoder", "CrossModalFusion", "DiffusionDenoiser", "ActionHead"], [(1, 3), (2, 3), (3, 4), (4, 5)]))
    assert roles(g) == {"vision_encoder", "language_encoder", "multimodal_fusion", "diffusion_denoiser", "action_head"} and rest.count() == 0
    fusion = json.loads(g.nodes.where("role = 'multimodal_fusion'").first()["attributes_json"])
    assert fusion["confidence"] >= 0.9 and fusion["member_ids"] == ["n3"]
    assert g.edges.where("kind = 'data'").count() == 4
    chosen, edges = project.paper_view(g)
    assert chosen.count() == 5 and sorted(e for r in edges.collect() for e in r["edge_ids"]) == [f"edge.data.{k}" for k in range(4)]
    assert project.components(g, phase="training").count() == 4
    assert project.components(g, limit=2).count() == 2
    with pytest.raises(ValueError):
        project.components(g, min_confidence=2)


def test_recover_cycle_override_unknown(spark):
    g, _ = semantics.recover(chain(spark, ["RobotPolicy", "LowLevelController", "RobotEnvironment"], [(1, 2), (2, 3), (3, 1)]))
    assert roles(g) == {"policy", "controller", "environment"}
    g, rest = semantics.recover(chain(spark, ["MysteryBlock7"], []))
    assert roles(g) == set() and [r["status"] for r in rest.collect()] == ["unknown"]
    g, _ = semantics.recover(chain(spark, ["StateEncoder"], []), overrides=[{"role": "world_model", "member_ids": ["n1"]}])
    assert roles(g) == {"world_model"}
    with pytest.raises(ValueError):
        semantics.recover(chain(spark, ["A"], []), overrides=[{"role": "policy", "member_ids": ["nobody"]}])
    g, _ = semantics.recover(chain(spark, ["PolicyThing"], [], kind="loss"))
    assert roles(g) == {"loss"}


def test_claims(spark):
    docs = spark.createDataFrame([("README.md", "It uses a cross-modal fusion module.\nThe model does not use a planner\nThe vision encoder is frozen.\nfrozen and trainable vision encoder")], "path string, text string")
    found = {(r["line"], r["role"], r["predicate"], r["value"]) for r in claims.declarations(claims.lines_of(docs)).collect()}
    assert found == {(1, "multimodal_fusion", "component_present", True), (2, "planner", "component_present", False), (3, "vision_encoder", "component_present", True), (3, "vision_encoder", "frozen", True), (4, "vision_encoder", "component_present", True)}
    author = spark.createDataFrame([("c1", "s", "frozen", True), ("c2", "t", "frozen", True), ("c3", "u", "frozen", True)], "claim_id string, subject_id string, predicate string, value boolean")
    votes = claims.unanimous(spark.createDataFrame([("s", False), ("s", False), ("t", True), ("t", False)], "subject_id string, value boolean"))
    from pyspark.sql import functions as F

    impl = votes.select("subject_id", F.lit("frozen").alias("predicate"), "value", F.concat(F.lit("i."), "subject_id").alias("impl_id"))
    compared = claims.compare(author, impl)
    assert {r["claim_id"]: r["status"] for r in compared.collect()} == {"c1": "contradicted", "c2": "unresolved", "c3": "unresolved"}
    assert ids(claims.conflicts(compared), "author_claim") == ["c1"]


def test_diff_and_collapse(spark):
    schema = "id string, role string, label string, phase string, modalities array<string>, n_members int, ordinal int"
    a = spark.createDataFrame([("a1", "loss", "L", "both", [], 1, 0), ("a2", "policy", "P", "both", [], 2, 1), ("a3", "memory", "M", "both", [], 2, 2)], schema)
    b = spark.createDataFrame([("b1", "policy", "p", "both", [], 3, 0), ("b2", "world_model", "W", "both", [], 1, 1), ("b3", "memory", "M", "both", [], 2, 2)], schema)
    assert sorted((r["id"], r["status"]) for r in compare.diff(compare.fingerprints(b), compare.fingerprints(a)).collect()) == [("a1", "removed"), ("b1", "changed"), ("b2", "added"), ("b3", "same")]
    rows = [("p", f"c{i}", f"c{i}", "d" if i < 4 else f"d{i}", "D") for i in range(6)]
    got = {r["label"]: r["members"] for r in explore.collapse_repeats(spark.createDataFrame(rows, "parent string, child string, label string, definition_id string, definition_label string")).collect()}
    assert got == {"D ×4": 4, "c4": 1, "c5": 1}


# -- sources ----------------------------------------------------------------------------


@pytest.fixture
def code(tmp_path):
    files = {
        "pipeline.py": "def preprocess(raw):\n    cleaned = normalize(raw)\n    return cleaned\n\ndef normalize(x):\n    return x\n\ndef loss_fn(y):\n    return y\n",
        "train.py": "import argparse\nimport torch\nfrom pipeline import preprocess, loss_fn\n\ndef main(model, data):\n    p = argparse.ArgumentParser()\n    p.add_argument('--lr')\n    x = preprocess(data)\n    y = model(x)\n    loss_fn(y)\n    len(x)\n\nif __name__ == '__main__':\n    main(None, None)\n",
        "base.py": "class Base:\n    def move(self):\n        pass\n", "child.py": "from base import Base\n\nclass Child(Base):\n    def go(self):\n        self.move()\n        super().move()\n",
        "broken.py": "def (:\n", "vendor/skip.py": "def v():\n    pass\n", "nested/.git/HEAD": "x", "nested/n.py": "def n():\n    pass\n",
        "conf/a.toml": "[train]\nlr = 0.001\n", "conf/b.yaml": "model:\n  hidden: 128 # wide\n  name: 'x'\nflag: true\n", "conf/c.json": '{"a": {"b": [1, 2]}, "e": {}}',
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_repository(spark, code):
    files = repository.scan(spark, code)
    assert ids(files, "path") == ["base.py", "broken.py", "child.py", "pipeline.py", "train.py"]
    index = repository.index_repository(files)
    assert ids(index["error"], "file") == ["broken.py"]
    calls = flows.resolve_calls(index["call"], index["symbol"], index["import"], index["base"], index["method"])
    found = {(r["callee"], r["resolution"], r["target"]) for r in calls.where("path in ('train.py', 'child.py')").collect()}
    assert found >= {("preprocess", "local", "pipeline.preprocess"), ("model", "dynamic", None), ("len", "external", "builtins.len"), ("loss_fn", "local", "pipeline.loss_fn"), ("self.move", "local", "base.Base.move"), ("super.move", "local", "base.Base.move")}
    name = {r["id"]: r["callee"] for r in calls.collect()}
    links = {(name[r["producer"]], name[r["consumer"]], r["variable"]) for r in flows.def_use(index["call"]).collect()}
    assert links >= {("preprocess", "model", "x"), ("model", "loss_fn", "y"), ("preprocess", "len", "x")}
    arguments = {(name[r["producer"]], name[r["consumer"]], r["variable"]) for r in flows.argument_flow(calls, index["param"], index["binding"]).collect()}
    assert ("preprocess", "normalize", "data") in arguments
    returned = {(name[r["producer"]], name[r["consumer"]], r["variable"]) for r in flows.return_flow(calls, index["return"]).collect()}
    assert ("normalize", "preprocess", "cleaned") in returned
    best = metrics.entrypoint_scores(repository.entry_reasons(index)).first()
    assert (best["path"], best["score"]) == ("train.py", 4 + 6 + 1 + 1)


def test_static_graph(spark, code):
    files = repository.scan(spark, code)
    index = repository.index_repository(files)
    index = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in index.items()}
    entries = configs.config_entries(repository.scan(spark, code, "*.toml"))
    g = emit.static_graph(index, entries)
    validate.require_valid(g)
    kinds = {r["kind"]: r["n"] for r in metrics.histogram(g.edges, "kind").withColumnRenamed("value", "kind").collect()}
    assert kinds["calls"] >= 5 and kinds["data"] >= 4 and kinds["contains"] >= 10
    assert {r["confidence"] for r in g.evidence.collect()} == {0.7, 0.9, 1.0}
    state = {"view": "module", "selected_key": "module:a%3Ab", "run_id": "a b", "expanded_keys": ["x", "y"], "search": None}
    assert emit.encode_state(state) == "view=module&selected=module%3Aa%253Ab&run=a+b&expanded=x&expanded=y" and emit.decode_state("?" + emit.encode_state(state)) == state
    assert emit.decode_state("view=none&q=z") == {"view": "paper", "selected_key": None, "run_id": None, "expanded_keys": [], "search": "z"}
    moved = emit.remap_sources(spark.createDataFrame([("/opt/lib/m.py",), ("/opt/lib/pkg/a.py",), ("b.py",)], "path string"), {"/opt/lib": "src", "/opt/lib/pkg": "own"})
    assert ids(moved, "path") == ["b.py", "own/a.py", "src/m.py"]
    captured = spark.createDataFrame([("c1", "enc.block", "x"), ("c2", "z.head", "Head"), ("c3", "q.tail", "y"), ("c4", "none", "w")], "id string, target string, label string")
    definitions = spark.createDataFrame([("d1", "Enc", ["enc.block"], 0), ("d2", "Head", [], 1), ("d3", "tail", [], 2)], "id string, label string, aliases array<string>, ordinal int")
    assert {r["id"]: r["definition_id"] for r in emit.match_structured(captured, definitions).collect()} == {"c1": "d1", "c2": "d2", "c3": "d3", "c4": None}


def test_configs(spark, code):
    entries = configs.config_entries(repository.scan(spark, code, "*"))
    got = {(r["path"], r["key"]): json.loads(r["value_json"]) for r in entries.collect()}
    assert got == {("conf/a.toml", "train.lr"): 0.001, ("conf/b.yaml", "model.hidden"): 128, ("conf/b.yaml", "model.name"): "x", ("conf/b.yaml", "flag"): True, ("conf/c.json", "a.b"): [1, 2]}
    refs = spark.createDataFrame([("r1", "load", "./conf/b", None, False), ("r2", "load", "none.json", None, False), ("r3", "load", None, None, True), ("r4", "hydra", "conf", None, False)], "id string, kind string, path string, name string, dynamic boolean")
    from pyspark.sql import functions as F

    out = {r["id"]: (r["status"], r["entry_ids"]) for r in flows.resolve_configs(refs, entries.select(F.col("key").alias("entry_id"), "path")).collect()}
    assert out == {"r1": ("resolved", ["flag", "model.hidden", "model.name"]), "r2": ("unresolved", []), "r3": ("dynamic", []), "r4": ("dynamic", [])}
    flat = configs.flatten_json(spark.createDataFrame([(1, '{"a":{"b":{"c":1}},"d":[1]}'), (2, "7"), (3, "{}")], "i int, json string"), "i")
    assert sorted((r["i"], r["key"], r["value"]) for r in flat.collect()) == [(1, "a.b.c", "1"), (1, "d", "[1]"), (2, "root", "7")]


def test_documents(spark, tmp_path):
    old = {"project": {"name": "p"}, "nodes": [{"id": "a", "level": "module", "kind": "module", "label": "A", "attributes": {"x": [1]}, "tensor": {"shape": [1, "B", None]}}, {"id": "b", "level": "source", "kind": "other", "label": "B"}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    g = documents.read_document(spark, str(tmp_path / "old.json"))
    rows = {r["id"]: r for r in g.nodes.collect()}
    assert rows["a"]["identity_kind"] == "definition" and rows["b"]["identity_kind"] == "source"
    assert json.loads(rows["a"]["attributes_json"]) == {"x": [1]} and [tuple(d) for d in rows["a"]["tensor"]["shape"]] == [(1, None), (None, "B"), (None, None)]
    assert "schema_migrations" in g.projects.first()["metadata_json"]
    documents.write_tables(g, str(tmp_path / "t"))
    assert ids(documents.read_tables(spark, str(tmp_path / "t")).nodes) == ["a", "b"]
    (tmp_path / "new.json").write_text(json.dumps(old | {"schema_version": "9"}))
    with pytest.raises(ValueError):
        documents.read_document(spark, str(tmp_path / "new.json"))


def test_traces(spark, tmp_path):
    raw = {
        "run": {"id": "run.0", "framework": "x"}, "definitions": [{"id": "d", "label": "D"}], "values": [{"id": "v", "label": "V", "run_id": "run.0"}],
        "occurrences": [{"id": f"o{i}", "definition_id": "d", "label": "D", "run_id": "run.0", "occurrence_index": i} for i in range(3)],
        "edges": [{"id": "e1", "source": "o0", "target": "v", "kind": "produces"}, {"id": "e2", "source": "v", "target": "o1", "kind": "consumes"}], "evidence": [],
    }
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    g = traces.read_trace(spark, str(tmp_path / "raw.json"))
    validate.require_valid(g)
    assert g.nodes.where("identity_kind = 'occurrence'").count() == 3
    events = spark.createDataFrame([("r", "d", "a", 1), ("r", "e", "b", 2), ("r", "d", "c", 3)], "run_id string, definition_id string, id string, seq long")
    assert [(r["id"], r["occurrence_index"], r["previous"]) for r in traces.number_occurrences(events).orderBy("seq").collect()] == [("a", 0, None), ("b", 0, "a"), ("c", 1, "b")]


def test_streaming(spark, tmp_path):
    import os

    from factloom.streaming import events

    (tmp_path / "in").mkdir()
    row = lambda i, t: {"run_id": "r", "definition_id": "d" if i % 2 else "e", "id": f"e{i}", "seq": i, "ts": t}
    # the later half arrives first; a last event, two days on, moves the watermark past all others
    batches = [[row(i, f"2024-01-01T00:0{i}:00Z") for i in (2, 3)], [row(i, f"2024-01-01T00:0{i}:00Z") for i in (1, 0)], [row(9, "2024-01-03T00:00:00Z")], [row(8, "2024-01-01T00:00:30Z"), {**row(10, "2024-01-03T00:00:01Z"), "run_id": "s"}]]
    for i, rows in enumerate(batches):
        f = tmp_path / "in" / f"{i}.json"
        f.write_text("\n".join(map(json.dumps, rows)))
        os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    read = lambda: spark.readStream.schema(events.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = events.numbered(read()).writeStream.format("memory").queryName("numbered").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["seq"], r["occurrence_index"], r["previous"]) for r in spark.sql("select * from numbered").collect())
    assert got == [(0, 0, None), (1, 0, "e0"), (2, 1, "e1"), (3, 1, "e2")]
    q = events.windowed_counts(read().where("id <> 'e8'")).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["definition_id"], r["n"]) for r in spark.sql("select * from windows").collect()) == [("d", 2), ("e", 2)]


def test_label_chain(spark):
    """A chain of 4,000 nodes, a cycle without entry, a diamond and a cycle with entry."""
    import time

    from factloom.operators import traverse

    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(3999)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "out")] + [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "b")]
    seeds = [("n0000", "vision"), ("n2000", "action"), ("y", "state"), ("c", "audio"), ("e", "text"), ("lonely", "depth")]
    down = {}
    for s, t in edges:
        down.setdefault(s, []).append(t)
    want = set()
    for node, label in seeds:
        todo = [node]
        while todo:
            at = todo.pop()
            if (at, label) not in want:
                want.add((at, label))
                todo += down.get(at, [])
    began = time.time()
    found = traverse.label_fixpoint(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "id string, label string"))
    got = [tuple(r) for r in found.select("id", "label").collect()]
    print("4,000-node chain:", round(time.time() - began, 1), "s")
    assert len(got) == len(want) and set(got) == want


def test_yaml_values():
    from factloom.sources.configs import yaml_leaves

    text = 'a:\n  color: "#fff"\n  url: http://x/a#frag\n\tdeep: 1 # one\n  b:\n      c: [1, 2]\n    d: none\n- e: f\n# g: h\ntop: TRUE\n  under: x'
    assert list(yaml_leaves(text)) == [("a.color", "#fff"), ("a.url", "http://x/a#frag"), ("a.deep", 1), ("a.b.c", [1, 2]), ("a.b.d", None), ("top", True), ("under", "x")]


def test_small_metrics(spark):
    paths = spark.createDataFrame([(p,) for p in ["b", "a", "c", "d", "/x", "u/../../y", "big", "bin"]], "path string")
    files = spark.createDataFrame([("a", 6, True), ("b", 5, True), ("c", 3, True), ("big", 99, True), ("bin", 1, False)], "path string, size long, utf8 boolean")
    got = {r["path"]: r["outcome"] for r in repository.bundle(paths, files, max_file=10, max_total=10).collect()}
    assert got == {"a": "embedded", "b": "total_limit", "c": "embedded", "d": "missing", "/x": "outside_source_root", "u/../../y": "outside_source_root", "big": "file_too_large", "bin": "not_utf8_text"}
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "name string, at int")
    assert [r["label"] for r in metrics.top_values(rows, "name", "at").collect()] == ["x ×2", "y ×1"]
    cover = EvidenceGraph.of(spark, coverage=[{"id": "v", "status": "always_observed"}]).coverage
    assert sorted(r["n"] for r in metrics.coverage_counts(cover).collect()) == [0, 0, 0, 0, 1]
    assert metrics.markdown(rows, "T", ["name"]).startswith("## T")
