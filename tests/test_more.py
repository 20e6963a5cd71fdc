"""Documents, manifests, browser forms and reports on small fixtures."""

import hashlib
import json
import random

import pytest

from factloom.operators import benchmark, browser
from factloom.schema import EvidenceGraph
from factloom.sources import documents, manifests


def small(spark):
    tensor = {"shape": [(2, None), (None, 'b"x'), (None, None)], "dtype": "f4", "device": None, "layout": None, "requires_grad": True, "semantics": ["image"]}
    nodes = [
        {"id": "g", "level": "semantic", "kind": "semantic_component", "identity_kind": "group", "label": "G", "role": "policy", "attributes_json": '{"member_ids":["a"],"confidence":0.9,"phase":"both","modalities":["vision"]}'},
        {"id": "a", "level": "module", "kind": "module", "identity_kind": "definition", "label": "A", "source": [("m/a.py", 3, None, None, None, "A.run")], "evidence_ids": ["e"], "attributes_json": '{"n":1,"l":["x",{"y":2}],"t":"[1"}'},
        {"id": "b", "level": "operation", "kind": "tensor", "identity_kind": "value", "label": "B", "parent_ids": ["a"], "tensor": tensor},
    ]
    edges = [{"id": "e1", "source": "a", "target": "b", "kind": "produces"}, {"id": "e2", "source": "g", "target": "a", "kind": "contains"}]
    evidence = [{"id": "e", "kind": "static", "status": "observed", "confidence": 1.0, "metadata_json": '{"k":[1,2]}'}]
    claims = [{"id": "claim.author.1", "subject_id": "g", "predicate": "frozen", "value_json": "true", "status": "declared", "confidence": 0.5, "scope": (["r"], '{"c":1}', ["t"])}]
    g = EvidenceGraph.of(spark, nodes=nodes, edges=edges, evidence=evidence, claims=claims, runs=[{"id": "r"}])
    return g.with_tables(projects=spark.createDataFrame([("p", "/r", None, "abc", '{"x":{"y":1}}')], g.projects.schema))


def rows(df, order="id"):
    out = []
    for r in df.orderBy(order).collect():
        d = r.asDict(recursive=True)
        out.append({k: json.loads(v) if k.endswith("_json") and v else v for k, v in d.items()})
    return out


def test_document_round_trip(spark, tmp_path):
    g = small(spark)
    documents.write_document(g, f"{tmp_path}/doc")
    back = documents.read_document(spark, f"{tmp_path}/doc", check=True)
    for name in ("nodes", "edges", "evidence", "runs", "coverage"):
        assert rows(getattr(back, name)) == rows(getattr(g, name)), name
    (claim,), (same,) = rows(back.claims), rows(g.claims)
    claim["scope"]["conditions_json"], same["scope"]["conditions_json"] = (json.loads(x["scope"]["conditions_json"]) for x in (claim, same))
    assert claim == same
    assert rows(back.projects, "name") == rows(g.projects, "name")
    text = "".join(r["value"] for r in spark.read.text(f"{tmp_path}/doc").collect())
    doc = json.loads(text)
    assert doc["schema_version"] == "0.2" and [n["id"] for n in doc["nodes"]] == ["a", "b", "g"] and doc["nodes"][1]["tensor"]["shape"] == [2, 'b"x', None]
    broken = g.with_tables(edges=g.edges.limit(0).unionByName(EvidenceGraph.of(spark, edges=[{"id": "e9", "source": "a", "target": "gone", "kind": "data"}]).edges))
    documents.write_document(broken, f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="edge_target"):
        documents.read_document(spark, f"{tmp_path}/bad", check=True)
    documents.write_document(EvidenceGraph.of(spark), f"{tmp_path}/none")
    assert documents.read_document(spark, f"{tmp_path}/none").nodes.count() == 0


def test_explorer_rows(spark):
    g = small(spark)
    (row,) = browser.node(g, "module:a").collect()
    assert (row["entity_id"], row["child_count"], json.loads(row["metadata_json"])["attributes"]) == ("a", 1, {"n": 1, "l": ["x", {"y": 2}], "t": "[1"})
    assert browser.node(g, "module:zz").count() == 0
    chosen, edges, n = browser.paper_slice(g)
    assert n == 1 and edges.count() == 0 and json.loads(chosen.first()["metadata_json"]) == {"member_ids": ["a"], "modalities": ["vision"], "confidence": 0.9}
    assert [(r["subject_id"], r["id"]) for r in browser.related(g, g.nodes.select("id")).orderBy("id").collect()] == [("g", "a"), ("g", "b")]
    assert tuple(browser.claim_counts(g).first()) == (1, 0)
    (export,) = browser.overlay_export(spark.createDataFrame([("a", "x", None), ("b", None, "n")], "id string, alias string, note string"), "My Project!").collect()
    assert export["name"] == "my-project--overlays.json" and json.loads(export["json"]) == {"project": "My Project!", "overlays": {"a": {"alias": "x"}, "b": {"note": "n"}}}
    clicks = spark.createDataFrame([(i, f"n{i // 2}") for i in range(200)], "seq long, id string")
    assert [r["id"] for r in browser.selection_history(clicks).collect()] == [f"n{i}" for i in range(20, 100)]


@pytest.mark.parametrize("seed", range(3))
def test_soft_lineage(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    links = [(f"e{k:03d}", r.choice(names), r.choice(names)) for k in range(70)]
    limit = [5, 12, 100][seed]
    g = EvidenceGraph.of(spark, nodes=[{"id": n, "level": "operation", "kind": "operation", "identity_kind": "value", "label": n} for n in names], edges=[{"id": e, "source": a, "target": b, "kind": "data"} for e, a, b in links])
    met, queue, edges = {"n00"}, ["n00"], set()
    while queue and len(met) < limit:
        now = queue.pop(0)
        for e, a, b in links:
            if a == now:
                edges.add(e)
                if b not in met:
                    met.add(b)
                    queue.append(b)
    nodes, found = browser.soft_lineage(g, "n00", max_nodes=limit)
    assert {x["id"] for x in nodes.collect()} == met and {x["edge_id"] for x in found.collect()} == edges


def test_manifest_and_specs(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[[case]]\nid = "x"\nrepository = "r"\nrevision = "1234567"\n[[case]]\nid = "y"\nrepository = "s"\nrevision = "12345678"\nmodes = ["static", "hybrid"]\n[[case]]\nid = "y"\nrepository = "t"\nrevision = "12345678"\n')
    cases = manifests.read_manifest(spark, f"{tmp_path}/m.toml")
    assert manifests.case(cases, "x").first()["modes"] == ["static"]
    for name in ("y", "none"):
        with pytest.raises(KeyError):
            manifests.case(cases, name)
    (tmp_path / "s.json").write_text(json.dumps({"module": "m", "symbol": "S", "args": [{"kind": "tensor", "shape": [1, 2]}], "seed": 3}))
    spec = manifests.read_spec(spark, f"{tmp_path}/s.json", "runtime").first()
    assert (spec["framework"], spec["seed"], spec["args"][0]["shape"], spec["no_grad"]) == ("pytorch", 3, [1, 2], True)
    (tmp_path / "res" / "sub").mkdir(parents=True)
    (tmp_path / "res" / "sub" / "f.bin").write_bytes(b"abc")
    files = manifests.fingerprints(spark, f"{tmp_path}/res")
    digest = hashlib.sha256(b"abc").hexdigest()
    assert [tuple(x) for x in files.collect()] == [("sub/f.bin", digest, 3)]
    wanted = spark.createDataFrame([("sub/f.bin", digest), ("sub/f.bin", "0"), ("no", None), ("../up", None)], "path string, sha256 string")
    assert sorted((x["path"], x["status"]) for x in manifests.verified(wanted, files).collect()) == [("../up", "escapes"), ("no", "missing"), ("sub/f.bin", "mismatch"), ("sub/f.bin", "ok")]
    assert manifests.git_facts(spark, str(tmp_path)).first()["revision"] is None
    assert manifests.tensor_shapes({"b": [{"shape": [1, 2]}, 5], "a": {"shape": []}}) == [[], [1, 2]]
    assert manifests.summary({"a": ["x" * 200, {"b": {"c": 1}}]})["items"]["a"]["items"] == [{"type": "str", "value": "x" * 128, "length": 200}, {"type": "dict"}][:2]


def test_report(spark, tmp_path):
    g = small(spark)
    results = benchmark.result(benchmark.runtime_metrics(g, "/r", 1.25, 10, 1), "case", "runtime", "runtime").unionByName(benchmark.result(benchmark.hybrid_metrics(g, g, g, "/r"), "case", "hybrid", "hybrid"))
    failures = spark.createDataFrame([("case", "hybrid", "hybrid_alignment_gap", "warning", "not aligned", 2)], "case_id string, mode string, category string, severity string, message string, n int")
    text = benchmark.markdown_report(results, failures)
    assert text.splitlines()[:7] == ["# Benchmark Report", "", "## Runtime", "", "| Case | Status | Trace | Target module defs | Nodes | Op defs | Tensor spec |", "| --- | --- | ---: | ---: | ---: | ---: | ---: |", "| case | completed | 1.25s | 0 | 3 | 0 | 100.0% |"]
    assert text.endswith("## Failure taxonomy\n\n- **case (hybrid)**\n  - `hybrid_alignment_gap` (warning, n=2): not aligned\n- **case (runtime)**: no recorded warnings/errors.\n")
    benchmark.write_results(results, failures, f"{tmp_path}/out")
    found = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert {x["mode"]: len(x.get("failures", [])) for x in found} == {"runtime": 0, "hybrid": 1} and all(x["metrics"]["runtime_nodes"] == 3 for x in found)
