"""Catalogue queries over every row of small fixtures (expected rows come from Python, not from the registered SQL)."""

from factloom.plans import catalog, catalog_more  # noqa: F401 - registers its queries


def tables(spark, folder, **given):
    """Parquet tables (rows, schema) in ``folder``."""
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_source_excerpt(spark, tmp_path):
    texts = {i: "\n".join(f"{i}.{k}" for k in range(1, i)) for i in range(1, 13)}
    sf = tables(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))
    want = [(f"doc:{i}", 0, k, line) for i, t in texts.items() for k, line in enumerate(t.split("\n"), 1) if 2 <= k <= 4]
    assert rows(catalog.QUERIES["source_excerpt"](spark, sf), "id", "n", "line", "text") == sorted(want)


def test_argument_flow(spark, tmp_path):
    types = ("click", "error", "purchase", "signup", "view")
    orders = [(k, k % 3 + 1, f"p{k}") for k in range(1, 25)]
    events = [(k, k % 4 + 1, types[k % 5]) for k in range(1, 25)]
    sf = tables(
        spark, tmp_path, customer=([(k,) for k in range(1, 5)], "c_custkey long"),
        orders=(orders, "o_orderkey long, o_custkey long, o_orderpriority string"), events=(events, "event_id long, user_id long, event_type string"),
    )
    want = [(f"order:{o}", f"event:{e}", p) for o, c, p in orders for e, user, kind in events if user == c and kind == types[c % 5]]
    assert len(want) > 20 and rows(catalog.QUERIES["argument_flow"](spark, sf), "producer", "consumer", "variable") == sorted(want)


def test_breadcrumbs(spark, tmp_path):
    none = {
        "supplier": "s_suppkey long, s_name string, s_nationkey long", "part": "p_partkey long, p_name string, p_type string, p_brand string",
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date",
        "lineitem": "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_shipdate date",
    }
    sf = tables(
        spark, tmp_path, region=([(0, "R0"), (1, "R1")], "r_regionkey long, r_name string"), nation=([(k, f"N{k}", k % 2) for k in range(3)], "n_nationkey long, n_name string, n_regionkey long"),
        customer=([(k, f"C{k}", k % 3, "M") for k in range(1, 12)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"), **{t: ([], s) for t, s in none.items()},
    )
    want = [(f"customer:{k}", i, c) for k in range(1, 12) for i, c in enumerate((f"region:{k % 3 % 2}", f"nation:{k % 3}", f"customer:{k}"), 1)]
    assert rows(catalog.QUERIES["breadcrumbs"](spark, sf), "id", "position", "crumb") == sorted(want)


def test_claim_check(spark, tmp_path):
    documents = [(k, 100 * k) for k in range(1, 17)]
    labels = [(k, k % 2) for k in range(1, 19)]  # 17 and 18 have no document
    sf = tables(spark, tmp_path, documents=(documents, "doc_id long, n_chars long"), labels=(labels, "doc_id long, quality int"))
    long = {k: n > 800 for k, n in documents}
    status = {k: "unresolved" if k not in long else "supported" if long[k] == (q == 1) else "contradicted" for k, q in labels}
    assert rows(catalog.QUERIES["claim_check"](spark, sf), "claim_id", "status") == sorted((f"claim:{k}", s) for k, s in status.items())
    want = sorted((f"claim:{k}", f"impl:{k}") for k, s in status.items() if s == "contradicted")
    assert len(want) == 8 and rows(catalog.QUERIES["conflicts"](spark, sf), "author_claim", "implementation_claim") == want
