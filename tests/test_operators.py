"""Operators on small hand-made data: boundaries, ties, nulls, and a queue-based search to compare propagation with."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tremorlake.functions import dims, text as X
from tremorlake.operators import audit, evaluation as E, extraction as T, graph as G, incremental as I, lexical, reports as P, rescoring as R, vectors as V, verdicts

EDGE = {name: (way, depth) for name, _, way, depth, _, _ in dims.edge_rows()}
SEV = {name: dims.RANK[s] for name, _, _, _, s, _ in dims.edge_rows()}


def one(spark, col, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return d.select(col.alias("x")).first()[0]


def test_tokens_keep_short_identifiers_and_drop_function_words(spark):
    got = one(spark, X.tokenise(F.col("t")), t="userId dbConnection tsConfig HTTPServer the dan 42 a x1 yang")
    assert got == ["user", "id", "db", "connection", "ts", "config", "http", "server", "x1"]


@pytest.mark.parametrize("path,kind,route", [("src/app/api/a/[id]/route.ts", "API_ROUTE", "/api/a/{id}"), ("src/app/page.tsx", "PAGE_COMPONENT", "/"), ("src/app/x.css", None, "/"), ("src/hooks/a.ts", "UI_COMPONENT", None), ("src/lib/db/models/__mocks__/a.ts", None, None), ("src/lib/db/models/a.ts", "TYPE_DEFINITION", None), ("src/lib/a.ts", "UTILITY", None), ("src/config.ts", None, None)])
def test_file_class_and_route(spark, path, kind, route):
    assert one(spark, X.file_class(F.col("p")), p=path) == kind and one(spark, X.route_path(F.col("p")), p=path) == route


def test_scalars(spark):
    assert one(spark, X.source_path(F.col("p")), p="/x/src/y/src/a.ts") == "src/a.ts" and one(spark, X.source_path(F.col("p")), p="/x/a.ts") == "a.ts"
    assert one(spark, X.slugify(F.col("t")), t=" 1. Use Case: Log-in! ") == "1_use_case_log_in"
    assert one(spark, X.severity(F.col("c")), c=["CALLS", "TYPED_BY"]) == "Tinggi" and one(spark, X.severity(F.col("c")), c=["x"]) == "Rendah"
    assert one(spark, X.strip_delimiters(F.col("t")), t=" <src/a.ts::f> ") == "src/a.ts::f"
    assert [one(spark, X.scope(F.col("n")), n=n) for n in (10, 11, 30, 31)] == ["terlokalisasi", "menengah", "menengah", "ekstensif"]
    assert [one(spark, X.chunk_type(F.col("t")), t=t) for t in ("Non-Functional Requirement", "Use Case 1", "Arsitektur", "Intro")] == ["NFR", "FR", "Design", "General"]
    assert one(spark, X.layers_to_chunk_types(F.col("l")), l=["design", "requirement", "design"]) == ["Design", "FR", "NFR"]


def test_rrf_closed_form(spark):
    lists = [("dense_doc", "ABC"), ("bm25_doc", "BAD"), ("dense_code", "CA")]
    d = spark.createDataFrame([(1, "ADDITION", p, i, r + 1) for p, ids in lists for r, i in enumerate(ids)], "cr int, change_type string, path string, id string, rank int")
    got = {r.id: r.rrf for r in R.fuse(d, dims.rrf_weights(spark)).collect()}
    assert abs(got["A"] - (1.2 / 61 + 1 / 62 + 1 / 62)) < 1e-12


def test_similarity_keeps_the_best_of_either_side(spark):
    m = spark.createDataFrame([("c1", "d1", 0.9), ("c1", "d2", 0.5), ("c2", "d2", 0.45), ("c2", "d1", 0.39)], "code_id string, doc_id string, score double")
    assert {(r.code_id, r.doc_id) for r in V.dual_top_k(m, 1, 0.4).collect()} == {("c1", "d1"), ("c1", "d2"), ("c2", "d2")}


def queue(nodes, edges, seeds, hub):
    """Propagation as a first-in-first-out search."""
    deg, ind = {}, {}
    for s, t, _ in edges:
        deg[s] = deg.get(s, 0) + 1
        deg[t] = deg.get(t, 0) + 1
        ind[t] = ind.get(t, 0) + 1
    trace = {s: (0, [], [s], s) for s, _ in seeds}
    low = dict(seeds)
    todo = deque((s, *trace[s]) for s, _ in seeds)
    while todo:
        u, d, chain, path, seed = todo.popleft()
        for kind, (way, depth) in EDGE.items():
            cap = 1 if deg.get(u, 0) > hub or kind == "CALLS" and (low[seed] or nodes[seed][1] == "UTILITY") else depth
            if d >= cap:
                continue
            near = {t for s, t, k in edges if s == u and k == kind} if way == "forward" else {s for s, t, k in edges if t == u and k == kind}
            for v in sorted(near):
                limit = dims.FAN_IN[nodes[v][0]]
                if nodes[v][0] == "ExternalPackage" or v in low or v not in trace and limit and ind.get(v, 0) > limit:
                    continue
                if v not in trace or SEV[kind] < SEV[trace[v][1][-1]]:
                    trace[v] = (d + 1, chain + [kind], path + [v], seed)
                    todo.append((v, *trace[v]))
    return trace


@pytest.mark.parametrize("seed", range(6))
def test_propagation_equals_queue(spark, seed):
    r = random.Random(seed)
    kinds = ["Function", "Class", "Interface", "File", "ExternalPackage", "Variable"]
    nodes = {f"n{i:02}": (r.choice(kinds), r.choice(["UTILITY", "API_ROUTE", None])) for i in range(30)}
    edges = sorted({(*r.sample(sorted(nodes), 2), r.choice(list(EDGE))) for _ in range(90)})
    seeds = [(n, r.random() < 0.5) for n in r.sample(sorted(nodes), 4)]
    n = spark.createDataFrame([(k, a, k, b) for k, (a, b) in nodes.items()], "node_id string, node_type string, file_path string, file_class string")
    e = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string")
    s = spark.createDataFrame([(k, i, low) for i, (k, low) in enumerate(seeds)], "node_id string, ord long, low boolean")
    got = {x.node_id: (x.depth, list(x.chain), list(x.path), x.seed) for x in G.propagate(n, e, s, dims.edge_config(spark), 9).collect()}
    assert got == queue(nodes, edges, seeds, 9)


def test_two_requests_are_followed_apart(spark):
    n = spark.createDataFrame([(k, "Function", k, None) for k in "abc"], "node_id string, node_type string, file_path string, file_class string")
    e = spark.createDataFrame([("b", "a", "CALLS"), ("c", "b", "CALLS")], "source_id string, target_id string, edge_type string")
    s = spark.createDataFrame([(1, "a", 0, False), (2, "a", 0, True), (2, "c", 1, False)], "cr int, node_id string, ord long, low boolean")
    got = {(x.cr, x.node_id): x.depth for x in G.propagate(n, e, s, dims.edge_config(spark)).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "a"): 0, (2, "b"): 1, (2, "c"): 0}


def test_gates(spark):
    pool = spark.createDataFrame([(1, "d1", "doc", "t", "f", None, "FR", "FR", 0.1, 0.5, 0.5), (1, "c1", "code", "loginForm", "a.ts", "UTILITY", None, "FR", 0.1, 0.4, 0.4), (1, "c2", "code", "x", "a.ts", "UTILITY", None, "FR", 0.1, -2.0, 0.3), (1, "c3", "code", "y", "b.ts", None, None, "FR", 0.2, 0.0, 0.2)], "cr int, node_id string, collection string, name string, file_path string, file_class string, chunk_type string, primary string, rrf double, raw double, score double")
    m = spark.createDataFrame([("c1", "d1", 0.8), ("c3", "d1", 0.7)], "code_id string, doc_id string, score double")
    ids = lambda df: sorted(r.node_id for r in df.collect())
    assert ids(R.score_floor(pool)) == ["c1", "c2", "c3", "d1"]
    d = R.semantic_dedup(pool, m)
    assert ids(d) == ["c1", "c2", "c3"] and d.where("node_id = 'c1'").first().merged_docs == ["d1"]
    assert ids(R.density_gate(pool)) == ["c3", "d1"] and ids(R.density_gate(pool, F.array(F.lit("login")))) == ["c1", "c3", "d1"]
    assert ids(R.density_gate(pool, None, 2 / 3)) == ["c1", "c2", "c3", "d1"]
    x = {r.node_id: r.score for r in R.negative_filter(pool, F.array(F.lit("loginform"), F.lit("x"))).collect()}
    assert x["c1"] == pytest.approx(-0.6) and x["c2"] == 0.3
    assert [r.node_id for r in R.admitted(pool).orderBy("rank").collect()] == ["d1", "c1", "c3", "c2"]
    assert {r.score for r in R.scale(pool.where("node_id = 'd1'")).collect()} == {0.5}


def test_fail_closed(spark):
    c = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c")], "cr int, batch long, node_id string")
    v = spark.createDataFrame([(1, 0, "<a>", True, "x"), (1, 0, "b", False, "x"), (1, 0, "c", True, "x"), (1, 0, "zz", True, "x")], "cr int, batch long, node_id string, confirmed boolean, justification string")
    assert [r.node_id for r in verdicts.confirmed(c, v).collect()] == ["a"]


def test_reports(spark):
    b = spark.createDataFrame([(1, 0, 50), (1, 1, 60), (1, 2, 30), (1, 3, 20)], "k int, o long, c long")
    assert tuple(P.pack_blocks(b, "k", "o", "c", 100).first()) == (1, 100, [0, 2, 3])
    cis = spark.createDataFrame([(1, f"n{i}", i < 2, "Rendah", i) for i in range(10)], "cr int, node_id string, is_seed boolean, severity string, depth int")
    assert sorted(r.node_id for r in P.hard_limit(cis, 10, 40).collect()) == ["n0", "n1", "n2", "n3"]


def test_metrics(spark):
    gt = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "cr int, item string")
    pred = spark.createDataFrame([(1, "a"), (1, "x"), (2, "y")], "cr int, item string")
    got = {r.cr: r for r in E.prf(gt, pred, ["cr"], "item").collect()}
    assert (got[1].precision, got[1].recall) == (0.5, pytest.approx(1 / 3)) and got[2].recall is None and got[2].f1 is None and got[2].precision == 0.0
    ranked = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("xaybzc")], "cr int, item string, rank int")
    assert E.r_precision(gt, ranked, ["cr"], "item", "rank").first().r_precision == pytest.approx(1 / 3)
    a, b = [(1, float(v)) for v in (1, 2, 2, 5)], [(1, float(v)) for v in (2, 3)]
    f = lambda x: spark.createDataFrame(x, "k int, v double")
    want = sum((x > y) - (x < y) for _, x in a for _, y in b) / 8
    assert E.cliffs_delta(f(a), f(b), ["k"], "v").first().delta == pytest.approx(want)


def test_wilcoxon_p_is_exact_for_few_pairs():
    assert E.wilcoxon_p(3, 6, 0) == 1 / 8 and E.wilcoxon_p(0, 0, 0) == 1.0
    assert abs(E.wilcoxon_p(20, 150, 0) - E.wilcoxon_p(20, 150, 0, exact=0)) < 0.01


def test_maintenance(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file_path string, content_hash string")
    assert {r.file_path: r.status for r in I.hash_diff(old, new).collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}
    t = spark.createDataFrame([("k", 1, "x")], "id string, v int, s string")
    assert [r.s for r in I.upsert(t, spark.createDataFrame([("k", 1, "y")], t.schema), ["id"], "v").collect()] == ["y"]
    n = spark.createDataFrame([("a::f", "Function", "a"), ("ext::p", "ExternalPackage", "a"), ("b::g", "Function", "b")], "node_id string, node_type string, file_path string")
    e = spark.createDataFrame([("a::f", "ext::p", "D"), ("b::g", "ext::p", "D"), ("b::g", "a::f", "CALLS")], "source_id string, target_id string, edge_type string")
    left = I.purge_files(n, e, spark.createDataFrame([("a::f", "d")], "code_id string, doc_id string"), spark.createDataFrame([("b", "a")], "dependent_file string, target_file string"), spark.createDataFrame([("a",)], "file_path string"))
    assert sorted(r.node_id for r in left["nodes"].collect()) == ["b::g", "ext::p"] and left["edges"].count() == 1 and left["pairs"].count() == 0


SRC = {
    "src/lib/item.service.ts": "import { Item } from './types'\nimport axios from 'axios'\n\n/** Finds items. */\nexport async function findItems(q: string): Promise<Item[]> {\n  const r = await helper(q) // helper2()\n  return r\n}\nconst helper = (q: string) => axios.get(q)\nexport class Store extends Base implements Repo {\n  private x = 1\n  save(i: Item): void {\n    findItems('a')\n  }\n  get size(): number { return 1 }\n}\nclass Base {}\ninterface Repo { save(i: Item): void }\n",
    "src/lib/types.ts": "export interface Item {\n  id: string\n  owner?: Owner;\n}\nexport type Owner = { name: string }\nexport enum Kind { A, B }\nexport const CONFIG = { limit: 10, name: 'x' }\n",
    "src/app/api/items/[id]/route.ts": "import { findItems } from '@/lib/item.service'\nexport async function GET(req: Request) {\n  return findItems('x')\n}\n",
    "src/components/List.tsx": "'use client'\nimport React, { useEffect } from 'react'\nimport * as svc from '../lib/item.service'\nimport { CONFIG } from '../lib/types'\nimport Card from './Card'\nexport default function List({ id }: Props) {\n  const load = () => fetch(`/api/items/${id}`)\n  useEffect(() => { svc.findItems(id) }, [id, CONFIG.limit])\n  return <Card onClick={load} n={CONFIG.limit} />\n}\n",
    "src/components/Card.tsx": "export default function Card(p) {\n  return <div/>\n}\n",
}


@pytest.fixture(scope="module")
def repo(spark):
    return spark.createDataFrame([(f"/r/{p}", s) for p, s in SRC.items()], "path string, content string").cache()


def test_nodes_of_typescript(repo):
    got = {r.node_id: r for r in T.nodes(repo).collect()}
    kinds = {k: v.node_type for k, v in got.items()}
    f = "src/lib/item.service.ts"
    assert kinds[f] == "File" and kinds[f"{f}::findItems"] == "Function" and kinds[f"{f}::helper"] == "Function" and kinds[f"{f}::Store"] == "Class" and kinds[f"{f}::Store.save"] == "Method" and kinds["ext::axios"] == "ExternalPackage"
    t = "src/lib/types.ts"
    assert [kinds[f"{t}::{x}"] for x in ("Item", "Item.id", "Item.owner", "Owner", "Kind", "CONFIG")] == ["Interface", "InterfaceField", "InterfaceField", "TypeAlias", "Enum", "Variable"]
    assert got[f"{f}::findItems"].docstring == "Finds items." and got[f"{f}::findItems"].exported and not got[f"{f}::helper"].exported
    assert got["src/components/List.tsx"].client_directive == "client" and got["src/app/api/items/[id]/route.ts"].route_path == "/api/items/{id}"


def test_edges_of_typescript(repo):
    got = {tuple(r) for r in T.edges(repo).collect()}
    f, t, l = "src/lib/item.service.ts", "src/lib/types.ts", "src/components/List.tsx"
    for e in [
        (f, t, "IMPORTS"), (f, "ext::axios", "DEPENDS_ON_EXTERNAL"), (f, f"{f}::Store", "CONTAINS"), (f"{t}::Item", f"{t}::Item.id", "CONTAINS"), (f"{f}::findItems", f"{f}::helper", "CALLS"), (f"{f}::Store.save", f"{f}::findItems", "CALLS"), (f"{f}::Store", f"{f}::Base", "INHERITS"),
        (f"{f}::Store", f"{f}::Repo", "IMPLEMENTS"), (f"{f}::Store", f"{f}::Store.save", "DEFINES_METHOD"), (f"{f}::Store.save", f"{t}::Item", "TYPED_BY"), (f"{f}::findItems", f"{t}::Item", "TYPED_BY"), ("src/app/api/items/[id]/route.ts::GET", f"{f}::findItems", "CALLS"), (f"{l}::List", f"{f}::findItems", "CALLS"),
        (f"{l}::List", "src/components/Card.tsx::Card", "RENDERS"), (f"{l}::List", "src/app/api/items/[id]/route.ts::GET", "CLIENT_API_CALLS"), (f"{l}::List", f"{t}::CONFIG", "HOOK_DEPENDS_ON"),
    ]:
        assert e in got, e
    assert not any(k == "CALLS" and b.endswith("helper2") for _, b, k in got)


def test_chunks(spark):
    md = "# T\nintro\n## Use Case `A`\nbody\n#### deep\nmore\n### Design\nx\n```\n## not\n```\n## Design\ny"
    d = spark.createDataFrame([("docs/srs.md", md), ("docs/n.md", "plain"), ("docs/z.md", None)], "path string, text string")
    got = {r.chunk_id: (r.chunk_type, r.text) for r in T.chunks(d).collect()}
    assert set(got) == {"srs__use_case_a", "srs__design", "srs__design_2", "n__document"} and got["srs__use_case_a"] == ("FR", "body\n#### deep\nmore")


def test_skeleton_folds():
    s = T.skeleton("// c\nconst a = [1, 2, 3, 4, 5];\nreturn <Card x={1}>long</Card>")
    assert "c\n" not in s and "[…]" in s and "<Card/>" in s


def test_audit(spark):
    n = spark.createDataFrame([(k, "Function") for k in "abcd"], "node_id string, node_type string")
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "b", "CALLS"), ("a", "c", "CALLS")], "source_id string, target_id string, edge_type string")
    assert [r.node_id for r in audit.orphans(n, e).collect()] == ["d"]
    assert {(r.node_id, r.kind) for r in audit.ends(n, e).collect()} == {("a", "source"), ("c", "sink")}
    assert {r.node_id: r.total for r in audit.top_degree(n, e).collect()} == {"a": 2, "b": 2, "c": 1}
    h = spark.createDataFrame([(x,) for x in (0.0, 1.0, 5.0, 10.0)], "v double")
    assert {r.bin: r.n for r in audit.histogram(h, "v").collect()} == {0: 2, 2: 1, 4: 1}
    assert {r.bin: r.n for r in audit.histogram(h.limit(1), "v").collect()} == {0: 1}


def test_bm25_negative_idf_floor(spark):
    import math

    docs = spark.createDataFrame([("1", "aa bb"), ("2", "aa cc"), ("3", "aa aa")], "id string, text string")
    got = {r.term: r.idf for r in lexical.idf(lexical.terms(docs, "id", "text"), docs.agg(F.count("*").alias("n"))).collect()}
    raw = {"aa": math.log(0.5) - math.log(3.5), "bb": math.log(2.5) - math.log(1.5)}
    assert got["aa"] == pytest.approx(0.25 * (raw["aa"] + 2 * raw["bb"]) / 3) and got["bb"] == pytest.approx(raw["bb"])


def test_files_are_scanned_once_by_all_cores(spark, tmp_path):
    kept = []

    def written(df):
        df.write.parquet(str(tmp_path / f"{len(kept)}"))
        kept.append(df.rdd.getNumPartitions())
        return spark.read.schema(df.schema).parquet(str(tmp_path / f"{len(kept) - 1}"))

    files = spark.createDataFrame([(f"/r/{p}", s) for p, s in SRC.items()], "path string, content string").coalesce(1)
    for f in (T.nodes, T.edges):
        got = f(files, written=written)
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.select(*sorted(got.columns)).where("true").collect()), key=str) == sorted(map(tuple, (x := f(files)).select(*sorted(x.columns)).collect()), key=str)
    assert kept == [4 * spark.sparkContext.defaultParallelism] * 2


def test_propagation_reads_edges_once_and_repeated_ones_change_nothing(spark):
    n = spark.createDataFrame([(x, "Function", "f", None) for x in "abcd"], "node_id string, node_type string, file_path string, file_class string")
    rows = [("b", "a", "CALLS"), ("c", "b", "IMPLEMENTS"), ("c", "b", "TYPED_BY"), ("z", "b", "TYPED_BY"), ("d", "z", "TYPED_BY")]  # z isn't a node: it is reached and leads nowhere
    e = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string")
    s = spark.createDataFrame([("a", 1, False)], "node_id string, ord int, low boolean")
    assert G.degrees(e)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    once, twice = (sorted(map(str, G.propagate(n, x, s, dims.edge_config(spark)).collect())) for x in (e, e.union(e)))
    assert once == twice
    got = {r.node_id: (r.depth, list(r.chain), list(r.path)) for r in G.propagate(n, e, s, dims.edge_config(spark)).collect()}
    assert got == {"a": (0, [], ["a"]), "b": (1, ["CALLS"], ["a", "b"]), "c": (2, ["CALLS", "IMPLEMENTS"], ["a", "b", "c"]), "z": (2, ["CALLS", "TYPED_BY"], ["a", "b", "z"])}
