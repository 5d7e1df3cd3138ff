"""Small cases: URLs, registry, payloads, loading, graph metrics, retrieval and evaluation."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import checks, evaluate, graph, infer, registry, search
from corvane.operators.components import connected_components
from corvane.sources import load


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://github.com/a/b", "https://github.com/a/b"),
        ("https://WWW.GitHub.com/a/b.git/", "https://github.com/a/b"),
        ("http://u:p@github.com:8080//a//b?x=1#y", "https://github.com/a/b"),
        ("https://github.com/A/b.git.git", "https://github.com/A/b.git"),
        ("https://github.com/a b/c", "https://github.com/a b/c"),
        ("https://github.com/a/b;v=1", "https://github.com/a/b"),
        ("https://example.org/a/b", "unsupported_host"),
        ("https://github.com/a", "not_a_repository_path"),
        ("https://github.com/a/b/c", "not_a_repository_path"),
        ("https://github.com/a/.git", "empty_name"),
        ("nonsense", "unsupported_host"),
        (None, "unsupported_host"),
    ],
)
def test_urls(spark, url, expected):
    row = registry.normalize_repo_url(spark.createDataFrame([(1, url)], "id int, raw_url string")).first()
    assert (row.normalized_url or row.reject_reason) == expected


def test_register_is_total_and_first_writer_wins(spark):
    asked = spark.createDataFrame([(1, "https://github.com/a/b"), (2, "https://github.com/a/b.git"), (3, "https://github.com/c/d"), (4, "x")], "request_id long, raw_url string")
    known = spark.createDataFrame([("https://github.com/c/d",)], "github_url string")
    accepted, rejected = registry.register(asked, known)
    assert [r.request_id for r in accepted.collect()] == [1]
    assert {r.request_id: r.reject_reason for r in rejected.collect()} == {2: "duplicate", 3: "duplicate", 4: "unsupported_host"}


def test_pages_are_bounded(spark):
    with pytest.raises(ValueError):
        registry.page(spark.range(3), [F.col("id")], 1, 101)


def test_payload_coercion(spark):
    raw = ['{"id": "7", "name": "n", "full_name": "o/n", "default_branch": "m", "private": false, "more": 1}', '{"id": 7, "name": "n"}', "broken", None]
    out = load.parse_repo_payload(spark.createDataFrame([(r,) for r in raw], "raw string"), "raw").select("repo").collect()
    assert [r.repo and r.repo.id for r in out] == [7, None, None, None]


def test_upsert_twice_is_once(spark):
    a = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, version int")
    b = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, v string, version int")
    once = load.upsert(a, b, ["id"], "version")
    assert sorted(map(tuple, load.upsert(once, b, ["id"], "version").collect())) == sorted(map(tuple, once.collect())) == [(1, "a", 0), (2, "c", 1), (3, "d", 1)]


def test_sections_replace_only_their_partition(spark, tmp_path):
    path = str(tmp_path / "sections")
    load.publish_section(spark.createDataFrame([(1, "overview", "x"), (1, "timeline", "y")], "snapshot_id int, section_type string, body string"), path)
    load.publish_section(spark.createDataFrame([(1, "overview", "z")], "snapshot_id int, section_type string, body string"), path)
    assert {(r.section_type, r.body) for r in spark.read.parquet(path).collect()} == {("overview", "z"), ("timeline", "y")}


def test_registry_round_trip_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "o", "n")], "id long, github_url string, owner string, name string").withColumn("created_at", F.current_timestamp())
    load.append_registry(rows, str(tmp_path), "repositories")
    assert load.read_registry(spark, str(tmp_path), "repositories").first().github_url == "u"
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text("import os\nfrom a.b import c\n")
    (tmp_path / "src" / "x.bin").write_text("?")
    files = load.read_source_tree(spark, str(tmp_path / "src"))
    found, rejects = tx.imports_of(files)
    assert {r.module for r in found.collect()} == {"os", "a.b"} and rejects.count() == 1
    (tmp_path / "issues").mkdir()
    (tmp_path / "issues" / "a.json").write_text('{"number": 3, "title": "t", "zzz": 1}\n')
    assert load.read_artifacts(spark, str(tmp_path), "issues").first().number == 3


def test_resolved_imports(spark):
    imports = spark.createDataFrame([("a.py", "p.q"), ("a.py", "none")], "path string, module string")
    files = spark.createDataFrame([("p/q.py",)], "path string")
    assert {r.module: r.target for r in tx.resolve_imports(imports, files).collect()} == {"p.q": "p/q.py", "none": None}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components_ignore_edge_order(spark):
    chain = [(i, i + 1) for i in range(20)] + [(40, 41), (50, 50)]
    for pairs in (chain, [(b, a) for a, b in reversed(chain)]):
        found = {r.node: r.component for r in connected_components(edges(spark, pairs)).collect()}
        assert {found[i] for i in range(21)} == {0} and found[41] == 40 and found[50] == 50
    assert connected_components(edges(spark, [])).count() == 0


def test_components_of_stars_and_of_what_only_looks_settled(spark):
    pairs = [(2, 1), (3, 1), (1, 3), (3, 1), (12, 10), (12, 11), (21, 20), (22, 21), (None, 7)]
    found = [tuple(r) for r in connected_components(edges(spark, pairs)).collect()]
    assert sorted(found) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10), (20, 20), (21, 20), (22, 20)]


def test_pagerank_sums_to_one(spark):
    ranks = [r["rank"] for r in graph.pagerank(edges(spark, [(1, 2), (2, 3), (4, 3)]), 5).collect()]
    assert abs(sum(ranks) - 1) < 1e-9


def test_cycles_and_order(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 8), (8, 7), (7, 1)])
    found = {r.node: (r.component, r.size) for r in graph.dependency_cycles(e).collect()}
    assert found == {1: (1, 3), 2: (1, 3), 3: (1, 3), 6: (6, 1), 7: (7, 2), 8: (7, 2)}
    layers = {r.node: r.layer for r in graph.learning_order(e).collect()}
    assert layers == {5: 0, 4: 1, 1: 2, 2: 2, 3: 2, 7: 3, 8: 3, 6: 0}


def test_communities_and_betweenness(spark):
    cliques = [(a, b) for g in (0, 10) for a in range(g, g + 4) for b in range(g, g + 4) if a < b] + [(3, 10)]
    labels = {r.node: r.label for r in graph.communities(edges(spark, cliques)).collect()}
    assert len({labels[i] for i in range(4)}) == 1 and len({labels[i] for i in range(10, 14)}) == 1
    path = edges(spark, [(1, 2), (2, 3), (3, 4)])
    pivots = spark.createDataFrame([(i,) for i in range(1, 5)], "node long")
    assert {r.node: r.betweenness for r in graph.betweenness(path, pivots).collect() if r.betweenness} == {2: 2.0, 3: 2.0}


def test_paths_use_stored_edges(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)])
    path = graph.path_to(5, graph.shortest_paths(1, e))
    assert sorted(map(tuple, path.collect())) == [(1, 1, 2), (2, 2, 4), (3, 4, 5)]
    assert graph.paths_unproven(path, e).count() == 0
    with pytest.raises(ValueError):
        graph.neighbors(spark.createDataFrame([(1,)], "node long"), e, 4)


def test_subgraph_and_candidates(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    kept, inner = graph.subgraph(nodes, edges(spark, [(1, 2), (2, 5)]), F.col("node") < 4)
    assert kept.count() == 3 and inner.count() == 1
    kinds = spark.createDataFrame([(1, "commit"), (2, "adr"), (5, "issue")], "artifact_id long, kind string")
    row = infer.decision_candidates(edges(spark, [(1, 2), (2, 5)]), kinds).first()
    assert (row.lead_id, row.n_artifacts) == (2, 3)


def test_lsh_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.doc_id) for r in search.vector_top_k(queries, vectors).collect()}
    near = {(r.query_id, r.doc_id) for r in search.lsh_top_k(queries, vectors).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_lookups_of_short_and_odd_keys(spark):
    names = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "xabc"), (4, None), (5, "")], "doc_id long, key string")
    asked = spark.createDataFrame([(1, "a"), (2, "ab"), (3, "abcd"), (4, ""), (5, None), (6, "xab")], "query_id long, key string")
    assert sorted(map(tuple, search.lookup_prefix(asked, names).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (6, 3)]


def test_containing_equals_comparing_all(spark):
    texts = ["", None, "one two three four five six seven", "xone two three four  five six", "zz one two\nthree four five six seven eight", "two three", "ne two three four fiv", "a.b", "aaab"]
    items = ["one two three four five six", "two three", "ne two three four fiv", ".", "five six seven eight", "one two\nthree four five six", "absent words are not found here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "query_id long, question string")
    want = sorted((q, d) for q, i in enumerate(items) for d, t in enumerate(texts) if i and t and i in t)
    assert sorted(map(tuple, search.containing(docs, asked).collect())) == want


def test_scoped_search_stays_inside(spark):
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (3, 2, [1.0, 0.0]), (4, 1, None), (5, 1, [0.0, 0.0])], "doc_id long, snapshot int, embedding array<double>")
    asked = spark.createDataFrame([(9, 1, [1.0, 0.0]), (8, 3, [1.0, 0.0])], "query_id long, snapshot int, embedding array<double>")
    assert [(r.query_id, r.doc_id) for r in search.vector_top_k(asked, vectors, scope=("snapshot",)).orderBy("rank").collect()] == [(9, 1), (9, 2)]


def test_records_without_evidence_say_so(spark):
    asked = search.route(spark.createDataFrame([(1, "why was it chosen"), (2, "who wrote it"), (3, "nothing")], "query_id long, question string"))
    ranked = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.2), (2, 12, 1, 0.3)], "query_id long, doc_id long, rank int, confidence double")
    files = spark.createDataFrame([(10, "f1"), (10, "f1"), (12, "f2")], "doc_id long, item string")
    out = {r.query_id: r for r in search.answer_records(asked, ranked, {"related_files": files}).collect()}
    assert len(out[1]) == 15 and out[1].answer is None and out[1].evidence == [10] and out[1].related_files == ["f1"] and not out[1].insufficient and out[1].limitations == []
    assert out[2].insufficient and out[2].evidence == [] and out[2].possible_interpretations == ["Inference: document 12 may be related"] and out[2].related_files == ["f2"]
    assert out[3].insufficient and out[3].possible_interpretations == [] and out[3].limitations and out[3].suggested_follow_up


def test_evidence_is_counted_whole_and_listed_in_part(spark):
    items = spark.createDataFrame([(1,), (2,)], "sha long")
    evidence = spark.createDataFrame([(1, e, 0.5) for e in range(30)], "sha long, evidence_id int, confidence double")
    out = {r.sha: r for r in infer.attach_evidence(items, evidence, ["sha"], 5).collect()}
    assert out[1].n_evidence == 30 and [e.evidence_id for e in out[1].evidence] == [0, 1, 2, 3, 4] and out[1].combined == 1.0
    assert (out[2].n_evidence, out[2].combined, out[2].evidence) == (0, 0.0, [])
    paths = infer.evidence_paths(spark.createDataFrame([(1,), (2,)], "issue_id long"), spark.createDataFrame([(1, 5)], "issue_id long, pr_id long"), spark.createDataFrame([(5, 7)], "pr_id long, sha long"), spark.createDataFrame([(7, 3)], "sha long, file_id long"))
    assert {r.issue_id: (r.path, r.completeness) for r in paths.collect()} == {1: (["issue:1", "pull_request:5", "commit:7", "file:3"], 1.0), 2: (["issue:2"], 0.25)}


def test_latest_snapshot_and_responses(spark):
    rows = spark.createDataFrame([(1, 9, "a", "ready", "2024-01-01"), (2, 9, "b", "ready", "2024-01-02"), (3, 9, "c", "ready", "2024-01-02"), (4, 9, "d", "failed", "2024-02-01"), (5, 8, "e", "pending", "2024-02-01")], "id long, repository_id long, commit_sha string, status string, created_at string")
    assert [(r.repository_id, r.snapshot_id) for r in registry.latest_snapshots(rows).collect()] == [(9, 3)]
    assert registry.response(rows, "snapshot").columns == list(registry.RESPONSES["snapshot"])


def test_rejects_and_declared_dependencies(spark, tmp_path):
    seen = spark.createDataFrame([(1, "duplicate"), (2, None), (3, "empty_name")], "request_id long, reject_reason string")
    for _ in range(2):
        load.write_rejects(seen, str(tmp_path / "rejects"))
    assert sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "rejects")).collect()) == [1, 1, 3, 3]
    files = spark.createDataFrame([("a/requirements.txt", "numpy==1.0\n# no\npandas >= 2 ; x\n-r b.txt\nplain"), ("package.json", '{"dependencies": {"left": "^1"}, "devDependencies": {"right": "2"}}'), ("x.py", "a==1"), ("b/package.json", "broken")], "path string, content string")
    assert sorted(map(tuple, tx.declared_dependencies(files).collect())) == [("a/requirements.txt", "numpy"), ("a/requirements.txt", "pandas"), ("a/requirements.txt", "plain"), ("package.json", "left"), ("package.json", "right")]


def test_tau_of_ties_and_many_blocks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(40), rng.randrange(300)) for i in range(1200)] + [(5000 + i, 7, 7) for i in range(300)]
    sign = lambda x: (x > 0) - (x < 0)
    want = sum(sign(a[1] - b[1]) * sign(a[2] - b[2]) for a, b in combinations(rows, 2)) / (len(rows) * (len(rows) - 1) / 2)
    assert evaluate.kendall_tau(spark.createDataFrame(rows, "item int, a int, b int"), parts=7).first().tau == pytest.approx(want, abs=1e-6)
    assert evaluate.kendall_tau(spark.createDataFrame(rows[:1], "item int, a int, b int")).first().tau is None


def test_citations_and_rates(spark):
    evidence = spark.createDataFrame([(1, 1, "alpha beta gamma"), (2, 2, "x")], "doc_id long, snapshot int, text string")
    claims = spark.createDataFrame([(1, 1, 1, "alpha beta"), (2, 1, 1, "other words"), (3, 2, 1, "x"), (4, 9, 1, "x")], "claim_id long, doc_id long, snapshot int, claim string")
    out = search.verify_citations(claims, evidence)
    assert {r.claim_id: r.outcome for r in out.collect()} == {1: "kept", 2: "downgraded", 3: "limitation", 4: "limitation"}
    assert evaluate.citation_rates(out).first().correct == 0.25


def test_gate_and_tau(spark):
    values = spark.createDataFrame([("recall_at_10", 0.9), ("median_latency_s", 20.0), ("other", 1.0)], "metric string, value double")
    assert {r.metric: r.passed for r in evaluate.gate(values).collect()} == {"recall_at_10": True, "median_latency_s": False}
    ranks = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 3)], "item int, a int, b int")
    assert evaluate.kendall_tau(ranks).first().tau == 1.0


def test_checks_on_nulls_and_masks(spark):
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, "pending")], "id int, status string")
    assert checks.unknown(df, "status", ("pending",)).count() == 2
    assert checks.orphans(df, "status", df, "status").count() == 0
    row = spark.range(1).select(tx.mask_secrets(F.lit('token = "abc" a@b.org')).alias("m"), tx.normal_path(F.lit("/./a//b")).alias("p"), tx.intent(F.lit("Who wrote it?")).alias("i")).first()
    assert row.m == 'token = "***" <email>' and row.p == "a/b" and row.i == "contributor"


def test_long_chains_are_followed_to_their_end(spark):
    chain = edges(spark, [(i, i + 1) for i in range(1, 16)])
    tree = graph.shortest_paths(1, chain)
    assert {r.node: (r.depth, r.parent) for r in tree.collect()} == {i: (i - 1, i - 1 if i > 1 else None) for i in range(1, 17)}
    assert sorted(map(tuple, graph.path_to(16, tree).collect())) == [(i, i, i + 1) for i in range(1, 16)]
    pivots = spark.createDataFrame([(i,) for i in range(1, 17)], "node long")
    assert {r.node: r.betweenness for r in graph.betweenness(chain, pivots).collect() if r.betweenness} == {i: float((i - 1) * (16 - i)) for i in range(2, 16)}


def test_learning_order_beyond_a_hundred_groups(spark):
    layers = graph.learning_order(edges(spark, [(i, i + 1) for i in range(1, 105)]))
    assert {r.node: r.layer for r in layers.collect()} == {i: 105 - i for i in range(1, 106)}
    few = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "node long, layer int")
    ranks = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.7)], "node long, rank double")
    assert {r.node: r.place for r in graph.learning_places(few, ranks).collect()} == {3: 1, 2: 2, 1: 3}


def test_co_change_counts_large_commits(spark):
    small = {1: [1, 2], 2: [1, 2, 3], 3: [3, 5000, 5001], 4: [1], 5: [5000, 7]}
    commits = {**small, 10: list(range(1, 1101)), 11: [1, 2, *range(5, 9), *range(2000, 3000)], 12: [5, 6, *range(4000, 5002)]}
    each, support = Counter(f for files in commits.values() for f in files), Counter()
    for files in commits.values():
        support.update(combinations(sorted(f for f in files if each[f] > 1), 2))
    want = {(a, b): (n, round(n / each[a], 6), round(n * len(commits) / (each[a] * each[b]), 6)) for (a, b), n in support.items() if n > 1}
    rows = spark.createDataFrame([(c, f) for c, files in commits.items() for f in files], "sha long, file_id long")
    for large in (1000, 2, 5000):
        got = {(r.file_a, r.file_b): (r.support, r.confidence, r.lift) for r in graph.co_change(rows, large=large).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_equal_versions_leave_the_same_row_in_any_order(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, "d"), (2, None, "e")]
    found = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "id long, version int, x string")
        found.add(tuple(sorted(tuple(r) for r in load.upsert(df.limit(2), df.exceptAll(df.limit(2)), ["id"], "version").collect())))
    assert len(found) == 1 and len(next(iter(found))) == 2


def test_decision_rules(spark):
    firm, model = "artifact", "model_inference"
    support = lambda d, part, c=0.7, kind=firm: (d, kind, c, part, False)
    rows = [
        *(support(1, "context"), support(1, "action")),
        *(support(2, "context"), support(2, None)),  # no action
        *(support(3, "context"), support(3, "action", 0.99, model), support(3, None)),  # the action is a model's
        *(support(4, "context"), support(4, "action"), (4, firm, 0.95, None, True)),  # stronger contradiction
        *(support(5, "context"), support(5, "action"), (5, firm, 0.5, None, True), (5, model, 1.0, None, True)),  # a weaker one, a model's
        *((6, firm, 0.9, "context", True), (6, None, 0.9, "action", None)),  # nothing firm for it
        *(support(7, "context", 0.1), (7, firm, None, None, None)),
    ]
    evidence = spark.createDataFrame(rows, "decision_id long, evidence_type string, confidence double, part string, contradicts boolean")
    got = {r.decision_id: r.status for r in infer.decision_rules(evidence).collect()}
    assert got == {1: "confirmed", 2: "candidate", 3: "candidate", 4: "rejected", 5: "confirmed", 6: "insufficient_evidence", 7: "rejected"}
    assert infer.decision_rules(evidence.limit(0)).count() == 0


def test_mean_ranks_of_ties_and_nulls(spark):
    rng = random.Random(5)
    scores = [(i, float(rng.randrange(300))) for i in range(2000)] + [(9000, None)]
    got = {r.item: r.place for r in evaluate.average_ranks(spark.createDataFrame(scores, "item int, score double").repartition(7), "item", "score", "place").collect()}
    known = sorted((s for _, s in scores if s is not None), reverse=True)
    want = {v: known.index(v) + (known.count(v) + 1) / 2 for v in set(known)}
    assert got == {i: want[s] for i, s in scores if s is not None}


def test_detail_counts_and_children(spark):
    base, tags = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (3, "z")], "of int, tag string")
    assert sorted(map(tuple, infer.detail(base, "id", {"tags": (tags, "of", "tag")}).collect())) == [(1, 2, "a"), (2, 0, None)]
    assert sorted(map(tuple, infer.detail_children("id", {"tags": (tags, "of", "tag")}).collect())) == [(1, "tags", "a"), (1, "tags", "b"), (3, "tags", "z")]


def test_nested_lists_all_children_in_order(spark):
    base = spark.createDataFrame([("a",), ("b",), (None,)], "of string")
    many = spark.range(25_000).select(F.lit("a").alias("of"), F.format_string("%05d", "id").alias("item"))  # several batches
    few = spark.createDataFrame([("b", "y"), ("b", "x"), ("b", "x"), ("b", None), ("z", "gone"), (None, "n")], "of string, tag string")
    lines = spark.createDataFrame([("b", 2, ["2:x"]), ("b", 1, ["1:y", "1:z"])], "of string, at int, each array<string>")
    got = {r["of"]: r for r in infer.nested(base, "of", {"items": (many, "of", "item"), "tags": (few, "of", "tag"), "notes": (lines, "of", "at", "each")}).collect()}
    assert (got["b"]["n_notes"], got["b"]["first_notes"], got["b"]["notes"], got["a"]["n_notes"]) == (3, "1:y", "1:y\n1:z\n2:x", 0)
    assert set(got) == {"a", "b", None}
    assert (got["a"]["n_items"], got["a"]["first_items"], got["a"]["tags"]) == (25_000, "00000", None) and got["a"]["items"].split("\n") == [f"{i:05d}" for i in range(25_000)]
    assert (got["b"]["n_tags"], got["b"]["first_tags"], got["b"]["tags"], got["b"]["n_items"], got["b"]["items"]) == (3, "x", "x\nx\ny", 0, None)
    assert got[None]["tags"] == "n"
