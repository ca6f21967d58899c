"""Cases in which a registered query once did less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

from knowmill import catalog
from knowmill.operators import graph, html, ranking, reasoning
from knowmill.sources import shared, tables


def test_every_label_is_asked(spark, tmp_path):
    e = spark.range(240).select(F.col("id").alias("vec_id"), (F.col("id") % 120).cast("int").alias("label"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("embedding"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES["cosine_topk"](spark, str(tmp_path)).select("query_label").distinct().count() == 120
    assert [r.query_id for r in catalog.QUERIES["cosine_topk_all"](spark, str(tmp_path)).select("query_id").distinct().orderBy("query_id").collect()] == [0, 50, 100, 150, 200]


def test_all_sizes_and_whole_texts(spark, tmp_path):
    part = [(1, "B", "red old tin", 4, "T"), (2, "B", "red old tins", 40, "T"), (3, "C", "red old tin", 4, "U"), (4, "C", "red old tins", 9, "T")]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_name string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert [(r.a, r.b, r.pairs) for r in catalog.QUERIES["similar_names"](spark, str(tmp_path)).collect()] == [(1, 2, 2)]
    docs = [(1, "de", "the " * 200 + " und der die das" * 300)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["document_language_whole"](spark, str(tmp_path)).first().detected == "de"


def test_starts_with_one_neighbour_share_its_search(spark, monkeypatch):
    edges = [(0, 1000), (1000, 1001), (1001, 1002), (1000, 1002), (1002, 1003)] + [(i, 1000) for i in range(1, 60)]
    dealt, keep = [], graph.written

    def counted(df, name):
        out = keep(df, name)
        dealt.append(out.count() if name == "frontier" else 0)
        return out

    monkeypatch.setattr(graph, "written", counted)
    starts = spark.createDataFrame([(i,) for i in [*range(50), 1001]], "id long")
    rows = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), starts, 3).collect()
    near = {u: {b if a == u else a for a, b in edges if u in (a, b)} for u in {x for e in edges for x in e}}
    want = {}
    for s in [*range(50), 1001]:
        level, known = {s: [s]}, {s}
        for hop in range(1, 4):
            steps = [(v, [*p, v]) for u, p in level.items() for v in near[u] - known]
            level = {v: min(p for w, p in steps if w == v) for v, _ in steps}
            known |= set(level)
            want |= {(s, v, hop): p for v, p in level.items()}
    assert {(r.start, r.node, r.distance): r.path for r in rows} == want and len(rows) == len(want)
    # Two searches of 63 other nodes at most, not 51.
    assert sum(dealt) <= 2 * 63


def test_steps_deal_numbers_instead_of_paths(spark, monkeypatch):
    """The least of many ways to a node is found by hashes of numbers, without sorting or spilling paths; doubled edges and
    edges of both directions count once."""
    plans, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    edges = [tuple(e) for e in np.random.default_rng(4).integers(0, 30, (60, 2)).tolist()]
    near = {u: {a + b - u for a, b in edges if u in (a, b) and a != b} for u in range(30)}
    starts = [u for u in range(30) if u % 3 == 0]
    rows = graph.shortest_paths(spark.createDataFrame(edges + edges[:9] + [(b, a) for a, b in edges[:9]], "src long, dst long"), spark.createDataFrame([(u,) for u in starts], "id long"), 4).collect()
    want = {}
    for s in starts:
        level, known = {s: [s]}, {s}
        for hop in range(1, 5):
            steps = [(v, [*p, v]) for u, p in level.items() for v in near[u] - known]
            level = {v: min(p for w, p in steps if w == v) for v, _ in steps}
            known |= set(level)
            want |= {(s, v, hop): p for v, p in level.items()}
    assert {(r.start, r.node, r.distance): r.path for r in rows} == want and len(rows) == len(want)
    assert plans and not any("SortAggregate" in p for p in plans)


def test_tables_that_grow_are_not_broadcast(spark, tmp_path):
    turns = [(i, t, "user", f"Anna Marie and Anna of Basel met Basel {i}") for i in range(20) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = catalog.QUERIES["entity_confidence"](spark, str(tmp_path))
    assert out.count() == 20 * 3 * 3
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def test_ways_to_a_node_are_dealt_as_lists(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 7)
    edges = [(i, 100 + j) for i in range(12) for j in range(40) if (i + j) % 3] + [(i, i + 1) for i in range(500, 503)] + [(500, 0), (7, 7)]
    near = {u: {b if a == u else a for a, b in edges if u in (a, b)} - {u} for u in {x for e in edges for x in e}}
    e = spark.createDataFrame(edges, "src long, dst long")
    assert graph.lists(graph.undirected(e), 7).where("size(vs) > 20").count() == 0
    for hops in (1, 3):
        want = {}
        for s in near:
            level, known = {s}, {s}
            for hop in range(1, hops + 1):
                level = set().union(*[near[u] for u in level]) - known
                known |= level
                want |= {(s, v): hop for v in level}
        starts = spark.createDataFrame([(s,) for s in near], "id long")
        for met in (1_000_000, 25):
            rows = graph.neighbours(e, starts, hops, met).collect()
            assert {(r.start, r.node): r.distance for r in rows} == want and len(rows) == len(want)


def test_edges_take_as_many_partitions_as_lines_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    orders = spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 30).alias("o_custkey"))
    lines = spark.range(2000).select((F.col("id") % 400).alias("l_orderkey"), (F.col("id") % 70).alias("l_partkey"), (F.col("id") % 9).alias("l_suppkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for edges, key in ((tables.bought(spark, str(tmp_path)), "o_custkey"), (tables.supplied(spark, str(tmp_path)), "l_suppkey")):
        assert edges.rdd.getNumPartitions() == 20
        want = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(key, "l_partkey").count()
        assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_of_items_are_dealt_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 500)
    rows = [(f, (f * f + k * 7) % 23) for f in range(300) for k in range(4)] + [(1, 1), (1, 1), (900, 5), (901, 99)]
    sets = [{i for g, i in rows if g == f} for f in {f for f, _ in rows}]
    total = {i: sum(i in s for s in sets) for _, i in rows}
    want = {(a, b): n for a in total for b in total if a != b and (n := sum({a, b} <= s for s in sets)) >= 0.1 * total[a] and n}
    out = graph.co_occurrence(spark.createDataFrame(rows, "fact long, item long"), 0.1)
    got = out.collect()
    assert {(r.a, r.b): r.shared for r in got} == want and len(got) == len(want)
    assert all(r.total == total[r.a] and r.share == r.shared / r.total for r in got)
    made = sum(len(s) ** 2 for s in sets)
    assert out.rdd.getNumPartitions() == -(-made // 500) > 4


def test_wedges_without_a_way_on_are_not_made(spark, monkeypatch):
    made, keep = [], graph.written

    def counted(df, name):
        out = keep(df, name)
        made.extend([out.agg(F.sum("n")).first()[0] or 0] if name == "asked" else [])
        return out

    monkeypatch.setattr(graph, "written", counted)
    # Low nodes with many common neighbours, of which few have edges; and a ball of triangles beside them.
    edges = [(i, 1000 + j) for i in range(60) for j in range(20)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1001, 1000), (5, 5)]
    edges += [(3000 + i, 3000 + j) for i in range(12) for j in range(i) if (i * j) % 5 != 1] + [(4000, 4001)]
    near = {u: {b if a == u else a for a, b in edges if u in (a, b)} - {u} for u in {x for e in edges for x in e}}
    want = {u: (len(v), sum(len(near[x] & v) for x in v) // 2) for u, v in near.items() if len(v) > 1}
    rows = graph.clustering(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.id: (r.neighbours, r.links) for r in rows} == want and len(rows) == len(want)
    assert all(abs(r.coefficient - 2 * r.links / (r.neighbours * (r.neighbours - 1))) < 1e-12 for r in rows)
    # Pairs of neighbours of the low nodes alone are 60 * 190.
    assert made and sum(made) < 1000


def test_tokens_of_pages_lie_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    pages = [(i, f"<html><body><main>text {i} <b>of</b> a page</main></body></html>") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    assert html.elements(df).rdd.getNumPartitions() >= 20
    assert {(r.page_id, r.content) for r in html.main_text(df).collect()} == {(i, f"text {i} of a page") for i in range(300)}


def test_sure_ways_lie_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    edges = [(i % 40, 100 + (i * i) % 60, 0.5 + i % 7 / 14) for i in range(1000)]
    parts, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: parts.append(df.rdd.getNumPartitions()) or keep(df, name))
    asked = spark.createDataFrame(edges, "src long, dst long, confidence double"), spark.createDataFrame([(0,), (107,)], "id long")
    rows = graph.surest(*asked, 2).collect()
    assert parts[0] == 20
    monkeypatch.setattr(graph, "ROWS", 0)
    assert sorted(map(tuple, graph.surest(*asked, 2).collect())) == sorted(map(tuple, rows))
    best = {}
    for a, b, c in edges:
        best[a, b] = best[b, a] = max(c, best.get((a, b), 0))
    want = {}
    for s in (0, 107):
        level = {s: 1.0}
        for hop in (1, 2):
            found = {}
            for u, c in level.items():
                for (x, y), e in best.items():
                    if x == u:
                        found[y] = max(found.get(y, 0), min(c, e))
            level = found
            for v, c in found.items():
                old = want.get((s, v), (hop, 0))
                want[s, v] = old[0], max(old[1], c)
    assert {(r.start, r.node): (r.depth, r.confidence) for r in rows} == {k: v for k, v in want.items() if k[0] != k[1]}


def test_a_batch_is_multiplied_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE", 7)
    ids = [(i, None if i == 3 else [float(i % 5), 1.0, float(i % 3)][: 2 if i == 11 else 3]) for i in range(200)]
    v = spark.createDataFrame(ids, "id long, embedding array<double>").coalesce(1)
    q = v.where("id % 9 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    rows = ranking.nearest(v, q, 5, 0.1).collect()
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in ids if x and len(x) == 3}
    for i in range(0, 200, 9):
        want = sorted((-round(float(unit[i] @ u), 12), j) for j, u in unit.items() if unit[i] @ u >= 0.1)[:5]
        got = sorted((r.rank, r.id, r.score) for r in rows if r["query"] == i)
        assert [x[1] for x in got] == [j for _, j in want] and np.allclose([x[2] for x in got], [-s for s, _ in want])


def test_questions_meet_documents_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 1000)
    names = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    docs = [(i, " ".join(names[(i * 7 + k * k) % 40] for k in range(12))) for i in range(200)]
    questions = [(i, " ".join(names[(i + 3 * k) % 40] for k in range(9))) for i in range(30)]
    q, d = spark.createDataFrame(questions, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    parts = []
    monkeypatch.setattr(reasoning, "dealt", lambda df, rows, *keys: parts.append(rows) or shared.dealt(df, rows, *keys))
    one = sorted(map(tuple, reasoning.refine(q, d, 0.9, 2, 5).collect()))
    assert parts and max(parts) > 10_000
    monkeypatch.setattr(reasoning, "ROWS", 10)
    assert sorted(map(tuple, reasoning.refine(q, d, 0.9, 2, 5).collect())) == one and len(one) == 30


def test_levels_read_links_as_they_lie(spark, monkeypatch):
    links = [(f, e, 0.2 + (f * 13 % 40) / 50) for f in range(400) for e in {f % 3, 3 + f % 50, 60 + f * f % 31}]
    plans, keep = [], reasoning.written
    monkeypatch.setattr(shared, "ROWS", 200)
    monkeypatch.setattr(reasoning, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or keep(df, name))
    asked = spark.createDataFrame([(q, q % 53) for q in range(20)] + [(1, 70)], "query_id long, entity long")
    rows = reasoning.facts_by_level(asked, spark.createDataFrame([*links, (7, 1, 0.01)], "fact_id long, entity long, score double"), 3, 4).collect()
    want = set()
    for q in range(20):
        front, seen, found = {q % 53} | ({70} if q == 1 else set()), set(), set()
        for level in range(3):
            seen |= front
            met = {f: s for f, e, s in links if e in front and f not in found and s * (1 - 0.2 * level) >= 0.1}
            new = sorted(met, key=lambda f: (-met[f], f))[:4]
            want |= {(q, f, level, round(met[f] * (1 - 0.2 * level), 9)) for f in new}
            found |= set(new)
            front = {e for f, e, _ in links if f in new} - seen
    assert {(r.query_id, r.fact_id, r.level, round(r.score, 9)) for r in rows} == want and len(rows) == len(want)
    assert all("Bucketed: true" in plan for name, plan in plans if name == "new")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("knowmill_")]


def test_betweenness_holds_rows_of_hubs_only(spark, monkeypatch):
    """Starts of several blocks, inner nodes of several tiles, edges between hubs, an end and a part apart from the rest."""
    rng = np.random.default_rng(7)
    edges = {(h, 100 + i) for i in range(400) for h in rng.choice(40, 3, replace=False).tolist()} | {(h, h + 1) for h in range(0, 30, 3)}
    edges |= {(100, 600), (600, 601), (700, 701), (701, 702)}
    nodes = sorted({x for e in edges for x in e} | {800})
    starts = [*range(40), *range(100, 130), 601, 700, 800]
    near = {x: [] for x in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    owed = dict.fromkeys(nodes, 0.0)
    for s in starts:
        far, paths, order = {s: 0}, {s: 1}, [s]
        for a in order:
            for b in near[a]:
                if b not in far:
                    far[b], paths[b] = far[a] + 1, 0
                    order.append(b)
                if far[b] == far[a] + 1:
                    paths[b] += paths[a]
        own = dict.fromkeys(order, 0.0)
        for a in reversed(order[1:]):
            own[a] = paths[a] * sum((1 + own[b]) / paths[b] for b in near[a] if far[b] == far[a] + 1)
            owed[a] += own[a]
    held, keep = [], graph.written

    def counted(df, name):
        out = keep(df, name)
        held.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    for limit, most in (("TILE", 400), ("HELD", 100), ("LIST", 25)):
        monkeypatch.setattr(graph, limit, most, raising=False)
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    rows = graph.betweenness(spark.createDataFrame(sorted(edges), "src long, dst long"), frame(nodes), frame(starts)).collect()
    n = len(nodes)
    want = {i: round(x * n / len(starts) / ((n - 1) * (n - 2)), 12) for i, x in owed.items()}
    assert {r.id: round(r.betweenness, 12) for r in rows} == want and len(rows) == n
    # One level alone has a row for most of the 73 starts and 450 nodes, if starts have rows of their own.
    assert max(held) < n * len(starts) / 10
