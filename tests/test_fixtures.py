"""Small cases with expected values worked out from the rules, and operators against brute force."""

import itertools

from pyspark.sql import functions as F

from knowmill.functions import similarity as S
from knowmill.functions import text as T
from knowmill.operators import chunking, dedup, facts, fusion, graph, ranking, resolve
from knowmill.streaming import events


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_identifiers(spark):
    names = ["John Doe", "Zirbeldrüse", "C++", "!!!", "  Two  Words "]
    got = [x for (x,) in values(spark, "n string", [(n,) for n in names], T.entity_id(F.col("n")))]
    assert got == ["ent_john_doe_94890005", "ent_zirbeldrüse_f35a92d7", "ent_c_cedb1bac", "ent_e84c538e7fe25073_e84c538e", "ent_two_words_ee0fd1b2"]
    a, b = got[0], T.relation_id(F.col("s"), F.col("d"), F.lit("WORKS_FOR"))
    both = values(spark, "s string, d string", [(a, "x"), ("x", a)], b)
    assert both[0] == both[1] and both[0][0].startswith("rel_works_for_")


def test_fusion_of_two_lists(spark):
    v = spark.createDataFrame([(1, "Vector 1", 0.9), (1, "Vector 2", 0.8), (1, "Shared", 0.7)], "query_id long, content string, score double")
    g = spark.createDataFrame([(1, "Graph 1", 0.85), (1, "Shared", 0.75), (1, "Graph 2", 0.6)], "query_id long, content string, score double")
    a = spark.createDataFrame([(1, 2, 0.6)], "query_id long, n_entities int, complexity double")
    got = {r.content: (round(r.score, 6), r.found_by) for r in fusion.weighted(v, g, a).collect()}
    assert got == {"Shared": (0.531, "hybrid_both"), "Graph 1": (0.442, "hybrid_graph"), "Vector 1": (0.432, "hybrid_vector"), "Vector 2": (0.384, "hybrid_vector"), "Graph 2": (0.312, "hybrid_graph")}
    rrf = {r.content: round(r.score, 6) for r in fusion.by_rank(v, g).collect()}
    assert rrf == {"Shared": 0.032002, "Graph 1": 0.016393, "Vector 1": 0.016393, "Vector 2": 0.016129, "Graph 2": 0.015873}
    assert fusion.rank_and_filter(fusion.by_rank(v, g)).count() == 0 and fusion.rank_and_filter(fusion.weighted(v, g, a)).count() == 5
    assert {r.content for r in fusion.adaptive(v, g, a).where("score < 0.1").collect()} == set(got)
    assert {r.content: r.found_by for r in fusion.simple(v, g).collect()}["Shared"] == "vector"


def test_entity_similarity(spark):
    rows = [
        ("artificial intelligence", "AI", "CONCEPT", "CONCEPT", "d", "d", 0.452174), ("AI", "A.I.", "CONCEPT", "CONCEPT", "d", "e", 0.63), ("machine learning", "ML", "CONCEPT", "CONCEPT", "d", "e", 0.405),
        ("John Smith", "john smith", "PERSON", "PERSON", "d", "e", 0.93), ("Acme", "acme", "COMPANY", "ORGANIZATION", "d", "e", 0.87),
    ]
    col = lambda a, b: (F.col(a), F.col(b))
    got = values(spark, "a string, b string, t string, u string, d string, e string, want double", rows, F.round(S.entity_similarity(col("a", "b"), col("t", "u"), col("d", "e")), 6), "want")
    assert all(abs(x - y) < 2e-6 for x, y in got), got


def test_greedy_clusters_against_brute_force(spark):
    names = ["red bolt", "red bolts", "blue bolt", "bolt", "green nut", "green nuts big", "nut", "green nut"]
    rows = [(i, n, "T" if i % 3 else "U", f"d{i % 2}") for i, n in enumerate(names)]
    e = spark.createDataFrame(rows, "ord long, name string, type string, doc string")
    every = e.alias("x").join(e.alias("y"), F.col("x.ord") < F.col("y.ord"))
    score = S.entity_similarity(*[(F.col(f"x.{c}"), F.col(f"y.{c}")) for c in ("name", "type", "doc")])
    want = {(r.a, r.b) for r in every.select(F.col("x.ord").alias("a"), F.col("y.ord").alias("b"), score.alias("s")).where("s >= 0.7").collect()}
    pairs = resolve.candidates(e)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    primary = {}
    for i in range(len(names)):
        heads = [p for p in range(i) if primary[p] == p and (p, i) in want]
        primary[i] = heads[0] if heads else i
    assert {r.ord: r.primary for r in resolve.greedy(e, pairs).collect()} == primary


def test_fixed_size_chunks():
    text = "alpha beta gamma delta epsilon"
    clean = [(a, b, text[a:b].strip()) for a, b in chunking.word_bounds(text, 12, 3)]
    assert clean == [(0, 10, "alpha beta"), (7, 16, "eta gamma"), (13, 22, "mma delta"), (19, 30, "lta epsilon")]
    tail = [text[a:b] for a, b in chunking.word_bounds(text, 12, 3, tail=True)]
    assert len(tail) == 7 and tail[4:] == ["lon", "on", "n"]
    assert list(chunking.word_bounds("", 12, 3)) == []


def test_relation_duplicates(spark):
    rows = [("rel1", "entity1", "entity2", "WORKS_FOR", 0.9), ("rel2", "entity1", "entity2", "WORKS_FOR", 0.8), ("rel3", "entity1", "entity2", "EMPLOYED_BY", 0.85), ("rel4", "entity2", "entity1", "EMPLOYS", 0.7)]
    e = spark.createDataFrame(rows, "id string, src string, dst string, type string, confidence double")
    assert [tuple(r) for r in dedup.exact_duplicates(e).collect()] == [("rel2", "rel1")]
    assert dedup.reversed_duplicates(e).count() == 0
    same = e.withColumn("type", S.family(F.col("type"), S.SYNONYMS))
    assert sorted(tuple(r) for r in dedup.exact_duplicates(same).collect()) == [("rel2", "rel1"), ("rel3", "rel1")]


def test_star_graph(spark):
    nodes = spark.createDataFrame([(f"ent_{i}",) for i in range(1, 5)], "id string")
    e = spark.createDataFrame([("ent_1", "ent_2", "A"), ("ent_1", "ent_3", "A"), ("ent_4", "ent_1", "B")], "src string, dst string, type string")
    assert {r.id: r.degree for r in graph.degrees(nodes, e).collect()} == {"ent_1": 3, "ent_2": 1, "ent_3": 1, "ent_4": 1}
    assert graph.density(nodes, e).first().density == 0.5
    start = nodes.where("id = 'ent_2'")
    assert {r.node: r.distance for r in graph.neighbours(e, start, 2).collect()} == {"ent_1": 1, "ent_3": 2, "ent_4": 2}
    assert {r.component for r in graph.components(e).collect()} == {"ent_1"} and graph.components(e).count() == 4
    assert {r.id: round(r.betweenness, 6) for r in graph.betweenness(e, nodes).collect()} == {"ent_1": 1.0, "ent_2": 0.0, "ent_3": 0.0, "ent_4": 0.0}
    assert {r.id: round(r.closeness, 6) for r in graph.closeness(e, nodes).collect()} == {"ent_1": 1.0, "ent_2": 0.6, "ent_3": 0.6, "ent_4": 0.6}


def test_components_of_a_long_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 100], "src long, dst long")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {i: 0 if i <= 100 else 101 for i in range(n + 1)}


def test_decay_and_packing(spark):
    got = values(spark, "d int", [(0,), (1,), (3,), (5,)], F.round(ranking.decayed(F.lit(0.9), F.col("d")), 6))
    assert [x for (x,) in got] == [0.9, 0.72, 0.36, 0.0]
    words = [f"w{i}" * (i % 5 + 1) for i in range(40)]
    (made,) = values(spark, "p array<string>", [(words,)], chunking.packed(F.col("p"), 20, " "))[0]
    assert " ".join(made) == " ".join(words) and all(len(x) <= 20 for x in made)
    assert all(len(a) + 1 + len(b.split(" ")[0]) > 20 for a, b in itertools.pairwise(made))


def test_facts_with_issues(spark):
    rows = [("The system uses eight cores for the work.", "definition", 0.9), ("Some of it might work.", "definition", 0.9), ("Short", "opinion", 0.2), (" ", "causal", 0.9)]
    found, after = facts.issues(F.col("t"), F.col("k"), F.col("c"))
    got = values(spark, "t string, k string, c double", rows, F.array_join(found, ";"), F.round(after, 6), F.round(facts.quality(found, after, F.lit(1)), 6))
    assert got == [("", 0.9, 0.95), ("", 0.7, 0.75), ("brief: too short;confidence: below threshold;type: unknown", 0.2, 0.0), ("empty: no text;brief: too short", 0.9, 0.5)]


def test_a_real_stream(spark, tmp_path):
    """Events in three files, with repeats and one late event, through windows and removal of repeats."""
    schema = "event_id long, ts timestamp, event_type string, value double"
    days = [[(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0)], [(3, "2024-01-01 05:00:00", "b", 3.0)], [(4, "2024-01-01 01:00:00", "a", 9.0), (5, "2024-01-01 09:00:00", "b", 4.0)]]
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = events.windowed_counts(events.unique_events(events.event_stream(spark, f"{tmp_path}/in", schema)), late=None)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.event_type, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # The late event is dropped, the repeat counts once, and the last window is still open.
    assert got == [("a", 2, 3.0), ("b", 1, 3.0)]
