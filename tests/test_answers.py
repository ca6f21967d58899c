"""Brute force for operators that SQL does not express."""

import difflib
import itertools
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from knowmill import catalog
from knowmill.functions import similarity as S
from knowmill.operators import chunking, citations, discovery, fact_scores, names, reasoning, resolve
from knowmill.operators import html as H
from knowmill.operators.containment import holding
from knowmill.sources import store


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.8
    return max(jaccard(set(a.split()), set(b.split())), 1 - edits(a, b) / max(len(a), len(b)))


def random_names(n, seed):
    rng = random.Random(seed)
    words = ["art", "heart", "heartland", "land", "systems", "system", "tin", "tins", "co-op", "coop", "alpha", "alpah", "beta", "gamma ray", "ray"]
    out = []
    for _ in range(n):
        name = " ".join(rng.choices(words, k=rng.randint(1, 3)))
        if rng.random() < 0.5:
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice(["", "x", name[k] * 2]) + name[k + 1 :]
        out.append(name)
    return out


def test_no_pair_of_entities_is_lost(spark):
    rng = random.Random(3)
    kinds = ["PERSON", "HUMAN", "CITY", "REGION", "THING", "OTHER THING", "", None]
    rows = [(i, x, rng.choice(kinds), rng.choice(["d1", "d2", "d3", None])) for i, x in enumerate(random_names(160, 5))]
    rows += [(900, "art", "PERSON", "d1"), (901, "heartland supersystems", "PERSON", "d2")]

    def kind(a, b):
        if not a or not b:
            return 0.5
        fam = lambda x: next((f for f in S.TYPE_FAMILIES if x in f), x)
        return 1.0 if a == b else 0.8 if fam(a) == fam(b) else 0.0

    low = lambda x: x.lower().strip()
    want = {}
    for (i, n, k, d), (j, m, q, e) in itertools.combinations(rows, 2):
        score = 0.6 * alike(low(n), low(m)) + 0.3 * kind(k, q) + 0.1 * (1.0 if d is not None and d == e else 0.3)
        if score >= 0.7 - 1e-9:
            want[i, j] = round(score, 6)
    df = spark.createDataFrame(rows, "ord long, name string, type string, doc string")
    got = {(r.a, r.b): round(r.score, 6) for r in resolve.candidates(df).collect()}
    assert got == want and (900, 901) in want


def test_few_pairs_meet(spark):
    rows = [(i, f"T{i % 6}", f"{a} {b} {c}") for i, (a, b, c) in enumerate(itertools.islice(itertools.product([f"w{k}a" for k in range(9)], [f"q{k}b" for k in range(9)], [f"z{k}{k}c" for k in range(9)]), 700))]
    df = spark.createDataFrame(rows, "id long, block string, name string").withColumn("least", F.lit(0.717))
    n = [x for *_, x in rows]
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][1] == rows[j][1] and alike(n[i], n[j]) >= 0.717}
    got = {(r.a, r.b) for r in names.like(df).collect()}
    assert want <= got


def test_keyword_variants_meet(spark):
    words = ["tin", "tins", "co-op", "co op", "coop", "3 lions", "drei lions", "red tin", "blue", "bluebell", ""]
    df = spark.createDataFrame([(i, w, "KEYWORD", "d") for i, w in enumerate(words)], "ord long, name string, type string, doc string")
    got = {(words[r.a], words[r.b]): r.keyword_score for r in resolve.keyword_candidates(df).collect()}
    assert {p: got.get(p) for p in [("tin", "tins"), ("co-op", "co op"), ("3 lions", "drei lions"), ("blue", "bluebell"), ("tin", "red tin")]} == {
        ("tin", "tins"): 0.9, ("co-op", "co op"): 0.9, ("3 lions", "drei lions"): 0.9, ("blue", "bluebell"): 0.8, ("tin", "red tin"): 0.8,
    }
    assert ("tin", "blue") not in got


def test_greedy_by_components_and_rounds(spark):
    rng = random.Random(1)
    pairs = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(90)}) + [(100 + i, 101 + i) for i in range(40)]
    primary = {}
    for x in sorted({x for p in pairs for x in p} | {500}):
        near = [a for a, b in pairs if b == x and primary[a] == a]
        primary[x] = min(near, default=x)
    ents = spark.createDataFrame([(x,) for x in primary], "ord long")
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.ord: r.primary for r in resolve.greedy(ents, df).collect()} == primary
    few = spark.createDataFrame([p for p in pairs if p[1] < 30], "a long, b long")
    some = {x for p in pairs if p[1] < 30 for x in p}
    assert {r.ord: r.primary for r in resolve._by_rounds(few).collect()} == {k: v for k, v in primary.items() if k in some}


@pytest.mark.parametrize("part_names", [3, 200_000])
def test_names_in_texts_by_parts(spark, part_names):
    texts = [(1, "Heartland is here"), (2, "nothing"), (3, None), (4, ""), (5, "ART art tin\nTINS")]
    dictionary = [(10, "art"), (11, "Heart"), (12, "tins"), (13, ""), (14, "ART"), (15, "no"), (16, "thing"), (17, "xyz"), (18, "i")]
    got = {tuple(r) for r in holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(dictionary, "name_id long, name string"), part_names).collect()}
    assert got == {(i, k) for i, t in texts for k, n in dictionary if t and n and n.lower() in t.lower()}
    assert holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "name_id long, name string")).count() == 0


def test_matching_blocks_like_difflib(spark):
    rng = random.Random(2)
    words = random_names(150, 9)
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(10_000)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", discovery.matching_blocks("a", "b").alias("r"), discovery.bag_bound(F.col("a"), F.col("b")).alias("most")).collect()
    assert all(abs(r.r - difflib.SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12 and r.r <= r.most + 1e-12 for r in rows)
    n = [(i, "b", w) for i, w in enumerate(words)]
    got = {(r.a, r.b) for r in discovery.alike(spark.createDataFrame(n, "id long, block string, name string"), 0.8).collect()}
    assert got == {(i, j) for (i, _, x), (j, _, y) in itertools.combinations(n, 2) if difflib.SequenceMatcher(None, x, y).ratio() >= 0.8}


def test_pieces_of_the_descent_hold_the_text(spark):
    long = "word " * 300
    texts = ["# T\nintro\n## A\npara one. Two! Three?\n\npara " + long + "\n## B\nshort", "", None, "x" * 900, "a. b. C d", long.strip()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.chunks(df, chunking.descended(F.col("text"), 200)).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for i, t in enumerate(texts):
        assert re.sub(r"[ \t\n]+", " ", " ".join(got.get(i, []))) == re.sub(r"[ \t\n]+", " ", (t or "").strip())
        assert all(len(p) <= 200 or " " not in p for p in got.get(i, []))
    assert got[0][:2] == ["# T\nintro", "## A\npara one. Two! Three?"]


class Tree(HTMLParser):
    """Main text by an explicit stack of open elements for each name."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.items, self.open = [], {}

    def handle_starttag(self, tag, attrs):
        if tag in H.VOID:
            return
        a = dict(attrs)
        if tag in H.FLAT and self.open.get(tag):
            self.items[self.open[tag].pop()]["stop"] = len(self.items)
        self.open.setdefault(tag, []).append(len(self.items))
        self.items.append({"tag": tag, "classes": (a.get("class") or "").split(), "id": a.get("id") or "", "role": a.get("role") or "", "stop": None})

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self.items[self.open[tag].pop()]["stop"] = len(self.items)
        self.items.append({"tag": None})

    def handle_data(self, data):
        self.items.append({"tag": None, "text": data})

    def main(self):
        items = self.items
        noise = lambda e: e["tag"] in H.NOISE_TAGS or set(e["classes"]) & set(H.NOISE_CLASSES) or e["id"] in H.NOISE_IDS
        gone = set()
        for i, e in enumerate(items):
            if e["tag"] and noise(e):
                gone |= set(range(i, e["stop"] if e["stop"] is not None else len(items)))
        alive = [(i, e) for i, e in enumerate(items) if e["tag"] and i not in gone]
        text = lambda i, e: [items[k]["text"] for k in range(i + 1, e["stop"] if e["stop"] is not None else len(items)) if "text" in items[k] and k not in gone]

        def fits(s, e):
            return e["role"] == "main" if s[0] == "[" else s[1:] in e["classes"] if s[0] == "." else e["id"] == s[1:] if s[0] == "#" else e["tag"] == s

        for s in H.MAIN:
            for i, e in alive:
                if fits(s, e):
                    return s, text(i, e)
        blocks = [(i, e) for i, e in alive if e["tag"] in H.BLOCKS]
        if blocks:
            i, e = max(blocks, key=lambda x: (sum(map(len, text(*x))), -x[0]))
            return "largest block", text(i, e)
        body = [(i, e) for i, e in alive if e["tag"] == "body"]
        return ("body", text(*body[0])) if body else ("page", [e["text"] for k, e in enumerate(items) if "text" in e and k not in gone])


PAGES = [
    "<body><div class='sidebar'><div>menu</div>more</div><div>one<div>two <b>three</b></div></div><div>x</div></body>",
    "<body><article class='ad'>bad</article><div id='content'><div>in</div><p>p1<p>p2</div><footer>f</footer></body>",
    "<div><div class='x content wide'>a<div>b</div>c</div>tail</div>",
    "<main>m1<nav><ul><li>n</ul></nav>m2</main><main>second</main>",
    "</div></div><div>a</div><section>bb<div>c</div></section>",
    "<body><p class=ad>gone<p>stays<ul><li class='share'>s<li>kept</ul></body>",
    "just text <b>bold</b>", "", "<div role=main>r<!-- <main>no</main> --></div><script>var a='<main>x</main>';</script>",
    "<body><div>never closed <span class='widget'>w</span> end",
]


def test_main_text_like_a_stack(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)) + [(99, None)], "page_id long, html string")
    got = {r.page_id: (r.part, r.content) for r in H.main_text(df).collect()}
    for i, page in enumerate(PAGES):
        t = Tree()
        t.feed(re.sub(r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", "", page))
        t.close()
        part, texts = t.main()
        assert got[i] == (part, re.sub(r"\s+", " ", " ".join(texts)).strip()), page
    assert got[99] == ("page", "")


def test_paths_by_all_strategies(spark):
    rng = random.Random(4)
    edges = [(a, b, float(rng.randint(1, 30))) for a, b in sorted({tuple(rng.sample(range(9), 2)) for _ in range(16)})]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {}).setdefault(b, 0.0)
        near.setdefault(b, {}).setdefault(a, 0.0)
        near[a][b] += w
        near[b][a] += w

    def walk(path, weight, depth):
        if len(path) > 1 and path[-1] == 7:
            yield path, weight
            return
        if len(path) <= depth:
            for x, w in near.get(path[-1], {}).items():
                if x not in path:
                    yield from walk([*path, x], weight + w, depth)

    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    pairs = spark.createDataFrame([(0, 7)], "source long, target long")
    for strategy, depth in reasoning.DEPTH.items():
        want = {(tuple(p), round(max(0, ((10 - len(p)) + min(w, 10)) / 2 + min(w / 10, 2) - 0.5 * max(0, len(p) - depth)), 6)) for p, w in walk([0], 0.0, depth)}
        got = {(tuple(r.path), round(r.relevance, 6)) for r in reasoning.reasoning_paths(e, pairs, strategy, most=100_000).collect()}
        assert got == want, strategy


def test_contexts_until_they_suffice(spark):
    rng = random.Random(8)
    words = [f"word{chr(97 + i)}{chr(97 + i)}" for i in range(20)]
    questions = [(i, " ".join(rng.sample(words, 6))) for i in range(8)] + [(20, None), (21, "unknownword"), (22, "the of")]
    docs = [(i, " ".join(rng.sample(words, rng.randint(1, 3)))) for i in range(25)] + [(90, None)]
    want = {}
    for q, text in questions:
        keys = set(text.split()) - {"the", "of"} if text else set()
        if not keys:
            continue
        held, used, rounds = set(), 0, 0
        for k in range(1, 4):
            if k > 1 and len(held) >= 0.8 * len(keys):
                break
            fills = sorted((-len(set((t or "").split()) & (keys - held)), d) for d, t in docs)
            new = [d for n, d in fills[:2] if n < 0]
            if not new:
                break
            held |= keys & {w for d, t in docs if d in new for w in t.split()}
            used, rounds = used + len(new), k
        want[q] = (rounds, used, round(len(held) / len(keys), 6))
    got = reasoning.refine(spark.createDataFrame(questions, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 0.8, 2, 3).collect()
    assert {r.query_id: (r.rounds, r.n_documents, round(r.covered, 6)) for r in got} == want


def test_citations_like_a_plain_loop(spark):
    answers = [(1, "Rivers carry sand. Sand carries rivers! The riverside sands rivers, and sand. No"), (2, ""), (3, "nothing here"), (4, "gold gold gold gold gold gold. gold?")]
    facts = [(1, 5, "rivers sand", 0.5, "[a]"), (1, 2, "riverside of sand", 0.9, "[b]"), (1, 9, "the and", 0.9, "[c]"), (4, 1, "gold", 0.7, None), (3, 1, "absent", 0.4, "[d]")]
    df = spark.createDataFrame(answers, "answer_id long, content string")
    spans = citations.citation_spans(df, spark.createDataFrame(facts, "answer_id long, fact_id long, text string, score double, source string"))
    out = spans.select("answer_id", "spans", *[citations.render(F.col("content"), F.col("spans"), s).alias(s) for s in citations.STYLES], citations.verification(F.col("spans")).alias("status")).collect()
    got = {r.answer_id: r for r in out}
    for a, content in answers:
        all_ = {}
        for i, f, text, score, source in sorted(facts, key=lambda x: x[1]):
            if i != a:
                continue
            for w in {w for w in re.findall(r"\w+", text.lower()) if len(w) > 2 and w not in citations.STOP}:
                for m in re.finditer(w, content.lower()):
                    all_.setdefault(m.span(), (f, score, source))
        taken = []
        for (s, e), v in sorted(all_.items(), key=lambda x: (x[0][0], -x[0][1])):
            if not taken or taken[-1][1] <= s:
                taken.append((s, e, *v))
        by = {}
        for x in taken:
            by.setdefault(len(re.findall(r"[.!?]+", content[: x[0]])), []).append(x)
        kept = sorted(y for x in by.values() for y in sorted(x, key=lambda z: (-z[3], z[0]))[:3])
        r = got[a]
        assert [(x.start, x.stop, x.fact_id, x.score, x.source) for x in r.spans] == kept
        foot, sup = content, content
        for n, x in reversed(list(enumerate(kept, 1))):
            foot, sup = foot[: x[1]] + f"[{n}]" + foot[x[1] :], sup[: x[1]] + f"^{n}" + sup[x[1] :]
        assert r.superscript == sup
        if all(x[4] for x in kept):
            notes = "\n".join(f"{n}. {x[4]}" for n, x in enumerate(kept, 1))
            assert r.footnote == foot + (f"\n\n## Footnotes\n{notes}" if kept else "")
            assert r.endnote == foot + (f"\n\n## References\n{notes}" if kept else "")
        assert r.status == ("no_citations" if not kept else "verified" if all(x[4] for x in kept) else "unverified")


def test_batches_are_seen_whole_or_not_at_all(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    good = {"documents": one([("d1",)], "id string"), "chunks": one([("c1", "d1"), ("c2", None)], "id string, document_id string"), "facts": one([("f1", "c1")], "id string, chunk_id string")}
    assert store.publish(spark, at, "b1", good) == [] == store.publish(spark, at, "b1", good)
    assert store.published(spark, at) == ["b1"] and store.stored(spark, at, "chunks").count() == 2
    bad = {"chunks": one([("c3", "d1"), ("c4", "d9")], "id string, document_id string"), "facts": one([("f2", "c3"), ("f3", "c7")], "id string, chunk_id string")}
    wrong = store.publish(spark, at, "b2", bad)
    assert len(wrong) == 2 and "d9" in wrong[0] and "c7" in wrong[1]
    assert store.published(spark, at) == ["b1"] and store.stored(spark, at, "facts").count() == 1
    more = {"chunks": one([("c3", "d1", 7)], "id string, document_id string, size int"), "facts": one([("f2", "c1")], "id string, chunk_id string")}
    assert store.publish(spark, at, "b2", more) == []
    assert store.stored(spark, at, "chunks").columns == ["id", "document_id", "size"] and store.stored(spark, at, "facts").count() == 2




def test_fact_scores_of_the_worked_example(spark):
    schema = "fact_id string, content string, kind string, confidence double, n_documents int, n_entities int, has_context boolean, has_metadata boolean, has_path boolean, path_length int, method string"
    rows = [
        ("fact_001", "Einstein developed the theory of relativity", "DIRECT", 0.9, 1, 2, True, True, True, None, "direct_triplet"),
        ("fact_002", "Princeton University is located in New Jersey", "DIRECT", 0.8, 1, 2, True, True, True, None, "direct_triplet"),
        ("fact_003", "Einstein worked at Princeton University and developed relativity theory there", "CHAIN", 0.7, 2, 3, True, True, True, None, "relationship_chain"),
    ]
    none = {c: F.lit(None).cast(t) for c, t in (("source_type", "string"), ("target_type", "string"), ("semantic_context", "boolean"), ("temporal_context", "boolean"), ("age", "long"))}
    got = fact_scores.score(spark.createDataFrame(rows, schema).withColumns(none), F.lit("What did Einstein develop")).orderBy("fact_id").collect()
    want = [(0.25, 0.9, 1.0, 0.5, 1.0, 0.75, 0.65), (0.0, 0.9, 0.9, 0.7, 1.0, 0.875, 0.5325), (0.25, 0.85, 0.71, 0.5, 1.0, 1.0, 0.558)]
    assert [tuple(round(r[c], 6) for c in (*fact_scores.DIMENSIONS, "score")) for r in got] == want
    assert got[0].reason == "Scored based on: High confidence (1.00), High source quality (0.90). Fact type: direct."


def test_copies_of_names_are_one_class(spark, tmp_path):
    words = random_names(40, 11) + ["wikimedia", "wikimania", "Wikimania"]
    rows = [(i, f"B{i % 2}", words[i * 7 % len(words)]) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = catalog.QUERIES["alike_names"](spark, str(tmp_path)).collect()
    of = {(f"B{i % 2}", i): i for i, _, _ in rows} | {(rows[r.b][1], r.b): r.a for r in out if r.kind == "copy"}
    met = {(rows[r.a][1], r.a, r.b): r.ratio for r in out if r.kind == "alike"}
    want = {}
    for (a, block, x), (b, other, y) in itertools.combinations(rows, 2):
        ratio = difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio()
        if block == other and ratio >= 0.8:
            want[a, b] = ratio
    got = {(a, b): 1.0 if of[block, a] == of[block, b] else met.get((block, of[block, a], of[block, b])) for (a, block, _), (b, other, _) in itertools.combinations(rows, 2) if block == other}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)
    # A row for each copy and one or two for each pair of names, not one for each pair of copies.
    names = len({(block, x.lower()) for _, block, x in rows})
    assert sum(r.kind == "copy" for r in out) == len(rows) - names and len(met) <= names * (names - 1)
    pairs = {(r.a, r.b): r.ratio for r in discovery.alike(spark.createDataFrame(rows, "id long, block string, name string"), 0.8).collect()}
    assert pairs == pytest.approx(want)
