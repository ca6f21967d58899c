"""Training-data operators against brute force on small fixtures with nulls, empty and odd texts, ties and extra columns."""

import collections
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowmill.llm import jaccard, licenses, lm, mixing, packing, pii, quality, topk, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 3
WORDS = [f"w{i}" for i in range(200)]
TEXTS = [
    None, "", "   \n\t ", "one", "One two three four", "one  two\nthree four", BASE, BASE, BASE + " extra", " ".join(WORDS), " ".join(WORDS[:195] + ["x"] * 5),
    " ".join(WORDS[:100] + ["y"] * 100), "Under the MIT license. Apache License, Version 2.0\ncc-by/nc", "CC BY-NC and under   the mit license", "naïve café x … y <|endoftext|> z",
    "line a\nline a\nline b", "mail joe@site.example.org call +1 (555) 123-4567 card 4111 1111 1111 1111 on 2020-02-29 from 10.0.0.1", "1234567812345678 2020-13-45",
    "\n".join(["# menu | home | about | contact | more | help"] * 5), " ".join(["long"] * 30_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s" if i % 3 else None, i * 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n double").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_quality(docs, none):
    got = rows(quality.measure(docs))
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines))), i
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert got[9].kept and not got[0].kept
    assert quality.measure(none).count() == 0
    full = docs.withColumn("n_chars", F.length("text").cast("long"))
    assert quality.stage_quality(None, full, "").columns == full.columns


def test_jaccard(docs, none):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = list(range(len(TEXTS)))
    for a in sets:
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                top = [min(top[a], top[b]) if x in (top[a], top[b]) else x for x in top]
    got = rows(jaccard.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), top[i]) for i, s in sets.items()}
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_large_group(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(160):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if top[a] != top[b] and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = [x if t == y else t for t in top]
    got = rows(jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].component_id for i in range(len(texts))] == top


def test_topk(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(0, 120)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4)]
    post = topk.to_postings(spark.createDataFrame(vecs, "vec_id long, embedding array<float>")).select("vec_id", "w")
    got = [tuple(r) for r in topk.top_k(post.where("vec_id % 50 = 0"), post, query_block=2, row_block=40).collect()]
    want = []
    for q, x in vecs[:120:50]:
        s = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(x, y)), i) for i, y in vecs[:120] if i != q)[:5]
        want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert sorted(got) == sorted(want)


def test_urls(spark, monkeypatch):
    page = lambda to: f'<link rel="canonical" href="{to}">'
    data = [(1, "http://a.example.com/en/x", None), (2, "http://other.org/1", page("http://a.example.com/en/x")), (3, "http://www.example.com/en/x", ""), (4, None, "x"), (5, "nothing", ""), (6, "HTTP://News.NET/es/1?q#f", ""), (7, "http://third.org/2", '<meta http-equiv="refresh" content="0;url=http://other.org/1">'), (8, "http://free.org/#top", page("http://x.com/"))]
    got = rows(urls.judge(spark.createDataFrame(data, "page_id long, url string, html string")), "page_id")
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow"}
    assert (got[6].host, got[6].path, got[6].rule, got[4].host, got[5].path) == ("news.net", "/es/1", "net/es/", "", "")


def test_packing(docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(TEXTS)}
    got = packing.pack(packing.cut_documents(docs)).collect()
    seen, used = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()} and sorted(used) == list(range(len(used)))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(packing.cut_documents(none)).count() == 0


def test_licenses(docs, none):
    word, phrases = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), licenses.BASE
    got = rows(licenses.detect(docs))
    for i, t in enumerate(TEXTS):
        w = word.findall(lower(t))
        at = sorted((k, x) for p, x in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None), i
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r.labels.split(","))
    assert len(licenses.rules()) > 200 and licenses.detect(none).count() == 0


def test_pii(docs, none):
    got = rows(pii.pseudonymise(docs))
    text = got[16].text
    for old in ("joe@site", "(555) 123-4567", "4111 1111 1111 1111", "2020-02-29", "10.0.0.1"):
        assert old not in text
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", text)[0].replace(" ", "")
    assert sum(d if k % 2 == 0 else d * 2 % 10 + d // 5 for k, d in enumerate(map(int, reversed(card)))) % 10 == 0
    assert got[16].n_pii == 5 and got[17].text == TEXTS[17] and got[0].text is None
    assert all(got[i].text == TEXTS[i] for i in range(16)) and pii.pseudonymise(none).count() == 0


def test_digits_are_permuted(spark):
    out = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x")).collect()
    assert len({r.x for r in out}) == 1000 and all(len(r.x) == 3 for r in out)


def test_mixing(docs, none):
    parts = mixing.whole_parts({"a": 0.5, "b": 0.3, "c": 0.2}, 100)
    plan = mixing.pfair(parts)
    assert sorted(s for _, _, s in plan) == list(range(100)) and collections.Counter(s for s, _, _ in plan) == parts and mixing.lag(parts) < Fraction(1)
    got = mixing.mix(docs, block=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(TEXTS))) and len({r.mix_position for r in got}) == len(TEXTS)
    assert mixing.mix(none).count() == 0


def test_toxicity(spark, docs, none):
    data = [(i, f"plain words {i} here" if i % 3 else f"you foul1sh grobnik {i}") for i in range(60)]
    d = spark.createDataFrame(data + [(100, "Gr0bnik!"), (101, None), (102, "clown fish")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = rows(toxicity.score(d, labels))
    assert got[100].score >= 0.3 > got[1].score and got[101].score < 0.3 and got[102].score < 0.3
    assert toxicity.score(none, labels).count() == 0


def test_lm(docs, none):
    seen = collections.Counter()
    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in enumerate(TEXTS)}
    for i, t in tokens.items():
        seen.update(t if i % 2 else [])
    n, v = sum(seen.values()), len(seen)
    got = rows(lm.score(docs.withColumn("train", F.col("doc_id") % 2 == 1)))
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(seen[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9) and r.score < 0
    assert lm.score(none.withColumn("train", F.lit(True))).count() == 0


@pytest.fixture(scope="module")
def odd(docs):
    """Rows with null and repeated ids, nulls in every column, and columns named like those that operators add."""
    more = docs.where("doc_id in (9, 10, 16)").withColumn("doc_id", F.lit(None).cast("long"))
    every = docs.union(more).union(docs.where("doc_id = 9")).union(docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    extra = ("n_words", "kept", "labels", "score", "n_pii", "component_id", "mix_slot", "verdict", "alias", "allow", "word", "rank", "block", "_aside", "_t", "_w", "_found", "_new", "_n", "_low", "_s", "_i", "_rank", "_own", "_url", "_id")
    return every.drop("n").withColumns({c: F.lit("x") for c in extra}).cache()


def test_odd_rows_in_operators(odd):
    n = odd.count()
    assert quality.measure(odd).count() == pii.pseudonymise(odd).count() == licenses.detect(odd).count() == n
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == n and {r.component_id for r in got if r.doc_id is None and r.n_shingles == 196} == {9}
    assert lm.score(odd.withColumn("train", F.col("doc_id") % 2 == 1)).count() == n
    assert toxicity.score(odd, odd.select("doc_id", F.lit(None).cast("int").alias("toxic"))).count() == n
    assert mixing.mix(odd, block=2).select("mix_position").distinct().count() == n
    assert packing.cut_documents(odd).where("start = 0").count() == n
    pieces = packing.pack(packing.cut_documents(odd))
    assert pieces.select("sequence_id", "offset").distinct().count() == packing.cut_documents(odd).count()
    pages = odd.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), "doc_id").alias("url"), F.col("text").alias("html"), "alias", "allow", "verdict", "block")
    assert urls.judge(pages).select("verdict", "alias", "allow", "block").where("allow = 'x' and block = 'x' and verdict = 'allow'").count() == n
    vectors = odd.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), "rank", "score")
    assert topk.to_postings(vectors).count() == odd.where("doc_id is not null").count()


def test_odd_rows_in_stages(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text"))
    for stage in (quality.stage_quality, jaccard.stage_near_duplicates, pii.stage_pii, mixing.stage_mixing):
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(r.kept == r.n_words == r.n_pii == "x" for r in rows)
        assert stage(spark, docs.limit(0), "").count() == 0
    assert mixing.stage_mixing(spark, docs, "").count() == pii.stage_pii(spark, docs, "").count() == docs.count()
    assert packing.stage_packing(spark, docs, "").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
