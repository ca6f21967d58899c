"""Conversation repair, spelling variants and shared lines against brute force."""

import collections
import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from knowmill.llm import conversations, lines, spelling

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
STEP = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def best_edits(rows):
    """All edit strings, by recursion: the cheapest and then the least."""
    seen, kinds = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        kinds.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "o")
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, s, inserts):
        found = [(0, "")] if i == len(rows) and s in "03" else []
        for r in "ua":
            if (s, r) in STEP and inserts < 4:
                c, x = best(i, STEP[s, r], inserts + 1)
                found.append((c + 2, "I" + x))
        if i < len(rows):
            c, x = best(i + 1, s, 0)
            found.append((c + 3, "D" + x))
            if kinds[i] in "ot":
                stays = int(kinds[i] == "t")
                if (s, rows[i][0][:1]) in STEP:
                    c, x = best(i + 1, STEP[s, rows[i][0][:1]], 0)
                    found.append((c + stays, "K" + x))
                for r in "ua":
                    if (s, r) in STEP:
                        c, x = best(i + 1, STEP[s, r], 0)
                        found.append((c + 2 + stays, "R" + x))
        return min(found, default=(10**9, ""))

    cost, audit = best(0, "0", 0)
    out, s, i = [], "0", 0
    for e in audit:
        r = "a" if s == "2" else "u"
        full = {"u": "user", "a": "assistant"}[r]
        if e == "I":
            out.append(full + ":")
            s = STEP[s, r]
            continue
        role, text = rows[i]
        i += 1
        if e != "D":
            out.append(f"{role if e == 'K' else full}:{text}")
            s = STEP[s, role[0] if e == "K" else r]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def repaired(table):
    groups = collections.defaultdict(list)
    said = lambda v: " " if v is None else str(v)
    for c, t, r, x in table:
        fault = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        r, x = said(r), said(x)
        groups[c] += [] if fault == 0 else [(t, "user" if fault == 4 else r, "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x)] * (2 if fault == 3 else 1)
    out = {}
    for c, rows in groups.items():
        rows.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        turns = [t for t, *_ in rows if t is not None]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *best_edits([z[1:] for z in rows]))
    return out


def test_conversations(spark, tmp_path):
    sys.setrecursionlimit(20_000)
    rng = random.Random(5)
    rows = []
    for c in [*range(30), None]:
        for i in range(rng.choice([1, 2, 3, 5, 40, 90, 200])):
            rows.append((c, rng.choice([i, i, i, None, i + 5]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b", "c!", " ", None, f"x{i}.", f"y{i}"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.select("*", F.lit(1).alias("at"), F.lit("z").alias("conv")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r)[0]: tuple(r)[1:] for r in conversations.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == repaired(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert conversations.op11_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_one_block_or_many(spark):
    """Where checkpoints lie makes no difference."""
    rng = random.Random(6)
    rows = [(c, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"x{i}.", ""])) for c in range(5) for i in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = sorted(map(tuple, conversations.repair(df).collect()))
    codes = "".join(rng.choice("ABCDEFGHIJKL") for _ in range(300))
    whole = conversations.walk(codes, conversations.END, True)[0]
    after, pieces = conversations.END, []
    for k in reversed(range(0, 300, 7)):
        pieces.append((codes[k : k + 7], after))
        after = conversations.across(conversations.block_costs(codes[k : k + 7]), after)
    s, edits = 0, ""
    for k, (part, end) in enumerate(reversed(pieces)):
        s, more = conversations.walk(part, end, k == len(pieces) - 1)[s]
        edits += more
    assert (s, edits) == whole
    assert [(r[-1], r[7]) for r in one] == [best_edits(sorted([(x[2], x[3]) for x in rows if x[0] == c], key=lambda z: 0))[::-1][:2] for c in range(5)]


def spelled(docs, slip=199):
    n = collections.Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = lower(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r if not slip or h % slip else r[: h % len(r)] + r[h % len(r) + 1 :]] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = collections.defaultdict(set)
    for a, b in itertools.combinations(words, 2):
        x, y = sorted((a, b), key=len)
        same = len(x) == len(y) and sum(p != q for p, q in zip(x, y, strict=True)) == 1
        if same or (len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, k in words.items():
        first = min(near[w], key=lambda x: (-words[x], x), default=None)
        if first and words[first] >= 5 * k:
            form[w] = first

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), k, len(near[w]), words[form[w]] if w in form else None) for w, k in words.items())


@pytest.mark.parametrize("large", [2, 32])
def test_spelling(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(spelling, "LARGE", large)
    rng = random.Random(7)
    base = ["winter", "witner", "aaaaaa", "aaaaaaa", "aaaaaaaa", "straße", "überall", "Éclairs", "éclairs", "sommer", "sommers", "sommer×"]
    weights = {w: 5 ** rng.randint(1, 4) for w in base}
    words = [w for w, k in weights.items() for _ in range(k)]
    for w in base[:8]:
        for _ in range(6):
            k = rng.randrange(len(w))
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :]])] * rng.randint(4, 30)
    rng.shuffle(words)
    docs = [(i, " ".join(words[k : k + 50])) for i, k in enumerate(range(0, len(words), 50))] + [(None, "Winter, WINTER winter"), (900, None), (901, ""), (0, "winter 6 x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = spelling.op12_spelling_variants(spark, str(tmp_path))
    assert sorted(map(tuple, out.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0]) == spelled(docs)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert spelling.op12_spelling_variants(spark, f"{tmp_path}/none").count() == 0


def deduplicated(docs):
    key = lambda x: lower(x.strip(SPACE))
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    last = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        gone = [last.get(key(x), i) != i for x in all_]
        runs = [len(list(g)) for _, g in itertools.groupby([False, *gone, False])]
        runs[0] -= 1
        runs[-1] -= 1
        out.append((i, len(all_), sum(gone), runs, "\n".join(x for x, g in zip(all_, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_shared_lines(spark, tmp_path):
    rng = random.Random(9)
    long = [f"{c * 3} " * 12 + c for c in "abcdefÄß"]
    lines_ = [*long, *[x.upper() for x in long[:3]], *[f"\x0b {x}\t" for x in long[:4]], "short", "", "x" * 39, "y" * 40, "É" * 41, "é" * 41]
    docs = [(i, "\n".join(rng.choices(lines_, k=rng.randint(0, 9)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "y" * 40), (5, "y" * 40 + "\nother"), (5, "y" * 40), (102, "\n".join(["y" * 40] * 3000)), (103, "\n\n" + "y" * 40 + "\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_lines": F.lit(1), "mark": F.lit(2), "keep": F.lit(3)})
    got = sorted((tuple(r) for r in lines.dedup_lines(df).collect()), key=repr)
    want = deduplicated(docs)
    assert [(a, b, c, e) for a, b, c, d, e in got] == [(a, b, c, e) for a, b, c, d, e in want]
    assert [d for *_, d, _ in got] == [d if d else [0] for *_, d, _ in want]
    assert lines.dedup_lines(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    digest = {(r.doc_id, r.kept_sha256) for r in lines.op13_line_dedup(spark, str(tmp_path)).collect()}
    assert digest == {(a, hashlib.sha256(e.encode()).hexdigest()) for a, *_, e in want}


def test_frequent_lines_are_dealt_over_ranges(spark):
    """A line of most documents gives the same result by ranges as without."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("z" * 50 + "\n"), F.when(F.col("id") % 500 == 0, "w" * 45).otherwise(F.col("id").cast("string"))).alias("text"))
    assert lines._frequent(lines._long_lines(docs, 40)).where("ranges > 1").count() >= 1
    got = lines.keep_bitmaps(docs)
    assert got.count() == 2999 and got.where("doc = 2999").count() == 0
    assert got.where("n_dropped = 2").count() == 5
