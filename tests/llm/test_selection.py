"""Resampling, spelling variants and exact duplicates against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import exact, resample, spelling

SCHEMA = "doc_id long, text string, id string, n long, `a.b` string"


def corpus(seed, n=160):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéÀß") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["Straße", "naïve", "x1y2", "漢字", "×÷"]
    pool += [w[:k] + c + w[k + 1 :] for w in pool[:40] for k in range(len(w)) for c in "az" if r.random() < 0.3]
    texts = [r.choice(["", " "]) + r.choice([" ", "\n", ", ", " \t", "-"]).join(r.choices(pool, k=r.randint(0, 60))) for _ in range(n)]
    texts += [t.upper() for t in texts[:5]] + [t.replace(" ", "  ") for t in texts[:30]] + [None, "", " \t\n", None, texts[3], texts[3], " ", "q" * 90_000, "é" + "w" * 70 + " b" * 25]
    rows = [(k if r.random() < 0.9 else None, t, "x", 1, None) for k, t in enumerate(texts)]
    return rows + rows[:4] + [(7, texts[9], "x", 1, None)] + [(None, "same text of some words " * 5, "y", 2, None)] * 12


def brute_resample(rows, target, percent=25, least=20, seed=7):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    found = [features(r[1]) for r in rows]
    s, t = Counter(x for _, f in found for x in f), Counter(x for text in target for x in features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000))))
    out = []
    for r, (n, f) in zip(rows, found):
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append((r[0], n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted(((-x[4], x[0] is None, x[0] or 0) for x in out if x[1] >= least))
    return out, able[: percent * len(able) // 100]


def test_resample(spark):
    rows, target = corpus(1), ["abc é " * 9, None, "漢字 x1y2 b b b"]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, bench).collect()
    want, drawn = brute_resample(rows, target)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(((x[0], *x[2:]) for x in want), key=key)
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn and drawn
    assert resample.resample(docs.filter("false"), bench).count() == 0
    assert all(r.rank is None for r in resample.resample(docs, bench.filter("false"), least_words=10**6).collect())
    assert {r.rank for r in resample.resample(docs, bench, percent=100, least_words=0).collect()} == set(range(1, len(rows) + 1))


@pytest.mark.parametrize("low, high", [(0, 5), (-3, 3), (-(2**63), 2**63 - 1), (2**40, 2**40 + 70_000), (5, 5)])
def test_kth_key(spark, low, high):
    r = random.Random(low)
    rows = [(r.randint(low, high), r.randint(-2, 2), k) for k in range(300)]
    df, parts = spark.createDataFrame(rows, "a long, b long, c long"), [F.col("a"), F.col("b"), F.col("c")]
    for k in (1, 150, 300):
        key = resample.kth_key(df, parts, k)
        assert tuple(key) == sorted(rows)[k - 1]
        assert df.filter(resample.up_to(parts, key)).count() == k


def test_crc_runs():
    raw = bytes(random.Random(5).randbytes(3000))
    begin = np.array([0, 10, 10, 500, 2000, 7])
    end = np.array([3, 10, 74, 565, 3000, 8])
    before = np.array([0, 5, 2**32 - 1, 77, 1, 9], np.uint32)
    assert resample.crc_runs(raw, begin, end, before).tolist() == [zlib.crc32(raw[a:b], int(c)) for a, b, c in zip(begin, end, before)]


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, deletes=97):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % deletes else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}
    out = set()
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, c, len(near[w]), words.get(form.get(w))))
    return out


@pytest.mark.parametrize("seed, deletes", [(2, 97), (3, 4)])
def test_variants(spark, seed, deletes):
    rows = corpus(seed) + [(k, "aaaaaa aaaaa aaaaab aaaba aabaa bbaaa aaaaaaa " * (k % 3), "", 0, "") for k in range(9)] + [(900 + k, "z" * 5000 + " " + "z" * (5000 + k % 2), "", 0, "") for k in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in spelling.variants(docs, deletes=deletes).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(rows, deletes)
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)
    assert spelling.variants(docs.filter("false")).count() == 0


def test_roots_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 3), (200, 201)], "id long, form long")
    assert {r.id: r.root for r in spelling.roots(chain).collect()} == {k: 40 for k in range(40)} | {100: 40, 200: 201}


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    return Counter(((x[3]), min(g)[3], len(g), hashlib.sha256(body.encode()).hexdigest()) for body, g in groups.items() for x in g), Counter(min(g)[3] for g in groups.values())


@pytest.mark.parametrize("table_bytes, hashes", [(32 << 20, None), (300, None), (300, 3), (5000, 1)])
def test_exact(spark, table_bytes, hashes):
    rows = corpus(4)
    deal = exact.digest if hashes is None else lambda c, level: F.pmod(F.xxhash64(F.lit(level), c), F.lit(hashes + level))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact.exact_duplicates(docs, table_bytes, deal).collect()
    want, kept = brute_exact(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.doc_id for r in got if r.kept) == kept
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact.exact_duplicates(docs.filter("false"), table_bytes, deal).count() == 0


def test_table_compares_contents():
    t = exact.Table(4)
    assert [t.put(h % 3, b"%d" % (h % 7), h) for h in range(21)] == [t.put(h % 3, b"%d" % (h % 7), 99) for h in range(21)]


def test_rows_of_one_id_have_their_own_classes(spark):
    from harvestry.llm import dedup

    words = lambda seed: " ".join(random.Random(seed).choices([f"w{k}" for k in range(400)], k=120))
    b, c = words(1), words(2)
    kept = lambda rows: sorted((r.doc_id or -1, r.text) for r in dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, `__id` string")).collect())
    assert kept([(3, c, "x"), (7, b, "x"), (7, c + " y", "x")]) == sorted([(3, c), (7, b)])
    assert kept([(7, b, "x"), (7, b, "x"), (8, b + " y", None), (None, b, None), (None, b, None)]) == sorted([(7, b), (-1, b), (-1, b)])
