"""Models, codes and searches against brute force on small data."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import dedup, html_extract, lang_id, rans, tokens, topk, toxicity
from harvestry.llm.textnum import words

EN, DE, FR = "the of and with from this that".split(), "der die und mit von ist nicht".split(), "le la et avec pour que dans".split()


def say(pool, n, r):
    return " ".join(r.choice(pool) for _ in range(n))


def test_rans_round_trip_and_damage():
    r = np.random.default_rng(0)
    ids = (r.zipf(1.3, 30_000) % 500).astype(np.uint16)
    t = rans.Table(np.bincount(ids, minlength=500))
    for n in (0, 1, 63, 64, 65, 30_000):
        block = rans.encode(ids[:n], t, lanes=64, every=16)
        assert (rans.decode(block, t) == ids[:n]).all()
    assert (rans.decode(block, t, 3) == ids[3 * 16 * 64 :]).all()
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(block[:100] + bytes([block[100] ^ 1]) + block[101:], t)
    with pytest.raises(ValueError, match="table"):
        rans.decode(block, rans.Table(np.ones(500)))


def test_tokens_read_back(spark):
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    rows = [(3, "Don't stop, it's 2024!"), (1, None), (2, ""), (7, "Ωσς x²½ <|endoftext|> a_b ... ,. 日本語"), (5, "naïve café. " * 3000), (5, "again")]
    files, table = tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, 1, block_tokens=64)
    got = sorted(tokens.digests(files, table).collect(), key=lambda r: r.start)
    at, want = 0, {}
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.setdefault(d, set()).add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    empty, table = tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), vocabulary)
    assert tokens.digests(empty, table).count() == 0


def test_top_k_is_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.2, 8).astype(float).tolist()) for i in range(700)] + [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, []), (704, [1e18] * 8), (705, [-1e18] * 8), (0, [0.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, cells=3).collect()
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and None not in v and not any(np.isnan(v))]
    for q, v in good:
        if q % 50 or q == 0:
            continue
        want = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), i) for i, w in good if i != q)[:5]
        assert [(-x.score, x.vec_id) for x in sorted(got, key=lambda x: x.rank) if x.query_id == q] == want


def test_blocks_are_pruned():
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(0, 5, (64, 8)) for _ in range(20)] + [r.integers(200, 205, (64, 8))])
    index = topk.Index(np.arange(len(x)), x)
    best = {}
    assert topk.search_chunk(np.array([-1]), np.ones((1, 8), np.int64), index, best, 5) < 10
    assert [i for _, i in best[-1]] == [i for _, i in sorted((-int(s), i) for i, s in enumerate(x.sum(1)))[:5]]


def test_dedup_against_brute_force(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(5000)}" for _ in range(120)] for _ in range(30)]
    texts = []
    for b in base:
        texts += [" ".join(b), " ".join(b).upper()]
        for _ in range(3):
            c = list(b)
            c[r.randrange(120)] = "new"
            texts.append(" ".join(c))
    texts += ["", None, "!!", "short one", "short one", "a b c d e f"]
    rows = list(enumerate(texts))
    got = {x.doc_id: x.class_id for x in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for k in range(30):
        assert {got[5 * k + j] for j in range(5)} == {5 * k}
    assert [got[150 + j] for j in range(6)] == [150, 150, 150, 153, 153, 155]
    kept = dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() == 33 and kept.columns == ["doc_id", "text"]
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dedup_of_a_passage_in_many_texts(spark):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(124)]
    texts = []
    for _ in range(550):
        tail = [word() for _ in range(8)]
        texts += [" ".join(passage + tail + [word() for _ in range(12)]) for _ in range(2)]
    s, d, _, _ = dedup.weighted(texts)
    names, at = np.unique(s, return_inverse=True)
    m = np.zeros((len(texts), len(names)), np.float32)
    m[d, at] = 1
    m = m[:, m.sum(0) > 1]
    both, n = m @ m.T, np.bincount(d)
    alike = both / (n[:, None] + n - both) >= 0.8
    assert alike.sum() == 2 * len(texts)  # each with itself and one other
    got = {x.doc_id: x.class_id for x in dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: int(np.flatnonzero(alike[i])[0]) for i in range(len(texts))}


def test_dedup_of_repeats(spark):
    texts = []
    for k in range(12):
        base, line = [f"w{k}x{i}" for i in range(120)], [f"line{k}x{i}" for i in range(10)]
        texts += [" ".join(base + line), " ".join(base + line * 31)]
    texts += ["la " * 6, "la " * 7, "so " * 9]
    got = {x.doc_id: x.class_id for x in dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(27)}


def test_signatures_estimate_probability_jaccard():
    r = random.Random(5)
    a = [f"w{r.randrange(300)}" for _ in range(400)]
    b = a[:330] + [f"v{r.randrange(300)}" for _ in range(70)]
    s, d, w, _ = dedup.weighted([" ".join(a), " ".join(b)], 1)
    x, y = d == 0, d == 1
    exact, _ = dedup.jaccard(s[x], w[x], s[y], w[y])
    p, q = dict(zip(s[x].tolist(), w[x].tolist(), strict=True)), dict(zip(s[y].tolist(), w[y].tolist(), strict=True))
    keys = {*p, *q}
    brute = sum(1 / sum(max(p.get(e, 0) / p[k], q.get(e, 0) / q[k]) for e in keys) for k in {*p} & {*q})
    sig = dedup.signatures(s, d, w, 2, 4096)
    assert abs(exact - brute) < 1e-9 and abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 20)] + [(100, 101), (101, 105), (3, 30), (200, 7)]
    got = {r.id: r.label for r in dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[k] for k in [*range(21), 30, 200]}) == 1 and got[100] == got[105] != got[0]
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(spark):
    r = random.Random(7)
    rows = [(i, say(p, 30, r), k) for i in range(120) for k, p in [list(zip(("en", "de", "fr"), (EN, DE, FR), strict=True))[i % 3]]] + [(500, None, "en"), (501, "123 !!", "en"), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in lang_id.identify(df, lang_id.fit(df)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120]) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert lang_id.fit(df.filter("false")) is None


def test_top_k_of_wide_vectors(spark):
    """Vectors of which few fit in a packed row, of unequal lengths, with nulls, a repeated row and names that clash, against all products."""
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=20_000 - 50 * (i % 3)).tolist(), 1, 2) for i in range(30)] + [(30, None, 1, 2), (31, [1.0, None], 1, 2), (32, [float("nan")], 1, 2), (33, [], 1, 2), (None, [1.0], 1, 2)]
    rows.append(rows[3])
    assert [topk.fit_in(topk.CHUNK, topk.ROW_BYTES, d) for d in (None, 0, 64, 20_000, 10**9)] == [1024, 1024, 1024, 3, 1]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `rank` int, `query.id` int")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and i not in (31, 32)]
    want = []
    for q in (0, 10, 20):
        a = next(v for i, v in good if i == q)
        best = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in good if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(df, (F.col("vec_id") % 10 == 0) & (F.col("vec_id") < 30))
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def _kneser_ney(texts):
    """Each word's share by distinct words before it, less modified Kneser-Ney discounts of add-one counts of counts, as a function of the backoff: plain loops over strings."""
    before = {}
    for t in texts:
        for a, b in zip([None, *t.split()], t.split(), strict=False):
            before.setdefault(b, set()).add(a)
    follows = {w: len(x) for w, x in before.items()}

    def share(word, kinds, backoff):
        n = {k: sum(follows.get(w, 0) == k for w in kinds) + 1 for k in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2])
        most = {1: 0.98, 2: 1.9, 3: 2.8}
        cut = {k: min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), most[k]) for k in most}
        freed = sum(cut[min(f, 3)] for f in follows.values())
        f = follows.get(word, 0)
        return (f - (cut[min(f, 3)] if f else 0) + freed * backoff) / sum(follows.values())

    return share


def test_toxicity_against_brute_force(spark):
    """The ratio of every word of the sample, and of one that it lacks, by dictionaries of words; the scores don't see names that clash."""
    r = random.Random(11)
    common, rude = [a + b for a in "bdfgklm" for b in ("alo", "eri", "ona", "uke")], ["grr", "zzt", "pfui"]
    texts = {i: say(common[: 8 + i % 20], 12, r) + (" " + say(rude, 2, r) if i % 3 == 0 else "") for i in range(60)}
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in texts.items()] + [(100, "never labelled words", 0, 1)], "doc_id long, text string, `toxic` int, `score` int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scale = {x.doc_id for x in labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)) == 0).collect()}
    learned = [[t for i, t in texts.items() if i not in scale and (i % 3 == 0) == toxic] for toxic in (False, True)]
    n_docs = {}
    for t in [*texts.values(), "never labelled words"]:
        for w in set(t.split()):
            n_docs[w] = n_docs.get(w, 0) + 1
    once, twice = (sum(n == k for n in n_docs.values()) for k in (1, 2))
    power = once / max(once + 2 * twice, 1)
    tables = {w: int(n**power * 1024) / 1024 for w, n in n_docs.items()}
    kinds = {w for ts in learned for t in ts for w in t.split()}
    rest = max(sum(tables.values()) - sum(tables[w] for w in kinds), 0.5)
    whole = rest + sum(max(tables[w], 0.5) for w in kinds)
    plain, toxic = (_kneser_ney(ts) for ts in learned)
    want = {w: np.log(toxic(w, kinds, max(tables[w], 0.5) / whole) / plain(w, kinds, max(tables[w], 0.5) / whole)) for w in kinds}
    hashes = {w: words([w])[0][0] for w in kinds}
    got = dict(zip(model.vocabulary.tolist(), model.ratio.tolist(), strict=False))
    assert len(got) == len(kinds) and all(abs(got[int(hashes[w])] - want[w]) < 1e-4 for w in kinds)
    assert abs(model.ratio[-1] - np.log(toxic("", kinds, rest / whole) / plain("", kinds, rest / whole))) < 1e-4
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "score"] and scored.count() == 61 and toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        t = [f"w{r.randrange(200)}" for _ in range(60)]
        if i % 4 == 0:
            t[10], t[30] = "vile", "awful"
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "vile awful vile w1 w2")]
    docs, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, y.filter("doc_id % 5 <> 0"))
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert sum((got[i] >= 0.5) == bool(t) for i, t in labels) >= 396 and got[902] > 0.5 and got[900] == got[901] < 0.5
    assert toxicity.fit(docs, y.filter("toxic = 0")) == 0.0
    more = docs.union(spark.createDataFrame([(1000 + i, "vile weather") for i in range(300)], docs.schema))
    assert toxicity.fit(more, y).ratio.tolist() != toxicity.fit(docs, y).ratio.tolist()  # the backoff counts documents without labels
    assert toxicity.fit(spark.createDataFrame([(1, None)], docs.schema), y) == 0.25


def test_document_counts(spark):
    rows = [(1, "a b a"), (2, "A c"), (2, "A c"), (3, None), (4, "b " * 10)]
    got = {r.word: r.docs for r in toxicity.document_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    at = lambda w: int(words([w])[0].view(np.int64)[0])
    assert got == {at("a"): 3, at("b"): 2, at("c"): 2}


def test_words_in_blocks():
    t = [say(EN, 50, random.Random(k)) for k in range(20)] + ["", "  "]
    a, b = words(t), words(t, block=40)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and np.bincount(a[1], minlength=22)[20:].sum() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>One</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p><b>First<br>line <a href="y">link</a>.</p><p>Be.
<form>mail</form><aside>See also</aside><div class="ad">Buy</div><script>x("</p>")</script></article>
<section id="comments"><p>This is the comment that a reader of the page wrote and it is as long as it is.</p></section><footer>&copy; x</footer></body>"""


def test_html():
    assert html_extract.main_text(PAGE) == "A & B\nFirst line link.\nBe."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    long = "The house of the man that is on the hill and was there for years with all of the people who were in it. " * 3
    plain = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><p>{long}</p><p>Short.</p><p>{long}</p><div><a href=3>Imprint</a></div></body>"
    assert html_extract.main_text(plain) == f"{long.strip()}\nShort.\n{long.strip()}"
    assert html_extract.main_text("<article><p>cut off &am") == "cut off &am"
    assert html_extract.main_text("<article><p title='a>b'>x &lt;y&gt; &#233;</p><p") == "x <y> é"


def test_html_wrappers():
    long = "The house of the man that is on the hill and was there for years with all of the people who were in it. " * 3
    for wrapper in ('class="has-sidebar"', 'class="content-with-sidebar"', 'id="share-page"', 'class="layout side-by-side"'):
        for inner in ("article", "main", 'div itemprop="articleBody"'):
            page = f"<body><div {wrapper}><div class='page-menu'><p>{long}menu</p></div><{inner}><p>{long}</p></{inner.split()[0]}></div></body>"
            assert html_extract.main_text(page) == long.strip(), (wrapper, inner)
    assert html_extract.main_text(f"<div class='has-sidebar'><p>{long}</p></div>") == long.strip()
    assert html_extract.main_text(f"<div class='sidebar'><article>{long}</article></div><section id='user-comments'><article>{long}</article></section>") == ""


def test_blocks_shrink_with_their_lanes():
    ids = (np.random.default_rng(4).zipf(1.3, 2000) % 500).astype(np.uint16)
    t = rans.Table(np.bincount(ids, minlength=500))
    block = rans.encode(ids, t)
    assert len(block) < 2 * len(ids) and (rans.decode(block, t) == ids).all()
    parts = [rans.decode(block, t, k, True) for k in range(rans.checkpoints(block))]
    assert len(parts) > 1 and (np.concatenate(parts) == ids).all()
    assert (rans.decode(block, rans.Table.of(t.freq, t.bits)) == ids).all()


def test_corpus_is_read_by_another_process(spark, tmp_path):
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = spark.createDataFrame([(k, f"some words of text {k} " * 300) for k in range(12)], "doc_id long, text string")
    path = str(tmp_path / "corpus")
    tokens.write_corpus(docs, path, vocabulary, 1, 4000)
    files, table = tokens.read_corpus(spark, path)
    whole = {(r.shard, r.first_seq, r.inner): r.ids for r in tokens.read_blocks(files, table).collect()}
    parts = {}
    for r in tokens.read_segments(files, table).orderBy("part").collect():
        parts[r.shard, r.first_seq] = parts.get((r.shard, r.first_seq), b"") + r.ids
    joined = {}
    for (shard, seq, _), ids in sorted(whole.items()):
        joined[shard, seq] = joined.get((shard, seq), b"") + ids
    assert joined == parts and len(whole) == 12


def test_dedup_keeps_rows_apart(spark):
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(None, a + " x"), (6, a), (7, b), (7, c), (8, c + " y"), (None, "alone " + text()), (None, text()), (9, "spam " * 40), (10, "spam " * 44)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, __class int, __row int")
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.class_id is None, x.class_id or 0) for x in dedup.near_duplicates(docs).collect()))
    assert got == sorted([(True, 0, False, 6), (False, 6, False, 6), (False, 7, False, 7), (False, 7, False, 7), (False, 8, False, 7), (True, 0, True, 0), (True, 0, True, 0), (False, 9, False, 9), (False, 10, False, 9)])
    kept = dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 0, 0, 6, 7, 9]


def test_dedup_of_loose_groups_against_all_pairs(spark):
    r = random.Random(12)
    texts = []
    for g in range(3):
        base = [f"g{g}w{r.randrange(10**6)}" for _ in range(100)]
        for _ in range(80):
            t = list(base)
            for _ in range(r.randrange(1, 4)):
                t[r.randrange(100)] = f"n{r.randrange(10**6)}"
            if r.random() < 0.3:
                t += ["again and again and again"] * r.randrange(1, 5)
            texts.append(" ".join(t))
    s, d, w, _ = dedup.weighted(texts)
    sets = [(s[d == k], w[d == k]) for k in range(len(texts))]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and max(dedup.jaccard(*sets[i], *sets[j])) >= 0.8 - 1e-9:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    got = {x.doc_id: x.class_id for x in dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == label


def test_pages_without_markup():
    long = "The house of the man that is on the hill and was there for years with all of the people who were in it. " * 3
    blocks = ["Home News Imprint", long, "Short line.", long, "table 12 33 45 66 71 88 zz qq xx yy ww vv kk jj hh gg ff dd ss mm nn bb rr", "Copyright 2024 all rights reserved"]
    page = "<div><a href=1>Home News Imprint</a></div>" + "".join(f"<div>{b}</div>" for b in blocks[1:])
    found = html_extract.blocks(page)
    assert [(k, rule) for k, rule in html_extract.judge(found)] == [(False, "text"), (True, "text"), (True, "neighbours"), (True, "text"), (False, "text"), (False, "text")]
    assert html_extract.main_text(f"<div class='page-menu-wrap'><p>{long}</p></div>") == long.strip()  # a compound class name alone doesn't empty a page
    assert html_extract.main_text(f"<article><p>{long}</p></article><p>tail with links <a href=1>{long}</a></p>") == long.strip()


def test_neighbour_pass_against_brute_force():
    r = random.Random(6)
    texts = {2: "The house of the man that is on the hill and was there for years with all of the people who were in it. " * 3, 0: "Too short.", -1: "zz qq xx yy ww vv kk jj hh gg ff dd ss aa bb cc ee rr tt yy uu ii oo pp zz qq xx yy ww vv kk jj hh"}
    for _ in range(50):
        kinds = [r.choice([2, 0, -1]) for _ in range(12)]
        label = {2: 1, 0: 0, -1: -1}
        want = []
        for k, kind in enumerate(kinds):
            decided = [(abs(j - k), label[x]) for j, x in enumerate(kinds) if label[x]]
            near = min((d for d, _ in decided), default=None)
            want.append(kind == 2 if kind else any(v == 1 for d, v in decided if d == near))
        found = [html_extract.Block(texts[k], 0, 0, False, False) for k in kinds]
        assert html_extract.classify(found) == want


def test_stages_of_the_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(2)
    rows = [(i, say(p, 40, r) + f" x{i}", k, f"s{i % 2}", 0, 0.5, "z", 1) for i in range(60) for k, p in [(("en", EN), ("de", DE))[i % 2]]]
    item = " ".join(f"bench{k}" for k in range(30))
    rows += [(100, rows[0][1], "en", "s0", 0, 0.5, "z", 1), (101, None, None, None, 0, 0.5, "z", 1), (102, "12 34", "en", "s0", 0, 0.5, "z", 1), (103, say(EN, 20, r) + " " + item, "en", "s1", 0, 0.5, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, `a.b` int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = dict(pipeline.STAGES)
    a = steps["language"](spark, docs, str(tmp_path))
    assert a.columns == docs.columns and {x.doc_id for x in a.collect()} == {i for i, *_ in rows} - {101, 102}
    b = steps["near_duplicates"](spark, a, str(tmp_path))
    assert 100 not in {x.doc_id for x in b.collect()} and b.count() == a.count() - 1
    c = steps["decontamination"](spark, b, str(tmp_path))
    assert {x.doc_id for x in b.collect()} - {x.doc_id for x in c.collect()} == {103}
    d = steps["mixing"](spark, c, str(tmp_path))
    assert d.columns == docs.columns
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == d.count() and out and min(x.start for x in out) == 0
    none = docs.filter("false")
    for name, step in pipeline.STAGES:
        assert step(spark, none, str(tmp_path)).count() == 0, name


def test_html_keeps_whole_articles(spark):
    long = "This is the text of an article that has all the words of a language in it, and so it is read as one. " * 4
    chinese = "这是一篇关于城市历史的文章。河边的老车站在一百年前建成，许多人从那里出发去远方。今天它是一座博物馆！"
    russian = "Старый вокзал у реки построили сто лет назад, и многие люди уезжали отсюда в далёкие города. Сегодня здесь музей. " * 3
    finnish = "Vanha asema joen rannalla rakennettiin sata vuotta sitten, ja moni lähti sieltä kaukaisiin kaupunkeihin. Nykyään siinä toimii museo, jossa käydään kesäisin. " * 2
    menu = "<nav><a href=1>Home</a></nav><div class='footer'>About us</div>"
    cases = [f"<div class='search'><article><p>{long}</p></article></div>", f"<div class='main side'><p>{long}</p></div>", f"<article class='reply-letter'><p>{long}</p></article>"]
    cases += [f"<h2>Comments</h2><article><p>{long}</p></article>", f"<div><p>{russian}</p></div>", f"<div><p>{finnish}</p></div>"]
    pages = [(k, "u", f"<body>{menu}{x}</body>", 1) for k, x in enumerate(cases)] + [(100, None, f"<div><p>{chinese}</p></div>", 2), (101, "u", None, 3), (102, "u", "", 4), (102, "u", "", 4)]
    comments = f"<article><p>{long}</p></article><h2>3 Comments</h2><div><p>{long}</p></div><article class='comment-body'><p>{long}</p></article>"
    listed = "<div><p>" + "Red Shoes Blue Coats Green Hats Summer Sale Winter Boots Leather Bags " * 4 + "</p></div>"
    very_long = f"<article>{f'<p>{long}</p>' * 3000}</article>"
    pages += [(103, "u", comments, 5), (104, "u", f"<article><p>{long}</p></article>{listed}", 6), (105, "u", very_long, 7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text long")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    texts = dict((k, t) for k, t, _ in got)
    want = [long] * 4 + [russian, finnish]
    assert [texts[k] for k in range(6)] == [x.strip() for x in want]
    assert texts[100] == chinese and [g for g in got if g[0] in (101, 102)] == [(101, "", 0), (102, "", 0), (102, "", 0)]
    assert texts[103] == texts[104] == long.strip()
    assert texts[105] == "\n".join([long.strip()] * 3000) and all(len(t) == n for _, t, n in got)
    assert html_extract.extract(df.filter("false")).count() == 0
