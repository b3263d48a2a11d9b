"""The operators without Python, on small cases."""

import json
import random

from pyspark.sql import functions as F

from harvestry.llm import chat, decontam, mixing, queries, urls


def test_targets(spark):
    def brute(sizes):
        weights = {s: 1 + k % 3 for k, (s, _) in enumerate(sizes)}
        total, capped = sum(n for _, n in sizes), {}
        size = dict(sizes)
        while True:
            left = total - sum(capped.values())
            w = sum(weights[s] for s in size if s not in capped)
            over = [s for s in size if s not in capped and left * weights[s] / w > 3 * size[s]]
            if not over:
                return {s: capped.get(s, left * weights[s] / w if w else 0) for s in size}
            capped |= {s: 3 * size[s] for s in over}

    for sizes in ([("a", 10), ("b", 1000), ("c", 1), (None, 5)], [("a", 0), ("b", 7)], [("x", 5)], [("a", 1), ("b", 1), ("c", 1), ("d", 97)]):
        df = spark.createDataFrame(sizes, "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), f"s{i % 4}" if i % 5 else None, "x") for i in range(500)] + [(500, None, "s1", "x"), (501, " \t", "s1", "x"), (7, "same id", "s2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    m = mixing.mix_sources(docs).collect()
    taken = {}
    for r in m:
        n = r["size"] * r["whole"] + r["part"]
        assert 0 <= n <= 3 * r["size"]
        taken.setdefault((r["row"].source, r.target), []).append(n)
    assert len(m) == len(rows) and all(abs(sum(v) - t) <= 40 for (_, t), v in taken.items())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {s: sum(v) for (s, _), v in taken.items() if sum(v)}
    assert mixing.mix_sources(docs.filter("false")).count() == 0


def test_leaks(spark):
    item = "A train leaves Rome with Maria Rossi on board and goes 120 km in 3 hours before it stops at the old station by the river for lunch"
    other = item.replace("Maria Rossi", "Anna Bianchi").replace("120", "480").replace(" 3 ", " 7 ").replace("Rome", "Oslo")
    mixed = other.replace("480 km in 7 hours", "480 km in 7 hours") + ". " + item
    filler = "Some words that are in no item at all and go on for a while so that there is a text. "
    docs = spark.createDataFrame([(1, filler + item), (2, filler + other + ". " + filler), (3, filler), (4, None), (5, ""), (6, item[:60]), (7, filler + item.upper()), (8, mixed)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find_leaks(docs, bench).collect()}
    assert {1, 2} <= set(got) <= {1, 2, 7, 8} and all(r.item_id == 10 for r in got.values()) and got[2].n_slots > 0
    left = decontam.decontaminate(docs, bench)
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 5, 6, 7, 8} - set(got) and left.columns == docs.columns
    assert decontam.find_leaks(docs.filter("false"), bench).count() == 0


def test_leaks_by_occurrence(spark):
    item = "A train leaves Rome with Maria Rossi on board and goes 120 km in 3 hours before it stops at the old station by the river for lunch"
    other = item.replace("Maria Rossi", "Anna Bianchi").replace("120", "480").replace(" 3 ", " 7 ").replace("Rome", "Oslo")
    again = "on monday the baker sold 12 loaves of bread and on tuesday the baker sold 30 loaves of bread and then he sold 7 loaves of bread to us"
    changed = again.replace("12", "15").replace("30", "41").replace(" 7 ", " 9 ")
    docs = spark.createDataFrame([(1, other + ". " + item), (2, again), (3, changed + ". " + again), (4, changed), (5, "no item in here at all, only words")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, again)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == {(1, 10), (2, 11), (3, 11), (4, 11)}
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [5]


def test_leaks_by_words_and_first_names(spark):
    item = "A train leaves Rome with Maria Rossi on board and goes 120 km in 3 hours before it stops at the old station by the river for lunch"
    earns = "Weng earns 12 dollars an hour. Betty is saving money for a new wallet. Tom gave her 15 dollars for that. Weng gave Betty twice as much."
    renamed = earns.replace("Weng", "Olga").replace("Betty", "Ruth").replace("Tom", "Karl")
    few = "Anna 12 Berta 13 Clara 14 Dora 15"
    docs = spark.createDataFrame([(1, item.upper()), (2, item.lower()), (3, "So: " + renamed), (4, "we know that water boils, yes"), (5, "x " + few), (6, "water that boils is hot. Nothing else is said here.")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, earns), (12, "Water boils"), (13, few)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == {(1, 10), (2, 10), (3, 11), (4, 12), (5, 13)}


def test_leaks_without_ids(spark):
    item = "the old baker in our street sold twelve loaves of bread before noon"
    docs = spark.createDataFrame([(None, item), (None, "something else that is no item"), (3, item), (3, "another text with the same id")], "doc_id long, text string")
    left = decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text for r in left.collect()) == ["another text with the same id", "something else that is no item"]


def test_chat(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    rows = [
        (1, 0, "user", 'hi "you"\n'), (1, 1, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "search", {"limit": 1}))), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "r"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (2, 0, "assistant", call(("a", "nope", {}), ("c", "weather", {"city": "Rom", "metric": "maybe"}), ("c", "weather", {"city": "Rom"}))), (3, 0, None, None),
        (4, 0, "tool", json.dumps({"tool_call_id": "late", "content": "early"})), (4, 1, "assistant", call(("late", "calculate", {"expression": "1+1"}))), (5, 0, "user", "{not json tool_call"),
    ]
    tools = spark.createDataFrame(queries.TOOLS, "name string, param string, type string, required boolean")
    got = chat.link_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()
    status = sorted((r.conv_id, r.turn, r.call_id or "", r.status) for r in got)
    assert status == sorted([
        (1, 0, "", "plain"), (1, 1, "a", "ok"), (1, 1, "b", "missing_argument"), (1, 3, "a", "linked"), (1, 2, "zz", "orphan"), (2, 0, "a", "unknown_tool"), (2, 0, "c", "bad_type"), (2, 0, "c", "duplicate"),
        (3, 0, "", "plain"), (4, 0, "late", "linked"), (4, 1, "late", "ok"), (5, 0, "", "plain"),
    ])
    late = sorted((r.anchor_turn, r.step) for r in got if r.conv_id == 4)
    assert late == [(1, 1), (1, 2)]
    for r in got:
        assert json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message
    ok = next(r for r in got if r.status == "ok" and r.conv_id == 1)
    assert json.loads(ok.message)["arguments"] == {"limit": 3, "query": "x"}


def test_chat_keeps_content_and_types(spark):
    arguments = {"a": {"y": [1, "2"], "x": None}, "b": [True, {"k": "v"}], "c": 3, "d": "3", "e": False, "f": "false", "g": '{"no": "object"}', "h": None, "i": 2.5}
    rows = [
        (1, 0, "assistant", json.dumps({"content": "Let me see", "tool_calls": [{"id": "a", "name": "other", "arguments": arguments}]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "r", "tool_calls": [{"id": "b", "name": "search", "arguments": {"query": "q"}}]})),
    ]
    tools = spark.createDataFrame(queries.TOOLS, "name string, param string, type string, required boolean")
    got = chat.link_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()
    by = {(r.turn, r.step, r.status): r.message for r in got}
    assert len(got) == 4 and set(by) == {(0, 0, "plain"), (0, 1, "unknown_tool"), (1, 1, "no_result"), (1, 2, "linked")}
    assert json.loads(by[0, 0, "plain"])["content"] == "Let me see" and json.loads(by[1, 2, "linked"])["content"] == "r"
    assert json.loads(by[0, 1, "unknown_tool"])["arguments"] == arguments
    assert by[0, 1, "unknown_tool"] == json.dumps(json.loads(by[0, 1, "unknown_tool"]), sort_keys=True, separators=(",", ":"))


def test_urls(spark):
    pages = spark.createDataFrame([(1, "https://www.bad.example.com/x?y#z"), (2, "http://user@BAD.example.com.:80/"), (3, "https://notbad.example.com"), (4, None), (5, "no url"), (1, "https://www.bad.example.com/x?y#z")], "page_id long, url string")
    entries = spark.createDataFrame([("l", "bad.example.com", "2024-01-02", "add"), ("l", "bad.example.com", "2024-01-05", "remove"), ("m", "example.com", "2024-01-03", "add"), (None, "x", "2024-01-01", "add")], "list string, domain string, day string, action string").withColumn("day", F.to_date("day"))
    on = lambda day: {r.page_id: (r.blocked, r.n_active, r.domain) for r in urls.filter_urls(pages, entries, F.lit(day).cast("date")).collect()}
    assert on("2024-01-01")[1] == (False, 0, None)
    assert on("2024-01-02")[1] == on("2024-01-02")[2] == (True, 1, "bad.example.com") and not on("2024-01-02")[3][0]
    assert on("2024-01-04")[1] == (True, 2, "bad.example.com") and on("2024-01-05")[1] == (True, 1, "example.com")
    assert not on("2024-01-04")[4][0] and not on("2024-01-04")[5][0]
    assert urls.filter_urls(pages, entries, F.lit("2024-01-04").cast("date")).count() == 6
    none = urls.filter_urls(pages.limit(0), entries, F.lit("2024-01-04").cast("date")), urls.filter_urls(pages, entries.limit(0), F.lit("2024-01-04").cast("date"))
    assert none[0].count() == 0 and none[1].filter("not blocked and n_active = 0").count() == 6


def test_hot_urls_in_slices(spark):
    """A listed and an unlisted URL and the null of a third of the rows each, rows alike among them: the same rows for any size of slices."""
    some = [(k % 7, ["http://a.bad.org/", "http://good.org/", None][k % 3], {"k": k % 2}) for k in range(900)] + [(k, f"http://h{k}.bad.org/{k}", None) for k in range(50)]
    pages = spark.createDataFrame(some, "page_id long, url string, `__pair` map<string,int>").repartition(5)
    entries = spark.createDataFrame([("l", "bad.org", "2024-01-02", "add"), ("l", "h7.bad.org", "2024-01-02", "add")], "list string, domain string, day string, action string").withColumn("day", F.to_date("day"))
    day = F.lit("2024-01-04").cast("date")
    rows = lambda n: sorted(map(str, urls.filter_urls(pages, entries, day, n).collect()))
    whole = rows(10**6)
    assert len(whole) == 950 and sum("blocked=True" in r for r in whole) == 350 and sum("n_active=2" in r for r in whole) == 1
    assert rows(1) == rows(17) == whole


def test_chat_arguments_as_text_and_types(spark):
    call = lambda i, a: json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": a}]})
    given = {"a": '{"query": "x", "limit": 2}', "b": {"query": 5}, "c": [1], "d": "no json", "e": {"query": "x", "limit": 2.5}, "f": None, "g": {"query": None}}
    rows = [(1, k, "assistant", call(i, a)) for k, (i, a) in enumerate(given.items())] + [(1, 100 + k, "tool", json.dumps({"tool_call_id": i, "content": "r"})) for k, i in enumerate(given)]
    tools = spark.createDataFrame(queries.TOOLS, "name string, param string, type string, required boolean")
    got = {r.call_id: r for r in chat.link_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect() if r.step == 1}
    assert {i: r.status for i, r in got.items()} == {"a": "ok", "b": "bad_type", "c": "bad_type", "d": "bad_type", "e": "bad_type", "f": "missing_argument", "g": "bad_type"}
    assert json.loads(got["a"].message)["arguments"] == {"limit": 2, "query": "x"} and json.loads(got["b"].message)["arguments"] == {"query": 5}
    empty = chat.link_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tools)
    assert empty.count() == 0


def test_chat_forms_of_calls(spark):
    wire = {"id": "c1", "type": "function", "function": {"name": "search", "arguments": '{"query": "x", "limit": 5.0}'}}
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [wire, dict(wire, id="c2", function=dict(wire["function"], strict=True)), dict(wire, id="c3", type="custom", note=[1])], "refusal": None, "name": "me"})),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": [{"type": "text", "text": "r"}], "is_error": False})),
        (1, 2, "assistant", '{"tool_calls": [{"id": "c4", "name": "search", "arguments": {"query": "a", "query": "b"}}]}'), (1, 3, "assistant", '{"tool_calls": {"id": "c5"}}'),
        (1, 4, "assistant", json.dumps({"tool_calls": [{"id": "c6", "name": "convert", "arguments": {"amount": 5, "unit": "m"}}, {"id": "c7", "name": "odd", "arguments": {"x": 1}}, {"id": "c8", "name": "search", "arguments": '{"query": 1, "query": 2}'}]})),
        (1, 5, "assistant", json.dumps({"tool_calls": [1]})), (1, 6, "user", json.dumps({"tool_calls": None, "content": "x"})), (None, 7, "tool", json.dumps({"tool_call_id": "c1", "content": "r"})),
        (1, 8, "assistant", json.dumps({"tool_calls": [{"id": "c9", "name": "search", "function": {"name": "other"}}]})),
    ]
    tools = spark.createDataFrame([*queries.TOOLS, ("odd", "x", "date", False)], "name string, param string, type string, required boolean")
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "conv_id long, turn long, role string, text string, call_id string, message string, kind int")
    got = sorted(chat.link_chat(docs, tools).collect(), key=lambda r: (r.turn, r.step, r.pos))
    assert [(r.turn, r.step, r.pos, r.call_id, r.status) for r in got] == [
        (0, 0, 0, None, "plain"), (0, 1, 0, "c1", "ok"), (0, 1, 1, "c2", "no_result"), (0, 1, 2, "c3", "no_result"), (1, 2, 0, "c1", "linked"), (2, 0, 0, None, "plain"), (3, 0, 0, None, "plain"),
        (4, 1, 0, "c6", "no_result"), (4, 1, 1, "c7", "bad_type"), (4, 1, 2, "c8", "bad_type"), (5, 0, 0, None, "plain"), (6, 0, 0, None, "plain"), (7, 2, 0, "c1", "orphan"), (8, 1, 0, "c9", "missing_argument"),
    ]
    by = {(r.turn, r.step, r.pos): json.loads(r.message) for r in got}
    assert by[0, 0, 0] == {"content": "", "extra": {"name": "me", "refusal": None}, "role": "assistant"} and by[0, 1, 0] == {"arguments": {"limit": 5, "query": "x"}, "id": "c1", "name": "search", "role": "assistant"}
    assert by[0, 1, 1]["extra"] == {"function": dict(wire["function"], strict=True)} and by[0, 1, 2]["extra"] == {"note": [1], "type": "custom"} and by[1, 2, 0]["extra"] == {"is_error": False}
    assert json.loads(by[1, 2, 0]["content"]) == [{"text": "r", "type": "text"}] and by[8, 1, 0]["extra"] == {"function": {"name": "other"}} and by[4, 1, 2]["arguments"] == '{"query": 1, "query": 2}'
    assert all(by[t, 0, 0]["content"] == rows[t][3] for t in (2, 3, 5, 6))
    for r in got:
        assert json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1, 2, 3, 4, 5), (1, "a b c", "s", 1, 2, 3, 4, 5), (2, None, None, 0, 0, 0, 0, 0)], "doc_id long, text string, source string, size int, row int, `part` int, __row int, `a.b` int")
    assert mixing.mixed_documents(docs).columns == docs.columns and sorted(r["row"]["row"] for r in mixing.mix_sources(docs).collect()) == [0, 2, 2]
    left = decontam.decontaminate(docs, spark.createDataFrame([(1, "x y z")], "item_id long, text string"))
    assert left.columns == docs.columns and left.count() == 3
    pages = spark.createDataFrame([(1, "http://x.org/", "h", "l", 1, 4)], "page_id long, url string, host string, list string, n_active int, `a.b` int")
    entries = spark.createDataFrame([("l", "x.org", "2024-01-01", "add")], "list string, domain string, day string, action string").withColumn("day", F.to_date("day"))
    r = urls.filter_urls(pages, entries, F.lit("2024-02-01").cast("date")).first()
    assert (r["host"], r["list"], r["n_active"], r["a.b"], r["host_"], r["n_active_"], r["blocked"]) == ("h", "l", 1, 4, "x.org", 1, True)


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    words = [a + b for a in "bdfgklmnprst" for b in ("alo", "eri", "ona", "uke")]
    base = [" ".join(rng.choices(words, k=rng.randint(6, 14))) for _ in range(12)]
    common = " ".join(rng.choices(words, k=7))
    items = base + [f"{common} {x}" for x in base] + [f"{x} {y}" for x, y in zip(base, base[1:], strict=False)]
    pool = items + [common] + [" ".join(rng.choices(words, k=9)) for _ in range(6)]
    texts = [" ".join(x if rng.random() < 0.7 else x[: rng.randrange(len(x))] for x in rng.choices(pool, k=rng.randint(1, 6))) for _ in range(80)]
    windows = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if len(windows(x) & windows(t)) >= 0.8 * len(windows(x))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_leaks_in_a_long_text(spark):
    """An item thousands of times in one text, each time with other values, beside a benchmark without rows and one of many items that share windows."""
    item = "A train leaves Rome with Maria Rossi on board and goes 120 km in 3 hours before it stops at the old station by the river for lunch"
    names = ["Anna Bianchi", "Carla Verdi", "Paolo Neri", "Luca Gallo"]
    text = ". ".join(item.replace("Maria Rossi", names[k % 4]).replace("120", str(200 + k)) for k in range(2500))
    broken = ". ".join(item.replace("on board and goes 120 km in 3 hours", f"runs {200 + k} km") for k in range(2500))
    docs = spark.createDataFrame([(1, text), (2, broken), (2, broken), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)] + [(k, f"{item} and then {k} apples") for k in range(2, 6)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.consistency for r in decontam.find_leaks(docs, bench).collect()}
    assert {d for d, _ in got} == {1, None} and got[1, 1] >= 0.8
    assert decontam.find_leaks(docs, bench.filter("false")).count() == 0
    assert decontam.decontaminate(docs, bench.filter("false")).count() == 4
