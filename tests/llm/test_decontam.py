import random
import re

from quire.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(10, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark, make, odd_texts):
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "Ärger", "x1", "日本", "b"]
    item_texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 2, 5, 9, 10, 11, 14, 25, 40)]
    items = [(i, t) for i, t in enumerate(item_texts)] + [(10, item_texts[6]), (100, ""), (101, None), (None, item_texts[5]), (7, item_texts[7]), (12, "one")]
    texts = list(odd_texts)
    for _ in range(60):
        t = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        if rng.random() < 0.6:
            x = rng.choice(item_texts).split()
            cut = x[rng.randint(0, 3) :]
            t += " " + ", ".join(cut).upper() + "; " + t
        texts.append(t)
    docs = make(texts)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = decontam.contamination(docs, bench)
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=repr)
    assert rows == sorted(((r["doc_id"], *brute(r["text"], items)) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] and r["n_items"] == len(r["items"]) for r in got.collect())
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns


def test_shuffled_join_agrees(spark, make, monkeypatch):
    t = " ".join(f"w{i}" for i in range(30))
    docs, bench = make([t, "no hit here", f"zz {t} zz"]), spark.createDataFrame([(1, t)], "item_id long, text string")
    want = sorted(map(repr, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, decontam.contamination(docs, bench).collect())) == want


def test_winnowing_keeps_a_gram_of_every_shared_window(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = []
    for k in range(40):
        shared = [rng.choice("abcdef") for _ in range(10)]
        rows += [(k, [rng.choice("abcdef") for _ in range(rng.randint(0, 9))] + shared + [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]) for _ in range(2)]
    df = spark.createDataFrame(rows, "k int, words array<string>")
    kept = df.select("k", F.transform(decontam.kept_grams(F.col("words"), 10, 5), lambda v: F.shiftright(v, 28)).alias("h")).collect()
    for k in range(40):
        a, b = (set(r["h"]) for r in kept if r["k"] == k)
        assert a & b


def test_empty_tables(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontam.contamination(make(["a b", None]), bench).collect()
    assert sorted((r["n_words"], r["n_hit"]) for r in got) == [(0, 0), (2, 0)]
    assert decontam.contamination(make([]), bench).count() == 0


def test_no_python_in_the_plan(spark, make):
    df = decontam.contamination(make(["a b c"]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapIn"))
