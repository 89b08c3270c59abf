"""Near-duplicates, line dedup, urls, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import common, neardup, urls


def shingles(text):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(x, y):
    """Probability Jaccard similarity, term by term."""
    every = [*(x.keys() & y.keys()), *(x.keys() ^ y.keys())]
    u, v = (np.array([z[i] for i in every], float) for z in (x, y))
    return sum(1 / np.maximum(u / u[i], v / v[i]).sum() for i in range(len(x.keys() & y.keys())))


def near(x, y):
    if x == y:
        return bool(x)
    least = sum(min(x[i] / x.total(), y[i] / y.total()) for i in x.keys() & y.keys()) if x and y else 0
    return least >= 0.8 - 1e-9 and similarity(x, y) >= 0.8 - 1e-9  # the common mass is never less than the similarity


def brute_classes(rows):
    """Class id of each row by comparing all pairs of different texts."""
    texts = sorted({t for _, t in rows if t is not None})
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if near(sets[i], sets[j]):
                parent[find(i)] = find(j)
    place = {t: find(k) for k, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if t is not None and i is not None:
            least[place[t]] = min(least.get(place[t], i), i)
    return [(i, least.get(place[t]) if t is not None else i) for i, t in rows]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Groups: a star of near copies around a base, exact copies, a chain, and single texts with one common passage."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    base, common = words(150), words(60)
    rows += [edited(rng, base, rng.randint(1, 4)) for _ in range(80)]
    rows += [" ".join(words(40))] * 30
    chain = words(200)
    for _ in range(12):
        chain = edited(rng, chain, 3).split()
        rows.append(" ".join(chain))
    rows += [" ".join(words(60) + common + words(60)) for _ in range(60)]
    rows += [" ".join(words(rng.randint(1, 90))) for _ in range(150)]
    return rows


def test_near_duplicates(make, copies, odd_texts):
    df = make([*odd_texts, *[(1000 + i, t) for i, t in enumerate(copies)]])
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None), key=repr) == sorted((x for x in brute_classes(rows) if x[0] is not None), key=repr)
    sizes = {}
    for r in got:
        sizes.setdefault(r["class_id"], []).append(r)
    assert all(len(v) == v[0]["class_size"] for k, v in sizes.items() if k is not None)
    assert all(r["keep"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_links_beside_unlike_pivots(make):
    """One bucket {P, C, A, B}: A and B are near copies, P and C like neither and the first two pivots."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    node = lambda t: hashlib.md5(t.encode()).digest()
    bucket = neardup.signature_kernel(1, 1, 5)

    def held(t):
        (got,) = bucket(iter([pa.RecordBatch.from_pydict({"node": [node(t)], "row": [0], "text": [t]})]))
        return got.column(2).to_pylist()[0][0]

    common = words(60)
    a = " ".join(common + words(60))
    b = a + " tail"
    texts = [" ".join(common + words(60)) for _ in range(200)]
    most = max(set(map(held, texts)), key=[held(t) for t in texts].count)
    texts = sorted((t for t in texts if held(t) == most), key=node)
    assert len(texts) > 3
    a, others = texts[0], texts[-2:]
    b = next(t for t in (f"{a} tail{i}" for i in range(1000)) if held(t) == most and node(t) < node(others[0]))
    rows = list(enumerate([*others, a, b]))
    got = neardup.near_duplicates(make(rows), bands=1, rows=1).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(brute_classes(rows)) == {0: 0, 1: 1, 2: 2, 3: 2}


def test_repeat_counts_weigh(make):
    """Shingles that one text repeats often make it unlike; a changed word in a line that both repeat often does not."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(6):
        single, again = words(150), words(14)
        rows += [(4 * i, " ".join(single + again * 2)), (4 * i + 1, " ".join(single + again * 60))]
        single, again = words(30), words(12)
        rows += [(4 * i + 2, " ".join(single + again * 40)), (4 * i + 3, edited(rng, single + again * 40, 3))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(make(rows)).collect()}
    assert got == dict(brute_classes(rows)) == {i: i - (i % 4 == 3) for i in range(24)}


def test_probability_jaccard_is_that_of_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = ({int(i): int(n) for i, n in zip(rng.choice(30, 20, replace=False), rng.integers(1, 6, 20))} for _ in range(2))
        held = [(np.array(sorted(z), np.uint64), np.array([z[i] for i in sorted(z)], float)) for z in (x, y)]
        assert abs(neardup.probability_jaccard(*held) - similarity(Counter(x), Counter(y))) < 1e-9


def test_prefix_pairs_hold_all_near_pairs(spark, copies):
    sets = [shingles(t) for t in sorted(set(copies))]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    name = lambda i: i.to_bytes(2, "big")
    packed = [sorted((number[x], n) for x, n in s.items()) for s in sets]
    rows = [(name(i), name(i), np.array([x for x, _ in p], np.uint64).tobytes(), np.array([n for _, n in p], np.uint32).tobytes()) for i, p in enumerate(packed)]
    df = spark.createDataFrame(rows, "node binary, comp binary, shingles binary, counts binary")
    got = {tuple(sorted(int.from_bytes(x, "big") for x in r)) for r in neardup.prefix_pairs(df, 0.8).collect()}
    pairs = {(i, j) for j in range(len(sets)) for i in range(j) if near(sets[i], sets[j])}
    assert len(pairs) > 100 and pairs <= got and len(got) < 4 * len(pairs)


def test_one_of_each(make, spark):
    rows = [(3, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (2, "other words"), (None, "other words"), (None, None), (7, None), (7, None)]
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row long, MD5 string")
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=repr) == sorted([(2, "A b c d e f g"), (2, "other words"), (None, None), (7, None), (7, None)], key=repr)


def test_hot_nodes_are_salted(make, copies, monkeypatch):
    """With every key hot, the result is the same."""
    rows = list(enumerate(copies[:140]))
    monkeypatch.setattr(common, "HOT_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 10**6)
    got = neardup.near_duplicates(make(rows)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted(brute_classes(rows))


def test_no_copies_and_no_rows(make):
    assert [r["keep"] for r in neardup.near_duplicates(make(["a b c", "d e f"])).collect()] == [True, True]
    assert neardup.near_duplicates(make([])).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    both, m = [], 400
    for _ in range(20):
        h = rng.integers(0, 2**63, 60, dtype=np.uint64)
        wa, wb = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
        wa[0] = wb[0] = 2
        doc = np.concatenate([np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)])
        sig = neardup.prob_minhash(doc, np.concatenate([h[wa > 0], h[wb > 0]]), np.concatenate([wa[wa > 0], wb[wb > 0]]).astype(float), 2, m)
        exact = sum(1 / sum(max(x / wa[d], y / wb[d]) for x, y in zip(wa, wb)) for d in range(60) if wa[d] and wb[d])
        both.append(((sig[0] == sig[1]).mean(), exact))
    assert max(abs(a - b) for a, b in both) < 0.1 and abs(np.mean([a - b for a, b in both])) < 0.02


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent}


URLS = [
    ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/a", "x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com/e", "example.com", "/e", "com/", "allow"),
    ("http://m.site.net/es/1", "m.site.net", "/es/1", "net/es/", "block"),
    ("http://site.net/ES/1", "site.net", "/ES/1", None, "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://a.org/xxx", "a.org", "/xxx", None, "block"),
    ("http://a.org/xxxl", "a.org", "/xxxl", None, "allow"),
    ("http://casino.org/poker", "casino.org", "/poker", None, "block"),
    ("http://casino.org/casino-CASINO", "casino.org", "/casino-CASINO", None, "allow"),
    ("http://a.com/xxx", "a.com", "/xxx", "com/", "allow"),
    ("no scheme/xxx", "", "", None, "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://a?b/c", "a", "", None, "allow"),
    ("http://a#://b.com/", "a", "", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert urls.judge_urls(df, rules=()).where("verdict = 'block'").count() == 4
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, copies):
    import corpus_pipeline
    from quire.llm import bpe, decontam, secrets, toxicity
    from quire.llm.queries import TOKENIZER

    rng = random.Random(5)
    clean = lambda n: " ".join(f"word{rng.randrange(4000)}" for _ in range(n))
    texts, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        texts.append(clean(40) + (" awfulword nastyword " if toxic else " ") + clean(40))
        labels.append((i, int(toxic)))
    item = clean(30)
    texts += [clean(20) + " " + item + " " + clean(20), texts[1], texts[2], texts[3] + " tail", None, None, "", f"{clean(30)} password=abcdef123456 end"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", len(texts[1]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(r["doc_id"], r["text"]) for r in toxicity.clean_documents(docs, model).distinct().collect()]
    assert not any(i % 4 == 0 and i < 200 for i, _ in left)
    least = dict(brute_classes(left))
    left = [(i, t) for i, t in left if least[i] == i]
    hit = {r["doc_id"] for r in decontam.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("n_hit > 0").collect()}
    left = [(i, t) for i, t in left if i not in hit]
    assert hit == {200} and set(got) == {i for i, _ in left}
    import public_tokenizers

    tokenizer = bpe.Tokenizer(bpe.read_ranks(TOKENIZER), public_tokenizers.PATTERN)
    assert all(got[i]["n_tokens"] == len(tokenizer.encode(secrets.redact(t or "", None))) for i, t in left)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_level_bpe"]
