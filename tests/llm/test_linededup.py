"""Substring dedup against a version in plain Python over all documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import common, linededup
from quire.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_units(text):
    """[(normalised words, start of the first word, start of the next unit or end of the text)]"""
    out, run, begin = [], [], 0
    found = list(WORD.finditer(text))
    for k, m in enumerate(found):
        begin = begin if run else m.start()
        run.append("".join(c.lower() if "A" <= c <= "Z" else c for c in m[0]))
        after = found[k + 1].start() if k + 1 < len(found) else len(text)
        if m[0][-1] in ".,;:!?|" or "\n" in text[m.end() : after] or k + 1 == len(found):
            out.append((tuple(run), begin, after))
            run = []
    return out


def brute_spans(rows, least=50):
    """{(id, text): spans that go}: runs of units that an earlier document holds."""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t}, key=lambda d: (d[0], d[1]))
    first, out = {}, {}
    for d in docs:
        units, run, gone = brute_units(d[2]), [], []
        for u in [*units, None]:
            if u is not None and first.setdefault(u[0], d) != d:
                run.append(u)
                continue
            if run and sum(len(x[0]) for x in run) >= least:
                gone.append((run[0][1], run[-1][2]))
            run = []
        out[(d[1] if d[0] else None, d[2])] = gone
    return out


def without(text, spans):
    return "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in spans))


@pytest.fixture(scope="module")
def rows():
    """Passages that stand in lines, across lines, glued to other words, recased and respaced; short ones and repeats within a text."""
    rng = random.Random(5)
    words = lambda n: [rng.choice(["ä", "B", "ça", ""]) + f"w{rng.randrange(10**6)}" for _ in range(n)]

    def prose(n):
        return " ".join(w + rng.choice(["", "", "", "", ",", ".", ";", " |"]) for w in words(n)) + "."

    passages, short = [prose(60) for _ in range(6)], [prose(20) for _ in range(3)]
    rows = []
    for i in range(120):
        p = rng.choice(passages)
        kind = i % 6
        if kind == 0:
            t = f"{prose(40)}\n{p}\n{prose(30)}"
        elif kind == 1:
            t = f"{prose(40)} {p} {prose(30)}"
        elif kind == 2:
            t = f"{prose(30)} {' '.join(words(5))} {p.upper()}   {prose(9)}"
        elif kind == 3:
            t = prose(20) + " \t\n\n" + re.sub(r"(\. |, )", lambda m: m[0] + "\n", p) + "\x0b\n"
        elif kind == 4:
            t = f"{rng.choice(short)} {prose(60)}\n{rng.choice(short)}"
        else:
            own = prose(70)
            t = f"{own}\n{prose(10)}\n{own}\n{prose(10)}"
        rows.append((1000 - i, t))
    return rows


def test_passages(make, rows):
    got = {r["doc_id"]: r for r in linededup.deduplicated(make(rows)).collect()}
    want = brute_spans(rows)
    assert sum(map(bool, want.values())) > 50
    for i, t in rows:
        assert [(x["start"], x["end"]) for x in got[i]["removed"]] == want[i, t]
        assert got[i]["kept_text"] == without(t, want[i, t])
        if i % 6 in (5, 0):  # 1000 - 5 and 1000 - 4: own repeats, and passages under 50 words
            assert want[i, t] == [] or (1000 - i) % 6 not in (4, 5)


def test_every_repeat_goes_with_a_limit_of_one_word(make):
    rows = [(1, "One, two three.\nfour"), (2, "one,  TWO three. five\nfour"), (3, "x, one, four")]
    got = {r["doc_id"]: r["kept_text"] for r in linededup.deduplicated(make(rows), min_words=1).collect()}
    assert got == {1: rows[0][1], 2: "five\n", 3: "x, "}


def test_hot_digests_are_dealt_out(make, rows, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_KEYS", 10**6)
    common_line = "all of these texts hold this line. " * 4
    many = [(i, f"{common_line}\n{t}") for i, t in rows] + [(i + 5000, common_line + ", ".join(f"z{i} {k}" for k in range(9))) for i in range(300)]
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["removed"]] for r in linededup.deduplicated(make(many), min_words=8).collect()}
    want = brute_spans(many, 8)
    assert got == {i: want[i, t] for i, t in many} and sum(map(bool, got.values())) > 400


def test_odd_rows(make, odd_texts, rows):
    odd = make(odd_texts)
    same = lambda df: sorted(((r[0], r[1]) for r in df), key=repr)
    got = linededup.deduplicated(odd, min_words=10**6).select("doc_id", "kept_text").collect()
    assert same(got) == same(odd.select("doc_id", "text").collect())
    long = rows[0][1] * 200
    again = linededup.deduplicated(make([(2, long), (2, long), (3, long), (None, long)])).collect()
    assert sorted(((r["doc_id"], r["kept_text"]) for r in again), key=repr) == sorted([(2, ""), (2, ""), (3, ""), (None, long)], key=repr)
    assert linededup.deduplicated(make([])).count() == 0
    assert linededup.deduplicated(make([(1, None), (2, "")])).select(F.sum(F.size("removed"))).first()[0] == 0


def brute_windows(rows, least):
    """{(id, text): spans that go}: of the words in windows of least words that an earlier document holds."""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t}, key=lambda d: (d[0], d[1]))
    first, out = {}, {}
    for d in docs:
        found = list(WORD.finditer(d[2]))
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in m[0]) for m in found]
        gone = set()
        for a in range(len(words) - least + 1):
            if first.setdefault(tuple(words[a : a + least]), d) != d:
                gone.update(range(a, a + least))
        starts = [*(m.start() for m in found), len(d[2])]
        edges = [k for k in range(len(starts)) if (k in gone) != (k - 1 in gone)]
        out[(d[1] if d[0] else None, d[2])] = [(starts[a], starts[b]) for a, b in zip(edges[::2], edges[1::2])]
    return out


@pytest.mark.parametrize("least", [1, 2, 9, 50])
def test_whole_passages(make, rows, monkeypatch, least):
    """Also such as begin and end within clauses, which units lose; those of hot digests; and short clauses of several documents in a row stay."""
    monkeypatch.setattr(linededup, "HOT_KEYS", 10**6)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    passage = [f"p{k}" + "," * (k % 12 == 9) for k in range(52)]
    inside = [(2000 + i, " ".join([f"a{i}", *passage[: 52 - i % 3], f"b{i}", "end", "of", "it."])) for i in range(120)]
    clauses = [(3000 + i, f"s{i} t{i}. q{i}") for i in range(30)] + [(3100, " ".join(f"s{i} t{i}." for i in range(30)))]
    many = [*rows, *inside, *clauses, inside[5], (None, inside[7][1]), (None, None), (4000, ""), (4001, " \n")]
    got = {(r["doc_id"], r["kept_text"], tuple((x["start"], x["end"], x["words"]) for x in r["removed"])) for r in linededup.deduplicated(make(many), min_words=least, whole=True).collect()}
    want = brute_windows(many, least)
    spans = {(i, t): want.get((i, t), []) for i, t in many}
    assert got == {(i, t and without(t, s), tuple((a, b, len(WORD.findall(t[a:b]))) for a, b in s)) for (i, t), s in spans.items()}
    if least == 50:
        assert sum(map(bool, want.values())) > 150 and not want[clauses[-1]]
        units = brute_spans(many)
        assert units[clauses[-1]] and not any(units[d] for d in inside if d[1] not in inside[7][1])


@pytest.mark.parametrize("least", [51, 60, 120])
def test_planted_passages_by_the_query(spark, make, tmp_path, least):
    """Passages at any word of texts of shuffled words, as the check plants them: every later copy loses all of it, clean texts nothing; rows as by plain Python and by SQL."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(least)
    pick = lambda n: [rng.choice(["ä", "B", ""]) + f"w{rng.randrange(500)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    space = lambda words: "".join(w + rng.choice(" \t\n") for w in words)
    first, later, clean = [], [], [(3000 + i, space(pick(rng.randrange(200)))) for i in range(30)]
    for i in range(20):
        passage = pick(least)
        first.append((1000 + i, space([*pick(rng.randrange(90)), *passage, *pick(rng.randrange(90))])))
        later += [(2000 + 2 * i + c, space([*pick(rng.randrange(90)), *(w.upper() if c and w.isascii() else w for w in passage), *pick(rng.randrange(90))])) for c in (0, 1)]
    rows = [*first, *later, *clean, (4000, later[3][1]), (4001, None), (4002, ""), (4003, " \n")]
    make(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["op9_passage_dedup"](spark, str(tmp_path)).collect()}
    want = brute_windows(rows, 50)
    assert {(r[0], r[3]) for r in got} == {(i, ",".join(f"{a}:{b}" for a, b in want.get((i, t), []))) for i, t in rows}
    words = {r[0]: r[2] for r in got}
    assert all(words[i] >= least for i, _ in later) and not any(words[i] for i, _ in [*first, *clean])
    assert got == set(duckdb.sql(ORACLE_SQL["op9_passage_dedup"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()) and len(got) == len(rows)
