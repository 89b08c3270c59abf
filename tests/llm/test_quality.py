import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import quality


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def measured(text):
    m = quality.Measures(text)
    return m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab #|\n\t\x1c\x85é日"), max_size=80))
def test_measures(text):
    assert measured(text) == brute(text)


def test_query(make, odd_texts):
    good = " ".join(f"word{i} of" for i in range(60))
    junk = ["a | b | " * 30, "same words again " * 40, "SHOUT!! " + " ".join(f"LOUD{i}!!" for i in range(80)), "short"]
    df = make([*odd_texts, good, *junk])
    got = quality.judged(df).collect()
    assert len(got) == df.count()
    by_text = {r["text"]: r["doc_id"] for r in df.select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in got}
    assert rows[by_text[good]]["kept"] and not any(rows[by_text[x]]["kept"] for x in junk)
    for r in df.where("doc_id is not null").select("doc_id", "text").distinct().collect():
        row = rows[r["doc_id"]]
        if r["doc_id"] != 4:
            assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == brute(r["text"])
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns and {r["text"] for r in kept.collect()} <= {good, odd_texts[12]}


def test_order_changes_nothing(make):
    rules = tuple(reversed(quality.RULES))
    m = [quality.Measures(t) for t in ("x", "a b " * 80, " ".join(map(str, range(90))))]
    assert [quality.first_rejection(x, rules) is None for x in m] == [quality.first_rejection(x, quality.RULES) is None for x in m]
    assert quality.judged(make([])).count() == 0
