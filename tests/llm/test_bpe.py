import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe
from quire.llm.queries import TOKENIZER

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(TOKENIZER)


@pytest.fixture(scope="module")
def both(ranks):
    return bpe.Tokenizer(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


any_text = st.text(st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(any_text | st.text(st.sampled_from("ab '1\n　\x1c²Ⅷ日😀st"), max_size=60))
def test_as_tiktoken(both, text):
    own, other = both
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 5000, "ab" * 2000, "x1" * 3000, "日本" * 3000, "<|endoftext|>", "\n" * 70, "!" * 65, "don't 's 'LL"])
def test_long_pieces(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_a_tree_for_each_and_one_for_all(ranks):
    pairs = bpe.PairRanks(ranks)
    words = [w.encode() for w in ("ab", "the", "Entwicklung", "éléphant", "zzzzzzzz", "ciónmenteos")]
    for w in words:
        if w not in ranks:
            leaves = max(4, 1 << (len(w) - 1).bit_length())
            assert bpe.merge_many([w, w], leaves, pairs) == [tuple(bpe.merge(w, ranks))] * 2


def test_bounded_cache(ranks):
    p = bpe.Pieces(ranks, limit=10)
    for k in range(10):
        p.learn({f"word{k}{i}" for i in range(8)})
        assert len(p) <= 18


def test_tables(make, odd_texts, both):
    df = make(odd_texts)
    got = bpe.digests(df, TOKENIZER, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = both[1].encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    back = bpe.decoded(bpe.encoded(df, TOKENIZER, PATTERN), TOKENIZER, PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((r["text"] or "").encode() for r in df.collect())
    assert bpe.digests(make([]), TOKENIZER, PATTERN).count() == 0
