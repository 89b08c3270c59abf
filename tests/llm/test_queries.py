"""Every registered query on small tables, against what its contract says of all rows."""

import zlib

import pytest

from quire.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, odd_texts):
    at = str(tmp_path_factory.mktemp("tables"))
    texts = [t[1] if isinstance(t, tuple) else t for t in odd_texts]
    texts += [f"plain text number {i} " + " ".join(f"w{i * j % 101}" for j in range(70)) + (" awful" if i % 3 == 0 else "") + f" password={i:08x}abcd" for i in range(40)]
    spark.createDataFrame([(i, t, ("en", "fr", None)[i % 3], "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("a", texts[20]), ("b", None), ("c", "w1 w2 w3")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(0, "http://a.net/es/x", None), (1, None, "<p>"), (2, "", None)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at, texts


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    at, texts = tables
    rows = QUERIES[name](spark, at).collect()
    if name == "op8_url_filter":
        assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == [(0, "a.net", "/es/x", "net/es/", "block"), (1, "", "", None, "allow"), (2, "", "", None, "allow")]
        return
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        text = texts[r["doc_id"]]
        if "held_out" in r:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if name == "op4_jump_shards":
            assert r["size"] == len((text or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text or "").encode()) and r["grown_shard"] in (r["shard"], 40)
        if name == "op7_secret_scan":
            assert r["n_assign"] == int(bool(text) and "password=" in text)
        if name == "op3_decontamination":
            assert (r["n_hit"] > 0) == r["contaminated"] and (not text or r["doc_id"] != 20 or r["n_hit"] == r["n_words"])


def test_sql_is_for_registered_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
