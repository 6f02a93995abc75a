import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigspark.llm import tokens
from sigspark.llm.queries import op9_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


with open(PATH, encoding="utf-8") as f:
    COUNTS = tokens.Counts(f.read(), {})


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aé '\n\t  s1.!<|"))))
def test_any_text(text):
    assert COUNTS(text) == library(text)


@pytest.mark.parametrize("text", ["", None, "<|endoftext|>", "a <|endoftext|>b", "don't  we'll \n\n x", " " * 50, "a" * 5000, "日本\x85語", "﻿ x", "é" * 99])
def test_special_cases(text):
    assert COUNTS(text) == library(text)


@pytest.mark.parametrize("text", ["It’s a plain “English” sentence — really…", "naïve café 🙂🏽 ok", "Πρόγραμμα и слово 日本語 テキスト", "\u200b\u2028 x\x85y\x1c z"])
def test_both_tiers_count_any_script(text):
    assert not COUNTS.whole(text) and COUNTS(text) == library(text)


def test_every_character():
    """Each code point in several places: the two pattern engines agree, or the text is encoded whole."""
    whole = []
    for k in range(0, 0x110000, 8192):
        cps = [c for c in range(k, k + 8192) if not 0xD800 <= c < 0xE000]
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}  {chr(c)}\n{chr(c)}'s" for c in cps]
        for c, t, e in zip(cps, texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
            whole.append(COUNTS.whole(t))
            if not whole[-1]:
                assert sum(len(p) for p in COUNTS.pieces(t)) == len(t) and [len(p) for p in COUNTS.pieces(t)] == [z - a for _, (a, z) in LIBRARY.pre_tokenizer.pre_tokenize_str(t)], hex(c)
                assert len(e.ids) > 0
    assert sum(not w for w in whole) > 280_000  # all assigned ones and those for private use


def test_frequent_pieces_come_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT", 3)
    df = spark.range(60).selectExpr("'the the the the cat' as text").union(spark.range(40).selectExpr("'the dog, the dog' as text")).repartition(7)
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    assert tokens.frequent_lengths(df, spec, "text") == {" the": 1, "the": 1, " dog": 1}


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    lengths = tokens.Lengths(LIBRARY, {"keep": 1})
    for k in range(50):
        assert lengths[f" w{k}"] == library(f" w{k}")
        assert len(lengths) <= 6 and "keep" in lengths


def test_rows(spark, odd_documents):
    rows = tokens.count_tokens(odd_documents, PATH).collect()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), library(t), library(t) > 512)
    assert tokens.count_tokens(odd_documents.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(odd_documents, "x.model")


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_token_counts(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got.collect()} == {i: (len(t.encode()), library(t)) for i, t in texts.items()}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
