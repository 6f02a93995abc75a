import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import langid
from sigspark.llm.queries import op1_language_id

SYLLABLES = {"aa": "ka ri to mu", "bb": "schen ber ung zu", "cc": "tion eau les oi", "dd": "szcz prz owa nie", "ee": "ing the ou wh", "ff": "ça ão nh lh", "gg": "ij oe van de", "hh": "ek lar ler ya", "ii": "ssa kka yy tta"}


def text(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(s[i] for i in rng.integers(0, len(s), rng.integers(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("n_langs", [1, 2, 4, 9])
def test_held_out_accuracy(spark, n_langs):
    rng = np.random.default_rng(n_langs)
    langs = sorted(SYLLABLES)[:n_langs]
    rows = [(i, text(rng, langs[i % n_langs], int(rng.integers(8, 60))), langs[i % n_langs]) for i in range(60 * n_langs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where(f"(doc_id div {n_langs}) % 3 <> 0"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if i // n_langs % 3 == 0]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_codewords_are_apart():
    for n in (2, 3, 7, 8, 30):
        code = langid.codebook(n)
        far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(far) >= (1 if n == 2 else 2 if n == 3 else code.shape[1] // 4)


def test_mixed_text_is_ambiguous(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text(rng, ("aa", "bb")[i % 2], 40), ("aa", "bb")[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    half = spark.createDataFrame([(1, text(rng, "aa", 30) + " " + text(rng, "bb", 22)), (2, text(rng, "aa", 30))], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(half, model).collect()}
    assert got[1].score < got[2].score and not got[2].ambiguous


def test_odd_rows(spark, odd_documents):
    got = langid.predict(odd_documents, langid.train(odd_documents))
    rows = got.collect()
    assert len(rows) == odd_documents.count() and got.columns == ["doc_id", "lang_pred", "score", "ambiguous"]
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and [by[i].score for i in (1, 2, 3, 9)] == [0.0] * 4
    assert all(by[i].lang_pred in ("en", "de", "fr") for i in (4, 5, 6, 7, 8))
    empty = odd_documents.limit(0)
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_documents, None).collect()} == {"und"}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.001"
    got = op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    assert got.where(crc != F.col("held_out")).count() == 0
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held >= 0.95
