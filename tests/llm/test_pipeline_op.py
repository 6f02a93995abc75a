import os

import corpus_pipeline
import pytest
from corpus_helpers import shingle_set, words
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sigspark.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        df = stage(spark, docs, SF)
        if name != "mixing":
            assert df.dtypes == docs.dtypes
        df.write.parquet(path)
        out.append((name, docs.toPandas(), spark.read.parquet(path).toPandas()))
        docs = spark.read.parquet(path)
    return {name: (before, after) for name, before, after in out}


def test_order(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "mixing"]


def test_toxicity_goes_and_the_rest_stays(spark, stages):
    before, after = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(before.doc_id) - set(after.doc_id)
    toxic, clean = {i for i, y in labels.items() if y}, {i for i, y in labels.items() if not y}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone & clean) <= 0.02 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    kept = dict(zip(after.doc_id, after.text))
    sets = {i: shingle_set(t, 5) for i, t in zip(before.doc_id, before.text)}
    by = {}
    for i in kept:
        by.setdefault(sets[i], []).append(i)
    assert all(len(v) == 1 for s, v in by.items() if s)
    inverted = {}
    for i in kept:
        for x in sets[i]:
            inverted.setdefault(x, []).append(i)
    for i, s in sets.items():  # what went has a near copy that stayed or that went with it
        if i not in kept:
            assert any(j != i and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]) for j in sets)
    for i in kept:
        near = {j for x in sets[i] for j in inverted[x] if j != i}
        assert not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in near)


def test_passages_stand_once(stages):
    before, after = stages["substring_dedup"]
    where = {}
    for i, t in sorted(zip(after.doc_id, after.text)):
        w = words(t)
        for k in range(len(w) - 51):
            where.setdefault(tuple(w[k : k + 52]), set()).add(i)
    assert max(map(len, where.values())) == 1
    first = dict(zip(before.doc_id, before.text))
    same = sum(first[i] == t for i, t in zip(after.doc_id, after.text))
    assert same >= 0.9 * len(after) and (after.n_chars == after.text.str.len()).all()


def test_no_benchmark_item_is_left(spark, stages):
    before, after = stages["decontamination"]
    items = [f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = lambda t: any(x in f" {' '.join(words(t))} " for x in items)
    assert not any(map(leaky, after.text))
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert sum(map(leaky, gone.text)) >= 0.8 * len(gone) > 0


def test_mix_takes_the_share(stages):
    before, after = stages["mixing"]
    assert sorted(after.doc_id) == sorted(before.doc_id) and (after.taken <= 2 * after["size"]).all()
    assert abs(after.taken.sum() - 1.5 * after["size"].sum()) < 16 * 60


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    want = stages["mixing"][1]
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(want.doc_id, want.taken))


def test_odd_rows(spark, odd_documents, tmp_path):
    spark.createDataFrame([(4, 1), (6, 0), (7, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for turn, docs in enumerate((odd_documents, odd_documents.limit(0))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{turn}-{k}")
            df = stage(spark, docs, str(tmp_path))
            assert name == "mixing" or df.columns == docs.columns
            df.write.parquet(path)
            docs = spark.read.schema(df.schema).parquet(path)
        assert docs.where(F.col("doc_id") == 6).count() <= 1


def test_registered():
    queries = entry.queries()
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in queries) == 1 for n in names) and queries["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and toxicity and os.path.exists(corpus_pipeline.__file__)
