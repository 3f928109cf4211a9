"""The pipeline against its stages run one by one on a small folder of tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from pactlake.llm import jaccard_join, language_id, packing, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    clean = "river stone light morning garden window letter bread music paper north".split()
    rows = []
    for i in range(240):
        words = [clean[(i * 7 + j * (1 + i % 5) + j * j) % 11] + str(i % 40) for j in range(40)]
        words = [w.rstrip("0123456789") if j % 3 else w for j, w in enumerate(words)]
        if i % 6 == 0:
            words[5:5] = ["you", "idiot", "scum"]
        rows.append((i, " ".join(words), "en" if i % 2 else "xx", "s", 0))
    rows += [(1000, "", "en", "s", 0), (1001, None, "en", "s", 0), (1002, rows[1][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "jaccard_join", "packing"]


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    left = docs.where(docs.doc_id.isin([k for k, s in scores.items() if s < 0.5]))
    assert left.count() < docs.count()
    langs = {r.doc_id: r.lang_pred for r in language_id.predict(left, language_id.learn(left)).collect()}
    left = left.where(left.doc_id.isin([k for k, x in langs.items() if x != "und"]))
    kept = [r.doc_id for r in jaccard_join.jaccard_join(left).collect() if r.doc_id == r.component_id]
    left = left.where(left.doc_id.isin(kept))
    want = sorted(map(tuple, packing.pack(packing.tokenised(left, public_tokenizers.path("byte_bpe_50k.json"), ids=True), carry=("ids",)).collect()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert got == want and 0 < len(got) < docs.count()
    assert not {1000, 1001, 1002} & {r[0] for r in got}


def test_middle_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_texts_of_no_learned_language_go(spark):
    words = {"aa": "the and with this that from", "bb": "der die und nicht mit sich", "cc": "jeg har ikke noget godt hus", "dd": "zal wel graag bij ons komen"}
    rows = [(i, " ".join(words[k].split()[(i * j) % 6] for j in range(3, 20)), k) for i, k in enumerate([*words] * 40)]
    odd = [(1000, "привет мир как дела", "aa"), (1001, "日本語", None), (1002, "die und", None), (1003, "x", None)]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, df, "").collect()}
    assert kept == {i for i, _, _ in rows} | {1002}
