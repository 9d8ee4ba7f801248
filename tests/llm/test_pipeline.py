"""The pipeline's stages on the supplied tables and on odd documents."""

import corpus_pipeline
import pytest


def stages(spark, folder, tmp_path, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for stage, apply in corpus_pipeline.STAGES:
        apply(spark, kept[-1], folder).write.parquet(str(tmp_path / name / stage))
        kept.append(spark.read.parquet(str(tmp_path / name / stage)))
    return kept


def test_stages_and_reruns(spark, sf_dir, tmp_path):
    docs, language, simhash, clean, mixed, files = stages(spark, sf_dir, tmp_path, "a")
    for stage in (language, simhash, clean, mixed):
        assert stage.columns == docs.columns
    ids = [{r["doc_id"] for r in stage.select("doc_id").collect()} for stage in (docs, language, simhash, clean, mixed)]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:]))
    assert len(ids[3]) < len(ids[0]) < 2 * len(ids[3])
    rows = files.orderBy("start").collect()
    assert len(rows) == mixed.count() and {r["doc_id"] for r in rows} == ids[4]
    assert [r["start"] for r in rows[1:]] == [r["start"] + r["n_tokens"] for r in rows[:-1]]
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, sf_dir, odd_docs, tmp_path, empty):
    docs = odd_docs.limit(0) if empty else odd_docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert (found.count() == 0) or not empty
