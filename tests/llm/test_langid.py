import zlib

from kinsheet.llm import langid, queries


def test_held_out_accuracy(spark, sf_dir, documents):
    found = queries.op5_language(spark, sf_dir).collect()
    truth = {r["doc_id"]: r for r in documents.collect()}
    assert len(found) == len(truth)
    right = []
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == truth[r["doc_id"]]["lang"])
    assert len(right) > 30 and sum(right) / len(right) > 0.97


def test_odd_rows(odd_docs, odd_rows, documents):
    model = langid.fit(documents)
    found = langid.predict(odd_docs, model).collect()
    assert len(found) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in found}
    for i in (5, 6, 7, 13):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0, True)
    assert by_id[12]["lang_pred"] in model.languages
    kept = langid.keep_known(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert {5, 6, 7, 13}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_clean_documents_stay(documents):
    assert langid.keep_known(documents, langid.fit(documents)).count() == documents.count()


def test_far_texts_are_rejected(spark, documents):
    model = langid.fit(documents)
    model.floor = model.floor.clip(min=0.2)
    odd = spark.createDataFrame([(1, "Ж щ ъ ы э ю я " * 50), (2, "zzqx xqzj " * 90)], "doc_id long, text string")
    assert all(r["rejected"] for r in langid.predict(odd, model).collect())


def test_nothing_to_learn(no_docs, odd_docs):
    model = langid.fit(no_docs)
    assert langid.predict(no_docs, model).count() == 0
    found = langid.predict(odd_docs, model).collect()
    assert {r["lang_pred"] for r in found} == {"und"} and all(r["rejected"] for r in found)
    # odd rows as the lesson: one language with few texts each
    assert langid.fit(odd_docs).languages


def test_fitted_floors_reject_in_every_class(spark, documents):
    """Also short and very long texts, and with a language of few texts among the others."""
    rare = spark.createDataFrame(
        [(10**6 + i, "kua mwana wetu jambo habari " * (20 + i), "sw") for i in range(5)],
        "doc_id long, text string, lang string",
    )
    lesson = documents.select("doc_id", "text", "lang").union(rare)
    model = langid.fit(lesson)
    assert "sw" in model.languages and model.floor.min() > 0
    far = [(n, ("Жщъыэюя Ћђљњџѓќ " * 1000)[: n]) for n in (40, 150, 600, 3000, 16_000)]
    odd = spark.createDataFrame(far, "doc_id long, text string")
    assert all(r["rejected"] for r in langid.predict(odd, model).collect())
    good = documents.where("text IS NOT NULL").selectExpr("doc_id", "explode(array(8, 30, 100, 400)) n", "text")
    good = good.selectExpr("doc_id", "substring(text, 1, n) AS text")
    found = langid.predict(good, model).collect()
    assert sum(r["rejected"] for r in found) < 0.01 * len(found)
    assert langid.keep_known(lesson, model).count() == lesson.count()
