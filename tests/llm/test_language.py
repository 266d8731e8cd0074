"""Operator 10: held-out accuracy, and odd rows."""

import zlib

import pytest

from ledgerprep.llm import language

GIVEN = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(GIVEN)


@pytest.fixture(scope="module")
def model(given):
    return language.train(given)


def test_held_out_accuracy(spark, given, model):
    found = language.predict(given, model).select("row.doc_id", "row.lang", "lang_pred", "score", "rejected").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in found) <= 0.01 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_training_is_repeatable_and_leaves_held_out_rows_alone(given, model):
    again = language.train(given.withColumn("lang", given["lang"]).repartition(7))
    assert again.languages == model.languages and (again.table == model.table).all()
    changed = given.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 4 = 2 THEN 'x' ELSE text END AS text", "CASE WHEN crc32(string(doc_id)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    third = language.train(changed)
    assert third.languages == model.languages and (third.table == model.table).all()


def test_odd_texts(documents, model, corpus):
    rows = [(1, None), (2, ""), (3, "123 456 !?"), (4, " \n"), (5, "Ж"), (6, "a"), (7, "²³"), (None, "the and of that"), (8, "the that and " * 20000)]
    found = {r.row.doc_id: r for r in language.predict(documents(rows, extra=True), model).collect()}
    for i in (1, 2, 3, 4, 7):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert all(found[i].lang_pred in model.languages for i in (5, 6, 8, None))
    assert found[8].lang_pred == "en" and not found[8].rejected
    assert list(found[1].row.asDict()) == documents(rows, extra=True).columns


def test_no_labels(documents):
    model = language.train(documents([(1, "some text"), (2, None)]).selectExpr("doc_id", "text", "string(null) AS lang"))
    assert model.languages == []
    assert {r.lang_pred for r in language.predict(documents([(1, "some text")]), model).collect()} == {"und"}
    assert language.predict(documents([]), model).collect() == []


def test_no_gram_crosses_texts():
    import pyarrow as pa

    one, at = language.grams(pa.array(["ab", "", None, "cd e"]))
    alone = [language.grams(pa.array([t]))[0].tolist() for t in ["ab", "", None, "cd e"]]
    assert [one[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == alone
