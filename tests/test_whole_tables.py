"""Queries that run over whole tables, on small ones written here."""

from pauta.operators import ml
from pauta.queries import QUERIES


def test_topics_of_all_cases(spark, tmp_path):
    rows = [
        (1, "Reunião sobre obras", "obras"),
        (2, "Reunião sobre obras – fase 2", "obras – fase 2"),
        (3, "Reunião sobre verbas", "ｖｅｒｂａｓ"),
        (4, "Olá", "“contas”"),
        (5, "Reunião de equipa", None),
    ]
    spark.createDataFrame(rows, "id bigint, subject string, gold_topic string").write.parquet(f"{tmp_path}/topic_extraction_holdout.parquet")
    got = QUERIES["topic_detection"](spark, str(tmp_path)).first()
    assert (got["cases"], got["spurious"], got["missed"]) == (5, 1, 1)


def test_terms_of_whole_mails(spark, tmp_path):
    body = " ".join(f"palavra{i:04d}" for i in range(700))
    rows = [(1, "Obras", body, "a"), (2, "Obras", "fim", "b"), (3, None, "só corpo", "b")]
    spark.createDataFrame(rows, "id bigint, subject string, body string, label string").write.parquet(f"{tmp_path}/dataset.parquet")
    weights = {(r["id"], r["term"]) for r in QUERIES["tfidf_weights"](spark, str(tmp_path)).collect()}
    assert {(1, f"palavra{i:04d}") for i in range(700)} <= weights and (3, "corpo") in weights and (1, "obras palavra0000") in weights
    table = QUERIES["naive_bayes_table"](spark, str(tmp_path)).collect()
    assert {r["term"] for r in table} == {t for _, t in weights} and {r["label"] for r in table} == {"a", "b"}


def test_only_the_classifier_is_fitted_on_a_sample(spark):
    rows = [(f"texto termo{i:03d}", "comum") for i in range(300)] + [("raro caso", "raro")]
    df = spark.createDataFrame(rows, "text string, label string")
    for kind in ("naive_bayes",):
        model = ml.fit(df, kind, fit_rows=30)
        assert model.stages[0].labels == ["comum", "raro"]
        assert {f"termo{i:03d}" for i in range(300)} <= set(model.stages[1].vocabulary)
        assert model.stages[2].numDocs == 301
        got = ml.predict(model, df.withColumn("id", df.text).where("label = 'raro'"), "id").first()
        assert set(got["probabilities"]) == {"comum", "raro"}
