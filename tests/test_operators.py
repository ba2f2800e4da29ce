import math
import random

import pytest
from pauta.components import components
from pauta.operators import anonymize, errors, gold, metrics, ml, qa, splits, validate
from pauta.sources import mime, readers, writers
from pauta.streaming import mails as stream
from pyspark.sql import functions as F

LABELS = ["agendamento_reuniao", "cancelamento_reuniao", "nao_reuniao", "reuniao_confirmada"]


def test_classification_numbers(spark):
    # a published confusion matrix: 2,000 cases, three errors in one pair
    counts = {(a, a): 600 for a in LABELS if a != "nao_reuniao"} | {("nao_reuniao", "nao_reuniao"): 197, ("nao_reuniao", "agendamento_reuniao"): 3}
    rows = [p for p, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "true_label string, predicted_label string")
    s = metrics.summary_metrics(df).first()
    assert s["rows"] == 2000 and math.isclose(s["accuracy"], 0.9985)
    assert math.isclose(s["macro_f1"], 0.997487, abs_tol=1e-3) and math.isclose(s["weighted_f1"], 0.998496, abs_tol=1e-4)
    m = {(r["true_label"], r["predicted_label"]): r["n"] for r in metrics.confusion(df).collect()}
    assert len(m) == 16 and m[("nao_reuniao", "agendamento_reuniao")] == 3 and sum(m.values()) == 2000
    e = {(r["kind"], r["key"]): r["n"] for r in metrics.error_analysis(df).collect()}
    assert e[("total", "")] == 3 and e[("pair", "nao_reuniao -> agendamento_reuniao")] == 3
    wide = writers.confusion_wide(metrics.confusion(df))
    assert wide.columns[0] == "true\\predicted" and wide.count() == 4


def test_empty_and_null_labels(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "true_label string, predicted_label string")
    s = metrics.summary_metrics(df).first()
    assert s["rows"] == 1 and s["accuracy"] == 0
    assert metrics.summary_metrics(df.limit(0)).first()["accuracy"] == 0
    assert metrics.error_analysis(df.limit(0)).first()["n"] == 0


def test_votes_and_pairs(spark):
    df = spark.createDataFrame([("a", "b", "b"), ("a", "b", "c"), ("a", "a", "c")], "x string, y string, z string")
    assert [r["v"] for r in df.select(metrics.vote("x", "y", "z").alias("v")).collect()] == ["b", "a", "a"]
    g = spark.createDataFrame([(["Ana Silva", "sala 2"], ["sala 2", "ana silva", "rua"])], "g array<string>, p array<string>")
    got = g.select(F.explode(metrics.pair_spans(F.col("g"), F.col("p"))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("sala 2", "sala 2", "exact"), ("Ana Silva", "ana silva", "exact"), (None, "rua", "none")]


def test_answer_scores(spark):
    rows = [("sexta às 15h", "sexta às 15h"), ("", ""), (None, "a"), ("a b", "b c"), ("x", "y")]
    df = spark.createDataFrame(rows, "p string, r string").select(metrics.token_scores(F.col("p"), F.col("r")).alias("s")).select("s.*")
    assert [(r["exact"], r["f1"]) for r in df.collect()] == [(1, 1), (1, 1), (0, 0), (0, 0.5), (0, 0)]
    cases = [("", "a", 0.1, "LOW_CONFIDENCE"), ("", "a", 0.9, "EMPTY_ANSWER"), ("Sala 2", "sala 2", 0.9, "EXACT_MATCH"), ("Marte", "sala 2", 0.9, "HALLUCINATION"), ("sala", "sala 2", 0.9, "TRUNCATION"), ("na sala", "sala 2", 0.9, "PARTIAL_MATCH"), ("ana", "sala 2", 0.9, "WRONG_ANSWER")]
    df = spark.createDataFrame([(p, r, c) for p, r, c, _ in cases], "p string, r string, c double")
    got = df.select(metrics.answer_error(F.col("p"), F.col("r"), F.col("c"), F.lit("a ana vai na sala 2")).alias("e")).collect()
    assert [r["e"] for r in got] == [c[3] for c in cases]
    j = spark.createDataFrame([("", ""), ("abc", "abd"), ("a", "")], "a string, b string").select(metrics.char_jaccard(F.col("a"), F.col("b")).alias("j"), metrics.overlap_ratio(F.col("a"), F.col("b")).alias("o")).collect()
    assert [(r["j"], round(r["o"], 3)) for r in j] == [(1.0, 1.0), (0.5, 0.667), (0.0, 0.0)]


def test_topic_metrics(spark):
    df = spark.createDataFrame([("plano anual", "plano anual"), ("plano anual", "plano"), ("obras", ""), ("", "x"), (None, None)], "gold string, predicted string")
    r = metrics.topic_metrics(df).first()
    assert (r["cases"], r["missed"], r["spurious"], r["different"]) == (5, 1, 1, 1)
    assert math.isclose(r["token_f1"], (1 + 2 / 3 + 0) / 3) and math.isclose(r["detection_f1"], 2 / 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)] + [(300, x) for x in range(301, 340)]
    got = {r["id"]: r["group_id"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(300, 340)} == {300} and 200 not in got


def test_splits(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("l"), (F.col("id") % 3 == 0).cast("string")).alias("label"))
    out = splits.stratified_split(df, "id", "label")
    counts = {(r["label"], r["part"]): r["count"] for r in out.groupBy("label", "part").count().collect()}
    assert counts == {("lfalse", "test"): 134, ("lfalse", "train"): 532, ("ltrue", "test"): 67, ("ltrue", "train"): 267}
    assert out.count() == 1000 and splits.per_label_sample(df, "id", "label", 10).count() == 20
    assert {r["fold"] for r in splits.folds(df, "id", "label").collect()} == {0, 1, 2, 3, 4}
    g = splits.group_split(df.withColumn("g", F.col("id") % 50), "g", [("train", 0.8), ("test", 0.2)])
    assert g.groupBy("g").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"agendamento_reuniao": "marcar agenda horario", "cancelamento_reuniao": "cancelar adiar lamento", "nao_reuniao": "fatura envio anexo", "reuniao_confirmada": "confirmo presenca combinado"}
    rows = [(i * 4 + k, f"{w.split()[i % 3]} {w.split()[(i + 1) % 3]} assunto {i % 5}", label) for i in range(25) for k, (label, w) in enumerate(words.items())]
    return spark.createDataFrame(rows, "id bigint, text string, label string")


@pytest.mark.parametrize("kind", ["logistic_regression", "naive_bayes", "decision_tree"])
def test_models(spark, labelled, kind, tmp_path):
    from pyspark.ml import PipelineModel

    model = ml.fit(labelled, kind, size=100)
    p = ml.predict(model, labelled.union(spark.createDataFrame([(999, None, None)], labelled.schema)), "id")
    got = labelled.join(p, "id")
    assert got.where("label <> predicted_label").count() <= 5 and p.count() == 101
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-6 for r in p.collect())
    model.write().overwrite().save(str(tmp_path / kind))
    again = ml.predict(PipelineModel.load(str(tmp_path / kind)), labelled, "id").drop("probabilities")
    assert again.exceptAll(p.drop("probabilities")).count() == 0


def test_model_tables(spark, labelled):
    table = ml.naive_bayes_table(labelled, "id", "text", "label", size=50)
    tops = {r["label"]: r["term"] for r in ml.top_terms(table, 1).collect()}
    assert tops["nao_reuniao"] in "fatura envio anexo assunto"
    norms = ml.tfidf(labelled, "id", "text", 50).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert norms.where("abs(n - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        ml.fit(labelled.limit(0), "naive_bayes")
    assert ml.leaked_texts(labelled, labelled.limit(3)).count() >= 1
    assert ml.cross_validate(labelled, "naive_bayes", "id", k=2).count() == 2
    both = ml.consensus({k: ml.predict(ml.fit(labelled, "naive_bayes", size=100), labelled, "id") for k in ("lr", "nb", "dt")}, "id")
    assert both.where("intent <> lr").count() == 0


def test_models_together(spark, labelled):
    models = ml.fit_all(labelled, ["logistic_regression", "naive_bayes", "decision_tree"], size=100)
    apart = {k: {r["id"]: r["predicted_label"] for r in ml.predict(m, labelled, "id").collect()} for k, m in models.items()}
    both = ml.predict_all(models, labelled, "id").collect()
    assert all(r[k]["predicted_label"] == apart[k][r["id"]] for r in both for k in models)
    rows = {r["model"]: r for r in ml.evaluate(models, labelled, "id").collect()}
    right = {r["id"]: r["label"] for r in labelled.collect()}
    for k in models:
        assert rows[k]["rows"] == 100 and math.isclose(rows[k]["accuracy"], sum(right[i] == p for i, p in apart[k].items()) / 100)
    top = ml.top_labels(ml.predict(models["naive_bayes"], labelled, "id"), "id", 2).collect()
    assert len(top) == 200 and all(r["label"] == apart["naive_bayes"][r["id"]] for r in top if r["rank"] == 1)
    terms = [r["term"] for r in ml.feature_importance(models["decision_tree"], 5, spark).collect()]
    assert terms and all("assunto 0" != t for t in terms)


def test_folds_and_grid(spark, labelled):
    folds = ml.cross_validate(labelled, "naive_bayes", "id", k=2)
    summary = {r["metric"]: (r["mean"], r["std"]) for r in ml.fold_summary(folds).collect()}
    got = [r["accuracy"] for r in folds.collect()]
    assert set(summary) == set(ml.FOLD_METRICS) and math.isclose(summary["accuracy"][0], sum(got) / 2)
    grid = ml.grid_search(labelled, "naive_bayes", "id", [{"smoothing": 1.0}, {"smoothing": 1000.0}], k=2).collect()
    assert [r["rank"] for r in grid] == [1, 2] and grid[0]["mean"] >= grid[1]["mean"]


GOLD = readers.GOLD


def test_validation(spark):
    rows = [
        (1, "t", "agendamento_reuniao", ["agendar"], (["Ana"], ["hoje"], [], None), {"time": 0.9}, None),
        (2, " ", "x", [], None, None, None),
        (3, "t", "", None, (["", "Ana"], None, None, None), None, None),
        (3, "u", "reuniao_confirmada", ["cancelar"], ([], [], [], []), None, None),
    ]
    df = spark.createDataFrame(rows, GOLD)
    got = {(r["id"], r["rule"]) for r in validate.validate_annotations(df).collect()}
    assert {(2, "missing_text"), (2, "unknown_intent"), (2, "missing_arguments"), (2, "empty_trigger"), (3, "missing_intent"), (3, "blank_participants"), (3, "duplicate_id"), (1, "no_topic")} <= got
    assert (1, "unknown_intent") not in got and (1, "duplicate_id") not in got
    assert [r["id"] for r in validate.trigger_mismatch(df).collect()] == [3]
    n = {r["text"]: r for r in validate.normalize_annotation(df).collect()}
    assert n[""]["arguments"]["time"] == [] and n["t"]["trigger"] is not None
    with pytest.raises(ValueError, match="reuniao_confirmada"):
        validate.require_labels(spark.createDataFrame([(x,) for x in LABELS[:3]], "label string"))


def test_fallbacks(spark):
    base = {"id": 1, "subject": "Obras", "body": "Reunião sexta às 15h na sala 3", "label": "agendamento_reuniao", "sender": "Ana", "location": None, "sent_datetime": "2026-04-21T10:00:00"}
    cases = [
        base,
        base | {"id": 2, "body": "Pode ser sexta às 15h ou segunda às 10h?"},
        base | {"id": 3, "label": "nao_reuniao"},
        base | {"id": 4, "body": "Vamos combinar", "label": None},
        base | {"id": 5, "body": "Texto", "label": "", "subject": None, "sender": None},
        base | {"id": 6, "location": "via Zoom", "body": "Hoje"},
    ]
    for c in cases:
        c |= {f"{k}_answer": None for k in qa.QUESTIONS} | {f"{k}_confidence": 0.0 for k in qa.QUESTIONS}
    cases[1]["time_answer"], cases[1]["time_confidence"] = "segunda às 10h", 0.8
    schema = ", ".join(f"{k} {'bigint' if k == 'id' else 'double' if k.endswith('confidence') else 'string'}" for k in base)
    df = spark.createDataFrame([tuple(c[k] for k in base) for c in cases], schema)
    r = {x["id"]: x for x in qa.apply_fallbacks(df).collect()}
    assert (r[1]["participants"]["answer"], r[1]["time"]["answer"], r[1]["time_normalized"]["answer"]) == ("Ana", "sexta às 15h", "2026-04-24T15:00:00")
    assert (r[1]["location"]["answer"], r[1]["location"]["fallback_source"]) == ("presencial - sala 3", "fallback_explicit_location")
    assert (r[1]["topic"]["answer"], r[1]["topic"]["confidence"]) == ("Obras", 0.65)
    assert (r[2]["time"]["answer"], r[2]["time"]["fallback_source"], r[2]["time"]["confidence"]) == ("segunda às 10h", "qa_temporal_alignment", 0.8)
    assert (r[3]["time"]["fallback_source"], r[3]["location"]["fallback_source"]) == ("non_meeting_no_time", "non_meeting_no_location")
    assert (r[4]["time"]["fallback_source"], r[4]["location"]["answer"]) == ("no_explicit_temporal_expression", "remoto - zoom")
    assert (r[5]["participants"]["answer"], r[5]["location"]["answer"], r[5]["topic"]["valid"]) == (None, None, False)
    assert r[6]["location"]["answer"] == "remoto - zoom" and r[6]["location"]["confidence"] == 0.9


def test_qa_examples(spark):
    df = spark.createDataFrame([(1, "Com Ana hoje", "x", [], (["Ana"], ["hoje"], None, []), None, None)], GOLD)
    got = {r["category"]: (r["answer"], r["answer_start"], r["is_impossible"]) for r in qa.qa_examples(df).collect()}
    assert got == {"participants": ("Ana", 4, False), "time": ("hoje", 8, False), "location": ("", -1, True), "topic": ("", -1, True)}
    assert qa.by_context(qa.qa_examples(df)).first()["qas"][0]["category"] == "location"
    assert qa.questions(df.withColumnRenamed("text", "context")).count() == 4
    c = spark.range(1).select(qa.enriched(F.lit("b"), F.lit("s"), F.lit("<a@x>")).alias("c")).first()["c"]
    assert c.startswith("b\n\nInformacao auxiliar:\nAssunto: s\nRemetente: a@x")


RAW = b"""From: =?utf-8?q?Jo=C3=A3o?= <j@x.pt>\r\nTo: a@x.pt\r\nSubject: =?utf-8?b?UmV1bmnDo28=?=\r\nDate: Fri, 24 Jul 2026 10:30:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Ol&aacute;</p><script>x</script>\r\n--b--\r\n"""


def test_mime(spark, tmp_path):
    (tmp_path / "1.eml").write_bytes(RAW)
    (tmp_path / "2.eml").write_bytes(b"Subject: sem data\n\ncorpo\n")
    got = {r["email_id"]: r for r in mime.read_folder(spark, str(tmp_path)).collect()}
    a, b = got["1.eml"], got["2.eml"]
    assert (a["subject"], a["body"], a["sent_datetime"], a["sender"]) == ("Reunião", "Olá", "2026-07-24T10:30:00+01:00", "João <j@x.pt>")
    assert (b["subject"], b["body"], b["sent_datetime"], b["cc"]) == ("sem data", "corpo", None, None)
    rows = mime.parse_messages(spark.createDataFrame([("x", None)], "email_id string, content binary")).collect()
    assert rows[0]["email_id"] == "x" and rows[0]["subject"] is None


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"id": 1, "subject": "s", "body": "b", "label": "x"}, {"id": 2, "subject": null, "body": "", "label": "x"}, {"id": 3, "body": "b", "label": ""}]')
    df = readers.json_array(spark, str(p))
    kept, bad = readers.valid_mails(df)
    assert ([r["id"] for r in kept.collect()], sorted(r["id"] for r in bad.collect())) == ([1], [2, 3])
    assert readers.strict_array(spark, str(p)).count() == 3
    (tmp_path / "o.json").write_text('{"id": 1}')
    assert readers.json_array(spark, str(tmp_path / "o.json")).count() == 1
    with pytest.raises(ValueError):
        readers.strict_array(spark, str(tmp_path / "o.json"))
    (tmp_path / "c.json").write_text('{"description": "d", "cases": [{"id": "1", "split": "dev", "subject": "s", "body": "b", "label": "l", "gold_topic": ""}]}')
    assert readers.topic_cases(spark, str(tmp_path / "c.json"), "dev").count() == 1
    with pytest.raises(ValueError):
        readers.topic_cases(spark, str(tmp_path / "c.json"), "holdout")
    (tmp_path / "k.json").write_text('{"1": {"a": "x"}, "z": {"a": "y"}}')
    assert [tuple(r) for r in readers.keyed_predictions(spark, str(tmp_path / "k.json"), "struct<a:string>").select("id", "value.a").collect()] == [(1, "x")]
    assert [r["id"] for r in readers.last_n(df, "id", 2).collect()] == [2, 3]
    assert writers.pretty_array(df, str(tmp_path / "out.json")) == 3
    writers.json_lines(df, str(tmp_path / "l"))
    assert readers.json_lines(spark, str(tmp_path / "l"), readers.MAIL).count() == 3
    writers.csv(df.select("id", "label"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "label"]
    nested = df.select(F.struct(F.lit(1).alias("x"), F.struct(F.lit(2).alias("y")).alias("z")).alias("s"))
    assert writers.flat(nested).columns == ["s_x", "s_z_y"]
    assert writers.markdown(df.select("id").orderBy("id")).splitlines()[2] == "| 1 |"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"m{i % 40}", "2026-07-05T10:20:30", f"2026-07-0{5 + i // 60} 1{i % 6}:00:00") for i in range(120)]
    df = spark.createDataFrame(rows, "email_id string, sent_datetime string, at string").selectExpr("email_id", "sent_datetime", "cast(at as timestamp) as imported_at")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    src = stream.read(spark, str(tmp_path / "in"), "email_id string, sent_datetime string, imported_at timestamp")
    q = stream.delays(src).writeStream.format("memory").queryName("delays").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("delays").exceptAll(stream.delays(df)).count() == 0 and spark.table("delays").count() == 120
    q = stream.once_each(src).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 40
    q = stream.hourly_counts(src).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination(120)
    batch = df.groupBy(F.date_trunc("hour", "imported_at").alias("hour")).count()
    assert spark.table("hours").exceptAll(batch).count() == 0


def test_gold_from_metadata(spark):
    schema = "id bigint, subject string, body string, label string, participants array<string>, sender string, recipient string, date string, time_expression string, topic string"
    rows = [
        (1, "Obras", "Reunião amanhã no Zoom, com Rita Alves", "agendamento_reuniao", ["Ana Sá"], "Dr. Rui Gil", "ana sá", "Tue, 21 Apr 2026 10:00:00 +0100", "Amanhã", "obras"),
        (2, "Obras", "nada", "agendamento_reuniao", None, None, None, None, "amanhã", "verbas"),
        (3, "Obras amanhã", None, "nao_reuniao", [], None, None, None, "amanhã", "obras"),
    ]
    df = spark.createDataFrame(rows, schema)
    people = lambda t: [(t.index("com Rita"), t.index("com Rita") + 14)] if "com Rita" in t else []
    got = {r["dataset_id"]: r["arguments"] for r in gold.gold_from_metadata(df).collect()}
    assert (got[1]["time"], got[1]["time_normalized"], got[1]["topic"]) == (["Amanhã"], ["2026-04-22"], ["obras"])
    assert got[1]["participants"] == ["Ana Sá", "Dr. Rui Gil"] and got[1]["location"] == ["remoto - zoom"]
    assert (got[2]["time"], got[2]["topic"], got[2]["participants"]) == ([], [], [])
    assert (got[3]["time"], got[3]["topic"], got[3]["location"]) == ([], [], [])
    assert "com Rita Alves" in gold.gold_from_metadata(df, people).where("dataset_id = 1").first()["arguments"]["participants"]
    assert [gold.participant_name(x) for x in ("Olá Ana Sá,", "Ana", "Enviado do Outlook", "Prof. Ana", "Exma. Dra. Rita Gil", None)] == ["Ana Sá", None, None, None, "Dra. Rita Gil", None]
    t = {r["id"]: r for r in gold.gold_from_text(df).collect()}
    assert t[3]["text"] == "Obras amanhã" and t[3]["arguments"]["time"] == ["amanhã"] and t[2]["trigger"] == ""


def test_answers(spark):
    one = spark.range(1)
    best = lambda p, rs: one.select(metrics.best_reference(F.lit(p), F.lit(rs) if rs is None else F.array(*[F.lit(r) for r in rs])).alias("b")).first()["b"]
    assert best("sala 3", ["sala", "sala 3", "Sala 3"])["reference"] == "sala 3"
    assert best("ana sá", ["rui", "ana"])["reference"] == "ana" and best("x", ["a", "b"])["reference"] == "a"
    assert best("x", None)["exact"] == 0.0
    spans = F.expr("array(struct('Ana' as text, 0.5D as confidence), struct(' ' as text, 0.1D as confidence), struct(' Rui ' as text, 1.0D as confidence))")
    a = one.select(metrics.category_answer(spans).alias("a"), metrics.category_answer(F.slice(spans, 2, 1)).alias("b")).first()
    assert (a["a"]["answer"], a["a"]["confidence"], a["a"]["valid"]) == ("Ana; Rui", 0.75, True) and (a["b"]["answer"], a["b"]["confidence"], a["b"]["valid"]) == (None, 0.0, False)
    rows = spark.createDataFrame([(i, "time", "p", "r", float(i == 3), i / 10) for i in range(9, 0, -1)], "id bigint, category string, predicted string, reference string, exact double, f1 double")
    assert [r["id"] for r in errors.worst_answers(rows).collect()] == [1, 2, 4, 5, 6]


def test_best_span_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        n = rng.randint(1, 30)
        rows.append((i, [rng.gauss(0, 3) for _ in range(n)], [rng.gauss(0, 3) for _ in range(n)], [rng.random() < 0.7 for _ in range(n)]))
    rows.append((99, None, None, None))
    df = spark.createDataFrame(rows, "id int, s array<double>, e array<double>, c array<boolean>")
    got = {r["id"]: r["b"] for r in df.select("id", qa.best_span(F.col("s"), F.col("e"), F.col("c"), 5).alias("b")).collect()}
    assert got[99] is None
    for i, s, e, c in rows[:-1]:
        pairs = [(s[a] + e[b], a, b) for a in range(len(s)) for b in range(a, min(a + 5, len(s))) if c[a] and c[b]]
        if sum(c) and len(s) <= 20:
            assert (got[i]["first"], got[i]["last"]) == max(pairs)[1:]
            z = [sum(math.exp(v) for v, k in zip(x, c) if k) for x in (s, e)]
            assert math.isclose(got[i]["score"], math.sqrt(math.exp(s[got[i]["first"]]) / z[0] * math.exp(e[got[i]["last"]]) / z[1]))


def test_questions_in_other_words(spark):
    df = spark.range(200).select("id", F.lit("t").alias("context"))
    rows = qa.asked(df).collect()
    assert len(rows) == 800 and all(r["question"] in [qa.QUESTIONS[r["category"]], *qa.VARIATIONS[r["category"]]] for r in rows)
    assert len({r["question"] for r in rows}) == sum(1 + len(v) for v in qa.VARIATIONS.values())
    assert all(r["question"] != qa.QUESTIONS[r["category"]] for r in qa.asked(df, main=False).collect())


def test_report_columns(spark, labelled):
    models = ml.fit_all(labelled, ["naive_bayes"], size=100)
    folds = ml.fold_summary(ml.cross_validate(labelled, "naive_bayes", "id", k=2)).withColumn("model", F.lit("naive_bayes"))
    out = writers.summary_rows(ml.evaluate(models, labelled, "id"), folds)
    r = out.first()
    assert out.columns == writers.SUMMARY_COLUMNS and r["cv_f1_macro_mean"] is not None and r["train_seconds"] is None
    assert ml.choose_folds(labelled, "label", 40) == 25 and ml.choose_folds(labelled.limit(0), "label", 5) == 0
    table = writers.latex(spark.createDataFrame([("a_b", 0.5)], "x string, y double"))
    assert r"a\_b & 0.5000 \\" in table
    answers = spark.createDataFrame([(1, None, ("Ana",), (None,), ("Zoom",), None)], "id int, subject string, participants struct<answer:string>, time struct<answer:string>, location struct<answer:string>, topic struct<answer:string>")
    assert tuple(writers.classic_rows(answers).first()) == (1, "", "Ana", "", "Zoom", "")


def test_mail_dates(spark):
    from pauta.functions.temporal import mail_reference

    rows = [
        ("Tue, 21 Apr 2026 10:00:05 +0100", None, "2026-04-21 10:00:05"),
        ("1 Jan 2026 9:05 GMT (x)", None, "2026-01-01 09:05:00"),
        ("sem data", "2026-04-21T10:00:00Z", "2026-04-21 10:00:00"),
        ("Mon, 31 Feb 2026 10:00:00 +0000", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, email_date string, timestamp string, want string")
    got = {r["i"]: r["r"] for r in df.select("i", mail_reference(df.columns).cast("string").alias("r")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[2] for r in rows]


def test_sequential_split(spark):
    ids = [5, 9000, 4096, 4095, 7, None, 123456, 8]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r["id"]: r["part"] for r in splits.sequential_split(df, "id", 0.5).collect()}
    assert {i for i, p in got.items() if p == "train"} == {5, 7, 8, 4095}
    assert splits.sequential_split(df.limit(0), "id").collect() == []


def test_anonymize_only_what_is_pending(spark):
    df = spark.createDataFrame([(1, "Escreva a ana@x.pt"), (2, "nada")], "id bigint, body string")
    once = anonymize.anonymize(df, ["body"])
    both = anonymize.anonymize_pending(once.unionByName(df.withColumn("id", F.col("id") + 10).withColumn("anonymization", F.lit(None).cast(once.schema["anonymization"].dataType))), ["body"])
    got = {r["id"]: r["body"] for r in both.collect()}
    assert got == {1: "Escreva a [EMAIL_1]", 11: "Escreva a [EMAIL_1]", 2: "nada", 12: "nada"}
    assert tuple(anonymize.anonymized_rows(both).first()) == (4, 4) and tuple(anonymize.anonymized_rows(df).first()) == (2, 0)
