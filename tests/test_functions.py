import random
import re
import unicodedata

from pauta.functions import spans as S
from pauta.functions import text as X
from pauta.operators import annotate, anonymize, arguments
from pauta.operators.triggers import trigger
from pyspark.sql import functions as F


def one(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    t = "  Olá,\n\n reunião às 15h! [x]\nCumprimentos,\nAna"
    assert one(spark, X.normalize(F.col("t")), t=t) == "Olá, reunião às 15h! x Cumprimentos, Ana"
    assert one(spark, X.clean_body(F.col("t")), t=t) == "Olá, reunião às 15h! x"
    assert one(spark, X.clean_body(F.col("t")), t="Sim. De: Rui Texto") == "Sim."
    assert one(spark, X.preprocess(F.col("t"), punctuation=True, stopwords=True), t="O Plano, de 3 dias. ATENTAMENTE, Rui") == "plano 3 dias"
    assert one(spark, X.preprocess(F.col("t")), t="ver assunto: plano") == "ver assun"
    assert one(spark, X.html_to_text(F.col("t")), t="<p>Olá&nbsp;<b>a</b> &amp; b</p><script>x()</script>") == "Olá a & b"
    for f in (X.normalize, X.clean_body, X.preprocess, X.html_to_text, X.fold_accents):
        assert one(spark, f(F.col("t")), t=None) is None
        assert one(spark, f(F.col("t")), t="") == ""


def test_accent_folding_follows_unicode(spark):
    letters = [chr(c) for c in range(0xC0, 0x180)]
    df = spark.createDataFrame([(c,) for c in letters], "c string").select("c", X.fold_accents(F.col("c")).alias("f"))
    for r in df.collect():
        plain = "".join(x for x in unicodedata.normalize("NFKD", r["c"]) if not unicodedata.combining(x))
        assert r["f"] == (plain if len(plain) == 1 and plain.isascii() else r["c"])


def test_answers(spark):
    assert one(spark, X.clean_answer(F.col("t")), t=" às  15h.,! ") == "às 15h"
    assert one(spark, X.is_empty_answer(F.col("t")), t="Nenhuma sala") is True
    assert one(spark, X.is_empty_answer(F.col("t")), t="sala 2") is False
    assert one(spark, X.first_sentence(F.col("t")), t="Sim. Não.") == "Sim"
    assert one(spark, X.without_artifacts(F.col("t")), t="sala 2 😊 Enviado do telemóvel") == "sala 2"
    assert one(spark, X.person_key(F.col("t")), t="Prof. Dr. Ana  Silva") == "ana silva"
    assert one(spark, X.unique_people(F.split("t", ",")), t="Ana Silva, ,Prof. Ana Silva,Rui") == ["Ana Silva", "Rui"]


def test_spans_against_python(spark):
    random.seed(4)
    texts = ["".join(random.choice("ab1é😅 ") for _ in range(random.randint(0, 60))) for _ in range(200)] + ["", "1"]
    for pattern in ("[a1]+", "b.", "é"):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.matches(F.col("t"), pattern).alias("m"))
        for r in df.collect():
            assert [(m["text"], m["start"], m["end"]) for m in r["m"]] == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, r["t"])]


def test_overlaps(spark):
    raw = [(0, 5), (3, 10), (0, 8), (8, 9)]
    spans = F.array(*[F.struct(F.lit("").alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(1.0).alias("confidence"), F.lit("").alias("method")) for a, b in raw])
    assert [(x["start"], x["end"]) for x in one(spark, S.earliest_longest(spans), t="")] == [(0, 8), (8, 9)]


def test_extraction(spark):
    t = "Reunião sobre o plano anual, sexta-feira às 15h na sala 3. Contacto: ana@x.pt"
    times = [x["text"].strip() for x in one(spark, arguments.time_spans(F.col("t")), t=t)]
    assert times == ["sexta-feira", "às 15h"]
    assert [x["text"] for x in one(spark, arguments.place_spans(F.col("t")), t=t)] == ["sala 3"]
    assert [x["text"] for x in one(spark, arguments.participant_spans(F.col("t")), t=t)] == ["ana@x.pt"]
    topic = one(spark, arguments.topic_spans(F.col("t"), F.col("s"), F.col("i")), t=t, s="Re: Reunião - outra coisa", i="agendamento_reuniao")
    assert [(x["text"], t[x["start"] : x["end"]]) for x in topic] == [("plano anual", "plano anual")]
    assert one(spark, arguments.topic_spans(F.col("t"), F.col("s"), F.col("i")), t=t, s="", i="nao_reuniao") == []
    assert [x["text"] for x in one(spark, arguments.topic_spans(F.col("t"), F.col("s"), F.col("i")), t="", s="Fw: Re: Reunião - obras", i=None)] == ["obras"]
    assert one(spark, arguments.canonical_place(F.col("t")), t="na sala 203") == "presencial - sala 203"
    assert one(spark, arguments.canonical_place(F.col("t")), t="via Microsoft Teams") == "remoto - teams"
    assert one(spark, arguments.canonical_place(F.col("t")), t="rua de cima") is None
    assert one(spark, trigger(F.col("t"), F.col("i")), t="Podemos agendar reunião?", i="agendamento_reuniao")["trigger"] == "agendar"
    assert one(spark, trigger(F.col("t"), F.col("i")), t="Não posso ir", i="cancelamento_reuniao") == ("nao posso", "regex")
    assert one(spark, trigger(F.col("t"), F.col("i")), t="  ", i="cancelamento_reuniao") is None
    a = one(spark, annotate.annotation(F.col("t")), t="Olá Rui, marcar reunião amanhã no Zoom sobre a tese")
    assert a["arguments"]["participants"][0] == "Rui"
    assert (a["trigger"], a["arguments"]["time"], a["arguments"]["location"], a["arguments"]["topic"]) == (["reunir"], ["amanhã"], ["Zoom"], ["tese"])
    assert one(spark, annotate.annotation(F.col("t")), t=None)["trigger"] == []


def test_anonymisation(spark):
    df = spark.createDataFrame(
        [(1, "Ana confirmou. Ana vai estar presente.", "Ligar à Rita: 912345678 ou ana@x.pt. Teams."), (2, None, ""), (3, "Zoom", "Prof. Carlos Lima da Universidade de Lisboa, aluno 12345")], "id int, subject string, body string"
    )
    r = {x["id"]: x for x in anonymize.anonymize(df, ["subject", "body"], True).collect()}
    assert r[1]["subject"] == "[PESSOA_1] confirmou. [PESSOA_1] vai estar presente."
    assert r[1]["body"] == "Ligar à [PESSOA_2]: [TELEFONE_1] ou [EMAIL_1]. Teams."
    assert (r[2]["subject"], r[2]["body"], r[2]["anonymization"]["entities"]) == (None, "", [])
    assert r[3]["body"] == "Prof. [PESSOA_1] da [UNIVERSIDADE_1], aluno [ID_ALUNO_1]"
    assert r[1]["anonymization"]["mapping"]["EMAIL:ana@x.pt"] == "[EMAIL_1]"
    lists = spark.createDataFrame([("Ana", ["Rita", "Ana e Rui", None]), (None, None)], "subject string, people array<string>")
    rows = anonymize.anonymize(lists, ["subject", "people"]).collect()
    assert (rows[0]["subject"], rows[0]["people"]) == ("[PESSOA_1]", ["[PESSOA_2]", "[PESSOA_1] e Rui", None])
    assert [e["field"] for e in rows[0]["anonymization"]["entities"]] == ["subject", "people[0]", "people[1]"]
    assert rows[1]["people"] is None and rows[1]["anonymization"]["entities"] == []
    plain = anonymize.anonymize(df, ["subject", "body"]).where("id = 1").first()["anonymization"]
    assert plain["mode"] == "anonymize" and "original" not in plain["entities"][0].asDict()
