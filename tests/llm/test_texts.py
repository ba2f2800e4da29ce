"""The row operators of texts: exact results, round trips and edge cases."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from pauta.llm import encoding, leakage, repetition
from pauta.llm.encoding import PATTERN, VOCABULARY, Encoder, encode
from pauta.llm.leakage import leak_report, leaks, name_words
from pauta.llm.lookalikes import Rewriter, classes, odd_records, one_form
from pauta.llm.personal_data import Finder, mentions, redact, redacted
from pauta.llm.repetition import line_frequency, repeated_share, repetitive_documents
from pauta.llm.wordhash import words

DOCS = "doc_id bigint, text string, source string, lang string"


def test_encoding_equals_a_reference_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = "abcdeéãç  \n\t123.,!?-_'\"<|endoftext|>ｆЖ😀​"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [None, "", " ", "<|endoftext|>", "a" * 3000, "ab" * 2000, "\n" * 50, "olá mundo " * 20_000, "olá", "olá"]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode(df).collect()}
    assert got == {i: (other.encode_ordinary(t) if t else []) for i, t in enumerate(texts)}
    assert encode(df.limit(0)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_encoding_round_trip(texts):
    e = test_encoding_round_trip.encoder
    flat, ends = e.encode(texts)
    for i, t in enumerate(texts):
        assert b"".join(e_bytes[int(x)] for x in flat[ends[i] : ends[i + 1]]) == t.encode("utf-8", "surrogatepass")


test_encoding_round_trip.encoder = Encoder()
e_bytes = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}


def share(text):
    w = words(text)
    g = [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
    return 1 - len(set(g)) / len(g) if g else 0.0


def test_repetition(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))) for _ in range(200)]
    texts += [None, "", "  ", "um", "spam e mais spam. " * 50_000, "Olá olá OLÁ olá " * 5, "a b c d e f g h i j k l m n o p q r s"]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["repeated_share"] for r in repeated_share(df).collect()}
    assert all(abs(got[i] - share(t)) < 1e-12 for i, t in enumerate(texts))
    found = {r["doc_id"] for r in repetitive_documents(df).collect()}
    assert found == {i for i, t in enumerate(texts) if len(words(t)) >= 20 and share(t) >= 0.3 - 1e-12}


def test_line_frequency(spark):
    rows = [(i, f"linha {i}\nAviso  LEGAL\ncorpo {i}", "a", None) for i in range(30)] + [(100, "aviso legal", "a", None), (101, "aviso legal\noutra", None, None), (102, None, "a", None), (103, "", "a", None)]
    got = {r["doc_id"]: (r["n_removed"], r["rejected"]) for r in line_frequency(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[5] == (1, False) and got[100] == (1, True) and got[101] == (0, False) and 102 not in got


@pytest.fixture(scope="module")
def leak_case():
    rng = random.Random(6)
    voc = [f"v{i}" for i in range(300)]
    plain = [w for w in voc]
    items = [(i, " ".join(rng.choice(plain) for _ in range(rng.randint(10, 60))), "c", "test") for i in range(30)] + [(90, "", "c", "test")]
    docs = []
    for i in range(120):
        w = [rng.choice(plain) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.5:
            src = items[rng.randrange(30)][1].split()
            n = rng.randint(8, 20)
            a = rng.randrange(max(1, len(src) - n))
            k = rng.randrange(len(w) + 1)
            w[k:k] = [x.upper() + "," for x in src[a : a + n]]
        docs.append((i, " ".join(w), None, None))
    docs += [(500, None, None, None), (501, "", None, None), docs[0]]
    return docs, items


@pytest.mark.parametrize("bound", [leakage.BROADCAST_WORDS, 0])
def test_leaks_against_brute_force(spark, leak_case, monkeypatch, bound):
    monkeypatch.setattr(leakage, "BROADCAST_WORDS", bound)
    docs, items = leak_case
    runs = {}
    for i, t, *_ in items:
        w = words(t)
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t, *_ in docs for w in [words(t)] for k in range(len(w) - 11) for i in runs.get(tuple(w[k : k + 12]), ())}
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string, category string, split string")
    assert want and {(r["doc_id"], r["item_id"]) for r in leaks(d, b).collect()} == want
    assert leaks(d.limit(0), b).collect() == [] and leaks(d, b.limit(0)).collect() == []


def test_reparameterised_leak(spark):
    item = "um comboio parte na segunda com 120 pessoas e demora 45 minutos a chegar ao destino final da linha"
    changed = item.replace("120", "77").replace("45", "90").replace("segunda", "sexta")
    mixed = "um comboio parte na segunda com 7 pessoas e demora 7 minutos a chegar ao destino final da linha"
    d = spark.createDataFrame([(1, changed, None, None), (2, item, None, None), (3, mixed, None, None), (4, "outra coisa", None, None)], DOCS)
    b = spark.createDataFrame([(9, item, "c", "test")], "item_id bigint, text string, category string, split string")
    got = {r["doc_id"]: r["kind"] for r in leaks(d, b, exact_only=False).collect()}
    assert got == {1: "reparameterised", 2: "exact"}  # two slot values that fall together aren't consistent
    r = leak_report(d, b).first()
    assert (r["exact_documents"], r["reparameterised_documents"]) == (1, 1)


SAME = [
    ("\uff50\u00e1\uff47\uff49\uff4e\uff41 1\uff12", "página 12"),
    ("h\u043eje, \u0430inda e Pr\u03bfponho", "hoje, ainda e Proponho"),
    ("na\u0303o e corac\u0327a\u0303o", "não e coração"),
    ("la\u200bbora\u00adtório\ufeff\u2060", "laboratório"),
    ("a\u00a0b\u2003c\u3000d\u202fe", "a b c d e"),
    ("\ufb01cha ter\u2011ça", "ficha ter-ça"),
    ("\uff2d\uff41\uff4e\uff54\uff45\u0301m", "Mantém"),
    ("calendar\u0456zaca\u0303\u03bf", "calendarizacão"),
]


def test_lookalikes():
    r = Rewriter()
    for odd, plain in SAME:
        assert r.plain(odd) == plain
        text, source = r.plain_with_source(odd)
        assert text == plain and len(source) == len(plain)
    for kept in ("λόγος e Жизнь (28)", "Δ = 10 °C", "nível λ9", "1.ª e 2º, 2 m², ½, 29 € – “líquido”…", "👍 🙂 😊 ❤️ 👩‍💻", "", "olá\n\nmundo\t!", "ação"):
        assert r.plain(kept) == kept
    assert r.plain(None) is None
    assert all(r.plain(r.plain(a)) == r.plain(a) for a, _ in SAME)
    members = [m for c in classes() for m in c]
    assert len(members) == len(set(members))  # classes are disjoint
    assert r.plain("ａ" * 50_000) == "a" * 50_000


def test_frequency_chooses_among_untyped():
    counts = {"Ā": 5}
    assert Rewriter(counts).plain("Ā") == "Ā"


def test_odd_records(spark):
    mails = spark.createDataFrame([(1, "olá"), (2, "olá​"), (2, "olá​"), (3, None)], "id bigint, body string")
    cases = spark.createDataFrame([("a", "tema"), ("b", "ｔema"), ("c", None)], "id string, gold_topic string")
    assert {tuple(r) for r in odd_records(mails, cases).collect()} == {("test_dataset", "2"), ("topic_extraction_holdout", "b")}
    assert odd_records(mails.limit(0), cases.limit(0)).collect() == []
    rows = spark.createDataFrame([("t", "1", "x y", "z")], "tbl string, rec_id string, text string, plain string")
    assert one_form(rows).first()["plain"] == "x y"


PERSONAL = [
    ("Olá Horácio Pinhomouro,", [("name", "Horácio Pinhomouro")]),
    ("falei com HORÁCIO DE PINHOMOURO e horácio", [("name", "HORÁCIO DE PINHOMOURO"), ("name", "horácio")]),
    ("Dr.ª Horácio P. também vem", [("name", "Horácio P.")]),
    ("E: horacio.p+x@uni.example.", [("email", "horacio.p+x@uni.example")]),
    ("(horacio [at] uni-a.example)", [("email", "horacio [at] uni-a.example")]),
    ("horacio arroba uni-a ponto example", [("email", "horacio arroba uni-a ponto example")]),
    ("grupo @turma-b já leu", []),
    ("Ligue para (+351) 969 832 321 se", [("phone", "(+351) 969 832 321")]),
    ("Pode telefonar ((934) 012 203).", [("phone", "(934) 012 203")]),
    ("telefonar (00351 916879138).", [("phone", "00351 916879138")]),
    ("T: 22 020 77 46", [("phone", "22 020 77 46")]),
    ("☎ 916-280-437", [("phone", "916-280-437")]),
    ("Orçamento: 218 450 000 ienes, à taxa", []),
    ("NIF 217 476 430", [("id_number", "217 476 430")]),
    ("contribuinte n.º 286582808)", [("id_number", "286582808")]),
    ("Segue CC n.º 14901163 4 XX1 para", [("id_number", "14901163 4 XX1")]),
    ("NISS 11776320733.", [("id_number", "11776320733")]),
    ("passaporte MC761875", [("id_number", "MC761875")]),
    ("n.º mecanográfico pg98521", [("id_number", "pg98521")]),
    ("processo n.º 2024/0000146, linha 2 104 558, circular 1044", []),
    ("Moro em R. dos Sete Degraus, n.º 61, cave, 8444-294 Pinhomouro", [("address", "R. dos Sete Degraus, n.º 61")]),
    ("é rua da Eira Grande 154, 5578", [("address", "rua da Eira Grande 154")]),
    ("Avenida principal do campus em obras até maio", []),
    ("na rua de trás do pavilhão. A sala 2.14", []),
    ("Ｈｏｒáｃｉｏ e NIF 28658​2808", [("name", "Ｈｏｒáｃｉｏ"), ("id_number", "28658​2808")]),
    ("", []),
]


def test_mentions_of_texts():
    f = Finder({"horacio", "pinhomouro"})
    for text, want in PERSONAL:
        got = [(k, text[a:b]) for k, a, b in f.mentions(text)]
        assert got == want, text
    assert f.mentions(None) == []
    assert redact("Olá Horácio, 916280437!", f.mentions("Olá Horácio, 916280437!")) == "Olá [PESSOA], [TELEFONE]!"
    assert redact(None, []) is None
    assert len(f.mentions("Horácio. " * 20_000)) == 20_000


def test_mentions_of_tables(spark):
    rows = [(1, "de Rosalina", "Olá, Rosalina Lamalva\n916280437", "Rosalina Lamalva", None, None, "x"), (2, None, "", None, "Olavo", None, "y")]
    df = spark.createDataFrame(rows, "id bigint, subject string, body string, sender string, recipient string, participants array<string>, kind string")
    df = df.union(df)
    got = sorted(map(tuple, mentions(df).collect()))
    assert got == [(1, "body", "name", 5), (1, "body", "phone", 22), (1, "subject", "name", 3)]
    out = {r["id"]: (r["subject"], r["body"]) for r in redacted(df).collect()}
    assert out == {1: ("de [PESSOA]", "Olá, [PESSOA]\n[TELEFONE]"), 2: (None, "")}
    assert mentions(df.limit(0)).collect() == []


def test_short_names(spark):
    from pauta.llm.personal_data import mentions, redacted

    rows = [(1, "Ana Silva", "Luz de Sá <x@y.pt>", "Reunião", "A Ana Silva e a Ana vêm, o Dr. Silva não."), (2, "Dr. Rui Sousa e Eva", None, "rui sousa", "A luz falhou; Luz e Sá avisam a eva.")]
    df = spark.createDataFrame(rows, "id bigint, sender string, recipient string, subject string, body string").withColumn("recipient", F.regexp_replace("recipient", " <.*", ""))
    got = {(r["id"], r["field"], r["start_pos"]) for r in mentions(df).collect() if r["kind"] == "name"}
    a, b = rows[0][4], rows[1][4]
    assert got == {(1, "body", 2), (1, "body", a.index("Ana v")), (1, "body", a.index("Silva não")), (2, "subject", 0), (2, "body", b.index("Luz")), (2, "body", b.index("Sá"))}
    text = {r["id"]: r["body"] for r in redacted(df).collect()}
    assert "Ana" not in text[1] and "A luz falhou" in text[2]


def test_lines_of_repeated_rows_count_once(spark):
    row = (1, "a\nb\n\na", "h")
    df = spark.createDataFrame([row, row, row, (2, "\n \n", "h"), (3, None, "h")], "doc_id bigint, text string, source string")
    assert [(r["doc_id"], r["n_lines"], r["n_removed"], r["kept_share"]) for r in line_frequency(df).collect()] == [(1, 3, 0, 1.0)]


@pytest.mark.parametrize("bound", [repetition.FREQUENT_LINES, 0])
def test_frequent_lines_in_both_joins(spark, monkeypatch, bound):
    monkeypatch.setattr(repetition, "FREQUENT_LINES", bound)
    df = spark.createDataFrame([(i, f"saudações\nlinha {i}", "h") for i in range(60)], "doc_id bigint, text string, source string")
    assert {(r["n_lines"], r["n_removed"]) for r in line_frequency(df).collect()} == {(2, 1)}


def test_long_words_by_both_ways(monkeypatch):
    e = encoding.Encoder()
    rng = random.Random(4)
    long_words = ["a" * 700, "".join(rng.choice("abcdeãç") for _ in range(900)), "漢字" * 300, "x" + "=-" * 400]
    got = e.encode([*long_words, "curto", None, ""])
    monkeypatch.setattr(encoding, "LONG", 10**9)
    want = encoding.Encoder().encode([*long_words, "curto", None, ""])
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_number_tables_show_exact_leaks_only(spark):
    """Windows of figures alone: equal ones leak, others are no re-parameterised leak, and none multiplies."""
    table = " ".join(str(i) for i in range(100, 1100))
    d = spark.createDataFrame([(1, table), (2, " ".join(str(i) for i in range(5000, 6000)))], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, " ".join(str(i) for i in range(100, 400)))], "item_id bigint, text string")
    assert [(r["doc_id"], r["kind"], r["windows"]) for r in leaks(d, b, exact_only=False).collect()] == [(1, "exact", 289)]


def test_exact_leaks_go_through_templates(monkeypatch):
    """Exact leaks only: a window's template decides whether its slots are compared, the slots whether it is a hit."""
    item = "um comboio parte na segunda com 120 pessoas e demora 45 minutos a chegar ao destino final da linha"
    changed = item.replace("120", "77").replace("45", "90").replace("segunda", "sexta")
    other = "uma carta segue na segunda com 120 folhas e espera 45 minutos a sair do posto central da vila"
    texts = [item, changed, other, " ".join(str(i) for i in range(5000, 6000)), None, ""]
    ids, items = np.array([7, 8]), [item, " ".join(str(i) for i in range(100, 400))]

    def counts():
        index = leakage._Index(ids, items, 12, None, True)
        met, hits = index.meeting(texts)[3], index.hits(texts)
        assert hits[3].all()
        return np.bincount(met, minlength=6).tolist(), sorted(zip(hits[1].tolist(), hits[2].tolist()))

    exact = [(0, 7)] * 8
    assert counts() == ([8, 8, 0, 989, 0, 0], exact)  # a template of figures alone meets everywhere, its slots nowhere
    monkeypatch.setattr(leakage, "templates", lambda h, digits, names: (h, np.zeros(len(h), bool)))
    assert counts() == ([8, 0, 0, 0, 0, 0], exact)


def test_names_are_slots_where_given(spark):
    b = spark.createDataFrame([(1, "o director Quintela pediu a todos que enviem já o novo relatório")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "o director Bragança pediu a todos que enviem já o novo relatório")], "doc_id bigint, text string")
    assert leaks(d.where("1 = 0"), b, exact_only=False).collect() == []
    names = spark.createDataFrame([("quintela",), ("braganca",)], "word string")
    (r,) = leaks(d, b, exact_only=False, names=names).collect()
    assert r["kind"] == "reparameterised"
    many = spark.createDataFrame([("Falou Quintela hoje. Quintela disse que sim; veio Quintela.",)], "text string")
    assert [r["word"] for r in name_words(many).collect()] == ["quintela"]


@pytest.mark.parametrize(
    "text, found",
    [
        ("A rosa do Porto é bonita.", ["Porto"]),  # a place that is also a listed surname: by its text alone a name
        ("Uma rosa para a Rosa.", ["Rosa"]),
        ("falei com rosa matos ontem", ["rosa matos"]),
        ("Vi a rosa matos ontem", ["rosa matos"]),
        ("Falei com a Ana e o Rui Gil.", ["Ana", "Rui Gil"]),
        ("Ana confirmou", ["Ana"]),
        ("Segue o parecer do Dr. Bernardo Quintela.", ["Bernardo Quintela"]),
        ("Olá Bernardo,\nsegue o texto.", ["Bernardo"]),
        ("Olá Equipa, Caros Colegas, Sr. Director, Bom dia Professora,", []),
        ("Professor Auxiliar do Departamento", []),
    ],
)
def test_names_by_context(text, found):
    f = Finder(["ana", "rui", "gil", "rosa", "porto", "matos"])
    assert [text[a:b] for kind, a, b in f.mentions(text) if kind == "name"] == found
