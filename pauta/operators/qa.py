"""Question answering around a pluggable scorer: questions, context, fallbacks, datasets.

The scorer is a function ``DataFrame (id, context, category, question) -> DataFrame with
answer, confidence``; the fallbacks are column expressions and need no model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pauta.functions.matching import per_row
from pauta.functions.temporal import canonical_text, parse_reference, reference_of, resolve
from pauta.functions.text import answer_text, first_text, let, squeeze, strip, tokens, truthy
from pauta.operators.arguments import ANY_PLACE, canonical_place, explicit_place, find_hints

#: Categories with their main questions, markers of auxiliary context.
QUESTIONS = {
    "participants": "Quem são os participantes da reunião?",
    "time": "Quando é a reunião?",
    "location": "Onde é a reunião?",
    "topic": "Qual é o tema da reunião?",
}
#: Other ways of asking, and parts of answers that show another category.
VARIATIONS = {
    "participants": [
        "Quem são as pessoas envolvidas?", "Com quem é a reunião?", "Quem vai estar presente?", "Que pessoas vão participar?", "Quem está envolvido?", "Quem mais vai estar lá?", "Há alguém mais na reunião?",
    ],
    "time": [
        "A que horas é a reunião?", "Qual é a hora da reunião?", "Em que dia e hora?", "Quando nos reunimos?", "Qual é o dia?", "Qual é o horário?", "Em que altura?", "Para que horas?", "A que hora marcou?",
        "Para que horas ficou marcada a reunião?", "Para quando é que ficou marcada?",
    ],
    "location": [
        "Qual é o local da reunião?", "Em que sítio é?", "Qual é o espaço?", "Onde vamos reunir?", "Em que local?", "Para onde é?", "Qual é o endereço?", "Que sala?", "Presencial ou online?",
    ],
    "topic": [
        "O que vai ser discutido?", "Qual é o assunto?", "Que se vai tratar?", "De que é que vamos falar?", "Qual é a temática?", "Qual é o tema?", "O que precisamos discutir?", "Qual é o objetivo?", "Que vamos abordar?", "vamos falar do quê?",
    ],
}
WRONG_PARTS = {
    "participants": ["reunião", "sexta", "Teams", "10h", "na sala", "o dataset", "a", "m", "amanhã", "hoje", "32", "cento e vinte e cinco"],
    "time": ["Ana", "Teams", "dataset", "na sala", "o professor", "o professor", "online", "presencial", "a"],
    "location": ["Ana", "sexta", "15h", "dataset", "professor"],
    "topic": ["Ana", "sexta", "15h", "Teams"],
}
NOT_MEETING = ["nao_reuniao", "não_reuniao", "nao reuniao"]
AUXILIARY = ["informacao auxiliar", "assunto", "remetente", "participante por defeito", "localizacao por defeito", "expressoes temporais normalizadas"]
MEETING_WORDS = ["reuni", "call", "disponibilidade", "combinar", "encontro"]
ANSWER = "struct<answer:string,confidence:double,valid:boolean,fallback_source:string>"


def questions(mails: DataFrame, key: str = "id", context: str = "context") -> DataFrame:
    """Every question for every mail: each row is repeated once a category (a fixed number)."""
    items = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(q).alias("question")) for k, q in QUESTIONS.items()])
    return mails.select(key, F.col(context).alias("context"), F.explode(items).alias("q")).select(key, "context", "q.category", "q.question")


def asked(mails: DataFrame, key: str = "id", context: str = "context", *, main: bool = True, seed: int = 42) -> DataFrame:
    """Like :func:`questions`, each in one of its wordings, drawn by the hash of the key; ``main`` lets the main one in."""
    rows = questions(mails, key, context).drop("question")
    out = F.lit(None).cast("string")
    for k, q in QUESTIONS.items():
        ways = ([q] if main else []) + VARIATIONS[k]
        at = F.pmod(F.xxhash64(F.col(key), F.lit(k), F.lit(seed)), F.lit(len(ways))).cast("int")
        out = F.when(F.col("category") == k, F.get(F.array(*[F.lit(w) for w in ways]), at)).otherwise(out)
    return rows.withColumn("question", out)


def fits_category(answer: Column, category: Column) -> Column:
    """Whether an answer isn't blank and holds no part that shows another category; unknown categories give null."""
    low = F.lower(strip(F.coalesce(answer, F.lit(""))))
    out = F.lit(None).cast("boolean")
    for k, parts in WRONG_PARTS.items():
        wrong = F.lit(False)
        for p in dict.fromkeys(parts):
            wrong = wrong | F.contains(low, F.lit(p.lower()))
        out = F.when(category == k, (low != "") & ~wrong).otherwise(out)
    return out


BEAM = 20
LONGEST_ANSWER = 64


def _best_span(start: list | None, end: list | None, context: list | None, most: int) -> dict | None:
    if not start or not end or not context:
        return None
    inside = np.array(context, bool)
    if not inside.any():
        return {"first": None, "last": None, "score": 0.0}
    s, e = (np.where(inside, np.array(x, float), -np.inf) for x in (start, end))
    top = lambda x: [int(k) for k in np.argsort(-x, kind="stable")[:BEAM] if inside[k]]
    pairs = [(a, b) for a in top(s) for b in top(e) if a <= b < a + min(most, LONGEST_ANSWER)]
    first = int(np.flatnonzero(inside)[0])
    a, b = max(pairs, key=lambda p: s[p[0]] + e[p[1]]) if pairs else (first, first)
    chance = lambda x, k: np.exp(x[k] - x.max()) / np.exp(x - x.max()).sum()
    return {"first": a, "last": b, "score": float(np.sqrt(chance(s, a) * chance(e, b)))}


def best_span(start: Column, end: Column, context: Column, most: int = LONGEST_ANSWER) -> Column:
    """``struct<first, last, score>``: the answer's tokens by a model's start and end logits.

    Only tokens that ``context`` marks count; of the ``BEAM`` best starts and ends the pair with
    the largest sum that isn't longer than ``most`` (64 at most); the score is the geometric mean
    of the two softmax probabilities. This is the seam for a model: its logits are columns.
    """
    kind = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])
    return per_row(lambda s, e, c: _best_span(s, e, c, most), "struct<first:int,last:int,score:double>", kind, start, end, context)


def enriched(body: Column, subject: Column, sender: Column) -> Column:
    """The body with hints about subject and sender below it."""
    s = truthy(strip(F.regexp_replace(squeeze(sender), r"^[<>]+|[<>]+$", "")))
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("Assunto: "), truthy(subject)),
            F.concat(F.lit("Remetente: "), s),
            F.concat(F.lit("Participante por defeito quando nao ha outro participante explicito: "), s),
        )
    )
    return F.when(F.size(lines) > 0, F.concat(F.coalesce(body, F.lit("")), F.lit("\n\nInformacao auxiliar:\n"), F.array_join(lines, "\n"))).otherwise(body)


def span_confidence(start: Column, end: Column, temperature: float = 1.0) -> Column:
    """Geometric mean of the sigmoids of two logits, kept in 0..1."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x / temperature))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sqrt(sigmoid(start) * sigmoid(end))))


def above(answer: Column, confidence: Column, threshold: float) -> Column:
    return F.when(confidence >= threshold, answer)


def _result(answer: Column, confidence: Column, source: str | Column) -> Column:
    s = F.lit(source) if isinstance(source, str) else source
    return F.struct(answer.alias("answer"), confidence.cast("double").alias("confidence"), answer.isNotNull().alias("valid"), s.alias("fallback_source"))


def _kept(a: Column) -> Column:
    return F.struct(a["answer"].alias("answer"), a["confidence"].alias("confidence"), F.coalesce(a["answer"] != "", F.lit(False)).alias("valid"), F.lit(None).cast("string").alias("fallback_source"))


def _empty(source: str) -> Column:
    return _result(F.lit(None).cast("string"), F.lit(0.0), source)


def is_bad(answer: Column, confidence: Column, body: Column) -> Column:
    """Empty, unsure, the whole mail, an auxiliary line, or longer than eight words."""
    a = strip(F.coalesce(answer, F.lit("")))
    low = answer_text(a, lowercase=True)
    marked = F.lit(False)
    for m in AUXILIARY:
        marked = marked | F.contains(low, F.lit(m))
    return (a == "") | (F.coalesce(confidence, F.lit(0.0)) < 0.35) | (low == answer_text(body, lowercase=True)) | marked | (F.size(tokens(a)) > 8)


def _hints(body: str | None, reference) -> list[dict]:
    ref = reference_of(reference)
    return [{"text": x["text"], "canonical": "" if ref is None else canonical_text(resolve(x["text"], ref)) or ""} for x in find_hints(body or "")]


def hints(body: Column, reference: Column) -> Column:
    """Temporal hints of a body with their canonical values: array<struct<text, canonical>>."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("canonical", pa.string())]))
    return per_row(_hints, "array<struct<text:string,canonical:string>>", kind, body, reference)


def _related(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def apply_fallbacks(df: DataFrame, answers: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Answers with fallbacks.

    ``df`` has ``body, subject, sender, sent_datetime, label`` and per category ``c`` the columns
    ``c_answer`` and ``c_confidence``. Adds ``participants, time, time_normalized, location,
    topic`` of type ``ANSWER``. Null answers count as empty; a null label is no meeting label.
    """
    cols = answers or {c: (f"{c}_answer", f"{c}_confidence") for c in QUESTIONS}
    get = {c: F.struct(F.col(a).alias("answer"), F.coalesce(F.col(k), F.lit(0.0)).alias("confidence")) for c, (a, k) in cols.items()}
    label = F.lower(strip(F.coalesce("label", F.lit(""))))
    not_meeting = label.isin(NOT_MEETING)
    words = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    named = F.lit(False)
    for w in MEETING_WORDS:
        named = named | F.contains(words, F.lit(w))
    meeting = ((label != "") & ~not_meeting) | named
    body = F.coalesce("body", F.lit(""))
    out = df.withColumn("__hints", hints(body, parse_reference(F.col("sent_datetime"))))

    sender = truthy(strip(F.col("sender")))
    p = get["participants"]
    participants = F.when(is_bad(p["answer"], p["confidence"], body) & sender.isNotNull(), _result(sender, F.lit(0.7), "fallback_sender")).otherwise(_kept(p))

    t = get["time"]
    said = answer_text(t["answer"], lowercase=True)
    chosen = F.get(F.filter("__hints", lambda h: (said != "") & (_related(said, answer_text(h["text"], lowercase=True)) | ((h["canonical"] != "") & (said == F.lower(h["canonical"]))))), F.lit(0))

    def timed(c: Column) -> Column:
        hint = F.coalesce(c, F.when(F.size("__hints") == 1, F.get("__hints", F.lit(0))))
        sure = F.when(c.isNotNull(), t["confidence"]).otherwise(F.lit(0.85))
        source = F.when(c.isNotNull(), "qa_temporal_alignment").otherwise("fallback_temporal_expression")
        norm = truthy(hint["canonical"])

        def both(a: Column, b: Column) -> Column:
            return F.struct(a.alias("time"), b.alias("norm"))

        return (
            F.when(not_meeting, both(_empty("non_meeting_no_time"), _empty("non_meeting_no_time")))
            .when(F.size("__hints") == 0, both(_empty("no_explicit_temporal_expression"), _empty("no_explicit_temporal_expression")))
            .when(hint.isNull(), both(_empty("ambiguous_temporal_expressions"), _empty("ambiguous_temporal_expressions")))
            .otherwise(both(_result(hint["text"], sure, source), _result(norm, F.when(norm.isNotNull(), sure).otherwise(0.0), F.lit(None).cast("string"))))
        )

    out = out.withColumn("__time", let(chosen, timed))

    loc = get["location"]
    low = answer_text(loc["answer"], lowercase=True)
    is_time = F.exists("__hints", lambda h: _related(low, answer_text(h["text"], lowercase=True)))
    bad_place = is_bad(loc["answer"], loc["confidence"], body) | low.isin("em", "no", "na", "por", "via", "onde") | (low == answer_text(F.col("subject"), lowercase=True)) | is_time | ~low.rlike(rf"(?iU)\b({ANY_PLACE})\b")
    named_place = canonical_place(explicit_place(body), keep_rest=True)
    given = canonical_place(F.col("location"), keep_rest=True) if "location" in df.columns else F.lit(None).cast("string")
    normal = canonical_place(loc["answer"], keep_rest=True)
    place = (
        F.when(not_meeting, _empty("non_meeting_no_location"))
        .when(~bad_place, F.when(normal.eqNullSafe(loc["answer"]), _kept(loc)).otherwise(_result(normal, loc["confidence"], "normalized_location")))
        .when(given.isNotNull(), _result(given, F.lit(0.9), "fallback_metadata_location"))
        .when(named_place.isNotNull(), _result(named_place, F.lit(0.8), "fallback_explicit_location"))
        .when(meeting, _result(F.lit("remoto - zoom"), F.lit(0.6), "default_remote_location"))
        .otherwise(_kept(loc))
    )
    topic_in = get["topic"]
    subject = truthy(F.col("subject"))
    topic = F.when(is_bad(topic_in["answer"], topic_in["confidence"], body) & subject.isNotNull(), _result(subject, F.lit(0.65), "fallback_subject")).otherwise(_kept(topic_in))
    out = out.withColumn("__place", place)
    keep = [c for c in df.columns if c not in (*QUESTIONS, "time_normalized")]
    return out.select(*keep, participants.alias("participants"), F.col("__time.time").alias("time"), F.col("__time.norm").alias("time_normalized"), F.col("__place").alias("location"), topic.alias("topic"))


def answer_start(context: Column, answer: Column) -> Column:
    """Place of the answer in the context from 0, or -1."""
    return F.instr(context, answer) - 1


def qa_examples(gold: DataFrame, *, include_impossible: bool = True) -> DataFrame:
    """SQuAD-like rows (id, context, question, answer, answer_start, category, is_impossible)."""
    items = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(q).alias("question"), F.array_join(F.coalesce(F.col(f"arguments.{c}"), F.array().cast("array<string>")), "; ").alias("answer")) for c, q in QUESTIONS.items()])
    rows = gold.select("id", F.coalesce("text", F.lit("")).alias("context"), F.explode(items).alias("x")).select(
        F.concat(F.col("id").cast("string"), F.lit("-"), F.col("x.category")).alias("example_id"), "id", "context", "x.question", "x.category", "x.answer"
    )
    at = answer_start(F.col("context"), F.get(F.split("answer", "; "), F.lit(0)))
    rows = rows.withColumn("answer_start", F.when(F.col("answer") == "", -1).otherwise(at)).withColumn("is_impossible", F.col("answer") == "")
    return rows if include_impossible else rows.where("not is_impossible")


def by_context(examples: DataFrame) -> DataFrame:
    """One row a context with its questions; a context has a fixed number of questions a record."""
    return examples.groupBy("id", "context").agg(F.array_sort(F.collect_list(F.struct("category", "question", "answer", "answer_start"))).alias("qas"))


def mail_body(df_col: dict[str, Column]) -> Column:
    """The first of clean body, body, text and original body that isn't empty."""
    return first_text(*[df_col[k] for k in ("clean_body", "body", "text", "original_body") if k in df_col])
