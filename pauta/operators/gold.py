"""Gold records from the mails' own fields, kept only where the text shows them.

Topic and time count for meeting labels whose value stands in subject or body; participants
are the people of the fields (each once) and of a given finder; the time is normalised
against the mail's date. Everything is row-local. Null fields count as empty.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pauta.functions.matching import per_row, plain
from pauta.functions.temporal import canonical, mail_reference, normalize
from pauta.functions.text import strip, truthy, unique_people
from pauta.operators.annotate import annotation
from pauta.operators.arguments import place_of_mail

#: Labels of meetings, prefixes of names, words that are no participant.
MEETING_LABELS = ("agendamento_reuniao", "cancelamento_reuniao", "reuniao_confirmada")
NAME_PREFIXES = [r"ola\s+", r"olá\s+", r"car[ao]\s+colega\s+", r"car[ao]\s+", r"estimad[oa]/a\s+estudante\s+", r"estimad[oa]\s+", r"exmo\.?\s+", r"exma\.?\s+"]
NO_PARTICIPANTS = [
    "boa", "bom", "ola", "olá", "viva", "exmo", "exma", "caro", "cara", "professor", "professora", "obrigado", "obrigada", "cumprimentos", "enviado", "enviado do outlook", "enviado do telemovel", "sent from my iphone",
    "mensagem enviada automaticamente", "proponho", "preciso",
]
NO_PARTICIPANT_PARTS = ["enviado", "outlook", "iphone", "telemovel", "automatica"]
_PREFIXES = [re.compile(f"^(?:{p})", re.IGNORECASE) for p in NAME_PREFIXES]
_TITLE = re.compile(r"^(?:(?:professora?|prof|dra?)\s+)+")


def shown(subject: Column, body: Column, value: Column) -> Column:
    """Whether the value stands in subject or body, whatever the case."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))))
    needle = F.lower(strip(F.coalesce(value, F.lit(""))))
    return (needle != "") & F.contains(hay, needle)


def participant_name(found: str | None) -> str | None:
    """A found name without greeting, or None where it is none: fewer than two words, a greeting or signature line."""
    text = " ".join((found or "").split())
    for p in _PREFIXES:
        text = p.sub("", text)
    text = text.strip(" ,.;:")
    low = " ".join(text.lower().split())
    key = _TITLE.sub("", " ".join(plain(text).replace(".", " ").split()))
    if len(key.split()) < 2 or low in NO_PARTICIPANTS or key in NO_PARTICIPANTS or any(w in low for w in NO_PARTICIPANT_PARTS):
        return None
    return text


def people_in_text(text: Column, people) -> Column:
    """Valid participant names that ``people`` (a function of a text giving (start, end)) finds."""
    names = lambda t: [n for a, b in people(t or "") if (n := participant_name((t or "")[a:b])) is not None]
    return per_row(names, "array<string>", pa.list_(pa.string()), text)


def gold_from_metadata(mails: DataFrame, people=None) -> DataFrame:
    """(dataset_id, subject, text, sent_datetime, intent, trigger, arguments, confidence) of every mail."""
    have = set(mails.columns)
    column = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    none = F.array().cast("array<string>")
    label = F.coalesce("label", F.lit(""))
    meeting = label.isin(*MEETING_LABELS)
    own = F.concat(F.coalesce(column("participants", "array<string>"), none), F.array(column("sender", "string"), column("recipient", "string")))
    every = own if people is None else F.concat(own, people_in_text(F.concat_ws(" ", "subject", "body"), people))
    time, topic = strip(column("time_expression", "string")), strip(column("topic", "string"))
    told = meeting & shown(F.col("subject"), F.col("body"), time)
    normal = canonical(normalize(time, mail_reference(mails.columns)))
    place = place_of_mail(F.col("body"), label)
    arguments = F.struct(
        unique_people(every).alias("participants"),
        F.when(told, F.array(time)).otherwise(none).alias("time"),
        F.when(told & normal.isNotNull(), F.array(normal)).otherwise(none).alias("time_normalized"),
        F.when(place.isNotNull(), F.array(place)).otherwise(none).alias("location"),
        F.when(meeting & shown(F.col("subject"), F.col("body"), topic), F.array(topic)).otherwise(none).alias("topic"),
    )
    sure = F.create_map(*[x for k in ("trigger", "participants", "temporal", "location", "topic") for x in (F.lit(k), F.lit(1.0))])
    return mails.select(
        F.col("id").alias("dataset_id"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("text"), column("sent_datetime", "string").alias("sent_datetime"), label.alias("intent"),
        none.alias("trigger"), arguments.alias("arguments"), sure.alias("confidence"),
    )


def gold_from_text(mails: DataFrame) -> DataFrame:
    """(id, text, intent, trigger, arguments, confidence) by the heuristic annotator; the text is the body, else the subject."""
    a = annotation(strip(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))))
    return mails.select("id", F.coalesce(truthy(F.col("body")), F.coalesce("subject", F.lit(""))).alias("text"), F.coalesce("label", F.lit("")).alias("intent"), a.alias("a")).select(
        "id", "text", "intent", F.coalesce(F.get("a.trigger", F.lit(0)), F.lit("")).alias("trigger"), "a.arguments", "a.confidence"
    )
