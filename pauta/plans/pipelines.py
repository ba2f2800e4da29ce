"""Whole pipelines as one lazy plan each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pauta.functions.matching import per_row
from pauta.functions.temporal import canonical_text, mail_reference, reference_of, resolve
from pauta.functions.text import clean_body, combine_fields, preprocess, sentences, strip, tokens
from pauta.operators.arguments import find_participants, find_places, find_times, find_topics
from pauta.operators.triggers import trigger


def processed(mails: DataFrame) -> DataFrame:
    """Cleaned mails: body without history and signature, sentences, tokens, model text."""
    body = clean_body(F.coalesce("body", F.lit("")))
    out = mails.withColumn("clean_body", body).withColumns({"sentences": sentences(F.col("clean_body")), "tokens": tokens(F.col("clean_body"))})
    text = combine_fields(F.col("subject"), F.col("clean_body"))
    return out.withColumn("text", preprocess(text)).where(strip(F.col("text")) != "")


def records(mails: DataFrame, people=None) -> DataFrame:
    """Meeting records: trigger, time spans with canonical times, places, participants and topic.

    The mail's date is taken from the first of its date columns (``temporal.DATE_KEYS``) that
    reads as one. Spans and their canonical times come from one trip of the texts to Python.
    ``people`` finds person names, see :func:`pauta.operators.arguments.find_participants`.
    """
    times = [("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("canonical", pa.string())]
    kind = pa.struct([("times", pa.list_(pa.struct(times))), ("locations", pa.list_(pa.string())), ("participants", pa.list_(pa.string())), ("topic", pa.string())])

    def found(mail: dict) -> dict:
        text, ref = mail["body"] or "", reference_of(mail["at"])
        topics = find_topics(mail["body"], mail["subject"], mail["label"])
        return {
            "times": [{"text": x["text"], "start": x["start"], "end": x["end"], "canonical": None if ref is None else canonical_text(resolve(x["text"], ref))} for x in find_times(text)],
            "locations": [x["text"] for x in find_places(text)],
            "participants": [x["text"] for x in find_participants(text, people)],
            "topic": topics[0]["text"] if topics else None,
        }

    mail = F.struct("body", "subject", "label", mail_reference(mails.columns).alias("at"))
    column = per_row(found, "struct<times:array<struct<text:string,start:int,end:int,canonical:string>>,locations:array<string>,participants:array<string>,topic:string>", kind, mail)
    intent = F.lower(F.coalesce("label", F.lit("")))
    return mails.select("id", trigger(F.col("body"), intent).alias("trigger"), column.alias("__found")).select("id", "trigger", "__found.times", "__found.locations", "__found.participants", "__found.topic")
