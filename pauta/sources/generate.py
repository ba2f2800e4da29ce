"""Synthetic labelled mails for tests and demonstrations, by hash of the row number.

The distribution is fixed (shares a label, names, rooms, hours); the texts are not meant to
equal any other generator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARES = [("agendamento_reuniao", 0.3), ("cancelamento_reuniao", 0.3), ("reuniao_confirmada", 0.3), ("nao_reuniao", 0.1)]
NAMES = ["Ana Silva", "Rui Costa", "Marta Reis", "Tiago Melo", "Inês Faria", "Paulo Dias"]
TOPICS = ["plano anual", "orçamento", "relatório de estágio", "calendário de exames", "obras da biblioteca"]
TIMES = ["amanhã às 10h", "sexta às 15h30", "dia 18 às 9h", "segunda de manhã", "16 de abril às 14:00"]
ROOMS = ["na sala 2.03", "via Zoom", "no gabinete 4", "na biblioteca", "por Teams"]
BODIES = {
    "agendamento_reuniao": "Olá {to}, podemos marcar uma reunião sobre {topic} {time} {room}?",
    "cancelamento_reuniao": "Olá {to}, tenho de cancelar a reunião sobre {topic} de {time}. Lamento.",
    "reuniao_confirmada": "Olá {to}, confirmo a minha presença {time} {room} para falarmos sobre {topic}.",
    "nao_reuniao": "Olá {to}, segue em anexo o documento sobre {topic}.",
}


def mails(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` mails (id, subject, body, label, sender, recipient, sent_datetime)."""
    draw = lambda what, k: F.pmod(F.xxhash64("id", F.lit(f"{what}-{seed}")), F.lit(k)).cast("int")
    pick = lambda what, values: F.get(F.array(*[F.lit(v) for v in values]), draw(what, len(values)))
    u = draw("label", 1000) / 1000
    label, edge = F.lit(SHARES[-1][0]), 1.0 - SHARES[-1][1]
    for name, share in reversed(SHARES[:-1]):
        label = F.when(u < edge, name).otherwise(label)
        edge -= share
    base = spark.range(1, n + 1).select("id", label.alias("label"), pick("sender", NAMES).alias("sender"), pick("recipient", NAMES).alias("recipient"), pick("topic", TOPICS).alias("topic"), pick("time", TIMES).alias("time"), pick("room", ROOMS).alias("room"))
    body = F.element_at(F.create_map(*[x for k, v in BODIES.items() for x in (F.lit(k), F.lit(v))]), F.col("label"))
    for k in ("to", "topic", "time", "room"):
        body = F.replace(body, F.lit("{" + k + "}"), F.col("recipient" if k == "to" else k))
    sent = F.date_format(F.timestamp_seconds(F.lit(1767254400) + draw("day", 120) * 86400 + (8 + draw("hour", 11)) * 3600 + draw("minute", 60) * 60), "yyyy-MM-dd'T'HH:mm:ss")
    return base.select("id", F.concat(F.lit("Reunião sobre "), "topic").alias("subject"), body.alias("body"), "label", "sender", "recipient", sent.alias("sent_datetime"))
