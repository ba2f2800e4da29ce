"""Heuristic annotation of mails with triggers, participants, times, places and topics."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column

from pauta.functions.matching import compiled, per_row

#: Patterns by kind.
TRIGGERS = {
    "reunir": [r"\breunir(?:mos|em|ão|ia)?(?:\s+(?:com|a))?", r"\breunião\b", r"\b(?:uma|uma\s+)?reunião\b"],
    "marcar": [r"\bmarcar(?:\s+(?:uma|a|o))?(?:\s+reunião)?", r"\bmarquei\b", r"\bmarca(?:do|da)?\b"],
    "cancelar": [r"\bcancelar(?:\s+(?:a|o|uma))?(?:\s+reunião)?", r"\bcancelado\b", r"\bcancelamento\b", r"\bfaltar(?:\s+à|ao)?(?:\s+reunião)?"],
    "confirmar": [r"\bconfirmar(?:\s+(?:a|o|que|se))?", r"\bconfirmado\b", r"\bconfirmação\b"],
    "agendar": [r"\bagendar", r"\bagendado\b"],
    "combinar": [r"\bcombinar", r"\bcombinado\b"],
    "encontrar": [r"\bencontrar(?:\s+(?:com|a|se))?", r"\bencontro\b"],
    "falar": [r"\bfalar(?:\s+(?:com|sobre))?", r"\bconversa(?:r|ção)?\b"],
    "discutir": [r"\bdiscutir", r"\bdiscussão\b"],
}
#: A pattern, and the least length of a name.
PEOPLE = [
    (r"(?:Olá|Oi|Caro|Cara|Prezado|Prezada|Exmo|Exma|Boas)\s+([A-Z][a-zá-ú]+(?:\s+[A-Z][a-zá-ú]+)?)", 2),
    (r"(?:com|a|para|pelo|pela)\s+(?:Professor|Professora|Dr\.|Dra\.|Eng\.|Enga\.|Prof\.)\s+([A-Z][a-zá-ú]+(?:\s+[A-Z][a-zá-ú]+)?)", 2),
    (r"@([a-zA-Z][a-zA-Z0-9]*)", 2),
    (r"(?:com|a|para|junto de)\s+([A-Z][a-zá-ú]+(?:\s+[A-Z][a-zá-ú]+)?)", 3),
    (r"(?:você|tu|ele|ela|eles|elas|nós|a|o)\s+([A-Z][a-zá-ú]+)", 3),
]
TITLES = ["Professor", "Professora", "Prof.", "Dr.", "Dra.", "Eng.", "Enga.", "Sr.", "Sra.", "Senhor", "Senhora"]
_DAYS = "segunda|terça|quarta|quinta|sexta|sábado|domingo"
TIMES = [
    r"\b(?:amanhã|hoje|ontem|agora)\b", rf"\b(?:{_DAYS})(?:-feira)?\b", rf"\b(?:próximo|próxima|seguinte)?\s*(?:{_DAYS})(?:-feira)?\b", r"\b(?:esta|próxima|semana\s+que\s+vem)\s+semana\b", r"\b(?:na|para\s+a)\s+(?:próxima\s+)?semana\b",
    r"\b(?:às|ao|a(?:s)?)\s*\d{1,2}(?:\s*[:h]\s*)?(?:\d{2})?\s*(?:h|horas)?\b", r"\d{1,2}:\d{2}", r"\b(?:meio-dia|meia-noite)\b", r"\b(?:de\s+)?(?:manhã|manha)\b", r"\b(?:à\s+)?(?:tarde|à tarde)\b", r"\b(?:à\s+)?(?:noite|à noite)\b",
    r"\b(?:depois\s+de\s+)?almoço\b", r"\b(?:depois\s+de\s+)?intervalo\b", r"\b(?:mais\s+)?logo\b", r"\b(?:em\s+breve|brevemente)\b", r"\b(?:ao\s+fim\s+da\s+tarde|final\s+da\s+tarde)\b",
]
PLACES = [
    r"\b(?:MS\s+)?Teams\b", r"\bZoom\b", r"\bDiscord\b", r"\bSkype\b", r"\bGoogle\s+Meet\b", r"\bMicrosoft\s+Teams\b", r"\bsala\s+(?:\d+[.-]?\d*|[A-Z]\d+)", r"\b(?:auditório|anfiteatro|sala\s+de\s+aula)\b", r"\baula\s+\d+", r"\bbiblioteca\b", r"\blaboratório\b",
    r"\blab\b", r"\boficina\b", r"\bcafetaria\b", r"\bcantina\b", r"\b(?:edifício|bloco)\s+[A-Z0-9]+", r"\bDepartamento\b",
]
TOPICS = [
    r"\bdissertação\b", r"\btese\b", r"\brelatório\b", r"\b(?:trabalho|projeto|assignment)\b", r"\bartigo\b", r"\bpaper\b", r"\b(?:pipeline|NLP|IA|AI|machine\s+learning|deep\s+learning)\b", r"\b(?:BERT|GPT|RNN|LSTM|CNN)\b",
    r"\b(?:dataset|corpus|embeddings?)\b", r"\b(?:precisão|recall|F1|accuracy|métrica)\b", r"\b(?:classificação|segmentação|extração|análise)\b", r"\b(?:linguística|processamento|computacional)\b",
    r"\b(?:inteligência\s+artificial|artificial\s+intelligence)\b",
]


_TRIGGERS = [(kind, re.compile("|".join(f"(?:{p})" for p in ps), re.IGNORECASE)) for kind, ps in TRIGGERS.items()]
_PEOPLE = [(re.compile(p, re.IGNORECASE), least) for p, least in PEOPLE]
_KINDS = {"time": compiled(TIMES), "location": compiled(PLACES), "topic": compiled(TOPICS)}
_SURE = {"trigger": 0.9, "participants": 0.75, "time": 0.8, "location": 0.85, "topic": 0.7}
_LIST = pa.list_(pa.string())
_KIND = pa.struct([("trigger", _LIST), ("arguments", pa.struct([(k, _LIST) for k in ("participants", *_KINDS)])), ("confidence", pa.map_(pa.string(), pa.float64()))])
_TYPE = "struct<trigger:array<string>,arguments:struct<participants:array<string>,time:array<string>,location:array<string>,topic:array<string>>,confidence:map<string,double>>"


def _all(text: str, patterns: list[re.Pattern]) -> list[str]:
    return list(dict.fromkeys(x for p in patterns for m in p.finditer(text) if (x := m.group().strip())))


def _people(text: str) -> list[str]:
    names = {x for p, least in _PEOPLE for m in p.finditer(text) if len(x := m.group(1).strip()) >= least}
    return sorted(x for x in names if x.split(maxsplit=1)[0] not in TITLES)


def _annotated(text: str | None) -> dict:
    text = text or ""
    trigger = next((kind for kind, p in _TRIGGERS if p.search(text)), None)
    values = {"participants": _people(text), **{k: _all(text, ps) for k, ps in _KINDS.items()}}
    sure = [(k, _SURE[k] if v else 0.0) for k, v in (("trigger", trigger), *values.items())]
    return {"trigger": [trigger] if trigger else [], "arguments": values, "confidence": sure}


def annotation(text: Column) -> Column:
    """Struct of the first trigger, arrays of values in order of sight, and confidences (0 where empty)."""
    return per_row(_annotated, _TYPE, _KIND, text)
