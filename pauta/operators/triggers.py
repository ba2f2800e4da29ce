"""Intent-aware trigger phrases: exact phrases first (longest first), then patterns in order.

Texts are folded with ``ã õ ç`` only, phrases are not, so phrases with these letters never
match exactly; patterns cover them. Null and blank texts and unknown intents give null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pauta.functions.text import let, squeeze, strip, truthy

#: Phrases and patterns of each intent.
PHRASES = {
    "agendamento_reuniao": [
        "agendar", "marcar", "remarcar", "remarcacao", "reagendar", "agendar reunião", "marcar reunião", "agendar encontro", "marcar encontro", "falar", "reunião", "agendamento", "marque", "agendai",
        "marcai", "marca", "quando", "qual dia", "que dia", "qual data", "que data", "próxima semana", "próximo mês", "amanhã", "depois de amanhã", "hoje", "semana que vem", "data", "sugerir data", "propor data",
        "próxima segunda", "próxima terça", "próxima quarta", "próxima quinta", "próxima sexta", "próximo sábado", "próximo domingo",
    ],
    "cancelamento_reuniao": [
        "cancelar", "cancelamento", "não posso", "indisponível", "impossível", "adiar", "adiamento", "postpone", "postponed", "reschedule", "lamento", "desculpa", "não me dá jeito", "ocupado",
    ],
    "reuniao_confirmada": [
        "confirmar", "confirmado", "fica para", "confirmamos", "lá estarei", "la estarei", "está confirmado", "esta confirmado", "confirmo presença", "confirmo presenca", "confirmo a minha presença",
        "confirmo a minha presenca", "asseguro a minha presença", "asseguro a minha presenca", "asseguro a minha participação", "asseguro a minha participacao", "confirmo a minha participação",
        "confirmo a minha participacao", "confirmo que estarei", "vou", "posso", "consigo", "estarei presente", "estarei lá", "estarei la", "estarei na reunião", "estarei na reuniao", "pode ser", "por mim tudo bem", "sem problema",
    ],
    "nao_reuniao": ["não é sobre reunião", "não é reunião", "off topic", "fora do assunto", "assunto diferente"],
}
PATTERNS = {
    "agendamento_reuniao": [
        r"\bagendar(?:ei|á|ás|emos|eis|ão)?\b", r"\bmarcar(?:ei|á|ás|emos|eis|ão)?\b", r"\bquando\s+(?:pode|consegue|está)", r"\bdisponí?vel\b", r"\bhorário\b", r"\breunião\b", r"\bslot\b", r"\bremarcar(?:ei|a|as|emos|eis|ao)?\b",
        r"\breagendar(?:ei|a|as|emos|eis|ao)?\b", r"\bremarcacao\b", r"\bcolocar\s+na\s+agenda\b", r"\bagendar\s+para\b", r"\bquando\b", r"\b(?:qual|que)\s+(?:dia|data)\b", r"\b(?:próximo|próxima)\s+(?:semana|mês)\b",
        r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b(?:segunda|terça|quarta|quinta|sexta|sábado|domingo)\b", r"\bdata\b", r"\bque\s+tal\b",
    ],
    "cancelamento_reuniao": [
        r"\bcancelar(?:ei|á|ás|emos|eis|ão)?\b", r"\badiar(?:ei|á|ás|emos|eis|ão)?\b", r"\bcancelado\b", r"\b(?:não|nao)\s+(?:vou|posso|consigo)\b", r"\bindisponí?vel\b", r"\bconflito\s+de\s+agenda\b", r"\bdesculpa\b", r"\blamento\b",
        r"\bocupado\b", r"\b(?:não|nao|n)\s+(?:me\s+dá|dá|da)\s+(?:jeito|saída)\b",
    ],
    "reuniao_confirmada": [
        r"\bestar(?:ei|á|ás|emos|eis|ão)?\b", r"\bconfirm(?:ar|ado|amos)?\b", r"\bvou\b", r"\bpor\s+mim\b", r"\bconsigo\b", r"\bpor\s+mim\s+(?:posso|consigo|tudo\s+bem|pode\s+ser)\b",
    ],
    "nao_reuniao": [r"\b(?:não|nao)\s+(?:é|eh)\s+(?:sobre\s+)?(?:reunião|reuniao)\b", r"\b(?:off\s+topic|off-topic)\b", r"\b(?:fora\s+do|out\s+of)\s+(?:assunto|scope)\b", r"\bassunto\s+(?:diferente|outro)\b"],
}
KIND = "struct<trigger:string,method:string>"


def folded(text: Column) -> Column:
    return squeeze(F.translate(F.lower(strip(text)), "ãõç", "aoc"))


def _exact(text: Column, phrases: list[str]) -> Column:
    """The first of the phrases, longest first, that stands in the text as words."""
    ordered = sorted(dict.fromkeys(phrases), key=len, reverse=True)
    return F.coalesce(*[F.when(text.rlike(rf"(?U)\b{re.escape(p)}\b"), F.lit(p)) for p in ordered])


def _pattern(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[truthy(F.regexp_extract(text, f"(?iU){p}", 0)) for p in patterns])


def trigger(text: Column, intent: Column) -> Column:
    """``struct<trigger, method>`` with method ``exact`` or ``regex``; null where nothing fits."""

    def by_intent(t: Column) -> Column:
        out = F.lit(None).cast(KIND)
        for k, phrases in PHRASES.items():
            found = F.coalesce(_labelled(_exact(t, phrases), "exact"), _labelled(_pattern(t, PATTERNS[k]), "regex"))
            out = F.when((intent == k) & (t != ""), found).otherwise(out)
        return out

    return let(folded(text), by_intent)


def _labelled(found: Column, method: str) -> Column:
    return let(found, lambda x: F.when(x.isNotNull(), F.struct(x.alias("trigger"), F.lit(method).alias("method"))))
