"""Arguments of meeting mails: spans of times, places, participants and the topic."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pauta.functions.matching import ARROW_SPAN, SPANS, Span, by_start, compiled, earliest_longest, first_per_key, per_row, plain, spans, squeezed
from pauta.functions.text import let, strip, truthy

_MONTH = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez"
#: The patterns by kind.
TIME_SPANS = {
    "date": [rf"\b\d{{1,2}}\s+de\s+(?:{_MONTH})(?:\s+de\s+\d{{2,4}})?\b", r"\b(?:jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez)\s+\d{1,2}(?:\s+\d{4})?\b", r"\b\d{1,2}[-/]\d{1,2}(?:[-/]\d{2,4})?\b"],
    "time": [r"\b(?:às|as|a)\s+(?:\d{1,2}):?(?:\d{2})?\s*(?:h|horas)?\b", r"\b\d{1,2}:?\d{2}\s*(?:h|horas)?\b", r"\b(?:\d{1,2})\s*horas?\b"],
    "weekday": [
        r"\b(?:segunda|seg)\.?\s*-?\s*(?:feira)?\b", r"\b(?:terça|ter)\.?\s*-?\s*(?:feira)?\b", r"\b(?:quarta|qua)\.?\s*-?\s*(?:feira)?\b", r"\b(?:quinta|qui)\.?\s*-?\s*(?:feira)?\b", r"\b(?:sexta|sex)\.?\s*-?\s*(?:feira)?\b",
        r"\b(?:sábado|sab)\.?\b", r"\b(?:domingo|dom)\.?\b",
    ],
    "relative": [
        r"\b(?:amanhã|manha|amanhã)\b", r"\b(?:hoje|hj)\b", r"\b(?:ontem|ont)\b", r"\b(?:próxima|proxima)\s+(?:semana|segunda)", r"\b(?:próximo|proximo)\s+(?:mês|mes|ano)\b", r"\b(?:esta|este)\s+(?:semana|segunda|sexta)\b",
        r"\b(?:semana)\s+(?:que|k)\s+(?:vem|vém)\b", r"\b(?:daqui)\s+a\s+(?:\d+)\s+(?:dias|semanas|horas)\b",
    ],
    "informal": [r"\b(?:de|por)\s+(?:manhã|tarde|noite)\b", r"\b(?:depois|ap[ó|o]s)\s+(?:de\s+)?(?:almoço|café|trabalho)\b", r"\b(?:antes|ac)\s+(?:de\s+)?(?:almoço|café)\b", r"\b(?:ao\s+)?(?:nível|final)\s+(?:de\s+)?(?:semana|dia)\b"],
}
PLACE_SPANS = [
    r"\b(?:sala|salas|escritório|escritorios|gabinete|gabinetes|auditório|auditórios)\s+(?:de\s+)?(?:n°|número|nº|#)?(\d+|[A-Z])\b", r"\b(?:\d+)[°º]\s*(?:andar|piso)\b", r"\b(?:andar|piso)\s+(?:\d+|térreo|terreo|cave)\b",
    r"\b(?:auditório|auditorio|laboratório|laboratorio|lab|anfiteatro|biblioteca|cafetaria|refeitório|refeitorio|cantina|armazém|armazem)\b", r"\b(?:bloco|edifício|edificio|campus|sede|filial)\s+[A-Z0-9]+\b",
    r"\b(?:rua|avenida|av|alameda|praça|pç)\s+[A-Z][a-záéíóúàâêõç\s]+\b",
]
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"

NOT_MEETING = ["nao_reuniao", "nao reuniao", "não", "nao", "infelizmente"]
TOPIC_STOP = [
    "de", "do", "da", "dos", "das", "e", "ou", "um", "uma", "uns", "umas", "o", "a", "os", "as", "em", "para", "por", "com", "sem", "sob", "sobre", "que", "qual", "quais", "ao", "aos", "ser", "estar", "ter", "teve", "temos",
    "tenho", "reuniao", "reunioes", "meeting", "meetings", "email", "emails",
]
GENERIC = [
    "agendamento", "cancelamento", "confirmacao", "disponibilidade", "informacao", "marcacao", "pedido", "ponto de situacao", "processo", "remarcacao", "reuniao", "reuniao confirmada", "assunto", "esse assunto", "este assunto",
    "aquilo", "consigo", "isso", "isto",
]
CAPTURE = r"([A-Za-zÀ-ÖØ-öø-ÿ0-9][^,.;?!\n]{0,160}?)(?=\s+(?:para|em|no|na|às|as|pelas|fica|ficou|vai|sera|será|quando|ate|até)\b|[,.;?!\n]|$)"
TOPIC_BODY = [
    r"\breuni(?:ao|ão)\s+(?:sobre|relacionad[ao]\s+com)\s+", r"\b(?:falar(?:mos)?|conversar(?:mos)?)\s+(?:consigo\s+)?(?:sobre|acerca\s+(?:de|do|da|dos|das))\s+",
    r"\b(?:discutir(?:mos)?|abordar(?:mos)?|rever(?:mos)?|analisar(?:mos)?|avaliar(?:mos)?|debater(?:mos)?)\s+(?:consigo\s+)?(?:o\s+tema\s+de\s+)?",
    r"\b(?:reuni(?:ao|ão)|sess(?:ao|ão)|encontro|conversa)\s+(?:(?:e|é|sera|será|foi)\s+)?(?:dedicad[ao]|focad[ao])\s+(?:a|à|ao|aos|às|em|no|na)\s+", r"\b(?:assunto|tema)\s+(?:principal\s+)?(?:e|é|sera|será|foi)\s+(?:o|a|os|as)?\s*",
    r"\bquanto\s+(?:a|à|ao|aos|às)\s+", r"\btratar(?:mos)?\s+(?:de|do|da|dos|das)\s+", r"\bincidir(?:a|á)?\s+sobre\s+", r"\b(?:reuni(?:ao|ão)|sess(?:ao|ão)|encontro)\s+(?:tem|tera|terá|teve)\s+como\s+(?:tema|assunto)\s+",
    r"\bordem\s+de\s+trabalhos\s+(?:inclui|incluira|incluirá)\s+", r"\bdar(?:mos|emos)?\s+seguimento\s+(?:a|à|ao|aos|às)\s+", r"\b(?:pontos?|quest(?:ao|ão|oes|ões))\s+sobre\s+", r"\bponto\s+de\s+situa(?:cao|ção)\s+de\s+",
    r"\b(?:tema|assunto)\s+(?:de|da|do|sobre)\s+", r"\brelativ[oa]s?\s+a\s+", r"\brelacionad[oa]s?\s+com\s+",
    r"\b(?:alinhar(?:mos)?\s+(?:os\s+proximos\s+passos\s+)?(?:relativos?\s+a|a\s+parte\s+do)|parte\s+do)\s+", r"\bsobre\s+",
]
TOPIC_SUBJECT = [r"\breuni(?:ao|ão)(?:\s+convocada)?\s*(?:sobre|[-:])\s*(.+)$", r"\b(?:agendamento|cancelamento|confirma(?:cao|ção)|imprevisto|pedido\s+de\s+reuni(?:ao|ão))\s*[-:]\s*(.+)$"]
ONLY_TIME_OR_PLACE = r"(?iU)^(?:(?:hoje|amanha|amanhã|ontem|segunda|terca|terça|quarta|quinta|sexta)|(?:as|às)?\s*\d{1,2}(?:h\d{0,2}|:\d{2})|(?:zoom|teams|google meet|remoto|presencial|sala|gabinete))$"
#: Temporal hints.
_LONG_MONTH = "(?:janeiro|fevereiro|mar[çc]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)"
_CLOCK = r"(?:\s+(?:às|as|pelas)\s+\d{1,2}(?:h\d{0,2}|:\d{2}|\s+horas?))?\b"
_DAYS = "segunda|ter[çc]a|quarta|quinta|sexta|s[áa]bado|domingo"
HINTS = [
    rf"\bdia\s+\d{{1,2}}(?:\s+de\s+{_LONG_MONTH})?{_CLOCK}",
    rf"\b\d{{1,2}}\s+de\s+{_LONG_MONTH}(?:\s+de\s+\d{{4}})?{_CLOCK}",
    rf"\b\d{{1,2}}[/-]\d{{1,2}}(?:[/-]\d{{2,4}})?{_CLOCK}",
    rf"\b(depois\s+de\s+amanh[ãa]|amanh[ãa]|hoje|ontem|(?:na\s+)?pr[óo]xima\s+semana|para\s+a\s+semana|esta\s+semana|(?:pr[óo]xima|esta)\s+(?:{_DAYS})|{_DAYS})(?:-feira)?(?:\s+(?:de|à|a|pela|ao)\s+(?:manh[ãa]|tarde|noite))?{_CLOCK}",
    r"\b(?:durante\s+a\s+manh[ãa]|ao\s+final\s+do\s+dia|depois\s+de\s+almo[çc]o|depois\s+da\s+aula|antes\s+do\s+semin[áa]rio|mais\s+logo)\b",
    rf"\b(?:daqui\s+a|dentro\s+de|em)\s+\d+\s+(?:dias?|semanas?|horas?){_CLOCK}",
    r"\b(?:às|as|pelas)?\s*\d{1,2}(?:h\d{0,2}|:\d{2}|\.\d{2}|\s+horas?)\b",
]
_HINTS = compiled(HINTS)

_TIMES = [(re.compile(p, re.IGNORECASE), f"regex_{kind}") for kind, ps in TIME_SPANS.items() for p in ps]
_PLACES = compiled(PLACE_SPANS)
_EMAIL = compiled([EMAIL])[0]
_BODY, _SUBJECT = compiled([p + CAPTURE for p in TOPIC_BODY]), compiled(TOPIC_SUBJECT)
_EDGE = " \t\r\n-:;,.'\""
_ABOUT = re.compile(r"^(?:sobre\s+|acerca\s+(?:de|do|da|dos|das)\s+)", re.IGNORECASE)
_ARTICLE = re.compile(r"^(?:o|a|os|as)\s+", re.IGNORECASE)
_REPLY = re.compile(r"^\s*(?:(?:re|fw|fwd|enc)\s*:\s*)+", re.IGNORECASE)
_NO_TOPIC = re.compile(ONLY_TIME_OR_PLACE.removeprefix("(?iU)"), re.IGNORECASE)
_WORD = re.compile("[a-z0-9]+")


def find_times(text: str) -> list[Span]:
    """Spans of temporal expressions, without overlaps (earliest, then longest)."""
    return earliest_longest([x for p, method in _TIMES for x in spans(text, p, 0.9, method)])


def find_places(text: str) -> list[Span]:
    return earliest_longest([x for p in _PLACES for x in spans(text, p, 0.85, "regex_location")])


def find_participants(text: str, people=None) -> list[Span]:
    """E-mail addresses, one a spelling, and what ``people`` finds.

    ``people`` is a function of a text that gives (start, end) of person names; names that
    overlap an address are left out, and each is kept once.
    """
    found = spans(text, _EMAIL, 0.95, "regex_email")
    named = [] if people is None else [(a, b) for a, b in people(text) if not any(a < x["end"] and b > x["start"] for x in found)]
    found += [{"text": text[a:b], "start": a, "end": b, "confidence": 0.85, "method": "person"} for a, b in named]
    return sorted(first_per_key(found, lambda x: x["text"].lower()), key=by_start)


def _candidate(raw: str) -> str:
    c = _ABOUT.sub("", squeezed(raw).strip(_EDGE))
    return _ARTICLE.sub("", c).strip(_EDGE)


def _valid(c: str) -> bool:
    if not c or len(c) > 140 or len(c.split()) > 14:
        return False
    key = plain(c)
    return key not in GENERIC and not _NO_TOPIC.search(c) and any(w not in TOPIC_STOP for w in _WORD.findall(key))


def _topics(text: str, patterns: list[re.Pattern], confidence: float, method: str) -> list[Span]:
    out = []
    for p in patterns:
        for x in spans(text, p, confidence, method, group=1):
            c = _candidate(x["text"])
            if _valid(c):
                at = x["start"] + max(x["text"].lower().find(c.lower()), 0)
                out.append(x | {"text": c, "start": at, "end": at + len(c)})
    return out


def find_topics(body: str | None, subject: str | None, intent: str | None) -> list[Span]:
    """At most one topic span: body phrases before subject phrases, then the longest."""
    if intent is not None and plain(intent) in NOT_MEETING:
        return []
    title = _REPLY.sub("", subject or "").strip()
    both = _topics(body or "", _BODY, 0.98, "regex_topic_body") + _topics(title, _SUBJECT, 0.9, "regex_topic_subject")
    return sorted(first_per_key(both, lambda x: plain(x["text"])), key=lambda x: (-x["confidence"], -len(x["text"])))[:1]


def find_hints(text: str) -> list[Span]:
    """Longer temporal hints (dates and days with their clock times), without overlaps, one a spelling."""
    found = [x | {"text": x["text"].strip()} for x in earliest_longest([x for p in _HINTS for x in spans(text, p, 0.9, "regex_hint")])]
    return first_per_key(found, lambda x: squeezed(x["text"]).lower())


_ARROW_SPANS = pa.list_(ARROW_SPAN)


def _spans_column(function, *columns: Column) -> Column:
    return per_row(function, SPANS, _ARROW_SPANS, *columns)


def _of_text(function):
    return lambda text: function(text or "")


def time_spans(text: Column) -> Column:
    """Spans of temporal expressions, without overlaps (earliest, then longest); none for null."""
    return _spans_column(_of_text(find_times), text)


def place_spans(text: Column) -> Column:
    return _spans_column(_of_text(find_places), text)


def participant_spans(text: Column, people=None) -> Column:
    """E-mail addresses as participants; ``people`` adds person names (see :func:`find_participants`)."""
    return _spans_column(_of_text(lambda t: find_participants(t, people)), text)


def topic_spans(body: Column, subject: Column, intent: Column) -> Column:
    """At most one topic span: body phrases before subject phrases, then the longest."""
    return _spans_column(find_topics, body, subject, intent)


def hint_spans(text: Column) -> Column:
    """Longer temporal hints (dates and days with their clock times), without overlaps."""
    return _spans_column(_of_text(find_hints), text)


def arguments(body: Column, subject: Column, intent: Column, people=None) -> Column:
    """Struct of the spans of participants, times, locations and topics, in one pass over the text."""

    def every(b, s, i) -> dict:
        text = b or ""
        return {"participants": find_participants(text, people), "times": find_times(text), "locations": find_places(text), "topics": find_topics(b, s, i)}

    names = ("participants", "times", "locations", "topics")
    return per_row(every, "struct<" + ",".join(f"{n}:{SPANS}" for n in names) + ">", pa.struct([(n, _ARROW_SPANS) for n in names]), body, subject, intent)


#: Places of meetings.
REMOTE = r"(?iU)\b(zoom|teams|microsoft\s+teams|google\s+meet|meet|online|remot[ao])\b"
DEPARTMENT_ROOM = r"(?iU)\bsala\s+de\s+reuni(?:ao|oes|ões)\s+do\s+departamento\b"
ROOM = r"(?iU)\bsala(?:\s+de\s+reuni(?:ao|oes|ões))?(?:\s+[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)?)?(?:\s+do\s+departamento)?\b"
OFFICE = r"(?iU)\bgabinete(?:\s+(?:da\s+direcao|da\s+direção|de\s+\w+|\d+(?:[.\-]\d+)?))?\b"
PRESENT = r"(?iU)\b(secretaria(?!\s+academica)|biblioteca|laborat(?:orio|ório)(?:\s+de\s+\w+)?|audit(?:orio|ório)(?:\s+\w+)?|campus(?:\s+\w+)?)\b"
ANY_PLACE = r"zoom|teams|microsoft\s+teams|google\s+meet|meet|skype|discord|online|remot[ao]|presencial|sala(?:\s+de\s+reuni(?:ao|oes|ões))?\s+[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)?|gabinete(?:\s+(?:da\s+direcao|de\s+\w+|\d+(?:[.\-]\d+)?))?|secretaria(?!\s+academica)|biblioteca|bar\s+da\s+faculdade|laborat(?:orio|ório)|lab\b|audit(?:orio|ório)(?:\s+\w+)?|campus(?:\s+\w+)?|departamento|reitoria|universidade|faculdade"


def platform(c: Column) -> Column:
    low = F.lower(c)
    return F.when(c.isNull(), None).when(F.contains(low, F.lit("team")), "teams").when(F.contains(low, F.lit("meet")), "google meet").otherwise("zoom")


def canonical_place(c: Column, *, keep_rest: bool = False, whole_room_text: bool = False) -> Column:
    """``remoto - x`` or ``presencial - x``; else null, or with ``keep_rest`` the text itself."""

    def made(t: Column) -> Column:
        hit = lambda p: truthy(F.regexp_extract(t, p, 0))
        here = lambda x: F.concat(F.lit("presencial - "), strip(x))
        room = F.when(hit(ROOM).isNotNull(), t) if whole_room_text else hit(ROOM)
        return F.coalesce(F.concat(F.lit("remoto - "), platform(hit(REMOTE))), here(hit(DEPARTMENT_ROOM)), here(room), here(hit(OFFICE)), here(hit(PRESENT)), t if keep_rest else F.lit(None).cast("string"))

    return let(truthy(F.regexp_replace(strip(c), r"(?iU)^\s*(?:em|no|na|por|via)\s+", "")), made)


def explicit_place(text: Column) -> Column:
    """The first place that follows a preposition."""
    near = rf"(?iU)(?:em|no|na|por|via)\s+\b({ANY_PLACE})\b"
    return truthy(F.regexp_extract(F.coalesce(text, F.lit("")), near, 1))


def place_of_mail(body: Column, label: Column) -> Column:
    """For meeting labels the place a body names, by default a remote one; else null."""
    meeting = label.isin("agendamento_reuniao", "cancelamento_reuniao", "reuniao_confirmada")
    return F.when(meeting, F.coalesce(canonical_place(explicit_place(body)), F.lit("remoto - zoom")))
