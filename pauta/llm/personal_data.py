"""Personal information inside free text: anchor expansion.

One Aho-Corasick pass over the folded text (accents and case dropped, places kept) finds
anchors: at-signs and their spellings, identifier labels, openings of phone numbers, street
types, and the tokens of known person names. At each anchor a local parser expands to the
mention's borders and validates it; overlaps go to the earlier kind of ``KINDS``. Look-alike
characters are brought to one form first, and all places are those of the stored text.

Name tokens come from name columns of the mails themselves. They are a vocabulary, broadcast
up to ``NAME_TOKENS`` distinct tokens (checked; more raise an error). Context speaks for and
against a name: capitalised words after a title, or alone after a greeting, are one whether
listed or not; a listed token in lower case is none after an article ("a rosa") or with so
few letters as ``SHORT``, unless another name stands beside it.

Defined results: null and empty fields give no mentions and stay as they are; texts are read
whole; repeated rows give each mention once; an empty table gives no rows.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pauta.cluster import bounded_rows
from pauta.llm.lookalikes import Rewriter
from pauta.llm.setjoin import _batches

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID]", "phone": "[TELEFONE]", "address": "[MORADA]", "name": "[PESSOA]"}
NAME_TOKENS = 1_000_000
LINKS = ("de", "da", "do", "dos", "das", "d'")
SHORT = 3  # a token of so many letters at most is a name by its capital or beside another name only
NO_NAMES = (*LINKS, "e", "dr", "dra", "sr", "sra", "eng", "arq")  # short words of name fields that are no names

#: Spellings of the at-sign, identifier labels, street types, currencies.
AT = ("@", "(at)", "[at]", "{at}", "(arroba)", "[arroba]", " arroba ")
LABELS = {
    "tax": ("nif", "nipc", "contribuinte", "numero fiscal", "identificacao fiscal"),
    "card": ("cc", "cartao de cidadao", "cartao do cidadao", "bilhete de identidade", "bi"),
    "social": ("niss", "seguranca social"),
    "passport": ("passaporte", "passport"),
    "student": ("aluno", "aluna", "mecanografico", "estudante"),
}
STREETS = (
    "rua", "r.", "avenida", "av.", "travessa", "tv.", "trav.", "largo", "lg.", "lgo.", "praca", "pc.", "pca.", "praceta", "pct.", "pcta.", "beco", "bc.", "alameda", "al.", "estrada", "estr.",
    "calcada", "cc.", "calc.", "rotunda", "rot.", "azinhaga", "viela", "ladeira", "caminho", "escadinhas", "escadas", "patio", "bairro", "urbanizacao", "urb.", "avda.", "est.",
)
#: Titles and greetings that a name follows, and words that follow them without being one.
TITLES = ("dr.", "dra.", "dr.ª", "sr.", "sra.", "sr.ª", "prof.", "prof.ª", "profa.", "eng.", "eng.º", "eng.ª", "arq.", "doutor", "doutora", "senhor", "senhora", "professor", "professora")
GREETINGS = ("caro", "cara", "ola", "bom dia", "boa tarde", "boa noite", "estimado", "estimada", "querido", "querida")
NO_PERSONS = frozenset(
    "colega colegas todos todas equipa equipe professor professora professores docente docentes doutor doutora doutores dr dra sr sra prof profa eng arq senhor senhora senhores senhoras engenheiro engenheira director directora "
    "diretor diretora coordenador coordenadora presidente vice reitor reitora secretario secretaria aluno aluna alunos alunas estudante estudantes membro membros conselho departamento comissao cliente clientes utilizador "
    "associado associada auxiliar catedratico catedratica adjunto adjunta convidado convidada responsavel chefe tecnico tecnica assistente investigador investigadora orientador orientadora e mestre juiz juiza".split()
)
MONEY = r"(?:ienes|euros?|eur|€|dolares|libras|reais|francos|escudos|contos|usd|jpy|yen)\b|€"

_FOLD = {}
for _c in "áàâãäå":
    _FOLD[ord(_c)] = "a"
for _a, _b in (("éèêë", "e"), ("íìîï", "i"), ("óòôõö", "o"), ("úùûü", "u"), ("ç", "c"), ("ñ", "n"), ("ý", "y")):
    _FOLD.update({ord(c): _b for c in _a})
_FOLD.update({ord(chr(k).upper()): v for k, v in list(_FOLD.items())})
_FOLD.update({c: chr(c + 32) for c in range(65, 91)})

_LOCAL = re.compile(r"[a-z0-9._%+\-]")
_DOMAIN = re.compile(r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:(?:\.|\s+ponto\s+|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\(ponto\)\s?|\s?\[ponto\]\s?)[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)+")
_NUM = r"(?:\s*(?:n\.?\s?[ºo°]\.?|no\.|numero|num\.|:|-|n\.))*\s*"
_TAIL = {
    "tax": re.compile(_NUM + r"(?:pt\s?)?([0-9]{3}[ .\-]?[0-9]{3}[ .\-]?[0-9]{3})(?![0-9])"),
    "card": re.compile(_NUM + r"([0-9]{7,8}(?:[ \-]?[0-9](?:[ \-]?[a-z]{2}[ \-]?[0-9])?)?)(?![0-9a-z])"),
    "social": re.compile(_NUM + r"([0-9]{11}|[0-9]{3}(?:[ .\-]?[0-9]{3}){2}[ .\-]?[0-9]{2}|[0-9]{4} [0-9]{3} [0-9]{4})(?![0-9])"),
    "passport": re.compile(_NUM + r"([a-z]{1,2}\s?[0-9]{6,7})(?![0-9a-z])"),
    "student": re.compile(_NUM + r"([a-z]{0,3}[0-9]{4,9})(?![0-9a-z])"),
}
_CARD = re.compile(r"[0-9]{8} ?[0-9] ?[a-z]{2}[0-9](?![0-9a-z])")
_PHONE = re.compile(
    r"(?:(?:\((?:\+|00)[0-9]{1,3}\)|(?:\+|00)351)[ .\-]?)?(?:\([0-9]{2,3}\)[ .\-]?[0-9]{3}[ .\-]?[0-9]{3,4}|[0-9]{3}[ .\-]?[0-9]{3}[ .\-]?[0-9]{3}|[0-9]{2}[ .\-][0-9]{3}[ .\-][0-9]{2}[ .\-][0-9]{2}|[0-9]{3} [0-9]{2} [0-9]{2} [0-9]{2})(?![0-9])(?!(?:[.,/\-]|:)[0-9])"
)
_ABROAD = re.compile(r"(?:\+|00)[1-9][0-9]{0,2}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])")
_PERIODS = re.compile(r"\s?" + MONEY)
_STREET = re.compile(r"\s*((?:[^\W\d_][\w'’.\-]*\s+|[^\W\d_][\w'’.\-]*(?=,)){1,9}?),?\s*(n\.?\s?[ºo°]\.?\s*|numero\s+|num\.\s*|n\.\s*)?([0-9]{1,4})(?:\s?-?[a-d](?![\w]))?(?![0-9])(?![.:h/][0-9])")
_POSTAL = re.compile(r"[0-9]{4}-[0-9]{3}\s+$")
_NAMED = re.compile(r"\s{1,2}([^\W\d_a-zà-öø-ÿ][a-zà-öø-ÿ'’\-]+(?: (?:(?:d[aeo]s?|e) )?[^\W\d_a-zà-öø-ÿ][a-zà-öø-ÿ'’\-]+){0,5})(?![\w@])")
_NOUN = re.compile(r"(?:^|[^a-z])(?:o|a|os|as|um|uma|do|da|no|na|ao|pelo|pela) $")
_INITIAL = re.compile(r" [a-z]\.(?![a-z])")


def fold(text: str) -> str:
    """Lower case without accents, every character at its place."""
    return text.translate(_FOLD)


class Finder:
    """Anchors and parsers; ``names`` are folded tokens of person names."""

    def __init__(self, names, rewriter: Rewriter | None = None) -> None:
        self.names = frozenset(names)
        self.rewriter = rewriter or Rewriter()
        self._build()

    def _build(self) -> None:
        a = ahocorasick.Automaton()
        cues: dict[str, list[tuple[str, str]]] = {}

        def cue(key: str, kind: str, what: str = "") -> None:
            cues.setdefault(key, []).append((kind, what))

        for x in AT:
            cue(x, "at")
        for what, labels in LABELS.items():
            for x in labels:
                cue(x, "label", what)
        for x in STREETS:
            cue(x, "street")
        for x in ("+", "00", "(", *(f"2{d}" for d in range(10)), *(f"9{d}" for d in range(10))):
            cue(x, "digits")
        for x in self.names:
            cue(x, "name")
        for x in TITLES:
            cue(fold(x), "title")
        for x in GREETINGS:
            cue(x, "greeting")
        for k, v in cues.items():
            a.add_word(k, (len(k), v))
        a.make_automaton()
        self.automaton = a

    def __reduce__(self):
        return Finder, (tuple(sorted(self.names)), self.rewriter)

    def mentions(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in the stored text, in order, without overlaps."""
        if not text:
            return []
        plain, source = self.rewriter.plain_with_source(text)
        low = fold(plain)
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        tokens: list[tuple[int, int]] = []
        for end, (size, cues) in self.automaton.iter(low):
            start, end = end - size + 1, end + 1
            for kind, what in cues:
                if kind == "name":
                    if (start == 0 or not low[start - 1].isalpha()) and (end == len(low) or not low[end].isalpha()):
                        tokens.append((start, end))
                elif kind == "digits":
                    if m := self._phone(low, start):
                        found["phone"].append(m)
                elif kind == "at":
                    if m := self._email(low, start, end):
                        found["email"].append(m)
                elif start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                    continue
                elif kind in ("title", "greeting"):
                    tokens += self._titled(plain, low, end, kind)
                elif kind == "label":
                    if m := _TAIL[what].match(low, end):
                        found["id_number"].append(m.span(1))
                elif m := self._street(plain, low, start, end):
                    found["address"].append(m)
        found["id_number"] += [m.span() for m in _CARD.finditer(low) if m.start() == 0 or not low[m.start() - 1].isalnum()]
        taken = bytearray(len(low))
        out = []
        for kind in KINDS:
            spans = found[kind] if kind != "name" else self._names(low, self._named(plain, low, tokens), taken)
            for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
                if not any(taken[a:b]):
                    taken[a:b] = b"\x01" * (b - a)
                    out.append((kind, a, b))
        if source is not None:
            ends = [*source, len(text)]
            out = [(k, source[a], max(ends[b], source[b - 1] + 1)) for k, a, b in out]
        return sorted(out, key=lambda m: m[1])

    def _email(self, low: str, start: int, end: int):
        a = start
        if a and low[a - 1] == " ":
            a -= 1
        b = a
        while a and _LOCAL.match(low[a - 1]):
            a -= 1
        while a < b and low[a] in ".-+%":
            a += 1
        c = end + 1 if end < len(low) and low[end] == " " else end
        m = _DOMAIN.match(low, c)
        return (a, m.end()) if m and a < b else None

    def _phone(self, low: str, start: int):
        if start and (low[start - 1].isalnum() or low[start - 1] == "+" or (low[start - 1] in ".-/," and start > 1 and low[start - 2].isdigit())):
            return None
        m = _PHONE.match(low, start)
        if m:
            digits = re.sub("[^0-9]", "", m.group())
            home = digits[-9:]
            if home[0] not in "2389" or (len(digits) == 9 and home[0] not in "29") or _PERIODS.match(low, m.end()):
                return None
            if start > 1 and low[start - 1] == " " and low[start - 2].isdigit() and low[start] not in "(+" and not low[max(0, start - 5) : start - 1].endswith("351"):
                return None  # inside a longer run of digit groups
            return m.span()
        m = _ABROAD.match(low, start)
        if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15 and not _PERIODS.match(low, m.end()):
            return m.span()
        return None

    def _street(self, plain: str, low: str, start: int, end: int):
        if low[end - 1] != "." and end < len(low) and low[end].isalnum():
            return None
        m = _STREET.match(low, end)
        if not m or "\n\n" in m.group() or _PERIODS.match(low, m.end()):
            return None
        named = plain[m.start(1) : m.end(1)]
        words = [w for w in re.findall(r"[^\s,]+", named) if w.lower() not in (*LINKS, "e", "à", "ao", "às", "aos", "a", "o")]
        if not words or any(w.endswith(".") and len(w) > 4 for w in words):
            return None
        if m.group(2) is None and not all(w[0].isupper() for w in words):
            return None
        return start, m.end()

    @staticmethod
    def _titled(plain: str, low: str, end: int, kind: str) -> list[tuple[int, int]]:
        """Tokens of a capitalised name that follows a title, or stands alone after a greeting, known or not."""
        m = _NAMED.match(plain, end)
        if not m or "\n" in m.group() or (kind == "greeting" and plain[m.end() : m.end() + 1] not in (",", "!", ".", "\n", "\r", "")):
            return []
        words = [(m.start(1) + w.start(), m.start(1) + w.end()) for w in re.finditer(r"[^\s]+", m.group(1))]
        if any(low[a:b] in NO_PERSONS and low[a:b] not in LINKS and low[a:b] != "e" for a, b in words):
            return []
        return [(a, b) for a, b in words if low[a:b] not in LINKS and low[a:b] != "e"]

    @staticmethod
    def _joined(gap: str) -> bool:
        """Whether two tokens with this text between them are parts of one name."""
        words = gap.split()
        return "\n" not in gap and (gap.isspace() or (len(words) <= 2 and gap[:1] == " " and gap[-1:] == " " and all(w in LINKS for w in words)))

    def _named(self, plain: str, low: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The tokens without those in lower case that have no name beside them and are short or follow an article."""
        tokens = sorted(set(tokens))
        sure = [plain[a].isupper() or (b - a > SHORT and not _NOUN.search(low, max(0, a - 6), a)) for a, b in tokens]
        gaps = [low[b:c] for (_, b), (c, _) in zip(tokens, tokens[1:])]
        for k in range(1, len(tokens)):  # onwards from a name, then back from one; a linking word leads to no noun
            sure[k] = sure[k] or (sure[k - 1] and self._joined(gaps[k - 1]))
        for k in range(len(tokens) - 2, -1, -1):
            noun = not plain[tokens[k][0]].isupper() and _NOUN.search(low, max(0, tokens[k][0] - 6), tokens[k][0])
            sure[k] = sure[k] or (sure[k + 1] and (gaps[k].isspace() if noun else self._joined(gaps[k])))
        return [t for t, ok in zip(tokens, sure) if ok]

    def _names(self, low: str, tokens: list[tuple[int, int]], taken: bytearray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(set(tokens)):
            if taken[a] or _POSTAL.search(low, max(0, a - 12), a):
                continue
            if out:
                if self._joined(low[out[-1][1] : a]):
                    out[-1] = (out[-1][0], b)
                    continue
            out.append((a, b))
        return [(a, m.end() if (m := _INITIAL.match(low, b)) and not any(taken[b : m.end()]) else b) for a, b in out]


def redact(text: str | None, mentions: list[tuple[str, int, int]]) -> str | None:
    """The text with a typed placeholder for each mention and the rest unchanged."""
    if not text or not mentions:
        return text
    out, at = [], 0
    for kind, a, b in mentions:
        out += (text[at:a], PLACEHOLDERS[kind])
        at = b
    return "".join([*out, text[at:]])


def name_tokens(mails: DataFrame, columns: tuple[str, ...] = ("sender", "recipient", "participants")) -> DataFrame:
    """Distinct folded tokens of the name columns (text, or array of texts)."""
    types = dict(mails.dtypes)
    arrays = [F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) if types[c].startswith("array") else F.array(F.col(c).cast("string")) for c in columns if c in types]
    plain = F.translate(F.lower(F.col("name")), "áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    names = mails.select(F.explode(F.concat(*arrays)).alias("name")).where("name is not null and instr(name, '@') = 0").distinct()
    return names.select(F.explode(F.split(plain, "[^a-z]+")).alias("token")).where((F.length("token") > 1) & ~F.col("token").isin(*NO_NAMES)).distinct()


def _finder(mails: DataFrame) -> Finder:
    tokens = name_tokens(mails)
    if not bounded_rows(tokens, NAME_TOKENS):
        raise ValueError(f"more than {NAME_TOKENS} distinct name tokens")
    return Finder(r["token"] for r in tokens.collect())


def mentions(mails: DataFrame, key: str = "id", fields: tuple[str, ...] = ("subject", "body")) -> DataFrame:
    """Distinct (id, field, kind, start_pos): every mention, its start in code points from 0."""
    shared = mails.sparkSession.sparkContext.broadcast(_finder(mails))
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")
    long = mails.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), parts).select("id", "x.field", "x.text").where("text <> ''")

    def scan(it):
        f = shared.value
        for b, texts in _batches(it):
            rows, kinds, starts = [], [], []
            for i, t in enumerate(texts):
                for kind, a, _ in f.mentions(t):
                    rows.append(i)
                    kinds.append(kind)
                    starts.append(a)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("field").take(at), pa.array(kinds, pa.string()), pa.array(starts, pa.int64())], ["id", "field", "kind", "start_pos"])

    return long.mapInArrow(scan, "id bigint, field string, kind string, start_pos bigint").distinct()


def redacted(mails: DataFrame, key: str = "id") -> DataFrame:
    """(id, subject, body) with placeholders; one row for each distinct record."""
    shared = mails.sparkSession.sparkContext.broadcast(_finder(mails))

    def rewrite(it):
        f = shared.value
        for b in it:
            if b.num_rows:
                cols = [pa.array([redact(t, f.mentions(t)) for t in b.column(c).to_pylist()], pa.string()) for c in ("subject", "body")]
                yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "subject", "body"])

    base = mails.select(F.col(key).cast("bigint").alias("id"), F.col("subject").cast("string").alias("subject"), F.col("body").cast("string").alias("body"))
    return base.mapInArrow(rewrite, "id bigint, subject string, body string").distinct()
