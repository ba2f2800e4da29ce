"""Anonymisation of mails with numbered placeholders shared over a mail's fields.

Entities are found by patterns and lists, overlaps go to the higher priority, then the
longer, then the earlier entity. One registry a mail, over subject, body and further fields
in order: an entity (type and lower-case text) keeps its placeholder, numbers count a prefix.
Everything is row-local: no shuffle. Null fields stay null and have no entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pauta.functions.spans import by_priority, group_spans, replace_spans, spans
from pauta.functions.text import squeeze, strip

#: Patterns and lists with their entity types and priorities.
PATTERNS = [
    ("EMAIL", 100, r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0),
    ("URL", 95, r"(?iU)\b(?:https?://|www\.)[^\s<>\"]+", 0),
    ("PHONE", 90, r"(?U)(?<!\w)(?:\+351\s*)?(?:9[1236]\d(?:[\s.-]?\d{3}){2}|2\d{2}(?:[\s.-]?\d{3}){2})(?!\w)", 0),
    ("STUDENT_ID", 90, r"(?iU)\b(?:aluno|aluna|estudante|n[úu]mero|n[ºo]\.?)\s*(?:n[ºo]\.?\s*)?(?:de\s*)?(?:aluno\s*)?(?:[:#-]?\s*)(\d{5,10})\b", 1),
    ("STUDENT_ID", 90, r"(?iU)\b(?:a|aluno|ist|isel|fc|uc|up|ul)\d{5,10}\b", 0),
]
UNIVERSITIES = ["Universidade de Lisboa", "Universidade do Porto", "Universidade de Coimbra", "Universidade do Minho", "Universidade de Aveiro", "Universidade Nova de Lisboa", "NOVA"]
INSTITUTIONS = ["Instituto Politécnico de Santarém", "Escola Superior de Gestão", "Instituto Superior Técnico", "Instituto Superior de Engenharia de Lisboa", "ISEL", "ISCTE"]
TITLES = ["professor", "professora", r"prof\.", r"profa\.", "doutor", "doutora", r"dr\.", r"dra\.", "orientador", "orientadora", "aluno", "aluna"]
NAMES = "ana joão joao maria rita paulo pedro vasco silva costa santos sofia miguel ines inês catarina diogo tiago beatriz".split()
PLATFORMS = ["teams", "microsoft teams", "zoom", "discord", "moodle", "github", "google meet", "outlook", "gmail", "slack", "trello", "notion"]
PREFIX = {"EMAIL": "EMAIL", "PHONE": "TELEFONE", "URL": "URL", "STUDENT_ID": "ID_ALUNO", "PERSON": "PESSOA", "ORG": "ORG", "LOCAL": "LOCAL", "UNIVERSITY": "UNIVERSIDADE", "INSTITUTION": "INSTITUICAO"}
ENTITY = "struct<text:string,start:int,end:int,type:string,priority:int,method:string>"
FOUND = "struct<text:string,start:int,end:int,type:string,priority:int,method:string,field:int>"
REGISTERED = "struct<text:string,start:int,end:int,type:string,priority:int,method:string,field:int,replacement:string>"
_CAPITAL = r"[A-ZÁÉÍÓÚÀÂÊÕÇ][\wÀ-ÿ-]+"


def _phrases(words: list[str]) -> str:
    ordered = sorted(words, key=len, reverse=True)
    return r"(?iU)(?<!\w)(?:" + "|".join(w.replace(" ", r"\s+") for w in ordered) + r")(?!\w)"


def entities(text: Column) -> Column:
    """Entities of a text without overlaps, ordered by place (heuristics only, no language model)."""
    title = rf"(?U)\b(?i:(?:{'|'.join(TITLES)}))\s+({_CAPITAL}(?:\s+{_CAPITAL}){{0,3}})"
    greeting = rf"(?U)\b(?i:(?:olá|ola|boas|car[oa]|bom dia|boa tarde))\s+({_CAPITAL}(?:\s+{_CAPITAL}){{0,2}})"
    rules = [
        *[(kind, rank, "REGEX", p, g) for kind, rank, p, g in PATTERNS],
        ("UNIVERSITY", 85, "ACADEMIC_RULE", _phrases(UNIVERSITIES), 0),
        ("INSTITUTION", 85, "ACADEMIC_RULE", _phrases(INSTITUTIONS), 0),
        ("PERSON", 80, "ACADEMIC_RULE", title, 1),
        ("PERSON", 80, "ACADEMIC_RULE", greeting, 1),
        ("PERSON", 60, "NAME_LEXICON", _phrases(NAMES), 0),
    ]
    found = []
    for kind, rank, method, pattern, group in rules:
        s = group_spans(text, pattern, group, 1.0, method) if group else spans(text, pattern, 1.0, method)
        found.append(F.transform(s, _as_entity(kind, rank)))
    known = F.filter(F.concat(*found), lambda x: ~F.lower(strip(x["text"])).isin(PLATFORMS))
    return by_priority(known, ENTITY)


def _as_entity(kind: str, rank: int):
    return lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("type"), F.lit(rank).alias("priority"), x["method"].alias("method"))


def _in_field(i: int):
    return lambda x: F.struct(*[x[k].alias(k) for k in ("text", "start", "end", "type", "priority", "method")], F.lit(i).alias("field"))


def _of_field(i: int):
    return lambda x: x["field"] == i


def _in_items(base: int):
    """Entities of the items of an array field, numbered from ``base``."""
    tag = lambda j: lambda x: F.struct(*[x[k].alias(k) for k in ("text", "start", "end", "type", "priority", "method")], (F.lit(base) + j).cast("int").alias("field"))
    return lambda item, j: F.transform(F.coalesce(entities(item), F.expr(f"cast(array() as array<{ENTITY}>)")), tag(j))


def _replace_items(base: int):
    mine = lambda j: lambda x: x["field"] == F.lit(base) + j
    return lambda item, j: F.when(item.isNotNull(), replace_spans(item, F.filter("__all", mine(j))))


ITEMS = 1_000_000


def anonymize(df: DataFrame, fields: list[str], pseudonymize: bool = False) -> DataFrame:
    """``df`` with the fields' texts replaced, ``anonymization`` (mode, entities and, in
    pseudonymise mode, the mapping) added. Fields may be texts or arrays of texts (their
    items are named ``field[i]``) and are numbered in the order given."""
    types = dict(df.dtypes)
    arrays = {f for f in fields if types[f].startswith("array")}
    out = df
    for i, f in enumerate(fields):
        if f in arrays:
            found = F.coalesce(F.flatten(F.transform(F.col(f), _in_items(i * ITEMS))), F.expr(f"cast(array() as array<{FOUND}>)"))
        else:
            found = F.transform(entities(F.col(f)), _in_field(i * ITEMS))
        out = out.withColumn(f"__e{i}", found)
    prefixes = F.create_map(*[x for k, v in PREFIX.items() for x in (F.lit(k), F.lit(v))])
    key = lambda x: F.concat(x["type"], F.lit(":"), squeeze(F.lower(strip(x["text"]))))
    start = F.expr(f"cast(array() as array<{REGISTERED}>)")

    def register(acc, x):
        same = F.filter(acc, lambda k: key(k) == key(x))
        prefix = F.element_at(prefixes, x["type"])
        number = F.size(F.array_distinct(F.transform(F.filter(acc, lambda k: F.element_at(prefixes, k["type"]) == prefix), lambda k: k["replacement"]))) + 1
        name = F.coalesce(F.get(same, F.lit(0))["replacement"], F.concat(F.lit("["), prefix, F.lit("_"), number.cast("string"), F.lit("]")))
        return F.concat(acc, F.array(F.struct(*[x[k].alias(k) for k in ("text", "start", "end", "type", "priority", "method", "field")], name.alias("replacement"))))

    out = out.withColumn("__all", F.aggregate(F.concat(*[F.col(f"__e{i}") for i in range(len(fields))]), start, register))
    for i, f in enumerate(fields):
        if f in arrays:
            out = out.withColumn(f, F.transform(F.col(f), _replace_items(i * ITEMS)))
        else:
            out = out.withColumn(f, F.when(F.col(f).isNotNull(), replace_spans(F.col(f), F.filter("__all", _of_field(i * ITEMS)))))
    names = F.array(*[F.lit(f) for f in fields])
    listed = F.array(*[F.lit(f in arrays) for f in fields])

    def field_name(x: Column) -> Column:
        i = F.floor(x["field"] / ITEMS).cast("int")
        item = F.concat(F.lit("["), (x["field"] % ITEMS).cast("string"), F.lit("]"))
        return F.concat(F.get(names, i), F.when(F.get(listed, i), item).otherwise(""))

    shown = F.transform(
        "__all",
        lambda x: F.struct(
            *([x["text"].alias("original")] if pseudonymize else []), x["replacement"].alias("replacement"), x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["method"].alias("method"), field_name(x).alias("field")
        ),
    )
    parts = [F.lit("pseudonymize" if pseudonymize else "anonymize").alias("mode"), shown.alias("entities")]
    if pseudonymize:
        parts.append(F.map_from_entries(F.array_distinct(F.transform("__all", lambda x: F.struct(key(x), x["replacement"])))).alias("mapping"))
    return out.withColumn("anonymization", F.struct(*parts)).drop("__all", *[f"__e{i}" for i in range(len(fields))])


def anonymize_pending(df: DataFrame, fields: list[str], pseudonymize: bool = False) -> DataFrame:
    """Like :func:`anonymize` for rows that have none yet; rows with an ``anonymization`` stay as they are."""
    if "anonymization" not in df.columns:
        return anonymize(df, fields, pseudonymize)
    done = df.where("anonymization is not null")
    return done.unionByName(anonymize(df.where("anonymization is null").drop("anonymization"), fields, pseudonymize))


def anonymized_rows(df: DataFrame) -> DataFrame:
    """One row: rows, and how many of them hold an ``anonymization``."""
    have = F.count("anonymization") if "anonymization" in df.columns else F.lit(0).cast("bigint")
    return df.agg(F.count("*").alias("rows"), have.alias("anonymized"))
