"""Registered queries of the core and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pauta.cluster import cut_lineage
from pauta.functions import spans as S
from pauta.functions import temporal as N
from pauta.functions import text as X
from pauta.operators import annotate, anonymize, arguments, errors, gold, metrics, ml, qa, splits, validate
from pauta.operators.triggers import PATTERNS, PHRASES, trigger
from pauta.plans import pipelines
from pauta.sources import generate
from pauta.span_sql import annotations_sql, spans_sql, topics_sql
from pauta.timestamps import LISBON, instants, zone_violations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LABEL = "regexp_replace(regexp_replace(strip_accents(lower(trim(coalesce({0}, '')))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _mails(spark, d, *cols) -> DataFrame:
    """Distinct records of the largest table, the given columns only."""
    return _read(spark, d, "dataset").select("id", *cols).distinct()


def _tests(spark, d, *cols) -> DataFrame:
    return _read(spark, d, "test_dataset").select("id", *cols).distinct()


# ---------------------------------------------------------------- timestamps


@query()
def p2_found(spark, d):
    return instants(_read(spark, d, "test_dataset"), "id", ["sent_datetime", "time_expression"])


@query()
def p2_zones(spark, d):
    """The wall clocks of imported mails without their offsets: the zone found against ingestion times."""
    mails = _read(spark, d, "imported_emails").select(F.substring("sent_datetime", 1, 19).alias("sent_local"), "imported_at")
    return zone_violations(mails, "sent_local", "imported_at", [LISBON, "Atlantic/Azores", "Europe/Madrid", "UTC"])


# ---------------------------------------------------------------- text functions

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(body, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,!?@:/\-]', '', 'g')"


def _sql_tails(expr: str, tails: list[str], flags: str = "(?s)") -> str:
    for p in tails:
        inner = p.replace(".*", "[^\\n]*")
        expr = f"regexp_replace({expr}, '{flags}(?:{inner}).*$', '')"
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


@query(rf"SELECT DISTINCT id, {_NORMAL} AS clean FROM dataset")
def text_normalize(spark, d):
    return _mails(spark, d, "body").select("id", X.normalize(F.col("body")).alias("clean"))


@query(f"SELECT DISTINCT id, {_sql_tails(_sql_tails(_NORMAL, X.HISTORY_TAILS), X.SIGNATURE_TAILS)} AS clean FROM dataset")
def text_clean_body(spark, d):
    return _mails(spark, d, "body").select("id", X.clean_body(F.col("body")).alias("clean"))


_MODEL = f"lower({_NORMAL.replace('body', _sql_tails(_sql_tails('body', X.THREAD_TAILS, '(?is)'), X.LONG_SIGNATURE_TAILS, '(?is)'))})"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


@query(
    rf"""SELECT DISTINCT id, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace({_MODEL}, '[.,!?;:-]', '', 'g'), '\d+', '', 'g'), '\s+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w)), ' ') AS clean FROM dataset"""
)
def text_preprocess(spark, d):
    return _mails(spark, d, "body").select("id", X.preprocess(F.col("body"), punctuation=True, digits=True, stopwords=True).alias("clean"))


_ENTITY_SQL = "t"
for _k, _v in X.ENTITIES.items():
    _ENTITY_SQL = "replace({}, '{}', '{}')".format(_ENTITY_SQL, _k, _v.replace("'", "''"))


@query(
    rf"""WITH a AS (SELECT DISTINCT email_id, regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM imported_emails)
SELECT DISTINCT email_id, regexp_replace(regexp_replace({_ENTITY_SQL}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS body_text FROM a"""
)
def text_html(spark, d):
    return _read(spark, d, "imported_emails").select("email_id", "body").distinct().select("email_id", X.html_to_text(F.col("body")).alias("body_text"))


@query("SELECT DISTINCT id, coalesce(contains(subject, 'Re:'), false) OR coalesce(contains(body, '>'), false) AS is_reply, length(body) - length(replace(body, '>', '')) AS thread_level FROM dataset")
def text_reply(spark, d):
    return _mails(spark, d, "subject", "body").select("id", X.is_reply(F.col("subject"), F.col("body")).alias("is_reply"), X.thread_level(F.col("body")).cast("bigint").alias("thread_level")).distinct()


@query(r"SELECT DISTINCT id, regexp_replace(time_expression, '(\d{1,2})h', '\1:00', 'g') AS t FROM dataset")
def text_hours(spark, d):
    return _mails(spark, d, "time_expression").select("id", X.normalize_hours(F.col("time_expression")).alias("t")).distinct()


@query(rf"SELECT DISTINCT id, {_STRIP.format("coalesce(subject, '') || ' ' || coalesce(subject, '') || ' ' || coalesce(body, '')")} AS t FROM dataset")
def text_combine(spark, d):
    return _mails(spark, d, "subject", "body").select("id", X.combine_fields(F.col("subject"), F.col("body"), 2, 1).alias("t")).distinct()


@query("SELECT DISTINCT id, array_to_string(regexp_extract_all(strip_accents(lower(subject)), '[a-z0-9]+'), ' ') AS t FROM dataset")
def text_topic_tokens(spark, d):
    return _mails(spark, d, "subject").select("id", F.array_join(X.topic_tokens(F.col("subject")), " ").alias("t")).distinct()


@query(
    r"""WITH p AS (SELECT DISTINCT id, unnest(participants) AS name FROM dataset)
SELECT regexp_replace(trim(regexp_replace(replace(lower(name), '.', ' '), '\s+', ' ', 'g')), '^(?:(?:professora?|prof|dra?) )+', '') AS person, count(*) AS n FROM p GROUP BY 1"""
)
def text_person_keys(spark, d):
    p = _read(spark, d, "dataset").select("id", "participants").distinct().select("id", F.explode("participants").alias("name")).distinct()
    return p.groupBy(X.person_key(F.col("name")).alias("person")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(coalesce(time_expression, ''), '^\s+|\s+$', '', 'g'), '[,;:.!?]+$', ''), '\s+', ' ', 'g') AS answer,
regexp_matches(lower(coalesce(topic, '')), '^\s*(não|nenhum|nenhuma|nada|vazio|sem|ausente|falta)') OR coalesce(topic, '') = '' AS empty FROM dataset"""
)
def text_answers(spark, d):
    return _mails(spark, d, "time_expression", "topic").select("id", X.clean_answer(F.col("time_expression")).alias("answer"), X.is_empty_answer(F.col("topic")).alias("empty")).distinct()


@query(
    r"""WITH a AS (SELECT DISTINCT sha256(regexp_replace(body, '^\s+|\s+$', '', 'g')) AS f FROM dataset WHERE regexp_replace(body, '^\s+|\s+$', '', 'g') <> ''),
b AS (SELECT DISTINCT sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS f FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
SELECT (SELECT count(*) FROM a) AS mails, (SELECT count(*) FROM b) AS documents, (SELECT count(*) FROM a JOIN b USING (f)) AS shared"""
)
def text_fingerprints(spark, d):
    a = _read(spark, d, "dataset").select(X.fingerprint(F.col("body")).alias("f")).where("f is not null").distinct()
    b = _read(spark, d, "documents").select(X.fingerprint(F.col("text")).alias("f")).where("f is not null").distinct()
    both = a.select("f", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select("f", F.lit(0), F.lit(1))).groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.agg(F.sum("a").alias("mails"), F.sum("b").alias("documents"), F.sum(F.col("a") * F.col("b")).alias("shared"))


# ---------------------------------------------------------------- spans and extraction


@query(
    r"""WITH t AS (SELECT DISTINCT id, body FROM dataset WHERE body IS NOT NULL)
SELECT id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(body, '[0-9]+'), lambda x: length(x))), 0) AS BIGINT) AS covered, CAST(len(regexp_extract_all(body, '[0-9]+')) AS BIGINT) AS n FROM t"""
)
def span_numbers(spark, d):
    m = S.matches(F.col("body"), "[0-9]+")
    covered = F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + (x["end"] - x["start"]))
    return _mails(spark, d, "body").where("body is not null").select("id", covered.alias("covered"), F.size(m).cast("bigint").alias("n"))


_TIME_RULES = [(p, 0.9, f"regex_{kind}") for kind, ps in arguments.TIME_SPANS.items() for p in ps]
_PLAIN_LABEL = "lower(coalesce(label, ''))"


@query(spans_sql("dataset", "id", "body", _TIME_RULES))
def span_times(spark, d):
    return _mails(spark, d, "body").select("id", F.explode(arguments.time_spans(F.coalesce("body", F.lit("")))).alias("s")).select("id", "s.*")


@query(spans_sql("dataset", "id", "body", [(p, 0.85, "regex_location") for p in arguments.PLACE_SPANS]))
def span_places(spark, d):
    return _mails(spark, d, "body").select("id", F.explode(arguments.place_spans(F.coalesce("body", F.lit("")))).alias("s")).select("id", "s.*")


@query(spans_sql("dataset", "id", "body", [(p, 0.9, "regex_hint") for p in arguments.HINTS], first_of_a_spelling=True))
def span_hints(spark, d):
    return _mails(spark, d, "body").select("id", F.explode(arguments.hint_spans(F.coalesce("body", F.lit("")))).alias("s")).select("id", "s.*")


def _trigger_sql(label: str) -> str:
    """The phrases and patterns as one CASE an intent; word borders as classes of letters, as the SQL's ``\\b`` knows ASCII only."""
    edge, word = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    quote = lambda x: x.replace("'", "''")
    cases = []
    for intent in PHRASES:
        tried = []
        for p in sorted(dict.fromkeys(PHRASES[intent]), key=len, reverse=True):
            tried.append(f"WHEN regexp_matches(t, '{edge}{quote(p)}{word}') THEN 'exact|{quote(p)}'")
        for p in PATTERNS[intent]:
            core = p.removeprefix(r"\b").removesuffix(r"\b")
            guard = f"(?i){edge}({core})" + (word if p.endswith(r"\b") else "")
            tried.append(f"WHEN regexp_matches(t, '{quote(guard)}') THEN 'regex|' || regexp_extract(t, '{quote(guard)}', 1)")
        cases.append(f"WHEN '{intent}' THEN CASE {' '.join(tried)} END")
    folded = r"regexp_replace(translate(lower(regexp_replace(body, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), 'ãõç', 'aoc'), '[\s\p{Z}]+', ' ', 'g')"
    return f"WITH m AS (SELECT DISTINCT id, body, label FROM dataset), x AS (SELECT id, {folded} AS t, {label} AS intent FROM m), f AS (SELECT id, CASE intent {' '.join(cases)} END AS found FROM x) SELECT id, nullif(split_part(found, '|', 2), '') AS trigger, nullif(split_part(found, '|', 1), '') AS method FROM f"


@query(_trigger_sql(_LABEL.format("label")))
def extract_triggers(spark, d):
    t = trigger(F.col("body"), X.label_key(F.col("label")))
    return _mails(spark, d, "body", "label").withColumn("t", t).select("id", "t.trigger", "t.method")


def _topics_sql(table: str, key: str, columns: str) -> str:
    body = [("body", p + arguments.CAPTURE, 0.98) for p in arguments.TOPIC_BODY]
    title = [("title", p, 0.9) for p in arguments.TOPIC_SUBJECT]
    return topics_sql(table, key, columns, body + title, not_meeting=arguments.NOT_MEETING, stop=arguments.TOPIC_STOP, generic=arguments.GENERIC, no_topic=arguments.ONLY_TIME_OR_PLACE.replace("(?iU)", "(?i)"))


@query(_topics_sql("dataset", "id", f"{_LABEL.format('label')} AS intent") + "SELECT id, topic FROM said")
def extract_topics(spark, d):
    t = arguments.topic_spans(F.col("body"), F.col("subject"), X.label_key(F.col("label")))
    return _mails(spark, d, "body", "subject", "label").select("id", F.get(t, F.lit(0))["text"].alias("topic"))


_PLACE_SQL = r"regexp_replace(regexp_replace(location, '^\s+|\s+$', '', 'g'), '(?i)^\s*(?:em|no|na|por|via)\s+', '')"


@query(
    rf"""WITH a AS (SELECT DISTINCT id, nullif({_PLACE_SQL}, '') AS t FROM dataset),
b AS (SELECT id, t, lower(regexp_extract(t, '(?i)\b(zoom|teams|microsoft\s+teams|google\s+meet|meet|online|remot[ao])\b')) AS r, regexp_extract(t, '(?i)\bsala(?:\s+de\s+reuni(?:ao|oes|ões))?(?:\s+[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)?)?(?:\s+do\s+departamento)?\b') AS s FROM a)
SELECT id, CASE WHEN t IS NULL THEN NULL WHEN r <> '' THEN 'remoto - ' || CASE WHEN contains(r, 'team') THEN 'teams' WHEN contains(r, 'meet') THEN 'google meet' ELSE 'zoom' END WHEN s <> '' THEN 'presencial - ' || trim(s) ELSE NULL END AS place FROM b"""
)
def extract_places(spark, d):
    return _mails(spark, d, "location").select("id", arguments.canonical_place(F.col("location")).alias("place"))


@query(
    r"""WITH m AS (SELECT DISTINCT id, list_concat(coalesce(participants, []), [sender, recipient]) AS v FROM dataset), u AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM m), c AS (SELECT id, i, trim(x) AS x, regexp_replace(trim(regexp_replace(replace(lower(x), '.', ' '), '\s+', ' ', 'g')), '^(?:(?:professora?|prof|dra?) )+', '') AS k FROM u WHERE trim(coalesce(x, '')) <> ''),
f AS (SELECT id, k, min(i) AS i, arg_min(x, i) AS x FROM c GROUP BY 1, 2) SELECT m.id, coalesce(string_agg(x, '; ' ORDER BY f.i), '') AS people FROM (SELECT DISTINCT id FROM m) m LEFT JOIN f USING (id) GROUP BY 1"""
)
def extract_people(spark, d):
    """A mail's people from its fields: each person once, in order of participants, sender, recipient."""
    m = _read(spark, d, "dataset").select("id", "participants", "sender", "recipient").distinct()
    empty = F.array().cast("array<string>")
    return m.select("id", F.array_join(X.unique_people(F.concat(F.coalesce("participants", empty), F.array("sender", "recipient"))), "; ").alias("people"))


def _mail_places_sql() -> str:
    """Words as classes of letters; a lookahead of the patterns is tested on the found place."""
    end = r"(?:$|[^\p{L}\p{N}_])"
    sql = lambda p: p.replace("(?iU)", "").replace(r"(?!\s+academica)", "").replace(r"\b", "").replace(r"\w", r"[\p{L}\p{N}_]")
    hit = lambda p: f"regexp_extract(p || ' ', '(?i)^(?:.*[^\\p{{L}}\\p{{N}}_])?({sql(p)}){end}', 1)"
    here = lambda p: f"WHEN {hit(p)} <> '' THEN 'presencial - ' || trim({hit(p)})"
    remote = f"lower({hit(arguments.REMOTE)})"
    return f"""WITH m AS (SELECT DISTINCT id, body, {_LABEL.format('label')} AS label FROM dataset), x AS (SELECT id, label, regexp_extract(coalesce(body, ''), '(?i)(?:em|no|na|por|via)\\s+({sql(arguments.ANY_PLACE)}){end}', 1) AS p FROM m)
SELECT id, CASE WHEN label IN ('agendamento_reuniao', 'cancelamento_reuniao', 'reuniao_confirmada') THEN CASE WHEN p = '' THEN 'remoto - zoom' WHEN {remote} <> '' THEN 'remoto - ' || CASE WHEN contains({remote}, 'team') THEN 'teams' WHEN contains({remote}, 'meet') THEN 'google meet' ELSE 'zoom' END {here(arguments.DEPARTMENT_ROOM)} {here(arguments.ROOM)} {here(arguments.OFFICE)} {here(arguments.PRESENT)} ELSE 'remoto - zoom' END END AS place FROM x"""


@query(_mail_places_sql())
def extract_mail_places(spark, d):
    return _mails(spark, d, "body", "label").select("id", arguments.place_of_mail(F.col("body"), X.label_key(F.col("label"))).alias("place"))


@query(annotations_sql("dataset", "id", annotate))
def extract_annotations(spark, d):
    a = annotate.annotation(X.strip(F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))))
    return _mails(spark, d, "body", "subject").select("id", a.alias("a")).select("id", "a.trigger", F.to_json("a.arguments").alias("arguments"), F.to_json("a.confidence").alias("confidence"))


@query()
def anonymized(spark, d):
    base = _read(spark, d, "imported_emails").select("email_id", "subject", "body", "sender").distinct()
    return anonymize.anonymize(base, ["subject", "body", "sender"]).select("email_id", "subject", "body", "sender", F.size("anonymization.entities").alias("entities"))


@query(
    r"""WITH t AS (SELECT DISTINCT email_id, coalesce(body, '') AS b FROM imported_emails)
SELECT CAST(sum(len(regexp_extract_all(b, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'))) AS BIGINT) AS addresses, CAST(sum(len(regexp_extract_all(b, '(?i)\b(?:https?://|www\.)[^\s<>"]+'))) AS BIGINT) AS links FROM t"""
)
def anonymize_counts(spark, d):
    b = F.coalesce("body", F.lit(""))
    count = lambda p: F.sum(F.size(F.regexp_extract_all(b, F.lit(p), F.lit(0)))).cast("bigint")
    t = _read(spark, d, "imported_emails").select("email_id", b.alias("body")).distinct()
    return t.agg(count(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b").alias("addresses"), count(r"(?i)\b(?:https?://|www\.)[^\s<>\"]+").alias("links"))


# ---------------------------------------------------------------- temporal rules

_REF = "try_cast(regexp_replace(sent_datetime, '(?:Z|[+-][0-9]{2}:?[0-9]{2})$', '') AS TIMESTAMP)"
_EXPR = r"trim(regexp_replace(lower(strip_accents(coalesce(time_expression, ''))), '\s+', ' ', 'g'))"
_MONTHS_SQL = "['janeiro', 'fevereiro', 'marco', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro']"
_DAYS_SQL = "['segunda', 'terca', 'quarta', 'quinta', 'sexta', 'sabado', 'domingo']"
_CLOCK = "'([0-9]{1,2})(?:h([0-9]{2})?|:([0-9]{2}))$'"
#: The notations of the tables' expressions, written anew as relational rules: a day (date, day of the month, weekday,
#: relative day, next week, days from now) and a clock time or a part of the day; all else is unknown.
_RULES = f"""b AS (SELECT *, CAST(r AS DATE) AS today, try_cast(regexp_extract(e, {_CLOCK}, 1) AS INT) AS h, coalesce(try_cast(regexp_extract(e, {_CLOCK}, 2) AS INT), try_cast(regexp_extract(e, {_CLOCK}, 3) AS INT), 0) AS m, CASE WHEN regexp_matches(e, '(?:^|de )manha$') THEN [360, 720] WHEN regexp_matches(e, '(?:^|a |de )tarde$') THEN [720, 1080] WHEN regexp_matches(e, '(?:^|a |de )noite$') THEN [1080, 1439] END AS part, e IN ('manha', 'de manha', 'tarde', 'a tarde', 'de tarde', 'noite', 'a noite', 'de noite') AS alone,
 try_cast(regexp_extract(e, '^dia ([0-9]{{1,2}})\\b', 1) AS INT) AS n, try_cast(regexp_extract(e, '^(?:dia )?([0-9]{{1,2}}) de ', 1) AS INT) AS nd, list_position({_MONTHS_SQL}, regexp_extract(e, '^(?:dia )?[0-9]{{1,2}} de ([a-z]+)\\b', 1)) AS k, regexp_extract(e, '^(segunda|terca|quarta|quinta|sexta|sabado|domingo)(-feira)?\\b', 0) AS w, regexp_extract(e, '^(hoje|amanha|depois de amanha|ontem)\\b', 1) AS rel, try_cast(regexp_extract(e, '^daqui a ([0-9]+) dias?\\b', 1) AS INT) AS ahead FROM a),
c AS (SELECT *, CASE WHEN h < 24 AND m < 60 THEN h * 60 + m END AS clock, try_cast(year(r) || '-' || lpad(CAST(k AS VARCHAR), 2, '0') || '-' || lpad(CAST(nd AS VARCHAR), 2, '0') AS DATE) AS named, CASE WHEN w <> 'terca-feira' THEN list_position({_DAYS_SQL}, replace(w, '-feira', '')) - isodow(r) END AS off FROM b),
d AS (SELECT *, (SELECT min(t) FROM (SELECT try_cast(strftime(date_trunc('month', c.today) + to_months(CAST(i AS INT)), '%Y-%m-') || lpad(CAST(c.n AS VARCHAR), 2, '0') AS DATE) AS t FROM range(13) x(i)) WHERE CASE WHEN c.clock IS NULL THEN t >= c.today ELSE CAST(t AS TIMESTAMP) + to_minutes(c.clock) > c.r END) AS next_day, today + CAST(CASE WHEN off < 0 THEN off + 7 WHEN off > 0 THEN off WHEN clock * 60 > epoch(r) - epoch(today) THEN 0 ELSE 7 END AS INT) AS on_weekday FROM c),
f AS (SELECT *, CASE WHEN r IS NULL THEN NULL WHEN named IS NOT NULL THEN 'named' WHEN next_day IS NOT NULL THEN 'month' WHEN off IS NOT NULL AND part IS NOT NULL AND clock IS NULL THEN 'weekday_part' WHEN rel <> '' THEN 'relative' WHEN regexp_matches(e, '^(?:na )?proxima semana|^para a semana') THEN 'week' WHEN e LIKE 'esta semana%' THEN 'this_week' WHEN ahead IS NOT NULL THEN 'ahead' WHEN off IS NOT NULL THEN 'weekday' WHEN alone THEN 'part' WHEN clock IS NOT NULL THEN 'clock' ELSE 'unknown' END AS rule FROM d),
g AS (SELECT *, CASE rule WHEN 'named' THEN named WHEN 'month' THEN next_day WHEN 'weekday_part' THEN on_weekday WHEN 'weekday' THEN on_weekday WHEN 'relative' THEN today + CASE rel WHEN 'hoje' THEN 0 WHEN 'amanha' THEN 1 WHEN 'ontem' THEN -1 ELSE 2 END WHEN 'ahead' THEN today + ahead WHEN 'clock' THEN today WHEN 'part' THEN today WHEN 'week' THEN CAST(date_trunc('week', today) AS DATE) + 7 WHEN 'this_week' THEN CAST(date_trunc('week', today) AS DATE) END AS day, CASE WHEN rule IN ('named', 'month', 'weekday_part', 'relative', 'part') THEN part END AS used FROM f),
o AS (SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('week', 'this_week') OR (used IS NOT NULL AND clock IS NULL) THEN 'interval' WHEN rule = 'clock' THEN 'time' WHEN rule = 'unknown' THEN 'unknown' WHEN clock IS NOT NULL THEN 'datetime' WHEN rule IN ('relative', 'ahead') THEN 'relative' WHEN rule IS NOT NULL THEN 'date' END AS type FROM g),
z AS (SELECT *, CASE WHEN rule IN ('week', 'this_week') THEN strftime(day, '%Y-%m-%dT00:00:00') || '/' || strftime(day + 6, '%Y-%m-%dT23:59:59') WHEN type = 'interval' THEN strftime(CAST(day AS TIMESTAMP) + to_minutes(used[1]), '%Y-%m-%dT%H:%M:%S') || '/' || strftime(CAST(day AS TIMESTAMP) + to_minutes(used[2]), '%Y-%m-%dT%H:%M:%S')
WHEN type IN ('datetime', 'time') THEN strftime(CAST(day AS TIMESTAMP) + to_minutes(clock), '%Y-%m-%dT%H:%M:%S') WHEN type IN ('date', 'relative') THEN strftime(day, '%Y-%m-%d') END AS canonical,
CASE WHEN rule IN ('week', 'this_week') THEN 'week' WHEN type = 'interval' THEN 'time_of_day' WHEN type = 'datetime' THEN 'exact' WHEN type = 'time' THEN 'time_only' WHEN type = 'unknown' THEN '' WHEN type IS NOT NULL THEN 'day' END AS precision,
CAST(CASE rule WHEN 'named' THEN 0.95 WHEN 'month' THEN 0.88 WHEN 'weekday_part' THEN 0.75 WHEN 'relative' THEN 0.85 WHEN 'week' THEN 0.75 WHEN 'this_week' THEN 0.75 WHEN 'part' THEN 0.75 WHEN 'ahead' THEN 0.9 WHEN 'weekday' THEN 0.9 WHEN 'clock' THEN 0.8 WHEN 'unknown' THEN 0.0 END AS DOUBLE) AS confidence FROM o) """


@query(f"WITH a AS (SELECT DISTINCT id, {_EXPR} AS e, {_REF} AS r FROM dataset), " + _RULES + "SELECT id, type, canonical, precision, confidence FROM z")
def temporal_normalize(spark, d):
    """Every expression of the largest table against its mail's date."""
    n = N.normalize(F.col("time_expression"), N.parse_reference(F.col("sent_datetime")))
    return _mails(spark, d, "time_expression", "sent_datetime").withColumn("n", n).select("id", "n.type", N.canonical(F.col("n")).alias("canonical"), "n.precision", "n.confidence")


@query(
    "WITH a AS (SELECT DISTINCT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS r FROM orders) SELECT k, strftime(date_trunc('week', r), '%Y-%m-%dT%H:%M:%S') || '/' || strftime(date_trunc('week', r) + INTERVAL 7 DAY - INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') AS this_week, strftime(date_trunc('month', r) + INTERVAL 1 MONTH, '%Y-%m-%dT%H:%M:%S') || '/' || strftime(date_trunc('month', r) + INTERVAL 2 MONTH - INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') AS next_month, strftime(date_trunc('week', r) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end FROM a"
)
def temporal_week_month(spark, d):
    ref = F.col("o_orderdate").cast("timestamp").cast("timestamp_ntz")
    say = lambda e: N.canonical(N.normalize(F.lit(e), ref))
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), say("esta semana").alias("this_week"), say("próximo mês").alias("next_month"), say("fim da semana").alias("week_end")).distinct()


def _records_sql() -> str:
    """Trigger, spans with canonical times, places, addresses and topic, each by its own SQL, put together."""
    plain = r"trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))"
    times = spans_sql("dataset", "id", "body", _TIME_RULES)
    places = spans_sql("dataset", "id", "body", [(p, 0.85, "regex_location") for p in arguments.PLACE_SPANS])
    people = spans_sql("dataset", "id", "body", [(arguments.EMAIL, 0.95, "regex_email")], first_of_a_spelling=True)
    topics = _topics_sql("dataset", "id", "coalesce(label, '') AS intent") + "SELECT id, topic FROM said"
    one = """'{"text":' || to_json(text) || ',"start":' || start || ',"end":' || "end" || coalesce(',"canonical":"' || canonical || '"', '') || '}'"""
    return (
        f"WITH a AS (SELECT s.*, {plain} AS e, r FROM ({times}) s JOIN (SELECT DISTINCT id, {_REF} AS r FROM dataset) USING (id)), {_RULES}, every AS (SELECT DISTINCT id FROM dataset), t AS (SELECT id, '[' || string_agg({one}, ',' ORDER BY start) || ']' AS times FROM z GROUP BY 1), "
        f"l AS (SELECT id, string_agg(text, '; ' ORDER BY start) AS locations FROM ({places}) GROUP BY 1), q AS (SELECT id, string_agg(text, '; ' ORDER BY start) AS participants FROM ({people}) GROUP BY 1), w AS ({_trigger_sql(_PLAIN_LABEL)}), v AS ({topics}) "
        "SELECT every.id, w.trigger, coalesce(times, '[]') AS times, coalesce(locations, '') AS locations, coalesce(participants, '') AS participants, v.topic FROM every LEFT JOIN w USING (id) LEFT JOIN v USING (id) LEFT JOIN t USING (id) LEFT JOIN l USING (id) LEFT JOIN q USING (id)"
    )


@query(_records_sql())
def extract_records(spark, d):
    out = pipelines.records(_mails(spark, d, "subject", "body", "label", "sent_datetime"))
    return out.select("id", "trigger.trigger", F.to_json("times").alias("times"), F.array_join("locations", "; ").alias("locations"), F.array_join("participants", "; ").alias("participants"), "topic")


@query(_records_sql())
def flagship(spark, d):
    """Trigger, time spans with canonical times, places, participants and topic of every mail."""
    return extract_records(spark, d)


@query(
    """SELECT DISTINCT id, strftime(coalesce(try_cast(regexp_replace(sent_datetime, '(?:Z|[+-][0-9]{2}:?[0-9]{2})$', '') AS TIMESTAMP), try_cast(regexp_replace(time_expression, '(?:Z|[+-][0-9]{2}:?[0-9]{2})$', '') AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%S') AS reference FROM dataset"""
)
def temporal_reference(spark, d):
    ref = N.parse_reference(F.col("sent_datetime"), F.col("time_expression"))
    return _mails(spark, d, "sent_datetime", "time_expression").select("id", F.date_format(ref, "yyyy-MM-dd'T'HH:mm:ss").alias("reference")).distinct()


# ---------------------------------------------------------------- joins

_L, _I = _LABEL.format("label"), _LABEL.format("intent")


def _pairs(spark, d) -> DataFrame:
    """Every annotation with its mail's label: the annotation's intent is the prediction."""
    gold = _read(spark, d, "gold_annotations").select("id", "dataset_id", X.label_key(F.col("intent")).alias("predicted_label")).distinct()
    mails = _tests(spark, d, "label").groupBy("id").agg(F.min(X.label_key(F.col("label"))).alias("true_label"))
    return gold.join(mails.withColumnRenamed("id", "dataset_id"), "dataset_id")


_PAIRS = f"WITH g AS (SELECT DISTINCT id, dataset_id, {_I} AS p FROM gold_annotations), m AS (SELECT id AS dataset_id, min({_L}) AS t FROM test_dataset GROUP BY 1), x AS (SELECT g.id, g.dataset_id, g.p, m.t FROM g JOIN m USING (dataset_id)) "


@query(_PAIRS + "SELECT id, dataset_id, p AS predicted_label, t AS true_label FROM x")
def join_gold_mails(spark, d):
    return _pairs(spark, d).select("id", "dataset_id", "predicted_label", "true_label")


@query(
    f"""WITH g AS (SELECT dataset_id, id, {_I} AS intent, row_number() OVER (PARTITION BY dataset_id ORDER BY id DESC, {_I} DESC) AS r FROM gold_annotations WHERE dataset_id IS NOT NULL)
SELECT m.id, g.id AS gold_id, g.intent FROM (SELECT DISTINCT id FROM test_dataset) m JOIN (SELECT * FROM g WHERE r = 1) g ON g.dataset_id = m.id"""
)
def join_last_gold(spark, d):
    """Inner join in which the last annotation of a mail wins."""
    g = _read(spark, d, "gold_annotations").where("dataset_id is not null").select("dataset_id", F.col("id").alias("gold_id"), X.label_key(F.col("intent")).alias("intent"))
    last = g.groupBy("dataset_id").agg(F.max(F.struct("gold_id", "intent")).alias("g")).select(F.col("dataset_id").alias("id"), "g.gold_id", "g.intent")
    return _tests(spark, d).join(last, "id")


@query(
    """WITH m AS (SELECT DISTINCT id FROM test_dataset), g AS (SELECT DISTINCT dataset_id AS id FROM gold_annotations WHERE dataset_id IS NOT NULL)
SELECT 'missing' AS kind, count(*) AS n FROM m WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'extra', count(*) FROM g WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT 'both', count(*) FROM m JOIN g USING (id)"""
)
def join_missing_extra(spark, d):
    m = _tests(spark, d).select("id", F.lit(1).alias("m"))
    g = _read(spark, d, "gold_annotations").where("dataset_id is not null").select(F.col("dataset_id").alias("id"), F.lit(1).alias("g")).distinct()
    both = m.join(g, "id", "full")
    kind = F.when(F.col("g").isNull(), "missing").when(F.col("m").isNull(), "extra").otherwise("both")
    counts = both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([("missing",), ("extra",), ("both",)], "kind string").join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """WITH g AS (SELECT dataset_id AS id, count(DISTINCT id) AS n FROM gold_annotations GROUP BY 1) SELECT m.id, coalesce(g.n, 0) AS annotations FROM (SELECT DISTINCT id FROM test_dataset) m LEFT JOIN g USING (id)"""
)
def join_left_outer(spark, d):
    g = _read(spark, d, "gold_annotations").groupBy(F.col("dataset_id").alias("id")).agg(F.countDistinct("id").alias("n"))
    return _tests(spark, d).join(g, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("annotations"))


_KEY = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query(
    f"""WITH g AS (SELECT DISTINCT id, text FROM gold_annotations), m AS (SELECT DISTINCT id, body FROM test_dataset),
t AS (SELECT {_KEY.format("body")} AS k, min(id) AS tid FROM m WHERE {_KEY.format("body")} <> '' GROUP BY 1)
SELECT g.id, coalesce(a.id, b.id, t.tid) AS mail_id, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN b.id IS NOT NULL THEN 'shifted' WHEN t.tid IS NOT NULL THEN 'text' ELSE 'none' END AS how
FROM g LEFT JOIN (SELECT DISTINCT id FROM m) a ON a.id = g.id LEFT JOIN (SELECT DISTINCT id FROM m) b ON b.id = g.id - 1 LEFT JOIN t ON t.k = {_KEY.format("g.text")}"""
)
def join_lookup_cascade(spark, d):
    """Annotation to mail by id, else by the id before, else by the normalised text."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"[\t\n\f\r ]+", " "))
    g = _read(spark, d, "gold_annotations").select("id", "text").distinct().withColumn("k", key("text"))
    m = _tests(spark, d, "body")
    ids = m.select("id").distinct()
    t = m.select(key("body").alias("k"), "id").where("k <> ''").groupBy("k").agg(F.min("id").alias("tid"))
    out = g.join(ids.withColumn("a", F.col("id")), "id", "left").join(ids.select((F.col("id") + 1).alias("id"), F.col("id").alias("b")), "id", "left").join(t, "k", "left")
    how = F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "shifted").when(F.col("tid").isNotNull(), "text").otherwise("none")
    return out.select("id", F.coalesce("a", "b", "tid").alias("mail_id"), how.alias("how"))


@query(
    """WITH p AS (SELECT DISTINCT sender, sender_role FROM dataset WHERE sender IS NOT NULL), r AS (SELECT DISTINCT recipient, recipient_role FROM dataset WHERE recipient IS NOT NULL)
SELECT sender_role AS role, count(*) AS pairs FROM p JOIN r ON sender_role = recipient_role AND sender <> recipient GROUP BY 1"""
)
def join_role_pairs(spark, d):
    """Counts of sender and recipient pairs with one role and different names, from the roles' name counts."""
    m = _read(spark, d, "dataset")
    p = m.where("sender is not null").select(F.col("sender_role").alias("role"), F.col("sender").alias("name")).distinct()
    r = m.where("recipient is not null").select(F.col("recipient_role").alias("role"), F.col("recipient").alias("name")).distinct()
    n = p.groupBy("role").agg(F.count("*").alias("a")).join(r.groupBy("role").agg(F.count("*").alias("b")), "role")
    same = p.join(r, ["role", "name"]).groupBy("role").agg(F.count("*").alias("c"))
    return n.join(same, "role", "left").select("role", (F.col("a") * F.col("b") - F.coalesce("c", F.lit(0))).alias("pairs")).where("pairs > 0")


# ---------------------------------------------------------------- classification metrics

_CLASS = _PAIRS + ", l AS (SELECT DISTINCT t AS label FROM x UNION SELECT DISTINCT p FROM x), c AS (SELECT label, (SELECT count(*) FROM x WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM x WHERE p = label AND t <> label) AS fp, (SELECT count(*) FROM x WHERE t = label AND p <> label) AS fn FROM l), f AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c) "


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_CLASS + "SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_report(spark, d):
    return _rounded(metrics.class_metrics(_pairs(spark, d)))


@query(
    _CLASS
    + "SELECT CAST(sum(support) AS BIGINT) AS rows, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f"
)
def class_summary(spark, d):
    return _rounded(metrics.summary_metrics(_pairs(spark, d)))


@query(_CLASS + "SELECT a.label AS true_label, b.label AS predicted_label, (SELECT count(*) FROM x WHERE t = a.label AND p = b.label) AS n FROM l a, l b")
def confusion_matrix(spark, d):
    return metrics.confusion(_pairs(spark, d))


@query(
    _PAIRS
    + """, e AS (SELECT * FROM x WHERE t <> p) SELECT 'true' AS kind, t AS key, count(*) AS n FROM e GROUP BY t UNION ALL SELECT 'predicted', p, count(*) FROM e GROUP BY p UNION ALL SELECT 'pair', t || ' -> ' || p, count(*) FROM e GROUP BY t, p UNION ALL SELECT 'total', '', count(*) FROM e"""
)
def error_analysis(spark, d):
    return metrics.error_analysis(_pairs(spark, d))


@query(f"WITH m AS (SELECT DISTINCT id, {_L} AS value FROM dataset) SELECT value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM m GROUP BY value")
def class_distribution(spark, d):
    return metrics.distribution(_mails(spark, d, "label").select("id", X.label_key(F.col("label")).alias("value")).distinct(), "value")


_VOTES = f"WITH m AS (SELECT id, min({_L}) AS a, max({_L}) AS b, min(substr({_L}, 1, 6)) AS c FROM test_dataset GROUP BY id), g AS (SELECT dataset_id AS id, min({_I}) AS v1, max({_I}) AS v2 FROM gold_annotations WHERE dataset_id IS NOT NULL GROUP BY 1) "


@query(_VOTES + "SELECT m.id, a AS lr, v1 AS nb, v2 AS dt, CASE WHEN v1 = v2 THEN v1 ELSE a END AS intent FROM m JOIN g USING (id)")
def majority_vote(spark, d):
    m = _tests(spark, d, "label").groupBy("id").agg(F.min(X.label_key(F.col("label"))).alias("lr"))
    k = X.label_key(F.col("intent"))
    g = _read(spark, d, "gold_annotations").where("dataset_id is not null").groupBy(F.col("dataset_id").alias("id")).agg(F.min(k).alias("nb"), F.max(k).alias("dt"))
    return m.join(g, "id").withColumn("intent", metrics.vote("lr", "nb", "dt"))


@query(f"SELECT (SELECT count(*) FROM (SELECT DISTINCT {_L} FROM dataset EXCEPT SELECT DISTINCT {_I} FROM gold_annotations)) AS only_mails, (SELECT count(*) FROM (SELECT DISTINCT {_I} FROM gold_annotations EXCEPT SELECT DISTINCT {_L} FROM dataset)) AS only_gold, (SELECT count(*) FROM (SELECT DISTINCT {_L} FROM dataset UNION SELECT DISTINCT {_I} FROM gold_annotations)) AS either")
def set_operations(spark, d):
    a = _read(spark, d, "dataset").select(X.label_key(F.col("label")).alias("x")).distinct()
    b = _read(spark, d, "gold_annotations").select(X.label_key(F.col("intent")).alias("x")).distinct()
    s = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "x", "full")
    return s.agg(F.count_if(F.col("b").isNull()).alias("only_mails"), F.count_if(F.col("a").isNull()).alias("only_gold"), F.count("*").alias("either"))


# ---------------------------------------------------------------- spans and answers


_CLEAN = "list_distinct(list_filter(list_transform(coalesce({0}, []), lambda v: trim(coalesce(v, ''))), lambda v: v <> ''))"


def _argument_rows(spark, d) -> DataFrame:
    """(kind, gold, predicted) arrays: annotations against the mails' own fields."""
    kinds = ["participants", "time", "location", "topic"]
    gold = _read(spark, d, "gold_annotations").where("dataset_id is not null").select("id", "dataset_id", "arguments").distinct()
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    mails = _read(spark, d, "test_dataset").groupBy(F.col("id").alias("dataset_id")).agg(F.min("participants").alias("participants"), F.min("time_expression").alias("time"), F.min("location").alias("location"), F.min("topic").alias("topic"))
    mails = mails.select("dataset_id", F.col("participants").alias("p_participants"), one("time").alias("p_time"), one("location").alias("p_location"), one("topic").alias("p_topic"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"arguments.{k}").alias("gold"), F.col(f"p_{k}").alias("predicted")) for k in kinds])
    return gold.join(mails, "dataset_id").select("id", F.explode(rows).alias("x")).select("id", "x.*")


_ARGS = (
    """WITH m AS (SELECT id AS dataset_id, min(participants) AS participants, min(time_expression) AS time, min(location) AS location, min(topic) AS topic FROM test_dataset GROUP BY 1),
g AS (SELECT DISTINCT id, dataset_id, arguments FROM gold_annotations WHERE dataset_id IS NOT NULL),
j AS (SELECT g.id, g.arguments AS a, m.* FROM g JOIN m USING (dataset_id)),
r AS (SELECT id, 'participants' AS kind, a.participants AS gold, participants AS predicted FROM j UNION ALL SELECT id, 'time', a.time, CASE WHEN time IS NULL THEN [] ELSE [time] END FROM j UNION ALL SELECT id, 'location', a.location, CASE WHEN location IS NULL THEN [] ELSE [location] END FROM j UNION ALL SELECT id, 'topic', a.topic, CASE WHEN topic IS NULL THEN [] ELSE [topic] END FROM j),
"""
    + f"s AS (SELECT kind, {_CLEAN.format('gold')} AS g, {_CLEAN.format('predicted')} AS p FROM r), "
    + "t AS (SELECT kind, len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM s), "
    + "k AS (SELECT kind AS scope, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM t GROUP BY 1), "
    + "z AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM k), "
    + "y AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM k) "
)


@query(
    _ARGS
    + """SELECT scope, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM z
UNION ALL SELECT 'MICRO', tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6), round(tp::DOUBLE / (tp + fn), 6), round(2.0 * tp / (2 * tp + fp + fn), 6) FROM y
UNION ALL SELECT 'MACRO', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM z
UNION ALL SELECT 'WEIGHTED', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(sum(precision * (tp + fn)) / sum(tp + fn), 6), round(sum(recall * (tp + fn)) / sum(tp + fn), 6), round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) FROM z"""
)
def argument_metrics(spark, d):
    r = _argument_rows(spark, d).withColumn("c", metrics.set_counts(F.col("gold"), F.col("predicted"))).select("kind", "c.*")
    out = metrics.aggregate_counts(r.withColumns({k: F.col(k).cast("bigint") for k in ("tp", "fp", "fn")}), "kind")
    return _rounded(out)


_LOW = r"regexp_replace(lower({0}), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CHARS = "CASE WHEN {0} = '' AND {1} = '' THEN 1.0 WHEN {0} = '' OR {1} = '' THEN 0.0 ELSE len(list_intersect(list_distinct(string_split({0}, '')), list_distinct(string_split({1}, ''))))::DOUBLE / len(list_distinct(list_concat(string_split({0}, ''), string_split({1}, '')))) END"
_SQUEEZED = r"trim(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g'))"
#: The greedy pairing as a recursion over a row's predictions: each takes the best value that none before it took.
_PAIRING = (
    _ARGS.split("\nr AS ")[0].replace("WITH m AS", "WITH RECURSIVE m AS")
    + "\nr AS "
    + _ARGS.split("\nr AS ")[1].split("),\n")[0]
    + f"""), w AS (SELECT row_number() OVER () AS rid, id, kind, list_filter(coalesce(gold, []), lambda x: x IS NOT NULL) AS gold, list_filter(coalesce(predicted, []), lambda x: x IS NOT NULL) AS predicted FROM r), ps AS (SELECT rid, unnest(predicted) AS p, generate_subscripts(predicted, 1) AS n FROM w), gs AS (SELECT rid, unnest(gold) AS g, generate_subscripts(gold, 1) AS i FROM w),
sc AS (SELECT rid, n, p, g, i, CASE WHEN {_LOW.format("g")} = {_LOW.format("p")} THEN 2.0 ELSE {_CHARS.format(_LOW.format("g"), _LOW.format("p"))} END AS s FROM ps JOIN gs USING (rid)), ca AS (SELECT ps.rid, ps.n, ps.p, coalesce(list({{'i': i, 's': s, 'g': g}} ORDER BY s DESC, i) FILTER (WHERE i IS NOT NULL), []) AS c FROM ps LEFT JOIN sc USING (rid, n, p) GROUP BY 1, 2, 3),
st(rid, n, used, g, p) AS (SELECT rid, 0::BIGINT, CAST([] AS BIGINT[]), NULL::VARCHAR, NULL::VARCHAR FROM w UNION ALL SELECT rid, n, CASE WHEN b.s >= 0.6 THEN list_append(used, b.i) ELSE used END, CASE WHEN b.s >= 0.6 THEN b.g END, p FROM (SELECT ca.rid, ca.n, st.used, ca.p, list_filter(ca.c, lambda x: NOT list_contains(st.used, x.i))[1] AS b FROM st JOIN ca ON ca.rid = st.rid AND ca.n = st.n + 1)),
fin AS (SELECT rid, arg_max(used, n) AS used, max(n) AS k FROM st GROUP BY 1), raw AS (SELECT rid, n - 1 AS pos, g AS gold, p AS predicted FROM st WHERE n > 0 UNION ALL SELECT rid, fin.k + row_number() OVER (PARTITION BY rid ORDER BY i) - 1, g, NULL FROM gs JOIN fin USING (rid) WHERE NOT list_contains(used, i)),
pr AS (SELECT w.id, w.kind, pos, raw.gold, raw.predicted, CASE WHEN raw.gold IS NULL OR raw.predicted IS NULL THEN 'none' WHEN {_SQUEEZED.format("raw.gold")} = {_SQUEEZED.format("raw.predicted")} THEN 'exact' WHEN {_CHARS.format(_SQUEEZED.format("raw.gold"), _SQUEEZED.format("raw.predicted"))} >= 0.7 THEN 'partial' WHEN {_CHARS.format(_SQUEEZED.format("raw.gold"), _SQUEEZED.format("raw.predicted"))} >= 0.6 THEN 'fuzzy' ELSE 'none' END AS match FROM raw JOIN w USING (rid)) """
)


@query(_PAIRING + "SELECT kind, match, count(*) AS n FROM pr GROUP BY 1, 2")
def argument_pairs(spark, d):
    """Greedy one-to-one pairs of annotated and given values with their match type."""
    r = _argument_rows(spark, d)
    empty = F.array().cast("array<string>")
    p = metrics.pair_spans(F.filter(F.coalesce("gold", empty), lambda x: x.isNotNull()), F.filter(F.coalesce("predicted", empty), lambda x: x.isNotNull()))
    return r.select("kind", F.explode(p).alias("x")).groupBy("kind", "x.match").agg(F.count("*").alias("n"))


@query(
    _PAIRING
    + """, er AS (SELECT *, CASE WHEN predicted IS NULL THEN 'false_negative' WHEN gold IS NULL THEN 'false_positive' WHEN match = 'partial' THEN 'partial_match' END AS error FROM pr), nu AS (SELECT *, row_number() OVER (PARTITION BY kind, error ORDER BY id, pos, gold NULLS FIRST, predicted NULLS FIRST) AS k FROM er WHERE error IS NOT NULL)
SELECT kind, error, count(*) AS n, string_agg(coalesce(gold, predicted), ' | ' ORDER BY k) FILTER (WHERE k <= 3) AS examples FROM nu GROUP BY 1, 2"""
)
def argument_errors(spark, d):
    return errors.error_summary(errors.error_records(errors.paired(_argument_rows(spark, d))))


@query(
    _PAIRING
    + """, co AS (SELECT count(predicted) AS p, count(gold) AS r, count_if(match = 'exact') AS e, count_if(match = 'partial') AS q, count_if(match <> 'none') AS a FROM pr), mo AS (SELECT p, r, unnest(['exact', 'partial', 'all']) AS mode, unnest([e, q, a]) AS tp FROM co)
SELECT mode, round(tp / p, 6) AS precision, round(tp / r, 6) AS recall, round(2 * tp / (p + r), 6) AS f1 FROM mo"""
)
def argument_match_types(spark, d):
    return _rounded(errors.by_match_type(errors.paired(_argument_rows(spark, d))))


@query(_ARGS + "SELECT first(scope ORDER BY f1 DESC, scope) AS best, first(scope ORDER BY f1, scope) AS worst FROM z")
def argument_best_worst(spark, d):
    r = _argument_rows(spark, d).withColumn("c", metrics.set_counts(F.col("gold"), F.col("predicted"))).select("kind", "c.*")
    m = metrics.aggregate_counts(r, "kind").where("scope not in ('MICRO', 'MACRO', 'WEIGHTED')")
    return errors.best_and_worst(m, "scope", "f1")


@query(
    """WITH g AS (SELECT DISTINCT id, trigger, arguments FROM gold_annotations), c AS (SELECT count(*) AS n, count_if(len(coalesce(trigger, [])) > 0) AS a, count_if(len(coalesce(arguments.participants, [])) > 0) AS b, count_if(len(coalesce(arguments.time, [])) > 0) AS c, count_if(len(coalesce(arguments.location, [])) > 0) AS d, count_if(len(coalesce(arguments.topic, [])) > 0) AS e FROM g)
SELECT 'trigger' AS "column", a AS filled, round(a / n, 6) AS share FROM c UNION ALL SELECT 'arguments.participants', b, round(b / n, 6) FROM c UNION ALL SELECT 'arguments.time', c, round(c / n, 6) FROM c UNION ALL SELECT 'arguments.location', d, round(d / n, 6) FROM c UNION ALL SELECT 'arguments.topic', e, round(e / n, 6) FROM c"""
)
def gold_coverage(spark, d):
    g = _read(spark, d, "gold_annotations").select("id", "trigger", "arguments").distinct()
    return errors.coverage(g, ["trigger", *[f"arguments.{k}" for k in ("participants", "time", "location", "topic")]])


_TOK = r"list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '\s+'), lambda w: w <> ''))"


@query(
    f"""WITH a AS (SELECT DISTINCT id, {_TOK.format("subject")} AS p, {_TOK.format("topic")} AS r FROM dataset), b AS (SELECT id, len(p) AS n, len(r) AS m, len(list_intersect(p, r)) AS c FROM a)
SELECT id, round(CASE WHEN n = 0 AND m = 0 THEN 1 WHEN n = 0 OR m = 0 THEN 0 ELSE c::DOUBLE / n END, 6) AS precision, round(CASE WHEN n = 0 AND m = 0 THEN 1 WHEN n = 0 OR m = 0 THEN 0 ELSE c::DOUBLE / m END, 6) AS recall, round(CASE WHEN n = 0 AND m = 0 THEN 1 WHEN n = 0 OR m = 0 THEN 0 ELSE 2.0 * c / (n + m) END, 6) AS f1 FROM b"""
)
def token_scores(spark, d):
    m = _mails(spark, d, "subject", "topic").withColumn("s", metrics.token_scores(F.col("subject"), F.col("topic")))
    return _rounded(m.select("id", "s.precision", "s.recall", "s.f1").distinct())


@query(
    """WITH a AS (SELECT DISTINCT id, coalesce(subject, '') AS s, coalesce(topic, '') AS t FROM dataset), b AS (SELECT id, s, t, list_distinct(string_split(s, '')) AS x, list_distinct(string_split(t, '')) AS y FROM a)
SELECT id, round(CASE WHEN s = '' AND t = '' THEN 1 WHEN s = '' OR t = '' THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM b"""
)
def char_jaccard(spark, d):
    m = _mails(spark, d, "subject", "topic").select("id", F.coalesce("subject", F.lit("")).alias("s"), F.coalesce("topic", F.lit("")).alias("t")).distinct()
    return m.select("id", F.round(metrics.char_jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@query(
    """WITH a AS (SELECT DISTINCT id, coalesce(subject, '') AS s, coalesce(topic, '') AS t FROM dataset), b AS (SELECT id, s, t, string_split(s, '') AS x, string_split(t, '') AS y, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS u, trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) AS v FROM a),
c AS (SELECT *, CASE WHEN s = '' AND t = '' THEN 1 WHEN s = '' OR t = '' THEN 0 ELSE len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]))::DOUBLE / greatest(length(s), length(t)) END AS r,
CASE WHEN u = '' AND v = '' THEN 1 WHEN u = '' OR v = '' THEN 0 ELSE len(list_intersect(list_distinct(string_split(u, '')), list_distinct(string_split(v, ''))))::DOUBLE / len(list_distinct(list_concat(string_split(u, ''), string_split(v, '')))) END AS j FROM b)
SELECT id, round(r, 6) AS ratio, CASE WHEN u = v THEN 'exact' WHEN j >= 0.7 THEN 'partial' WHEN j >= 0.6 THEN 'fuzzy' ELSE 'none' END AS match FROM c"""
)
def overlap_ratios(spark, d):
    m = _mails(spark, d, "subject", "topic").select("id", F.coalesce("subject", F.lit("")).alias("s"), F.coalesce("topic", F.lit("")).alias("t")).distinct()
    return m.select("id", F.round(metrics.overlap_ratio(F.col("s"), F.col("t")), 6).alias("ratio"), metrics.match_type(F.col("t"), F.col("s")).alias("match"))


def _answers(spark, d) -> DataFrame:
    """Answer rows: the mails' topic and time against the subject and the body."""
    m = _mails(spark, d, "subject", "body", "topic", "time_expression")
    rows = F.array(F.struct(F.lit("topic").alias("category"), F.col("subject").alias("predicted"), F.col("topic").alias("reference")), F.struct(F.lit("time").alias("category"), F.col("time_expression").alias("predicted"), F.col("topic").alias("reference")))
    return m.select("id", F.coalesce("body", F.lit("")).alias("body"), F.explode(rows).alias("x")).select("id", "body", "x.*").distinct()


_ANS = r"""WITH m AS (SELECT DISTINCT id, coalesce(body, '') AS body, subject, topic, time_expression FROM dataset), a AS (SELECT DISTINCT id, body, 'topic' AS category, coalesce(subject, '') AS p, coalesce(topic, '') AS r FROM m UNION SELECT DISTINCT id, body, 'time', coalesce(time_expression, ''), coalesce(topic, '') FROM m), """


@query(
    _ANS
    + r"""e AS (SELECT CASE WHEN trim(p) = '' THEN 'LOW_CONFIDENCE' WHEN trim(regexp_replace(lower(p), '\s+', ' ', 'g')) = trim(regexp_replace(lower(r), '\s+', ' ', 'g')) THEN 'EXACT_MATCH' WHEN NOT contains(body, p) AND NOT contains(lower(body), lower(p)) THEN 'HALLUCINATION' WHEN contains(lower(r), lower(p)) OR contains(lower(p), lower(r)) THEN 'TRUNCATION'
WHEN len(list_intersect(list_filter(string_split_regex(lower(p), '\s+'), lambda w: w <> ''), list_filter(string_split_regex(lower(r), '\s+'), lambda w: w <> ''))) > 0 THEN 'PARTIAL_MATCH' ELSE 'WRONG_ANSWER' END AS error, category FROM a) SELECT category, error, count(*) AS n FROM e GROUP BY 1, 2"""
)
def answer_errors(spark, d):
    e = metrics.answer_error(F.col("predicted"), F.col("reference"), F.lit(0.4), F.col("body"))
    a = _answers(spark, d).select("id", "body", "category", F.coalesce("predicted", F.lit("")).alias("predicted"), F.coalesce("reference", F.lit("")).alias("reference")).distinct()
    return a.groupBy("category", e.alias("error")).agg(F.count("*").alias("n"))


_SCORED = (
    r"""WITH m AS (SELECT DISTINCT id, coalesce(body, '') AS body, subject, topic, time_expression FROM dataset), a AS (SELECT DISTINCT id, body, 'topic' AS category, subject AS p, topic AS r FROM m UNION SELECT DISTINCT id, body, 'time', time_expression, topic FROM m), """
    + f"k AS (SELECT category, body, r, {_TOK.format('p')} AS x, {_TOK.format('r')} AS y, {_TOK.format('body')} AS z, trim(regexp_replace(lower(coalesce(p, '')), '\\s+', ' ', 'g')) AS pn, trim(regexp_replace(lower(coalesce(r, '')), '\\s+', ' ', 'g')) AS rn, trim(regexp_replace(lower(body), '\\s+', ' ', 'g')) AS bn FROM a), "
    + "".join(
        f"{n} AS (SELECT category, CASE WHEN {q} = rn THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN len({t}) = 0 AND len(y) = 0 THEN 1.0 WHEN len({t}) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect({t}, y))::DOUBLE / len({t}) END AS precision, CASE WHEN len({t}) = 0 AND len(y) = 0 THEN 1.0 WHEN len({t}) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect({t}, y))::DOUBLE / len(y) END AS recall, CASE WHEN len({t}) = 0 AND len(y) = 0 THEN 1.0 WHEN len({t}) = 0 OR len(y) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({t}, y)) / (len({t}) + len(y)) END AS f1 FROM k), "
        + f"{n}s AS (SELECT coalesce(category, 'ALL') AS category, count(*) AS n, avg(exact) AS exact, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM {n} GROUP BY GROUPING SETS ((category), ()))"
        + (", " if n == "u" else " ")
        for n, t, q in (("u", "x", "pn"), ("v", "z", "bn"))
    )
)


@query(_SCORED + "SELECT category, n, round(exact, 6) AS exact, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, 0.5 AS confidence FROM us")
def answer_summary(spark, d):
    a = _answers(spark, d).withColumn("s", metrics.token_scores(F.col("predicted"), F.col("reference"))).select("category", "s.*", F.lit(0.5).alias("confidence"))
    return _rounded(metrics.answer_summary(a))


@query(_SCORED + "SELECT category, round(us.exact, 6) AS exact_a, round(vs.exact, 6) AS exact_b, round(us.f1, 6) AS f1_a, round(vs.f1, 6) AS f1_b, round(vs.f1 - us.f1, 6) AS f1_delta, CASE WHEN abs(vs.f1 - us.f1) < 1e-12 THEN 'tie' WHEN vs.f1 > us.f1 THEN 'b' ELSE 'a' END AS winner FROM us FULL JOIN vs USING (category)")
def answer_comparison(spark, d):
    a = _answers(spark, d).withColumn("s", metrics.token_scores(F.col("predicted"), F.col("reference"))).select("category", "s.*", F.lit(0.5).alias("confidence"))
    b = _answers(spark, d).withColumn("s", metrics.token_scores(F.col("body"), F.col("reference"))).select("category", "s.*", F.lit(0.5).alias("confidence"))
    return _rounded(metrics.compare_methods(metrics.answer_summary(a), metrics.answer_summary(b)))


@query(
    f"""WITH m AS (SELECT DISTINCT id, {_L} AS label, length(coalesce(body, '')) AS n FROM dataset), g AS (SELECT label, avg(n) AS score FROM m GROUP BY 1)
SELECT first(label ORDER BY score DESC, label) AS best, first(label ORDER BY score, label) AS worst, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(coalesce(stddev_samp(score), 0), 6) AS stddev, round(stddev_pop(score), 6) AS stddev_pop FROM g"""
)
def score_stats(spark, d):
    m = _mails(spark, d, "label", "body").select("id", X.label_key(F.col("label")).alias("label"), F.length(F.coalesce("body", F.lit(""))).alias("n")).distinct()
    return _rounded(metrics.score_stats(m.groupBy("label").agg(F.avg("n").alias("score")), "label", "score"))


@query(
    r"""WITH c AS (SELECT DISTINCT id, array_to_string(regexp_extract_all(strip_accents(lower(translate(coalesce(gold_topic, ''), 'ªº²³¹', 'ao231'))), '[a-z0-9]+'), ' ') AS g, array_to_string(regexp_extract_all(strip_accents(lower(translate(coalesce(regexp_extract(subject, '(?i)reunião (?:sobre|d[aeo]s?) (.+)$', 1), ''), 'ªº²³¹', 'ao231'))), '[a-z0-9]+'), ' ') AS p FROM topic_extraction_holdout)
SELECT count(*) AS cases, CAST(count_if(g = '' AND p <> '') AS BIGINT) AS spurious, CAST(count_if(g <> '' AND p = '') AS BIGINT) AS missed, round(avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END), 6) AS exact FROM c"""
)
def topic_detection(spark, d):
    c = _read(spark, d, "topic_extraction_holdout")
    said = F.regexp_extract("subject", r"(?iU)reunião (?:sobre|d[aeo]s?) (.+)$", 1)
    m = metrics.topic_metrics(c.select("id", F.col("gold_topic").alias("gold"), F.coalesce(said, F.lit("")).alias("predicted")).distinct())
    return m.select("cases", "spurious", "missed", F.round("exact", 6).alias("exact"))


_FOLDED = "regexp_extract_all(strip_accents(lower(translate(coalesce({0}, ''), 'ªº²³¹', 'ao231'))), '[a-z0-9]+')"


@query(
    _topics_sql("topic_extraction_holdout", "id", f"subject AS given, label AS given_label, gold_topic, {_LABEL.format('label')} AS intent")
    + f""", t AS (SELECT {_FOLDED.format("gold_topic")} AS g, {_FOLDED.format("topic")} AS p FROM said), n AS (SELECT g, p, len(g) > 0 AS pos, len(p) > 0 AS told, g = p AS same, coalesce(list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))), 0) AS c FROM t),
k AS (SELECT *, CASE WHEN told THEN c / len(p) ELSE 0 END AS pr, c / len(g) AS re, CASE WHEN told THEN 2.0 * c / (len(p) + len(g)) ELSE 0 END AS f FROM n), q AS (SELECT count(*) AS cases, avg(CASE WHEN same THEN 1.0 ELSE 0 END) AS exact, avg(CASE WHEN pos THEN CASE WHEN same THEN 1.0 ELSE 0 END END) AS exact_positive, avg(CASE WHEN pos THEN pr END) AS token_precision, avg(CASE WHEN pos THEN re END) AS token_recall, avg(CASE WHEN pos THEN f END) AS token_f1,
avg(CASE WHEN NOT pos THEN CASE WHEN told THEN 0.0 ELSE 1 END END) AS negative_accuracy, count_if(pos AND told) AS tp, count_if(NOT pos AND told) AS fp, count_if(pos AND NOT told) AS fn, count_if(pos) AS positives, count_if(pos AND told AND NOT same) AS different FROM k)
SELECT cases, round(exact, 6) AS exact, round(exact_positive, 6) AS exact_positive, round(token_precision, 6) AS token_precision, round(token_recall, 6) AS token_recall, round(token_f1, 6) AS token_f1, round(negative_accuracy, 6) AS negative_accuracy, round(fp / (cases - positives), 6) AS false_positive_rate, round(tp / positives, 6) AS coverage,
round(tp / (tp + fp), 6) AS detection_precision, round(tp / (tp + fn), 6) AS detection_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS detection_f1, CAST(fn AS BIGINT) AS missed, CAST(fp AS BIGINT) AS spurious, CAST(different AS BIGINT) AS different FROM q"""
)
def topic_report(spark, d):
    """The topic extractor on all labelled cases."""
    c = _read(spark, d, "topic_extraction_holdout").select("id", "subject", "body", "label", "gold_topic").distinct()
    t = arguments.topic_spans(F.col("body"), F.col("subject"), X.label_key(F.col("label")))
    return _rounded(metrics.topic_metrics(c.select(F.col("gold_topic").alias("gold"), F.get(t, F.lit(0))["text"].alias("predicted"))))


@query(
    f"""WITH g AS (SELECT DISTINCT id, {_I} AS intent, len(coalesce(trigger, [])) AS t, len(coalesce(arguments.time, [])) AS w FROM gold_annotations)
SELECT intent, count(*) AS n, count_if(t > 0) AS with_trigger, round(100.0 * count_if(w > 0) / count(*), 4) AS time_coverage FROM g GROUP BY 1"""
)
def gold_report(spark, d):
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    g = _read(spark, d, "gold_annotations").select("id", X.label_key(F.col("intent")).alias("intent"), size(F.col("trigger")).alias("t"), size(F.col("arguments.time")).alias("w")).distinct()
    return g.groupBy("intent").agg(F.count("*").alias("n"), F.count_if(F.col("t") > 0).alias("with_trigger"), F.round(100.0 * F.count_if(F.col("w") > 0) / F.count("*"), 4).alias("time_coverage"))


# ---------------------------------------------------------------- windows, sets, limits


@query("WITH m AS (SELECT DISTINCT id, sender_email FROM dataset) SELECT id, row_number() OVER (PARTITION BY coalesce(sender_email, '') ORDER BY id, sender_email) - 1 AS position FROM m")
def window_positions(spark, d):
    """A record's place among its sender's records, from counts of id ranges and short windows: no sender is sorted in one task."""
    m = _mails(spark, d, "sender_email").select("id", "sender_email", F.coalesce("sender_email", F.lit("")).alias("sender"), F.floor(F.col("id") / 4096).alias("range"))
    counts = m.groupBy("sender", "range").agg(F.count("*").alias("n"))
    before = counts.select("sender", "range", (F.sum("n").over(W.partitionBy("sender").orderBy("range")) - F.col("n")).alias("before"))
    w = W.partitionBy("sender", "range").orderBy("id", "sender_email")
    return m.withColumn("k", F.row_number().over(w)).join(before, ["sender", "range"]).select("id", (F.col("k") - 1 + F.col("before")).cast("bigint").alias("position"))


@query(
    f"""WITH g AS (SELECT DISTINCT id, {_I} AS intent, dataset_id FROM gold_annotations WHERE dataset_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY length(intent) DESC, id, intent) AS k FROM g) SELECT dataset_id, id, intent FROM r WHERE k = 1"""
)
def window_best_per_key(spark, d):
    """One row a key: the best, of equals the first."""
    g = _read(spark, d, "gold_annotations").where("dataset_id is not null").select("id", X.label_key(F.col("intent")).alias("intent"), "dataset_id").distinct()
    best = g.groupBy("dataset_id").agg(F.min(F.struct((-F.length("intent")).alias("n"), "id", "intent")).alias("b"))
    return best.select("dataset_id", "b.id", "b.intent")


@query("WITH m AS (SELECT DISTINCT id, participants FROM dataset WHERE participants IS NOT NULL) SELECT id, array_to_string(list_sort(list_distinct(participants)), '; ') AS names FROM m")
def array_distinct_names(spark, d):
    return _read(spark, d, "dataset").where("participants is not null").select("id", "participants").distinct().select("id", F.array_join(F.array_sort(F.array_distinct("participants")), "; ").alias("names"))


@query(
    f"""WITH t AS (SELECT DISTINCT * FROM (SELECT id, {_L} AS label, unnest(regexp_extract_all(lower(strip_accents(coalesce(subject, ''))), '[a-z0-9]+')) AS term FROM dataset)), c AS (SELECT label, term, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS rank FROM c) SELECT label, term, n, rank FROM r WHERE rank <= 10"""
)
def top_terms_per_label(spark, d):
    m = _mails(spark, d, "subject", "label").select("id", X.label_key(F.col("label")).alias("label"), F.explode(X.topic_tokens(F.coalesce("subject", F.lit("")))).alias("term")).distinct()
    c = m.groupBy("label", "term").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "term")).cast("bigint")).where("rank <= 10")


@query("SELECT DISTINCT event_id, ts FROM events ORDER BY event_id DESC LIMIT 50")
def last_events(spark, d):
    """The newest records: the limit is the feature."""
    return _read(spark, d, "events").select("event_id", "ts").distinct().orderBy(F.desc("event_id")).limit(50)


# ---------------------------------------------------------------- validation


@query(f"WITH m AS (SELECT DISTINCT id, trim(coalesce(body, '')) AS b, trim(coalesce(subject, '')) AS s, trim(coalesce(label, '')) AS l FROM dataset) SELECT count(*) AS records, count_if(l = '') AS missing_label, count_if(b = '') AS empty_body, count_if(b = '' AND s = '') AS empty_mail, count_if(l <> '' AND l NOT IN ('agendamento_reuniao', 'cancelamento_reuniao', 'reuniao_confirmada', 'nao_reuniao')) AS unknown_label FROM m")
def validate_dataset(spark, d):
    m = _mails(spark, d, "subject", "body", "label").select("id", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("subject", "body", "label")]).distinct()
    return validate.dataset_report(m)


@query(
    """WITH g AS (SELECT DISTINCT id, text, intent, trigger, arguments FROM gold_annotations)
SELECT DISTINCT id, 'error' AS level, 'missing_text' AS rule FROM g WHERE trim(coalesce(text, '')) = '' UNION SELECT id, 'error', 'missing_intent' FROM g WHERE coalesce(intent, '') = '' UNION SELECT id, 'error', 'unknown_intent' FROM g WHERE intent <> '' AND intent NOT IN ('agendamento_reuniao', 'cancelamento_reuniao', 'reuniao_confirmada')
UNION SELECT id, 'error', 'missing_arguments' FROM g WHERE arguments IS NULL UNION SELECT id, 'warning', 'empty_trigger' FROM g WHERE len(coalesce(trigger, [])) = 0 UNION SELECT id, 'warning', 'no_participants' FROM g WHERE arguments IS NOT NULL AND arguments.participants IS NULL UNION SELECT id, 'warning', 'no_time' FROM g WHERE arguments IS NOT NULL AND arguments.time IS NULL UNION SELECT id, 'warning', 'no_location' FROM g WHERE arguments IS NOT NULL AND arguments.location IS NULL UNION SELECT id, 'warning', 'no_topic' FROM g WHERE arguments IS NOT NULL AND arguments.topic IS NULL
UNION SELECT id, 'error', 'blank_participants' FROM g WHERE len(list_filter(arguments.participants, lambda x: x IS NULL OR trim(x) = '')) > 0 UNION SELECT id, 'error', 'blank_time' FROM g WHERE len(list_filter(arguments.time, lambda x: x IS NULL OR trim(x) = '')) > 0 UNION SELECT id, 'error', 'blank_location' FROM g WHERE len(list_filter(arguments.location, lambda x: x IS NULL OR trim(x) = '')) > 0 UNION SELECT id, 'error', 'blank_topic' FROM g WHERE len(list_filter(arguments.topic, lambda x: x IS NULL OR trim(x) = '')) > 0
UNION SELECT id, 'error', 'duplicate_id' FROM (SELECT id FROM g GROUP BY id HAVING count(*) > 1)"""
)
def validate_gold(spark, d):
    return validate.validate_annotations(_read(spark, d, "gold_annotations").select("id", "text", "intent", "trigger", "arguments"))


@query(
    "WITH p AS (SELECT * FROM (VALUES "
    + ", ".join("('{}', [{}])".format(k, ", ".join("'" + x + "'" for x in v)) for k, v in PHRASES.items())
    + ") p(intent, allowed)), g AS (SELECT DISTINCT id, intent, list_transform(trigger, lambda x: lower(trim(x))) AS t FROM gold_annotations) SELECT DISTINCT id FROM g JOIN p USING (intent) WHERE len(t) > 0 AND NOT list_has_any(t, allowed)"
)
def validate_triggers(spark, d):
    return validate.trigger_mismatch(_read(spark, d, "gold_annotations"))


@query(
    """WITH g AS (SELECT DISTINCT id, text, intent, trigger, arguments FROM gold_annotations) SELECT id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text, regexp_replace(coalesce(intent, ''), '^\\s+|\\s+$', '', 'g') AS intent, array_to_string(list_filter(list_transform(coalesce(trigger, []), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), '|') AS trigger, array_to_string(list_filter(list_transform(coalesce(arguments.time, []), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), '|') AS time FROM g""".replace("\\\\", "\\")
)
def normalized_gold(spark, d):
    g = _read(spark, d, "gold_annotations").select("id", "text", "intent", "trigger", "arguments").distinct()
    return validate.normalize_annotation(g).select("id", "text", "intent", F.array_join("trigger", "|").alias("trigger"), F.array_join("arguments.time", "|").alias("time"))


# ---------------------------------------------------------------- splits and models


def _labelled(spark, d) -> DataFrame:
    return _mails(spark, d, "label").groupBy("id").agg(F.min(X.label_key(F.col("label"))).alias("label"))


_LABELLED = f"WITH m AS (SELECT id, min({_L}) AS label FROM dataset GROUP BY id), o AS (SELECT *, md5(CAST(id AS VARCHAR) || '-42') AS h FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) AS k, count(*) OVER (PARTITION BY label) AS n FROM o) "


@query(_LABELLED + "SELECT id, label FROM r WHERE k <= 50")
def split_sample(spark, d):
    return splits.per_label_sample(_labelled(spark, d), "id", "label", 50).select("id", "label")


@query(_LABELLED + "SELECT id, label, CASE WHEN k <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM r")
def split_stratified(spark, d):
    return splits.stratified_split(_labelled(spark, d), "id", "label").select("id", "label", "part")


@query(f"WITH m AS (SELECT id, min({_L}) AS label FROM dataset GROUP BY id) SELECT id, CAST(CAST('0x' || substr(md5(label || '-' || CAST(id AS VARCHAR) || '-42'), 1, 7) AS BIGINT) % 5 AS INT) AS fold FROM m")
def split_folds(spark, d):
    return splits.folds(_labelled(spark, d), "id", "label").select("id", "fold")


@query("WITH g AS (SELECT DISTINCT id, coalesce(dataset_id, -1) AS mail FROM gold_annotations), h AS (SELECT *, CAST('0x' || substr(md5(CAST(mail AS VARCHAR) || '-42'), 1, 7) AS BIGINT) / 268435456.0 AS u FROM g) SELECT id, mail, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS part FROM h")
def split_grouped(spark, d):
    g = _read(spark, d, "gold_annotations").select("id", F.coalesce("dataset_id", F.lit(-1)).alias("mail")).distinct()
    return splits.group_split(g, "mail", [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).select("id", "mail", "part")


@query(f"WITH m AS (SELECT id, min({_L}) AS label FROM dataset GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM m) SELECT id, label, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM r")
def split_sequential(spark, d):
    return splits.sequential_split(_labelled(spark, d), "id").select("id", "label", "part")


@query(f"WITH g AS (SELECT DISTINCT id, dataset_id, {_I} AS intent FROM gold_annotations), m AS (SELECT id, min({_L}) AS label FROM test_dataset GROUP BY id) SELECT g.id, coalesce(nullif(intent, ''), label, '') AS intent FROM g LEFT JOIN m ON m.id = g.dataset_id WHERE coalesce(nullif(intent, ''), label, '') <> 'nao_reuniao'")
def intent_fallback(spark, d):
    """An annotation's intent, else its mail's label; the class without meetings left out."""
    g = _read(spark, d, "gold_annotations").select("id", "dataset_id", X.label_key(F.col("intent")).alias("intent")).distinct()
    m = _tests(spark, d, "label").groupBy("id").agg(F.min(X.label_key(F.col("label"))).alias("label")).withColumnRenamed("id", "dataset_id")
    out = g.join(m, "dataset_id", "left").select("id", validate.intent_of(F.col("intent"), F.col("label")).alias("intent"))
    return validate.without_class(out, "intent", "nao_reuniao")


_TFIDF_SQL = r"""WITH m AS (SELECT id, min(coalesce(subject, '') || ' ' || coalesce(body, '')) AS t FROM dataset GROUP BY id), w AS (SELECT id, regexp_extract_all(lower(t), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}') AS ws FROM m),
x AS (SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w), c AS (SELECT id, term, count(*) AS tf FROM x GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 5000) """


def _whole_mails(spark, d) -> DataFrame:
    """One row a mail: (id, t: subject and body, label); of several records of an id the least."""
    m = _mails(spark, d, "subject", "body", "label")
    t = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    return m.groupBy("id").agg(F.min(t).alias("t"), F.min(X.label_key(F.col("label"))).alias("label"))


@query(_TFIDF_SQL + ", s AS (SELECT c.id, c.term, tf * (ln((1.0 + (SELECT count(*) FROM m)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM s GROUP BY 1) SELECT id, term, round(w / norm, 6) AS weight FROM s JOIN n USING (id)")
def tfidf_weights(spark, d):
    """Weights over subject and body with the operator's whole vocabulary."""
    return _rounded(ml.tfidf(_whole_mails(spark, d), "id", "t"))


@query(
    _TFIDF_SQL
    + f", l AS (SELECT id, min({_L}) AS label FROM dataset GROUP BY id), b AS (SELECT label, term, sum(tf) AS n FROM c JOIN v USING (term) JOIN l USING (id) GROUP BY 1, 2), t AS (SELECT label, sum(n) AS total FROM b GROUP BY 1) SELECT t.label, v.term, round(ln((coalesce(b.n, 0) + 1.0) / (t.total + 5000)), 6) AS log_prob FROM t CROSS JOIN v LEFT JOIN b ON b.label = t.label AND b.term = v.term"
)
def naive_bayes_table(spark, d):
    """The model's table over subject and body with the operator's whole vocabulary."""
    return _rounded(ml.naive_bayes_table(_whole_mails(spark, d), "id", "t", "label"))


def _texts(spark, d) -> DataFrame:
    m = _mails(spark, d, "subject", "body", "label").where("label is not null")
    text = X.preprocess(X.combine_fields(F.col("subject"), F.col("body")))
    return m.select("id", text.alias("text"), X.label_key(F.col("label")).alias("label")).dropDuplicates(["id"])


MODELS = ["logistic_regression", "naive_bayes", "decision_tree"]


@query()
def model_folds(spark, d):
    """Accuracy and F1 of the Bayes model in each of three folds, everything fitted anew."""
    return _rounded(ml.cross_validate(cut_lineage(_texts(spark, d)), "naive_bayes", "id", k=3))


@query()
def model_consensus(spark, d):
    """Confusion counts of the three models' majority on a stratified test part."""
    parts = cut_lineage(splits.stratified_split(_texts(spark, d), "id", "label"))
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    both = ml.consensus_of(ml.fit_all(train, MODELS), test, "id")
    return metrics.confusion(test.select("id", F.col("label").alias("true_label")).join(both.select("id", F.col("intent").alias("predicted_label")), "id"))


@query()
def generated_mails(spark, d):
    """Label shares of synthetic mails, as many as the largest table has rows."""
    n = _read(spark, d, "dataset").count()
    return metrics.distribution(generate.mails(spark, n), "label")


@query()
def model_metrics(spark, d):
    """Accuracy, macro and weighted F1 of three models on a stratified test part."""
    parts = cut_lineage(splits.stratified_split(_texts(spark, d), "id", "label"))
    models = ml.fit_all(parts.where("part = 'train'"), MODELS)
    return _rounded(ml.evaluate(models, parts.where("part = 'test'"), "id").select("model", "rows", "accuracy", "macro_f1", "weighted_f1"))


# ---------------------------------------------------------------- gold records

_SHOWN = "contains(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), lower({0})) AND {0} <> ''"
_TRIMMED = r"regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(
    f"""WITH m AS (SELECT DISTINCT id, subject, body, coalesce(label, '') AS intent, participants, sender, recipient, {_TRIMMED.format("time_expression")} AS x, {_TRIMMED.format("topic")} AS y FROM dataset), n AS (SELECT *, intent IN ('agendamento_reuniao', 'cancelamento_reuniao', 'reuniao_confirmada') AS meeting FROM m)
SELECT id AS dataset_id, coalesce(body, '') AS text, intent, CASE WHEN meeting AND {_SHOWN.format("x")} THEN x ELSE '' END AS time, CASE WHEN meeting AND {_SHOWN.format("y")} THEN y ELSE '' END AS topic FROM n"""
)
def gold_metadata(spark, d):
    """Gold records from the mails' fields: times and topics that the texts show."""
    g = gold.gold_from_metadata(_read(spark, d, "dataset").select("id", "subject", "body", "label", "participants", "sender", "recipient", "sent_datetime", "time_expression", "topic").distinct())
    return g.select("dataset_id", "text", "intent", F.array_join("arguments.time", "; ").alias("time"), F.array_join("arguments.topic", "; ").alias("topic"))


_WRONG_SQL = " ".join(
    f"WHEN '{k}' THEN " + " OR ".join(f"contains(a, '{p.lower()}')" for p in dict.fromkeys(parts)) for k, parts in qa.WRONG_PARTS.items()
)


@query(
    f"""WITH m AS (SELECT DISTINCT id, sender, time_expression, location, topic FROM dataset), r AS (SELECT id, 'participants' AS category, sender AS v FROM m UNION ALL SELECT id, 'time', time_expression FROM m UNION ALL SELECT id, 'location', location FROM m UNION ALL SELECT id, 'topic', topic FROM m), n AS (SELECT category, lower({_TRIMMED.format("v")}) AS a FROM r)
SELECT category, count(*) AS n, CAST(count_if(a <> '' AND NOT (CASE category {_WRONG_SQL} END)) AS BIGINT) AS fitting FROM n GROUP BY 1"""
)
def qa_fitting(spark, d):
    """Of the mails' own values by category, those that fit the category's answers."""
    m = _read(spark, d, "dataset").select("id", "sender", "time_expression", "location", "topic").distinct()
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(c).alias("v")) for k, c in (("participants", "sender"), ("time", "time_expression"), ("location", "location"), ("topic", "topic"))])).alias("x")
    r = m.select(values).select("x.category", qa.fits_category(F.col("x.v"), F.col("x.category")).alias("ok"))
    return r.groupBy("category").agg(F.count("*").alias("n"), F.count_if("ok").alias("fitting"))


# ---------------------------------------------------------------- questions and answers


@query("WITH m AS (SELECT DISTINCT id, body FROM dataset), q AS (SELECT * FROM (VALUES ('participants', 'Quem são os participantes da reunião?'), ('time', 'Quando é a reunião?'), ('location', 'Onde é a reunião?'), ('topic', 'Qual é o tema da reunião?')) q(category, question)) SELECT category, question, count(*) AS n, CAST(sum(length(coalesce(body, ''))) AS BIGINT) AS characters FROM m CROSS JOIN q GROUP BY 1, 2")
def qa_questions(spark, d):
    q = qa.questions(_mails(spark, d, "body"), context="body")
    return q.groupBy("category", "question").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("context", F.lit("")))).alias("characters"))


@query()
def qa_fallbacks(spark, d):
    """Fallbacks around answers taken from the mails' own fields."""
    m = _read(spark, d, "dataset").select("id", "subject", "body", "label", "sender", "location", "sent_datetime", "topic", "time_expression").dropDuplicates(["id"])
    given = {"participants": F.lit(None).cast("string"), "time": F.col("time_expression"), "location": F.col("location"), "topic": F.col("topic")}
    for k, c in given.items():
        m = m.withColumns({f"{k}_answer": c, f"{k}_confidence": F.lit(0.6)})
    out = qa.apply_fallbacks(m.withColumn("label", X.label_key(F.col("label"))))
    cols = [F.col(f"{c}.{p}").alias(f"{c}_{n}") for c in ("participants", "time", "time_normalized", "location", "topic") for p, n in (("answer", "text"), ("fallback_source", "source"))]
    return out.select("id", *cols)


@query(
    """WITH g AS (SELECT DISTINCT id, coalesce(text, '') AS context, arguments AS a FROM gold_annotations), r AS (SELECT id, context, 'participants' AS category, coalesce(a.participants, []) AS v FROM g UNION ALL SELECT id, context, 'time', coalesce(a.time, []) FROM g UNION ALL SELECT id, context, 'location', coalesce(a.location, []) FROM g UNION ALL SELECT id, context, 'topic', coalesce(a.topic, []) FROM g), s AS (SELECT *, array_to_string(v, '; ') AS answer FROM r)
SELECT id || '-' || category AS example_id, category, answer, CAST(CASE WHEN answer = '' THEN -1 ELSE instr(context, string_split(answer, '; ')[1]) - 1 END AS INT) AS answer_start, answer = '' AS is_impossible FROM s"""
)
def qa_examples(spark, d):
    g = _read(spark, d, "gold_annotations").select("id", "text", "arguments").distinct()
    return qa.qa_examples(g).select("example_id", "category", "answer", F.col("answer_start").cast("int").alias("answer_start"), "is_impossible")


@query("SELECT id, coalesce(text, '') AS context, 4 AS questions FROM (SELECT DISTINCT id, text FROM gold_annotations)")
def qa_contexts(spark, d):
    g = _read(spark, d, "gold_annotations").select("id", "text", "arguments").dropDuplicates(["id"])
    return qa.by_context(qa.qa_examples(g)).select("id", "context", F.size("qas").alias("questions"))


# ---------------------------------------------------------------- scale checks on the star tables


@query("SELECT n_name AS nation, count(*) AS orders, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def star_join(spark, d):
    o, c, n = _read(spark, d, "orders"), _read(spark, d, "customer"), _read(spark, d, "nation")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 0).cast("bigint").alias("total"))
