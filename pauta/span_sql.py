"""SQL for the span queries: places of pattern matches from a database's regular expressions.

The database's ``\\b`` and ``\\w`` know ASCII only, so texts and patterns are brought to ASCII
first, character by character: lower case, letters with accents to capitals, all other letters
to ``Z``, all blanks to a blank. Places then come from the matches and the gaps between them.
"""

from __future__ import annotations

import re
import sys
import unicodedata

_LETTERS = dict(zip("áàâãéêíóôõúçºª", "ABCDEFGHIJKLMN"))


def _others() -> tuple[str, str]:
    """All other letters and digits of the Basic Multilingual Plane in lower case, and all blanks that aren't ASCII."""
    letters = "".join(c for k in range(128, 0x3100) if (c := chr(k)).isalnum() and c not in _LETTERS and len(c.lower()) == 1)
    blanks = "".join(chr(k) for k in range(128, sys.maxunicode) if unicodedata.category(chr(k)) in ("Zs", "Zl", "Zp"))
    return letters, blanks


_FROM = "".join(_LETTERS) + "".join(_others())
_TO = "".join(_LETTERS.values()) + "Z" * len(_others()[0]) + " " * len(_others()[1])


def ascii_text(sql: str) -> str:
    return f"translate(lower({sql}), '{_FROM}', '{_TO}')"


def ascii_pattern(pattern: str) -> str:
    """A pattern without flags in the same alphabet; its lookaheads at the end become part of the match."""
    p = pattern.replace("[A-Za-zÀ-ÖØ-öø-ÿ", "[\x01").replace("á-ú", "\x02").replace("(?=", "(?:")
    out, escaped = [], False
    for c in p:
        low = c if escaped else c.lower()
        out.append(_LETTERS.get(low, low))
        escaped = c == "\\" and not escaped
    inside = "".join(v for k, v in _LETTERS.items() if "á" <= k <= "ú") + "Z"
    return "".join(out).replace("\x01", "a-zA-Z").replace("\x02", inside).replace("'", "''")


def _matches(text: str, pattern: str) -> str:
    """List of structs (start, stop) of all matches in the column ``text``."""
    p = ascii_pattern(pattern)
    found, gaps = f"regexp_extract_all({text}, '{p}')", f"string_split_regex({text}, '{p}')"
    lengths = lambda e: f"list_transform({e}, lambda y: length(y))"
    before = f"coalesce(list_sum(list_transform({gaps}, lambda y: length(y))[1:i]), 0) + coalesce(list_sum({lengths(found)}[1:i - 1]), 0)"
    return f"list_transform({found}, lambda x, i: {{'start': CAST({before} AS INT), 'stop': CAST({before} + length(x) AS INT)}})"


def spans_sql(table: str, key: str, text: str, rules: list[tuple[str, float, str]], first_of_a_spelling: bool = False) -> str:
    """(key, text, start, end, confidence, method): earliest, then longest match of the rules, without overlaps."""
    lists = [f"list_transform({_matches('t', p)}, lambda s: {{'start': s.start, 'less': -s.stop, 'rule': {k}}})" for k, (p, _, _) in enumerate(rules)]
    every = lists[0]
    for x in lists[1:]:
        every = f"list_concat({every}, {x})"
    confidence = " ".join(f"WHEN {k} THEN {c}" for k, (_, c, _) in enumerate(rules))
    method = " ".join(f"WHEN {k} THEN '{m}'" for k, (_, _, m) in enumerate(rules))
    strip = lambda e: f"regexp_replace({e}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    body = "substr(raw, s.start + 1, -s.less - s.start)"
    out = f"""WITH m AS (SELECT DISTINCT {key}, coalesce({text}, '') AS raw FROM {table}), a AS (SELECT *, {ascii_text('raw')} AS t FROM m), f AS (SELECT {key}, raw, list_sort({every}) AS found FROM a),
g AS (SELECT {key}, raw, list_reduce(list_transform(found, lambda x: [x]), lambda kept, x: CASE WHEN x[1].start >= -kept[-1].less THEN list_concat(kept, x) ELSE kept END) AS kept FROM f WHERE len(found) > 0),
u AS (SELECT {key}, raw, unnest(kept) AS s, generate_subscripts(kept, 1) AS place FROM g), r AS (SELECT {key}, place, {strip(body) if first_of_a_spelling else body} AS text, s.start AS start, -s.less AS "end", CAST(CASE s.rule {confidence} END AS DOUBLE) AS confidence, CASE s.rule {method} END AS method FROM u) """
    if first_of_a_spelling:
        return out + f"SELECT {key}, text, start, \"end\", confidence, method FROM r QUALIFY row_number() OVER (PARTITION BY {key}, lower(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) ORDER BY place) = 1"
    return out + f'SELECT {key}, text, start, "end", confidence, method FROM r'


def topics_sql(table: str, key: str, columns: str, rules: list[tuple[str, str, float]], *, not_meeting: list[str], stop: list[str], generic: list[str], no_topic: str) -> str:
    """(key, columns, topic): the best valid capture of the rules ``(text column, pattern, confidence)``."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    plain = lambda e: f"trim(regexp_replace(strip_accents(lower(translate({e}, 'ªº²³¹', 'ao231'))), '[\\s\\p{{Z}}]+', ' ', 'g'))"
    edge = "' ' || chr(9) || chr(13) || chr(10) || '-:;,.''\"'"
    parts = []
    for k, (text, pattern, confidence) in enumerate(rules):
        p = ascii_pattern(pattern)
        whole, group = f"regexp_extract_all({text}_t, '{p}')", f"regexp_extract_all({text}_t, '{p}', 1)"
        places = _matches(f"{text}_t", pattern)
        one = f"{{'c': substr({text}_raw, x.start + strpos(({whole})[i], ({group})[i]), length(({group})[i])), 'sure': {confidence}, 'rule': {k}, 'nth': i}}"
        parts.append(f"list_transform({places}, lambda x, i: {one})")
    every = parts[0]
    for x in parts[1:]:
        every = f"list_concat({every}, {x})"
    title = r"regexp_replace(regexp_replace(coalesce(subject, ''), '(?i)^\s*(?:(?:re|fw|fwd|enc)\s*:\s*)+', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
    about = r"regexp_replace({0}, '(?i)^(?:sobre\s+|acerca\s+(?:de|do|da|dos|das)\s+)', '')"
    article = r"regexp_replace({0}, '(?i)^(?:o|a|os|as)\s+', '')"
    squeezed = f"trim(regexp_replace(f.c, '[\\s\\p{{Z}}]+', ' ', 'g'), {edge})"
    clean = f"trim({article.format(about.format(squeezed))}, {edge})"
    return f"""WITH m AS (SELECT DISTINCT {key}, {columns}, coalesce(body, '') AS body_raw, {title} AS title_raw FROM {table}), a AS (SELECT *, {ascii_text('body_raw')} AS body_t, {ascii_text('title_raw')} AS title_t FROM m),
u AS (SELECT {key}, body_raw, title_raw, unnest({every}) AS f FROM a WHERE {plain('intent')} NOT IN ({listed(not_meeting)})), c AS (SELECT {key}, body_raw, title_raw, {clean} AS c, f.sure AS sure, f.rule AS rule, f.nth AS nth FROM u WHERE f.c <> ''),
v AS (SELECT *, {plain('c')} AS k FROM c WHERE c <> '' AND length(c) <= 140 AND len(list_filter(string_split_regex(c, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) <= 14 AND NOT regexp_matches(c, '{no_topic}')),
w AS (SELECT * FROM v WHERE k NOT IN ({listed(generic)}) AND len(list_filter(regexp_extract_all(k, '[a-z0-9]+'), lambda x: x NOT IN ({listed(stop)}))) > 0),
best AS (SELECT {key}, body_raw, title_raw, first(c ORDER BY sure DESC, length(c) DESC, rule, nth) AS topic FROM w GROUP BY ALL), said AS (SELECT a.*, topic FROM a LEFT JOIN best USING ({key}, body_raw, title_raw)) """


def annotations_sql(table: str, key: str, rules) -> str:
    """(key, trigger, arguments, confidence as JSON) by the patterns of the module ``rules``."""
    strip = lambda e: f"regexp_replace({e}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"

    def values(pattern: str, group: int) -> str:
        """Texts of all matches, or of a group at its first place in each match, from the text as stored."""
        p = ascii_pattern(pattern)
        if not group:
            return f"list_transform({_matches('t', pattern)}, lambda x: substr(raw, x.start + 1, x.stop - x.start))"
        found, groups = f"regexp_extract_all(t, '{p}')", f"regexp_extract_all(t, '{p}', {group})"
        return f"list_transform({_matches('t', pattern)}, lambda x, i: substr(raw, x.start + strpos(({found})[i], ({groups})[i]), length(({groups})[i])))"

    def kind(patterns: list[str]) -> str:
        every = "CAST([] AS VARCHAR[])"
        for p in patterns:
            every = f"list_concat({every}, {values(p, 0)})"
        texts = f"list_filter(list_transform({every}, lambda x: {strip('x')}), lambda x: x <> '')"
        return f"list_filter({texts}, lambda x, i: list_position({texts}, x) = i)"

    people = "CAST([] AS VARCHAR[])"
    for p, least in rules.PEOPLE:
        people = f"list_concat({people}, list_filter(list_transform({values(p, 1)}, lambda x: {strip('x')}), lambda x: length(x) >= {least}))"
    titles = ", ".join(f"'{x}'" for x in rules.TITLES)
    people = f"list_sort(list_filter(list_distinct({people}), lambda x: string_split_regex(x, '[\\s\\p{{Z}}]+')[1] NOT IN ({titles})))"
    trigger = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(f'(?:{ascii_pattern(p)})' for p in ps)}') THEN '{k}'" for k, ps in rules.TRIGGERS.items()) + " END"
    sure = lambda c, x: f"CASE WHEN len({c}) > 0 THEN {x} ELSE 0.0 END"
    return f"""WITH m AS (SELECT DISTINCT {key}, {strip("coalesce(subject, '') || chr(10) || coalesce(body, '')")} AS raw FROM {table}), a AS (SELECT *, {ascii_text('raw')} AS t FROM m),
v AS (SELECT {key}, {trigger} AS w, {people} AS participants, {kind(rules.TIMES)} AS time, {kind(rules.PLACES)} AS location, {kind(rules.TOPICS)} AS topic FROM a)
SELECT {key}, CASE WHEN w IS NULL THEN CAST([] AS VARCHAR[]) ELSE [w] END AS trigger, CAST(to_json({{'participants': participants, 'time': time, 'location': location, 'topic': topic}}) AS VARCHAR) AS arguments,
'{{"trigger":' || CASE WHEN w IS NULL THEN '0.0' ELSE '0.9' END || ',"participants":' || {sure('participants', "'0.75'").replace('0.0 END', "'0.0' END")} || ',"time":' || {sure('time', "'0.8'").replace('0.0 END', "'0.0' END")} || ',"location":' || {sure('location', "'0.85'").replace('0.0 END', "'0.0' END")} || ',"topic":' || {sure('topic', "'0.7'").replace('0.0 END', "'0.0' END")} || '}}' AS confidence FROM v"""
