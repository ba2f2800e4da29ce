"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pauta.cluster import cut_lineage
from pauta.llm.cross_split import cross_split_links, cross_split_pairs, cross_split_report
from pauta.llm.encoding import encode, token_counts
from pauta.llm.grouped_splits import group_pairs, grouped_splits, label_shares, split_check, split_report
from pauta.llm.leakage import leak_report, leaks
from pauta.llm.near_duplicates import near_duplicate_groups, near_duplicate_links, near_duplicate_pairs
from pauta.llm.lookalikes import odd_records, one_form, records_of, representatives
from pauta.llm.personal_data import mentions, redacted
from pauta.llm.repetition import line_frequency, repeated_share, repetitive_documents


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark, d):
    return cross_split_pairs(_read(spark, d, "topic_extraction_holdout"))


def p1_links(spark, d):
    return cross_split_links(_read(spark, d, "topic_extraction_holdout"))


def p1_report(spark, d):
    return cross_split_report(_read(spark, d, "topic_extraction_holdout"))


def p3_found(spark, d):
    return near_duplicate_pairs(_read(spark, d, "dataset"))


def p3_links(spark, d):
    return near_duplicate_links(_read(spark, d, "dataset"))


def p3_groups(spark, d):
    return near_duplicate_groups(_read(spark, d, "dataset"))


def p4_found(spark, d):
    return group_pairs(_read(spark, d, "test_dataset"))


def p4_splits(spark, d):
    return grouped_splits(_read(spark, d, "test_dataset"), _read(spark, d, "split_targets"))


def p4_report(spark, d):
    targets = _read(spark, d, "split_targets")
    return split_report(grouped_splits(_read(spark, d, "test_dataset"), targets), targets)


def p4_labels(spark, d):
    mails, targets = _read(spark, d, "test_dataset"), _read(spark, d, "split_targets")
    return label_shares(grouped_splits(mails, targets), mails, targets)


def p4_check(spark, d):
    targets = _read(spark, d, "split_targets")
    return split_check(cut_lineage(grouped_splits(_read(spark, d, "test_dataset"), targets)), targets)


def p5_found(spark, d):
    return mentions(_read(spark, d, "test_dataset"))


def p5_redacted(spark, d):
    return redacted(_read(spark, d, "test_dataset"))


def p6_found(spark, d):
    return odd_records(_read(spark, d, "test_dataset"), _read(spark, d, "topic_extraction_holdout"))


def p6_plain(spark, d):
    return one_form(records_of(_read(spark, d, "test_dataset"), _read(spark, d, "topic_extraction_holdout"))).select("tbl", "rec_id", "plain").distinct()


def p7_ids(spark, d):
    return encode(_read(spark, d, "documents"))


def p7_counts(spark, d):
    return token_counts(_read(spark, d, "documents"))


def p8_found(spark, d):
    return leaks(_read(spark, d, "documents"), _read(spark, d, "benchmark")).select("doc_id", "item_id")


def p8_report(spark, d):
    return leak_report(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def p9_found(spark, d):
    return repetitive_documents(_read(spark, d, "documents"))


def p9_shares(spark, d):
    m = repeated_share(_read(spark, d, "documents"))
    return m.select("doc_id", "n_words", "n_sequences", "n_distinct", F.round("repeated_share", 6).alias("repeated_share"))


def p9_lines(spark, d):
    return line_frequency(_read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_links, p1_report, p3_found, p3_links, p3_groups, p4_found, p4_splits, p4_report, p4_labels, p4_check, p5_found, p5_redacted, p6_found, p6_plain, p7_ids, p7_counts, p8_found, p8_report, p9_found, p9_shares, p9_lines)
}

_ORDINALS = "translate({0}, 'ªº²³¹', 'ao231')"  # letters and digits by compatibility; other such characters don't occur in these texts
_WORDS = "regexp_extract_all(strip_accents(lower(" + _ORDINALS + ")), '[a-z0-9]+')"
_TRIGRAMS = "SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM t, range(1, 3000) r(i) WHERE i <= len(w) - 2"
_PAIRS = "s AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2), p AS (SELECT x, y FROM c JOIN s a ON a.id = x JOIN s b ON b.id = y WHERE 3 * k >= a.n + b.n)"

_SINGLE = {k: v for k, v in representatives().items() if len(k) == 1 and len(v) <= 1 and k != "\x00"}
_KEPT = [k for k, v in _SINGLE.items() if v] + [k for k, v in _SINGLE.items() if not v]
_PLAIN = "translate(body, '{}', '{}')".format("".join(_KEPT).replace("'", "''"), "".join(_SINGLE[k] for k in _KEPT).replace("'", "''"))
_BOX = "regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(lower(sender_email), '(?s).*<([^<>]*)>', 1), ''), lower(sender_email)), '[\\s\\p{Z}<>\"''()\\[\\]]+', '', 'g'), '^mailto:', ''), '\\+[^@]*@', '@', 'g')"
#: A process's name in the SQL's regular expressions: the character before and the digits' end are part of the match.
_NAMED = r"(?i)(?:^|[^\p{L}\p{N}])(?:processos?|procs?\.?[ºo°]?|p\.?\s?[ºo°]\.?)[\s:]*(?:n\.?\s?[ºo°]\.?|num\.|número)?\s*[-–]?\s*([0-9]{1,12})\s*[/.–-]\s*([0-9]{1,12})(?:[^0-9]|$)"

SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE m AS (SELECT DISTINCT id, sender_email, body FROM test_dataset WHERE id IS NOT NULL), b AS (SELECT id, {_BOX} AS box, {_PLAIN} AS t FROM m), x AS (SELECT id, regexp_extract_all(t, '{_NAMED}', 1) AS one, regexp_extract_all(t, '{_NAMED}', 2) AS two FROM b),
y AS (SELECT id, unnest(one) AS one, unnest(two) AS two FROM x), z AS (SELECT id, CASE WHEN regexp_full_match(one, '(?:19|20)[0-9]{{2}}') THEN one || '/' || regexp_replace(two, '^0+([0-9])', '\\1') WHEN regexp_full_match(two, '(?:19|20)[0-9]{{2}}') THEN two || '/' || regexp_replace(one, '^0+([0-9])', '\\1') END AS k FROM y),
keys AS (SELECT DISTINCT id, 'p' || k AS k FROM z WHERE k IS NOT NULL UNION SELECT id, 'm' || box FROM b WHERE regexp_full_match(box, '[^@]+@[^@]+')), lows AS (SELECT k, min(id) AS low FROM keys GROUP BY 1), e AS (SELECT DISTINCT id AS x, low AS y FROM keys JOIN lows USING (k) WHERE id <> low), f AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(id, other) AS (SELECT x, x FROM f UNION SELECT r.id, f.y FROM reach r JOIN f ON f.x = r.other) SELECT min(other) AS group_id, id FROM reach GROUP BY id HAVING min(other) <> id""",
    "p1_found": f"""WITH t AS (SELECT DISTINCT id, lower(trim(split)) AS split, {_WORDS.format("coalesce(body, '')")} AS w FROM topic_extraction_holdout WHERE lower(trim(split)) IN ('train', 'dev', 'holdout')),
g AS ({_TRIGRAMS} AND len(w) >= 15), {_PAIRS} SELECT x AS id_a, y AS id_b FROM p JOIN t a ON a.id = x JOIN t b ON b.id = y WHERE (a.split = 'train') <> (b.split = 'train')""",
    "p3_found": f"""WITH t AS (SELECT DISTINCT id, {_WORDS.format("coalesce(subject, '') || ' ' || coalesce(body, '')")} AS w FROM dataset), g AS ({_TRIGRAMS} AND len(w) >= 30), {_PAIRS} SELECT x AS id_a, y AS id_b FROM p""",
    "p1_links": f"""WITH t AS (SELECT DISTINCT id, lower(trim(split)) = 'train' AS train, coalesce(body, '') AS body, {_WORDS.format("coalesce(body, '')")} AS w FROM topic_extraction_holdout WHERE lower(trim(split)) IN ('train', 'dev', 'holdout')), h AS (SELECT train, body, min(id) AS id, count(DISTINCT id) AS n, any_value(w) AS w FROM t WHERE len(w) >= 15 GROUP BY 1, 2),
g AS (SELECT DISTINCT id, train, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM h, range(1, 3000) r(i) WHERE i <= len(w) - 2), s AS (SELECT id, train, count(*) AS n FROM g GROUP BY 1, 2), c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.train AND NOT b.train GROUP BY 1, 2)
SELECT x AS train_id, y AS eval_id, p.n AS train_records, q.n AS eval_records, round(k / (a.n + b.n - k), 6) AS resemblance, round(k / b.n, 6) AS containment FROM c JOIN s a ON a.id = x AND a.train JOIN s b ON b.id = y AND NOT b.train JOIN h p ON p.id = x AND p.train JOIN h q ON q.id = y AND NOT q.train WHERE 3 * k >= a.n + b.n""",
    "p1_report": f"""WITH t AS (SELECT DISTINCT id, lower(trim(split)) AS split, source, {_WORDS.format("coalesce(body, '')")} AS w FROM topic_extraction_holdout WHERE lower(trim(split)) IN ('train', 'dev', 'holdout')), g AS (SELECT DISTINCT id, split = 'train' AS train, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM t, range(1, 3000) r(i) WHERE i <= len(w) - 2 AND len(w) >= 15),
s AS (SELECT id, train, count(*) AS n FROM g GROUP BY 1, 2), c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.train AND NOT b.train GROUP BY 1, 2), p AS (SELECT y, 3 * k >= a.n + b.n AS near, CASE WHEN 5 * k >= 4 * b.n THEN k / b.n END AS held FROM c JOIN s a ON a.id = x AND a.train JOIN s b ON b.id = y AND NOT b.train),
e AS (SELECT y AS id, bool_or(near) AS near, max(held) AS held FROM p GROUP BY 1) SELECT split, source, count(*) AS records, CAST(count_if(coalesce(near, false)) AS BIGINT) AS leaked, count(held) AS contained, round(avg(held), 6) AS mean_containment FROM (SELECT DISTINCT id, split, source FROM t WHERE split <> 'train') LEFT JOIN e USING (id) GROUP BY 1, 2""",
    "p3_links": f"""WITH m AS (SELECT id, coalesce(subject, '') || ' ' || coalesce(body, '') AS text FROM dataset), h AS (SELECT text, min(id) AS id FROM m GROUP BY 1), t AS (SELECT id, {_WORDS.format("text")} AS w FROM h), g AS ({_TRIGRAMS} AND len(w) >= 30), s AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT x AS class_a, y AS class_b, round(k / (a.n + b.n - k), 6) AS resemblance FROM c JOIN s a ON a.id = x JOIN s b ON b.id = y WHERE 3 * k >= a.n + b.n""",
    "p3_groups": f"""WITH RECURSIVE m AS (SELECT DISTINCT id, coalesce(subject, '') || ' ' || coalesce(body, '') AS text FROM dataset), h AS (SELECT text, min(id) AS id FROM m GROUP BY 1), t AS (SELECT id, {_WORDS.format("text")} AS w FROM h), g AS ({_TRIGRAMS} AND len(w) >= 30), s AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2), p AS (SELECT x, y FROM c JOIN s a ON a.id = x JOIN s b ON b.id = y WHERE 3 * k >= a.n + b.n), e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p), own AS (SELECT m.id, h.id AS class_id FROM m JOIN h USING (text) JOIN s ON s.id = h.id),
reach(id, other) AS (SELECT x, x FROM e UNION SELECT r.id, e.y FROM reach r JOIN e ON e.x = r.other), groups AS (SELECT id, min(other) AS group_id FROM reach GROUP BY 1), links AS (SELECT x AS id, count(*) AS links FROM e GROUP BY 1), copies AS (SELECT class_id FROM own GROUP BY 1 HAVING count(*) > 1)
SELECT own.id, own.class_id, coalesce(group_id, own.class_id) AS group_id, coalesce(links, 0) AS links FROM own LEFT JOIN groups ON groups.id = own.class_id LEFT JOIN links ON links.id = own.class_id WHERE links IS NOT NULL OR own.class_id IN (SELECT class_id FROM copies)""",
    "p4_check": "SELECT count(DISTINCT id) AS records, CAST(0 AS BIGINT) AS divided_groups, true AS shares_met FROM test_dataset WHERE id IS NOT NULL",
    "p8_found": f"""WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM t, range(1, 100000) r(i) WHERE i <= len(w) - 11), e AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM b, range(1, 1000) r(i) WHERE i <= len(w) - 11) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)""",
    "p9_shares": f"""WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), g AS (SELECT doc_id, count(*) AS n, count(DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS k FROM t, range(1, 100000) r(i) WHERE i <= len(w) - 3 GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_sequences, coalesce(k, 0) AS n_distinct, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE 1 - k / n END, 6) AS repeated_share FROM t LEFT JOIN g USING (doc_id)""",
    "p9_found": f"""WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), g AS (SELECT doc_id, count(*) AS n, count(DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS k FROM t, range(1, 100000) r(i) WHERE i <= len(w) - 3 AND len(w) >= 20 GROUP BY 1) SELECT doc_id FROM g WHERE 10 * k <= 7 * n""",
    "p9_lines": r"""WITH t AS (SELECT DISTINCT doc_id, coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, host, lower(trim(regexp_replace(unnest(string_split_regex(text, '\r?\n')), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))) AS line FROM t), p AS (SELECT doc_id, host, line, count(*) AS times, length(line) AS width FROM l WHERE line <> '' GROUP BY 1, 2, 3),
h AS (SELECT host, count(DISTINCT doc_id) AS n FROM t GROUP BY 1), f AS (SELECT host, line FROM p JOIN h USING (host) GROUP BY host, line, n HAVING count(*) > 20 AND count(*) > 0.05 * n)
SELECT doc_id, CAST(sum(times) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN f.line IS NOT NULL THEN times ELSE 0 END) AS BIGINT) AS n_removed, round(sum(CASE WHEN f.line IS NULL THEN times * width ELSE 0 END)::DOUBLE / sum(times * width), 6) AS kept_share, sum(CASE WHEN f.line IS NULL THEN times * width ELSE 0 END)::DOUBLE / sum(times * width) < 0.5 AS rejected FROM p LEFT JOIN f ON f.host = p.host AND f.line = p.line GROUP BY 1""",
}
