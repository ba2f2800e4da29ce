"""Raw MIME messages to mails: the standard library is the specification, so this is an Arrow UDF.

A message that can't be parsed gives a row of nulls with its id. Texts are decoded whole.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import html
import re
from collections.abc import Iterator
from datetime import UTC
from email.header import decode_header, make_header

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "email_id string, email_date string, sent_datetime string, subject string, body string, sender string, recipient string, cc string"


def header_text(value: str | None) -> str:
    """A header with its encoded words decoded."""
    if not value:
        return ""
    try:
        return str(make_header(decode_header(value)))
    except (LookupError, ValueError, UnicodeError):
        return value


def plain_of_html(text: str) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]+>", " ", text))).strip()


def _decoded(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def body_of(message) -> str:
    """The first plain part that is no attachment, else the first HTML part as text."""
    parts = [p for p in message.walk() if not p.is_multipart() and "attachment" not in str(p.get("Content-Disposition", "")).lower()]
    for kind, make in (("text/plain", str.strip), ("text/html", plain_of_html)):
        for p in parts:
            if p.get_content_type() == kind:
                return make(_decoded(p))
    return ""


def iso_date(value: str | None) -> str | None:
    """A mail date in ISO form with its offset; a date without one counts as UTC."""
    try:
        d = email.utils.parsedate_to_datetime(value) if value else None
    except (TypeError, ValueError, IndexError):
        return None
    return None if d is None else (d if d.tzinfo else d.replace(tzinfo=UTC)).isoformat()


def parse(raw: bytes) -> tuple[str | None, ...]:
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    return m.get("Date"), iso_date(m.get("Date")), header_text(m.get("Subject")), body_of(m), header_text(m.get("From")), header_text(m.get("To")), header_text(m.get("Cc")) or None


def parse_messages(raw: DataFrame) -> DataFrame:
    """``raw (email_id, content)`` to the columns of ``SCHEMA``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for content in b.column("content").to_pylist():
                try:
                    rows.append(parse(content) if content is not None else (None,) * 7)
                except Exception:  # noqa: BLE001 - one broken message must not end the job
                    rows.append((None,) * 7)
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("email_id").cast(pa.string()), *(pa.array(c, pa.string()) for c in cols)], [x.split()[0] for x in SCHEMA.split(", ")])

    return raw.select("email_id", "content").mapInArrow(run, SCHEMA)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """All message files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return parse_messages(files.select(F.element_at(F.split("path", "/"), -1).alias("email_id"), "content"))
