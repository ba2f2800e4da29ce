"""Repetition inside a single document.

Two measures come from one pass over hashed words and lines:

* the *repeated share* of a document, 1 - distinct / all sequences of four words, and
* *cross-document line frequency*: normalised lines are hashed, the number of different
  documents of a host (``source``) that hold each line is counted, lines above the limits
  are removed and documents that lose most of their words are rejected.

Line counts can't give the share of phrases repeated inside a line, so the share is taken
from word sequences; the line measure is an operator of its own (``line_frequency``).

Defined results: null, empty and blank texts have no words and share 0; a document with
fewer than four words has share 0; a null ``source`` is one host; repeated rows of a
document count once in line counts; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pauta.cluster import bounded_rows, cut_lineage
from pauta.llm.setjoin import _batches
from pauta.llm.wordhash import distinct_per_row, ngrams, word_hashes

SEQUENCE = 4
MIN_WORDS = 20
HIGH = 0.3
FREQUENT_LINES = 200_000  # 32 bytes a line: a few MB
SALTS = 16


def repeated_share(docs: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, n_words, n_sequences, n_distinct, repeated_share) of every document."""

    def measure(it):
        for b, texts in _batches(it):
            h, o = word_hashes(texts)
            g, row, _ = ngrams(h, o, sequence)
            every = np.bincount(row, minlength=len(texts))
            distinct = np.bincount(distinct_per_row(g, row)[1], minlength=len(texts))
            share = np.where(every > 0, 1 - distinct / np.maximum(every, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(o)), pa.array(every), pa.array(distinct), pa.array(share)], ["doc_id", "n_words", "n_sequences", "n_distinct", "repeated_share"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "doc_id bigint, n_words bigint, n_sequences bigint, n_distinct bigint, repeated_share double")


def repetitive_documents(docs: DataFrame, *, min_words: int = MIN_WORDS, high: float = HIGH) -> DataFrame:
    """(doc_id) of documents of at least ``min_words`` words whose repeated share is at least ``high``."""
    m = repeated_share(docs)
    return m.where((F.col("n_words") >= min_words) & (F.col("n_sequences") > 0) & (F.col("n_distinct") <= (1 - high) * F.col("n_sequences") + 1e-9)).select("doc_id").distinct()


def line_frequency(docs: DataFrame, *, most_documents: int = 20, most_share: float = 0.05, depleted_below: float = 0.5) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_share, rejected) after removing lines that too many documents of a host hold.

    A line is removed when more than ``most_documents`` documents of its host and more than
    ``most_share`` of them hold it. Lines are hashed (two 64-bit hashes) after folding case
    and blanks; counts are combined on the map side, so a line or host of a third of all
    rows is no hot group there. The frequent lines join back by hash and host: broadcast up
    to a checked number, else with the documents' side dealt to ``SALTS`` salts a line.
    Copies of a row are counted by their first lines, and every sum is divided by them.
    """
    folded = F.lower(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")))
    host = F.coalesce(F.col("source"), F.lit(""))
    base = docs.select("doc_id", host.alias("host"), F.xxhash64("text").alias("row"), "text").where("text is not null")
    lines = base.select("doc_id", "host", "row", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).select(
        "doc_id", "host", "row", "at", F.length(folded).alias("width"), F.xxhash64(folded).alias("k1"), F.xxhash64(F.lit(7), folded).alias("k2")
    )
    per_doc = lines.groupBy("doc_id", "host", "row", "k1", "k2").agg(F.count_if(F.col("width") > 0).alias("times"), F.count_if(F.col("at") == 0).alias("copies"), F.max("width").alias("width"))
    held = per_doc.where("width > 0").groupBy("host", "k1", "k2").agg(F.count_distinct("doc_id").alias("documents"))
    hosts = base.groupBy("host").agg(F.count_distinct("doc_id").alias("host_documents"))
    frequent = held.where(F.col("documents") > most_documents).join(hosts, "host").where(F.col("documents") > most_share * F.col("host_documents")).select("host", "k1", "k2", F.lit(1).alias("hit"))
    frequent = cut_lineage(frequent)
    if bounded_rows(frequent, FREQUENT_LINES):
        marked = per_doc.join(F.broadcast(frequent), ["host", "k1", "k2"], "left")
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = per_doc.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "k1", "k2", "salt"], "left")
    wide = F.col("times") * F.col("width")
    one = marked.groupBy("doc_id", "host", "row").agg(
        F.sum("copies").alias("copies"),
        F.sum("times").alias("n_lines"),
        F.sum(F.when(F.col("hit") == 1, F.col("times")).otherwise(0)).alias("n_removed"),
        F.sum(F.when(F.col("hit").isNull(), wide).otherwise(0)).alias("kept"),
        F.sum(wide).alias("every"),
    )
    whole = lambda c: F.sum(F.floor(F.col(c) / F.col("copies")))
    out = one.groupBy("doc_id").agg(whole("n_lines").alias("n_lines"), whole("n_removed").alias("n_removed"), (whole("kept") / whole("every")).alias("kept")).where("n_lines > 0")
    return out.select("doc_id", "n_lines", "n_removed", F.round("kept", 6).alias("kept_share"), (F.col("kept") < depleted_below).alias("rejected"))
