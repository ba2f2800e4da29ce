"""Evaluation texts leaking into training text: template windows joined by hash.

Every word is first canonicalised: words with a digit become one placeholder, units,
calendar names and the names of a given table (``name_words`` takes them from a corpus: words
that stand nearly always with a capital) become one placeholder a kind. The mapping is a
function of the word alone, so windows that are equal word by word are equal as templates
too. Template windows of the evaluation items are joined by hash with those of the corpus;
on the hits the slots are compared: all equal gives an exact leak, a consistent one-to-one
replacement of slot values gives a re-parameterised one. A window with fewer than
``LITERAL`` words outside slots (a table of figures) is met by its words only: it can show an
exact leak, not a re-parameterised one.

Where only exact leaks are asked for, the same template join comes first and leaves out the
windows of no item's template; the slot words of the others are then met by their hash, so a
frequent template multiplies nothing, and every word is compared on the hits.

The items' windows are broadcast up to ``BROADCAST_WORDS`` words of items (checked); a
larger set goes through a shuffled join on the window hash with the same result.

Defined results: null and empty texts and items give no rows; repeated rows give one row a
(document, item); items shorter than the window can't be found; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pauta.llm.setjoin import _batches
from pauta.llm.wordhash import mix, ngrams, word_hashes

WINDOW = 12
LITERAL = 4
BROADCAST_WORDS = 2_000_000  # 32 bytes a word: 64 MB at most
NAME_WORDS = 1_000_000  # 8 bytes a word: 8 MB at most

#: Units and calendar names whose occurrences are slots of a template.
UNITS = "euros euro eur ienes dolares reais minutos minuto min horas hora h dias dia semanas semana meses mes anos ano km m cm kg g pontos votos pessoas paginas registos copias"
NAMES = (
    "segunda terca quarta quinta sexta sabado domingo feira janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december"
)
_SLOT = {k: np.uint64(v) for k, v in (("number", 0xA5A5A5A5A5A5A501), ("unit", 0xA5A5A5A5A5A5A502), ("name", 0xA5A5A5A5A5A5A503))}


def _hashed(listing: str) -> np.ndarray:
    return np.sort(word_hashes([listing])[0])


def templates(h: np.ndarray, digits: np.ndarray, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with slot words replaced by their kind's placeholder, and which are slots."""
    t = h.copy()
    slot = digits.copy()
    for kind, listing in (("unit", _hashed(UNITS)), ("name", _hashed(NAMES)), ("name", names)):
        if listing is not None and len(listing):
            at = np.isin(h, listing)
            t[at] = _SLOT[kind]
            slot |= at
    t[digits] = _SLOT["number"]
    return t, slot


def name_words(texts: DataFrame, *, share: float = 0.9, least: int = 3) -> DataFrame:
    """(word): folded words of column ``text`` that stand at least ``least`` times, in ``share`` of them with a capital.

    Words are split from the texts on the JVM and counted with map-side combination.
    """
    word = texts.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), F.lit(0))).alias("w"))
    plain = F.translate(F.lower("w"), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    found = word.groupBy(plain.alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("w").rlike(r"^\p{Lu}")).alias("capital"))
    return found.where((F.col("n") >= least) & (F.col("capital") >= share * F.col("n")) & F.col("word").rlike("^[a-z]+$")).select("word")


def _name_hashes(names: DataFrame | None) -> np.ndarray:
    if names is None:
        return np.zeros(0, np.uint64)
    rows = names.limit(NAME_WORDS + 1).collect()
    if len(rows) > NAME_WORDS:
        raise ValueError(f"more than {NAME_WORDS} name words; take a larger share or least")
    return _hashed(" ".join(r[0] for r in rows))


def _windows(texts: list, n: int, names: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(words, which are slots, template hash, row, place) of every window."""
    h, o, digits = word_hashes(texts, with_digits=True)
    t, slot = templates(h, digits, names)
    return h, slot, *ngrams(t, o, n)


def _keys(h: np.ndarray, slot: np.ndarray, tg: np.ndarray, at: np.ndarray, n: int, exact_only: bool) -> np.ndarray:
    """What windows meet by: the template's hash.

    Where only equal slots count (``exact_only``, or too few literal words) the hash of the
    slot words at their places is mixed in; with an equal template that makes equal windows.
    """
    run = np.concatenate(([0], np.cumsum(~slot)))
    equal = np.flatnonzero((run[at + n] - run[at] < LITERAL) | exact_only)
    value = np.where(slot, h, np.uint64(0))
    keys = tg.copy()
    with np.errstate(over="ignore"):
        g = np.zeros(len(equal), np.uint64)
        for k in range(n):
            g = (g + value[at[equal] + k]) * np.uint64(0xD6E8FEB86659FD93)
            g ^= g >> np.uint64(32)
        keys[equal] = tg[equal] * np.uint64(3) + mix(g)
    return keys


class _Index:
    """Templates of the items' windows, and the windows sorted by key with their words."""

    def __init__(self, ids: np.ndarray, texts: list, n: int, names: np.ndarray | None, exact_only: bool) -> None:
        self.n, self.names, self.exact_only = n, names, exact_only
        self.h, slot, tg, row, at = _windows(texts, n, names)
        keys = _keys(self.h, slot, tg, at, n, exact_only)
        order = np.argsort(keys, kind="stable")
        self.templates, self.keys, self.at, self.item = np.unique(tg), keys[order], at[order], np.asarray(ids)[row[order]]

    def meeting(self, texts: list) -> tuple[np.ndarray, ...]:
        """(words, which are slots, template hash, row, place) of the windows whose template is an item's."""
        h, slot, tg, row, at = _windows(texts, self.n, self.names)
        low = np.searchsorted(self.templates, tg)
        near = low < len(self.templates)
        near[near] = self.templates[low[near]] == tg[near]
        return h, slot, tg[near], row[near], at[near]

    def hits(self, texts: list) -> tuple[np.ndarray, ...]:
        """(words, row, item, exact, place in words, place in items) of all meeting windows."""
        h, slot, tg, row, at = self.meeting(texts)
        keys = _keys(h, slot, tg, at, self.n, self.exact_only)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        times = high - low
        i = np.repeat(np.arange(len(keys)), times)
        j = np.repeat(low, times) + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        eq = np.ones(len(i), bool)
        for k in range(self.n):  # the slots' check, exact on every word
            eq &= h[at[i] + k] == self.h[self.at[j] + k]
        if self.exact_only:
            i, j, eq = i[eq], j[eq], eq[eq]
        return h, row[i], self.item[j], eq, at[i], self.at[j]


def _leak_rows(index: _Index, texts: list, exact_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, kind, windows): kind 0 exact, 1 re-parameterised with consistent slots."""
    h, row, item, eq, at, place = index.hits(texts)
    if not len(row):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    if exact_only:
        pairs, n = np.unique(np.stack([row, item], axis=1), axis=0, return_counts=True)
        return pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), n
    diagonal = at - place
    order = np.lexsort((place, diagonal, item, row))
    out: dict[tuple[int, int], list[int]] = {}
    keys = np.stack([row, item, diagonal], axis=1)[order]
    cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    for part in np.split(order, cuts):
        r, it = int(row[part[0]]), int(item[part[0]])
        if eq[part].any():
            kind = 0
        else:
            ours = np.unique((at[part][:, None] + np.arange(index.n)).ravel())
            theirs = ours - diagonal[part[0]]
            slot = np.unique(np.stack([index.h[theirs], h[ours]], axis=1), axis=0)
            kind = 1 if len(np.unique(slot[:, 0])) == len(slot) == len(np.unique(slot[:, 1])) else 2
        best = out.setdefault((r, it), [kind, 0])
        if kind < best[0]:
            best[:] = [kind, 0]
        if kind == best[0]:  # windows of the best kind only
            best[1] += int(eq[part].sum()) if kind == 0 else len(part)
    found = [(r, i, k, n) for (r, i), (k, n) in out.items() if k < 2]
    a = np.array(found, np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def leaks(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, exact_only: bool = True, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, kind, windows): documents that hold at least ``window`` consecutive words of an item.

    ``kind`` is ``exact`` or, unless ``exact_only``, also ``reparameterised``; ``windows``
    counts those of that kind. ``names`` (one column of folded words) are slots too.
    """
    name_hashes = _name_hashes(names)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0  # a word and a blank take two characters at least
    if size <= BROADCAST_WORDS:
        rows = items.collect()
        index = _Index(np.array([r["item_id"] for r in rows], np.int64), [r["text"] for r in rows], window, name_hashes, exact_only)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(it):
            for b, texts in _batches(it):
                row, item, kind, n = _leak_rows(shared.value, texts, exact_only)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(item), pa.array(kind), pa.array(n)], ["doc_id", "item_id", "k", "windows"])

        found = docs.mapInArrow(scan, "doc_id bigint, item_id bigint, k bigint, windows bigint")
    else:
        found = _joined(docs, items, window, exact_only, name_hashes)
    kinds = F.when(F.col("k") == 0, "exact").otherwise("reparameterised")
    return found.groupBy("doc_id", "item_id").agg(F.min("k").alias("k"), F.max("windows").alias("windows")).select("doc_id", "item_id", kinds.alias("kind"), "windows")


def _joined(docs: DataFrame, items: DataFrame, window: int, exact_only: bool, names: np.ndarray) -> DataFrame:
    """The shuffled form: candidates by the windows' keys, then the same slot check on each pair's texts."""

    def keyed(it):
        for b, texts in _batches(it):
            h, slot, tg, row, at = _windows(texts, window, names)
            pairs = np.unique(np.stack([row.astype(np.uint64), _keys(h, slot, tg, at, window, exact_only)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(pairs[:, 0].astype(np.int64))), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], ["id", "k"])

    d = docs.withColumnRenamed("doc_id", "id").mapInArrow(keyed, "id bigint, k bigint").withColumnRenamed("id", "doc_id")
    i = items.withColumnRenamed("item_id", "id").mapInArrow(keyed, "id bigint, k bigint").withColumnRenamed("id", "item_id")
    pairs = d.join(i, "k").select("doc_id", "item_id").distinct()
    both = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "item_id", "text", "item_text")

    def check(it):
        for b, texts in _batches(it):
            ids, its = b.column("item_id").to_numpy(), b.column("item_text").to_pylist()
            for k in range(b.num_rows):
                _, item, kind, n = _leak_rows(_Index(ids[k : k + 1], [its[k]], window, names, exact_only), texts[k : k + 1], exact_only)
                if len(item):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k, 1), pa.array(item), pa.array(kind), pa.array(n)], ["doc_id", "item_id", "k", "windows"])

    return both.mapInArrow(check, "doc_id bigint, item_id bigint, k bigint, windows bigint")


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents with an exact and with a re-parameterised leak."""
    found = leaks(docs, items, exact_only=False, names=name_words(docs.select("text").union(items.select("text"))))
    return (
        items.select("item_id", "category", "split")
        .distinct()
        .join(found.groupBy("item_id").agg(F.count_if(F.col("kind") == "exact").alias("exact_documents"), F.count_if(F.col("kind") == "reparameterised").alias("reparameterised_documents")), "item_id", "left")
        .na.fill(0, ["exact_documents", "reparameterised_documents"])
    )
