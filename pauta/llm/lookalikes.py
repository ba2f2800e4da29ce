"""Visually identical text with different characters, brought to one form.

Strings and code points that look alike (or print as nothing) are linked by rules over the
Unicode tables and one table of look-alike letters; union-find closes the links to
transitive classes. Each class gets a representative: of its members that one types in
European Portuguese (ASCII and precomposed Latin-1 letters) the most frequent in the data,
else the most frequent at all. An Aho-Corasick automaton of all other members rewrites a
text greedily, leftmost and longest first, until nothing changes. Letters of another script
are rewritten only inside words that also hold Latin letters, so foreign words stay.

Defined results: null stays null, an empty text stays empty; texts are rewritten whole;
rewriting a rewritten text changes nothing; ordinals, fractions, superscripts, dashes,
quotes and emoji stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pauta.llm.setjoin import _batches

#: Letters of other scripts (and rare Latin ones) that look like Latin letters.
LETTERS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y", "к": "k", "г": "r", "ё": "ë", "ї": "ï",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "η": "n", "τ": "t", "ε": "e", "ά": "á", "έ": "é", "ί": "í", "ό": "ó", "ύ": "ú",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Տ": "S", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ꞑ": "n",
}
#: Other characters that look like typed ones.
OTHERS = {"\u2010": "-", "\u2011": "-", "\u2028": "\n", "\u2029": "\n", "\u0085": "\n", "\u1680": " ", "\u180e": "", "\u2800": " ", "\u3164": "", "\u115f": "", "\u1160": "", "\uffa0": "", "\u034f": ""}

_TYPED = {chr(c) for c in range(32, 127)} | set("\n\r\t") | {chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
_SAFE = re.compile("[^\t\n\r -~\xa1-\xac\xae-\xff–—‘-‟…€]")
_HIDDEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\u061c"


class _Union:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)


def _links():
    """Pairs of look-alike strings, by rule."""
    for c in range(0x80, 0x1FB00):
        if 0x3400 <= c <= 0xF8FF or 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        kind, tag = unicodedata.category(ch), unicodedata.decomposition(ch)
        if ch in OTHERS or ch == "\ufe0f":
            continue
        if kind == "Zs":
            yield ch, " "
        elif kind == "Cf" or (kind == "Cc" and ch != "\x85") or 0xFE00 <= c <= 0xFE0E:
            yield ch, ""
        elif tag.startswith(("<wide>", "<narrow>", "<font>")) or (tag.startswith("<compat>") and kind[0] in "LN" and kind != "No"):
            plain = unicodedata.normalize("NFKC", ch)
            if plain != ch and all(x in _TYPED for x in plain):
                yield ch, plain
        elif tag and not tag.startswith("<"):
            for form in ("NFD", "NFC"):
                other = unicodedata.normalize(form, ch)
                if other != ch and (c < 0x250 or 0x1E00 <= c < 0x1F00 or c in (0x212A, 0x212B)):
                    yield ch, other
    for c in [*range(0, 9), 11, 12, *range(14, 32), 127, 0xFE0F]:
        yield chr(c), ""
    yield from LETTERS.items()
    yield from OTHERS.items()


def classes() -> list[list[str]]:
    """The transitive look-alike classes."""
    u = _Union()
    for a, b in _links():
        u.join(a, b)
    out: dict[str, list[str]] = {}
    for x in list(u.up):
        out.setdefault(u.find(x), []).append(x)
    return [sorted(v) for v in out.values() if len(v) > 1]


def representatives(counts: dict[str, int] | None = None) -> dict[str, str]:
    """Every member of a class that isn't its representative, with the representative."""
    counts = counts or {}
    rewrite = {}
    for members in classes():
        typed = [m for m in members if all(c in _TYPED for c in m)]
        pool = typed or [m for m in members if len(m) == 1]
        if pool:
            best = min(pool, key=lambda m: (-counts.get(m, 0), -len(m), m))
            rewrite.update({m: best for m in members if m not in typed and m != best})
    return rewrite


def _latin(ch: str) -> bool:
    return ch in _TYPED and ch.isalpha() or "LATIN" in unicodedata.name(ch, "")


class Rewriter:
    """The automaton of look-alikes and its greedy rewriting."""

    def __init__(self, counts: dict[str, int] | None = None) -> None:
        self.table = representatives(counts)
        self.foreign = {k for k in self.table if k in LETTERS and not _latin(k)}
        self.automaton = ahocorasick.Automaton()
        for k, v in self.table.items():
            self.automaton.add_word(k, (k, v))
        self.automaton.make_automaton()
        self._mixed: dict[str, bool] = {}

    def __reduce__(self):
        return _rebuilt, (self.table,)

    def _in_latin_word(self, text: str, at: int) -> bool:
        part = lambda c: c.isalpha() or unicodedata.combining(c) or c in _HIDDEN
        a = b = at
        while a and part(text[a - 1]):
            a -= 1
        while b < len(text) and part(text[b]):
            b += 1
        word = text[a:b]
        if word not in self._mixed:
            if len(self._mixed) > 100_000:
                self._mixed.clear()
            self._mixed[word] = any(_latin(c) for c in word if c not in self.foreign)
        return self._mixed[word]

    def _pass(self, text: str, source: list[int] | None) -> tuple[str, list[int] | None]:
        out, origin, done = [], [], 0
        for end, (key, value) in self.automaton.iter_long(text):
            start = end - len(key) + 1
            if key in self.foreign and not self._in_latin_word(text, start):
                continue
            if key in ("\ufe0f", "\u200d") and start and unicodedata.category(text[start - 1]) in ("So", "Sk", "Mn"):
                continue  # part of an emoji
            out += (text[done:start], value)
            if source is not None:
                origin += source[done:start] + [source[start]] * len(value)
            done = end + 1
        if not out:
            return text, source
        out.append(text[done:])
        if source is not None:
            origin += source[done:]
        return "".join(out), origin if source is not None else None

    def plain(self, text: str | None) -> str | None:
        """The text in its one form."""
        if text is None or not _SAFE.search(text):
            return text
        seen = set()
        while text not in seen:  # until nothing changes
            seen.add(text)
            text, _s = self._pass(text, None)
        return text

    def plain_with_source(self, text: str) -> tuple[str, list[int] | None]:
        """The text in its one form, and the place in ``text`` of each of its characters (None: the same places)."""
        if not _SAFE.search(text):
            return text, None
        source: list[int] | None = list(range(len(text)))
        seen = set()
        while text not in seen:
            seen.add(text)
            text, source = self._pass(text, source)
        return text, source


def _rebuilt(table: dict[str, str]) -> Rewriter:
    r = Rewriter.__new__(Rewriter)
    r.table = table
    r.foreign = {k for k in table if k in LETTERS and not _latin(k)}
    r.automaton = ahocorasick.Automaton()
    for k, v in table.items():
        r.automaton.add_word(k, (k, v))
    r.automaton.make_automaton()
    r._mixed = {}
    return r


def character_counts(texts: DataFrame) -> dict[str, int]:
    """How often every character occurs in column ``text`` (at most one row a code point comes back)."""

    def count(it):
        total: Counter = Counter()
        for _, t in _batches(it):
            total.update("".join(x for x in t if x))
        yield pa.RecordBatch.from_pydict({"ch": pa.array([ord(c) for c in total], pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "ch int, n bigint").groupBy("ch").agg(F.sum("n").alias("n")).collect()
    return {chr(r["ch"]): r["n"] for r in rows}


def one_form(records: DataFrame) -> DataFrame:
    """``records (tbl, rec_id, text)`` with ``plain``, the text in one form, and ``changed``."""
    records = records.select("tbl", "rec_id", F.col("text").cast("string").alias("text"))
    shared = records.sparkSession.sparkContext.broadcast(Rewriter(character_counts(records)))

    def rewrite(it):
        r = shared.value
        for b, texts in _batches(it):
            plain = [r.plain(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("tbl"), b.column("rec_id"), b.column("text"), pa.array(plain, pa.string()), pa.array([p != t for p, t in zip(plain, texts)], pa.bool_())], ["tbl", "rec_id", "text", "plain", "changed"]
            )

    return records.mapInArrow(rewrite, "tbl string, rec_id string, text string, plain string, changed boolean")


def records_of(mails: DataFrame, cases: DataFrame) -> DataFrame:
    a = mails.select(F.lit("test_dataset").alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.col("body").alias("text"))
    b = cases.select(F.lit("topic_extraction_holdout").alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.col("gold_topic").alias("text"))
    return a.union(b)


def odd_records(mails: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct (tbl, rec_id) of the records whose text isn't in its one form."""
    return one_form(records_of(mails, cases)).where("changed and rec_id is not null").select("tbl", "rec_id").distinct()


def jvm_plain(text: Column) -> Column:
    """Single characters replaced by their representatives, as a JVM expression (for patterns over ASCII)."""
    table = {k: v for k, v in representatives().items() if len(k) == 1 and len(v) <= 1}
    keep = [k for k, v in table.items() if v] + [k for k, v in table.items() if not v]
    return F.translate(text, "".join(keep), "".join(table[k] for k in keep))
