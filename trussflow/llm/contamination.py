"""Evaluation texts leaking into a corpus: template windows, hash join, slot check, exact alignment.

Texts are normalised (case, punctuation, markup, line prefixes, line-end hyphens, typographic variants) to words; numbers,
units and names are replaced by typed placeholders. Every WINDOW placeholder words in a row are a row with two hashes: that of
the template and that of the words themselves. The windows of documents and items are hash-joined on the template; the slot
check then compares the words in the slots. Windows whose slots hold the item's own words are seeds of an exact leak; enough
windows on a diagonal, whatever their slots, are seeds of a re-parameterised item. Seeds are decided on the hashes of words,
so no text is read twice: exact leaks by furthest-reaching alignment, in which a changed slot is a replaced word;
re-parameterised items by the longest run with a consistent exchange of slot values.
The corpus is never shuffled: documents emit only windows whose template some item has, as long as the templates of the items
fit a checked size, and all windows beyond it. Names are told by capitals, which disguises change, so they are slots only in
a second reading, and only where exchanged slots are sought.

A leak is a run of at least RUN words of the item, or a stretch of at least STRETCH item words with at most one word in
EVERY replaced, left out or added. Any such stretch holds WINDOW equal words in a row (24 words with 3 edits leave 21 words
in 4 runs), so no leak is without a seed.

Defined results: null and empty texts leak nothing; repeated documents and items each count by their id; a null id is left
out; items shorter than RUN words cannot leak; very long texts are processed whole.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussflow.session import SMALL_BYTES, lookup_join, materialize, table_bytes

RUN, STRETCH, EVERY, WINDOW = 13, 24, 8, 6

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\((?:https?:|/|#|mailto:)[^)\s]*\)")
_MARKS = r"(?:>+|[-*•·–—‣▪|+]|#+|\[[^\]\n]{1,24}\]|\d{1,2}:\d{2}(?::\d{2})?)"
_NUMBERS = r"(?:\(?\d{1,3}[.)]|\d{1,3}(?:\.\d{1,3}){1,3}\.?|\(?[A-Za-z][.)])"
#: Line prefixes that are marks only, and those with numbers too (a wrapped line may also begin with a number of its own).
_PREFIX = re.compile(rf"^[ \t]*(?:{_MARKS}(?:[ \t]+|$)|>+)+", re.M)
_NUMBERED = re.compile(rf"^[ \t]*(?:(?:{_MARKS}|{_NUMBERS})(?:[ \t]+|$)|>+)+", re.M)
_HAS_NUMBER = re.compile(rf"^(?:[ \t]*(?:{_MARKS}[ \t]+|>+))*[ \t]*{_NUMBERS}(?:[ \t]|$)", re.M)
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+(?:[.,’'][^\W_]+)*")
_INNER = re.compile(r"[.,’']")
#: Characters without width, and marks that combine with a letter.
_INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
#: Unit words of slots.
_UNITS = {"mm", "cm", "m", "km", "m2", "m3", "millimetres", "millimetre", "centimetres", "metres", "metre", "kilograms", "kg", "kilogramm", "kilos", "percent", "w/m2k", "mpa", "kn", "inch", "inches", "feet", "ft"}


#: Titles whose full stop ends no sentence (as that of an initial).
_TITLES = {"mr", "mrs", "ms", "dr", "prof", "st", "ing", "dipl"}


def words(text: str | None, numbered: bool = False) -> list[str]:
    """Normalised words of a text. ``numbered``: numbers and letters of lists and clauses before lines are dropped too."""
    return _split(_clean(text, numbered).casefold())


def names(text: str | None, numbered: bool = False) -> list[bool]:
    """Which words of a text are names: capitalised ones, at the start of a sentence only before another capitalised one."""
    t = _clean(text, numbered)
    if not t.isascii():
        t = _COMBINING.sub("", unicodedata.normalize("NFKD", t)).replace("‐", "").replace("‑", "")
    t = t.replace("-", "")
    capital, starts, last, before = [], [], 0, ""
    for m in _WORD.finditer(t):
        w, gap = m.group(), t[last : m.start()]
        short = len(before) == 1 or before.casefold() in _TITLES
        starts.append(not before or any(c in "!?:" or c == "." and not short for c in gap))
        capital.append(w[0].isupper())
        last, before = m.end(), w
    follows = [c and not s for c, s in zip(capital[1:], starts[1:])] + [False]
    return [c and (not s or f) for c, s, f in zip(capital, starts, follows)]


def _clean(text: str | None, numbered: bool) -> str:
    if not text:
        return ""
    t = html.unescape(text) if "&" in text else text
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "](" in t:
        t = _LINK.sub(" ", t)
    return _HYPHEN.sub("", (_NUMBERED if numbered else _PREFIX).sub("", t))


def _split(t: str) -> list[str]:
    if not t.isascii():
        t = _COMBINING.sub("", unicodedata.normalize("NFKD", t)).replace("‐", "").replace("‑", "")
    found = _WORD.findall(t.replace("-", ""))
    return [w if w.isalnum() else _INNER.sub("", w) for w in found]


def slot(word: str, name: bool = False) -> str:
    """The typed placeholder of a word, or the word."""
    if any(c.isdigit() for c in word):
        return "<n>"
    if word in _UNITS:
        return "<u>"
    return "<p>" if name or word.startswith("ifc") else word


def _named(text: str, w: list[str], numbered: bool = False) -> list[bool]:
    """``names``, or none where folding the case changed the count of words."""
    flags = names(text, numbered)
    return flags if len(flags) == len(w) else [False] * len(w)


def _reach(a: list[int], b: list[int], i: int, j: int, step: int, slack: int) -> list[int]:
    """Most words of ``b`` covered from (i, j) in direction ``step`` with 0, 1, 2, ... edits."""
    na, nb = len(a), len(b)

    def slide(x: int, y: int) -> int:
        while 0 <= x < na and 0 <= y < nb and a[x] == b[y]:
            x += step
            y += step
        return y

    left = nb - j if step > 0 else j + 1
    front = {0: slide(i, j)}  # diagonal (x - y, in step direction) -> y
    out = [abs(front[0] - j)]
    for e in range(1, left // EVERY + 2):
        new: dict[int, int] = {}
        for d, y in front.items():
            x = i + (y - j) + d * step
            inside = 0 <= y < nb
            # replaced, left out of the document, added in the document
            for d2, x2, y2 in ((d, x + step, y + step), (d - 1, x, y + step), (d + 1, x + step, y)):
                if y2 != y and not inside or x2 != x and not 0 <= x < na:
                    continue
                y3 = slide(x2, y2)
                if d2 not in new or (y3 - new[d2]) * step > 0:
                    new[d2] = y3
        if not new:
            break
        best = max(abs(y - j) for y in new.values())
        out.append(max(best, out[-1]))
        if best < EVERY * e - slack:
            break
        front = new
    return out


def _leak(doc: list[int], item: list[int], i: int, j: int, n: int) -> tuple[int, int] | None:
    """(stretch, edits) of a leak around the equal run doc[i:i+n] == item[j:j+n], or None."""
    if n >= RUN:
        return n, 0
    right = _reach(doc, item, i + n, j + n, 1, STRETCH)
    left = _reach(doc, item, i - 1, j - 1, -1, STRETCH)
    best = None
    for e1, a in enumerate(left):
        for e2, b in enumerate(right):
            total = a + n + b
            if total >= STRETCH and EVERY * (e1 + e2) <= total and (best is None or total > best[0]):
                best = total, e1 + e2
    return best


def _exchanges(pairs: list[tuple[str, str]]) -> Iterator[tuple[int, int]]:
    """(length, changed) of the longest runs of (word, item word) in which each item word stands for one word."""
    begin, changed, at = 0, [0], {}
    for n, (x, y) in enumerate(pairs):
        seen = at.get(y)
        if seen is not None and seen[0] != x and seen[1] >= begin:
            yield n - begin, changed[n] - changed[begin]
            begin = seen[1] + 1
        at[y] = x, n
        changed.append(changed[n] + (x != y))
    yield len(pairs) - begin, changed[-1] - changed[begin]


def _decide(doc: list[int], doc_slots: list[int], item: list[int], item_slots: list[int], seeds: list[tuple[int, int]], exact: bool) -> tuple | None:
    """(longest run, stretch, edits) of an exact leak, or (run, changed slots) of a re-parameterised item, from the seeds of a pair."""
    best, longest = None, 0
    last: dict[int, int] = {}
    for i, j in sorted(seeds):
        seen = last.get(i - j)
        last[i - j] = i
        if seen is not None and seen >= i - 1:
            continue
        a, b = (doc, item) if exact else (doc_slots, item_slots)
        n = WINDOW
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        if exact:
            hit = _leak(doc, item, i, j, n)
            if hit:
                longest = max(longest, n)
                best = hit if best is None else max(best, hit)
        else:
            for run, changed in _exchanges(list(zip(doc[i : i + n], item[j : j + n]))):
                if run >= RUN and changed and (best is None or run > best[0]):
                    best = run, changed
    return best if best is None or not exact else (longest, *best)


_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hasher:
    """Hashes of the template windows of texts."""

    def __init__(self, with_names: bool):
        self.with_names = with_names
        self.memo: dict[tuple[str, bool], tuple[int, int]] = {}

    def _word(self, key: tuple[str, bool]) -> tuple[int, int]:
        h = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        v = self.memo[key] = (h(slot(*key)), h(key[0]))
        return v

    def windows(self, w: list[str], flags: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Placeholder hashes, word hashes, and (template hash, word hash) of the window at every position."""
        n = max(0, len(w) - WINDOW + 1)
        known, word = self.memo.get, self._word
        h = np.array([known(k) or word(k) for k in zip(w, flags or repeat(False))], np.uint64).reshape(-1, 2).T
        out = np.zeros((2, n), np.uint64)
        for j in range(WINDOW if n else 0):
            out = out * _STEP + h[:, j : j + n]
        return h[0].view(np.int64), h[1].view(np.int64), out.view(np.int64)

    def readings(self, text: str) -> Iterator[tuple[int, list[str], list[bool] | None]]:
        """(number, words, name flags) of every way a text is read: with and without numbers before lines, names as words or slots."""
        plain = words(text)
        yield 0, plain, None
        other = words(text, numbered=True) if _HAS_NUMBER.search(text) else plain
        if other != plain:
            yield 1, other, None
        if self.with_names:
            yield 2, plain, _named(text, plain)
            if other != plain:
                yield 3, other, _named(text, other, numbered=True)


def probes(texts: DataFrame, key: str, with_names: bool, numbered: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """key, named, w, s, seeds of every reading of a text: hashes of its words and placeholders, and its windows (pos, template, exact).

    ``wanted``: only windows of these templates, and only readings that have one.
    """
    build = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)
    seed = pa.struct([("pos", pa.int32()), ("template", pa.int64()), ("exact", pa.int64())])
    longs = pa.list_(pa.int64())

    def run(batches):
        hasher = _Hasher(with_names)
        keep = None if build is None else build.value
        for batch in batches:
            keys, named, ws, ss, sizes, seeds = [], [], [], [], [0], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for reading, w, flags in hasher.readings(text):
                    if not numbered and reading in (1, 3):
                        continue
                    slots, ids, h = hasher.windows(w, flags)
                    at = np.arange(h.shape[1])
                    if keep is not None and len(at):
                        spot = np.searchsorted(keep, h[0])
                        at = np.flatnonzero(keep[np.minimum(spot, len(keep) - 1)] == h[0]) if len(keep) else at[:0]
                    if not len(at):
                        continue
                    keys.append(k)
                    named.append(reading >= 2)
                    ws.append(ids)
                    ss.append(slots)
                    sizes.append(sizes[-1] + len(at))
                    seeds.append(np.vstack([at, h[:, at]]))
            flat = np.hstack(seeds) if seeds else np.zeros((3, 0), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1]), pa.array(flat[2])], fields=list(seed)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(named, pa.bool_()), pa.array(ws, longs), pa.array(ss, longs), lists], names=[key, "named", "w", "s", "seeds"])

    return texts.select(key, "text").mapInArrow(run, f"{key} long, named boolean, w array<long>, s array<long>, seeds array<struct<pos:int,template:long,exact:long>>")


def _lists(offsets: pa.Array, values: pa.Array) -> list[list[int]]:
    """Python lists of an Arrow list column without nulls."""
    o, v = offsets.to_numpy(), values.to_numpy(zero_copy_only=False)
    return [v[a:b].tolist() for a, b in zip(o[:-1], o[1:])]


def _probe(documents: DataFrame, items: DataFrame, exact: bool, columns: list[str]) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    tests = materialize(probes(tests, "item_id", not exact, False).where(F.size("w") >= RUN), "items").withColumn("test", F.xxhash64("item_id", "named", "w"))
    windows = tests.select("test", "item_id", "named", F.inline("seeds")).withColumnsRenamed({"pos": "item_pos", "exact": "item_exact"})
    templates = materialize(windows.select("template").distinct(), "templates")
    wanted = None
    if table_bytes(templates) <= SMALL_BYTES:  # a checked size of the stated query set
        wanted = np.sort(np.array([r[0] for r in templates.collect()], np.int64))
    read = materialize(probes(docs, "doc_id", not exact, True, wanted).withColumn("probe", F.monotonically_increasing_id()), "probes")
    # Numbers before lines are a matter of documents only; templates with and without names are different ones.
    seeds = lookup_join(read.select("probe", "named", F.inline("seeds")), windows, ["named", "template"], "inner")
    same = F.col("exact") == F.col("item_exact")
    if exact:  # some window's slots hold the item's own words
        seeds = seeds.where(same)
    else:  # RUN template words in a row have RUN - WINDOW + 1 windows on one diagonal
        d = seeds.groupBy("probe", "test", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.count("*").alias("n"), F.bool_and(same).alias("same"), F.collect_list(F.struct("pos", "item_pos")).alias("at"))
        seeds = d.where((F.col("n") >= RUN - WINDOW + 1) & ~F.col("same")).select("probe", "test", F.inline("at"))
    pairs = seeds.groupBy("probe", "test").agg(F.collect_list(F.struct("pos", "item_pos")).alias("at"))
    # Pairs come to their documents, then the words of the items to the pairs; the words of documents do not move.
    rows = lookup_join(read.select("probe", "doc_id", "w", "s"), pairs, ["probe"], "inner")
    rows = lookup_join(rows, tests.select("test", "item_id", F.col("w").alias("item_w"), F.col("s").alias("item_s")), ["test"], "inner")

    def run(batches):
        for batch in batches:
            out = []
            at = batch.column(6).values
            places = [list(zip(*x)) for x in zip(*(_lists(batch.column(6).offsets, at.field(k)) for k in (0, 1)))]
            lists = (_lists(batch.column(k).offsets, batch.column(k).values) for k in range(2, 6))
            for doc_id, item_id, w, s, iw, it, seeds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *lists, places):
                v = _decide(w, s, iw, it, seeds, exact)
                if v is not None:
                    out.append((doc_id, item_id, *v))
            cols = list(zip(*out)) or [()] * (2 + len(columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)], names=["doc_id", "item_id", *columns])

    slots = ("w", "item_w") if exact else ("s", "item_s")  # placeholders play no part in an exact alignment
    found = rows.select("doc_id", "item_id", "w", F.col(slots[0]).alias("s"), "item_w", F.col(slots[1]).alias("item_s"), "at").mapInArrow(run, f"doc_id long, item_id long, {', '.join(f'{c} int' for c in columns)}")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*columns)).alias("v")).select("doc_id", "item_id", "v.*")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, longest_run, stretch, edits: every document and the items leaked into it."""
    return _probe(documents, items, True, ["longest_run", "stretch", "edits"])


def reparameterised(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, template_run, changed: runs of RUN or more template words with consistently exchanged slots."""
    return _probe(documents, items, False, ["template_run", "changed"])
