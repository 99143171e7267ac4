"""Personal information in free text: a linear-chain conditional random field over word-shape features.

The field is trained once per process from the small labelled table of ``pii_table`` (TRAIN_ROWS rows, a documented bound; written without any corpus at hand) by AdaGrad on
the exact gradient (forward-backward in numpy) and sent to the executors. Documents stream through Arrow batches: tokens
are turned into hashed features by array arithmetic and decoded by Viterbi over many documents at once. Spans then pass an
exact check of their form (an email holds an at sign or its dodge, a phone number 7 to 17 digits, a name is more than function
words, and so on). Plain email addresses are found whole by their form, names right after a form of address by theirs.

Defined results: null and empty texts have no spans, and a null text stays null; texts of any length are decoded
whole, in time and memory in proportion to their tokens; repeated rows give repeated spans; positions are 1-based characters.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trussflow.llm.pii_table import labelled_rows

KINDS = ["name", "email", "phone", "id_number", "address"]
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
TRAIN_ROWS, EPOCHS, BATCH, RATE, DECAY = 9_000, 5, 60, 0.25, 2e-6
DIM = 1 << 17
#: Steps after which scores are rescaled (a block of 256 texts so long is decoded at once), and tokens taken together.
STRETCH, TOGETHER = 1_500, 30_000

_TOKEN = re.compile(r"\n|[^\W\d_]+|\d+|\S")
_PAD = "\x00"
PLACEHOLDER = {k: f"<{k.upper()}>" for k in KINDS}


def _shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 16)}"
    if not w.isalpha():
        return w
    size = "1" if len(w) == 1 else "2" if len(w) == 2 else "3" if len(w) <= 4 else "5"
    if w.isupper():
        return "X" + size
    if w.islower():
        return "x" + size
    return ("Xx" if w[0].isupper() and w[1:].islower() else "mX") + size


class _Types:
    """Per distinct token: hashes of word, shape, and its first and last letters."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.add(_PAD)

    def add(self, w: str) -> int:
        k = self.ids.get(w)
        if k is None:
            k = self.ids[w] = len(self.rows)
            low = w.lower()
            if w.isdigit():
                word = f"0{min(len(w), 16)}" if len(w) > 1 else w
                pre, suf3, suf2 = w[:2] if len(w) > 5 else f"0{len(w)}", "0", "0"
            else:
                word, pre, suf3, suf2 = low, low[:3], low[-3:], low[-2:]
            self.rows.append(tuple(zlib.crc32(x.encode()) for x in (word, _shape(w), "p" + pre, "s" + suf3, "t" + suf2)))
        return k


def _plans() -> tuple[list, list]:
    """Feature templates: those of one token at an offset, and conjunctions. w: word, s: shape, p, e, f: first and last letters, g: no blank before."""
    single = [("w", o) for o in range(-4, 5)] + [("s", o) for o in (-2, -1, 0, 1, 2)] + [(k, o) for k in "pef" for o in (-1, 0, 1)]
    joint = [
        [("w", -2), ("w", -1)], [("w", -1), ("s", 0)], [("s", 0), ("w", 1)], [("w", -1), ("w", 1), ("s", 0)],
        [("w", -3), ("w", -2), ("w", -1)], [("w", -2), ("w", -1), ("s", 0)], [("s", 0), ("w", 1), ("w", 2)],
        [("s", -1), ("s", 0), ("s", 1)], [("s", -2), ("s", -1), ("s", 0)], [("s", 0), ("s", 1), ("s", 2)],
        [("s", -3), ("s", -2), ("s", -1), ("s", 0)], [("s", 0), ("s", 1), ("s", 2), ("s", 3)], [("s", -2), ("s", -1), ("s", 0), ("s", 1), ("s", 2)],
        [("w", -1), ("s", 0), ("s", 1), ("s", 2)], [("g", 0), ("g", 1), ("s", 0)], [("g", 0), ("s", -1), ("s", 0)], [("g", 1), ("s", 0), ("s", 1)],
        [("s", -4), ("s", -3), ("s", -2), ("s", -1)],
    ]
    return single, joint


_COLUMN = {"w": 0, "s": 1, "p": 2, "e": 3, "f": 4}


def _mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h * np.uint32(0x9E3779B1) + v) * np.uint32(0x85EBCA77)
    return h ^ (h >> np.uint32(15))


def _single_features(types: np.ndarray):
    """(offset, feature numbers of every type) of the one-token templates."""
    for k, (name, o) in enumerate(_plans()[0]):
        h = _mix(np.full(len(types), 1_000_003 * (k + 1), np.uint32), types[:, _COLUMN[name]])
        yield o, (h & np.uint32(DIM - 1)).astype(np.int32)


def _joint_features(ids: np.ndarray, glued: np.ndarray, types: np.ndarray):
    """Feature numbers of the conjunctions at every position. Positions beyond the ends count as pads."""
    n = len(ids)
    at = {}
    for name in "ws":
        v = types[ids, _COLUMN[name]]
        ext = np.concatenate([np.full(4, types[0, _COLUMN[name]], np.uint32), v, np.full(4, types[0, _COLUMN[name]], np.uint32)])
        for o in range(-4, 5):
            at[name, o] = ext[4 + o : 4 + o + n]
    g = np.concatenate([glued, [0]]).astype(np.uint32)
    at["g", 0], at["g", 1] = g[:n], g[1:]
    for k, plan in enumerate(_plans()[1]):
        h = np.full(n, 7_000_003 * (k + 1), np.uint32)
        for key in plan:
            h = _mix(h, at[key])
        yield (h & np.uint32(DIM - 1)).astype(np.int32)


def _allowed() -> np.ndarray:
    """Score of each transition that BIO forbids: an inside label must follow its own begin or inside."""
    t = np.zeros((LABELS, LABELS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        t[:, inside] = -1e4
        t[[1 + 2 * k, inside], inside] = 0
    return t


def _flatten(texts: list[str], types: _Types):
    """ids, glued, doc bounds and starts of all tokens of the texts, four pads between documents."""
    ids, glued, bounds, starts = [], [], [], []
    known, add = types.ids, types.add
    for text in texts:
        ids.extend((0, 0, 0, 0))
        glued.extend((0, 0, 0, 0))
        first, last, begin = len(ids), -1, []
        for m in _TOKEN.finditer(text):
            w = m.group()
            b, e = m.span()
            k = known.get(w)
            ids.append(add(w) if k is None else k)
            glued.append(b == last)
            begin.append(b)
            last = e
        bounds.append((first, len(ids)))
        starts.append(begin)
    return np.array([*ids, 0, 0, 0, 0], np.int64), np.array([*glued, 0, 0, 0, 0], np.int8), bounds, starts


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=2)
def train(rows: int = TRAIN_ROWS, epochs: int = EPOCHS, seed: int = 7, part: str = "all") -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transition scores) of the field. ``part``: ``train`` keeps the frames of tests out."""
    table = labelled_rows(rows, seed, part)
    types = _Types()
    ids, glued, bounds, starts = _flatten([t for t, _ in table], types)
    gold = np.zeros(len(ids), np.int64)
    for (a, b), begin, (_, spans) in zip(bounds, starts, table):
        begin = np.array(begin, np.int64)
        for s, e, kind in spans:
            k = KINDS.index(kind)
            inside = np.flatnonzero((begin >= s) & (begin < e)) + a
            gold[inside] = 2 + 2 * k
            gold[inside[:1]] = 1 + 2 * k
    kinds = np.array(types.rows, np.uint32)
    padded = np.concatenate([np.zeros(4, np.int64), ids, np.zeros(4, np.int64)])
    columns = [f[padded[4 + o : 4 + o + len(ids)]] for o, f in _single_features(kinds)] + list(_joint_features(ids, glued, kinds))
    matrix = np.stack(columns, axis=1)
    mask = _allowed().astype(np.float64)
    w, trans = np.zeros((DIM, LABELS)), np.zeros((LABELS, LABELS))
    gw, gt = np.full_like(w, 1e-2), np.full_like(trans, 1e-2)
    order = sorted(range(len(bounds)), key=lambda i: bounds[i][1] - bounds[i][0])
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            part = [bounds[i] for i in batches[k] if bounds[i][1] > bounds[i][0]]
            if not part:
                continue
            size, longest = len(part), max(b - a for a, b in part)
            pos = np.zeros((size, longest), np.int64)
            live = np.zeros((size, longest), bool)
            for r, (a, b) in enumerate(part):
                pos[r, : b - a] = np.arange(a, b)
                live[r, : b - a] = True
            feats = matrix[pos]
            em = w[feats].sum(axis=2)
            tr = trans + mask
            alpha = np.zeros((size, longest, LABELS))
            beta = np.zeros_like(alpha)
            alpha[:, 0] = em[:, 0] + tr[0]
            for t in range(1, longest):
                nxt = em[:, t] + _logsumexp(alpha[:, t - 1, :, None] + tr, 1)
                alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                nxt = _logsumexp(tr + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(live[:, t + 1, None], nxt, 0)
            z = _logsumexp(alpha[:, -1], 1)
            prob = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
            y = gold[pos]
            grad = prob.copy()
            rr, tt = np.nonzero(live)
            grad[rr, tt, y[rr, tt]] -= 1
            flat, g = feats[live].ravel(), np.repeat(grad[live], matrix.shape[1], axis=0)
            step = np.stack([np.bincount(flat, g[:, c], DIM) for c in range(LABELS)], axis=1) / size + DECAY * w
            dt = np.zeros_like(trans)
            first = np.zeros(LABELS)
            first += prob[:, 0].sum(0)
            np.add.at(first, y[:, 0], -1)
            dt[0] += first
            for t in range(1, longest):
                on = live[:, t]
                if not on.any():
                    break
                pair = np.exp(alpha[on, t - 1, :, None] + tr + (em[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
                dt += pair.sum(0)
                np.add.at(dt, (y[on, t - 1], y[on, t]), -1)
            dt /= size
            gw += step**2
            gt += dt**2
            w -= RATE * step / np.sqrt(gw)
            trans -= RATE * dt / np.sqrt(gt)
    return w.astype(np.float32), (trans + mask).astype(np.float32)


def viterbi(em: np.ndarray, trans: np.ndarray, stretches: list[tuple[int, int]]) -> np.ndarray:
    """Best labels of every position; stretches of like length are decoded together, a very long one by itself."""
    best = np.zeros(len(em), np.int8)
    todo = sorted((s for s in stretches if s[1] > s[0]), key=lambda s: s[1] - s[0])
    i = 0
    while i < len(todo):
        j = i + 1
        while j < min(len(todo), i + 256) and (j + 1 - i) * (todo[j][1] - todo[j][0]) <= 256 * STRETCH:
            j += 1
        part, i = todo[i:j], j
        size, longest = len(part), part[-1][1] - part[-1][0]
        pos = np.zeros((size, longest), np.int64)
        length = np.array([b - a for a, b in part])
        for r, (a, b) in enumerate(part):
            pos[r, : b - a] = np.arange(a, b)
        score = em[pos[:, 0]] + trans[0]
        back = np.zeros((longest, size, LABELS), np.int8)
        # Every label may follow any, but an inside label only its own begin or inside.
        open_ = np.array([0, *range(1, LABELS, 2)])
        begins, insides = np.arange(1, LABELS, 2), np.arange(2, LABELS, 2)
        t_open, t_begin, t_inside = trans[:, open_], trans[begins, insides], trans[insides, insides]
        rows1 = np.arange(size)[:, None]
        cols = np.arange(len(open_))[None, :]
        for t in range(1, longest):
            cand = score[:, :, None] + t_open
            best_from = cand.argmax(1)
            a, b = score[:, begins] + t_begin, score[:, insides] + t_inside
            nxt = np.empty_like(score)
            nxt[:, open_] = cand[rows1, best_from, cols]
            nxt[:, insides] = np.maximum(a, b)
            back[t][:, open_] = best_from
            back[t][:, insides] = np.where(a > b, begins, insides)
            nxt += em[pos[:, t]]
            score = np.where((length > t)[:, None], nxt, score)
            if t % STRETCH == 0:  # else the sum outgrows the digits of a float
                score -= score.max(1, keepdims=True)
        label = score.argmax(1)
        rows = np.arange(size)
        for t in range(longest - 1, -1, -1):
            on = length > t
            best[pos[on, t]] = label[on]
            if t:
                label = np.where(on, back[t, rows, label], label)
    return best


_TITLE = re.compile(r"^(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Dipl|Ing)\.?\s+)+(?=[^\W\d_])")
_FRENCH = re.compile(r"\b(?:le|la|les|des|du|est|sont|ont|au|aux|une|sous|côté|chez|faute|avant|vérifie|mesuré|près)\b")
_NOT_NAME = re.compile(r"^(?:&.*|Mr|Mrs|Ms|Dr|Herr|Frau|Mme|M|Prof)\.?$|^[\W\d_]*$")
#: Words that open or close a sentence part and are no name by themselves: of closed classes, days, greetings.
_FUNCTION = frozenset(
    (
        "if when while once since unless because although after before until whenever it which what why how both please and there here then now also nobody somebody someone everybody everyone anybody nothing "
        "monday tuesday wednesday thursday friday saturday sunday thanks regards "
        "wenn falls weil seit nach laut mit für und danach dann hier dort bitte es wer wie warum montag dienstag mittwoch donnerstag freitag samstag sonntag gruß grüße danke bei "
        "si quand lorsque depuis après avant selon avec pour chez et puis ensuite ici chaque il jusqu lundi mardi mercredi jeudi vendredi samedi dimanche merci cordialement"
    ).split()
)
_ARTICLE = re.compile(r"(?:the|this|that|these|those|every|each|some|der|die|ein|eine|kein|keine|jede|jeder|diese|dieser|dieses|un|une|cette|ces)\b", re.I)
#: A letter after one of these is the sign of a place in a building, not an initial; a name does not end like a street.
_SIGN = re.compile(r"\b(?:grid|axis|zone|shaft|bay|row|block|core|room|level|achse|schacht|raum|axe|local)\s+$", re.I)
_STREET = re.compile(r"\s(?:Street|St|Road|Rd|Avenue|Ave)\.?$")
#: The number of a list entry; what follows the number of a measure.
_NUMBERED, _MEASURE = re.compile(r"\d{1,3}\.\s+(?=[\d(+])"), re.compile(r"\s?(?:mm|cm|m|km|kg|m²|m³|%|°)(?!\w)|[.,]\d+\s?(?:mm|cm|m)(?!\w)")
_EDGE = re.compile(r"[^\W\d_]+")
_MAIL = re.compile(r"(?<![\w.+@/-])[\w.+-]*\w@\w[\w-]*(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w@]|:\w)")


#: A form of address and what it stands before: initials, particles and capitalised words.
_TITLED = re.compile(
    r"(?<![\w.])(?:(?:Mr|Mrs|Ms|Miss|Herrn?|Frau|Mme|Mlle)\.?\s(?:(?:Prof|Dr)\.\s)*|(?:Prof\.\s)?Dr\.\s)"
    r"((?:[^\W\d_a-z]\.\s)?(?:(?:von|van|de|der|den|la|di|el|al)[ -])*[^\W\d_a-z](?:[^\W\d_]|['’-](?=[^\W\d_]))+(?:\s[^\W\d_a-z][^\W\d_]*[a-zß-ÿ](?![\w.]))?)"
)


def _name_core(s: str) -> tuple[int, int]:
    """Start and end within ``s`` without function words and signs on either side."""
    words = [m.span() for m in _EDGE.finditer(s)]
    while words and s[slice(*words[0])].lower() in _FUNCTION:
        del words[0]
    cut = len(words)
    while cut and s[slice(*words[cut - 1])].lower() in _FUNCTION:
        cut -= 1
    if not cut:
        return 0, 0
    return words[0][0], len(s) if cut == len(words) else words[cut - 1][1]


def _with_mails(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans with every plain email address as a whole: its form decides, so parts of it go."""
    mails = [m.span() for m in _MAIL.finditer(text)] if "@" in text else []
    if not mails:
        return spans
    out, k = [(a, b, "email") for a, b in mails], 0
    for a, b, kind in sorted(spans):
        while k < len(mails) and mails[k][1] <= a:
            k += 1
        if k == len(mails) or b <= mails[k][0]:
            out.append((a, b, kind))
    return sorted(out)


def _checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span trimmed to its form, or None if it has not that form."""
    while a < b and text[a] in " \n\t,;:<>\"'|=*-–•" + ("" if kind == "phone" else "()[]"):
        a += 1
    while b > a and text[b - 1] in " \n\t,;:<>\"'|=([*":
        b -= 1
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        if s.lower().startswith("mailto:"):
            a, s = a + 7, s[7:]
        if re.search(r"@\s*[\d.]*$", s):
            return None
        return (a, b) if re.search(r"@|[\[( ]\s*at\s*[\]) ]", s, re.I) and re.search(r"\w.*\w", s) else None
    if kind == "phone":
        m = _NUMBERED.match(s)
        if m and (a == 0 or text[a - 1] == "\n"):
            a, s, digits = a + m.end(), s[m.end() :], digits - sum(c.isdigit() for c in m.group())
        return (a, b) if 7 <= digits <= 17 and (s[0] in "+(" or s[0].isdigit()) else None
    if kind == "id_number":
        return (a, b) if digits >= 5 else None
    if kind == "address":
        return (a, b) if digits and not _MEASURE.match(text, b) else None
    m = _TITLE.match(s)
    if m and m.end() < len(s):
        a, s = a + m.end(), s[m.end() :]
    if _ARTICLE.match(s) or _STREET.search(s):
        return None
    first, last = _name_core(s)
    a, s = a + first, s[first:last]
    b = a + len(s)
    begin = a if s.startswith("M. ") else a - 3
    if text[max(0, begin) : begin + 3] == "M. " and not text[max(0, begin - 1) : begin].isalnum():
        french = len(_FRENCH.findall(text, max(0, begin - 117), begin + 123)) >= 2
        a = begin + 3 if french else begin  # an initial: only French addresses people so
        s = text[a:b]
    if s[1:3] == ". " and _SIGN.search(text, max(0, a - 12), a):
        return None
    return None if _NOT_NAME.match(s) or len(s) < 2 or digits > 1 or re.match(r"[^\W\d_]\.?$", s) or re.search(r"\bIfc[A-Z]", s) else (a, b)


def _with_titled(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans and the names after a form of address that none of them touches."""
    out, k, spans = list(spans), 0, sorted(spans)
    for m in _TITLED.finditer(text):
        a, b = m.span(1)
        if m.group().startswith("Dr") and re.search(r"[^\W\d_a-z][^\W\d_]* $", text[max(0, m.start() - 12) : m.start()]):
            continue  # a street, perhaps
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k == len(spans) or b <= spans[k][0]:
            out.append((a, b, "name"))
    return sorted(out)


class Tagger:
    """Finds spans in batches of texts."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans
        self._reset()

    def _reset(self) -> None:
        self.types, self.known = _Types(), 0
        self.table = np.zeros((9, 0, LABELS), np.float32)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text, 0-based."""
        out: list[list[tuple[int, int, str]]] = []
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) < 2_000_000):
                chars += len(texts[j])
                j += 1
            out.extend(self._spans(texts[i:j]))
            i = j
        return out

    def _spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if len(self.types.rows) > 100_000:
            self._reset()
        ids, glued, bounds, starts = _flatten(texts, self.types)
        types = np.array(self.types.rows, np.uint32)
        new = types[self.known :]
        if len(new):  # the one-token features of a token are added up once
            table = np.zeros((9, len(new), LABELS), np.float32)
            for o, f in _single_features(new):
                table[4 + o] += self.weights[f]
            self.table = np.concatenate([self.table, table], axis=1)
            self.known = len(types)
        em = np.zeros((len(ids), LABELS), np.float32)
        for a in range(0, len(ids), TOGETHER):  # features look four tokens to either side
            lo, hi = max(0, a - 8), min(len(ids), a + TOGETHER + 8)
            part = ids[lo:hi]
            padded = np.concatenate([np.zeros(4, np.int64), part, np.zeros(4, np.int64)])
            block = self.table[4][part]
            for o in (-4, -3, -2, -1, 1, 2, 3, 4):
                block += self.table[4 + o][padded[4 + o : 4 + o + len(part)]]
            for f in _joint_features(part, glued[lo:hi], types):
                block += self.weights[f]
            b = min(len(ids), a + TOGETHER)
            em[a:b] = block[a - lo : b - lo]
        labels = viterbi(em, self.trans, bounds)
        result = []
        for text, (a, b), begin in zip(texts, bounds, starts):
            found, k = [], a
            hot = np.flatnonzero(labels[a:b]) + a
            for k in hot:
                lab = labels[k]
                kind = (lab - 1) // 2
                if lab % 2 == 1 or not found or found[-1][3] != k or found[-1][2] != kind:
                    found.append([k, k, kind, k + 1])
                else:
                    found[-1][3] = k + 1
            spans = []
            for first, _, kind, end in found:
                s = begin[first - a]
                e = begin[end - 1 - a] + len(_TOKEN.match(text, begin[end - 1 - a]).group())
                ok = _checked(text, s, e, KINDS[kind])
                if ok:
                    spans.append((*ok, KINDS[kind]))
            result.append(_with_titled(text, _with_mails(text, spans)))
        return result


def _tagger(df: DataFrame):
    model = df.sparkSession.sparkContext.broadcast(train())
    return lambda: Tagger(*model.value)


def find(documents: DataFrame) -> DataFrame:
    """doc_id, kind, start_pos, end_pos (exclusive), found: one row per occurrence."""
    make = _tagger(documents)

    def run(batches):
        tagger = make()
        for pdf in batches:
            rows = []
            for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], tagger.spans(list(pdf["text"]))):
                rows.extend((doc_id, kind, a + 1, b + 1, text[a:b]) for a, b, kind in spans)
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos", "found"])

    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    return docs.mapInPandas(run, "doc_id long, kind string, start_pos long, end_pos long, found string")


def redact(documents: DataFrame) -> DataFrame:
    """doc_id, text with typed placeholders, n_replaced; every document, in its place."""
    make = _tagger(documents)

    def run(batches):
        tagger = make()
        for pdf in batches:
            texts, counts = [], []
            for text, spans in zip(pdf["text"], tagger.spans([t or "" for t in pdf["text"]])):
                parts, at = [], 0
                for a, b, kind in sorted(spans):
                    if a >= at:
                        parts += [text[at:a], PLACEHOLDER[kind]]
                        at = b
                texts.append(None if text is None else "".join(parts) + text[at:])
                counts.append(len(spans))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "n_replaced": pd.Series(counts, dtype="int32")})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, text string, n_replaced int")
