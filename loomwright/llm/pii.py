"""Personal data: candidate spans, boosted trees that score them, and calibrated thresholds.

Base spans come from four strict patterns with their checks (CHECKS) and always stay. They miss what is disguised
("name [at] host dot org", "10[.]1[.]2[.]3") or what a number beside it has spoilt (two card numbers in a row are one
run of 32 digits). Generators of high recall propose overlapping spans for these: every run of neighbouring groups of
digits that could be an address, a card or a telephone number, and every local part before something like "at" with
each domain after it. Boosted trees, one model for each kind, score a candidate by its format (digits, groups,
separators, check sums, disguises) and its context (characters and numbers beside it, words before it). Of those over
their kind's threshold the best of each overlapping group is taken, unless it overlaps a base span.

There are no labels, so the models learn from the corpus itself: base spans with their surroundings are drawn from all
documents (at most `spans_a_kind` of each kind, shorter than LONGEST, by the smallest hash), each is disguised or spoilt in several ways in
place, and the candidates of the new text are labelled by whether they are the whole span; spans broken on purpose (a
wrong check digit, a part over 255, a missing domain) and other numbers in their place have no right candidate. Scores
are calibrated on a third of the surroundings held out, and the threshold is the lowest probability there from which on
at least PRECISION of the candidates are right.

Each document is scanned in time linear in its length (runs are read with possessive patterns), without a shuffle; only
the bounded sample and the models leave the tasks.

Defined results: null or empty text has no spans; texts of any length are scanned whole; positions are code points, ends
exclusive; base spans of different kinds may overlap, added ones overlap nothing; equal texts have equal spans; a kind
without base spans in the corpus gets none added; rows are neither merged nor dropped; a null id stays null; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import trees
from loomwright.llm.bpe import chunks
from loomwright.llm.common import arrow_batched, beside, only, stored, table, texts_of

KINDS = ["email", "ip", "card", "phone"]
#: Base spans of each kind that the models learn from, characters around them, the share of right spans asked for, and
#: the length from which a base span teaches nothing of others.
SPANS_A_KIND, AROUND, PRECISION, LONGEST = 400, 48, 0.98, 200
#: Surroundings in one of so many are held out.
HELD_OUT = 3

#: (kind, start, end)
Span = tuple[str, int, int]

#: Words that announce a kind, in the languages of the corpus.
ANNOUNCE = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "ruf", "llam", "appel"),
}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CHAIN = re.compile(r"[0-9]++(?:[^0-9A-Za-z\n]{1,3}+[0-9]++)*+")
_AT = re.compile(r"[\s\[({<]at[\s\])}>]", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_DOT = re.compile(r"\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s(?:dot|\.)\s", re.I)
_FILLERS = str.maketrans("", "", " ().-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """A part of an address: at most 255."""
    kept = part.lstrip("0")
    return len(kept) < 4 and int(kept or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    begin, p = 0, text.find("@")
    while p >= 0:
        before = text[begin:p]
        start = begin + len(before.rstrip(LOCAL))
        begin = p + 1
        if start < p and (m := _DOMAIN.match(text, p + 1)):
            yield start, m.end()
            begin = m.end()
        p = text.find("@", begin)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m[0].count(".") > 2:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(map(small, four)):
                    yield at, at + size
                at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15 and 16 <= len(d := m[0].translate(_FILLERS)) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(m[0].translate(_FILLERS)) - 1 <= 15:
            yield m.span()


CHECKS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> list[Span]:
    return [(kind, *s) for kind in KINDS for s in CHECKS[kind](text)]


def _class(c: str) -> int:
    """Kind of a character: 0 for none."""
    if not c:
        return 0
    if c.isspace():
        return 1
    if c.isalpha():
        return 2
    if c.isdigit():
        return 3
    return 4 if c in ".,;:!?" else 5 if c in "()[]{}<>\"'" else 6 if c == "+" else 7 if c == "@" else 8


def _context(text: str, start: int, end: int) -> list[float]:
    before = text[max(0, start - 24) : start].lower()
    said = [float(any(w in before for w in ANNOUNCE[k])) for k in KINDS]
    return [_class(text[start - 1 : start]), _class(text[end : end + 1]), _class(text[start - 2 : start - 1] if start > 1 else ""), _class(text[end + 1 : end + 2]), *said]


def _number_features(text: str, start: int, end: int, groups: list[tuple[int, int]], i: int, j: int) -> list[float]:
    """Format and context of the groups i to j - 1 of a chain."""
    own = groups[i:j]
    sizes = [b - a for a, b in own]
    digits = "".join(text[a:b] for a, b in own)
    gaps = [text[a:b] for (_, a), (b, _) in zip(own[:-1], own[1:], strict=True)]
    between = "".join(gaps)
    left = text[groups[i - 1][1] : start] if i else ""
    right = text[end : groups[j][0]] if j < len(groups) else ""
    return [
        len(digits), len(own), sizes[0], sizes[-1], max(sizes), min(sizes), luhn(digits), all(small(text[a:b]) for a, b in own),
        text[start] == "+", text[start] == "(", digits.startswith("00"), len(set(gaps)), max(map(len, gaps), default=0),
        between.count("."), between.count("-"), between.count(" "), sum(c in "()[]" for c in between), sum(c not in ".- ()[]" for c in between),
        text[start:end].count("(") == text[start:end].count(")"), i, len(groups) - j, groups[i - 1][1] - groups[i - 1][0] if i else 0,
        groups[j][1] - groups[j][0] if j < len(groups) else 0, len(left), len(right), int(digits[0]), int(digits[:4] or 0) in range(1900, 2100), *_context(text, start, end),
    ]


def _numbers(text: str) -> Iterator[tuple[Span, list[float]]]:
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())]
        dotted = [text[a:b].strip(" []()") == "." for (_, a), (b, _) in zip(groups[:-1], groups[1:], strict=True)]
        for i, (start, _) in enumerate(groups):
            n, lead = 0, start - (text[start - 1 : start] in ("+", "(") and start > 0)
            for j in range(i + 1, len(groups) + 1):
                end = groups[j - 1][1]
                n += end - groups[j - 1][0]
                if n > 19:
                    break
                kinds = [("ip", start)] if j - i == 4 and n <= 12 and all(dotted[i : j - 1]) else []
                kinds += [("card", start)] if n >= 13 else []
                kinds += [("phone", lead)] if 7 <= n <= 15 and j - i <= 7 else []
                for kind, at in kinds:
                    yield (kind, at, end), _number_features(text, at, end, groups, i, j)


def _email_places(text: str) -> Iterator[tuple[int, int, int]]:
    """Start, end and disguise of everything that may stand for an at sign."""
    for m in _AT.finditer(text):
        a, b = m.span()
        bracket = not (text[a].isspace() and text[b - 1].isspace())
        yield a - (bracket and text[a - 1 : a].isspace()), b + (bracket and text[b : b + 1].isspace()), 2 if bracket else 3
    p = text.find("@")
    while p >= 0:
        a, b = p, p + 1
        bracket = text[a - 1 : a] in "[({<" and text[b : b + 1] in "])}>" and 0 < a and b < len(text)
        a, b = (a - 1, b + 1) if bracket else (a, b)
        yield a - (text[a - 1 : a].isspace()), b + (text[b : b + 1].isspace()), 1 if bracket or text[a - 1 : a].isspace() else 0
        p = text.find("@", p + 1)


def _mails(text: str) -> Iterator[tuple[Span, list[float]]]:
    for a, b, disguise in _email_places(text):
        near = text[max(0, a - 64) : a]
        start = a - len(near) + len(near.rstrip(LOCAL))
        if start == a or not (m := _LABEL.match(text, b)):
            continue
        local, at, labels, hidden, plain = text[start:a], m.end(), [m[0]], 0, 0
        while len(labels) < 6 and (dot := _DOT.match(text, at)) and (m := _LABEL.match(text, dot.end())):
            hidden, plain = hidden + (len(dot[0]) > 1), plain + (len(dot[0]) == 1)
            at = m.end()
            labels.append(m[0])
            more = _DOT.match(text, at)
            yield ("email", start, at), [
                disguise, hidden, plain, len(labels), len(local), sum(c.isdigit() for c in local), sum(c in "._%+-" for c in local), local.isalpha(), len(m[0]), m[0].isalpha(),
                m[0].islower(), sum(map(len, labels)), sum(c.isdigit() for x in labels for c in x), bool(more and _LABEL.match(text, more.end())), local[0] in "._%+-", *_context(text, start, at),
            ]


def candidates(text: str, taken: list[Span]) -> list[tuple[Span, list[float]]]:
    """Proposed spans, which may overlap each other but none of those taken, with their features."""
    found = [*_mails(text), *_numbers(text)]
    if not found or not taken:
        return found
    ends = sorted((a, b) for _, a, b in taken)
    starts = np.array([a for a, _ in ends])
    reach = np.maximum.accumulate(np.array([b for _, b in ends]))  # the furthest end of those that start so far
    before = np.searchsorted(starts, np.array([s[2] for s, _ in found]))  # those that start before the end
    return [f for f, k in zip(found, before.tolist(), strict=True) if not k or reach[k - 1] <= f[0][1]]


@dataclass
class Detector:
    models: dict[str, tuple[trees.Boosted, float, float, float]]  #: with the slope, shift and threshold of a kind

    def probability(self, kind: str, x: np.ndarray) -> np.ndarray:
        model, slope, shift, _ = self.models[kind]
        return 1 / (1 + np.exp(-np.clip(slope * model.log_odds(x) + shift, -30, 30)))

    def added(self, found: list[list[tuple[Span, list[float]]]]) -> list[list[Span]]:
        """For each text the spans to add: the most probable of each overlapping group that passes its threshold."""
        passed: list[list[tuple[float, int, int, str]]] = [[] for _ in found]
        for kind, (_, _, _, cut) in self.models.items():
            own = [(t, s, x) for t, f in enumerate(found) for s, x in f if s[0] == kind]
            if own and cut <= 1:
                p = self.probability(kind, np.array([x for _, _, x in own], float))
                for k in np.flatnonzero(p >= cut).tolist():
                    t, (_, a, b), _ = own[k]
                    passed[t].append((-float(p[k]), a - b, a, kind))
        return [self._apart(rows) for rows in passed]

    @staticmethod
    def _apart(rows: list[tuple[float, int, int, str]]) -> list[Span]:
        taken: set[int] = set()
        out = []
        for _, minus, a, kind in sorted(rows):
            here = range(a, a - minus)
            if taken.isdisjoint(here):
                taken.update(here)
                out.append((kind, a, a - minus))
        return out

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base and added spans of each text."""
        base = [base_spans(t) for t in texts]
        added = self.added([candidates(t, b) for t, b in zip(texts, base, strict=True)])
        return list(zip(base, added, strict=True))


def _disguised(kind: str, s: str, rnd: random.Random) -> Iterator[tuple[str, str, str, bool]]:
    """What to put for a base span: text before it, the span, text after it, and whether it is personal data."""
    pick = rnd.choice
    digit = lambda: pick("0123456789")
    if kind == "email":
        local, _, domain = s.partition("@")
        at = [" at ", " [at] ", "[at]", "(at)", " (at) ", " @ ", " AT ", " {at} ", " <at> "]
        dots = [" dot ", " [dot] ", "[dot]", "(dot)", " (dot) ", " . ", ".", "[.]", " DOT "]
        for _ in range(7):
            a, d = pick(at), pick(dots)
            yield "", local + a + domain.replace(".", d), "", True
        yield "", local + "@" + domain.replace(".", pick(dots[:6])), "", True
        yield "", local.strip("._%+-") + " at " + domain.split(".")[0], "", False
        yield "", "".join(pick("aeinorst") for _ in range(5)) + pick([" at ", " @ "]) + "the" + pick([".", ". "]) + "Then", "", False
        yield "", local + pick([" at ", " @ "]) + f"{digit()}.{digit()}", "", False
        yield "", local + "@" + domain.split(".")[0], "", False
    elif kind == "ip":
        parts = s.split(".")
        for sep in ("[.]", " . ", "(.)", pick(["[.]", " . ", "(.)"])):
            yield "", sep.join(parts), "", True
        yield "", "[.]".join(parts), pick([" 80", " 2024", ", 10"]), True
        over = list(parts)
        over[rnd.randrange(4)] = str(rnd.randint(256, 999))
        for sep in (".", "[.]", " . "):
            yield "", sep.join(over), "", False
        yield "", ".".join([*over, digit()]), "", False
        yield "", ".".join(f"{rnd.randint(256, 400)}" for _ in range(2)) + "." + ".".join(parts), "." + digit(), False
        yield "", " . ".join(parts[:3]), "", False
    elif kind == "card":
        d = s.translate(_FILLERS)
        short = "".join(digit() for _ in range(pick([13, 14])))
        short += next(c for c in "0123456789" if luhn(short + c))
        fours = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, len(x), 4))
        other = d[4:8] + d[:4] + d[8:]
        for sep in (".", "/", "_", "  ", " ", " - "):
            yield "", fours(d, sep), "", True
        yield "", pick([short, f"{short[:4]} {short[4:10]} {short[10:]}", f"{short[:4]}-{short[4:10]}-{short[10:]}"]), "", True
        yield "", d, pick([" ", "-"]) + other, True
        yield pick([f"{digit()} ", f"{digit()}{digit()}-", "2024 "]), d, "", True
        yield "", pick([d, fours(d, " ")]), pick([f" {digit()}{digit()}{digit()}", f" {digit()}", " 2024", " 12/27"]), True
        wrong = d[:-1] + str((int(d[-1]) + rnd.randint(1, 9)) % 10)
        for x in (wrong, fours(wrong, " "), fours(wrong, "."), wrong + " " + wrong, f"{wrong[:5]} {wrong[5:]}"):
            yield "", x, "", False
        yield "", pick("abcdef") + d, "", False
        yield "", d + pick("abcdef"), "", False
        yield "", "".join(digit() for _ in range(4)) + d + "".join(digit() for _ in range(4)), "", False
    else:
        d = s.translate(_FILLERS)[1:]
        n = d[-10:].rjust(10, "5")
        for x in (f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", f"00{d[:-10] or 1} {n[:3]} {n[3:6]} {n[6:]}", f"+{d[:-10] or 1}/{n[:3]}/{n[3:6]}/{n[6:]}", f"({n[:3]}) {n[3:6]} {n[6:]}"):
            yield "", x, "", True
        yield "", s, pick([" 190.137.223.204", " 4111111111111111", " 2024 2025", "  1234567"]), True
        yield "", s, " " + ".".join(str(rnd.randint(1, 255)) for _ in range(4)), True
        day = f"{rnd.randint(1, 28):02}", f"{rnd.randint(1, 12):02}", str(rnd.randint(1950, 2030))
        for x in ("-".join(day[::-1]), "-".join(day[::-1]) + f" {rnd.randint(10, 23)}:{rnd.randint(10, 59)}:{rnd.randint(10, 59)}", ".".join(day), "/".join(day), f"{n[0]},{n[1:4]},{n[4:7]}", n, f"{n[:5]} {n[5:]}", f"{n[:2]}.{n[2:4]}.{n[4:]}", f"978-3-{n[:2]}-{n[2:8]}-{n[8]}", f"{n[:4]} {n[4:8]}", f"{n[:3]}-{n[3:7]}", "-".join(n), f"{rnd.randint(1000, 1999)}-{rnd.randint(2000, 2030)}"):
            yield "", x, "", False
        yield "", pick("abcdef") + f"{n[:3]}-{n[3:6]}-{n[6:]}", "", False


def training_rows(kind: str, before: str, span: str, after: str) -> Iterator[tuple[list[float], int]]:
    """Features and labels of the candidates in the surroundings of a base span, for each of its disguises."""
    rnd = random.Random(zlib.crc32(f"{kind}\n{before}\n{span}\n{after}".encode("utf-8", "surrogatepass")))
    for lead, s, tail, right in _disguised(kind, span, rnd):
        text = before + lead + s + tail + after
        a = len(before) + len(lead)
        for (k, lo, hi), x in candidates(text, base_spans(text)):
            if k == kind and lo < a + len(s) + len(tail) and hi > a - len(lead):
                inside = not (lo >= a + len(s) or hi <= a)  # what is put beside the span has no label
                if inside or not right:
                    yield x, int(right and (lo, hi) == (a, a + len(s)))


def sample(docs: DataFrame, spans_a_kind: int = SPANS_A_KIND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kind, before, span, after of different base spans with their surroundings, the smallest hashes of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[str, dict[bytes, tuple[str, str, str]]] = {k: {} for k in KINDS}
        most = {k: b"\xff" * 9 for k in KINDS}
        for b in batches:
            for text in texts_of(b, text_col):
                for kind, s, e in base_spans(text):
                    row = text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND]
                    key = hashlib.blake2b("\n".join(row).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    if key < most[kind] and e - s < LONGEST:
                        low[kind][key] = row
                        if len(low[kind]) >= 2 * spans_a_kind:
                            kept = sorted(low[kind])[:spans_a_kind]
                            low[kind], most[kind] = {k: low[kind][k] for k in kept}, kept[-1]
        rows = [(kind, key.hex(), *low[kind][key]) for kind in KINDS for key in sorted(low[kind])[:spans_a_kind]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["kind", "key", "before", "span", "after"])

    src = only(docs, [text_col])
    each = stored(arrow_batched(src, run, "kind string, key string, before string, span string, after string"), "spans").distinct()
    parts = [each.where(F.col("kind") == k).orderBy("key", "before", "span").limit(spans_a_kind) for k in KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return stored(out, "sample")


def fit_kind(kind: str, rows: pd.DataFrame) -> tuple[trees.Boosted, float, float, float]:
    """The model of a kind with its calibration and threshold; above 1 if it can't reach PRECISION."""
    x, y, held = [], [], []
    for r in rows.sort_values(["key", "before", "span"]).itertuples():
        made = list(training_rows(kind, r.before, r.span, r.after))
        x += [m[0] for m in made]
        y += [m[1] for m in made]
        held += [int(r.key, 16) % HELD_OUT == 0] * len(made)
    x, y, held = np.array(x, float), np.array(y, float), np.array(held, bool)
    if len(y) == 0 or not 0 < y[~held].sum() < (~held).sum() or not 0 < y[held].sum() < held.sum():
        return trees.fit(np.zeros((1, 1)), np.zeros(1), 0), 1.0, 0.0, 2.0
    model = trees.fit(x[~held], y[~held])
    s = model.log_odds(x[held])
    slope, shift = trees.calibration(s, y[held])
    p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -30, 30)))
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True)  # equal scores pass together
    good = np.flatnonzero((right >= PRECISION) & last)
    cut = float(p[order][good[-1]]) if len(good) else 2.0
    return model, slope, shift, max(cut, 0.5)


def train(docs: DataFrame, spans_a_kind: int = SPANS_A_KIND, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """A detector from the base spans of all documents; each kind is fitted by a task."""

    def run(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        model, slope, shift, cut = fit_kind(key[0], rows)
        parts = [model.feature.astype(np.int64), model.cut.astype(float), model.leaf.astype(float)]
        return pd.DataFrame([(key[0], model.bias, slope, shift, cut, len(model.feature), *[a.tobytes() for a in parts])])

    schema = "kind string, bias double, slope double, shift double, cut double, rounds int, feature binary, cuts binary, leaf binary"
    found = sample(docs, spans_a_kind, id_col, text_col).groupBy("kind").applyInPandas(run, schema).collect()  # a row for each kind
    models = {}
    for r in sorted(found, key=lambda r: KINDS.index(r["kind"])):
        feature, cuts, leaf = (np.frombuffer(bytes(r[c]), d).reshape(r["rounds"], -1) if r["rounds"] else np.zeros((0, 1)) for c, d in (("feature", np.int64), ("cuts", float), ("leaf", float)))
        models[r["kind"]] = trees.Boosted(r["bias"], feature, cuts, leaf), r["slope"], r["shift"], r["cut"]
    return Detector(models)


def detect(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id; base and added: arrays of (kind, start, end), by kind and start."""
    sent = docs.sparkSession.sparkContext.broadcast(detector)
    order = lambda spans: sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts = texts_of(b, text_col)
            for i, j in chunks(texts):
                found = sent.value.spans(texts[i:j])
                made = {name: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in order(f[k])] for f in found], span) for k, name in enumerate(("base", "added"))}
                yield beside(b.column(id_col).slice(i, j - i), made, id_col)

    src = only(docs, [id_col, text_col])
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return arrow_batched(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, base {spans}, added {spans}")


def redact(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, and text with [EMAIL], [IP], [CARD] or [PHONE] for each span; of overlapping ones the first names all."""
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b, text_col)
            for i, j in chunks(texts):
                out = []
                for text, (base, added) in zip(texts[i:j], sent.value.spans(texts[i:j]), strict=True):
                    parts, at = [], 0
                    for kind, s, e in sorted([*base, *added], key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            parts += [text[at:s], f"[{kind.upper()}]"]
                        at = max(at, e)
                    out.append("".join([*parts, text[at:]]))
                yield beside(b.column(id_col).slice(i, j - i), {"text": pa.array(out, pa.string())}, id_col)

    src = only(docs, [id_col, text_col])
    return arrow_batched(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text string")


def op13_boosted_candidate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, train(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "added"), rank))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
