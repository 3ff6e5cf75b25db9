"""Personal data: certain spans by fixed formats, and further ones chosen from overlapping candidates by boosted trees.

Generators with a high recall propose spans: every window of a few digit groups of a run of numbers, and every place
that may be read as an address, with its marker spelt out or not. Trees, one set a kind, score a candidate by its
format and by its context. There are no labels of personal data, so the trees learn from the fixed formats: spans of the
base rules are positive, and so are copies of them written in another way in their own context (another separator, no
country code, ``at`` and ``dot``); candidates that cut across a base span or fail the kind's check, and copies that are
damaged, are negative; candidates that pass the check without being base spans are left out. On a fold that the trees
didn't see their probabilities are calibrated, and the least threshold is taken whose precision is certain enough there.
What passes it and overlaps neither a base span nor a better candidate is added.

The base rules run in linear time on any text; they give what the leftmost matches of their regular expressions give.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosted_trees
from .common import arrow_map, table_chunks

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: The trees are fitted on at most so many documents (those with the smallest hashes), and so many candidates of each.
SAMPLE_DOCS, SAMPLE_CANDIDATES = 20_000, 64
#: Precision that a threshold has to reach, with 95 % certainty, on the documents held out from fitting.
PRECISION = 0.95
#: Digit groups of a window, characters around a span that are looked at, candidates that are scored at once.
GROUPS, CONTEXT, AT_ONCE = 6, 32, 4096
#: Longest local part and domain that are proposed.
LONGEST_LOCAL, LONGEST_DOMAIN = 64, 255

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_number = re.compile(r"[0-9]++")
_run = re.compile(r"[0-9](?:[\x20().\[\]/-]{0,3}[0-9])*+")
_marker = re.compile(r"@|\x20at\x20|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?", re.IGNORECASE)
_spelt = re.compile(r"[\w-]++(?:(?:\.|\x20dot\x20|\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?)[\w-]++)++", re.IGNORECASE)
_dot = re.compile(r"\.|\x20dot\x20|\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?", re.IGNORECASE)
_letters = re.compile(r"[^\W\d_]")
_word = re.compile(r"[^\W\d_]+")
#: Words that announce a kind.
_announced = (
    re.compile(r"e-?mail|contact|write|address|courriel|correo", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|address|router", re.IGNORECASE),
    re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.IGNORECASE),
    re.compile(r"phone|call|\btel|mobile|fax|telefon|tél", re.IGNORECASE),
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x if x < 10 else x - 9 for x in (2 * int(d) for d in digits[-2::-2]))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_number.findall(s))


def passes(kind: int, s: str) -> bool:
    """The check of a kind beyond its pattern."""
    if kind == IP:
        return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in _number.findall(s))
    n = len(_digits(s))
    return kind == EMAIL or (14 <= n <= 19 and luhn(_digits(s)) if kind == CARD else 10 <= n <= 15)


def base_spans(text: str) -> list[Span]:
    """The certain spans, by start, then kind."""
    found: list[Span] = []
    done = 0  # the local part of the next address starts behind the last match
    for m in re.finditer("@", text):
        before = text[done : m.start()]
        start = m.start() - (len(before) - len(before.rstrip(_LOCAL)))
        d = _domain.match(text, m.end()) if start < m.start() else None
        done = d.end() if d else m.end()
        if d:
            found.append((EMAIL, start, d.end()))
    for m in _dotted.finditer(text):
        parts = [(x.start(), x.end()) for x in _number.finditer(text, m.start(), m.end())]
        found += [(IP, parts[k][0], parts[k + 3][1]) for k in range(0, len(parts) - 3, 4) if passes(IP, text[parts[k][0] : parts[k + 3][1]])]
    for kind, pattern in ((CARD, _card), (PHONE, _phone)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be personal data; they overlap, and a base span needn't be one of them."""
    for m in _marker.finditer(text):
        before = text[max(0, m.start() - LONGEST_LOCAL - 1) : m.start()]
        n = 0
        while n < len(before) and (before[-1 - n].isalnum() or before[-1 - n] in "._%+-"):
            n += 1
        d = _spelt.match(text, m.end(), m.end() + LONGEST_DOMAIN)
        if d and 0 < n <= LONGEST_LOCAL:
            yield EMAIL, m.start() - n, d.end()
    for run in _run.finditer(text):
        if run.end() - run.start() < 7:
            continue
        held: list[tuple[int, int]] = []
        for m in _number.finditer(text, run.start(), run.end()):
            held = [*held[1 - GROUPS :], (m.start(), m.end())]
            n = 0
            for k in range(len(held) - 1, -1, -1):  # windows that end with this group
                start, end = held[k][0], m.end()
                n += held[k][1] - start
                if n > 19:
                    break
                if len(held) - k == 4 and n <= 12 and max(b - a for a, b in held[k:]) <= 3:
                    yield IP, start, end
                if n >= 13:
                    yield CARD, start, end
                if 7 <= n <= 15:
                    opened = start - (text[start - 1 : start] == "(")
                    yield PHONE, opened - (text[opened - 1 : opened] == "+"), end


FEATURES = (
    "digits", "groups", "shortest", "longest", "first", "last", "plus", "parens", "dashes", "dots", "spaces", "others", "one_separator", "luhn", "bytes", "distinct", "lead",
    "before", "after", "gap_before", "gap_after", "letters_around", "announced", "local", "labels", "top", "top_letters", "local_digit", "marker", "spelt_dot",
)


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ".,;:!?" else 4


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    s, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    gap_left = next((k for k, c in enumerate(reversed(left)) if "0" <= c <= "9"), CONTEXT)
    gap_right = next((k for k, c in enumerate(right) if "0" <= c <= "9"), CONTEXT)
    context = [_class(left[-1:]), _class(right[:1]), min(gap_left, 8), min(gap_right, 8), len(_letters.findall(left + right)), bool(_announced[kind].search(left))]
    if kind == EMAIL:
        m = _marker.search(s)
        local, domain = s[: m.start()], s[m.end() :]
        labels = _dot.split(domain)
        spelt = [x for x in _dot.findall(domain) if x != "."]
        return [0.0] * 17 + [float(x) for x in (*context, len(local), len(labels), len(labels[-1]), labels[-1].isalpha(), any(c.isdigit() for c in local), 0 if m[0] == "@" else 1 if m[0].lower() == " at " else 2, len(spelt) / (len(labels) - 1))]
    groups = _number.findall(s)
    size, digits = [len(g) for g in groups], "".join(groups)
    between = _number.split(s)[1:-1]
    others = len(s) - len(digits) - sum(s.count(c) for c in "+()-. ")
    shape = [len(digits), len(size), min(size), max(size), size[0], size[-1], s[0] == "+", "(" in s, s.count("-"), s.count("."), s.count(" "), others, len(set(between)) < 2, luhn(digits), len(size) == 4 and all(int(g) <= 255 for g in groups if len(g) < 4) and max(size) < 4, len(set(digits)), int(digits[0])]
    return [float(x) for x in (*shape, *context)] + [0.0] * 7


def _rewritten(kind: int, s: str, pick: int) -> str:
    """A base span in another way of writing."""
    groups = _number.findall(s)
    if kind == EMAIL:
        local, domain = s.rsplit("@", 1)
        at, dot = ((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", "."))[pick % 4]
        return local + at + domain.replace(".", dot)
    if kind == IP:
        return ("[.]", "(.)", "[.]", " . ")[pick % 4].join(groups)
    if kind == CARD:
        d = "".join(groups)
        return ("/", ".", "-", " ")[pick % 4].join(d[k : k + 4] for k in range(0, len(d), 4))
    rest = groups[1:] if len(groups) > 2 else groups
    return (f"({rest[0]}) " + "-".join(rest[1:]) if len(rest) > 1 else rest[0], "-".join(rest), ".".join(rest), " ".join(rest))[pick % 4]


def _damaged(kind: int, s: str, pick: int, left: str) -> str:
    """A base span that no longer is one: a word of the text before the domain, a digit off, a part too large, a number too short."""
    if kind == EMAIL:
        words = _word.findall(left) or ["look"]
        domain = s.rsplit("@", 1)[1].split(".")
        return f"{words[-1]} at {'.'.join(domain if pick % 2 else (domain[0], words[0]))}"
    at = [m.start() for m in _number.finditer(s)]
    if kind == CARD:
        k = at[0]
        return s[:k] + str((int(s[k]) + 1 + pick % 8) % 10) + s[k + 1 :]
    if kind == IP:
        return s[: at[pick % 4]] + str(300 + pick % 600) + "." + s[at[pick % 4] :].partition(".")[2] if pick % 4 < 3 else s[: at[3]] + str(300 + pick % 600)
    groups = _number.findall(s)
    return "".join(groups[:-1]) if len(groups) > 2 else s[1:7]


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """``kind, label, features`` to learn from, of one text."""
    base = base_spans(text)
    spans = {*base}
    for span in base:
        kind, start, end = span
        yield kind, 1, features(text, span)
        left, right, pick = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT], zlib.crc32(text[start:end].encode())
        for label, written in ((1, _rewritten(kind, text[start:end], pick)), (0, _damaged(kind, text[start:end], pick, left))):
            near = left + written + right
            inside = (len(left), len(left) + len(written))
            for c in candidates(near):
                whole = c[0] == kind and c[1:] == inside
                if whole or (label == 0 and c[0] == kind and c[1] < inside[1] and c[2] > inside[0] and not passes_wholly(near, c)):
                    yield kind, label, features(near, c)
    starts = [s for _, s, _ in base]
    for c in candidates(text):
        k = bisect_left(starts, c[2])
        cuts = any(s < c[2] and e > c[1] for _, s, e in base[max(0, k - 8) : k])
        if c not in spans and (cuts or not passes_wholly(text, c)):
            yield c[0], 0, features(text, c)


def passes_wholly(text: str, span: Span) -> bool:
    """True if a candidate passes its kind's check, so that not being a base span isn't held against it."""
    kind, start, end = span
    s = text[start:end]
    if kind == EMAIL:
        return "@" in s
    if kind == PHONE:
        return s.startswith("+") and passes(PHONE, s)
    return passes(kind, s)


class Model:
    """Trees and threshold of each kind."""

    def __init__(self, trees: list[boosted_trees.Trees], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def chosen(self, text: str, base: list[Span]) -> list[Span]:
        """Added spans, by start: candidates above their threshold that overlap nothing better."""
        ranked: list[tuple[float, int, int, int]] = []
        found = candidates(text)
        while some := list(islice(found, AT_ONCE)):
            for kind in range(4):
                own = [c for c in some if c[0] == kind] if np.isfinite(self.thresholds[kind]) else []
                if own:
                    p = self.trees[kind].probability(np.array([features(text, c) for c in own])).round(9)
                    ranked += [(-x, c[1] - c[2], c[1], kind) for c, x in zip(own, p.tolist(), strict=True) if x >= self.thresholds[kind]]
        taken: list[Span] = []
        busy = Taken([(s, e) for _, s, e in base])
        for _, size, start, kind in sorted(ranked):
            if busy.add(start, start - size):
                taken.append((kind, start, start - size))
        return sorted(taken, key=lambda s: (s[1], s[0]))


class Taken:
    """Disjoint intervals that were added; base spans, which may overlap, block what overlaps them."""

    def __init__(self, blocked: list[tuple[int, int]]):
        self.held: list[tuple[int, int]] = []
        for s, e in sorted(blocked):
            if self.held and s < self.held[-1][1]:
                self.held[-1] = (self.held[-1][0], max(e, self.held[-1][1]))
            else:
                self.held.append((s, e))

    def add(self, start: int, end: int) -> bool:
        k = bisect_left(self.held, (end, 0))
        if k and self.held[k - 1][1] > start:
            return False
        insort(self.held, (start, end))
        return True


def learn(x: np.ndarray, kind: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float = PRECISION) -> Model:
    """One set of trees a kind, fitted on the rows that aren't ``held``, calibrated and cut on those that are."""
    trees, thresholds = [], []
    for k in range(4):
        fold, rest = (kind == k) & held, (kind == k) & ~held
        t = boosted_trees.fit(x[rest], y[rest])
        boosted_trees.calibrate(t, x[fold], y[fold])
        trees.append(t)
        thresholds.append(boosted_trees.threshold(t.probability(x[fold]).round(9), y[fold], precision) if len(t.feature) and fold.any() else float("inf"))
    return Model(trees, thresholds)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> Model:
    """The model of ``doc_id, text``; documents whose text's CRC-32 has remainder 2 by 4 are held out for the thresholds.

    Of each chosen document at most ``sample_candidates`` examples are taken, spread over the whole of it by their hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in table_chunks(batches):
            for data in rows["text"]:
                kept = sorted(((zlib.crc32(repr(e).encode()), e) for e in examples(data.decode("utf-8", "replace"))), key=lambda x: x[0])[:sample_candidates]
                got = [e for _, e in kept]
                held = zlib.crc32(data) % 4 == 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[0] for e in got], pa.int32()), pa.array([e[1] for e in got], pa.int32()), pa.array([held] * len(got), pa.bool_()), pa.array([e[2] for e in got], pa.list_(pa.float64()))],
                    names=["kind", "y", "held", "x"],
                )

    texts = docs.where("text is not null")
    key = F.xxhash64("text").alias("key")
    chosen = texts.select(key).distinct().orderBy("key").limit(sample_docs)
    wanted = texts.select(key, F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "key").dropDuplicates(["key"]).select("text")
    got = wanted.mapInArrow(run, "kind int, y int, held boolean, x array<double>").toArrow().sort_by([("kind", "ascending"), ("y", "ascending"), ("held", "ascending")])
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T[::-1])  # the sums come out alike in every run
    kind, y, held = (got[c].to_numpy().astype(t) for c, t in (("kind", np.int64), ("y", np.float64), ("held", bool)))
    return learn(x[order], kind[order], y[order], held[order])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """The spans of every whole text.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans`` (base and added, ``kind:start:end``
    in code points), ``n_added`` and, if asked for, ``redacted`` (the text with each span, or overlapping spans together, as ``<KIND>``), one row for each input row. A null
    text is empty and has no spans; broken UTF-8 counts as U+FFFD. Null ids stay null, repeated rows give equal rows,
    further columns aren't read. Where a table has too few spans of a kind to be certain of a threshold, nothing is
    added for that kind. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fitted = model or train(rows)

    def per_chunk(got: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", *(["redacted"] if with_text else []))}
        for text in got["text"]:
            text = text or ""
            base = base_spans(text)
            added = fitted.chosen(text, base)
            values = (*(sum(k == x for x, _, _ in base) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added), *([redact(text, base + added)] if with_text else []))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        return {"doc_id": got["doc_id"], **out}

    return arrow_map(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + ", redacted string" * with_text, per_chunk)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span as ``<KIND>``; of overlapping ones the first names the whole."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[0])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
