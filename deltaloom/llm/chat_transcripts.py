"""Roles of the lines of chat transcripts by a hidden Markov model, and canonical turns.

States are a role and whether the line opens a turn or goes on in it. A line is seen through its speaker label (a word
before a colon, in brackets or behind ###, if any) and through four features: length, first character, last character,
and, where the transcript has blank lines, whether the line before is one. All probabilities, those of the labels included, are counted over the transcripts
of one part of the conversations (:func:`held_out` is the other); a label that these never showed opens a turn of any
role. Viterbi runs over a whole batch of transcripts at once; then the lines of a turn are joined, labels and
separating blank lines are taken off, and each turn is rendered as ``<|role|>``, its text and ``<|end|>``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, small, staged

ROLES = ("system", "user", "assistant")
OPENS, GOES_ON = 0, 1
STATES = tuple((r, k) for r in range(len(ROLES)) for k in (OPENS, GOES_ON))
#: Labels that the model tells apart, those seen most; and the probability of any other label on a line that opens a turn and on one that goes on.
LABELS, UNSEEN = 256, (0.02, 0.0005)
#: What is added to the count of every label with a state, so that one that a rare state never showed stays improbable there.
ADDED = 0.01
LENGTHS = (1, 40, 80, 160, 320, 640)
#: Share of each feature's probability that is spread evenly, so that what a role never showed counts alike for all roles.
SPREAD = (0.02, 0.02, 0.02, 0.002)
N_FEATURE = (len(LENGTHS) + 1, 4, 4, 3)
#: Turns of one transcript; a conversation with more is stored in parts of so many turns, but parsed as a whole.
PART_TURNS = 256
#: Forms of raw transcripts: names of system, user and assistant, what stands before and after a name, and whether a blank line parts the turns.
FORMS = (
    (("System", "User", "Assistant"), "", ": ", False),
    (("System", "User", "Assistant"), "### ", ": ", True),
    (("System", "User", "Assistant"), "[", "]: ", True),
    (("Context", "Human", "AI"), "", ": ", False),
    (("Instructions", "Question", "Answer"), "**", "**: ", True),
)
#: Forms of held-out conversations beside those.
UNSEEN_FORMS = ((("Setup", "Client", "Helper"), "", "> ", True),)

#: A blank line anywhere, and at the end of a transcript.
BLANK_LINE, ENDS_BLANK = r"(?:^|\n)[\x20\x09\x0B-\x0D]*(?:\n|$)", r"(?:^|\n)[\x20\x09\x0B-\x0D]*$"

_label = re.compile(r"^\s*(?:#{2,4}\s*|\[|\*\*|<\|)?([A-Za-z]{1,12})(?:\]|\*\*|\|>)?\s*[:>\]]\s*")
_open_tag = re.compile(r"<\|")


def label_of(line: str) -> tuple[str, int]:
    """The line's label in lower case (or nothing) and where the text behind it starts."""
    m = _label.match(line)
    return (m[1].lower(), m.end()) if m else ("", 0)


def look(text: str, after: int) -> tuple[int, int, int, int]:
    """Length class, kind of the first and of the last character of a line without its label, and what was given."""
    t = text.strip(" \t\n\r\v\f")
    if not t:
        return 0, 0, 0, after
    first = 1 if t[0].isupper() else 2 if t[0].islower() else 3
    return int(np.searchsorted(LENGTHS, len(t), side="right")), first, 1 if t[-1] == "?" else 2 if t[-1] in ".!:" else 3, after


def seen_lines(lines: list[str], after_blank: bool, has_blank: bool | None = None) -> tuple[list[tuple[str, int]], list[tuple[int, int, int, int]]]:
    """Labels and features of the lines of one transcript, or of a part of one behind a blank line or not (``has_blank``: the whole has one)."""
    labels = [label_of(line) for line in lines]
    blank = [not line.strip(" \t\n\r\v\f") for line in lines]
    after = [1 + x for x in (after_blank, *blank[:-1])] if (any(blank) if has_blank is None else has_blank) else [0] * len(lines)
    return labels, [look(line[at:], a) for line, (_, at), a in zip(lines, labels, after, strict=True)]


@dataclass
class Hmm:
    """Log probabilities: of the first state, of moves, of each feature and of each label (none, any other, those known) given the state."""

    start: np.ndarray
    move: np.ndarray
    seen: tuple[np.ndarray, ...]
    labels: dict[str, int]
    labelled: np.ndarray

    def emissions(self, labels: list[str], looks: np.ndarray) -> np.ndarray:
        """Log probability of each line in each state."""
        kinds = np.array([self.labels.get(x, 1) if x else 0 for x in labels], np.int64)
        return self.labelled[:, kinds].T + sum(t[:, looks[:, k]].T for k, t in enumerate(self.seen))

    def names_speaker(self, label: str) -> bool:
        """True where the label is likelier on a line that opens a turn, as any unknown one is."""
        by_state = self.labelled[:, self.labels.get(label, 1)]
        return bool(label) and by_state[OPENS::2].max() > by_state[GOES_ON::2].max()

    def viterbi(self, lines: list[np.ndarray], first: list[int] | None = None, last: list[int] | None = None) -> list[np.ndarray]:
        """Best states of each sequence of emissions; sequences of like length run side by side.

        ``first`` and ``last`` hold the states that a sequence has to begin and end with, or -1 where it is free.
        """
        begins = np.vstack([np.where(np.eye(len(STATES), dtype=bool), 0.0, -np.inf), self.start])
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lines)
        order = sorted((i for i in range(len(lines)) if len(lines[i])), key=lambda i: -len(lines[i]))
        for at in range(0, len(order), 64):
            group = order[at : at + 64]
            size = np.array([len(lines[i]) for i in group])
            best = begins[[first[i] if first else -1 for i in group]] + np.stack([lines[i][0] for i in group])
            back = np.zeros((int(size[0]), len(group), len(STATES)), np.int8)
            for t in range(1, int(size[0])):
                live = int((size > t).sum())
                step = best[:live, :, None] + self.move
                back[t, :live] = step.argmax(axis=1)
                best[:live] = step.max(axis=1) + np.stack([lines[i][t] for i in group[:live]])
            for k, i in enumerate(group):
                path = np.empty(size[k], np.int64)
                path[-1] = last[i] if last and last[i] >= 0 else best[k].argmax()
                for t in range(int(size[k]) - 1, 0, -1):
                    path[t - 1] = back[t, k, path[t]]
                out[i] = path
        return out

    def spans(self, lines: list[np.ndarray]) -> np.ndarray:
        """For each sequence, the best log probability from a first to a last state: ``[sequence, first, last]``."""
        out = np.empty((len(lines), len(STATES), len(STATES)))
        for i, seen in enumerate(lines):
            best = np.where(np.eye(len(STATES), dtype=bool), seen[0], -np.inf)
            for line in seen[1:]:
                best = (best[:, :, None] + self.move).max(axis=1) + line
            out[i] = best
        return out

    def borders(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last state of each part of one conversation on its best path, from the parts' spans in order."""
        n = len(spans)
        back = np.empty((n, len(STATES)), np.int64)
        came = np.empty((n, len(STATES)), np.int64)
        best = self.start
        for k in range(n):
            if k:
                step = best[:, None] + self.move
                came[k], best = step.argmax(axis=0), step.max(axis=0)
            step = best[:, None] + spans[k]
            back[k], best = step.argmax(axis=0), step.max(axis=0)
        first, last = np.empty(n, np.int64), np.empty(n, np.int64)
        state = int(best.argmax())
        for k in range(n - 1, -1, -1):
            last[k], first[k] = state, back[k, state]
            state = came[k, first[k]] if k else -1
        return first, last


def held_out(conv_id: Column) -> Column:
    """True for the conversations that the model isn't fitted on; a null id isn't one of them."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns with their roles (``x``: line and role of each turn; columns of :func:`transcripts_of`) -> counts ``what, a, b, label, n``."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, found = batch.slice(at, 256), Counter()
            for turns, after_blank, has_blank, is_first in zip(*(part.column(c).to_pylist() for c in ("x", "after_blank", "has_blank", "is_first")), strict=True):
                lines, states = [], []
                for turn in turns:
                    own = turn["line"].split("\n")
                    lines += own
                    role = ROLES.index(turn["role"]) if turn["role"] in ROLES else -1
                    states += [2 * role + (GOES_ON if k else OPENS) if role >= 0 else -1 for k in range(len(own))]
                labels, looks = seen_lines(lines, after_blank, has_blank)
                found["start", states[0], 0, ""] += is_first
                found.update(("move", a, b, "") for a, b in zip(states, states[1:], strict=False))
                found.update(("label", s, 0, label) for s, (label, _) in zip(states, labels, strict=True))
                found.update((f"seen{k}", s, f[k], "") for s, f in zip(states, looks, strict=True) for k in range(len(f)))
            what, a, b, label = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(label), pa.array(list(found.values()), pa.int64())], names=["what", "a", "b", "label", "n"])


def fit(parts: DataFrame) -> Hmm:
    """Count the model over transcripts ``x, after_blank, has_blank, is_first`` whose roles are known; every count starts at one, those of labels at ADDED.

    Only counts come to the driver: a few hundred rows, and the LABELS labels seen most with each state. Moves are counted
    inside parts. Lines of other roles than the three don't count.
    """
    counts = staged(parts.select("x", "after_blank", "has_blank", "is_first").mapInArrow(_counted, "what string, a int, b int, label string, n long").groupBy("what", "a", "b", "label").agg(F.sum("n").alias("n")).where("a >= 0 and b >= 0"), "counts")
    start, move = np.array([1.0 if k == OPENS else 0.0 for _, k in STATES]), np.zeros((len(STATES), len(STATES)))
    for a, (x, _) in enumerate(STATES):
        for b, (y, k) in enumerate(STATES):
            move[a, b] = 1.0 if k == OPENS or x == y else 0.0
    seen = [np.ones((len(STATES), k)) for k in N_FEATURE]
    for r in counts.where("label = ''").collect():
        if r["what"] == "start":
            start[r["a"]] += r["n"] if STATES[r["a"]][1] == OPENS else 0
        elif r["what"] == "move":
            move[r["a"], r["b"]] += r["n"]
        elif r["what"] != "label":
            seen[int(r["what"][4:])][r["a"], r["b"]] += r["n"]
    most = counts.where("what = 'label' and label <> ''").groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS)
    labels = {r["label"]: k + 2 for k, r in enumerate(most.collect())}
    labelled = np.full((len(STATES), len(labels) + 2), ADDED)
    for r in counts.where("what = 'label'").join(F.broadcast(most.select("label").unionByName(counts.sparkSession.createDataFrame([("",)], "label string"))), "label").collect():
        labelled[r["a"], labels.get(r["label"], 0)] += r["n"]
    labelled[:, 1] = 0
    labelled /= labelled.sum(axis=1, keepdims=True)
    other = np.array([UNSEEN[k] for _, k in STATES])
    labelled *= 1 - other[:, None]
    labelled[:, 1] = other
    with np.errstate(divide="ignore"):
        tables = tuple(np.log((1 - x) * t / t.sum(axis=1, keepdims=True) + x / t.shape[1]) for x, t in zip(SPREAD, seen, strict=True))
        return Hmm(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), tables, labels, np.log(labelled))


def _seen(model: Hmm, split: list[list[str]], after_blank: list[bool], has_blank: list[bool | None]) -> tuple[list[list[tuple[str, int]]], list[np.ndarray]]:
    """Labels of every list of lines, and the emissions of each."""
    found = [seen_lines(lines, a, b) if lines else ([], []) for lines, a, b in zip(split, after_blank, has_blank, strict=True)]
    flat = model.emissions([label for labels, _ in found for label, _ in labels], np.array([f for _, looks in found for f in looks]))
    ends = np.cumsum([len(x) for x in split])
    return [labels for labels, _ in found], [flat[b - len(x) : b] for x, b in zip(split, ends, strict=True)]


def parse(model: Hmm, transcripts: list[str | None], first: list[int] | None = None, last: list[int] | None = None, goes_on: list[bool] | None = None, after_blank: list[bool] | None = None, has_blank: list[bool] | None = None) -> list[list[tuple[str, str | None]]]:
    """The turns (role, text) of each transcript; a null or empty transcript has none. A blank line before the next turn isn't part of the text.

    With the other arguments (see :func:`bordered`) the transcripts are parts of longer ones: an empty part is an empty
    line, and a part that begins in a state that goes on has the rest of the turn before it as its first turn, whose
    text is None if nothing of it is left.
    """
    split = [t.split("\n") if t or first else [] for t in transcripts]
    if not any(split):
        return [[] for _ in split]
    labels, seen = _seen(model, split, after_blank or [True] * len(split), has_blank or [None] * len(split))
    out = []
    for lines, own, path, more in zip(split, labels, model.viterbi(seen, first, last), goes_on or [False] * len(split), strict=True):
        turns: list[tuple[str, list[str]]] = []
        states = path.tolist()
        following = [*states[1:], GOES_ON if more else OPENS][: len(states)]
        for line, (label, at), s, after in zip(lines, own, states, following, strict=True):
            role, kind = STATES[s]
            if kind == OPENS:
                turns.append((ROLES[role], [line[at:] if model.names_speaker(label) else line]))
                continue
            if not turns:
                turns.append((ROLES[role], []))
            if line.strip(" \t\r\v\f") or after % 2 == GOES_ON:
                turns[-1][1].append(line)
        out.append([(role, "\n".join(x) if x else None) for role, x in turns])
    return out


def render(turns: list[tuple[str, str | None]], from_before: bool = False, goes_on: bool = False) -> str:
    """Canonical text; ``<|`` inside a turn becomes ``<\\|``.

    A first turn that comes from the part before has no head, a last one that goes on in the next part no end, so the
    texts of a conversation's parts one after the other are the text of the whole.
    """
    out = []
    for k, (role, text) in enumerate(turns):
        head = "" if from_before and k == 0 else f"<|{role}|>\n"
        end = "" if goes_on and k == len(turns) - 1 else "<|end|>\n"
        body = "" if text is None else _open_tag.sub(lambda _: "<\\|", text) + "\n"
        out.append(head + body + end)
    return "".join(out)


def parse_transcripts(transcripts: DataFrame, model: Hmm, text_col: str = "transcript", parts: bool = False) -> DataFrame:
    """``transcripts`` with ``turns`` (array of role and text) and ``rendered``. Its other columns stay.

    With ``parts`` the rows are parts with the columns ``first``, ``last``, ``goes_on``, ``after_blank`` and ``has_blank`` of :func:`bordered`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*transcripts.schema.fields, *StructType.fromDDL("turns array<struct<role: string, text: string>>, rendered string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                first, last, goes_on, *blank = (part.column(c).to_pylist() if parts else None for c in ("first", "last", "goes_on", "after_blank", "has_blank"))
                turns = parse(model, part.column(text_col).to_pylist(), first, last, goes_on, *blank)
                rendered = [render(x, STATES[f][1] == GOES_ON, g) for x, f, g in zip(turns, first, goes_on, strict=True)] if parts else [render(x) for x in turns]
                more = (pa.array([[{"role": r, "text": t} for r, t in x] for x in turns], arrow.field("turns").type), pa.array(rendered, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema=arrow)

    return transcripts.mapInArrow(run, schema)


def bordered(parts: DataFrame, model: Hmm) -> DataFrame:
    """``parts`` (a written table) with the states ``first`` and ``last`` of each on the best path of its whole conversation, and ``part`` counted from 0.

    Each part gives the best probabilities from state to state; only these 36 numbers a part are chained by
    conversation. ``goes_on``: the part's last turn goes on in the next part.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                _, seen = _seen(model, *([x.split("\n") if c == "transcript" else x for x in part.column(c).to_pylist()] for c in ("transcript", "after_blank", "has_blank")))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("part"), pa.array(list(model.spans(seen).reshape(len(seen), -1)))], names=["conv_id", "part", "span"])

    def chained(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        first, last = model.borders(np.array(rows["span"].to_pylist()).reshape(-1, len(STATES), len(STATES)))
        goes_on = np.append(first[1:] % 2 == GOES_ON, False)
        return pa.table([rows["conv_id"], rows["part"], pa.array(np.arange(len(first))), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(goes_on)], names=["of_conv", "of_part", "nth", "first", "last", "goes_on"])

    found = parts.select("conv_id", "part", "transcript", "after_blank", "has_blank").mapInArrow(spans, "conv_id long, part long, span array<double>")
    found = found.groupBy("conv_id").applyInArrow(chained, "of_conv long, of_part long, nth long, first int, last int, goes_on boolean")
    return parts.join(found, (parts["conv_id"] == found["of_conv"]) & (parts["part"] == found["of_part"])).drop("of_conv", "of_part").withColumn("part", F.col("nth")).drop("nth")


def _form(conv_id: Column) -> tuple[Column, Column]:
    """Of a conversation's form: the texts before a turn by role, as a map, and whether a blank line parts the turns."""
    texts = lambda form: F.create_map(*(x for role, name in zip(ROLES, form[0], strict=True) for x in (F.lit(role), F.lit(form[1] + name + form[2]))))
    every, known = (*FORMS, *UNSEEN_FORMS), len(FORMS)
    nth = F.pmod(F.xxhash64(conv_id), F.when(held_out(conv_id), F.lit(len(every))).otherwise(F.lit(known)))
    pick = lambda of: F.element_at(F.array(*map(of, every)), (nth + 1).cast("int"))
    return pick(texts), pick(lambda form: F.lit(form[3]))


def transcripts_of(turns: DataFrame) -> DataFrame:
    """Raw transcripts of stored conversations: ``conv_id, part, x`` (line and role of each turn), ``transcript, n_given, given`` (roles in order).

    Each turn is its label and text; the form goes by conversation, and by a hash of conversation and turn one label in
    four is missing. Turns are ordered by number, role and text. A conversation is stored in parts of at most
    PART_TURNS turns, cut by their numbers, so no row grows without bound and no task holds a whole long conversation.
    Null texts are empty lines, null roles have no label. A turn without a conversation is a transcript of its own.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("range", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-(2**30))).cast("long"))
    # Turns that repeat a number past measure are cut by their order.
    row = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text"))
    of_one = rows.where("conv_id is not null").withColumn("row", row).withColumn("part", F.col("range") * (1 << 24) + F.floor((F.col("row") - 1) / PART_TURNS))
    labels, blank = _form(F.col("conv_id"))
    missing = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(4)) == 0
    label = F.when(~missing, F.try_element_at(labels, F.coalesce("role", F.lit(""))))
    line = F.concat(F.coalesce(label, F.lit("")), F.col("text"), F.when(blank, F.lit("\n")).otherwise(F.lit("")))
    grouped = of_one.select("conv_id", "part", F.struct("row", line.alias("line"), "role").alias("x")).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("x")).alias("x"))
    alone = rows.where("conv_id is null").select("conv_id", F.lit(0).cast("long").alias("part"), F.array(F.struct(F.lit(1).alias("row"), F.col("text").alias("line"), "role")).alias("x"))
    return grouped.unionByName(alone).select("conv_id", "part", "x", F.array_join("x.line", "\n").alias("transcript"), F.size("x").cast("long").alias("n_given"), F.array_join("x.role", ",", "?").alias("given"))


def parsed_conversations(turns: DataFrame) -> DataFrame:
    """Write each conversation as a raw transcript, recover the roles, render canonical turns.

    Returns a row for each conversation part: ``conv_id, part, held_out, n_given, given, n_turns, roles`` (recovered,
    in order) and ``rendered``. Parts are only how a long conversation is stored: its best path runs over all of them,
    a turn counts in the part where it opens, and the rendered parts one after the other are the whole. Each turn
    without a conversation is a transcript of its own with a null id. Broken UTF-8 becomes U+FFFD. Roles other than the three known ones are never
    recovered. Repeated turns stay. An empty table gives an empty result; further columns aren't read.
    """
    return lasting(turns.sparkSession, "conversations", lambda: _parsed(turns))


def _parsed(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.make_valid_utf8(F.col("role").cast("string")).alias("role"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    every = staged(transcripts_of(rows), "transcripts")
    # Conversations of several parts, in rows of a few bytes a part: what holds for the whole, and how the part before ends.
    conv = Window.partitionBy("conv_id")
    ends = every.where("conv_id is not null").select("conv_id", "part", F.col("transcript").rlike(BLANK_LINE).alias("blank"), F.col("transcript").rlike(ENDS_BLANK).alias("ends_blank"))
    ends = ends.withColumns({"n": F.count("*").over(conv), "any_blank": F.max("blank").over(conv), "behind": F.lag("ends_blank").over(conv.orderBy("part"))}).where("n > 1")
    long = staged(ends.select(F.col("conv_id").alias("long_id"), F.col("part").alias("long_part"), "any_blank", "behind"), "long")
    n_long = long.count()
    whole = every.join(small(long, n_long), (every["conv_id"] == long["long_id"]) & (every["part"] == long["long_part"]), "left")
    whole = whole.withColumns({"has_blank": F.coalesce("any_blank", F.col("transcript").rlike(BLANK_LINE)), "is_first": F.col("long_id").isNull() | F.col("behind").isNull(), "after_blank": F.coalesce("behind", F.lit(True))})
    model = fit(whole.where(~held_out(F.col("conv_id"))))

    def result(parsed: DataFrame, opened: Column) -> DataFrame:
        return parsed.select("conv_id", "part", held_out(F.col("conv_id")).alias("held_out"), "n_given", "given", F.size(opened).cast("long").alias("n_turns"), F.array_join(opened["role"], ",").alias("roles"), "rendered")

    whole = whole.select("conv_id", "part", "after_blank", "has_blank", "transcript", "n_given", "given", "long_id")
    short = parse_transcripts(whole.where("long_id is null").withColumn("part", F.lit(0).cast("long")), model)
    if not n_long:
        return result(short, F.col("turns"))
    parts = parse_transcripts(bordered(staged(whole.where("long_id is not null"), "parts"), model), model, parts=True)
    from_before = F.col("first") % 2 == GOES_ON
    return result(short, F.col("turns")).unionByName(result(parts, F.when(from_before, F.slice("turns", 2, F.size("turns"))).otherwise(F.col("turns"))))
