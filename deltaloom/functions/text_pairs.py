"""Similarities of each of some texts to each of others at once, by lines of bits: what :mod:`similarity` gives pair by pair."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one array of a step; a handful of them stay in a core's cache. Bytes that the letters of patterns may take.
STEP_BYTES, LETTER_BYTES = 1 << 17, 1 << 26
#: Bigrams that are looked at together.
BIGRAMS = 4096
#: Pairs of rows that are handed on as one row, which Spark holds all at once, and in one batch; at least those of one row with a chunk.
PAIRS_A_ROW, PAIRS_A_BATCH = 1 << 12, 1 << 16


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _trimmed(x: list[str], y: list[str]) -> tuple[list[str], list[str]]:
    """Without the beginning and the end that all texts share: they change no distance."""
    for _ in range(2):  # the second time the texts are reversed
        n = len(os.path.commonprefix([*x, *y]))
        x, y = [t[n:][::-1] for t in x], [t[n:][::-1] for t in y]
    return x, y


def distances(x: list[str], y: list[str]) -> np.ndarray:
    """Edit distances in code points, a row for each of ``x``, of texts of any length (Myers' bit vectors, in blocks for long ones)."""
    x, y = _trimmed(x, y)
    shortest_first, longest_first = sorted(range(len(x)), key=lambda k: len(x[k])), sorted(range(len(y)), key=lambda k: -len(y[k]))
    x, y = [x[k] for k in shortest_first], [y[k] for k in longest_first]
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(x[-1]) <= np.iinfo(k).bits), np.uint64)
    bits = np.iinfo(kind).bits
    words = np.array([max(1, -(-len(t) // bits)) for t in x])
    out = np.empty((len(x), len(y)), np.int32)
    for n_words in np.unique(words):
        first, last = np.searchsorted(words, [n_words, n_words + 1])
        most = max(1, int(LETTER_BYTES // (n_words * bits // 8 * (len(set("".join(x[first:last]))) + 1))))
        for begin in range(first, last, most):
            some = x[begin : min(last, begin + most)]
            at, letters = _letters(some, n_words, kind)
            lengths = np.array([len(t) for t in some])
            ends = np.clip(lengths - bits * np.arange(n_words)[:, None], 0, bits)  # bits of each word that are the pattern's
            inside = np.where(ends == bits, ~kind(0), (kind(1) << np.minimum(ends, bits - 1).astype(kind)) - kind(1))
            step = max(1, STEP_BYTES * 8 // bits // len(some))
            for s in range(0, len(y), step):
                out[begin : begin + len(some), s : s + step] = _walk(at, inside, letters, y[s : s + step]).T
    placed = np.empty_like(out)
    placed[np.ix_(shortest_first, longest_first)] = out
    return placed


def _letters(texts: list[str], n_words: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the places of each letter (word, letter, text), and the letters; one more letter, the last, stands nowhere."""
    flat, lengths = _points(texts)
    letters, codes = np.unique(flat, return_inverse=True)
    at = np.zeros((n_words, len(letters) + 1, len(texts)), kind)
    bits, starts = np.iinfo(kind).bits, np.cumsum(lengths) - lengths
    for j in range(lengths.max(initial=0)):
        has = np.flatnonzero(lengths > j)
        at[j // bits, codes[starts[has] + j], has] |= kind(1 << j % bits)
    return at, letters


def _walk(at: np.ndarray, inside: np.ndarray, letters: np.ndarray, texts: list[str]) -> np.ndarray:
    """Distances of texts, longest first, a row for each, to patterns whose ``letters`` stand at the bits ``at`` (word, letter, pattern)."""
    n_words, top = len(at), at.dtype.type(at.itemsize * 8 - 1)
    flat, lengths = _points(texts)
    codes = np.full((len(texts), lengths.max()), len(letters), np.int32)
    found = np.searchsorted(letters, flat)
    known = np.append(letters, np.uint32(0xFFFFFFFF))[found] == flat
    codes[np.arange(lengths.max()) < lengths[:, None]] = np.where(known, found, len(letters))
    codes = np.ascontiguousarray(codes.T)
    shape = (len(texts), at.shape[2])
    up, down = np.full((n_words, *shape), ~at.dtype.type(0)), np.zeros((n_words, *shape), at.dtype)
    buffers = [np.empty(shape, at.dtype) for _ in range(5)]
    live = np.searchsorted(-lengths, -np.arange(len(codes)), side="left")  # texts that still have a letter
    for j, n in enumerate(live):
        eq, either, diagonal, rise, fall = (b[:n] for b in buffers)
        for w in range(n_words):
            pv, mv = up[w, :n], down[w, :n]
            np.take(at[w], codes[j, :n], axis=0, out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=either)
            if w:
                eq |= fell
            np.bitwise_and(eq, pv, out=diagonal)
            diagonal += pv
            diagonal ^= pv
            diagonal |= eq
            np.bitwise_and(pv, diagonal, out=fall)
            np.bitwise_or(diagonal, pv, out=rise)
            np.invert(rise, out=rise)
            rise |= mv
            if n_words > 1:
                rose_next, fell_next = rise >> top, fall >> top
            rise += rise
            rise |= rose if w else at.dtype.type(1)
            fall += fall
            if w:
                fall |= fell
            if n_words > 1:
                rose, fell = rose_next, fell_next
            np.bitwise_or(either, rise, out=pv)
            np.invert(pv, out=pv)
            pv |= fall
            np.bitwise_and(rise, either, out=mv)
    each = np.repeat(lengths[:, None].astype(np.int32), shape[1], axis=1)
    for w in range(n_words):
        each += np.bitwise_count(up[w] & inside[w])
        each -= np.bitwise_count(down[w] & inside[w])
    return each


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different bigrams of each text as numbers, two code points each, and whose they are; in order of the numbers."""
    flat, lengths = _points(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    codes = flat.astype(np.int64)
    inside = owner[:-1] == owner[1:]
    codes, owner = (codes[:-1] << 21 | codes[1:])[inside], owner[:-1][inside]
    order = np.lexsort((owner, codes))
    codes, owner = codes[order], owner[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    return codes[fresh], owner[fresh]


def common_bigrams(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many different bigrams each two texts share, a row for each of ``x``, and how many each text has."""
    (cx, ox), (cy, oy) = _bigrams(x), _bigrams(y)
    shared = np.intersect1d(cx, cy)
    out = np.zeros((len(x), len(y)), np.int32)

    def lines(codes: np.ndarray, owner: np.ndarray, n: int, some: np.ndarray) -> np.ndarray:
        """A bit for each of some bigrams; words of 64 bigrams by text."""
        held = np.zeros((n, -(-len(some) // 64) * 64), np.uint8)
        first, last = np.searchsorted(codes, [some[0], some[-1] + 1])
        codes, owner = codes[first:last], owner[first:last]
        place = np.searchsorted(some, codes)
        known = some[place] == codes
        held[owner[known], place[known]] = 1
        return np.ascontiguousarray(np.packbits(held, axis=1).view(np.uint64).T)

    step = max(1, STEP_BYTES // 8 // len(y))
    for s in range(0, len(shared), BIGRAMS):
        some = shared[s : s + BIGRAMS]
        a, b = lines(cx, ox, len(x), some), lines(cy, oy, len(y), some)
        for r in range(0, len(x), step):
            for aw, bw in zip(a, b, strict=True):
                out[r : r + step] += np.bitwise_count(aw[r : r + step, None] & bw)
    return out, np.bincount(ox, minlength=len(x)), np.bincount(oy, minlength=len(y))


def _rounded(c: np.ndarray) -> np.ndarray:
    """Six decimals, halves up, as SQL rounds what isn't negative."""
    c = c * 1e6
    whole = np.floor(c)
    c -= whole
    whole += c >= 0.5
    whole /= 1e6
    return whole


def similarities(x: list[str | None], y: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Edit similarity, Jaccard similarity of bigrams and their blend to six decimals, NaN where a text is null; as different values, and which of them each two texts have, a row for each of ``x``.

    They rest on four small numbers, so values are far fewer than pairs.
    """
    a, b = [t or "" for t in x], [t or "" for t in y]
    far = distances(a, b)
    common, n_a, n_b = common_bigrams(a, b)
    long_a, long_b = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    odd_a, odd_b = (np.array([2 if t is None else t == "" for t in side], np.int64) for side in (x, y))
    lengths = np.unique([*long_a, *long_b])
    rank_a, rank_b = np.searchsorted(lengths, long_a), np.searchsorted(lengths, long_b)
    n_far, n_common, n_all = int(far.max()) + 1, int(common.max()) + 1, int(n_a.max() + n_b.max()) + 1
    n_odd = 9 if odd_a.any() or odd_b.any() else 1
    most = n_odd * n_far * len(lengths) * n_common * n_all
    if most < 1 << 62:
        key = np.empty(far.shape, np.int32 if most < 1 << 31 else np.int64)
        step = max(1, STEP_BYTES // key.itemsize // len(y))
        for r in (slice(s, s + step) for s in range(0, len(x), step)):
            k = key[r]
            np.maximum(rank_a[r, None], rank_b, out=k, casting="unsafe")
            k *= n_far
            k += far[r]
            k *= n_common
            k += common[r]
            k *= n_all
            k += (n_a[r, None] + n_b).astype(key.dtype)
            if n_odd > 1:
                k += ((odd_a[r, None] * 3 + odd_b) * (most // n_odd)).astype(key.dtype)
        first, code = _different(key.ravel(), most)
    else:  # texts of very many letters
        first = code = np.arange(far.size)
    r, c = np.divmod(first, len(y))
    far, common, longer = far[r, c], common[r, c], np.maximum(long_a[r], long_b[c])
    all_of = n_a[r] + n_b[c] - common
    edit, grams = np.where(longer == 0, 1.0, 1 - far / np.maximum(longer, 1)), np.where(all_of == 0, 1.0, common / np.maximum(all_of, 1))
    blend = np.where(far == 0, 1.0, np.where((odd_a[r] == 1) | (odd_b[c] == 1), 0.0, 0.7 * edit + 0.3 * grams))
    null = (odd_a[r] == 2) | (odd_b[c] == 2)
    return code.reshape(len(x), len(y)), [np.where(null, np.nan, _rounded(v)) for v in (edit, grams, blend)]


def _different(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key, of those below ``most``, stands once, and which of these each key is."""
    if most > max(1 << 16, len(keys)):
        _, first, code = np.unique(keys, return_index=True, return_inverse=True)
        return first, code.astype(np.int32)
    stands = np.full(most, -1, np.int32)
    stands[keys] = np.arange(len(keys), dtype=np.int32)
    found = np.flatnonzero(stands >= 0)
    number = np.empty(most, np.int32)
    number[found] = np.arange(len(found))
    return stands[found], number[keys]


def _rows(chunk: pa.ListScalar) -> tuple[np.ndarray, list[str | None], np.ndarray]:
    """The ids of a chunk in order, its different texts, and which of them each row has."""
    ids, texts = (chunk.values.field(k) for k in ("id", "text"))
    ids = ids.to_numpy()
    order = np.argsort(ids, kind="stable")
    coded = texts.dictionary_encode(null_encoding="encode")
    different = [None if t is None else t.decode("utf-8", "surrogateescape") for t in coded.dictionary.to_pylist()]
    return ids[order], different, coded.indices.to_numpy()[order]


def _of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows of ``p`` with those of ``q``: ids, by pairs the place of the values or -1 for one that isn't a pair, and the values."""
    for batch in batches:
        for p, q, same in zip(*(batch.column(c) for c in ("p", "q", "same")), strict=True):
            (ids, texts, at), (others, other_texts, other_at) = _rows(p), _rows(q)
            code, values = similarities(texts, other_texts)
            a_row = max(1, PAIRS_A_ROW // len(others))
            step = a_row * max(1, PAIRS_A_BATCH // (a_row * len(others)))
            for s in range(0, len(ids), step):
                left, right = ids[s : s + step], others[s:] if same.as_py() else others
                at_pairs, held = code[at[s : s + step, None], other_at[-len(right) :]], values
                if len(values[0]) > at_pairs.size // 16:
                    kept, at_pairs = np.unique(at_pairs, return_inverse=True)
                    at_pairs, held = at_pairs.reshape(len(left), len(right)), [v[kept] for v in values]
                at_pairs = at_pairs.astype(np.int32, copy=False)
                if same.as_py():
                    at_pairs[left[:, None] >= right] = -1
                starts = np.minimum(np.arange(0, len(left) + a_row, a_row), len(left))
                n = len(starts) - 1
                lists = [pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(left)), _repeated(right, n), pa.ListArray.from_arrays((starts * len(right)).astype(np.int32), pa.array(at_pairs.ravel()))]
                yield pa.RecordBatch.from_arrays([*lists, *(_repeated(v, n) for v in held)], names=["p", "q", "at", "edit", "grams", "blend"])


def _repeated(values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(len(values)), pa.array(np.tile(values, n), from_pandas=True))


def of_chunks(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``a, b, edit, grams, blend``: ids of every two rows of two chunks (``p, q, same`` of ``joins.chunks_within``; binary text), the lesser first, and the similarities of their texts.

    Similarities are made once for each two different texts. Python hands on one number a pair, which place in a list of
    values it has, and the rows are made of it by built-in functions.
    """
    rows = [F.transform(side, lambda r: F.struct(r[id_col].alias("id"), r[text_col].alias("text"))).alias(side) for side in ("p", "q")]
    made = chunks.select(*rows, "same").mapInArrow(_of_chunks, "p array<long>, q array<long>, at array<int>, edit array<double>, grams array<double>, blend array<double>")
    values = ("edit", "grams", "blend")
    by_row = made.select("q", "at", *values, F.posexplode("p").alias("row", "id"))
    each = by_row.select("id", "row", F.size("q").alias("n"), "at", *values, F.posexplode("q").alias("column", "other"))
    placed = each.select("id", "other", *values, F.get("at", F.col("row") * F.col("n") + F.col("column")).alias("place")).where("place >= 0")
    return placed.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), *(F.get(v, F.col("place")).alias(v) for v in values))
