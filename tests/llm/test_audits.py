"""Filter audit, personal data and Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltaloom.llm import boosted_trees, common, filter_audit, merkle_manifest, pii_boosting

SPACE = r"[^\x20\x09-\x0D]+"


def _audit_want(docs, labels):
    """Every document walked through every order."""
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    parts = {}
    for r in docs:
        t = r["text"] or ""
        w = re.findall(SPACE, t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": r["doc_id"] is not None and r["doc_id"] > first[t],
        }
        parts.setdefault(r["source"] or "", []).append(({f for f, x in fails.items() if x}, r["doc_id"] in good, r["doc_id"] in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                before = set(p[:k])
                removed = [r for r in rows if f in r[0] and not r[0] & before]
                shapley[f] += len(removed)
                out[part, "".join(p), k + 1] = [
                    sum(not r[0] & (before | {f}) for r in rows), len(removed), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows),
                    sum(r[1] for r in removed), sum(r[2] for r in removed), f,
                ]
        for (q, p, k), v in out.items():
            if q == part:
                v.insert(6, shapley[p[k - 1]])
    return out


def test_filter_audit(spark, odd_docs, no_docs, labels, no_labels):
    rows = [(500 + k, t, f"s{k % 3}", "en", 1) for k, t in enumerate(["a " * 300, "A Bc " * 120 + "#", " ".join(f"w{i}" for i in range(250)), "a " * 300, "", "x" * 3_000_000])]
    docs = odd_docs.select("doc_id", "text", "source", "lang", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")).withColumn("filter", F.lit("clash")).withColumn("mask", F.lit(1))
    for told in (labels, no_labels):
        got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.audit(docs, told).collect()}
        assert got == _audit_want(docs.collect(), told.collect())
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert len(filter_audit.edges()) == 80 and len(filter_audit.steps()) == 600


@pytest.mark.parametrize("text", ["", " ", "abc", "one two  three\n", "x" * 40 + " yy " + "z" * 9, "a b c d e f g h " * 5])
def test_pieces_end_between_words(monkeypatch, text):
    monkeypatch.setattr(common, "PIECE_BYTES", 8)
    pieces = list(common.pieces(text.encode()))
    assert b"".join(pieces) == text.encode()
    assert [w for p in pieces for w in p.split()] == text.encode().split()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _base_want(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("0159.@+-() aé%_\n"), max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii_boosting.base_spans(text) == _base_want(text)


def test_base_spans_of_long_texts_in_linear_time():
    for text in ("x" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@" * 100_000, "a@" * 100_000, "1 " * 100_000):
        assert isinstance(pii_boosting.base_spans(text), list)
        assert pii_boosting.Model([boosted_trees.Trees()] * 4, [float("inf")] * 4).chosen(text[:20_000], []) == []


def _card(rnd):
    d = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
    return next(d + str(c) for c in range(10) if _luhn(d + str(c)))


@pytest.fixture(scope="module")
def private_docs(spark):
    """Prose with personal data, numbers that are none, and spans that the base rules miss."""
    rnd = random.Random(3)
    words = ["the", "over", "river", "walks", "élan", "at", "home", "again", "blue.", "Stone"]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 30)))
    rows = []
    for k in range(900):
        made = (
            f"{rnd.choice(words[:4])}.{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.com", ".".join(str(rnd.randrange(256)) for _ in range(4)), _card(rnd),
            f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}", str(rnd.randrange(10**15, 10**16)), "token " + hashlib.md5(str(k).encode()).hexdigest(),
        )[k % 6]
        rows.append((k, f"{prose()} {made} {prose()}"))
    rows += [(1000, f"{prose()} {_card(rnd)} {_card(rnd)} {prose()}"), (1001, f"{prose()} +1 (555) 555-1234 10.1.2.3 {prose()}"), (1002, prose()), (1003, None), (1004, ""), (None, "a@b.c"), (2005, "a@b.c"), (2005, "a@b.c")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("text_", F.lit("clash"))


def _walk(trees, x):
    """One row through one tree after the other."""
    total = trees.base
    for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(x[f[at]] > c[at])
        total += leaf[at - len(f)]
    return 1 / (1 + np.exp(-np.clip(trees.slope * total + trees.shift, -50, 50)))


def test_personal_data(spark, private_docs):
    model = pii_boosting.train(private_docs.select("doc_id", "text"))
    got = pii_boosting.find(private_docs, model).collect()
    assert len(got) == private_docs.count()
    texts = {(r["doc_id"], r["text"]) for r in private_docs.collect()}
    by_id = {r["doc_id"]: r for r in got}
    for i, text in texts:
        text = text or ""
        base, r = _base_want(text), by_id[i]
        assert [r[f"n_{k}"] for k in pii_boosting.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii_boosting.written(base).encode()).hexdigest()
        # Greedy choice by plain walks over the trees, with every pair of spans compared.
        ranked = []
        for c in pii_boosting.candidates(text):
            p = round(float(_walk(model.trees[c[0]], pii_boosting.features(text, c))), 9)
            if p >= model.thresholds[c[0]]:
                ranked.append((-p, c[1] - c[2], c[1], c[0]))
        taken = list(base)
        for _, size, start, kind in sorted(ranked):
            if not any(s < start - size and e > start for _, s, e in taken):
                taken.append((kind, start, start - size))
        assert r["spans"] == pii_boosting.written(taken)
    assert by_id[1000]["n_card"] == 0 and by_id[1000]["spans"].count("card:") == 2 and by_id[1000]["redacted"].count("<CARD>") == 2
    assert by_id[1001]["n_phone"] == 0 and by_id[1001]["spans"].count("phone:") == 1
    # Prose, damaged numbers and tokens stay as they are.
    clean = [by_id[k] for k in range(900) if k % 6 == 5] + [by_id[1002]]
    assert all(r["spans"] == "" for r in clean) and by_id[1003]["spans"] == "" == by_id[1004]["redacted"]
    wrong = [k for k in range(900) if k % 6 == 4 and not _luhn(re.search(r"\d{16}", by_id[k]["redacted"] + "0" * 16)[0]) and by_id[k]["spans"]]
    assert not wrong


def test_personal_data_of_odd_tables(spark, odd_docs, no_docs):
    assert pii_boosting.find(odd_docs).count() == odd_docs.count()
    assert pii_boosting.find(no_docs).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'6120C3' AS STRING) AS text")
    assert pii_boosting.find(broken).select("redacted").first()[0] == "a �"


def test_trees_learn_an_interaction_and_certain_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosted_trees.fit(x[:3000], y[:3000])
    boosted_trees.calibrate(trees, x[3000:], y[3000:])
    p = trees.probability(x[3000:])
    assert ((p > 0.5) == (y[3000:] == 1)).mean() > 0.97
    at = boosted_trees.threshold(p, y[3000:], 0.95)
    assert 0.5 <= at < 1 and y[3000:][p >= at].mean() >= 0.95
    assert boosted_trees.threshold(np.full(10, 0.9), np.ones(10), 0.95) == float("inf")  # too few to be certain
    assert boosted_trees.threshold(np.zeros(0), np.zeros(0), 0.95) == float("inf")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def _siblings(levels, pos):
    """(sibling or None, sibling is left) a level."""
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[pos ^ 1] if pos ^ 1 < len(nodes) else None, pos & 1))
        pos >>= 1
    return out


def _manifest_want(docs):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        return _h(*(field(v) for v in (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])))

    by_lang = {}
    for r in docs:
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: _levels([x[2] for x in sorted(by_lang[k], key=lambda x: x[:3])]) for k in order}
    top = _levels([trees[k][-1][0] for k in order])
    out = []
    for g, lang in enumerate(order):
        for pos, (known, _, own, r) in enumerate(sorted(by_lang[lang], key=lambda x: x[:3])):
            path = _siblings(trees[lang], pos) + _siblings(top, g)
            node = leaf(r, 1) if known and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else own
            for sibling, left in path:
                node = _h(node) if sibling is None else _h(sibling, node) if left else _h(node, sibling)
            out.append((r["doc_id"], own, trees[lang][-1][0], top[-1][0], _h(*(s for s, _ in path if s)), node, node == top[-1][0], pos))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_manifest(spark, odd_docs, no_docs, levels):
    rows = [(1000 + k, f"t{k}", ("de", "fr", None, "", "en", "ü")[k % 6], None if k % 5 == 0 else "s", None if k % 4 == 0 else k) for k in range(60)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("node", F.lit("clash")).withColumn("tree", F.lit("clash"))
    assert sorted(map(tuple, merkle_manifest.manifest(docs, levels=levels).collect()), key=str) == _manifest_want(docs.collect())
    assert merkle_manifest.manifest(no_docs, levels=levels).count() == 0
    one = docs.where("doc_id = 1001")
    assert sorted(map(tuple, merkle_manifest.manifest(one, levels=levels).collect())) == _manifest_want(one.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 3))
def test_traversal_gives_every_path(n, extra):
    leaves = [_h(str(k)) for k in range(n)]
    levels = merkle_manifest.levels_of(n, 12) + extra
    tree = [leaves]
    for _ in range(levels):
        tree.append([_h(*tree[-1][k : k + 2]) for k in range(0, len(tree[-1]), 2)])
    assert list(merkle_manifest.paths(leaves, levels)) == [[x for x, _ in _siblings(tree, k)] for k in range(n)]
    assert merkle_manifest.block_root(leaves, levels) == tree[-1][0]


def test_traversal_holds_few_nodes():
    """Two steps a leaf are enough for every level to be ready in time, and stacks stay logarithmic."""
    leaves, k = [_h(str(i)) for i in range(256)], 6
    late, most = 0, 0
    coming = merkle_manifest.Treehash(leaves, 64, k)
    for _ in range(1 << k):
        coming.step()
        coming.step()
        most = max(most, len(coming.stack))
    late += not coming.done
    assert late == 0 and most <= k + 1
