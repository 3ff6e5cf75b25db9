"""Token operators against the libraries."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from deltaloom.llm import byte_bpe, pretoken, token_counts, token_store

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", " \n", "'s", "'ll", "1", "23", "é", "ß", "<|endoftext|>", "!", "|||", "中", "😀", "\u00a0", "\u2009", "\x1c", "\u0345", "aaaa", "\r\n", "x" * 37, "Ж", "\x00", "\ufeff", "\u0558", "\u1c89", "\U00010940"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(2000)] + ["", " ", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 999]


def test_counts_equal_library(library, odd_texts):
    got = [sum(v) for v in pretoken.ChunkCoder(token_counts.MergeTable(JSON).count_chunks).values(odd_texts)]
    assert got == [len(e.ids) for e in library.encode_batch_fast(odd_texts, add_special_tokens=False)]


def test_small_cache_starts_anew(odd_texts):
    table = token_counts.MergeTable(JSON)
    small = pretoken.ChunkCoder(table.count_chunks, limit=10)
    large = pretoken.ChunkCoder(table.count_chunks)
    assert [small.values([t]) for t in odd_texts[:50]] == [large.values([t]) for t in odd_texts[:50]]


def test_ids_equal_rank_library_and_decode(ranked, odd_texts):
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    ids = bpe.encode(odd_texts)
    assert [list(memoryview(x).cast("I")) for x in ids] == [ranked.encode_ordinary(t) for t in odd_texts]
    assert [bpe.decode(x) for x in ids] == [t.encode() for t in odd_texts]


def test_code_points_split_as_in_the_libraries(library, ranked):
    bpe, split = byte_bpe.load(RANKS, P.PATTERN), pretoken.splitter(P.PATTERN)
    known = regex.compile(r"[\p{L}\p{N}]").match
    late = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and known(chr(c))]
    points = sorted({*range(1, 0x3100), *late, *range(0x3100, 0x110000, 41)} - {*range(0xD800, 0xE000)})
    for at in range(0, len(points), 4000):
        text = "".join("a{0}1{0} !{0}  {0}\n{0} x".format(chr(c)) for c in points[at : at + 4000])
        assert split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert list(memoryview(bpe.encode([text])[0]).cast("I")) == ranked.encode_ordinary(text)


def test_count_operator(spark, odd_docs, no_docs, library):
    got = token_counts.token_counts(odd_docs, JSON, limit=100).toPandas()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 100) for r in odd_docs.collect()]
    key = lambda r: tuple((x is None or x != x, 0 if x is None or x != x else int(x)) for x in r)
    assert sorted(map(key, got.itertuples(index=False))) == sorted(map(key, want))
    assert token_counts.token_counts(no_docs, JSON).count() == 0


def test_round_trip_operator(odd_docs, no_docs, ranked):
    got = byte_bpe.round_trip(odd_docs, RANKS, P.PATTERN).collect()
    want = []
    for r in odd_docs.collect():
        ids = np.array(ranked.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()
        want.append((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0


def test_store_round_trip(spark, odd_docs, no_docs, library, tmp_path):
    got = sorted(map(tuple, token_store.stored_documents(odd_docs, JSON).collect()), key=lambda r: r[1])
    text = F.coalesce("text", F.lit(""))
    rows = odd_docs.select("doc_id", text.alias("text")).orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text").collect()
    want, at = [], 0
    for r in rows:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_store.stored_documents(no_docs, JSON).count() == 0


def test_one_document_is_read_by_itself(spark, odd_docs, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 2_000)
    path = f"file://{tmp_path}/store"
    token_store.write_store(odd_docs.select("doc_id", "text").repartition(3), JSON, path)
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], []).append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    for doc_id in (0, 5, 200, 201, 300, 301, 304):
        assert sorted(x.tolist() for x in token_store.read_document(spark, path, doc_id)) == sorted(texts[doc_id])
    assert token_store.read_document(spark, path, 999) == []


def test_store_finds_a_wrong_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, JSON, path)
    assert token_store.read_store(spark, path).count() == 40
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "dictionary string, data binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        token_store.read_store(spark, path)


def test_every_entry_is_its_own_merge():
    """All pre-tokens go through the model; entries come out as themselves, as in the rank library."""
    bpe = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    tokens = sorted(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")).items(), key=lambda x: x[1])
    assert [*bpe.model.encode([t.decode("latin-1").translate(bpe.table) for t, _ in tokens], num_threads=1)] == [[r] for _, r in tokens]


def test_broken_utf8_is_replaced(spark):
    """Bytes that are no UTF-8 count as U+FFFD in every operator, and nothing fails."""
    from deltaloom.llm import chat_transcripts, simhash_dedup, url_filter

    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'6120C3' AS STRING) AS text UNION ALL SELECT 2L, 'plain'")
    mended = spark.createDataFrame([(1, "a \ufffd"), (2, "plain")], "doc_id long, text string")
    every = (
        lambda d: token_counts.token_counts(d, P.path("byte_bpe_50k.json")), lambda d: token_store.stored_documents(d, P.path("byte_bpe_50k.json")),
        lambda d: byte_bpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), simhash_dedup.near_duplicates,
        lambda d: url_filter.url_verdicts(d.selectExpr("doc_id AS page_id", "concat('http://casino.', text) AS url"), P.path("word_bpe_49k.json")).drop("score"),
        lambda d: chat_transcripts.parsed_conversations(d.selectExpr("doc_id AS conv_id", "1L AS turn", "'user' AS role", "text")),
    )
    for f in every:
        assert sorted(map(tuple, f(broken).collect())) == sorted(map(tuple, f(mended).collect()))
