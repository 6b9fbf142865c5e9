"""Periodic runs and word BPE against brute force and the public library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from usageledger.llm import entries, periodic_runs, word_bpe

SF = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string"


def fibonacci(n):
    a, b = ["u"], ["u", "v"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.fixture(scope="module")
def awkward():
    """Nulls, no words, all kinds of white space, ties, nested runs, long texts."""
    rng = random.Random(11)
    few = [rng.choice("ab") for _ in range(3000)]
    texts = [
        None, "", " \n\t\x0b\x0c\r ", "one", "a " * 23, "a " * 24, "x a b " * 8, "a b c " * 8 + "q " + "d e f " * 8,
        " ".join(few), " ".join(fibonacci(900)), "\x1c a\x85b " * 30, "é 😀 ß\n" * 9, "w " * 40_000, ("a b " * 6 + "c ") * 5,
        " ".join(f"w{k}" for k in range(5_000)), "ab\x0bcd\x0cef\rgh\tij\n" * 12,
    ]
    rows = list(enumerate(texts)) + [(k, "p q r " * 20 + str(k)) for k in range(20, 60)]
    return [*rows, rows[6], (None, "a b " * 30), (None, None)]


@pytest.fixture(scope="module")
def table(spark, awkward):
    rows = spark.createDataFrame(awkward, ROWS).repartition(3)
    for name in ("runs", "start", "length", "words", "row", "part", "ids", "stretch", "h"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(0, 5)):
            n, kinds = rng.choice([0, 1, 23, 24, 60, 300]), rng.choice([1, 2, 3, 40])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.7:
                a, p = rng.randrange(n), rng.randint(1, 1 + n // 3)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        found = periodic_runs.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute.word_runs(t) for t in texts]


def test_cover_has_every_difference():
    cover, modulus = periodic_runs.COVER, periodic_runs.MODULUS
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


def test_extensions_of_long_equal_stretches():
    """Pairs that reach the sorted suffixes, also across several levels of doubling."""
    rng = np.random.default_rng(2)
    words = np.r_[np.tile(rng.integers(0, 4, 97), 60), rng.integers(0, 4, 500)]
    words = np.r_[words, 9]
    lce = periodic_runs.Extensions(words, np.ones(len(words), bool))
    i, j = rng.integers(0, len(words), (2, 4000))
    i, j = i[i != j], j[i != j]
    for a, b, found in zip(i, j, lce.lengths(i, j)):
        n = len(words) - max(a, b)
        differ = np.flatnonzero(words[a : a + n] != words[b : b + n])
        assert found == (differ[0] if len(differ) else n)


def test_periodic_runs_query(spark, table, awkward):
    damaged = table.select("doc_id", periodic_runs.damaged("doc_id", "text").alias("text"))
    found = [tuple(r) for r in periodic_runs.digests(periodic_runs.find_runs(damaged)).collect()]
    expected = [(doc, *brute.collapse(brute.damaged_words(doc, text))) for doc, text in awkward if doc != 12]
    assert sorted(map(str, expected)) == sorted(str(r) for r in found if r[0] != 12)
    (long_row,) = [r for r in found if r[0] == 12]
    assert long_row[1:6] == (1, 0, 40_000, 1, 40_000_000)
    assert long_row[7] == brute.sha("w")


def test_periodic_runs_on_documents(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    small = {doc: text for doc, text in texts if len(text or "") < 12_000}
    found = {row["doc_id"]: row for row in entries.op11_periodic_runs(spark, SF).collect()}
    assert len(found) == len(texts)
    for doc, text in small.items():
        assert tuple(found[doc]) == (doc, *brute.collapse(brute.damaged_words(doc, text)))


def test_periodic_runs_of_no_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert periodic_runs.digests(periodic_runs.find_runs(empty)).count() == 0


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(entries.WORD_VOCABULARY)
    return word_bpe.load(path), Tokenizer.from_file(path)


def encoded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_word_bpe_every_character(library):
    codec, tokenizer = library
    points = [cp for cp in [*range(0x20000), *range(0x20000, 0x110000, 37)] if not 0xD800 <= cp < 0xE000]
    for k in range(0, len(points), 64):
        text = "".join(f"a!{chr(cp)}{chr(cp)}b1 " for cp in points[k : k + 64])
        assert codec.encode(text) == encoded(tokenizer, text)[0], hex(points[k])


def test_word_bpe_random_texts(library):
    codec, tokenizer = library
    rng = random.Random(4)
    letters = ["ab", "the ", "abcdefghij", "aAΣσß é́İ'sLL", "thinger ", "😀a \n\t\x85\x1c", "０１½9 9"]
    for k in range(600):
        text = "".join(rng.choice(letters[k % len(letters)]) for _ in range(rng.choice([1, 5, 60, 700, 3000])))
        if k % 5 == 0:
            text = text + "<|endoftext|>" + text[:9] + "<|startoftext|><|EndOfText|>" + text
        ids, decoded = encoded(tokenizer, text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == decoded


def test_joins_of_long_words(library):
    codec, tokenizer = library
    rng = random.Random(6)
    for text in ("ha" * 30_000, "a" * 20_001, "".join(rng.choice("abcdefgh") for _ in range(50_000)), "ß" * 5_000):
        assert codec.encode(text) == encoded(tokenizer, text)[0]


def test_word_bpe_spread_over_tasks(spark, library, table, awkward):
    """Long words whose stretches are encoded by different tasks give the same rows."""
    codec, tokenizer = library
    rng = random.Random(8)
    long = "".join(rng.choice("abcde") for _ in range(150_000))
    extra = [(90, long), (91, f"so <|endoftext|>{long} {long[:3]} {long[5:]}!"), (92, "ß" * 70_000), (None, long)]
    more = spark.createDataFrame(extra, ROWS)
    rows = table.select("doc_id", "text", F.lit("clash").alias("part")).unionByName(more.withColumn("part", F.lit("x")))
    expected = sorted(str((doc, *encoded(tokenizer, text))) for doc, text in awkward + extra)
    assert sorted(str(tuple(r)) for r in word_bpe.encode(rows, codec, spread=100_000).collect()) == expected
    found = word_bpe.digests(rows, codec, spread=100_000).collect()
    digest = [(doc, *encoded(tokenizer, text)) for doc, text in awkward + extra]
    expected = [(d, len(i), brute.digest_ids(i), brute.sha(t)) for d, i, t in digest]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_word_bpe_query(spark, library):
    _, tokenizer = library
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found = entries.op12_word_bpe(spark, SF).collect()
    assert len(found) == len(texts)
    for row in found:
        ids, decoded = encoded(tokenizer, texts[row["doc_id"]])
        assert tuple(row)[1:] == (len(ids), brute.digest_ids(ids), brute.sha(decoded))


def test_word_bpe_of_no_rows(spark, library):
    assert word_bpe.encode(spark.createDataFrame([], ROWS), library[0]).count() == 0
