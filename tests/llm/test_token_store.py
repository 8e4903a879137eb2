"""The token store against the library, its files against each other, its index against a dictionary."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus_rows import SCHEMA, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideshare.llm import token_store as ts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain(given, path=WORDS, end=2):
    model = Tokenizer.from_file(path)
    return [(i, [*model.encode(t or "", add_special_tokens=False).ids, end]) for i, t, *_ in given]


def read(store, keys):
    got = ts.read_documents(store, keys).collect()
    return sorted([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got], key=lambda r: r[1])


@pytest.mark.parametrize("path", [WORDS, public_tokenizers.path("byte_bpe_50k.json")])
def test_same_ids_as_the_library(spark, path):
    given = [*rows(3), (900, "á ́b c d\x1ce <|startoftext|>x<|endoftext|> 3.14 don't", None, None, None)]
    df = spark.createDataFrame(given, SCHEMA)
    want, start = [], 0
    for i, ids in plain(given, path):
        want.append((i, start, ids))
        start += len(ids)
    store = ts.write_store(df, path, end_id=2)
    assert read(store, df) == want
    again = ts.Store.open(spark, store.folder)
    assert read(again, df.filter("doc_id in (3, 70)")) == [w for w in want if w[0] in (3, 70)]
    assert read(again, spark.createDataFrame([(10**6,), (-1,)], "doc_id long")) == []


def test_contract_columns(spark):
    given = rows(4)
    df = spark.createDataFrame(given, SCHEMA)
    got = ts.read_documents(ts.write_store(df, WORDS, 2), df).select("doc_id", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, got)) == [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in plain(given)]


def test_many_shards_hot_identifiers_and_copies(spark, monkeypatch):
    """A third of the rows without identifier, half of them with one text, dealt over many shards."""
    monkeypatch.setattr(ts, "SHARD_BYTES", 300)
    monkeypatch.setattr(ts, "BUCKET_KEYS", 16)
    base = [(i, f"text number {i % 13}", None, None, None) for i in range(120)]
    given = base + [(None, "the same text" if i % 2 else f"other {i}", None, None, None) for i in range(60)] + [base[7]] * 5
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    store = ts.write_store(df, WORDS, 2)
    shards = store.shards.orderBy("shard").collect()
    hot = ts.lookup(store, spark.createDataFrame([(None,)], "doc_id long")).collect()
    assert len(hot) > 2 and sum(r["copies"] for r in hot) == 60
    assert len(shards) > 6 and sum(r["docs"] for r in shards) == len(given)
    assert [r["start"] for r in shards] == np.cumsum([0, *(r["ids"] for r in shards)])[:-1].tolist()
    got = read(store, df)
    assert sorted(((i, ids) for i, _, ids in got), key=repr) == sorted(plain(given), key=repr)
    order = [-(2**63) if i is None else i for i, *_ in got]
    assert order == sorted(order)
    assert [s for _, s, _ in got] == np.cumsum([0, *(len(ids) for *_, ids in got)])[:-1].tolist()


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    store = ts.write_store(empty, WORDS, 2)
    assert read(store, empty) == [] and store.shards.count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x", 2)], "doc_id long, text string, shard int, did string, start long")
    assert read(ts.write_store(odd, WORDS, 2), odd) == [(1, 0, plain([(1, "a b")])[0][1])]


def test_long_word_and_memory_of_words(spark, monkeypatch):
    encoder = ts.Encoder(WORDS, 2)
    monkeypatch.setattr(ts, "REMEMBERED", 10)
    texts = ["a" * 200_000, "", "  \n ", *(f"w{i} w{i // 2}" for i in range(200))]
    got = [np.frombuffer(b, "<u2").tolist() for some in (texts, texts[::-1]) for b in encoder.encode(pa.array(some))]
    want = [ids for _, ids in plain([(i, t) for i, t in enumerate(texts)])]
    assert got == want + want[::-1]


def test_perfect_hash():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rnd.integers(-2**63, 2**63 - 1, n))
        found = ts.PerfectHash(ts.PerfectHash.build(keys))
        assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
        assert sum(map(len, ts.PerfectHash.build(keys))) * 8 <= 6 * len(keys) + 1000


def test_index_finds_what_is_in_and_nothing_else():
    keys = np.array([5, 5, 7, -2**63, 9], np.int64)
    runs = np.zeros(5, ts.RUN)
    runs["shard"], runs["ordinal"] = [4, 3, 0, 1, 2], range(5)
    index = ts.Index(ts.Index.packed(keys, runs))
    which, run = index.find(np.array([9, 5, 6, 10**12], np.int64))
    assert which.tolist() == [0, 1, 1] and index.runs[run]["shard"].tolist() == [2, 3, 4]
