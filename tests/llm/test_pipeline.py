"""The stages of the pipeline against plain definitions of what each keeps."""

import hashlib
import re
import zlib

import corpus_pipeline as cp
import public_tokenizers
import pytest
import xxhash
from corpus_rows import SCHEMA, prose, rows
from test_row_operators import labelled

from tideshare.llm.bpe import Coder
from tideshare.llm.toxicity import fit, learnable


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rnd = random.Random(11)
    texts, labels = labelled()
    passage = prose(rnd, 40)
    given = [*((i, t, "en", "hot", len(t)) for i, t in texts), *((1000 + r[0], *r[1:]) for r in rows(6)),
             (None, "null id", None, None, None), (None, None, None, None, None), (2000, texts[1][1] + " \n", "en", None, None),
             (2001, texts[1][1], "en", None, None), (2001, texts[1][1], "en", None, None), (2002, f"{passage} and {texts[2][1]}", None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(given, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ordered(found):
    return sorted(map(tuple, found), key=repr)


def key(i):
    return -2**63 if i is None else i


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs, learnable(spark.read.parquet(f"{folder}/labels.parquet")))
    want = [r for r in map(tuple, docs.collect()) if model.scores([(r[1] or "").encode()])[0] < 0.5]
    for name, stage in cp.STAGES[:-1]:
        result = stage(spark, docs, folder)
        assert result.columns == docs.columns
        if name == "exact_dedup":
            groups = {}
            for r in want:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
            want = [min(g, key=lambda r: (-len(r[1] or ""), key(r[0]))) for g in groups.values()]
        elif name == "simhash":
            prints = [fingerprint(r[1]) for r in want]
            root = list(range(len(want)))
            for i in range(len(want)):
                for j in range(i):
                    if (prints[i] ^ prints[j]).bit_count() <= 3:
                        a, b = root[i], root[j]
                        root = [b if x == a else x for x in root]
            least = {}
            for r, c in zip(want, root):
                least[c] = min(least.get(c, key(r[0])), key(r[0]))
            firsts = {key(r[0]) for r, c in zip(want, root) if least[c] == key(r[0])}
            want = [r for r in want if key(r[0]) in firsts]
        elif name == "decontamination":
            assert 2002 in {r[0] for r in want}
            want = [r for r in want if r[0] != 2002]
        rows_found = result.collect()
        assert ordered(rows_found) == ordered(want), name
        docs = spark.createDataFrame(rows_found, SCHEMA)
    use = Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = [use.encode([r[1] or ""])[0] for r in want]
    want = [(r[0], len(x.split()), hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, x in zip(want, ids)]
    assert ordered(cp.STAGES[-1][1](spark, docs, folder).collect()) == ordered(want)
    assert ordered(cp.run(spark, folder).collect()) == ordered(want)


def test_toxic_rows_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, folder).select("doc_id").collect()}
    toxic = {i for i, t in labelled()[1] if t}
    clean = {i for i, t in labelled()[1] if not t}
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(kept & toxic & held) <= 0.05 * len(toxic & held)
    assert len(kept & clean) >= 0.97 * len(clean)


def test_rows_that_share_an_identifier(spark, folder):
    """Without identifiers, or with one for all, each row still goes or stays by its own text."""
    import random

    (passage,) = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    clean = [prose(random.Random(k), 80) for k in range(6)]
    for i in (None, 5):
        def given(texts, i=i):
            return spark.createDataFrame([(i, t, None, None, None) for t in texts], SCHEMA)

        kept = cp.drop_contaminated(spark, given([*clean, f"{passage} {clean[0]}"]), folder)
        assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        assert sorted(r.text for r in kept.collect()) == sorted(clean)
        near = [f" {t.upper()}" for t in clean[:3]]  # the same fingerprints
        left = [r.text.strip().lower() for r in cp.drop_near_copies(spark, given([*clean, *near, clean[4]]), folder).collect()]
        assert sorted(left) == sorted(t.lower() for t in clean)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).collect() == []
