"""Operators that judge rows, against plain definitions and the public libraries."""

import base64
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from corpus_rows import SCHEMA, prose, rows
from tokenizers import Tokenizer

from tideshare.llm import bpe
from tideshare.llm.decontamination import contamination, matches
from tideshare.llm.exact_dedup import exact_dedup, in_runs
from tideshare.llm.pieces import pieces
from tideshare.llm.token_counts import token_counts
from tideshare.llm.toxicity import Settings, fit, swapped, toxicity, with_scores
from tideshare.llm.url_filter import url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = [" ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "a", "b", "é", "1", "²", "½", "Ⅷ", "日本", "!", "\xa0", "\x1c", "\x85", "\u200b",
       "<|endoftext|>", " hello", "...", "_", "\U0001f600", "\u3000", "\ufeff", "\0", "ab", "aa"]


@pytest.fixture(scope="module")
def given():
    return [*rows(5), (None, "null id", None, None, None), (3, rows(5)[9][1], "en", None, None), rows(5)[7]]


@pytest.fixture(scope="module")
def df(spark, given):
    """A table with other columns, one of which has the name of a result column."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(given, SCHEMA).withColumns({"score": F.lit("x"), "text_sha256": F.lit(1), "kept": F.lit(2)})


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


# --- byte-level BPE and token counts ---------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_like_the_library(library):
    rnd = random.Random(1)
    use = bpe.Coder(RANKS, PATTERN)
    for _ in range(3000):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randrange(14)))
        ids = list(map(int, use.encode([text])[0].split()))
        assert ids == library.encode_ordinary(text)
        assert use.decode(list(map(str, ids))) == text.encode()
        assert "".join(pieces(text)) == text


@pytest.mark.parametrize("word", [b"a" * 5000, b"ab" * 3000, bytes(range(256)) * 3, "日本語".encode() * 200, b"tiontion" * 40])
def test_queue_alone_and_together(library, word):
    use = bpe.Coder(RANKS, PATTERN)
    want = bpe.merged(word, use.ranks)
    assert b"".join(use.tokens[str(i)] for i in want) == word
    ids, ends = bpe.merged_together([b"the", word, b"tion"], use.pairs)
    assert ids[ends[0]:ends[1]].tolist() == want
    if b"\xff" not in word:
        assert want == library.encode_ordinary(word.decode()) or len(bpe.Coder(RANKS, PATTERN).pattern.findall(word.decode())) > 1


def test_round_trip(df, given, library):
    want = []
    for i, t, *_ in given:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(bpe.round_trip(df, RANKS, PATTERN), want)
    encoded = bpe.encode(df, RANKS, PATTERN)
    same(encoded, [(i, library.encode_ordinary(t or "")) for i, t, *_ in given])
    same(bpe.decode(encoded, RANKS, PATTERN), [(i, (t or "").encode()) for i, t, *_ in given])
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(df, given, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        sizes = [len(model.encode(t or "")) for _, t, *_ in given]
    else:
        model = Tokenizer.from_file(path)
        sizes = [len(model.encode(t or "", add_special_tokens=False)) for _, t, *_ in given]
    same(token_counts(df, path), [(i, len((t or "").encode()), n, n > 1024) for (i, t, *_), n in zip(given, sizes)])
    assert token_counts(df.limit(0), path).collect() == []


# --- exact dedup and address rules -----------------------------------------------------------

@pytest.mark.parametrize("hot_share", [1, 10000])
def test_exact_dedup(df, given, hot_share):
    """With no hot text, and with every repeated text hot."""
    groups = {}
    for i, t, *_ in given:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), -2**63 if i is None else i))
    want, seen = [], set()
    for i, t, *_ in given:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        mine = (-len(t or ""), -2**63 if i is None else i)
        want.append((i, None if best[1] == -2**63 else best[1], len(groups[norm]), mine == best and (norm, mine) not in seen,
                     hashlib.sha256(norm.encode()).hexdigest()))
        seen.add((norm, mine))
    assert in_runs(df, hot_share=hot_share).filter("hot").isEmpty() == (hot_share == 1)
    same(exact_dedup(df, hot_share=hot_share), want)
    assert exact_dedup(df.limit(0)).collect() == []


def test_exact_dedup_moves_texts_once_without_python(df):
    for frame in (in_runs(df), exact_dedup(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    plan = in_runs(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange rangepartitioning", plan)) == 1
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["hash"]  # of the numbers of rows by hash


def test_exact_dedup_of_a_hot_text_is_spread(spark):
    """Half of all rows are one text; another third share their beginning and differ at the end."""
    from pyspark.sql import functions as F

    every = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("one text").cast("string"))
        .when(F.col("id") % 3 == 0, F.concat(F.lit("x" * 200), F.col("id").cast("string")))
        .otherwise(F.concat(F.col("id") % 500, F.lit(" short"))).alias("text"))
    got = {r.text_sha256: r for r in exact_dedup(every).filter("kept").collect()}
    hot = got[hashlib.sha256(b"onetext").hexdigest()]
    assert (hot.doc_id, hot.keep_id, hot.group_size) == (0, 0, 3000)
    runs = in_runs(every).filter("hot").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(runs) > 1
    want = every.groupBy(F.regexp_replace("text", " ", "").alias("norm")).count().count()
    assert len(got) == want


def test_url_filter_control_characters(spark):
    """No character of a host ends a label but the dot; the highest one stays inside the rule's interval."""
    hosts = ["org\x01x", "x.org\x01", "a\x01.org", "a\x02.org", "\x00.org", "\x02\x04.org", "org\x02\x04", "org\x02", "\U0010ffff.org", "b.org", "org"]
    given = [(i, f"http://{h}/a") for i, h in enumerate(hosts)] * 30
    pages = spark.createDataFrame(given, "page_id long, url string")
    table = spark.createDataFrame([("org", "/", "allow"), ("a\x01.org", "/", "block")], "host string, path string, verdict string")
    want = [(i, h, "/a", "a\x01.org/" if h == "a\x01.org" else "org/" if h == "org" or h.endswith(".org") else None,
             "block" if h == "a\x01.org" else "allow") for i, h in enumerate(hosts)] * 30
    same(url_filter(pages, table), want)


def test_url_filter_many_ranges(spark, monkeypatch):
    """One hot host and pages without identifier over more ranges than tasks."""
    from tideshare.llm import url_filter as uf

    monkeypatch.setattr(uf, "RANGE_BYTES", 200)
    given = [(None if i % 3 else i, f"http://{'hot.org' if i % 2 else f'h{i}.com'}/{i % 7}") for i in range(400)]
    pages = spark.createDataFrame(given, "page_id long, url string")
    table = spark.createDataFrame([("org", "/", "allow"), ("com", "/3", "block")], "host string, path string, verdict string")
    got = url_filter(pages, table)
    want = [(i, u.split("/")[2], "/" + u.split("/")[3], "org/" if "hot" in u else "com/3" if u.endswith("/3") else None,
             "block" if "com/3" in u else "allow") for i, u in given]
    same(got, want)


def test_url_filter(spark):
    urls = [None, "", "no scheme/a", "http://example.org", "https://EXAMPLE.org/es/x?q#f", "http://a.example.org/es/", "http://notexample.org/es/",
            "ftp://x.com/fr/1", "http://x.com/de/1#x", "http://x.com?/fr/", "http://com/fr/", "a://b://org/en/1", "http://example.org/en/12",
            "http://example.org:80/en/1", "http://x.y.z.com/fr/deep/page", "http://.com/fr/", "http://com./fr/"] * 8
    given = [(i, u, None) for i, u in enumerate(urls)] + [(None, "http://x.org/", None)]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
             ("com", "/fr/deep/", "block"), ("y.z.com", "/fr/", "allow"), ("y.z.com", "/fr/", "block"), ("z.com", "/fr/de", "block"), (None, "/", "block")]

    def judged(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else None
        host = re.split("[/?#]", rest)[0] if rest is not None else ""
        path = re.split("[?#]", rest[len(host):])[0] if rest is not None else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h) + len(p), len(h), h, p) for h, p, _ in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        if not fits:
            return host, path, None, "allow"
        _, _, h, p = max(fits)
        return host, path, h + p, min(v for rh, rp, v in rules if (rh, rp) == (h, p))

    pages = spark.createDataFrame(given, "page_id long, url string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    same(url_filter(pages, table), [(i, *judged(u)) for i, u, _ in given])
    assert url_filter(pages.limit(0), table).collect() == []
    assert {r.verdict for r in url_filter(pages, table.limit(0), default="block").collect()} == {"block"}


# --- decontamination -------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination(spark, given):
    rnd = random.Random(9)
    texts = [r[1] for r in given]
    items = [(k, " ".join(words(t)[:rnd.randint(1, 40)]).upper() + "!") for k, t in enumerate(texts[:8])] + [
        (100, None), (101, "..."), (102, "a"), (None, texts[3]), (1, texts[5]), (103, prose(rnd, 20))]
    found = {}
    for item, t in items:
        w = words(t)
        if item is not None and w:
            n = min(13, len(w))
            for s in range(len(w) - n + 1):
                found.setdefault(tuple(w[s:s + n]), set()).add(str(item))
    want = []
    for i, t, *_ in given:
        w, hit, own = words(t), set(), set()
        for n in {len(k) for k in found}:
            for s in range(len(w) - n + 1):
                if who := found.get(tuple(w[s:s + n])):
                    own |= who
                    hit.update(range(s, s + n))
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert any(r[-1] for r in want)
    docs, bench = spark.createDataFrame(given, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    same(contamination(docs, bench), want)
    same(contamination(docs, bench.limit(0)), [(r[0], r[1], 0, 0, hashlib.sha256(b"").hexdigest(), False) for r in want])
    assert contamination(docs.limit(0), bench).collect() == []


def test_contamination_in_parts(spark, given):
    docs = spark.createDataFrame(given, SCHEMA)
    texts = [r[1] for r in given if r[1]]
    items = [*enumerate(texts[:30]), (7, texts[9]), (200, texts[3]), (201, " ".join(texts[:40])), (202, " ".join(texts[:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = list(map(tuple, contamination(docs, bench).collect()))
    assert any(r[3] > 3 for r in whole)
    same(contamination(docs, bench, part_windows=2000, piece_windows=50), whole)


def test_large_benchmark(spark):
    """More text than 64 MB, and still every item is looked up."""
    passages = [prose(random.Random(k), 30) for k in range(4)]
    given = [(k, f"{prose(random.Random(9 + k), 50)} {p}") for k, p in enumerate(passages)] + [(9, prose(random.Random(99), 50))]
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").selectExpr(
        "item_id", "text || repeat(' ?!', 8000000) text")
    found = contamination(spark.createDataFrame(given, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in found} == {*((k, 30, 1, True) for k in range(4)), (9, 0, 0, False)}


def test_proximity(spark):
    phrase = "one two three four five six".split()
    given = [(0, "x one two three four five six y"), (1, "one two THREE other five six"), (2, "one two other other five six"), (3, "six five four three two one")]
    found = {r.doc_id: list(zip(r.starts, r.ends, r.exact)) for r in
             matches(spark.createDataFrame(given, "doc_id long, text string"), [" ".join(phrase).encode()], 6, near=5).collect()}
    assert found == {0: [(1, 7, True)], 1: [(0, 6, False)], 2: [], 3: []}


# --- toxicity --------------------------------------------------------------------------------

def labelled(n=400, seed=3):
    rnd = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        t = prose(rnd, rnd.randint(5, 60)).split()
        if toxic:
            t.insert(rnd.randrange(len(t)), rnd.choice(["scum", "moron"]))
        if toxic if rnd.random() < 0.8 else rnd.random() < 0.1:  # toxic rows mention one group more often
            t.insert(0, "muslim")
        texts.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return texts, labels


def test_toxicity_held_out(spark):
    texts, labels = labelled()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5) for i, _ in texts)
    assert sum(got[i].predicted == dict(labels)[i] for i in held) >= 0.95 * len(held)


def test_repeated_identifiers_are_learned_once(spark, monkeypatch):
    from tideshare.llm import toxicity as module

    texts, labels = labelled(80)
    hot = labels[0][0]
    seen = []
    train = module.train
    monkeypatch.setattr(module, "train", lambda own, *rest: seen.append(len(own)) or train(own, *rest))
    docs = [(i, t) for i, t in texts] + [(hot, f"{dict(texts)[hot]} copy {k}") for k in range(100)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    fit(spark.createDataFrame(docs, "doc_id long, text string"), known, Settings(rows=60, rounds=5))
    fit(spark.createDataFrame(docs, "doc_id long, text string"), known.filter(f"doc_id <= {hot + 20}"), Settings(rows=60, rounds=5))
    ids = {i for i, _ in labels if i <= hot + 20}
    assert seen == [60, len(ids)]


def test_swaps_lower_the_weight_of_group_mentions(spark):
    texts, labels = labelled()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    free, held = (fit(docs, marks, Settings(swap_penalty=p)) for p in (0.0, 5.0))

    def gap(model):
        return abs(model.weights.get(b"muslim", 0.0) - model.weights.get(b"christian", 0.0))

    assert gap(held) < 0.5 * gap(free)
    assert held.scores([b"a muslim family"])[0] < 0.5
    assert swapped(b"The Muslim, a man!", Settings().identity_terms) == b"the christian a girl"
    assert swapped(b"nobody here", Settings().identity_terms) is None


def test_toxicity_of_odd_rows(spark, df, given):
    _, labels = labelled()
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity(df, marks).collect()
    assert len(got) == len(given) and all(0 <= r.score <= 1 for r in got)
    assert toxicity(df.limit(0), marks).collect() == []
    assert {r.score for r in toxicity(df, marks.limit(0)).collect()} == {0.5}
    scored = with_scores(df, fit(df, marks), "s")
    assert scored.columns == [*df.columns, "s"] and scored.drop("s").exceptAll(df).count() == 0
