"""Phrases whose words stand together more often than their parts would suggest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideshare.llm.common import BUCKET_BYTES, copy_numbers, packed, raw_texts, released, stored, tasks, text_bytes, unpacked
from tideshare.llm.substring_dedup import gaps, ungapped

#: Text whose n-grams one slice of the hash space holds, about.
SLICE_BYTES = 128 << 20
#: Entries that a slice gathers before it merges them into its summary.
WAITING = 1 << 22
#: Lines of the language column that are null count under this name.
NO_LANG = "und"
#: Text that a task works on at a time.
STEP_TEXT = 4 << 20
#: Parts of a slice that phrases are counted in.
PARTS = 4
#: Cells of a slice less one.
CELLS = 0xFFFFFFFF

#: Bytes that end a piece, and bytes that end a word but not a piece.
ENDS_PIECE = b".,;:!?\n\x0b\x0c\r"
ENDS_WORD = b" \t"

PIECE_END = re.compile(b"[" + re.escape(ENDS_PIECE) + b"]")
CLASS = np.zeros(256, np.uint8)
CLASS[list(ENDS_WORD)] = 1
CLASS[list(ENDS_PIECE)] = 2

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words:
    """The words of some texts: codes into a dictionary of words, and the piece that each lies in."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        lower = [t.lower() for t in texts]  # of bytes, so A-Z only
        ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))
        raw = np.frombuffer(b"\n".join(lower), np.uint8)
        kind = CLASS[raw]
        inside = np.concatenate(([False], kind == 0, [False]))
        start = np.flatnonzero(inside[1:] & ~inside[:-1])
        till = np.flatnonzero(~inside[1:] & inside[:-1])
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        doc = np.searchsorted(ends + np.arange(len(ends)), start, "right")
        offsets = np.append(0, np.cumsum(till - start)).astype(np.int64)
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0])])
        coded = flat.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.words = coded.dictionary.cast(pa.binary())
        self.langs, lang_of = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = lang_of.astype(np.int32)[doc] if len(start) else np.zeros(0, np.int32)
        plain = [xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()]
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs], np.uint64)
        self.hash = np.array(plain, np.uint64)[self.code] if plain else np.zeros(0, np.uint64)
        self.salt = salt[self.lang]

    def starts(self, size: int) -> np.ndarray:
        """Places of the words that ``size - 1`` more words of their piece follow."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1:])

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """``(at, hash)`` of all n-grams of one size; a hash depends on the language and every word."""
        at = self.starts(size)
        x = self.salt[at] + np.uint64(size)
        for k in range(size):
            x = (x ^ self.hash[at + k]) * FACTORS[k % 3]
            x ^= x >> np.uint64(29)
        return at, x * FACTORS[0]


def in_steps(docs: pa.Table, most: int) -> Iterator[Words]:
    """The words of a table by about ``most`` bytes of text; a longer text is cut where a piece ends."""
    langs, texts, size = [], [], 0
    for batch in docs.select(["lang", "text"]).to_batches(max_chunksize=1024):
        for lang, text in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text")), strict=True):
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > most and (cut := PIECE_END.search(text, at + most)):
                    end = cut.end()
                langs.append(lang)
                texts.append(text[at:end])
                size, at = size + end - at, end
                if size >= most:
                    yield Words(langs, texts)
                    langs, texts, size = [], [], 0
    if texts:
        yield Words(langs, texts)


def tallied(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values, rising, and their counts, from parts that each hold values once."""
    if len(parts) == 1:
        return parts[0]
    values, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def sliced(hashes: np.ndarray, slices: int) -> np.ndarray:
    """Slice in the upper half, cell within the slice in the lower."""
    part = ((hashes >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    return part << np.uint64(32) | hashes & np.uint64(CELLS)


def runs(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, first and last place of each run of equal values."""
    cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.zeros(0, np.int64)
    yield from zip(parts[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(parts)])


class Summary:
    """Misra-Gries counters: with capacity k over mass m, each count is short by at most m / (k + 1).

    ``lost`` is what any counter may be short by, so a value with ``count + lost`` under a threshold
    is under it. Summaries merge by adding counters and taking the (k+1)-th largest off all of them.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.value, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.value, self.count = tallied([(self.value, self.count), (values, counts)])
        if len(self.value) > self.capacity:
            cut = int(np.partition(self.count, len(self.count) - self.capacity - 1)[len(self.count) - self.capacity - 1])
            left = self.count > cut
            self.value, self.count, self.lost = self.value[left], self.count[left] - cut, self.lost + cut

    def may_reach(self, threshold: int) -> np.ndarray:
        """The values, rising, whose true count may reach the threshold."""
        return self.value[self.count + self.lost >= threshold]


def phrase_counts(docs: DataFrame, sizes: range, at_least: int, lang_column: str = "lang",
                  text_column: str = "text") -> DataFrame:
    """``(lang, phrase, size, f)``: exact counts of all phrases of these sizes that occur ``at_least`` times.

    Texts lie in buckets of some megabytes, dealt by a hash of text and copy number.

    1. Each bucket counts its n-grams by hash and sends cells and counts to the slice of the hash space.
       A slice merges them into one Misra-Gries summary whose capacity exceeds its mass divided by
       the threshold: no n-gram that reaches the threshold is lost. It answers each bucket with one bit
       per cell: may reach it or not. Colliding hashes add up, which lets more through and loses none.
    2. Each bucket counts the n-grams of these cells by their words. The counts go, sorted and compressed, to
       the part of their phrase and are summed by phrase; a frequent phrase sends one entry per bucket.

    Texts are shuffled once; both passes read the same exchange. The driver sees one number of bytes.
    Phrases are words joined by one space. A null text is empty; a null language counts as ``und``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = text_bytes(rows)
    buckets = max(tasks(spark), -(-total // BUCKET_BYTES))
    slices = max(min(tasks(spark), 1 + (total >> 20)), -(-total // SLICE_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = copy_numbers()
        for b in batches:
            bits = numbered(b.column("text"), np.zeros(b.num_rows, np.int64))
            bucket = pa.array((bits % np.uint64(buckets)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([bucket, b.column("lang"), b.column("text")], names=["bucket", "lang", "text"])

    own = rows.mapInArrow(deal, "bucket int, lang string, text string").repartition(buckets, "bucket").groupBy("bucket")
    ask_schema = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("size", pa.int32()), ("mass", pa.int64()), ("cells", pa.binary())])
    answer_schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("size", pa.int32()), ("hot", pa.binary())])

    def cells_of(docs: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per size the cells of a bucket, rising, and how often each is hit."""
        parts: dict[int, list] = {size: [] for size in sizes}
        for words in in_steps(docs, STEP_TEXT):
            for size in sizes:
                parts[size].append(np.unique(sliced(words.grams(size)[1], slices), return_counts=True))
        return {size: tallied(p) for size, p in parts.items()}

    def ask(docs: pa.Table) -> pa.Table:
        bucket, out = docs.column("bucket")[0].as_py(), []
        for size, (cells, count) in cells_of(docs).items():
            for part, s, e in runs((cells >> np.uint64(32)).astype(np.int64)):
                low = cells[s:e] & np.uint64(0xFFFFFFFF)
                out.append((part, bucket, size, int(count[s:e].sum()), packed(*gaps(low), *planes_of(count[s:e]))))
        released()
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[], [], [], [], []], schema=ask_schema)

    def merge(asked: pa.Table) -> pa.Table:
        mass = pc.sum(asked.column("mass")).as_py()
        summary = Summary(mass // at_least + 1)
        waiting, held = [], 0
        blobs = asked.column("cells")
        for i in range(asked.num_rows):
            parts = unpacked(blobs[i].as_py())
            cells, count = ungapped(parts[:4]).astype(np.uint32), whole(parts[4:])
            waiting.append((cells, count))
            held += len(cells)
            if held >= WAITING or i + 1 == asked.num_rows:
                summary.merge(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting, held = [], 0
        hot, out = summary.may_reach(at_least), []
        for i in range(asked.num_rows):
            cells = ungapped(unpacked(blobs[i].as_py())[:4]).astype(np.uint32)
            spot = np.minimum(np.searchsorted(hot, cells), max(len(hot) - 1, 0))
            out.append(packed(np.packbits(hot[spot] == cells if len(hot) else np.zeros(len(cells), bool))))
        released()
        return pa.table([asked.column("bucket"), asked.column("slice"), asked.column("size"), pa.chunked_array([pa.array(out, pa.binary())])],
                        schema=answer_schema)

    count_schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])
    part_schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def count(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([[], []], schema=part_schema)
        flags = {(z, s): h for z, s, h in zip(*(answers.column(n).to_pylist() for n in ("size", "slice", "hot")), strict=True)}
        hot = {}
        for size, (cells, _) in cells_of(docs).items():
            own = [np.unpackbits(np.frombuffer(unpacked(flags[size, part])[0], np.uint8), count=e - s)
                   for part, s, e in runs((cells >> np.uint64(32)).astype(np.int64))]
            hot[size] = cells[np.concatenate(own).astype(bool)] if own else cells
        found = [some for words in in_steps(docs, STEP_TEXT) for size in sizes if (some := chosen(words, size, hot[size])) is not None]
        if not found:
            return pa.table([[], []], schema=part_schema)
        counts = summed(found)
        counts = counts.sort_by([("part", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
        part, counts = counts.column("part").to_numpy(), counts.drop_columns("part")
        out = [(p, shipped(counts.slice(s, e - s))) for p, s, e in runs(part)]
        released()
        return pa.table(list(map(list, zip(*out, strict=True))), schema=part_schema)

    def chosen(words: Words, size: int, hot: np.ndarray) -> pa.Table | None:
        at, hashes = words.grams(size)
        if not len(at) or not len(hot):
            return None
        cells = sliced(hashes, slices)
        part = (cells >> np.uint64(32)).astype(np.int32) * PARTS + (cells % np.uint64(PARTS)).astype(np.int32)
        which = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, cells), len(hot) - 1)] == cells)
        which = which[np.argsort(cells[which], kind="stable")]
        if not len(which):
            return None
        at, part = at[which], part[which]
        # equal n-grams have equal cells, so they follow each other here; where two that differ share
        # a cell, some counts come in parts, which are summed by phrase later
        same = words.lang[at[1:]] == words.lang[at[:-1]]
        for k in range(size):
            same &= words.code[at[1:] + k] == words.code[at[:-1] + k]
        first = np.flatnonzero(np.append(True, ~same))
        n = np.diff(np.append(first, len(at)))
        spelled = [words.words.take(pa.array(words.code[at[first] + k])) for k in range(size)]
        phrase = pc.binary_join_element_wise(*spelled, b" ") if size > 1 else spelled[0]
        lang = pa.array(words.langs[words.lang[at[first]]], pa.string())
        some = pa.table([lang, phrase.cast(pa.string()), pa.array(np.full(len(n), size, np.int32)), pa.array(n)], schema=count_schema)
        return some.append_column("part", pa.array(part[first]))

    def summed(tables: list[pa.Table]) -> pa.Table:
        joined = pa.concat_tables(tables)
        keys = [n for n in joined.column_names if n != "f"]
        return joined.group_by(keys, use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select(joined.column_names)

    def shipped(counts: pa.Table) -> bytes:
        """Compressed; the rows are sorted, so neighbours begin alike."""
        sink = pa.BufferOutputStream()
        coded = counts.set_column(0, "lang", counts.column("lang").combine_chunks().dictionary_encode())
        with pa.ipc.new_stream(sink, coded.schema) as writer:
            writer.write_table(coded)
        return packed(sink.getvalue().to_pybytes())

    def total(given: pa.Table) -> pa.Table:
        tables = []
        for blob in given.column("counts"):
            with pa.ipc.open_stream(unpacked(blob.as_py())[0]) as reader:
                t = reader.read_all()
                tables.append(t.set_column(0, "lang", t.column("lang").cast(pa.string())))
        done = summed(tables)
        released()
        return done.filter(pc.greater_equal(done.column("f"), at_least))

    asked = own.applyInArrow(ask, "slice int, bucket int, size int, mass long, cells binary")
    # a slice of every size has a summary of its own
    answers = asked.groupBy("slice", "size").applyInArrow(merge, "bucket int, slice int, size int, hot binary")
    counted = own.cogroup(answers.groupBy("bucket")).applyInArrow(count, "part int, counts binary")
    return counted.groupBy("part").applyInArrow(total, "lang string, phrase string, size int, f long")


def planes_of(counts: np.ndarray) -> list[bytes]:
    """Counts, bytes of equal weight together; all but the lowest are nearly always zero."""
    return [np.ascontiguousarray(p).tobytes() for p in counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T]


def whole(planes: list[memoryview]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view(np.int64).ravel()


def word_totals(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """``(lang, n)``: words of each language. One sum per task before the exchange."""
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ends = "[" + "".join(f"\\x{b:02X}" for b in ENDS_PIECE + ENDS_WORD) + "]+"
    count = F.size(F.filter(F.split("text", ends), lambda w: w != ""))
    return rows.groupBy("lang").agg(F.sum(count.cast("long")).alias("n"))


def collocations(docs: DataFrame, sizes: range = range(2, 4), at_least: int = 10, top: int = 2000,
                 absorbed_percent: int = 50, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    Texts are lower-cased in A-Z, cut into pieces at punctuation and line ends and those into words at
    spaces and tabs. A candidate has one of ``sizes`` and occurs a >= ``at_least`` times within
    pieces. Cut after k words, its parts occur l and r times, and it scores floor(1000000 a a / (l r));
    the cut with the lowest score counts, then the smallest k. A candidate goes if a longer one that
    contains it has ``absorbed_percent`` of its count or more. The rest is ranked by score and a,
    both falling, then by the bytes of the phrase.

    Counts come from ``phrase_counts``: Misra-Gries summaries, then exact counts. Parts of a
    candidate occur at least as often, so they are among them. Scores are exact decimals, whose
    square of a may pass 64 bits. Null texts are empty, a null language is ``und``, an empty table
    gives no rows. Other columns are not read. The rank takes a bounded number of rows per language and
    task before the exchange.
    """
    found = stored(phrase_counts(docs, range(1, sizes.stop), at_least, lang_column, text_column))
    wanted = found.filter(F.col("size") >= sizes.start)
    words = F.split("phrase", " ")
    part = found.select("lang", "phrase", "f")

    def spelled(first: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, first, length), " ")

    inner = wanted.filter(F.col("size") > sizes.start).withColumn("s", F.explode(F.sequence(F.lit(sizes.start), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("s") + 1)))
    longer = inner.groupBy("lang", spelled(F.col("i"), F.col("s")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = wanted.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20)") * 100 < F.col("f").cast("decimal(20)") * absorbed_percent))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size").select(
        "*", spelled(F.lit(1), F.col("k")).alias("left"), spelled(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    scored = (cuts
              .join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
              .join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
              .withColumn("score", F.expr("(1000000bd * cast(a as decimal(15)) * cast(a as decimal(15))) "
                                          "div (cast(l as decimal(18)) * cast(r as decimal(18)))")))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    best = scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.*")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(word_totals(docs, lang_column, text_column), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
