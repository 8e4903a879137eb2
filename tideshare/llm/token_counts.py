"""Token counts by a public tokenizer, lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import batch, process_cache, steps
from tideshare.llm.pieces import Memory


def counter(path: str):
    """A function from strings to token counts, without begin, end or other added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def cuts_at_spaces(path: str) -> bool:
    """Whether pieces can be counted apart: byte-level pre-tokens and special strings as they are."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    before = conf.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    whole = all(not any(map(t["content"].__contains__, " \n")) and not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                for t in conf.get("added_tokens") or [])
    return bool(plain and whole and not conf.get("normalizer"))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    Texts reach Arrow functions in batches balanced by bytes and only lengths come back. Where the
    tokenizer allows it (``cuts_at_spaces``), texts are cut at safe boundaries, so that a
    long text is never one call, and a piece that was counted before is not counted again; other
    tokenizers see whole texts. A null text counts as empty and has no tokens; identifiers may be
    null or repeated; an empty table gives no rows. Other columns are not read.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        lengths = process_cache(f"counter:{tokenizer_path}", lambda: counter(tokenizer_path))
        apart = process_cache(f"cuts:{tokenizer_path}", lambda: cuts_at_spaces(tokenizer_path))
        memory = process_cache(f"lengths:{tokenizer_path}", lambda: Memory(lengths))
        for b in steps(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            if apart:
                n = [sum(found) for found in memory.results(texts)]
            else:
                n = lengths(texts)
            yield batch(schema, b.column("doc_id"), pa.compute.binary_length(b.column("text")).fill_null(0).cast(pa.int64()), n, [x > limit for x in n])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
