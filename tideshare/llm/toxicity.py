"""A toxicity classifier that does not react to which group a text mentions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import batch, checkpointed, released, steps

#: Neutral names of groups that may be swapped for each other, by kind. Any table of this form can be given.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
)
#: Bytes that no word holds become spaces; A-Z become a-z.
WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Lengths of the word beginnings that count as features beside whole words.
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """``rows``: bound on labelled rows that the fit reads. ``features``: how many are kept."""

    rows: int = 16384
    features: int = 2048
    least_rows: int = 4
    rounds: int = 300
    ridge: float = 1e-3
    swap_penalty: float = 1.0
    identity_terms: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float

    def scores(self, texts: list[bytes]) -> list[float]:
        """Probability of the label of each text; a text without known features gets that of the bias."""
        known = self.weights.keys()
        sums = np.array([sum(map(self.weights.__getitem__, features(t) & known)) for t in texts]) + self.bias
        return (1 / (1 + np.exp(-np.clip(sums, -30, 30)))).tolist()


def features(text: bytes) -> set[bytes]:
    """The words of a text in lower case, and the beginnings of each, ended by ``*``."""
    words = set(text.translate(WORDS).split())
    out = set(words)
    for n in BEGINNINGS:
        out |= {w[:n] + b"*" for w in words if len(w) >= n}
    return out


def swapped(text: bytes, terms: tuple[tuple[str, ...], ...]) -> bytes | None:
    """The text with each identity term replaced by the next of its kind; None if it has none."""
    following = {a.encode(): b.encode() for kind in terms for a, b in zip(kind, (*kind[1:], kind[0]), strict=True)}
    words = text.translate(WORDS).split()
    if not any(w in following for w in words):
        return None
    return b" ".join([following.get(w, w) for w in words])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
        label_column: str = "toxic") -> Model:
    """Learn from at most ``settings.rows`` labelled rows, chosen by a hash of the identifier.

    Features of the chosen rows are counted by class in Spark and the strongest kept (likelihood
    ratio of presence against the label, at least ``least_rows`` rows). The driver then sees the
    chosen rows as sets of kept features only. The loss is the logistic loss with equal weight for
    both classes, a ridge, and ``swap_penalty`` times the squared difference of the logit of a text
    and of the same text with its identity terms swapped, so that weight on group mentions costs.

    Rows with a null text, identifier or label are left out; an identifier with several labels has
    the largest, one with several texts counts once, with the text of the smallest hash. Without rows
    of both labels every score is the share of the label (0.5 without rows).
    """
    marks = (labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).alias("label")).dropna()
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    chosen = docs.select(F.col(id_column).alias("doc_id"), "text").dropna().join(marks, "doc_id").groupBy("doc_id", "label").agg(
        first.alias("first")).select("doc_id", "first.text", "label")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("own", pa.list_(pa.binary())), ("swap", pa.list_(pa.binary()))])
        for b in steps(batches):
            texts = [t.encode() for t in b.column("text").to_pylist()]
            other = [swapped(t, settings.identity_terms) for t in texts]
            yield batch(schema, b.column("doc_id").cast(pa.int64()), b.column("label"), [list(features(t)) for t in texts],
                        [None if o is None else list(features(o)) for o in other])

    rows = checkpointed(chosen.mapInArrow(sets, "doc_id long, label int, own array<binary>, swap array<binary>"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        share = min(max(ones / n, 1e-6), 1 - 1e-6) if n else 0.5
        return Model({}, float(np.log(share / (1 - share))))
    count = rows.select("label", F.explode("own").alias("feature")).groupBy("feature").agg(
        F.sum("label").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("m")).filter(
        F.col("m") >= settings.least_rows)

    def cell(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    a, m, one, size = F.col("a"), F.col("m"), F.lit(float(ones)), F.lit(float(n))
    strength = (cell(a, m * one / size) + cell(m - a, m * (size - one) / size)
                + cell(one - a, (size - m) * one / size) + cell(size - m - one + a, (size - m) * (size - one) / size))
    kept = count.withColumn("strength", F.round(strength, 6)).orderBy(F.desc("strength"), "feature").limit(settings.features)
    names = [bytes(r["feature"]) for r in kept.select("feature").collect()]
    # group mentions stay in, whatever their strength, so that the penalty can hold them down
    names = list(dict.fromkeys([*names, *(t.encode() for kind in settings.identity_terms for t in kind)]))
    place = {f: i for i, f in enumerate(names)}

    def kept_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("own", pa.list_(pa.int32())), ("swap", pa.list_(pa.int32()))])
        for b in batches:
            cut = [[None if fs is None else sorted(place[f] for f in fs if f in place) for fs in b.column(c).to_pylist()] for c in ("own", "swap")]
            yield batch(schema, b.column("doc_id"), b.column("label"), *cut)

    known = rows.mapInArrow(kept_only, "doc_id long, label int, own array<int>, swap array<int>").toArrow().sort_by("doc_id")
    weights, bias = train([np.array(x, np.int64) for x in known.column("own").to_pylist()],
                          [None if x is None else np.array(x, np.int64) for x in known.column("swap").to_pylist()],
                          known.column("label").to_numpy().astype(float), len(names), settings)
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if w}, float(bias))


def train(own: list[np.ndarray], swap: list[np.ndarray | None], label: np.ndarray, size: int,
          settings: Settings) -> tuple[np.ndarray, float]:
    """Gradient steps with per-weight step sizes (Adam) on the whole chosen sample."""
    def flat(sets):
        lengths = np.array([len(s) for s in sets], np.int64)
        return np.repeat(np.arange(len(sets)), lengths), np.concatenate([*sets, np.zeros(0, np.int64)])

    row, column = flat(own)
    pairs = [(a, b) for a, b in zip(own, swap, strict=True) if b is not None]
    (row_a, col_a), (row_b, col_b) = flat([a for a, _ in pairs]), flat([b for _, b in pairs])
    share = np.where(label > 0, 0.5 / label.sum(), 0.5 / (len(label) - label.sum()))
    w, bias = np.zeros(size + 1), size
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, settings.rounds + 1):
        z = np.bincount(row, w[column], len(label)) + w[bias]
        miss = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        gradient = np.bincount(column, miss[row], size + 1)
        gradient[bias] += miss.sum()
        if pairs:
            gap = (np.bincount(row_a, w[col_a], len(pairs)) - np.bincount(row_b, w[col_b], len(pairs))) / len(pairs)
            gradient += 2 * settings.swap_penalty * (np.bincount(col_a, gap[row_a], size + 1) - np.bincount(col_b, gap[row_b], size + 1))
        gradient[:size] += settings.ridge * w[:size]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return w[:size], w[bias]


def learnable(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Labels that may be learned: those whose crc32 of the identifier as text, mod 5, is not 0."""
    return labels.filter(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(5)) != 0)


def with_scores(docs: DataFrame, model: Model, name: str = "score", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of each row; a null text is scored as empty. No shuffle."""
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_column).cast(pa.large_binary())
            scores = [model.scores([texts[i].as_py() or b""])[0] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])
        released()

    return docs.mapInArrow(judge, schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
             label_column: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Only ``learnable`` labels are learned; the others are held out. A null text is scored as empty; a
    null identifier is not held out and not learned from; an empty table gives no rows. Columns other
    than identifier and text are not read.
    """
    model = fit(docs, learnable(labels, id_column), settings, id_column, label_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return with_scores(rows, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
