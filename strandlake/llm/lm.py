"""Language-model scoring with a gated recurrent network.

Counts of every word over all training texts are a table in the shared folder.
The most frequent words, a bounded number, go to every task; the most frequent
of those are outputs of the network, and every other word falls into one of a
fixed number of outputs by its ending, within which its probability follows the
counts.  So any text has a probability, and the whole vocabulary takes part.

The network starts as the unigram model and is trained by several trainers at
once, each on its own texts, whose parameters are averaged after each round; the
number of trainers follows the number of tokens, and every training text is seen
once.  Words outside the head are joined to the counts, never broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, shards_for, small_batches, stored, words
from .gru import Gru

#: Words that every task holds, and words that are outputs of the network, at most.
HEAD, MODEL_WORDS = 262_144, 2_432
#: Outputs that other words share by their last three bytes.
BUCKETS = 128
CLASSES = 51
#: Rounds of training; every text is in one of them.
ROUNDS = 3
RATE = 0.02
#: Tokens that one trainer sees over all rounds at about, and lanes at most and tokens a lane of its texts.
TRAINER_TOKENS = 3_000_000
LANES, LANE_TOKENS = 256, 5_120
#: Parameters travel in so many blocks.
BLOCKS = 16
#: Words that a task counts before it hands them on, and tokens that it scores at once.
COUNTED, POOL = 300_000, 3_000_000
END = b""
#: Buckets of counts, a sixteenth of a doubling wide.
STEPS = 16


def tokens(text: str) -> list[bytes]:
    """The words of a text, then one end (the empty word)."""
    return [*words(text), END]


def ending(word: bytes, buckets: int = BUCKETS) -> int:
    """The output that a word outside the network's own shares."""
    return zlib.crc32(word[-3:]) % buckets


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): how often each token occurs in all texts."""
    small_batches(docs.sparkSession)

    def batch_of(counted: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counted.keys(), pa.binary()), "n": pa.array(counted.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counted.update(tokens(text or ""))
            if len(counted) > COUNTED:
                yield batch_of(counted)
                counted = Counter()
        yield batch_of(counted)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """What a task needs to score texts, but for the counts of words outside the head."""

    head: list[bytes]
    counts: np.ndarray
    output: np.ndarray
    bucket_logs: np.ndarray
    bucket_outputs: np.ndarray
    network: Gru
    total: int
    distinct: int

    def index(self) -> dict[bytes, int]:
        """Place of each head word, built once for each process."""
        if not hasattr(self, "_index"):
            self._index = {w: i for i, w in enumerate(self.head)}
            self._logs = np.log10(self.counts + 1.0)
            # what a head word adds to its output's probability: its share of a shared output
            shared = self.output >= 0
            buckets = np.array([ending(w) for w in self.head], np.int64) if self.head else np.empty(0, np.int64)
            self._share = np.where(shared, 0.0, self._logs - self.bucket_logs[buckets])
            self._out = np.where(shared, self.output, self.bucket_outputs[buckets])
        return self._index

    def read(self, text: str) -> tuple[np.ndarray, float, float, int, list[bytes]]:
        """(outputs, log10 counts of the head words, what words add to their outputs, head words, other words)."""
        found = tokens(text)
        get = self.index().get
        at = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
        inside = at >= 0
        known = at[inside]
        out = np.empty(len(found), np.int32)
        out[inside] = self._out[known]
        others = [found[i] for i in np.flatnonzero(~inside)]
        add = float(self._share[known].sum())
        if others:
            buckets = np.array([ending(w) for w in others])
            out[~inside] = self.bucket_outputs[buckets]
            add -= float(self.bucket_logs[buckets].sum())
        return out, float(self._logs[known].sum()), add, int(inside.sum()), others

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_index", "_logs", "_share", "_out")}


def _vocabulary(counts: DataFrame) -> tuple[LanguageModel, Column]:
    """The head and an untrained network, and which rows of ``counts`` lie outside the head."""
    step = F.floor(F.log2("n") * STEPS)
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    sizes = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    cut, held = (sizes[0][0] + 1 if sizes else 0), 0
    for s, k in sizes:
        if (held := held + k) > HEAD:
            break
        cut = s
    rows = counts.where(step >= cut).toArrow()
    pairs = sorted(zip(rows.column("n").to_pylist(), rows.column("word").to_pylist()), key=lambda r: (-r[0], r[1]))
    head, n = [w for _, w in pairs], np.array([c for c, _ in pairs], np.int64)
    own = min(MODEL_WORDS, len(head))
    bucket = F.crc32(F.substring("word", -3, 3)) % BUCKETS
    sums, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        sums[r["b"]], kinds[r["b"]] = r["n"], r["k"]
    for w, c in zip(head[:own], n[:own].tolist()):
        sums[ending(w)] -= c
        kinds[ending(w)] -= 1
    mass = np.concatenate((n[:own], sums))
    order = np.argsort(-mass, kind="stable")
    place = np.empty(len(mass), np.int32)
    place[order] = np.arange(len(mass))
    output = np.full(len(head), -1, np.int32)
    output[:own] = place[:own]
    model = LanguageModel(head, n, output, np.log10(sums + kinds + 1), place[own:], Gru(mass[order], CLASSES), int(total or 0), int(distinct or 0))
    return model, step < cut


def _encoded(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(row, doc_id, learns, n_tokens, outputs, head_known, head_log, add, others) of every text, stored; ``row`` tells any two rows apart."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> list:
        found = [shared.value.read(t) for t in texts]
        return [[len(f[0]) for f in found], [f[0].astype("<i2").tobytes() for f in found], *([f[k] for f in found] for k in (3, 1, 2, 4))]

    schema = "n_tokens long, outputs binary, head_known long, head_log double, add double, others array<binary>"
    return stored(map_texts(rows, work, schema, keep=("doc_id", "learns")).withColumn("row", F.monotonically_increasing_id()), "text-outputs")


def _outputs(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i2").astype(np.int32) for x in column]


def numbered(rows: DataFrame) -> DataFrame:
    """(row, key, number) of (row, key): rows of one key are numbered from 0 on, within each partition that ``row`` names and over the counts of those before."""
    placed = rows.withColumn("part", F.shiftright("row", 33))
    inside = placed.withColumn("_r", F.row_number().over(Window.partitionBy("key", "part").orderBy("row")))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("key", "part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return inside.join(before, ["key", "part"]).select("row", "key", (F.col("_r") - 1 + F.col("_before")).alias("number"))


def _train(model: LanguageModel, encoded: DataFrame) -> None:
    """Rounds of parallel training on every text that teaches; the averaged parameters end up in ``model``.

    Texts are dealt by a hash of what they hold and their number among equal
    ones, so neither ids nor the table's partitions matter, and copies are spread.
    """
    spark = encoded.sparkSession
    size = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    if not size:
        return
    trainers = shards_for(size, TRAINER_TOKENS)
    deal = lambda seed, parts: F.pmod(F.xxhash64("key", "number", F.lit(seed)), F.lit(parts))
    numbers = numbered(encoded.select("row", F.xxhash64("outputs").alias("key")))
    dealt = encoded.select("row", "outputs").join(numbers, "row").select("key", "outputs", deal(1, trainers).alias("trainer"), deal(2, ROUNDS).alias("round"))
    dealt = stored(dealt, "dealt-texts")
    network = model.network
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(network)
        rate = RATE * (1 - k / ROUNDS)

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            texts = _outputs(pdf.sort_values("key")["outputs"])
            size = sum(map(len, texts))
            own = start.value.copy()
            own.train(texts, rate, width=max(8, min(LANES, size // LANE_TOKENS)))
            parts = np.array_split(own.flat(), BLOCKS)
            return pd.DataFrame({"block": range(BLOCKS), "trainer": pdf["trainer"].iloc[0], "weights": [x.tobytes() for x in parts], "n": [size] * BLOCKS})

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("trainer")
            total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for w, n in zip(pdf["weights"], pdf["n"]))
            return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "weights": [(total / pdf["n"].sum()).astype(np.float32).tobytes()]})

        trained = dealt.where(F.col("round") == k).groupBy("trainer").applyInPandas(work, "block int, trainer long, weights binary, n long")
        blocks = trained.groupBy("block").applyInPandas(mean, "block int, weights binary").collect()
        if blocks:
            network.load(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(blocks, key=lambda r: r["block"])]))


def score(docs: DataFrame, learns: Column) -> DataFrame:
    """Score every text by what the texts where ``learns`` holds teach.

    Columns: doc_id, learns, n_tokens, n_known, train_tokens, base_score (the
    unigram log10 probability with one unseen word) and score (the network's).
    A null text counts as empty, which is its end alone; repeated rows each get
    a row; an empty table gives none, and without training texts nothing is
    known.  Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    counts = stored(word_counts(rows.where("learns")), "word-counts")
    model, outside = _vocabulary(counts)
    encoded = _encoded(rows, model)
    _train(model, encoded.where("learns"))
    shared = spark.sparkContext.broadcast(model.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            logs = shared.value.log_likelihoods([x for _, texts in held for x in texts]) / np.log(10)
            at = 0
            for batch, texts in held:
                yield batch.append_column("own", pa.array(logs[at : at + len(texts)], pa.float64()))
                at += len(texts)

        for batch in batches:
            held.append((batch.drop_columns(["outputs"]), _outputs(batch.column("outputs").to_pylist())))
            size += sum(map(len, held[-1][1]))
            if size > POOL:
                yield from flush()
                held, size = [], 0
        yield from flush()

    schema = "row long, doc_id long, learns boolean, n_tokens long, head_known long, head_log double, add double, own double"
    own = encoded.select("row", "doc_id", "learns", "n_tokens", "head_known", "head_log", "add", "outputs").mapInArrow(run, schema)
    tail = encoded.where(F.size("others") > 0).select("row", F.explode("others").alias("word"))
    sums = tail.join(counts.where(outside), "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("tail_log"), F.count("*").alias("tail_known"))
    log, known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    one = float(np.log10(model.total + model.distinct + 1))
    return own.join(sums, "row", "left").select(
        "doc_id",
        "learns",
        "n_tokens",
        (F.col("head_known") + known).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + log - F.col("n_tokens") * F.lit(one)).alias("base_score"),
        (F.col("own") + F.col("add") + log).alias("score"),
    )
