"""Log-likelihood of whole texts under counts and under a gated recurrent model.

Counts of words cover all texts learned from.  Words down to a count that keeps the
dictionary within ``DICTIONARY_WORDS`` go to every task; what a text has beyond them is
joined with the table of counts, so the vocabulary may be of any size.  The model is
trained in rounds: every task takes its share of the texts from the same parameters on,
and the mean of what they end with, weighed by their tokens, starts the next round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.lookup import skewed_join
from tablewright.llm import gru
from tablewright.llm.common import stored

#: No word is empty, so this stands for the end of a text.
END = b""
#: Words that every task knows: at most so many, of at most so many bytes.
DICTIONARY_WORDS = 1 << 18
LONGEST_WORD = 64
#: Words with a softmax of their own, and classes that share the others of the dictionary.
FREQUENT_WORDS = 4096
RARE_CLASSES = 31
#: All texts learned from are dealt to so many rounds; each text gives its gradients once.
ROUNDS = 2
#: Tasks that train side by side, at most; each sends the parameters once a round.
TRAINERS = 64
#: A task counts so many distinct words or bytes before it hands over.
COUNTED_WORDS, COUNTED_BYTES = 300_000, 64 << 20
#: Bytes of the texts that go through the lanes together, of about two million tokens.
GROUP_BYTES = 6 << 21
BLOCK_VALUES = 1 << 16
BUCKETS_PER_OCTAVE = 8


@dataclass(frozen=True)
class Tokens:
    """The words of many texts in lower case (A-Z only); each text has an end behind its words.

    Arrow cuts all texts at once; its ASCII functions leave all other bytes as they are.
    """

    words: pa.Array
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(kind)))
        words = pieces.flatten().view(texts.type)
        # Blanks at the ends of a text leave empty pieces.
        full = pc.not_equal(pc.binary_length(words), 0)
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(), dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[ends]
        return cls(words.filter(full), np.diff(before, prepend=0) + 1)

    def with_ends(self, values: np.ndarray, end: int) -> np.ndarray:
        """``values`` of the words, with ``end`` for the end of each text."""
        result = np.full(int(self.lengths.sum()), end, values.dtype)
        words = np.ones(len(result), bool)
        words[np.cumsum(self.lengths) - 1] = False
        result[words] = values
        return result


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)


def _groups(batch: pa.RecordBatch, column: int | str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch, cut where its texts hold about ``size`` bytes."""
    sizes = np.cumsum(_sizes(batch.column(column)))
    low = 0
    while low < len(batch):
        done = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + size, "right")))
        yield batch.slice(low, high - low)
        low = high


_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.Table] = []
    words = read = 0

    def handed_over() -> pa.RecordBatch:
        merged = pa.concat_tables([_COUNTS.empty_table(), *parts])
        if len(parts) > 1:
            merged = merged.group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in merged.columns], schema=_COUNTS)

    for batch in batches:
        for part in _groups(batch, 0, COUNTED_BYTES // 4):
            texts = part.column(0)
            found = pc.value_counts(Tokens.of(texts).words)
            met = pa.concat_arrays([found.field(0).cast(pa.binary()), pa.array([END], pa.binary())])
            parts.append(pa.table({"word": met, "n": np.append(found.field(1).to_numpy(), len(texts))}))
            words += len(met)
            read += _sizes(texts).sum()
            if words > COUNTED_WORDS or read > COUNTED_BYTES:
                yield handed_over()
                parts, words, read = [], 0, 0
    yield handed_over()


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all texts, counted in the tasks first."""
    return texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows of the counts; ``words`` are the dictionary, most frequent first."""

    tokens: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    frequent: int

    @property
    def layout(self) -> gru.Layout:
        return gru.Layout(min(self.frequent, len(self.words)), RARE_CLASSES + 1)

    @property
    def numbers(self) -> np.ndarray:
        """The model's number of each word: its rank, or its class among the rarer ones.

        Classes of rarer words have about equal shares of the tokens; the last class is that of
        all words outside the dictionary.
        """
        known = self.layout.frequent
        rare = self.counts[known:].astype(np.float64)
        middle = (np.cumsum(rare) - rare / 2) / max(rare.sum(), 1)
        classes = np.minimum((middle * RARE_CLASSES).astype(np.int64), RARE_CLASSES - 1)
        return np.concatenate([np.arange(known), known + classes]).astype(np.int32)

    @property
    def outside(self) -> int:
        """The number of words that are not in the dictionary."""
        return self.layout.inputs - 1

    @property
    def weights(self) -> np.ndarray:
        """Tokens per number of the model; one for words never met."""
        weights = np.bincount(self.numbers, weights=self.counts, minlength=self.layout.inputs)
        weights[self.outside] = self.tokens - self.counts.sum() + 1
        return weights

    @property
    def log_in_class(self) -> np.ndarray:
        """Logarithm of each word's share of its class; 0 for words with a softmax of their own."""
        shares = np.log(self.counts / self.weights[self.numbers]) if len(self.words) else np.zeros(0)
        shares[: self.layout.frequent] = 0
        return shares

    @property
    def outside_size(self) -> int:
        """What shares among the words outside are divided by: their tokens, their number, one for new words."""
        return int(self.tokens - self.counts.sum()) + self.distinct - len(self.words) + 1


def _bucket(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * BUCKETS_PER_OCTAVE)


def _in_dictionary(least: int | None) -> Column:
    if least is None:
        return F.col("word") == F.lit(END)
    return (F.col("word") == F.lit(END)) | ((_bucket(F.col("n")) >= least) & (F.octet_length("word") <= LONGEST_WORD))


def learn_vocabulary(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The dictionary, and the counts of the words outside it."""
    sizes = counts.groupBy(_bucket(F.col("n")).alias("bucket")).agg(
        F.sum("n").alias("tokens"), F.count("*").alias("distinct"), F.count_if(F.octet_length("word") <= LONGEST_WORD).alias("short")
    )
    rows = sorted(sizes.collect(), key=lambda r: -r["bucket"])
    least, words = None, 1
    for r in rows:
        words += r["short"]
        if words > DICTIONARY_WORDS:
            break
        least = r["bucket"]
    known = counts.where(_in_dictionary(least)).collect() if rows else []
    known = sorted(((bytes(r["word"]), r["n"]) for r in known), key=lambda w: (-w[1], w[0]))
    vocabulary = Vocabulary(
        sum(r["tokens"] for r in rows),
        sum(r["distinct"] for r in rows),
        [w for w, _ in known],
        np.array([n for _, n in known], np.int64),
        FREQUENT_WORDS,
    )
    return vocabulary, counts.where(~_in_dictionary(least))


class _Task:
    """What a Python worker makes once of the parts that the driver sent."""

    made: dict[int, _Task] = {}

    def __init__(self, words: bytes, counts: np.ndarray, *sizes: int) -> None:
        tokens, distinct, frequent = sizes
        self.vocabulary = v = Vocabulary(tokens, distinct, words.split(b" ") if len(counts) else [], counts, frequent)
        self.words = pa.array(v.words, pa.binary())
        self.end = v.words.index(END) if END in v.words else len(v.words)
        self.number_of = np.append(v.numbers, v.outside).astype(np.int32)
        self.layout = v.layout

    @classmethod
    def of(cls, sent) -> _Task:
        if sent.id not in cls.made:
            cls.made.clear()
            cls.made[sent.id] = cls(*sent.value)
        return cls.made[sent.id]

    def ranks_of(self, tokens: Tokens) -> np.ndarray:
        """The rank of each token; those outside the dictionary have the rank behind its last."""
        found = pc.index_in(tokens.words, value_set=self.words.cast(tokens.words.type))
        return tokens.with_ends(pc.fill_null(found, len(self.words)).to_numpy(), self.end)


class _Sent:
    """A broadcast with a number that survives its way to the tasks."""

    def __init__(self, spark, value) -> None:
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _train_round(texts: DataFrame, sent: _Sent, parameters: gru.Arrays) -> gru.Arrays | None:
    """The mean of the parameters of all tasks, weighed by their tokens; None without texts."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task.of(sent)
        trainer = gru.Trainer(task.layout, parameters)
        for batch in batches:
            for part in _groups(batch, "text", GROUP_BYTES):
                tokens = Tokens.of(part.column("text"))
                numbers, lengths = task.number_of[task.ranks_of(tokens)], tokens.lengths
                del tokens
                pa.default_memory_pool().release_unused()
                trainer.train(numbers, lengths)
        if trainer.seen:
            values = gru.flat(trainer.p)
            blocks = [values[low : low + BLOCK_VALUES].tobytes() for low in range(0, len(values), BLOCK_VALUES)]
            n = len(blocks)
            columns = [[TaskContext.get().partitionId()] * n, list(range(n)), [trainer.seen] * n, blocks]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            names = ["trainer", "block", "weight", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("trainer")
        total = int(rows["weight"].sum())
        merged = sum(np.frombuffer(d, np.float32).astype(np.float64) * (w / total) for d, w in zip(rows["data"], rows["weight"]))
        return pd.DataFrame({"block": rows["block"].iloc[:1], "data": [merged.astype(np.float32).tobytes()]})

    parts = texts.coalesce(TRAINERS).mapInArrow(train, "trainer int, block int, weight long, data binary")
    merged = parts.groupBy("block").applyInPandas(mean, "block int, data binary").collect()
    if not merged:
        return None
    vector = np.concatenate([np.frombuffer(r["data"], np.float32) for r in sorted(merged, key=lambda r: r["block"])])
    return gru.unflat(vector, parameters)


def train(texts: DataFrame, vocabulary: Vocabulary, sent: _Sent) -> gru.Arrays:
    """Parameters after ``ROUNDS`` rounds, which together take every text once.

    A text's round follows from its bytes alone.
    """
    parameters = gru.initial(vocabulary.layout, vocabulary.weights)
    part = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    for number in range(ROUNDS):
        parameters = _train_round(texts.where(part == number), sent, parameters) or parameters
    return parameters


_SCORED = "row long, n_tokens long, n_inside long, log_counts double, log_model double, outside array<struct<word: binary, n: long>>"


def _beyond(tokens: Tokens, outside: np.ndarray) -> pa.Array:
    """For each text, its different words among those ``outside`` and how often each stands there."""
    places = np.flatnonzero(outside)
    number = tokens.with_ends(np.arange(len(tokens.words)), len(tokens.words))[places]
    every = pa.concat_arrays([tokens.words.cast(pa.binary()), pa.array([END], pa.binary())])
    found = pc.dictionary_encode(every.take(pa.array(number)))
    kinds = max(1, len(found.dictionary))
    texts = np.searchsorted(np.cumsum(tokens.lengths), places, "right")
    pairs, times = np.unique(texts * kinds + found.indices.to_numpy(), return_counts=True)
    starts = np.searchsorted(pairs, np.arange(len(tokens.lengths) + 1) * kinds)
    words = found.dictionary.take(pa.array(pairs % kinds))
    structs = pa.StructArray.from_arrays([words, pa.array(times, pa.int64())], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), structs)


def _score(columns: list[str], sent: _Sent, parameters: gru.Arrays, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task.of(sent)
        model = gru.Model(task.layout, parameters)
        v = task.vocabulary
        log_counts = np.append(np.log10(v.counts + 1.0), 0.0)
        in_class = np.append(v.log_in_class, 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in (part for batch in batches for part in _groups(batch, "__text", GROUP_BYTES)):
            tokens = Tokens.of(batch.column("__text"))
            together, lengths = task.ranks_of(tokens), tokens.lengths
            beyond = _beyond(tokens, together == len(v.words))
            del tokens
            pa.default_memory_pool().release_unused()
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            inside = np.add.reduceat((together < len(v.words)).astype(np.int64), starts)
            logs = model.score(task.number_of[together], lengths) + np.add.reduceat(in_class[together], starts)
            found = [
                pa.array(row + np.arange(len(batch))),
                pa.array(lengths.astype(np.int64)),
                pa.array(inside),
                pa.array(np.add.reduceat(log_counts[together], starts)),
                pa.array(logs / np.log(10)),
                beyond,
            ]
            row += len(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *found], names)

    return score


def score(df: DataFrame, text: str, learned_from: Column) -> DataFrame:
    """``df`` without its text, as struct ``row``, with ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``.

    ``learned_from`` tells which rows the counts and the model learn from.  ``base_score`` is
    the sum over a text's tokens of log10((c + 1) / (N + V + 1)), ``score`` the model's log10
    probability of the whole text: that of each token's class, times that of the token in it.
    Words outside the dictionary share a class by (c + 1), words never met as one word.

    A null text is an empty one: its end is its only token.  Where nothing is learned from,
    every score is 0.  An empty table gives no rows.  Repeated rows are learned from and scored
    each; long texts are scored from their first to their last word in windows; other columns
    come back in ``row``, whatever their names.
    """
    spark = df.sparkSession
    learning = df.where(learned_from).select(_bytes(F.col(f"`{text}`")).alias("text"))
    counts = stored(count_words(learning), "word-counts")
    vocabulary, rare = learn_vocabulary(counts)
    sizes = (vocabulary.tokens, vocabulary.distinct, vocabulary.frequent)
    sent = _Sent(spark, (b" ".join(vocabulary.words), vocabulary.counts, *sizes))
    parameters = train(learning, vocabulary, sent)

    others = [c for c in df.columns if c != text]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"), _bytes(F.col(f"`{text}`")).alias("__text"))
    kind = rows.schema["__row"].dataType.simpleString()
    names = ["__row", *[part.split()[0] for part in _SCORED.split(", ")[:6]]]
    scored = stored(rows.mapInArrow(_score(["__row"], sent, parameters, names), f"__row {kind}, {_SCORED}"), "scored")

    beyond = scored.select("row", F.explode("outside").alias("o")).select("row", "o.word", F.col("o.n").alias("times"))
    met = skewed_join(beyond, rare, ["word"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Sums of decimals do not depend on their order.
    log_count = F.log10(F.col("n") + F.lit(1.0)).cast("decimal(20,16)")
    sums = met.groupBy("row").agg(
        F.sum(F.col("times") * log_count).cast("double").alias("log_outside"),
        F.sum("times").alias("n_outside"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known_outside"),
    )
    none = F.lit(0).cast("long")
    log_outside, n_outside = F.coalesce("log_outside", F.lit(0.0)), F.coalesce("n_outside", none)
    base = F.col("log_counts") + log_outside - F.col("n_tokens") * F.log10(F.lit(float(vocabulary.tokens + vocabulary.distinct + 1)))
    model = F.col("log_model") + log_outside - n_outside * F.log10(F.lit(float(vocabulary.outside_size)))
    return scored.join(sums, "row", "left").select(
        F.col("__row").alias("row"),
        "n_tokens",
        (F.col("n_inside") + F.coalesce("n_known_outside", none)).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model.alias("score"),
    )
