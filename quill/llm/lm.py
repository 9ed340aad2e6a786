"""LM scoring with a gated recurrent network trained by truncated
backpropagation, a class-factored softmax and state carried through documents.

Words are runs of anything but blanks, A-Z lower-cased; every document ends in
one end token. All training documents take part in all of the following:

1. Counts: every task sums its words before the shuffle; the table (token, n)
   has every distinct token and is never gathered whole.
2. Vocabulary: the ``KNOWN`` most frequent tokens (a bounded broadcast). The
   first ``HEADS * WORDS`` are predicted by class and word; all other tokens,
   known or not, by a class of similar endings and their share of the class,
   (count + 0.5) / (sum over the class + 0.5), which leaves room for one
   unseen token per class. So the model is a distribution over all tokens.
3. Weights: rounds over growing disjoint parts of the documents. In a round
   every task trains its own copy on its rows; the copies' mean, weighted by
   tokens, is summed up in levels of ``FAN`` and starts the next round. Every
   corpus is gone through the same number of times.
4. Scores: each document is scored whole. Counts of tokens outside the
   vocabulary reach their documents by a join on the token; none of them is
   frequent, because the frequent ones are all in the vocabulary.

Defined results: NULL and empty texts consist of the end token; NULL or equal
ids are rows of their own; without training documents every count is zero and
N and V are zero; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .gru import DOC, FIRST, LAST, Adam, C, Net, Shape, W, fit, windows

END = b"\n"  # no word holds a blank
KNOWN = 1 << 18
FREQUENT = 1 << 15  # tokens of them that training looks up
HEADS, WORDS = 128, 64
TAILS = 64  # classes of all other tokens
ENDINGS = 512  # input ids of all other tokens, by their last three bytes
HIDDEN = 16
FAN = 32
BLOCK = 1 << 20  # bytes of text worked on at once
LOOKED_UP = 1 << 22  # bytes of text whose words are looked up among all known at once
LANES = 512  # documents that take a step together
COUNTED = 1 << 24  # bytes of text whose words are counted at once
ROUNDS = ((0, 1), (1, 4), (4, 16))  # parts of 16


def split_words(column) -> tuple[pa.Array, np.ndarray]:
    """All words of an Arrow text column in one array, and each text's number of
    them. Arrow lower-cases A-Z and splits at the six blanks, without a Python
    object per word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    some = pc.not_equal(pc.binary_length(flat), 0)  # blanks at a text's ends leave empty pieces
    before = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
    at = offsets - offsets[0]
    return flat.filter(some), before[at[1:]] - before[at[:-1]]


def long_first(batches, column: int, block: int | None = None):
    """Slices of each Arrow batch, the longest texts first: lanes end together."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()
        yield from slices(b.take(pa.array(np.argsort(-size, kind="stable"))), column, block or BLOCK)


# 1. counts ------------------------------------------------------------------

def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token binary, n): every distinct token of the texts, end tokens too."""
    def run(batches):
        for part in (p for b in batches for p in slices(b, 0, COUNTED)):
            distinct = split_words(part.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([distinct.field("values").cast(pa.binary()), pa.array([END], pa.binary())]),
                 pa.concat_arrays([distinct.field("counts").cast(pa.int64()), pa.array([part.num_rows], pa.int64())])],
                names=["token", "n"])

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n long")
            .groupBy("token").agg(F.sum("n").alias("n")))


def most_frequent(counts: DataFrame, known: int) -> tuple[list[bytes], np.ndarray]:
    """The ``known`` most frequent tokens, ties by token; at most these and
    those of one narrow band of counts meet in a task."""
    band = F.floor(F.log2("n") * 16)
    bands = sorted(counts.groupBy(band.alias("b")).count().collect(), reverse=True)  # at most 16 * 64 rows
    total, least = 0, 0
    for r in bands:
        total, least = total + r["count"], r["b"]
        if total >= known:
            break
    top = (counts.where(band >= least).orderBy(F.desc("n"), "token").limit(known)).toPandas()
    return [bytes(t) for t in top["token"]], top["n"].to_numpy(np.int64)


# 2. vocabulary ----------------------------------------------------------------

class Vocabulary:
    """Ids and classes of tokens. Known tokens come from arrays, others from
    their endings."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray):
        if END not in tokens:
            tokens, counts = [*tokens, END], np.r_[counts, 0]
        self.tokens, self.counts = tokens, counts
        self.logc = np.log10(counts + 0.5)
        self.end = tokens.index(END)
        head = sorted(range(min(HEADS * WORDS, len(tokens))), key=lambda i: tokens[i][::-1])  # like endings are neighbours
        rest = sorted(range(len(head), len(tokens)), key=lambda i: tokens[i][-4:][::-1])
        mass = np.cumsum(counts[rest]) if rest else np.zeros(0)
        at = np.searchsorted(mass, mass[-1] * np.arange(1, TAILS) / TAILS) if rest else []
        self.cuts = [tokens[rest[i]][-4:][::-1] for i in at]
        self.xcw = np.full((len(tokens), 3), -1, np.int32)  # input id, class, place in it
        for k, i in enumerate(head):
            self.xcw[i] = k, k // WORDS, k % WORDS
        for i in range(len(head), len(tokens)):
            self.xcw[i, :2] = self.ending(tokens[i])
        self.c, self.w = self.xcw[:, 1], self.xcw[:, 2]
        self._values = self._ends = None

    def ending(self, token: bytes) -> tuple[int, int]:
        """Input id and class of a token that is not among the first."""
        return (HEADS * WORDS + zlib.crc32(token[-3:]) % ENDINGS, HEADS + bisect_right(self.cuts, token[-4:][::-1]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, d):
        self.__dict__.update(d, _values=None, _ends=None)

    def read(self, column, learn: bool = False):
        """Texts as the network reads them: (tokens, 6) with end tokens, the
        place of each text's end, the tokens' ids (-1: unknown), the unknown
        tokens, and each text's number of them. Training (``learn``) needs no
        counts: only the most frequent tokens are looked up."""
        if self._values is None:
            every = pa.array(self.tokens, pa.string())
            self._values, self._ends = {True: every[:max(FREQUENT, HEADS * WORDS)], False: every}, {}
        flat, n = split_words(column)
        ids = pc.fill_null(pc.index_in(flat, value_set=self._values[learn]), -1).to_numpy()
        ends = np.cumsum(n + 1) - 1
        total = int(ends[-1]) + 1
        at = np.ones(total, bool)
        at[ends] = False
        every = np.full(total, self.end, np.int32)
        every[at] = ids
        out = np.zeros((total, 6), np.int32)
        out[:, :3] = self.xcw.take(every, axis=0, mode="clip")
        odd = flat.filter(pa.array(ids < 0)).cast(pa.binary())
        places = np.flatnonzero(every < 0)
        if len(places):
            endings = pc.binary_slice(odd, -4, None).dictionary_encode()
            if len(self._ends) > 1 << 18:
                self._ends.clear()
            xc = []
            for e in endings.dictionary.to_pylist():
                if e not in self._ends:
                    self._ends[e] = self.ending(e)
                xc.append(self._ends[e])
            out[places, :2] = np.array(xc, np.int32)[endings.indices.to_numpy()]
            out[places, W] = -1
        out[ends - n, FIRST] = out[ends, LAST] = 1
        unknown = np.diff(np.r_[0, np.cumsum(every < 0)[ends]])
        return out, ends, every, odd, unknown

    def texts(self, column):
        """Each text's tokens, for training."""
        out, ends, *_ = self.read(column, True)
        return np.split(out, ends[:-1] + 1)


def class_sums(counts: DataFrame, vocab) -> np.ndarray:
    """Sum of count + 0.5 over the tokens of each class, and 0.5 for one unseen."""
    def run(batches):
        v = vocab.value
        first = [v.tokens[i] for i in np.flatnonzero(v.w >= 0)]
        z, classes = np.zeros(HEADS + TAILS), {}
        for b in batches:
            tail = pc.invert(pc.is_in(b.column(0), pa.array(first, b.column(0).type)))
            ends = [t[-4:] for t in b.column(0).filter(tail).to_pylist()]
            for e in set(ends):
                if e not in classes:
                    classes[e] = v.ending(e)[1]
            c = np.fromiter(map(classes.__getitem__, ends), np.int64, len(ends))
            z += np.bincount(c, b.column(1).filter(tail).to_numpy() + 0.5, minlength=len(z))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(z)), pa.int32()), pa.array(z)], names=["c", "z"])

    got = counts.select("token", "n").mapInArrow(run, "c int, z double").groupBy("c").agg(F.sum("z").alias("z")).collect()
    z = np.full(HEADS + TAILS, 0.5)
    for r in got:
        z[r.c] += r.z
    return z


# 3. weights -------------------------------------------------------------------

def trained(docs: DataFrame, text_col: str, vocab, shape: Shape, flat: np.ndarray, rate: float) -> np.ndarray:
    """The mean of the weights that the tasks trained from ``flat`` on their rows."""
    start = docs.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        v, mine = vocab.value, start.value.copy()
        _, n = fit(mine, shape, (t for part in long_first(batches, 0) for t in v.texts(part.column(0))), Adam(len(mine), rate))
        if n:
            yield blob(mine, n)

    def blob(mean, n):
        return pa.RecordBatch.from_arrays([pa.array([mean.astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())],
                                          names=["mean", "n"])

    def add(batches):
        total, n = 0, 0
        for b in batches:
            for raw, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total, n = total + np.frombuffer(raw, np.float32) * float(k), n + k
        if n:
            yield blob(total / n, n)

    rows = docs.select(F.col(text_col).alias("text"))
    tasks = rows.rdd.getNumPartitions()
    means = rows.mapInArrow(run, "mean binary, n long")
    while tasks > 1:  # the driver gets one vector
        tasks = -(-tasks // FAN)
        means = means.repartition(tasks).mapInArrow(add, "mean binary, n long")
    got = means.first()
    start.destroy()
    return np.frombuffer(got["mean"], np.float32) if got else flat


@dataclass
class Model:
    vocab: object  # broadcast Vocabulary
    counts: DataFrame  # (token, n) of tokens outside the vocabulary
    shape: Shape
    weights: np.ndarray
    sums: np.ndarray  # per class
    tokens: int  # N
    distinct: int  # V


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", known: int = KNOWN, hidden: int = HIDDEN,
          rate: float = 0.01, max_epochs: int = 2) -> Model:
    """Learn from all rows of ``docs``, gone through ``max_epochs`` times
    whatever their number."""
    sc = docs.sparkSession.sparkContext
    counts = written(token_counts(docs, text_col), "counts")
    size = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    n = size.n or 0
    tokens, freq = most_frequent(counts, known)
    vocab = sc.broadcast(Vocabulary(tokens, freq))
    v, sums = vocab.value, class_sums(counts, vocab)
    word_mass = np.zeros((HEADS, WORDS))
    first = np.flatnonzero(v.w >= 0)
    word_mass[v.c[first], v.w[first]] = v.counts[first]
    mass = sums.copy()
    mass[:HEADS] = word_mass.sum(1)
    shape = Shape(HEADS * WORDS + ENDINGS, hidden, HEADS + TAILS, HEADS, WORDS)
    flat = shape.initial(mass, word_mass)
    part = F.pmod(F.xxhash64(F.lit("round"), F.col(id_col), F.col(text_col)), F.lit(16))
    for epoch in range(max_epochs):
        for i, (a, b) in enumerate(ROUNDS):
            flat = trained(docs.where((part >= a) & (part < b)), text_col, vocab, shape, flat, rate / (1 + epoch + i))
    last = (freq[-1], tokens[-1]) if len(tokens) >= known else (0, b"")
    rare = counts.where((F.col("n") < F.lit(int(last[0]))) | ((F.col("n") == F.lit(int(last[0]))) & (F.col("token") > F.lit(last[1]))))
    return Model(vocab, rare, shape, flat, sums, n, size.v)


# 4. scores --------------------------------------------------------------------

def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): base-10
    logarithms of each whole text's probability by unigrams and by the model."""
    vocab, shape = model.vocab, model.shape
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    log_class = np.log10(model.sums)
    base = math.log10(model.tokens + 0.5 * (model.distinct + 1))

    def run(batches):
        v, net = vocab.value, Net(shape, weights.value, LANES)
        free, sums, places = [], np.zeros(0), np.zeros(0, np.int64)  # of the documents in the lanes
        facts, done = [], []  # rows to hand on

        def documents():
            nonlocal sums, places
            for part in long_first(batches, 2, LOOKED_UP):
                tokens, ends, known, odd, unknown = v.read(part.column(2))
                numbers, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                starts, have = np.r_[0, ends[:-1] + 1], known >= 0
                share = np.where(have, v.logc[known], 0.0)
                # the fixed shares of tail words; unknown tokens' counts come by the join
                tail = np.add.reduceat(np.where(tokens[:, W] < 0, share - log_class[tokens[:, C]], 0.0), starts)
                base_of = np.add.reduceat(share - base, starts)
                counted = np.add.reduceat((have & (v.counts[known] > 0)).astype(np.int64), starts)
                words, cut = odd.to_pylist(), np.r_[0, np.cumsum(unknown)]
                for k, (a, z) in enumerate(zip(starts, ends, strict=True)):
                    if not free:
                        free.extend(range(len(sums), len(sums) + 4096))
                        sums, places = np.r_[sums, np.zeros(4096)], np.r_[places, np.zeros(4096, np.int64)]
                    i = free.pop()
                    sums[i], places[i] = tail[k], numbers[k]
                    tokens[a:z + 1, DOC] = i
                    bag = Counter(words[cut[k]:cut[k + 1]])
                    facts.append((numbers[k], ids[k], int(z - a) + 1, int(counted[k]), float(base_of[k]), None, list(bag), list(bag.values())))
                    yield tokens[a:z + 1]

        for lane, token, live in windows(documents(), LANES, 64):
            t, logp = net.score(lane, token, live)
            np.add.at(sums, t[:, DOC], logp / math.log(10))
            ended = t[t[:, LAST] == 1, DOC]
            done.extend((int(places[i]), None, None, None, None, float(sums[i]), None, None) for i in ended)
            free.extend(ended.tolist())
            if len(facts) + len(done) > 4096:
                yield table_of(facts + done)
                facts.clear(), done.clear()
        yield table_of(facts + done)

    def table_of(rows):
        cols = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("row", pa.int64()), ("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64()), ("others", pa.list_(pa.binary())),
                        ("times", pa.list_(pa.int64()))])
    own = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
                  .mapInArrow(run, f"row long, doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double, "
                                   "others array<binary>, times array<long>"), "scores")
    facts = own.where("n_tokens IS NOT NULL")
    pairs = facts.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select(
        "row", F.col("o.others").alias("token"), F.col("o.times").alias("k"))
    n = F.coalesce("n", F.lit(0))
    joined = pairs.join(model.counts, "token", "left").select(
        "row", (F.col("k") * F.log10(n + 0.5)).alias("more"), F.when(n > 0, F.col("k")).otherwise(0).alias("also"), F.lit(0.0).alias("score"))
    scores = own.where("score IS NOT NULL").select("row", F.lit(0.0), F.lit(0).cast("long"), "score")
    rest = joined.union(scores).groupBy("row").agg(*[F.sum(c).alias(f"_{c}") for c in ("more", "also", "score")])
    return facts.drop("others", "times", "score").join(rest, "row").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("_also")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("_more")).alias("base_score"),
        (F.col("_score") + F.col("_more")).alias("score"))
