"""Hidden Markov language model, trained by Baum-Welch over all training texts.

The hidden chain emits word classes, ``CLASSES`` of them by word hash, and one
more symbol for the end; a class then emits its word by add-one counts:

    P(text) = P_hmm(classes) * product of P(word | class),
    P(word | class) = (c(word) + 1) / (tokens of class + words of class + 1)

so the vocabulary is open, the model's size is fixed, and the likelihood is
exact. The first factor comes from the scaled forward recursion, whole texts at
a time; the second doesn't depend on order, and its numerators are those of the
base score.

1. Counts: tasks add up words and send one row a word and batch; a partial
   aggregation sums them. Nothing of the vocabulary reaches the driver.
2. Baum-Welch: texts are written once as class sequences (2 bytes a token). Each
   iteration, tasks run forward and backward over their sequences and send
   expected counts, which are added up by column before they reach the driver
   (``states * CLASSES`` numbers, whatever the input). Rounds go on until one
   gains less than ``tolerance`` a token.
3. Scores: words among the ``HEAD`` most frequent are looked up in a broadcast
   table of at most that many rows. All other words of a text go, once each with
   their number, to a join with the counts.

Defined results: null and empty texts are the end alone; without training texts
all counts are 0, N is 0 and the chain keeps its start values; rows with a null
id count as crc32 of the empty text (0: they train); rows that share an id are
told apart by text, and equal rows repeat; other columns are not read. Words are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecraft.llm.common import as_hash, as_long, crc32_of_id, hash_words, ship_by_value, text_slices, written

STATES = 4
CLASSES = 1 << 14
#: Training ends with the first round whose model gains less than this in the
#: log10 likelihood a training token. That likelihood is never above 0, so
#: training ends without a limit on rounds.
TOLERANCE = 0.01
HEAD = 1 << 17
SEED = 20_240_603
#: The end's place among words (a hash that no word is given).
END = np.uint64(0)
#: Words that a task adds up before it sends them.
COUNTED = 1 << 19
#: Tokens of a row of class sequences. The sequences of a row advance together,
#: so those above ``LONG`` tokens have rows of their own.
PACK = 1 << 20
LONG = 2048
#: Chance to stay in a state that training starts from.
STAY = 0.99
#: Start of the classes' and transitions' counts (Dirichlet).
PRIOR = 0.1


def _words(b):
    """Per slice: first row, last row + 1, word hashes, first word of each row."""
    for lo, hi, data, off in text_slices(b.column("text")):
        h, _, woff = hash_words(data, off, lower=True)
        h[h == END] = np.uint64(1)
        yield lo, hi, h, woff


def _count(batches):
    held, size = [], 0

    def flush():
        word, n = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        total = np.bincount(n, np.concatenate([y for _, y in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(as_long(word)), pa.array(total)], names=["word", "n"])

    for b in batches:
        train = b.column("train").to_numpy(zero_copy_only=False)
        for lo, hi, h, woff in _words(b):
            use = train[lo:hi]
            word, n = np.unique(h[np.repeat(use, np.diff(woff))], return_counts=True)
            held.append((np.append(word, END), np.append(n, int(use.sum()))))
            size += len(word) + 1
            if size > COUNTED:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the training texts, the end included."""
    return rows.select("train", "text").mapInArrow(_count, "word long, n long") \
        .groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")


def class_of(h: np.ndarray) -> np.ndarray:
    """The end has the last class to itself."""
    return np.where(h == END, CLASSES, (h >> np.uint64(64 - 14)).astype(np.int64))


def _pack(batches):
    part, seq, held, size = TaskContext.get().partitionId(), 0, {False: [], True: []}, {False: 0, True: 0}

    def row(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
             pa.array([[k for k, _, _ in rows]], pa.list_(pa.int64())),
             pa.array([np.array([t for _, t, _ in rows], bool).tobytes()], pa.binary()),
             pa.array([np.array([len(s) for _, _, s in rows], np.int64).tobytes()], pa.binary()),
             pa.array([np.concatenate([s for _, _, s in rows]).astype(np.uint16).tobytes()], pa.binary())],
            names=["part", "seq", "keys", "train", "sizes", "classes"])

    for b in batches:
        key, train = b.column("key").to_numpy(), b.column("train").to_numpy(zero_copy_only=False)
        for lo, hi, h, woff in _words(b):
            cls = class_of(h)
            for i in range(lo, hi):
                s = np.append(cls[woff[i - lo]:woff[i - lo + 1]], CLASSES)
                long = len(s) > LONG
                if held[long] and size[long] + len(s) > PACK:
                    yield row(held[long])
                    held[long], size[long], seq = [], 0, seq + 1
                held[long].append((int(key[i]), bool(train[i]), s))
                size[long] += len(s)
    for rows in held.values():
        if rows:
            yield row(rows)
            seq += 1


def _sequences(r):
    size = np.frombuffer(r["sizes"], np.int64)
    cls = np.frombuffer(r["classes"], np.uint16).astype(np.int64)
    return size, cls, np.concatenate([[0], np.cumsum(size)])


def _in_step(size, off):
    """Sequences longest first, and for each step how many are that long."""
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    return order, off[:-1][order], live


def forward(model, size, cls, off):
    """(log10 likelihood of each sequence, scaled forward rows by token)."""
    start, move, emit = model
    order, at, live = _in_step(size, off)
    alpha = np.empty((len(cls), len(start)))
    scale = np.empty(len(cls))
    a, ones = None, np.ones(len(start))
    for t, n in enumerate(live.tolist()):
        i = at[:n] + t
        a = (start if t == 0 else a[:n] @ move) * emit.take(cls.take(i), axis=0)
        s = a @ ones
        a /= s[:, None]
        alpha[i] = a
        scale[i] = s
    logs = np.add.reduceat(np.log10(scale), off[:-1]) if len(size) else np.zeros(0)
    return logs, alpha, scale


def expected(model, size, cls, off):
    """Expected counts of starts, moves and emissions (Baum-Welch's E step)."""
    start, move, emit = model
    k = len(start)
    logs, alpha, scale = forward(model, size, cls, off)
    order, at, live = _in_step(size, off)
    gamma = np.empty_like(alpha)
    moves = np.zeros((k, k))
    n_all = len(size)
    beta = np.ones((n_all, k))
    back = np.ascontiguousarray(move.T)
    weight = emit.take(cls, axis=0) / scale[:, None]
    live, inner = live.tolist(), 0
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        i = at[:n] + t
        if inner:  # sequences with a token after this one
            after = weight.take(i[:inner] + 1, axis=0)
            after *= beta[:inner]
            moves += alpha.take(i[:inner], axis=0).T @ after
            beta[:inner] = after @ back
        gamma[i] = beta[:n]
        inner = n
    gamma *= alpha
    moves *= move
    emits = np.stack([np.bincount(cls, gamma[:, s], minlength=CLASSES + 1) for s in range(k)], axis=1)
    starts = gamma[off[:-1]].sum(axis=0) if n_all else np.zeros(k)
    return starts, moves, emits, float(logs.sum()), int(size.sum())


def _expect(model):
    """One row a part of the expected counts, summed over the task's sequences."""
    def run(batches):
        total = None
        for b in batches:
            for r in b.to_pylist():
                size, cls, off = _sequences(r)
                train = np.frombuffer(r["train"], bool)
                if not train.any():
                    continue
                keep = np.repeat(train, size)
                size = size[train]
                off = np.concatenate([[0], np.cumsum(size)])
                got = expected(model.value, size, cls[keep], off)
                vector = np.concatenate([got[0], got[1].ravel(), got[2].ravel(), got[3:]])
                total = vector if total is None else total + vector
        if total is not None:
            parts = np.array_split(total, 16)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(16, dtype=np.int32)),
                                              pa.array([p.tobytes() for p in parts], pa.binary())], names=["slot", "v"])

    return run


def _add(batches):
    total = {}
    for b in batches:
        for r in b.to_pylist():
            v = np.frombuffer(r["v"])
            total[r["slot"]] = total[r["slot"]] + v if r["slot"] in total else v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                      pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slot", "v"])


def _starting_model(states: int):
    rng = np.random.default_rng(SEED)
    start = np.full(states, 1 / states)
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    emit = rng.gamma(1.0, 1.0, (CLASSES + 1, states)) + 0.1
    return start, move, emit / emit.sum(axis=0)


def baum_welch(sequences: DataFrame, states: int = STATES, tolerance: float = TOLERANCE):
    """The model (start, move, emit) and the log10 likelihood a token of the
    training texts before each round; the last round gained less than
    ``tolerance`` over the one before it."""
    sc = sequences.sparkSession.sparkContext
    model, history = _starting_model(states), []
    while len(history) < 2 or history[-1] - history[-2] >= tolerance:
        parts = sequences.select("train", "sizes", "classes").mapInArrow(_expect(sc.broadcast(model)), "slot int, v binary")
        # The sums of a slot meet in two steps, so no task adds up all tasks' rows.
        parts = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("slot", "lane") \
            .select("slot", "v").mapInArrow(_add, "slot int, v binary")
        rows = parts.repartition("slot").mapInArrow(_add, "slot int, v binary").collect()
        if not rows:
            break
        total: dict[int, np.ndarray] = {}
        for r in rows:
            total[r.slot] = total.get(r.slot, 0) + np.frombuffer(r.v)
        v = np.concatenate([total[i] for i in range(16)])
        k = states
        start = v[:k] + PRIOR
        move = v[k:k + k * k].reshape(k, k) + PRIOR
        emit = v[k + k * k:-2].reshape(CLASSES + 1, k) + PRIOR
        model = start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
        history.append(v[-2] / max(v[-1], 1))
    return model, history


def _chain(model, below):
    """log10 of each sequence's chain, less the log10 of its classes' sizes."""
    def run(batches):
        m, size_of = model.value, np.log10(below.value)
        for b in batches:
            for r in b.to_pylist():
                size, cls, off = _sequences(r)
                logs = forward(m, size, cls, off)[0] - np.add.reduceat(size_of[cls], off[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(r["keys"], pa.int64()), pa.array(logs)], names=["key", "chain"])

    return run


def _lookup(head):
    """A row a text: its tokens, and what the head words add; then a row for
    each of its other words."""
    names = ["key", "word", "tf", "n_tokens", "n_known", "logs"]

    def run(batches):
        word, logs = head.value
        for b in batches:
            key = b.column("key").to_numpy()
            for lo, hi, h, woff in _words(b):
                n = hi - lo
                doc = np.repeat(np.arange(n), np.diff(woff))
                at = np.minimum(np.searchsorted(word, h), max(len(word) - 1, 0))
                found = (word[at] == h) if len(word) else np.zeros(len(h), bool)
                value = np.bincount(doc[found], logs[at[found]], minlength=n).astype(np.float64)
                known = np.bincount(doc[found], minlength=n)
                order = np.lexsort((h[~found], doc[~found]))
                d, w = doc[~found][order], h[~found][order]
                cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])) if len(d) else \
                    np.zeros(0, np.int64)
                tf = np.diff(np.append(cut, len(d)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[lo:hi]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                     pa.array(np.diff(woff) + 1), pa.array(known), pa.array(value)], names=names)
                m = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[lo:hi][d[cut]]), pa.array(as_long(w[cut])), pa.array(tf),
                     pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())], names=names)

    return run


def hmm_scores(docs: DataFrame, held_out: int = 2, folds: int = 7, states: int = STATES,
               tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"),
        (crc32_of_id("doc_id") % folds != held_out).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    counts = written(word_counts(rows), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"),
                       F.max(F.when(F.col("word") == 0, F.col("c"))).alias("e")).first()
    n, v, ends = total.n or 0, total.v, total.e or 0

    # The most frequent words: from the lowest count that leaves at most HEAD.
    many = counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).limit(HEAD).collect()
    least, room = None, HEAD
    for r in many:
        room -= r.words
        if room < 0:
            break
        least = r.c
    top = counts.where(F.col("c") >= least).collect() if least is not None else []
    word = as_hash(np.array([r.word for r in top], np.int64)) if top else np.zeros(0, np.uint64)
    c = np.array([r.c for r in top], np.float64)
    order = np.argsort(word)
    head = sc.broadcast((word[order], np.log10(c[order] + 1)))

    # Tokens and words of each class: at most CLASSES rows.
    below = np.ones(CLASSES + 1)
    of = F.shiftrightunsigned("word", 64 - 14)
    for r in counts.where("word <> 0").groupBy(of.alias("k")).agg((F.sum("c") + F.count("*")).alias("d")).collect():
        below[r.k] += r.d
    below[CLASSES] = 1.0  # its only word is the end
    sequences = written(rows.select("key", "train", "text").mapInArrow(
        _pack, "part int, seq int, keys array<bigint>, train binary, sizes binary, classes binary"), "sequences")
    model, _ = baum_welch(sequences, states, tolerance)
    chain = sequences.mapInArrow(_chain(sc.broadcast(model), sc.broadcast(below)), "key long, chain double")

    looked = rows.select("key", "text").mapInArrow(
        _lookup(head), "key long, word long, tf long, n_tokens long, n_known long, logs double")
    looked = written(looked, "words")
    tail = counts if least is None else counts.where(F.col("c") < least)
    rare = looked.where("word is not null").select("key", "word", "tf").join(tail, "word") \
        .select("key", (F.col("tf") * F.log10(F.col("c") + 1)).alias("logs"), F.col("tf").alias("n_known"))
    def parts(df, **has):
        columns = {"n_tokens": "long", "n_known": "long", "logs": "double", "chain": "double"}
        return df.select("key", *[has.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()],
                         F.lit(int("n_tokens" in has)).alias("one"))

    # Rows of equal key are equal: each sum is right after division by their number.
    n_known, logs = F.col("n_known"), F.col("logs")
    per = parts(looked.where("word is null"), n_tokens=F.col("n_tokens"), n_known=n_known, logs=logs) \
        .unionByName(parts(rare, n_known=n_known, logs=logs)) \
        .unionByName(parts(chain, chain=F.col("chain")))
    per = per.groupBy("key").agg(
        F.max("n_tokens").alias("n_tokens"), (F.sum("n_known") / F.sum("one")).cast("long").alias("n_known"),
        (F.sum("logs") / F.sum("one")).alias("logs"), F.max("chain").alias("chain"))
    log_end = float(np.log10(ends + 1))
    smooth = float(np.log10(n + v + 1))
    # Of the end, P(end | class) is 1; its count matters to the base score only.
    out = rows.select("doc_id", "key", (~F.col("train")).alias("held_out")).join(per, "key")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + log_end - F.col("n_tokens") * smooth).alias("base_score"),
        (F.col("chain") + F.col("logs")).alias("score"))


ship_by_value(__name__)
