"""Quality classifier: a factorisation machine.

    score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

The second sum holds every pairwise interaction of low rank ``RANK`` in time
linear in the features. Features: the hashed distinct words of the text (equal
weights, norm 1), and one of ``BINS`` bins of each structure statistic (length,
word length, share of capitals, digits, symbols, punctuation and line ends,
distinct words, repeated three-word runs) and of the record's ``n_chars``.
Labels, language, source and id are never features.

Training reads a bounded sample: about ``SAMPLE`` labelled rows of the training
folds, by a hash of the id; all of them when there are fewer. Its features are
computed by tasks; the fit, over at most that many rows, runs on the driver.
Scoring covers every whole text with the model (2.4 MB) broadcast.

Defined results: null and empty texts have no words and are scored by their
statistics; without labels of both kinds every score is the share of good
labels, or 0.5; a document with labels that differ counts as bad; rows with a
null id are scored, and never trained on; null ``n_chars`` has a bin of its own;
repeated rows are scored one by one, and of rows that share an id the one with
the least text hash is trained on; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecraft.llm.common import crc32_of_id, hash_shingles, hash_words, ship_by_value, text_slices

#: Labelled rows that are trained on, at most about.
SAMPLE = 8192
FOLDS = 5
WORDS = 1 << 16
BINS = 16
RANK = 8
EPOCHS = 8
BATCH = 64
SEED = 20_240_602
#: Statistic -> lower edges of its bins.
EDGES = {
    "words": [1, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536],
    "word_bytes": [2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 16],
    "capitals": [.001, .005, .01, .02, .03, .05, .08, .12, .2, .3, .4, .5, .6, .8, .9],
    "digits": [.001, .002, .005, .01, .02, .04, .06, .08, .1, .15, .2, .3, .4, .5, .7],
    "symbols": [.0005, .001, .002, .005, .01, .02, .03, .05, .08, .1, .15, .2, .25, .3, .5],
    "marks": [.001, .005, .01, .015, .02, .03, .04, .06, .08, .1, .15, .2, .3, .4, .6],
    "lines": [.0005, .001, .002, .004, .006, .008, .01, .015, .02, .03, .05, .08, .1, .15, .2],
    "distinct": [.02, .05, .1, .2, .3, .4, .5, .55, .6, .65, .7, .75, .8, .9, .97],
    "repeats": [.002, .005, .01, .02, .05, .1, .15, .2, .3, .4, .5, .6, .7, .8, .9],
    "n_chars": [1, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 262144],
}
N_FEATURES = WORDS + len(EDGES) * BINS
#: Value of a statistic's feature.
STAT = 0.35


def _class_table():
    t = np.zeros((256, 5), np.int64)
    t[ord("A"):ord("Z") + 1, 0] = 1
    t[ord("0"):ord("9") + 1, 1] = 1
    t[[ord(c) for c in "#*$%&|<>{}[]\\^~=+@_/"], 2] = 1
    t[[ord(c) for c in "!?.,;:'\"()-"], 3] = 1
    t[10, 4] = 1
    return t


def _distinct(owner, value, n):
    """(owner, value) pairs once each, sorted, and their number by owner."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return owner, value, np.bincount(owner, minlength=n)


def features(data, off, n_chars):
    """(row, feature, value) of every text of a slice, rows rising."""
    n = len(off) - 1
    h, _, woff = hash_words(data, off, lower=True)
    count = np.diff(woff)
    doc = np.repeat(np.arange(n), count)
    row, word, distinct = _distinct(doc, (h & np.uint64(WORDS - 1)).astype(np.int64), n)
    s, soff = hash_shingles(h, woff, 3)
    runs = np.diff(soff)
    _, _, kinds = _distinct(np.repeat(np.arange(n), runs), (s >> np.uint64(20)).astype(np.int64), n)
    size = np.diff(off)
    share = np.zeros((n, 5))
    sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(_class_table()[data], axis=0)]) if len(data) \
        else np.zeros((1, 5), np.int64)
    share = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(size, 1)[:, None]
    stats = {
        "words": count, "word_bytes": (size - count) / np.maximum(count, 1), "capitals": share[:, 0],
        "digits": share[:, 1], "symbols": share[:, 2], "marks": share[:, 3], "lines": share[:, 4],
        "distinct": distinct / np.maximum(count, 1), "repeats": 1 - kinds / np.maximum(runs, 1),
        "n_chars": n_chars,
    }
    cols = [WORDS + k * BINS + np.searchsorted(edges, np.nan_to_num(stats[name], nan=0.0), "right")
            for k, (name, edges) in enumerate(EDGES.items())]
    rows = np.concatenate([row, np.tile(np.arange(n), len(cols))])
    feats = np.concatenate([word, *cols])
    value = np.concatenate([1 / np.sqrt(distinct[row]), np.full(n * len(cols), STAT)]).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    return rows[order], feats[order].astype(np.int32), value[order]


def _chars(b):
    return b.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)


def _featurise(batches):
    for b in batches:
        chars, label = _chars(b), b.column("label").to_numpy()
        for lo, hi, data, off in text_slices(b.column("text")):
            r, f, v = features(data, off, chars[lo:hi])
            cut = np.searchsorted(r, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[lo:hi]),
                 pa.array([f[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                 pa.array([v[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["label", "f", "v"])


def machine(model, row, feat, value, n):
    """The score of ``n`` rows before the sigmoid, and the sums it is made of."""
    b, w, v = model
    xv = v[feat] * value[:, None]
    total, square = np.zeros((n, RANK), np.float64), np.zeros((n, RANK), np.float64)
    if len(row):
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total[row[at]] = np.add.reduceat(xv, at, axis=0)
        square[row[at]] = np.add.reduceat(xv * xv, at, axis=0)
    linear = np.bincount(row, w[feat] * value, minlength=n).astype(np.float64)
    return b + linear + 0.5 * (total * total - square).sum(axis=1), total


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(label, rows):
    """Logistic loss by AdaGrad over mini-batches, in an order set by ``SEED``."""
    rng = np.random.default_rng(SEED)
    label = np.asarray(label, np.float64)
    w, v = np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, RANK))
    if not len(label) or label.min() == label.max():
        share = label.mean() if len(label) else 0.5
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.log(p / (1 - p)), w.astype(np.float32), np.zeros((N_FEATURES, RANK), np.float32)
    share = label.mean()
    b = np.log(share / (1 - share))
    gb, gw, gv = 1e-8, np.full(N_FEATURES, 1e-8), np.full((N_FEATURES, RANK), 1e-8)
    rate, decay = 0.1, 1e-5
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            size = [len(rows[i][0]) for i in pick]
            row = np.repeat(np.arange(len(pick)), size)
            feat = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            z, total = machine((b, w, v), row, feat, value, len(pick))
            d = (_sigmoid(z) - label[pick]) / len(pick)
            uniq, inv = np.unique(feat, return_inverse=True)
            dx = d[row] * value
            dw = np.bincount(inv, dx, minlength=len(uniq)) + decay * w[uniq]
            each = dx[:, None] * (total[row] - v[feat] * value[:, None])
            dv = np.stack([np.bincount(inv, each[:, k], minlength=len(uniq)) for k in range(RANK)], axis=1) + decay * v[uniq]
            gb += d.sum() ** 2
            b -= rate * d.sum() / np.sqrt(gb)
            gw[uniq] += dw * dw
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            gv[uniq] += dv * dv
            v[uniq] -= rate * dv / np.sqrt(gv[uniq])
    return b, w.astype(np.float32), v.astype(np.float32)


def _score(model):
    def run(batches):
        m = model.value
        for b in batches:
            chars, score = _chars(b), np.zeros(b.num_rows)
            for lo, hi, data, off in text_slices(b.column("text"), 1 << 20):
                r, f, v = features(data, off, chars[lo:hi])
                score[lo:hi] = _sigmoid(machine(m, r, f, v, hi - lo)[0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score)],
                                             names=["doc_id", "held_out", "score"])

    return run


def _fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame):
    """The model (b, w, v), from about ``SAMPLE`` labelled rows off the held-out fold."""
    known = labels.where("quality is not null and doc_id is not null").where(_fold() != 0) \
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
    n = known.count()
    at = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    sample = known.where(at < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))) \
        .select(F.col("doc_id").alias("label_id"), F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")) \
        .join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # about SAMPLE rows of 12 bytes
    # One row an id, whatever its number of rows: the least text hash.
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "n_chars", "text")).alias("one")
    rows = rows.groupBy("doc_id", "label").agg(one).select("doc_id", "label", "one.text", "one.n_chars")
    got = rows.mapInArrow(_featurise, "label int, f binary, v binary").collect()
    got.sort(key=lambda r: (r.f, r.v, r.label))  # the fit must not depend on the tasks' order
    return fit([r.label for r in got], [(np.frombuffer(r.f, np.int32), np.frombuffer(r.v, np.float32)) for r in got])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    held = F.coalesce(crc32_of_id("doc_id") % FOLDS == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text", F.col("n_chars").cast("double").alias("n_chars"))
    scored = rows.mapInArrow(_score(model), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


ship_by_value(__name__)
