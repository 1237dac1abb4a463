"""Operator 2: quality classifier on supervised subword embeddings.

A document is the mean of the vectors of its words and of their character n-grams, all of
them hashed into one table; a softmax over two classes reads the mean. Repetition is made of
ordinary words, so it has three marks with vectors of their own, one for each word equal to
the one before, each three-word window met again and each line met again. Vectors and output
weights are learned together by stochastic gradient descent in numpy.

The model is linear after the mean, so scoring needs the class margin of a word only: the sum
over its features of vector times weight difference. A task computes it once per distinct word.

Fitting uses at most ``most_rows`` labelled documents (``TRAIN_ROWS``), the ones with the
smallest hash, taken from rows that are not held out; everything else covers all rows. A
document without features gets the score of the learned bias.

Defined results: null text is the empty text; a null id counts as held out; an id with
unequal labels is not used for fitting; repeated rows are scored each; without any labelled
row the score is 0.5 everywhere; an empty table gives no rows.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantwatch.llm.arrow import BoundedCache, free_name, map_arrow, texts
from plantwatch.llm.words import mix

TRAIN_ROWS = 3_000
FOLDS = 5
#: Marks of repetition: word, window, line.
MARKS = 3


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 17
    width: int = 10
    shortest: int = 2
    longest: int = 4


@dataclass
class Model:
    """Class margin (label 1 minus label 0) of every feature bucket, and of the bias."""
    shape: Shape
    margin: np.ndarray
    bias: float


_PLACES = np.random.default_rng(17).integers(1, 2**62, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def features(words: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of the character n-grams of ``<word>``, and which word each belongs to.

    All words at once: n-grams are windows over one array of code points.
    """
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    ids = [np.array([zlib.crc32(w) % shape.buckets for w in words], np.int64)]
    whose = [np.arange(len(words))]
    for n in range(shape.shortest, shape.longest + 1):
        m = len(codes) - n + 1
        if m > 0:
            inside = owner[:m] == owner[n - 1:]
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h += codes[k:k + m] * _PLACES[k]
            ids.append((mix(h[inside]) % np.uint64(shape.buckets)).astype(np.int64))
            whose.append(owner[:m][inside])
    return np.concatenate(ids), np.concatenate(whose)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def repeats(text: str, words: list[bytes]) -> tuple[int, int, int]:
    """How often each mark of repetition occurs."""
    lines = [x for x in text.split("\n") if x.strip()]
    windows = max(0, len(words) - 2)
    return (sum(map(operator.eq, words, words[1:])), windows - len(set(zip(words, words[1:], words[2:]))), len(lines) - len(set(lines)))


def bag(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their share of all its features; marks follow the buckets."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    counts = Counter(words)
    ids, whose = features(list(counts), shape)
    times = np.array([*counts.values()], float)[whose]
    marks = np.arange(shape.buckets, shape.buckets + MARKS)
    found, at = np.unique(np.concatenate([ids, marks]), return_inverse=True)
    n = np.bincount(at, np.concatenate([times, repeats(text, words)]))
    return found[n > 0], (n[n > 0] / n.sum()).astype(np.float32)


def fit(bodies: list[str], labels: list[int], shape: Shape = Shape(), epochs: int = 5, rate: float = 0.2,
        decay: float = 1e-4, seed: int = 11) -> Model:
    """Stochastic gradient descent, one document a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / shape.width, 1 / shape.width, (shape.buckets + MARKS, shape.width)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (shape.width, 2)).astype(np.float32), np.zeros(2, np.float32)
    bags = [bag(t, shape) for t in bodies]
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            speed = rate * (1 - step / steps)
            step += 1
            rows = table[ids]
            mean = share @ rows
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            grad = weight @ error
            weight -= speed * (np.outer(mean, error) + decay * weight)
            bias -= 0.1 * speed * error
            # A document has thousands of features, each with a tiny share: the step of a row is scaled by their number.
            table[ids] = rows - speed * np.minimum(1, share * len(ids))[:, None] * grad
    difference = weight[:, 1] - weight[:, 0]
    return Model(shape, table @ difference, float(bias[1] - bias[0]))


def held_out(id_col: str) -> Column:
    """True for rows that never take part in fitting."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
                  most_rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """At most ``most_rows`` labelled whole texts outside the held-out part, as many of each label as can be.

    The ids are picked from the labels by hash first, so only chosen texts travel.
    """
    if most_rows < 2:
        raise ValueError("most_rows must be 2 at least")
    clean = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
             .groupBy(F.col(id_col)).agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_most"))
             .filter("_label = _most").withColumn("_order", F.md5(F.col(id_col).cast("string"))))
    half = most_rows // 2
    chosen = [r for k in (0, 1) for r in clean.filter(F.col("_label") == k).orderBy("_order", id_col).limit(half).collect()]
    if not chosen:
        return []
    spark = docs.sparkSession
    pick = spark.createDataFrame([(r[id_col], r["_label"], r["_order"]) for r in chosen],
                                 clean.select(id_col, "_label", "_order").schema)
    rows = (docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text"))
            .join(F.broadcast(pick), id_col).groupBy(id_col, "_label", "_order").agg(F.min("_text").alias("_text"))
            .collect())
    rows.sort(key=lambda r: (r["_order"], r[id_col]))
    return [(r["_text"], int(r["_label"])) for r in rows]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", **options) -> Model:
    rows = training_rows(docs, labels, label_col, **options)
    if not rows:
        return Model(Shape(), np.zeros(Shape().buckets + MARKS, np.float32), 0.0)
    return fit([t for t, _ in rows], [y for _, y in rows])


def scorer(model: Model, cached_words: int = 300_000):
    """Scores of whole texts: softmax probability of label 1."""
    known = BoundedCache(cached_words)
    margin, shape = model.margin, model.shape

    def learn(words: list[bytes]) -> None:
        ids, whose = features(words, shape)
        sums, sizes = np.bincount(whose, margin[ids], len(words)), np.bincount(whose, minlength=len(words))
        known.update(zip(words, zip(sums.tolist(), sizes.tolist())))

    def score(bodies: list[str]) -> list[float]:
        out = []
        split = [words_of(t) for t in bodies]
        known.room()
        new = [w for w in set().union(*split) if w not in known]
        if new:
            learn(new)
        for text, words in zip(bodies, split):
            total, n = 0.0, 0
            for mark, times in zip(margin[shape.buckets:], repeats(text, words)):
                total += float(mark) * times
                n += times
            for (word_margin, size), times in ((known[w], k) for w, k in Counter(words).items()):
                total += times * word_margin
                n += times * size
            z = model.bias + (total / n if n else 0.0)
            out.append(1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z)))
        return out

    return score


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``score``, in place of a column of that name. The model is broadcast; its size is fixed by its shape."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body_name = free_name(docs, "_text")
    source = docs.select(*[c for c in keep if c != "score"], F.col(text_col).alias(body_name))
    keep = source.columns[:-1]

    def run(batches):
        score = scorer(shared.value)
        for b in batches:
            body = b.column(body_name)
            values = [x for i in range(0, b.num_rows, 128) for x in score(texts(body.slice(i, 128)))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(values, pa.float64())],
                                             names=[*keep, "score"])

    return map_arrow(source, run, docs.select(*keep).schema.add("score", "double"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(shared.value)
        for b in batches:
            body = b.column(text_col)
            yield b.filter(pa.array([x >= threshold for i in range(0, b.num_rows, 128)
                                     for x in score(texts(body.slice(i, 128)))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
