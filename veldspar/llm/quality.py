"""Quality classifier by co-training on two views.

One classifier sees a text's content, the other only the row's metadata (language, source,
length). Both start from the labelled rows. In each round every unlabelled document of the
corpus is scored by both views; all documents that a view is sure of join the other's training
set with its label. The fit is distributed: tasks sum gradients and curvatures over their
documents, and the driver takes Newton steps on the sums, whose size is fixed by the number of
features. Each view's score is calibrated on labelled rows kept apart, and a logistic
combination of the two, fitted on the same rows, scores all documents.

The one bound, a parameter: at most MAX_LABELLED labelled rows (drawn by hash) are learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import blocks_of, mix
from .common import materialise, release

MAX_LABELLED = 6000
ROUNDS = 3
#: Newton steps of a round.
STEPS = 2
#: How sure a view must be of a document to hand it over.
SURE = 0.9
#: Documents under this probability of good quality are rejected.
REJECT = 0.5
SEED = 7
N_META = 48
#: Buckets of hashed byte n-grams, and the n-grams' length.
GRAMS, GRAM = 512, 4

_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", dtype=np.uint8)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SPACE, _DIGIT = _table(b" \t\n\r\x0b\x0c"), _table(bytes(range(48, 58)))
_UPPER, _LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_HIGH, _TAIL, _EDGE = _table(bytes(range(128, 256))), _table(b"!#$%&*|<>=~^+@"), _table(b".,;:!?'\"()")
_LETTER = _UPPER | _LOWER
_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))
_FOLD = np.arange(256, dtype=np.uint64) + np.where(_UPPER, 32, 0).astype(np.uint64)
N_SHAPE = 19 + len(_MARKS)


def _bucket(text: str, seed: int, n: int) -> int:
    h = 1469598103934665603 + seed
    for b in text.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 29) % n


def _distinct(names: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct names of each document."""
    if not len(names):
        return np.zeros(n)
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    new = np.concatenate(([True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])))
    return np.bincount(doc[new], minlength=n).astype(float)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, dtype=values.dtype)


def shapes(parts: list[bytes]) -> np.ndarray:
    """Shares and shapes of whole texts, one row each; none of a text's length alone."""
    n = len(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)  # a line break ends each text
    doc = np.repeat(np.arange(n), lengths + 1)
    counts = np.bincount(doc * 256 + data, minlength=256 * n).reshape(n, 256).astype(float)
    counts[:, 10] -= 1
    size = np.maximum(1, lengths)
    upper, lower, digit, high, blank = (counts[:, t].sum(axis=1) for t in (_UPPER, _LOWER, _DIGIT, _HIGH, _table(b" ")))
    letters = upper + lower + high
    some = np.maximum(1, letters)
    word = ~_SPACE[data]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    stops = np.flatnonzero(~word & np.concatenate(([False], word[:-1])))
    owner = doc[starts]
    words = np.bincount(owner, minlength=n).astype(float)
    m = np.maximum(1, words)
    # A byte's place counts from the last start of a word before it.
    place = np.arange(len(data)) - np.maximum.accumulate(np.where(word & ~np.concatenate(([False], word[:-1])), np.arange(len(data)), 0))
    weight = mix(np.arange(1, int(place.max(initial=0)) + 2, dtype=np.uint64)) | np.uint64(1)
    name = _sums(np.where(word, _BYTE_HASH[data] * weight[place], np.uint64(0)), starts)
    long = stops - starts
    is_letter = _LETTER[data]
    n_upper, n_lower, n_high, n_letter = (_sums(t[data].astype(np.int64) * word, starts) for t in (_UPPER, _LOWER, _HIGH, _LETTER))
    n_edge = _sums((_EDGE[data] & word).astype(np.int64), starts)
    first = np.where(is_letter, place, 1 << 60)
    first = np.minimum.reduceat(first, starts) if len(starts) else first[:0]
    last = np.maximum.reduceat(np.where(is_letter, place, -1), starts) if len(starts) else place[:0]
    clean = (n_high > 0) | (n_letter > 0) & (n_letter + n_edge == long) & (last - first + 1 == n_letter)
    per = lambda flag: np.bincount(owner, weights=flag, minlength=n)
    odd, tail, single = per((n_upper > 0) & (n_lower == 0)), per(_TAIL[data[stops - 1]] if len(stops) else np.zeros(0)), per(long == 1)
    same_doc = owner[1:] == owner[:-1]
    twice = np.bincount(owner[1:][same_doc & (name[1:] == name[:-1])], minlength=n).astype(float)
    pairs = np.maximum(0, words - 1)
    pair_names = mix(name[:-1] * np.uint64(3) + name[1:])[same_doc]
    distinct_pairs = _distinct(pair_names, owner[1:][same_doc], n)
    # Lines: from after a line break up to the next one, not blank.
    ends = np.flatnonzero(data == 10)
    at = np.concatenate(([0], ends[:-1] + 1))
    line_place = np.arange(len(data)) - np.repeat(at, np.diff(np.concatenate((at, [len(data)]))))
    line_weight = mix(np.arange(1, int(line_place.max(initial=0)) + 2, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
    line_name = _sums(_BYTE_HASH[data] * line_weight[line_place], at)
    full = _sums(word.astype(np.int64), at) > 0
    line_doc = doc[at][full]
    lines = np.bincount(line_doc, minlength=n).astype(float)
    distinct_lines = _distinct(line_name[full], line_doc, n)
    columns = [
        upper / some, lower / some, digit / size, high / some, blank / size, (lengths - letters - blank) / size,
        _distinct(name, owner, n) / m, twice / m, 1 - distinct_pairs / np.maximum(1, pairs), odd / m, tail / m, np.minimum(1.0, size / m / 30),
        1 - distinct_lines / np.maximum(1, lines), np.log1p(m / np.maximum(1, lines)) / 8, single / m,
        twice > 2, tail > 0.1 * m, odd > 0.3 * m, per(clean) / m,
    ]
    return np.column_stack((*columns, np.minimum(1.0, 10 * counts[:, _MARKS] / size[:, None]))).astype(float)


def gram_shares(parts: list[bytes]) -> np.ndarray:
    """Each text's shares of hashed byte n-grams, letters in lower case."""
    n = len(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    data = _FOLD[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    many = np.maximum(0, lengths - GRAM + 1)
    h = np.zeros(max(0, len(data) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + data[k : k + len(h)]
    doc = np.repeat(np.arange(n), many)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(lengths) - lengths, many)
    bucket = (mix(h[at]) % np.uint64(GRAMS)).astype(np.int64)
    return np.bincount(doc * GRAMS + bucket, minlength=n * GRAMS).reshape(n, GRAMS) / np.maximum(1, many)[:, None]


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata features; nulls have a place of their own."""
    out = np.zeros(N_META)
    out[_bucket(lang, 1, 8) if lang is not None else 8] = 1
    out[9 + (_bucket(source, 2, 29) if source is not None else 29)] = 1
    if n_chars is None:
        out[39] = 1
    else:
        size = min(16.0, float(np.log1p(max(0, n_chars))))
        out[40] = size / 16
        out[41 + min(6, int(size / 2))] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -20, 20)


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, gradient and curvature of the logistic loss over rows x with targets y."""
    x = np.hstack((x, np.ones((len(x), 1))))
    p = _sigmoid(x @ w)
    return float(len(x)), x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x


def newton(w: np.ndarray, weight: float, grad: np.ndarray, hess: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """The weights after a bounded Newton step of the ridge loss."""
    reg = np.full(len(w), ridge * max(1.0, weight))
    reg[-1] = 1e-9
    step = np.linalg.solve(hess + np.diag(reg + 1e-9), grad + reg * w)
    return w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        before, w = w, newton(w, *sums(x, y, w))
        if np.abs(w - before).max() < 1e-6:
            break
    return w


def gram_weights(shares: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log odds of each n-gram bucket between good and bad rows, shrunk to none."""
    good, bad = (shares[y == c].mean(axis=0) if (y == c).any() else np.zeros(GRAMS) for c in (1, 0))
    return np.log((good + 1 / GRAMS) / (bad + 1 / GRAMS))


@dataclass
class Model:
    grams: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    #: weights of the calibrated text score, the calibrated metadata score, and the bias
    both: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray

    def views(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Calibrated log odds of the two views."""
        return np.column_stack((_score(_score(a, self.text)[:, None], self.text_scale), _score(_score(b, self.meta)[:, None], self.meta_scale)))

    def probability(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _sigmoid(_score(self.views(a, b), self.both))


#: Sums of a round's step: for each view (0 text, 1 metadata) and label, what `sums` gives.
Sums = dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]


def pseudo_sums(a: np.ndarray, b: np.ndarray, base: list[np.ndarray], now: list[np.ndarray]) -> Sums:
    """Over unlabelled rows: `base` says which rows each view is sure of, `now` is where the
    other's loss is summed."""
    rows = (a, b)
    out = {}
    for me, you in ((0, 1), (1, 0)):
        p = _sigmoid(_score(rows[me], base[me]))
        for label, at in ((1, p >= SURE), (0, p <= 1 - SURE)):
            out[you, label] = sums(rows[you][at], np.full(int(at.sum()), float(label)), now[you])
    return out


def cotrain(a: np.ndarray, b: np.ndarray, y: np.ndarray, corpus, rounds: int = ROUNDS, seed: int = SEED) -> tuple[list[np.ndarray], np.ndarray]:
    """The two views' weights, and which labelled rows were kept apart for calibration.

    a, b: the views of the labelled rows y; corpus(base, now): pseudo_sums() over all
    unlabelled documents. Pseudo-labelled rows of a label weigh as much as its labelled rows
    at most, however many there are.
    """
    apart = np.random.default_rng(seed).random(len(y)) < 0.25
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), dtype=bool)
    fit = ~apart
    xs, t = (a[fit], b[fit]), y[fit].astype(float)
    w = [logistic(x, t) for x in xs]
    for _ in range(rounds):
        base = [v.copy() for v in w]
        for _ in range(STEPS):
            told = corpus(base, w)
            new = []
            for view in (0, 1):
                weight, grad, hess = sums(xs[view], t, w[view])
                for label in (0, 1):
                    n, g, h = told.get((view, label), (0.0, 0.0, 0.0))
                    share = min(1.0, float((t == label).sum()) / n) if n else 0.0
                    weight, grad, hess = weight + share * n, grad + share * g, hess + share * h
                new.append(newton(w[view], weight, grad, hess))
            w = new
    return w, apart if apart.any() else fit


def combined(a: np.ndarray, b: np.ndarray, y: np.ndarray, w: list[np.ndarray], held: np.ndarray, grams: np.ndarray) -> Model:
    """Both views calibrated, and combined, on the rows kept apart."""
    t = y[held].astype(float)
    scales = [logistic(_score(x[held], v)[:, None], t) for x, v in ((a, w[0]), (b, w[1]))]
    model = Model(grams, w[0], w[1], np.array([1.0, 0.0, 0.0]), scales[0], scales[1])
    model.both = logistic(model.views(a[held], b[held]), t)
    return model


def constant(y: np.ndarray) -> Model:
    """Where labels are of one class only, or there are none: all documents get its score."""
    bias = 10.0 if not len(y) or y[0] else -10.0
    return Model(np.zeros(GRAMS), np.zeros(N_SHAPE + 2), np.zeros(N_META + 1), np.array([0.0, 0.0, bias]), np.array([1.0, 0.0]), np.array([1.0, 0.0]))


def text_views(parts: list[bytes], grams: np.ndarray | None) -> np.ndarray:
    """Shapes and the mean log odds of the n-grams, or all n-gram shares where no odds are known."""
    last = gram_shares(parts)
    return np.hstack((shapes(parts), last if grams is None else (last @ grams)[:, None]))


#: The columns that the views read.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _views(b: pa.RecordBatch, at: tuple[int, int, int, int], grams: np.ndarray | None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The two views of a batch's rows, a bounded block of texts at a time."""
    texts, meta = b.column(at[0]), [b.column(k).to_pylist() for k in at[1:]]
    parts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]
    for k in blocks_of(parts, lambda p: len(p) + 2000):
        yield k, text_views(parts[k], grams), np.array([meta_view(*x) for x in zip(*(c[k] for c in meta), strict=True)]).reshape(-1, N_META)


def features(docs: DataFrame, columns: tuple[str, str, str, str, str], grams: np.ndarray | None, *more: str) -> DataFrame:
    """(id, the columns of more, a, b) of every row: the two views."""
    key, text, lang, source, size = (F.col(f"`{c}`") for c in columns)
    own = docs.select(text.cast("string").alias("t"), lang.cast("string").alias("l"), source.cast("string").alias("s"), size.cast("long").alias("n"), key.cast("long").alias("id"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x, m in _views(b, (0, 1, 2, 3), grams):
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.float32).ravel()), v.shape[1]).cast(pa.list_(pa.float32())) for v in (x, m)]
                yield pa.RecordBatch.from_arrays([*(c.slice(k.start, k.stop - k.start) for c in b.columns[4:]), *lists], ["id", *more, "a", "b"])
        release()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[4:])
    return own.mapInArrow(run, f"{kinds}, a array<float>, b array<float>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def corpus_sums(rows: DataFrame, base: list[np.ndarray], now: list[np.ndarray]) -> Sums:
    """pseudo_sums() over all rows (a, b): each task sums its own, and sums meet by place."""
    widths = [len(w) - 1 for w in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for key, (n, g, h) in pseudo_sums(_matrix(b.column(0), widths[0]), _matrix(b.column(1), widths[1]), base, now).items():
                flat = np.concatenate(([n], g, h.ravel()))
                total[key] = total[key] + flat if key in total else flat
        for (view, label), flat in total.items():
            n = len(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, view, dtype=np.int32)), pa.array(np.full(n, label, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(flat)], ["view", "label", "k", "v"])

    got = rows.select("a", "b").mapInArrow(run, "view int, label int, k int, v double").groupBy("view", "label", "k").agg(F.sum("v").alias("v")).orderBy("view", "label", "k").toPandas()
    out = {}
    for (view, label), part in got.groupby(["view", "label"]):
        flat, d = part["v"].to_numpy(), widths[int(view)] + 1
        out[int(view), int(label)] = float(flat[0]), flat[1 : 1 + d], flat[1 + d :].reshape(d, d)
    return out


def learn(docs: DataFrame, labels: DataFrame, columns: tuple[str, str, str, str, str] = COLUMNS, label: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> tuple[Model, DataFrame | None]:
    """The model, and the (id, a, b) of every row that it was fitted on; None if there was no fit."""
    key = columns[0]
    known = labels.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    # At most max_labelled rows, so the broadcast and what comes to the driver (as Arrow
    # batches: row objects take ten times as much) are bounded.
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), F.col("id")), "id").limit(max_labelled).select(F.col("id").alias("__id"), F.col("y").alias("__y"))
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    plain = tuple(f"c{k}" for k in range(5))
    rows = named.join(F.broadcast(chosen), F.col("c0").cast("long") == F.col("__id"))
    got = features(rows, plain, None, "__y").groupBy("id").agg(F.min(F.struct("a", "b", "__y")).alias("r")).select("id", "r.*").orderBy("id").toArrow()
    y = got["__y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return constant(y), None
    a, b = (_matrix(got[c].combine_chunks(), width) for c, width in (("a", N_SHAPE + GRAMS), ("b", N_META)))
    del got
    shape, shares = a[:, :N_SHAPE], a[:, N_SHAPE:]
    # The labelled rows' own odds come from the other half of them.
    half = np.arange(len(y)) % 2
    odds = np.zeros(len(y))
    for k in (0, 1):
        odds[half == k] = shares[half == k] @ gram_weights(shares[half != k], y[half != k])
    scale = 1 / max(1e-9, odds.std())
    grams = gram_weights(shares, y) * scale
    a = np.hstack((shape, (odds * scale)[:, None]))
    every = materialise(features(named.join(F.broadcast(chosen), F.col("c0").cast("long") == F.col("__id"), "left"), plain, grams, "__y"), "views")
    open_rows = every.filter("__y is null")
    del shape, shares
    w, held = cotrain(a, b, y, lambda base, now: corpus_sums(open_rows, base, now), rounds)
    model = combined(a, b, y, w, held, grams)
    del a, b
    release()  # the driver, too, has other steps to come
    return model, every


def classify(docs: DataFrame, labels: DataFrame, columns: tuple[str, str, str, str, str] = COLUMNS, label: str = "quality", reject: float = REJECT) -> DataFrame:
    """One row per input row: id, quality (probability), kept.

    Nulls: a null or empty text has the features of an empty text, null metadata has places
    of its own, a null id is scored like any row, null labels are ignored and of several
    labels of an id the largest counts. Very long texts are read whole, one at a time.
    Without labels of both classes all rows get the same score (kept, if there are none).
    An empty table gives an empty result; other columns are ignored.
    """
    model, every = learn(docs, labels, columns, label)
    if every is None:
        p = float(model.probability(np.zeros((1, N_SHAPE + 1)), np.zeros((1, N_META)))[0])
        return docs.select(F.col(f"`{columns[0]}`").cast("long").alias("id"), F.lit(p).alias("quality"), F.lit(p >= reject).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(_matrix(b.column(1), N_SHAPE + 1), _matrix(b.column(2), N_META)))], ["id", "quality"])

    return every.select("id", "a", "b").mapInArrow(run, "id long, quality double").withColumn("kept", F.col("quality") >= reject)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the co-trained classifier."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).withColumnRenamed("id", "doc_id")


def good_documents(docs: DataFrame, labels: DataFrame, columns: tuple[str, str, str, str, str] = COLUMNS, reject: float = REJECT) -> DataFrame:
    """The rows of docs that are not rejected, with their columns, whatever their names; nulls as in classify()."""
    model, _ = learn(docs, labels, columns)
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    own = {c: names.index(c) for c in columns}
    casts = (("string", columns[1]), ("string", columns[2]), ("string", columns[3]), ("long", columns[4]))
    views = [F.col(f"c{own[c]}").cast(kind).alias(f"v{k}") for k, (kind, c) in enumerate(casts) if docs.schema[c].dataType.simpleString() != {"long": "bigint"}.get(kind, kind)]
    seen = numbered.select("*", *views)
    at = tuple(seen.columns.index(f"v{k}") if f"v{k}" in seen.columns else own[c] for k, (_, c) in enumerate(casts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.concatenate([np.zeros(0, dtype=bool), *(model.probability(x, m) >= reject for _, x, m in _views(b, at, model.grams))])
            yield b.select(range(len(names))).filter(pa.array(good))
        release()

    kept = seen.mapInArrow(run, numbered.schema)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
