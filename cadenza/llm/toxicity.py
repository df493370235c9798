"""Toxicity severity by cumulative-link ordinal regression.

Features are sparse: hashes of a text's lower-cased words and of their
first four and six letters, of which the regression uses those that are
clearly more frequent in documents labelled toxic. Labels say toxic or
not; the grades to learn are 0 for the others and 1 to 3 for toxic ones, by
thirds of the words that carry such a feature. One weight vector is shared
by the ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w . x).
A text's severity is its expected grade; it is toxic where the chance of a
grade above 0 reaches the cut with the best F1 on the sample.

The features are counted on Spark over a sample of at most ``SAMPLE_ROWS``
labelled documents of each class; the driver sees the best
``MAX_FEATURES`` of them and the sample's values for these. Every text is
scored whole.

Defined results: a null or empty text has no features and the severity of
the thresholds alone; without labels of both classes nothing is toxic and
severity is 0; repeated rows score alike; extra columns are ignored
(``reject`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.labels import sample
from cadenza.llm.words import SpanHash, chunks, find_words, mix64
from cadenza.session import checkpoint

#: Labelled documents of each class that the fit may use.
SAMPLE_ROWS = 8_000
MAX_FEATURES = 4_096
#: A feature needs this many toxic documents and this many standard errors.
LEAST_DOCS, LEAST_Z = 5, 4.0
GRADES = 4
RIDGE = 1.0
STEPS, RATE = 1500, 0.05

_hash = SpanHash(7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OTHER = np.ones(256, bool)  # bytes that stand in no word
_OTHER[np.r_[65:91, 97:123, 128:256]] = False
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False
_PREFIXES = (4, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, feature) of every word and long enough word beginning."""
    data = _LOWER[data]
    words = find_words(data, offsets, _OTHER)
    point = np.flatnonzero(_POINT[data])
    rank = np.searchsorted(point, words.start)
    ends = np.r_[point, np.full(max(_PREFIXES) + 1, len(data))]
    at = np.arange(len(words.start))
    row, word, out = [words.doc], [at], [_hash(data, words.start, words.end)]
    for n in _PREFIXES:
        end = ends[rank + n]
        longer = end < words.end
        row.append(words.doc[longer])
        word.append(at[longer])
        out.append(mix64(_hash(data, words.start[longer], end[longer]) + np.uint64(n)))
    return np.concatenate(row), np.concatenate(word), np.concatenate(out)


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) and how often each occurs."""
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])]) \
        if len(row) else np.zeros(0, int)
    return row[new], feature[new], np.diff(np.r_[new, len(row)])


def _document_counts(batches):
    """Documents of each class with a feature, summed over a batch."""
    for batch in batches:
        for part, data, offsets in chunks(batch):
            y = part.column(1).to_numpy()
            row, _, f = features(data, offsets)
            row, f, _ = _distinct(row, f)
            known, at = np.unique(f, return_inverse=True)
            toxic = np.bincount(at, weights=y[row], minlength=len(known)).astype(np.int64)
            both = np.bincount(at, minlength=len(known))
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.view(np.int64)), pa.array(toxic), pa.array(both - toxic)],
                ["feature", "toxic", "clean"])


@dataclass
class Model:
    """Chosen features (sorted), their weights, the thresholds, and the
    chance of a grade above 0 from which a text is toxic."""
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def values(self, data, offsets):
        """(row, chosen feature, value) and the carrying words per row."""
        row, word, f = features(data, offsets)
        at = np.searchsorted(self.features, f)
        at[at == len(self.features)] = 0
        hit = np.flatnonzero(self.features[at] == f) if len(self.features) else np.zeros(0, int)
        n = len(offsets) - 1
        pairs = np.unique(np.stack([row[hit], word[hit]]), axis=1) if len(hit) else np.zeros((2, 0), int)
        carriers = np.bincount(pairs[0], minlength=n)
        r, c, count = _distinct(row[hit], at[hit].astype(np.uint64))
        return r, c.astype(np.int64), 1.0 + np.log(count), carriers

    def exceed(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -50, 50)))


def _fit(row, col, val, n_features, y, weight):
    """Weights and thresholds of the smallest penalised loss (Adam)."""
    n, k = len(y), GRADES - 1
    w = np.zeros(n_features)
    share = np.array([np.average(y > j, weights=weight) for j in range(k)]).clip(1e-4, 1 - 1e-4)
    t = -np.log(share / (1 - share))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(k))
    theta = np.r_[t[0], np.log(np.diff(t).clip(1e-3))]
    params = np.r_[w, theta]
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, theta = params[:n_features], params[n_features:]
        gaps = np.exp(theta[1:])
        t = theta[0] + np.r_[0, np.cumsum(gaps)]
        eta = np.bincount(row, weights=val * w[col], minlength=n)
        below = 1 / (1 + np.exp(-np.clip(np.r_[-50, t, 50][None, :] - eta[:, None], -50, 50)))
        hi, lo = below[np.arange(n), y + 1], below[np.arange(n), y]
        p = (hi - lo).clip(1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_eta = weight * (dhi - dlo)
        d_t = np.array([np.sum(-weight * dhi * (y == j)) + np.sum(weight * dlo * (y == j + 1)) for j in range(k)])
        g_theta = np.r_[d_t.sum(), [gaps[j] * d_t[j + 1:].sum() for j in range(k - 1)]]
        g = np.r_[np.bincount(col, weights=val * d_eta[row], minlength=n_features) + RIDGE * w, g_theta]
        g /= n
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, theta = params[:n_features], params[n_features:]
    return w, theta[0] + np.r_[0, np.cumsum(np.exp(theta[1:]))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic",
        text_col: str = "text") -> Model:
    """Choose features and fit the regression on a bounded sample."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 50.0))
    rows = sample(labels, label, SAMPLE_ROWS, id_col=id_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(rows), id_col) \
        .select("weight", "y", "text")
    rows = checkpoint(rows)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return none
    counts = rows.mapInArrow(_document_counts, "feature bigint, toxic bigint, clean bigint") \
        .groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")) \
        .filter(F.col("a") >= LEAST_DOCS)
    odds = F.log((F.col("a") + 0.5) / (sizes[1] - F.col("a") + 0.5)) \
        - F.log((F.col("b") + 0.5) / (sizes[0] - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (sizes[1] - F.col("a") + 0.5)
                   + 1 / (F.col("b") + 0.5) + 1 / (sizes[0] - F.col("b") + 0.5))
    best = counts.withColumn("z", odds / error).filter(F.col("z") >= LEAST_Z) \
        .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").collect()
    if not best:
        return none
    chosen = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))
    model = Model(chosen, np.zeros(len(chosen)), none.thresholds)

    def sparse(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                r, c, x, carriers = model.values(data, offsets)
                cut = np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(carriers, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(c)),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(x))],
                    ["weight", "y", "carriers", "at", "value"])

    pdf = rows.mapInArrow(sparse, "weight double, y int, carriers bigint, at array<bigint>, value array<double>") \
        .toPandas()
    pdf = pdf.assign(key=pdf["at"].map(tuple), val=pdf["value"].map(tuple)) \
        .sort_values(["y", "carriers", "key", "val"], ignore_index=True)  # rows arrive in any order
    carriers, y = pdf["carriers"].to_numpy(), pdf["y"].to_numpy().astype(int)
    cuts = np.quantile(carriers[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (carriers[:, None] > cuts).sum(1), 0)
    sizes_ = pdf["at"].map(len).to_numpy()
    row = np.repeat(np.arange(len(pdf)), sizes_)
    col = np.concatenate([*pdf["at"], np.zeros(0)]).astype(int)
    val = np.concatenate([*pdf["value"], np.zeros(0)])
    weight = pdf["weight"].to_numpy()
    w, t = _fit(row, col, val, len(chosen), grade, weight / weight.mean())
    model = Model(chosen, w, t)
    p = model.exceed(np.bincount(row, weights=val * w[col], minlength=len(y)))[:, 0]
    model.cut = _best_cut(p, y, weight)
    return model


def _best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut on ``p`` with the best F1, half-way to the next lower value."""
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    hits, taken = np.cumsum(weight * y), np.cumsum(weight)
    last = np.flatnonzero(np.r_[p[1:] < p[:-1], True])
    f1 = 2 * hits[last] / (taken[last] + hits[-1])
    at = last[int(np.argmax(f1))]
    return float((p[at] + p[at + 1]) / 2 if at + 1 < len(p) else p[at])


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, ``severity`` (expected grade), ``p_toxic``, ``grade``
    (the likeliest) and ``toxic`` of every row."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, text=text_col):
                r, c, x, _ = model.values(data, offsets)
                eta = np.bincount(r, weights=x * model.weights[c], minlength=part.num_rows)
                above = model.exceed(eta)
                p = -np.diff(np.c_[np.ones(len(eta)), above, np.zeros(len(eta))], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(p.argmax(1).astype(np.int32)),
                       pa.array(above[:, 0] >= model.cut)], [*keep, "severity", "p_toxic", "grade", "toxic"])

    return docs.select(*keep, text_col).mapInArrow(
        run, f"{kinds}, severity double, p_toxic double, grade int, toxic boolean")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows judged toxic; one pass, no shuffle."""
    model = fit(docs, labels, id_col, text_col=text_col)

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, text=text_col):
                r, c, x, _ = model.values(data, offsets)
                eta = np.bincount(r, weights=x * model.weights[c], minlength=part.num_rows)
                yield part.filter(pa.array(model.exceed(eta)[:, 0] < model.cut))

    return docs.mapInArrow(run, docs.schema)
