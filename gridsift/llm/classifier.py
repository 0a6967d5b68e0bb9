"""Quality classifier: a document's own evidence combined with posteriors of its host and path by empirical Bayes.

1. Byte and word counts of the whole text give features; a logistic regression is fitted to at most ``SAMPLE``
   labelled rows (those with the least hashes of their ids and features) and gives each document a probability.
2. Hosts' rates of good documents (labels where known, else probabilities) are shrunk to the global rate, and paths'
   rates to their host's posterior. The prior weights are ratios of the variance within groups to that between them:
   hosts about the global rate, paths about their own host's rate.
3. A document's log odds are its own plus its path's, less the global ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import staged, trimmed
from .words import placed

SAMPLE = 20_000
THRESHOLD = 0.5
FEATURES = ("upper", "digit", "newline", "symbol", "bang", "punctuation", "word_bytes", "log_words", "same_as_last", "same_as_before_last", "distinct", "short_words")
#: A rate's prior weight lies within these bounds.
WEIGHTS = (2.0, 1e6)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[0x20, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[[*b"#*$%&|<>"]] = 5
_CLASS[[*b"!?"]] = 6
_CLASS[[*b".,;:'\"()-/"]] = 7
_AS_IS = np.arange(256, dtype=np.uint8)


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    from .words import LOWER, text_bytes

    raw, off = text_bytes(column)
    for a, b, h, at, starts, ends, own in placed(column, LOWER):
        part, n = raw[off[a] : off[b]], b - a
        size, words = np.diff(own), np.diff(at)
        row = np.repeat(np.arange(n), size)
        c = np.bincount(row * 8 + _CLASS[part], minlength=8 * n).reshape(n, 8)
        of = np.repeat(np.arange(n), words)
        first = np.repeat(at[:-1], words)
        place = np.arange(len(h)) - first
        lag = lambda k: np.bincount(of[k:][(h[k:] == h[:-k]) & (place[k:] >= k)], minlength=n) if len(h) > k else np.zeros(n)  # noqa: B023, E731
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(of[order]) != 0) | (np.diff(h[order].view(np.int64)) != 0)
        distinct = np.bincount(of[order][new], minlength=n)
        short = np.bincount(of[(ends - starts) <= 2], minlength=n)
        bytes_, w = np.maximum(size, 1), np.maximum(words, 1)
        x = np.stack((*(c[:, k] / bytes_ for k in (1, 2, 4, 5, 6, 7)), np.minimum((size - c[:, 3] - c[:, 4]) / w, 100) / 10, np.log1p(words) / 5, lag(1) / w, lag(2) / w, distinct / w, short / w), 1)
        yield a, b, x


def document_features(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The ``carry`` columns and ``x``, the features of the whole text (all zero for a null or empty one)."""
    rows = docs.select(*carry, F.col(text).alias("_c_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("_c_text").dtypes) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, b, x in _features(batch.column(len(carry))):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(carry))), flat], [*carry, "x"])

    return rows.mapInArrow(trimmed(run), schema)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression by Newton steps; of one class only, its smoothed log odds."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), float(np.log(rate / (1 - rate)))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), 1)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 5 / max(size, 1e-9))
        if size < 1e-8:
            break
    w, b = w[:-1] / scale, w[-1]
    return w, float(b - w @ mean)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _prior_weight(n: float, groups: int, parents: int, within: float, between: float, squares: float) -> float:
    """Variance within groups over variance between groups of one parent (analysis of variance), in WEIGHTS.

    ``n`` rows in ``groups`` groups of ``parents`` parents; sums of squares within groups, and of groups' rates about
    their parents'; ``squares`` is the sum over parents of their groups' squared sizes over their own.
    """
    if groups <= parents or n <= groups:
        return WEIGHTS[1]
    noise = within / (n - groups)
    spread = (between - (groups - parents) * noise) / max(n - squares, 1e-9)
    return WEIGHTS[1] if spread <= 0 else float(min(max(noise / spread, WEIGHTS[0]), WEIGHTS[1]))


def posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """host, path, p_host, p_path for a table of host, path and good (a label or probability), and the global rate.

    Sums are partial by task, so a host with a third of all rows costs a row a task.
    """
    c = F.col
    sums = [F.sum(x).alias(x) for x in ("n", "good", "sq")]
    paths = staged(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum(c("good") * c("good")).alias("sq")), "paths")
    hosts = staged(paths.groupBy("host").agg(*sums, F.count("*").alias("k"), F.sum(c("n") * c("n")).alias("nn"), F.sum(c("sq") - c("good") * c("good") / c("n")).alias("within"), F.sum(c("good") * c("good") / c("n")).alias("gg")), "hosts")
    t = hosts.agg(
        *sums, F.count("*").alias("hosts"), F.sum("k").alias("paths"), F.sum(c("sq") - c("good") * c("good") / c("n")).alias("within_hosts"), F.sum("within").alias("within_paths"),
        F.sum(c("good") * c("good") / c("n")).alias("gg"), F.sum(c("gg") - c("good") * c("good") / c("n")).alias("between_paths"), F.sum(c("n") * c("n")).alias("nn"), F.sum(c("nn") / c("n")).alias("nn_paths"),
    ).head()
    if not t.n:
        return paths.select("host", "path", F.lit(0.5).alias("p_host"), F.lit(0.5).alias("p_path")), 0.5
    rate = min(max((t.good + 1) / (t.n + 2), 1e-3), 1 - 1e-3)
    wide = _prior_weight(t.n, t.hosts, 1, t.within_hosts, t.gg - t.good * t.good / t.n, t.nn / t.n)
    narrow = _prior_weight(t.n, t.paths, t.hosts, t.within_paths, t.between_paths, t.nn_paths)
    hosts = hosts.select("host", ((c("good") + wide * rate) / (c("n") + wide)).alias("p_host"))
    out = paths.join(hosts, "host").select("host", "path", "p_host", ((c("good") + narrow * c("p_host")) / (c("n") + narrow)).alias("p_path"))
    return out, rate


def _training_rows(train: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``sample`` distinct rows of x and y: a bound on their hashes, from their number, picks about twice as many, and only those are sorted."""
    n = train.count()
    share = (F.col("h").cast("double") / float(1 << 63) + 1) / 2
    some = train.where(share <= min(1.0, 2 * sample / n + 20 / n)) if n else train
    got = some.distinct().orderBy("h", "x", "y").limit(sample).select("x", "y").toPandas()
    return np.stack(got.x) if len(got) else np.zeros((0, len(FEATURES))), got.y.to_numpy()


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", path: str = "lang", label: str = "quality", carry: tuple[str, ...] = (), sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the ``carry`` columns, p_document, p_host, p_path, score (of being good) and kept, for every row of ``docs``.

    ``labels`` has doc_id and a 0/1 label; several labels of a document are averaged, null ones and those of no
    document do nothing. A null host or path is the group ''. A null or empty text has all-zero features and is
    scored like any other. Without labels, or with one class only, nothing is rejected unless that class is bad.
    Repeated rows each get a score.
    """
    cols = list(dict.fromkeys([doc_id, host, path, *carry]))
    rows = staged(document_features(docs, text, cols), "classifier-features")
    known = labels.select(F.col(doc_id).alias("_c_id"), F.col(label).cast("double").alias("_c_y")).where("_c_id IS NOT NULL AND _c_y IS NOT NULL").groupBy("_c_id").agg(F.avg("_c_y").alias("_c_y"))
    with_y = rows.join(known, F.col(doc_id) == F.col("_c_id"), "left").drop("_c_id")
    train = with_y.where(F.col("_c_y").isNotNull()).select("x", (F.col("_c_y") >= 0.5).cast("double").alias("y"), F.xxhash64(F.lit("quality"), doc_id, "x").alias("h"))
    w, b = fit(*_training_rows(train, sample))
    odds = reduce(lambda a, k: a + F.get("x", F.lit(k)) * float(w[k]), range(len(FEATURES)), F.lit(b))
    p = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    scored = with_y.select(*cols, "_c_y", p.alias("p_document"), key(host).alias("_c_host"), key(path).alias("_c_path"))
    groups, rate = posteriors(scored.select(F.col("_c_host").alias("host"), F.col("_c_path").alias("path"), F.coalesce("_c_y", "p_document").alias("good")))
    groups = groups.withColumnsRenamed({"host": "_c_h", "path": "_c_p"})
    own = rows.select(*cols, p.alias("p_document"), key(host).alias("_c_host"), key(path).alias("_c_path"))
    out = own.join(groups, (F.col("_c_host") == F.col("_c_h")) & (F.col("_c_path") == F.col("_c_p")), "left")
    total = _logit(F.greatest(F.least("p_document", F.lit(1 - 1e-12)), F.lit(1e-12))) + _logit(F.col("p_path")) - _logit(F.lit(rate))
    score = 1 / (1 + F.exp(-total))
    return out.select(*cols, "p_document", "p_host", "p_path", score.alias("score"), (score >= threshold).alias("kept"))
