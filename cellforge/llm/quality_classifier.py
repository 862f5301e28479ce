"""Quality classifier: a factorisation machine over hashed words and structure statistics (operator 10)."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches, table
from .language_id import held_out

BUCKETS = 1 << 14
#: Labelled rows that the fit may see at most; the sample is drawn by a hash of the id.
SAMPLE_ROWS = 4000
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
#: Every code point that str.isupper() holds for, as one class of ranges.
_CAPITALS = [c for c in range(sys.maxunicode + 1) if chr(c).isupper()]
_STARTS, _ENDS = ([c for c in _CAPITALS if not chr(c + step).isupper()] for step in (-1, 1))
UPPER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(_STARTS, _ENDS)) + "]")
STATS = ("bias", "log_words", "log_chars", "word_length", "symbols", "digits", "upper", "punctuation", "distinct", "longest_run", "line_length", "repeated_lines", "odd_words", "empty")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word buckets, their weights (unit length in all), and the structure statistics of a whole text."""
    t = text or ""
    w = t.split()
    n, chars = len(w), len(t)
    counts = Counter(w)
    by: dict[int, float] = {}
    digest = xxhash.xxh32_intdigest
    for word, c in counts.items():
        k = digest(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        by[k] = by.get(k, 0) + c
    idx = np.fromiter(by, np.int64, len(by))
    val = np.log1p(np.fromiter(by.values(), np.float64, len(by)))
    val /= max(1e-9, math.sqrt(float(val @ val)))
    stats = np.zeros(len(STATS))
    stats[0] = 1
    if not n:
        stats[-1] = 1
        return idx, val, stats
    run = longest = 1
    for a, b in zip(w, w[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    lines = t.split("\n")
    upper = len(UPPER.findall(t))
    symbols = sum(map(t.count, "#*$%&|<>!@^~={}[]_\\"))
    marks = sum(map(t.count, ".,;:?'\"-()"))
    odd = sum(c for x, c in counts.items() if EDGE.sub("", x) != x.rstrip(".,;:"))
    stats[1:-1] = (
        math.log1p(n),
        math.log1p(chars),
        chars / n,
        symbols / chars,
        len(re.findall(r"\d", t)) / chars,
        upper / chars,
        marks / chars,
        len(counts) / n,
        math.log(longest) if longest > 1 else 0.0,
        math.log1p(chars / len(lines)),
        1 - len(set(lines)) / len(lines),
        odd / n,
    )
    return idx, val, stats


@dataclass
class FactorisationMachine:
    """w0 + <w, x> + sum over pairs of <v_i, v_j> x_i x_j, as half of (squared sum - sum of squares) in linear time."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and the start of each row, from features() of its text."""
        idx, val, start, at = [], [], [], 0
        own = np.arange(len(STATS)) + BUCKETS
        for i, x, s in found:
            idx += [i, own]
            val += [x, np.clip((s - self.mean) / self.scale, -6, 6)]
            start.append(at)
            at += len(i) + len(own)
        return np.concatenate(idx), np.concatenate(val), np.array(start, np.int64)

    def margins(self, idx: np.ndarray, val: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[idx] * val[:, None]
        total = np.add.reduceat(vx, start)
        squares = np.add.reduceat(vx * vx, start)
        return np.add.reduceat(self.w[idx] * val, start) + 0.5 * (total * total - squares).sum(axis=1), total

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        m, _ = self.margins(*self.rows([features(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))

    @staticmethod
    def fit(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int], rank: int = 8, epochs: int = 24, rate: float = 0.03, decay: float = 2e-4, batch: int = 64, seed: int = 7) -> "FactorisationMachine":
        """Adam on the log loss of rows given by features(), both classes with the same weight in all. Without both
        classes the score is constant."""
        size = BUCKETS + len(STATS)
        rng = np.random.default_rng(seed)
        stats = np.array([s for _, _, s in found]).reshape(-1, len(STATS))
        mean = stats.mean(axis=0) if len(found) else np.zeros(len(STATS))
        scale = np.maximum(stats.std(axis=0), 1e-3) if len(found) else np.ones(len(STATS))
        mean[0], scale[0] = 0, 1
        m = FactorisationMachine(mean, scale, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
        y = np.array(labels, float)
        if len(set(labels)) < 2:
            m.v[:] = 0
            m.w[BUCKETS] = 0 if not labels else (3 if labels[0] else -3)
            return m
        idx, val, start = m.rows(found)
        ends = np.append(start[1:], len(idx))
        share = y.mean()
        cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        moments = [np.zeros_like(m.w), np.zeros_like(m.w), np.zeros_like(m.v), np.zeros_like(m.v)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for b in range(0, len(order), batch):
                pick = order[b : b + batch]
                at = np.concatenate([np.arange(start[i], ends[i]) for i in pick])
                lens = ends[pick] - start[pick]
                first = np.append(0, np.cumsum(lens)[:-1])
                i, x = idx[at], val[at]
                z, total = m.margins(i, x, first)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * cost[pick] / len(pick)
                gx = np.repeat(g, lens) * x
                touched, inverse = np.unique(i, return_inverse=True)
                gw = np.bincount(inverse, gx, len(touched)) + decay * m.w[touched]
                full = gx[:, None] * (np.repeat(total, lens, axis=0) - m.v[i] * x[:, None])
                gv = np.stack([np.bincount(inverse, full[:, f], len(touched)) for f in range(rank)], axis=1) + decay * m.v[touched]
                step += 1
                for value, grad, one, two in ((m.w, gw, *moments[:2]), (m.v, gv, *moments[2:])):
                    one[touched] = 0.9 * one[touched] + 0.1 * grad
                    two[touched] = 0.99 * two[touched] + 0.01 * grad * grad
                    value[touched] -= rate * (one[touched] / (1 - 0.9**step)) / (np.sqrt(two[touched] / (1 - 0.99**step)) + 1e-8)
        return m


def fit_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fits on at most `sample_rows` labelled documents, the first by a hash of the id; null labels and ids are left out.

    Executors compute the features, so the driver gets at most BUCKETS numbers and weights and the statistics of each
    sampled document, never a text. Of rows repeated with one id the least features count, once; of an id with several
    labels the least label. An empty table, or labels of one kind, give a constant score.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    sample = {r["id"]: int(r["label"]) for r in marked.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()}
    rows = []

    @F.pandas_udf("stats array<double>, idx array<int>, val array<double>")
    def of(texts):
        import pandas as pd

        found = [features(t) for t in texts]
        return pd.DataFrame({"stats": [s for _, _, s in found], "idx": [i.astype(np.int32) for i, _, _ in found], "val": [x for _, x, _ in found]})

    if sample:
        ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sample], f"id {dict(marked.dtypes)['id']}"))
        chosen = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
        rows = chosen.select("id", of("text").alias("f")).groupBy("id").agg(F.min("f").alias("f")).collect()
    rows.sort(key=lambda r: str(r["id"]))
    found = [(np.array(r["f"]["idx"], np.int64), np.array(r["f"]["val"], float), np.array(r["f"]["stats"], float)) for r in rows]
    return FactorisationMachine.fit(found, [sample[r["id"]] for r in rows])


def score_quality(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`docs` with a score from 0 to 1 and the predicted label, from the whole text alone; null counts as empty.

    Rows stay as they are, repeated ones included, and equal texts get equal scores; a score of 0.5 predicts 1. An empty
    table gives no rows. A new column whose name is taken gets an underscore more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        texts = list(texts)
        return pd.Series(np.concatenate([held.value.scores(texts[i : i + 128]) for i in range(0, len(texts), 128)] or [np.zeros(0)]))

    held_score = fresh(docs.columns, "__score")
    names = [fresh(docs.columns, n) for n in out]
    return small_batches(docs).withColumn(held_score, of(F.col(text_col))).select(*docs.columns, F.col(held_score).alias(names[0]), (F.col(held_score) >= 0.5).cast("int").alias(names[1]))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; fitted on labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    model = fit_quality_model(docs, labels)
    return score_quality(docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text"), model).drop("text")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
