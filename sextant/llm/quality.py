"""Quality by a sparse rule ensemble.

Whole texts give statistics (sizes, shares of character classes, repetition of words, lines and word
quadruples). Small trees grown on random parts of a bounded labelled sample give paths; each path is a
rule, a conjunction of comparisons with statistics. A lasso-penalised logistic regression over
all rules leaves a few; these, with their weights, are compiled into one Spark column expression.

Bounds: at most max_rows labelled rows, the first by a hash of doc_id, are fitted on, one text for each doc_id. Scoring takes
every text as a whole. Null text counts as empty; all statistics of an empty text are 0, and the rules
score them as any others. Without labels of both classes the score is the one label there is, or 0.5.
Rows are independent; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import bounded_batches
from sextant.llm.minhash_dedup import shingles
from sextant.llm.toxicity import held_out

CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "line": b"\n", "pipe": b"|", "bang": b"!?", "symbol": b"#$%&*@^~<>=+_\\/{}[]",
    "stop": b".,;:", "wide": range(128, 256),
}
STATISTICS = ["log_bytes", "log_words", "word_length", *(f"{c}_share" for c in CLASSES), "distinct_words", "top_word", "same_neighbour", "distinct_quads", "distinct_lines", "line_words"]


def _repeats(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and count of the most frequent one, by row."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(rows)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(v))))
    return np.bincount(r[at], minlength=rows).astype(float), top


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines, each with its line end, and their rows. Line ends are looked for piece by piece; a line goes on over the border of a piece."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in bs.runs(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        ends = [np.flatnonzero(data[a : min(a + bs.PIECE, hi)] == 10) + (a + 1) for a in range(lo, hi, bs.PIECE)]
        edges = np.unique(np.concatenate([offsets[i : j + 1], *ends]))
        part = data[lo:hi]
        hashes.append(bs.names_beside(part, edges - lo))
        rows.append(np.searchsorted(offsets, edges[:-1], "right") - 1)
    return np.concatenate(hashes), np.concatenate(rows)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x STATISTICS."""
    offsets = offsets.astype(np.int64)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    each = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    hashes, first = bs.word_hashes(data, offsets)
    words = np.diff(first).astype(float)
    row = np.repeat(np.arange(n), np.diff(first))
    out = [np.log1p(size), np.log1p(words)]
    counts = np.zeros((n, 256))
    for r in range(n):
        counts[r] = np.bincount(data[offsets[r] : offsets[r + 1]], minlength=256)
    blank = counts[:, ~bs.WORD_LUT].sum(axis=1)
    out.append(each(size - blank, words))
    out += [each(counts[:, list(members)].sum(axis=1), size) for members in CLASSES.values()]
    distinct, top = _repeats(hashes, row, n)
    same = np.zeros(n)
    if len(hashes) > 1:
        np.add.at(same, row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], 1)
    _, at = shingles(hashes, first, 4)
    lines, line_row = _lines(data, offsets)
    n_lines = np.bincount(line_row, minlength=n).astype(float)
    out += [each(distinct, words), each(top, words), each(same, words), each(np.diff(at).astype(float), np.maximum(words - 3, np.minimum(words, 1))), each(_repeats(lines, line_row, n)[0], n_lines), np.log1p(each(words, n_lines))]
    return np.column_stack(out) if n else np.zeros((0, len(STATISTICS)))


def _measure(batches):
    for ids, text in bs.arrow_batches(batches, ["doc_id", "text"]):
        data, offsets = bs.buffers(text)
        for i, j in bs.runs(offsets, 2 * bs.PIECE):
            found = statistics(data, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=["doc_id", *STATISTICS])


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), ...


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, bins: int = 24) -> list[Rule]:
    """The paths to all nodes of a regression tree on y."""
    found: list[Rule] = []
    cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0)

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            found.append(path)
        if len(path) == depth or len(rows) < 20 or np.ptp(y[rows]) == 0:
            return
        best = (1e-9, 0, 0.0)
        total, n = y[rows].sum(), len(rows)
        for f in rng.choice(x.shape[1], size=max(3, x.shape[1] // 2), replace=False):
            at = np.unique(cuts[:, f])
            slot = np.searchsorted(at, x[rows, f], "left")
            number = np.cumsum(np.bincount(slot, minlength=len(at) + 1))[:-1].astype(float)
            below = np.cumsum(np.bincount(slot, weights=y[rows], minlength=len(at) + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = below**2 / number + (total - below) ** 2 / (n - number) - total**2 / n
            gain[(number < 5) | (n - number < 5)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], int(f), float(at[k]))
        if best[0] <= 1e-9:
            return
        above = x[rows, best[1]] > best[2]
        for side in (False, True):
            grow(rows[above == side], (*path, (best[1], side, best[2])))

    grow(np.arange(len(y)), ())
    return found


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in rule])


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the constant is not penalised."""
    n = len(y)
    step = 4 * n / (float(np.linalg.eigvalsh(x.T @ x)[-1]) + n)
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        new = v - step * (x.T @ (p - y)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        const = c - step * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), const + (t - 1) / t_new * (const - b)
        w, b, t = new, const, t_new
    return w, b


@dataclass
class QualityModel:
    constant: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The probability of label 1 over the columns STATISTICS."""
        def one(rule: Rule, weight: float) -> Column:
            tests = [F.col(STATISTICS[f]) > t if above else F.col(STATISTICS[f]) <= t for f, above, t in rule]
            return F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0.0))

        z = reduce(lambda a, b: a + b, (one(r, w) for r, w in self.rules), F.lit(self.constant))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, documents: DataFrame) -> DataFrame:
        """(doc_id, score) of every row; whole texts."""
        return measured(documents).select("doc_id", self.column().alias("score"))


def fit_quality(documents: DataFrame, labels: DataFrame, max_rows: int = 12_000, trees: int = 40, depth: int = 3, penalty: float = 0.0015) -> QualityModel:
    """labels(doc_id, quality): training labels only; the caller leaves the held-out ones out. Rows with a null label don't count."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most max_rows rows: one text for each doc_id
    rows = np.array([tuple(r) for r in measured(picked).join(F.broadcast(sample), "doc_id").select("doc_id", "y", *STATISTICS).collect()], float)
    if not len(rows) or np.ptp(rows[:, 1]) == 0:
        return QualityModel(0.0 if not len(rows) else (20.0 if rows[0, 1] else -20.0))
    rows = rows[np.lexsort(rows.T[::-1])]
    y, x = rows[:, 1], rows[:, 2:]
    rng = np.random.default_rng(11)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        part = rng.choice(len(y), size=max(20, int(len(y) * 0.5)), replace=True)
        rules |= dict.fromkeys(tree_rules(x[part], y[part] - y.mean(), rng, depth))
    names, columns, seen = [], [], set()
    for rule in rules:
        c = holds(rule, x)
        if 0.002 < c.mean() < 0.998 and (key := np.packbits(c).tobytes()) not in seen:
            seen.add(key)
            names.append(rule)
            columns.append(c)
    if not columns:  # no rule tells any rows apart
        return QualityModel(float(np.log(y.mean() / (1 - y.mean()))))
    matrix = np.column_stack(columns).astype(np.float64)
    weights, constant = lasso_logistic(matrix, y, penalty)
    return QualityModel(constant, [(r, float(w)) for r, w in zip(names, weights, strict=True) if w])


def op1_quality_rules(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(documents, labels.where(~held_out(5, 0)))
    return model.score(documents).select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
