"""Quality classifier: a sparse rule ensemble.

Shallow trees are grown on text statistics of a bounded, labelled sample; every path from a root
is a conjunctive rule, a lasso logistic regression keeps few of them, and what is kept is compiled
into one Spark column over the statistics, which scores every document.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, freed

#: Labelled rows that a fit looks at: those with the smallest hash of their id.
SAMPLE = 20_000
STATISTICS = ("n_bytes", "n_words", "word_bytes", "letters", "upper", "digits", "high", "commas_stops", "symbols", "marked_words", "lone_symbols", "unique_words", "top_word", "echoed_words", "n_lines", "line_bytes", "repeated_lines")
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_SPACE = b" \t\n\v\f\r"
_PLAIN = _UPPER + _LOWER + _DIGIT + _HIGH + _SPACE + b".,;:'\"?-()"


def statistics(text: bytes | None) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for UTF-8 ``text``; zeros for a null or empty one."""
    text = text or b""
    words = text.split()
    if not words:
        return (float(len(text)), *[0.0] * (len(STATISTICS) - 1))
    n, w = len(text), len(words)
    # Bytes of a class: what deleting it takes away.
    upper, digits, high = n - len(text.translate(None, _UPPER)), n - len(text.translate(None, _DIGIT)), n - len(text.translate(None, _HIGH))
    lower, symbols = n - len(text.translate(None, _LOWER)), len(text.translate(None, _PLAIN))
    seen = Counter(words)
    lines = text.split(b"\n")
    marked = sum(1 for x in words if x[-1] in b"!#$%&*|@~^+=<>/\\_")
    lone = sum(c for x, c in seen.items() if len(x) == 1 and x[0] < 128 and not x.isalnum())
    return (
        float(n), float(w), (n - w) / w, (upper + lower + high) / n, upper / max(1, upper + lower), digits / n, high / n,
        (text.count(b".") + text.count(b",")) / w, symbols / n, marked / w, lone / w, len(seen) / w, max(seen.values()) / w,
        sum(map(operator.eq, words, words[1:])) / w, float(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and one double a statistic, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], float).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], ["doc_id", *STATISTICS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freed(run), "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


Condition = tuple[int, bool, float]  # statistic, whether above, threshold


@dataclass
class RuleModel:
    """Weighted conjunctions of conditions; the score is the logistic of their sum."""

    intercept: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, within: str = "") -> Column:
        """The score, 0 to 1, as a Spark column over the statistics, or over fields of the struct ``within``."""

        def held(rule: tuple[Condition, ...]) -> Column:
            return reduce(operator.and_, [F.col(within + STATISTICS[j]) > t if above else F.col(within + STATISTICS[j]) <= t for j, above, t in rule])

        terms = [F.when(held(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        total = reduce(operator.add, terms, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _splits(x: np.ndarray, most: int = 24) -> np.ndarray:
    """Thresholds between values, at quantiles."""
    values = np.unique(np.quantile(x, np.linspace(0.01, 0.99, most)))
    return (values[1:] + values[:-1]) / 2


def _grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: tuple[Condition, ...], out: set[tuple[Condition, ...]], least: int) -> None:
    """Splits that lower the weighted squared error of ``y`` most; every node but the root is a rule."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 2 * least:
        return
    w, t = weight[rows], y[rows]
    best = (1e-9, 0, 0.0)
    total, sum_w = (w * t).sum(), w.sum()
    for j in columns.tolist():
        v = x[rows, j]
        for at in _splits(v).tolist():
            left = v <= at
            n_left = int(left.sum())
            if n_left < least or len(rows) - n_left < least:
                continue
            a, wa = (w * t)[left].sum(), w[left].sum()
            gain = a * a / wa + (total - a) ** 2 / (sum_w - wa) - total * total / sum_w
            if gain > best[0]:
                best = (gain, j, at)
    gain, j, at = best
    if gain <= 1e-9:
        return
    above = x[rows, j] > at
    for side in (False, True):
        _grow(x, y, weight, rows[above == side], columns, depth - 1, (*path, (j, side, at)), out, least)


def _lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    a = np.hstack([np.ones((len(z), 1)), z])
    w = weight / weight.sum()
    step = 4.0 / max(1e-9, np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2)
    beta = ahead = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -30, 30)))
        new = ahead - step * (a.T @ (w * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - step * penalty)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, beta, t = new + (t - 1) / t_new * (new - beta), new, t_new
    return float(beta[0]), beta[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 4e-4, seed: int = 7) -> RuleModel:
    """A rule ensemble for labels 0 and 1; classes weigh the same while trees grow, so that rare ones get rules."""
    if not len(y):
        return RuleModel()
    if y.min() == y.max():
        return RuleModel(4.0 if y[0] else -4.0)
    rng, rules = np.random.default_rng(seed), set()
    share = y.mean()
    even = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 3000), replace=False)
        columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        _grow(x, y, even, rows, columns, depth, (), rules, max(5, len(rows) // 300))
    ordered = sorted(rules)
    z = np.array([reduce(operator.and_, [(x[:, j] > t) == above for j, above, t in rule]) for rule in ordered], float).reshape(len(ordered), len(y)).T
    intercept, beta = _lasso(z, y, np.ones(len(y)), penalty)
    return RuleModel(intercept, [(rule, float(b)) for rule, b in zip(ordered, beta.tolist(), strict=True) if abs(b) > 1e-6])


def _sampled(labels: DataFrame, sample: int, id_col: str, label_col: str, folds: int) -> DataFrame:
    """``doc_id, label`` of at most ``sample`` labelled rows outside the held-out fold."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").where(_fold(folds) != 0)
    return marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)


def fit_quality(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5) -> RuleModel:
    """The rules for documents whose ``with_statistics`` is ``stats``, from at most ``sample`` labelled rows outside the held-out fold."""
    rows = stats.join(_sampled(labels, sample, id_col, label_col, folds), "doc_id").orderBy("doc_id", "label").select(*STATISTICS, "label").limit(2 * sample).toPandas()
    data = rows.to_numpy(float).reshape(-1, len(STATISTICS) + 1)
    return fit_rules(data[:, :-1], data[:, -1])


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Fitted on at most ``sample`` labelled rows, none of which has crc32(id as text) mod ``folds``
    equal to 0; such rows are ``held_out``, rows with a null id are not. Null and empty texts are
    scored from their (zero) statistics. Without labels every score is 0.5. Labels of unknown
    documents, null labels and further columns are ignored, whatever their names; repeated rows are
    scored each, and several labels of one id all count. Texts of any length are measured whole.
    """
    stats = cut(with_statistics(docs, id_col, text_col))
    held_out = F.coalesce(_fold(folds) == 0, F.lit(False))
    model = fit_quality(stats, labels, sample, id_col, label_col, folds)
    return stats.select("doc_id", held_out.alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> DataFrame:
    """The rows of ``docs``, whole, whose score is ``threshold`` or more; fitted and scored as in ``quality_scores``."""
    # Only what the fit looks at is measured for it: at most ``sample`` ids, which all tasks are told.
    wanted = F.broadcast(_sampled(labels, sample, id_col, label_col, folds).select(F.col("doc_id").alias("wanted")).distinct())
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, F.col("id").cast("long") == F.col("wanted"), "left_semi")
    model = fit_quality(with_statistics(known, "id", "text"), labels, sample, id_col, label_col, folds)

    @F.arrow_udf(", ".join(f"{c} double" for c in STATISTICS))
    def measured(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(x) for x in texts.cast(pa.binary()).to_pylist()], float).reshape(len(texts), len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(STATISTICS))

    name = "measured"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return docs.withColumn(name, measured(F.col(text_col))).where(model.column(f"{name}.") >= threshold).drop(name)
