"""Quality classifier: a sparse ensemble of rules over text statistics (operator 2).

Boosted trees on a bounded sample of labelled rows propose rules: each path from a root is a conjunction of
comparisons of statistics. Lasso logistic regression weighs them, most at nothing, and the rest is compiled
into one Spark column expression over the statistics. Only the statistics are computed in Python, in one pass
over whole texts; id, language, source and labels are never inputs of a score.

Defined cases: a null text is scored like an empty one; a null id counts as the empty string for the folds;
with labels of one class only, or none, every score is the share of label 1 (one half without labels); repeated
rows are scored one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatab.llm import shared
from lumatab.llm.quality_rules import SPACES, repeated_words
from lumatab.llm.trees import boost
from lumatab.operators.sampling import smallest

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000

STATISTICS = (
    "log_words", "word_length", "distinct_share", "repeated_share", "same_as_last", "top_word_share", "line_words",
    "repeated_lines", "ended_share", "comma_share", "symbols", "pipes", "shouts", "digit_share", "upper_share", "letter_share",
    "one_char_words", "long_words", "bytes_per_char", "brackets",
)

_UPPER, _LOWER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))


def statistics(text: str | None) -> list[float]:
    """The whole text's statistics, in the order of STATISTICS."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for line in data.split(b"\n") if (x := line.strip())]
    chars = max(1, len(text) - sum(map(text.count, SPACES)))
    count = lambda marks: sum(map(data.count, marks))
    without = lambda cls: len(data) - len(data.translate(None, cls))
    upper, lower, digits = without(_UPPER), without(_LOWER), without(_DIGITS)
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)),
        chars / n,
        len(counts) / n,
        repeated_words(words) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        count((b". ", b".\n", b"? ", b"! ")) / n,
        data.count(b",") / n,
        count((b"#", b"*", b"$", b"%", b"&", b"<", b">", b"~", b"^", b"=")) / n,
        data.count(b"|") / n,
        data.count(b"!!") / n,
        digits / chars,
        upper / max(1, upper + lower),
        (upper + lower + len(data) - len(text)) / chars,
        float((sizes == 1).mean()),
        float((sizes > 20).mean()),
        len(data) / len(text),
        count((b"{", b"}", b"[", b"]", b"\\", b"_")) / n,
    ]


Rule = tuple[tuple[int, float, bool], ...]


@dataclass
class RuleModel:
    """sigmoid(base + sum of the weights of the rules that hold)."""

    base: float
    rules: list[Rule]
    weights: list[float]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return holds(self.rules, x)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.holds(x) @ np.array(self.weights), -700, 700)))

    def column(self, statistic: dict[int, Column]) -> Column:
        """The score as a Spark expression over the statistics."""
        z = F.lit(self.base)
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = F.lit(True)
            for f, cut, low in rule:
                cond = cond & ((statistic[f] <= cut) if low else (statistic[f] > cut))
            z = z + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'<=' if low else '>'} {c:.4g}" for f, c, low in r) for r, w in zip(self.rules, self.weights, strict=True)]


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, cut, low in rule:
            out[:, j] *= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out


def simplify(path: Rule) -> Rule:
    """One lower and one upper comparison a statistic at most, in the order of statistics."""
    low: dict[int, float] = {}
    high: dict[int, float] = {}
    for f, cut, is_low in path:
        if is_low:
            low[f] = min(cut, low.get(f, cut))
        else:
            high[f] = max(cut, high.get(f, cut))
    return tuple(sorted([*((f, c, True) for f, c in low.items()), *((f, c, False) for f, c in high.items())]))


def lasso_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float, rounds: int = 2000) -> tuple[float, np.ndarray]:
    """Base and weights that minimise mean logistic loss + penalty * sum |weights|, by accelerated proximal gradient; the base is free.

    Row i stands for n[i] rows, a share y[i] of them with label 1.
    """
    m, total = x.shape[1], n.sum()
    step = 4.0 / max(1e-9, 1.0 + float(np.linalg.norm(x * np.sqrt(n)[:, None], 2) ** 2) / total)
    p = float(np.clip((n * y).sum() / total, 1e-6, 1 - 1e-6))
    w, b = np.zeros(m), float(np.log(p / (1 - p)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        err = n * (1 / (1 + np.exp(-np.clip(x @ vw + vb, -500, 500))) - y)
        new_w = vw - step * (x.T @ err) / total
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = vb - step * err.sum() / total
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, max_rules: int = 400, penalties: tuple[float, ...] = (0.01, 0.003, 0.001, 0.0003), seed: int = 7) -> RuleModel:
    """Rules from boosted trees, weighed by lasso; the penalty is the one with the fewest errors, then the least loss, on a held-back fifth."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or share in (0.0, 1.0):
        p = float(np.clip(share, 1e-3, 1 - 1e-3))
        return RuleModel(float(np.log(p / (1 - p))), [], [])
    r = np.random.default_rng(seed)
    back = r.random(len(y)) < 0.2
    if not back.any() or back.all() or len(set(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    least = max(3, len(y) // 500)
    model = boost(x[~back], y[~back], rounds=50, depth=3, least=least, seed=seed)
    rules = list(dict.fromkeys(simplify(p) for t in model.trees for p in t.paths()))
    h = holds(rules, x[~back])
    support = h.mean(axis=0)
    first = {c.tobytes(): j for j, c in reversed([*enumerate(np.packbits(h.T > 0, axis=1))])}.values()  # rules that hold for the same rows are one
    keep = [j for j in sorted(first) if 0.002 < support[j] < 0.998][:max_rules]
    rules = [rules[j] for j in keep]
    if not rules:
        return fit(x[:0], np.full(0, share))
    h = h[:, keep]
    # rows for which the same rules hold are one, too
    _, at, inverse, n = np.unique(np.packbits(h > 0, axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    distinct, mean = h[at], np.bincount(inverse.ravel(), y[~back]) / n
    found = []
    for penalty in penalties:
        b, w = lasso_logistic(distinct, mean, n.astype(np.float64), penalty)
        test = (holds(rules, x[back]) if back.any() else h) @ w + b
        truth = y[back] if back.any() else y[~back]
        wrong = float(((test >= 0) != truth).mean())
        loss = float(np.logaddexp(0, np.where(truth == 1, -test, test)).mean())
        found.append((wrong, loss, b, w))
    _, _, b, w = min(found, key=lambda x: x[:2])
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(b, [rules[j] for j in used], [float(w[j]) for j in used])


def with_statistics(docs: DataFrame, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """The columns in keep and an array `stats` per row."""
    source = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text_col).cast("string").alias("_text_"))
    k, names = len(keep), [*keep, "stats"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [v for t in b.column(k) for v in statistics(t.as_py())]
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()))], names)

    return source.mapInArrow(run, f"{kinds}, stats array<double>")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, folds: int, held_out: int, size: int) -> DataFrame:
    """(key, label) of at most `size` labelled ids outside the held-out fold, by md5 of the id: the same rows whatever the order."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col), folds) != held_out))
    key = F.col(id_col).cast("string")
    return smallest(usable.select(key.alias("key"), F.col(label_col).cast("int").alias("label")), F.md5("key"), ["key", "label"], size)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> RuleModel:
    """A model from labelled rows outside the held-out fold."""
    with shared.steps(docs.sparkSession) as tables:
        chosen = tables.write(labelled_sample(labels, label_col, id_col, folds, held_out, sample), "labelled")
        rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "key")  # at most `sample` short rows
        stats = with_statistics(rows, "t", {"key": F.col("key"), "label": F.col("label")})
        got = stats.orderBy(F.md5("key"), "label", "stats").limit(sample).toArrow()  # again at most `sample`, should ids repeat
    x = got.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS)) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, got.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) per row."""
    rows = with_statistics(docs, text_col, {"id": F.col(id_col)})
    value = model.column({i: F.col("stats")[i] for i in range(len(STATISTICS))})
    rows = rows.select(F.col("id").alias(id_col), (fold(F.col("id"), folds) == held_out).alias("held_out"), value.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of one half or more."""
    at, name = docs.columns.index(text_col), "_stats_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [v for t in b.column(at) for v in statistics(t.as_py())]
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            yield b.append_column(name, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64())))

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
    value = model.column({i: F.col(name)[i] for i in range(len(STATISTICS))})
    return rows.where(value >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
