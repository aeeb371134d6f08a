"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, may_hold

FEATURES = (
    "size", "words", "word_bytes", "upper", "digits", "blanks", "lines", "high_bytes", "stops", "marks", "pipes", "shouts", "symbols",
    "distinct", "repeats", "same_lines", "entropy",
)

_CLASSES = {
    "upper": range(65, 91), "digits": range(48, 58), "blanks": (9, 10, 13, 32), "high_bytes": range(128, 256), "stops": b".,;:",
    "marks": b"'\"()[]{}<>/\\-_=+~`^", "pipes": b"|", "shouts": b"!?", "symbols": b"#$%&*@",
}


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, transformed: counts by log(1 + n), shares by the arcsine of the square root. Empty texts have zeros."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    share = {k: hist[list(v)].sum() / n for k, v in _CLASSES.items()}
    count, distinct = len(words), len(set(words))
    share["distinct"] = distinct / max(1, count)
    share["repeats"] = sum(map(operator.eq, words, words[1:])) / max(1, count - 1)
    share["same_lines"] = 1 - len(set(lines)) / len(lines)
    p = hist[hist > 0] / n
    value = {k: float(np.arcsin(np.sqrt(min(1.0, v)))) for k, v in share.items()}
    value |= {"size": np.log1p(n), "words": np.log1p(count), "word_bytes": np.log1p((n - hist[[9, 10, 13, 32]].sum()) / max(1, count)), "lines": np.log1p(len(lines) / n * 100), "entropy": float(-(p * np.log2(p)).sum())}
    return [float(value[k]) for k in FEATURES]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x0, x1, ...): the statistics of every row, in one pass over whole texts."""
    kind = dict(docs.dtypes)[id_col]
    names = [f"x{i}" for i in range(len(FEATURES))]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([statistics(t) for t in b["t"]], columns=names, dtype=float)
            out.insert(0, "id", b["id"].astype("Int64") if kind == "bigint" else b["id"])
            yield out

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(of, f"id {kind}, " + ", ".join(f"{n} double" for n in names))


@dataclass
class Discriminant:
    """Two classes, each with its mean and the inverse of the Cholesky factor of its shrunk covariance; a line calibrates their difference."""

    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, n: np.ndarray, total: np.ndarray, outer: np.ndarray, pooled: float, ridge: float) -> Discriminant:
        """From counts, sums and sums of outer products by class. pooled: share of the common covariance; ridge: share of a scaled identity."""
        means = total / n[:, None]
        cov = outer / n[:, None, None] - means[:, :, None] * means[:, None, :]
        common = (cov * (n / n.sum())[:, None, None]).sum(axis=0)
        scale = np.diag(np.maximum(np.diag(common), 1e-9))
        factors = [np.linalg.cholesky((1 - ridge) * ((1 - pooled) * c + pooled * common) + ridge * scale + 1e-9 * np.eye(len(scale))) for c in cov]
        whiten = np.stack([np.linalg.inv(f) for f in factors])
        offset = np.array([np.log(m / n.sum()) - np.log(np.diag(f)).sum() for m, f in zip(n, factors, strict=True)])
        return cls(means, whiten, offset)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, priors included."""
        density = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offset, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.difference(x)) + self.shift, -35, 35)))


def squash(d: np.ndarray) -> np.ndarray:
    """Differences grow with the square of a distance; calibration sees them on a root scale."""
    return np.sign(d) * np.sqrt(np.abs(d))


def _line(bins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of binned scores: slope and shift by damped Newton steps, held near (1, 0) by a ridge of one row's weight."""
    x, prior = np.stack((bins, np.ones_like(bins)), axis=1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + 0.5 * ((w - prior) ** 2).sum())

    w = prior
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (weight * (label - p)) - (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(step).max() * size < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Shares of the common covariance and of a scaled identity that cross-validation chooses from.
SHRINKAGE = ((0.15, 0.1), (0.05, 0.02), (0.15, 0.02), (0.4, 0.1), (0.8, 0.1), (0.8, 0.3))
FOLDS = 4


def train(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", choices: tuple[tuple[float, float], ...] = SHRINKAGE) -> Discriminant | None:
    """Fits on all labelled rows that aren't held out; only sums by class and fold and histograms of scores reach the driver.

    choices (pooled, ridge): the one whose calibrated scores of rows outside the fitted folds have the least log-loss; of equal ones the
    first. The line that calibrates is that of those scores. None if a class has fewer than two rows; without enough rows for folds, the
    first choice. Rows with null ids or labels teach nothing; repeated rows count again.
    """
    k = len(FEATURES)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)")
    rows = feats.join(known, "id").where(~held_out(F.col("id"))).withColumn("fold", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(FOLDS)).cast("int"))
    rows = materialize(rows, "quality-train")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = rows.groupBy("fold", "y").agg(F.count("*").alias("n"), F.array(*[F.sum(f"x{i}") for i in range(k)]).alias("s"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("o")).collect()
    n, total, outer = np.zeros((FOLDS, 2)), np.zeros((FOLDS, 2, k)), np.zeros((FOLDS, 2, k, k))
    for r in sums:
        n[r["fold"], r["y"]], total[r["fold"], r["y"]] = r["n"], r["s"]
        for (i, j), v in zip(pairs, r["o"], strict=True):
            outer[r["fold"], r["y"], i, j] = outer[r["fold"], r["y"], j, i] = v
    if n.sum(axis=0).min() < 2:
        return None
    fit = lambda keep, c: Discriminant.fit(n[keep].sum(axis=0), total[keep].sum(axis=0), outer[keep].sum(axis=0), *c)
    others = [np.arange(FOLDS) != f for f in range(FOLDS)]
    folded = min(n[o].sum(axis=0).min() for o in others) >= 2
    models = [[fit(o, c) for o in others] if folded else [fit(slice(None), c)] * FOLDS for c in (choices if folded else choices[:1])]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, fold = b[[f"x{i}" for i in range(k)]].to_numpy(), b["fold"].to_numpy()
            for c, of in enumerate(models):
                d = np.zeros(len(b))
                for f, m in enumerate(of):
                    d[fold == f] = m.difference(x[fold == f])
                yield pd.DataFrame({"c": c, "y": b["y"], "bin": np.round(np.clip(squash(d), -30, 30) * 10).astype(np.int64)}).value_counts().reset_index()

    hist = rows.mapInPandas(binned, "c int, y int, bin long, count long").groupBy("c", "y", "bin").agg(F.sum("count").alias("n")).collect()  # 1,202 rows a choice at most
    lines = []
    for c in range(len(models)):
        mine = sorted((r["bin"], r["y"], r["n"]) for r in hist if r["c"] == c)
        bins, label, weight = (np.array(v, float) for v in zip(*mine, strict=True))
        slope, shift = _line(bins / 10, label, weight)
        z = slope * bins / 10 + shift
        lines.append(((weight * (np.logaddexp(0, z) - label * z)).sum(), c, slope, shift))
    _, best, slope, shift = min(lines)
    model = fit(slice(None), choices[best])
    model.slope, model.shift = slope, shift
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """Per document: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only statistics of the text enter a score. Null text counts as empty and is scored like any text; rows with a null id are
    scored and never held out; repeated rows get equal scores; other columns are ignored. Without a model (see train)
    nothing speaks against a text: all scores are 1.
    """
    feats = materialize(features(docs, id_col, text_col), "quality-features")
    model, kind = train(feats, labels, id_col, label_col, **options), dict(docs.dtypes)[id_col]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[[f"x{i}" for i in range(len(FEATURES))]].to_numpy(float)
            yield pd.DataFrame({"id": b["id"].astype("Int64") if kind == "bigint" else b["id"], "score": model.score(x) if model else np.ones(len(x))})

    out = feats.mapInPandas(score, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """docs without the rows whose predicted quality is 0; all columns stay, rows with a null id are judged like others.

    Every row is judged by its own text, in place: the model is fitted on the statistics of labelled rows alone, then
    a second pass scores and filters, and no row is joined or moved.
    """
    known = materialize(labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id")).where(~held_out(F.col("id"))).distinct(), "quality-known")
    feats = features(may_hold(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), F.col("id"), known), "id", "t")
    model = train(feats, labels, id_col, label_col, **options)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))

    return docs.where(score(F.col(text_col)) >= threshold)
