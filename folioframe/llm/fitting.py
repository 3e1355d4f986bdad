"""What the classifiers share: bounded training samples and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a row without id."""
    return F.crc32(F.col(id_column).cast("string")) % parts


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores where a column (in any case) has that name already."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sample_rows(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, values: tuple = (0, 1)
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents for each label value.

    The rows with the smallest hashes of their ids are chosen. The ids, at most ``rows`` for each value, are the only
    thing that is broadcast.
    """
    known = labels.filter(keep & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    chosen = None
    for value in values:
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").filter(F.col("text").isNotNull())


def stands_for(labels: DataFrame, label: str, keep: Column, rows: int) -> dict[int, float]:
    """For each label value, how many rows a row of ``sample_rows`` stands for."""
    known = labels.filter(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return {r[0]: max(1.0, r[1] / rows) for r in known.groupBy(label).count().collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the constant first) of a ridge logistic regression, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    weights = np.zeros(x.shape[1])
    penalty = ridge * len(x) / 1000 * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1]),
            x.T @ (y - p) - penalty @ weights,
        )
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def best_cut(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The margin that parts the labels with the highest F1; ``weight`` is how many rows a sampled row stands for."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum((y * weight)[order])
    score = 2 * hits / (np.cumsum(weight[order]) + max(1, (y * weight).sum()))
    at = int(np.argmax(score))
    following = margin[order[at + 1]] if at + 1 < len(y) else margin[order[at]] - 1
    return float((margin[order[at]] + following) / 2)
