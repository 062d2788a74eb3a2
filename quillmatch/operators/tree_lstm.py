"""A binary tree LSTM over trees in node rows: leaves and pairs of states composed bottom-up, one task a group of trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Cell:
    """Weights drawn once from a seed: a leaf module and gates over the two children's states."""

    def __init__(self, dim: int = DIM, seed: int = 42):
        g = np.random.default_rng(seed)
        scale = np.sqrt(2.0 / dim)
        self.dim, self.embed = dim, g.normal(0, 1, (100, dim))
        self.leaf_c, self.leaf_o = (g.normal(0, scale, (dim, dim)) for _ in "co")
        self.gates = {k: (g.normal(0, scale, (dim, dim)), g.normal(0, scale, (dim, dim))) for k in ("i", "fl", "fr", "u", "o")}

    def leaf(self, node_type: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed[node_type % 100]
        c = x @ self.leaf_c
        return c, _sigmoid(x @ self.leaf_o) * np.tanh(c)

    def join(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        gate = {k: a[1] @ left + b[1] @ right for k, (left, right) in self.gates.items()}
        c = _sigmoid(gate["i"]) * np.tanh(gate["u"]) + _sigmoid(gate["fl"]) * a[0] + _sigmoid(gate["fr"]) * b[0]
        return c, _sigmoid(gate["o"]) * np.tanh(c)

    def state(self, types: np.ndarray, parents: np.ndarray) -> np.ndarray:
        """Hidden state of the root: a node joins its own leaf state with its children's, one after the other."""
        states: dict[int, tuple] = {}
        for i in range(len(types) - 1, -1, -1):  # preorder backwards meets children before parents, last child first
            own = self.leaf(int(types[i]))
            for child in states.pop(("kids", i), []):
                own = self.join(own, child)
            states[i] = own
            if parents[i] >= 0:
                states.setdefault(("kids", int(parents[i])), []).insert(0, states.pop(i))
        return states[0][1]


def embed(nodes: DataFrame, dim: int = DIM, seed: int = 42) -> DataFrame:
    """unit and embedding of every tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node_id")
        h = Cell(dim, seed).state(rows["node_type"].to_numpy(), rows["parent_id"].fillna(-1).to_numpy().astype(int))
        return pd.DataFrame({"unit": [rows["unit"].iloc[0]], "embedding": [np.round(h, 6).tolist()]})

    return nodes.select("unit", "node_id", "parent_id", "node_type").groupBy("unit").applyInPandas(run, "unit string, embedding array<double>")


def head(embeddings: DataFrame, pairs: DataFrame, seed: int = 43) -> DataFrame:
    """a, b, cosine, and the learned head's score: a logistic of the product and the distance of two embeddings."""
    from ..functions import tensor as L

    a = embeddings.select(F.col("unit").alias("a"), F.col("embedding").alias("x"))
    b = embeddings.select(F.col("unit").alias("b"), F.col("embedding").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("cosine", L.cosine(F.col("x"), F.col("y")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.random.default_rng(seed)
        w = g.normal(0, 0.5, (2 * DIM,))
        for p in batches:
            s = [_sigmoid(np.concatenate([np.array(x) * y, np.abs(np.array(x) - y)]) @ w) for x, y in zip(p["x"], p["y"])]
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "cosine": p["cosine"], "score": np.round(s, 6)})

    return both.mapInPandas(run, "a string, b string, cosine double, score double")
