"""Self-attentive sequence scoring: item and position embeddings, pre-norm blocks with causal and padding mask, tied output.

A forward pass in NumPy over Arrow batches of users; weights are broadcast (their size is fixed by the configuration).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def random_weights(items: int, dim: int = 16, length: int = 50, blocks: int = 2, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.02, s).astype(np.float32)
    layer = lambda: {"n1": (np.ones(dim, np.float32), np.zeros(dim, np.float32)), "n2": (np.ones(dim, np.float32), np.zeros(dim, np.float32)), "qkv": draw(dim, 3 * dim), "out": draw(dim, dim), "up": draw(dim, dim), "down": draw(dim, dim)}
    item = draw(items + 1, dim)
    item[0] = 0
    return {"item": item, "position": draw(length, dim), "blocks": [layer() for _ in range(blocks)], "norm": (np.ones(dim, np.float32), np.zeros(dim, np.float32))}


def _norm(x: np.ndarray, scale: tuple) -> np.ndarray:
    mean, var = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - mean) / np.sqrt(var + 1e-8) * scale[0] + scale[1]


def encode(history: np.ndarray, w: dict) -> np.ndarray:
    """The last position's feature for left-padded histories (0 is padding)."""
    live = history > 0
    x = (w["item"][history] + w["position"][None, -history.shape[1] :]) * live[..., None]
    n, dim = history.shape[1], x.shape[-1]
    allowed = np.tril(np.ones((n, n), bool))[None] & live[:, None, :]
    for b in w["blocks"]:
        q, k, v = np.split(_norm(x, b["n1"]) @ b["qkv"], 3, -1)
        score = np.where(allowed, q @ k.transpose(0, 2, 1) / np.sqrt(dim), -1e9)
        weight = np.exp(score - score.max(-1, keepdims=True))
        x = x + (weight / weight.sum(-1, keepdims=True)) @ v @ b["out"]
        x = (x + np.maximum(_norm(x, b["n2"]) @ b["up"], 0) @ b["down"]) * live[..., None]
    return _norm(x, w["norm"])[:, -1]


def score_users(histories: DataFrame, weights: dict, k: int = 10, cells: int = 4_000_000) -> DataFrame:
    """user_id, model_index, score, rank from histories (user_id, padded array, and seen array if there are more items to leave out).

    The best unseen items, ties by index, fewer where fewer are unseen. ``cells`` scores are held at once.
    """
    shared = histories.sparkSession.sparkContext.broadcast(weights)
    more = ["seen"] if "seen" in histories.columns else []
    users = max(1, min(128, cells // len(weights["item"])))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[at : at + users] for whole in batches for at in range(0, len(whole), users)):
            history = np.stack(pdf.padded.to_list()).astype(np.int64)
            score = encode(history, shared.value) @ shared.value["item"].T
            score[:, 0] = -np.inf
            np.put_along_axis(score, history, -np.inf, 1)
            for row, seen in zip(score, pdf.seen if more else [], strict=False):
                row[np.asarray(seen, np.int64)] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            n = top.shape[1]
            rows, place = np.repeat(np.arange(len(pdf)), n), np.tile(np.arange(1, n + 1), len(pdf))
            found = score[rows, top.ravel()].astype(float)
            yield pd.DataFrame({"user_id": pdf.user_id.to_numpy()[rows], "model_index": top.ravel(), "score": found, "rank": place})[np.isfinite(found)]

    return histories.select("user_id", "padded", *more).mapInPandas(one, "user_id string, model_index long, score double, rank long")
