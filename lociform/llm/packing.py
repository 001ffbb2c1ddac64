"""Texts put together into containers of a fixed number of tokens (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.tokens import TokenCounter

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items packed against each other; enough that the room left hardly falls any more.
BLOCK = 4096
#: Attention's share of a token's cost grows by this with each token before it (6 x a width of 2,048).
QUADRATIC = 1 / 12288
#: Costs count as equal within such parts of a full container's cost; of the packings they give, the one with the fewest containers is taken.
TOLERANCES = (1 / 16, 1 / 8, 1 / 4, 1 / 2)


def balance(sizes: np.ndarray, capacity: int, tolerance: float, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray]:
    """Containers of falling sizes, and the cost of each container.

    Starts from as many containers as the sizes need at least. Each item goes to the
    container of lowest cost (linear plus quadratic in its items) that has room for it;
    of containers whose costs fall into the same step of ``tolerance``, to the one with
    least room. Where none has room, a container is added. Without tolerance all
    containers end up with the same small rest that no item fits into.
    """
    n = max(1, -(-int(sizes.sum()) // capacity))
    cost, room = np.zeros(n + len(sizes)), np.full(n + len(sizes), capacity)
    each, step = sizes + quadratic * sizes.astype(float) ** 2, tolerance * (capacity + quadratic * capacity**2)
    rank, place = np.full(n + len(sizes), capacity if step else 0, float), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        by = np.where(room[:n] >= size, rank[:n], np.inf)
        j = int(by.argmin())
        if by[j] == np.inf:
            j, n = n, n + 1
        cost[j] += each[i]
        room[j] -= size
        rank[j] = cost[j] // step * (capacity + 1) + room[j] if step else cost[j]
        place[i] = j
    return place, cost[:n]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item: the balance with the fewest containers, then the evenest cost."""
    order = np.argsort(-sizes, kind="stable")
    tries = [balance(sizes[order], capacity, tolerance) for tolerance in TOLERANCES]
    place, _ = min(tries, key=lambda t: (len(t[1]), t[1].std()))
    out = np.empty(len(sizes), np.int64)
    out[order] = place
    return out


def pack_documents(df: DataFrame, ident: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Container of every text or, of texts longer than a container, of every piece.

    Columns: ``ident, piece_no, token_start, n_tokens, container_id``. Texts are measured
    in tokens of the vocabulary (a file of ranks that every executor can read) and never
    cut unless longer than ``capacity``; those are cut at whole containers, and the rest
    is packed as an item. Items are packed in blocks of ``block`` as they come in a task,
    largest first, so memory stays bounded, nothing is shuffled and no text leaves its
    task; only a task's last block may be short. Null texts have no row; texts without
    tokens take no room and have a null container. Repeated rows are packed each.
    Container numbers are unique over all tasks and the same if a task runs again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(vocabulary)
        numbers = iter(range(TaskContext.get().partitionId() << 40, 1 << 63))
        waiting: list[tuple] = []

        def emit(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["ident", "piece_no", "token_start", "n_tokens", "container_id"]).astype({"container_id": "Int64"})

        def flush() -> pd.DataFrame:
            place = pack(np.array([w[3] for w in waiting]), capacity)
            name = [next(numbers) for _ in range(place.max() + 1)]
            rows = [(*w, name[p]) for w, p in zip(waiting, place)]
            waiting.clear()
            return emit(rows)

        for part in parts:
            whole = []
            for who, words in zip(part["ident"], part["words"]):
                n, k = counter.count(words), 0
                while n - k * capacity >= capacity:
                    whole.append((who, k + 1, k * capacity, capacity, next(numbers)))
                    k += 1
                if n == 0:
                    whole.append((who, 1, 0, 0, None))
                elif n > k * capacity:
                    waiting.append((who, k + 1, k * capacity, n - k * capacity))
                if len(waiting) == block:
                    yield flush()
            yield emit(whole)
        if waiting:
            yield flush()

    kind = df.select(ident).dtypes[0][1]
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("words")).where("words is not null")
    return rows.mapInPandas(run, f"ident {kind}, piece_no int, token_start long, n_tokens int, container_id long")


def container_report(packed: DataFrame, capacity: int = 2048, quadratic: float = QUADRATIC) -> DataFrame:
    """One row on the containers: how many, the least possible, share filled, and the spread of their costs."""
    cost = F.sum(F.col("n_tokens") + quadratic * F.col("n_tokens").cast("double") ** 2)
    each = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), cost.alias("cost"))
    return each.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("n") / capacity).alias("n_least"),
        F.sum("n").alias("n_tokens"),
        (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("share_filled"),
        (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"),
    )
