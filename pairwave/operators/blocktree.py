"""Blocks as leaves of a tree by medians: about as many pivots in each, wherever they cluster.

The tree is made of a bounded sample of the pivots, which only says where blocks end: results don't depend on it. It's sent to all
workers, a plane for each node. A pivot goes to its leaf, a point around to every leaf that its cube of a radius reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots that are sampled, and levels of the tree at most.
SAMPLE, LEVELS = 1 << 17, 16


class Leaves:
    """axis and value of each node's plane, in the order of a heap from 1; points on a plane go down."""

    def __init__(self, xyz: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.value = np.zeros(1 << levels, np.int8), np.full(1 << levels, np.inf)
        parts = [xyz]
        for level in range(levels):
            below = []
            for k, part in enumerate(parts):
                node, axis = (1 << level) + k, 0
                if len(part):
                    axis = int(np.argmax(part.max(0) - part.min(0)))
                    self.axis[node], self.value[node] = axis, np.median(part[:, axis])
                low = part[:, axis] <= self.value[node]
                below += [part[low], part[~low]]
            parts = below

    def of(self, xyz: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.ones(len(xyz), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (xyz[np.arange(len(xyz)), self.axis[node]] > self.value[node])
        return node

    def reached(self, xyz: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Points and the leaves that their cubes reach."""
        at, node = np.arange(len(xyz)), np.ones(len(xyz), np.int64)
        radius *= 1 + 1e-9
        for _ in range(self.levels):
            x, plane = xyz[at, self.axis[node]], self.value[node]
            low, high = x - radius <= plane, x + radius > plane
            at, node = np.concatenate([at[low], at[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
        return at, node

    def placed(self, p: DataFrame, q: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
        """p with its leaf as gx (gy, gz: 0), q with each leaf that it reaches."""
        sent = p.sparkSession.sparkContext.broadcast(self)  # 2^LEVELS planes at most

        def run(prefix: str, around: bool):
            def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    xyz = np.stack([batch.column(f"{prefix}{c}").to_numpy(zero_copy_only=False) for c in "xyz"], 1)
                    at, node = sent.value.reached(xyz, radius) if around else (np.arange(len(xyz)), sent.value.of(xyz))
                    for k in range(0, len(at), 1 << 16):
                        part, leaf = batch.take(pa.array(at[k : k + (1 << 16)])), node[k : k + (1 << 16)]
                        zero = pa.array(np.zeros(len(leaf), np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), zero, zero, *part.columns], ["gx", "gy", "gz", *batch.schema.names])

            return rows

        schema = lambda df: "gx int, gy int, gz int, " + ", ".join(f"{n} {t}" for n, t in df.dtypes)
        return p.mapInArrow(run("p", False), schema(p)), q.mapInArrow(run("q", True), schema(q))


def leaves_of(p: DataFrame, points: int) -> Leaves:
    """A tree whose leaves hold about so many pivots (columns px, py, pz)."""
    n = p.count()
    sample = p.select("px", "py", "pz") if n <= SAMPLE else p.select("px", "py", "pz").sample(SAMPLE / n, 1).limit(2 * SAMPLE)
    found = sample.toArrow()
    xyz = np.stack([found.column(k).to_numpy() for k in range(3)], 1) if n else np.zeros((0, 3))
    tasks = 2 * p.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, -(-n // points), min(tasks, n // 64))
    return Leaves(xyz, min(LEVELS, (wanted - 1).bit_length()))
