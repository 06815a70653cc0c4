"""Near-duplicates by SimHash fingerprints in vantage-point trees.

A tree over Hamming distance is fitted on a bounded sample of the distinct fingerprints and then indexes every
one of them. A node sends fingerprints nearer to its vantage point than a boundary to one side, the rest to the
other. By the triangle bound two fingerprints within ``radius`` of each other lie in the same leaf unless one of
them is within ``radius`` of a boundary; fingerprints just below a boundary are therefore sent to both sides, and
every linked pair meets in some leaf. A leaf is solved exactly, splitting itself further where it is large, and
hands on a spanning forest of its links rather than all pairs.

Copies share a fingerprint and enter once. Defined results: a null or empty text has fingerprint zero, which links
like any other; a null doc_id takes its component's id; repeated rows get the same result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, ship, store
from tidemark.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Distinct fingerprints the tree is fitted on, give or take a percent (it indexes all of them), and the leaf size aimed at.
SAMPLE, LEAF = 65_536, 1024
#: Shingle hashes turned into bits at once.
_BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1:].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = hashes[i:i + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` per row, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp long")


# --- vantage-point tree ------------------------------------------------------------------------------------

def _border(distances: np.ndarray) -> int | None:
    """The distance that parts a node most evenly (below it, from it on); None if all are equal."""
    counts = np.bincount(distances, minlength=66)
    below = np.cumsum(counts)[:-1]
    uneven = np.abs(2 * below - len(distances))
    best = int(np.argmin(np.where((below == 0) | (below == len(distances)), len(distances) + 1, uneven)))
    return best + 1 if 0 < below[best] < len(distances) else None


def grow(sample: np.ndarray, leaf: int, leaves: list | None = None) -> tuple:
    """A tree as nested tuples: ``(vantage point, border, near side, far side)``, or ``(leaf number,)``."""
    leaves = [] if leaves is None else leaves
    if len(sample) > leaf:
        # of a few candidates the vantage point with the widest spread of distances, so that few lie at the border
        candidates = sample[np.linspace(0, len(sample) - 1, 8).astype(int)]
        spread = [np.bitwise_count(sample ^ c).astype(np.int64) for c in candidates]
        pick = int(np.argmax([d.std() for d in spread]))
        border = _border(spread[pick])
        if border is not None:
            near = spread[pick] < border
            return candidates[pick], border, grow(sample[near], leaf, leaves), grow(sample[~near], leaf, leaves)
    leaves.append(None)
    return (len(leaves) - 1,)


def route(fps: np.ndarray, tree: tuple, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(leaf, fingerprints)`` with every pair within ``radius`` together in at least one leaf."""
    if not len(fps):
        return
    if len(tree) == 1:
        yield tree[0], fps
        return
    vantage, border, near, far = tree
    d = np.bitwise_count(fps ^ vantage).astype(np.int64)
    yield from route(fps[d < border], near, radius)
    yield from route(fps[d >= border - radius], far, radius)  # those just below may have partners from the border on


def forest(fps: np.ndarray, radius: int, block: int = 512, leaf: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all pairs within ``radius`` of distinct ``fps``."""
    fps = np.unique(fps)
    if len(fps) > leaf:
        tree = grow(fps, leaf)
        if len(tree) > 1:
            parts = [forest(p, radius, block, max(leaf, len(p) // 2 if len(p) > 0.9 * len(fps) else leaf) if len(p) < len(fps) else len(p)) for _, p in route(fps, tree, radius)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    root = np.arange(len(fps))
    for i in range(0, len(fps), block):
        # columns from i on: each pair is seen once
        rows, cols = np.nonzero(np.bitwise_count(fps[i:i + block, None] ^ fps[None, i:]) <= radius)
        keep = rows < cols
        rows, cols = rows[keep] + i, cols[keep] + i
        while len(rows):
            a, b = root[rows], root[cols]
            open_ = a != b
            if not open_.any():
                break
            rows, cols, a, b = rows[open_], cols[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def vp_links(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """``(a, b)``: links spanning the components of all pairs of distinct ``fp`` values within ``radius`` bits."""
    total = fps.count()
    # those whose hash is in the lowest part: about ``sample`` rows in all, however many tasks send them
    part = fps if total <= sample else fps.where(F.xxhash64("fp") < F.lit(int(sample / total * 2.0**64 - 2.0**63)))
    drawn = np.sort(part.select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
    tree = grow(drawn, max(8, leaf * len(drawn) // max(total, 1)))

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, part in route(batch.column(0).to_numpy().view(np.uint64), tree, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number, np.int32)), pa.array(part.view(np.int64))], ["leaf", "fp"])

    def solve(group: pa.Table) -> pa.Table:
        a, b = forest(group.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    df = fps.select("fp")
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return df.mapInArrow(to_leaves, "leaf int, fp long").groupBy("leaf").applyInArrow(solve, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that can
    be reached over links of at most ``radius`` differing bits."""
    docs = store(fingerprints(df, id_col, text_col), "fingerprints")
    classes = store(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    nodes = components(store(vp_links(classes, radius), "forest"))
    joined = nodes.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "first_id")
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = joined.join(smallest, "root").select("fp", "component_id")
    ids = store(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "components")
    return docs.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
