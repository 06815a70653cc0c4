"""Exact isotonic regression over any number of distinct scores.

Rows are combined to one cell per distinct score. Adjacent cells whose means fall are pooled until none do; in whatever order
violators are pooled, the result is the same, so it can be done in pieces: cells are dealt by their place in chunks of bounded
size, each chunk is pooled in one task, and the blocks that come out are numbered and dealt again with the chunk borders moved by
half a chunk, until no border has a violation. The check is on the borders of all chunks, so the fit is the least-squares one and not
an approximation; a round costs what is left of the blocks. Blocks are few where scores are noisy (a round or two). The most rounds
come from a long rising run that a heavy low end pulls down: as many as it has half chunks.

NULL scores, labels and weights, and weights of zero or less, take no part. NaN scores take none either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import _ranges, _with_offsets
from tidemark.session import materialize

C = F.col
#: Blocks pooled in one task.
CHUNK = 100_000
BLOCK = "chunk long, i long, lo double, hi double, w double, wy double"


def _pooled(blocks: DataFrame) -> DataFrame:
    """Blocks with a ``chunk`` and a place ``i``, pooled inside their chunks."""

    def pool(chunk: pa.Table) -> pa.Table:
        order = np.argsort(chunk.column("i").to_numpy())
        lo, hi, w, wy = (chunk.column(c).to_numpy()[order].tolist() for c in ("lo", "hi", "w", "wy"))
        out: list[list[float]] = []  # lo, hi, w, wy
        for block in zip(lo, hi, w, wy, strict=True):
            now = list(block)
            while out and out[-1][3] * now[2] >= now[3] * out[-1][2]:
                last = out.pop()
                now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
            out.append(now)
        n = len(out)
        number = chunk.column("chunk")[0].as_py() if n else 0
        columns = list(zip(*out, strict=True)) if n else [[]] * 4
        return pa.table([pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64()), *[pa.array(c, pa.float64()) for c in columns]], names=["chunk", "i", "lo", "hi", "w", "wy"])

    return materialize(blocks.select("chunk", "i", "lo", "hi", "w", "wy").groupBy("chunk").applyInArrow(pool, BLOCK), "isotonic-blocks")


def _violations(blocks: DataFrame) -> int:
    """Borders between chunks where the mean does not rise; a row per chunk is ordered."""
    mean = C("wy") / C("w")
    ends = blocks.groupBy("chunk").agg(F.min_by(mean, "i").alias("first"), F.max_by(mean, "i").alias("last"))
    before = F.lag("last").over(Window.orderBy("chunk"))
    return ends.select((before >= C("first")).alias("bad")).where("bad").count()


def _numbered(blocks: DataFrame) -> DataFrame:
    """``pos``: the place of a block among all, from the counts of the chunks before its own."""
    counts = blocks.groupBy("chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.join(counts.select("chunk", F.coalesce(before, F.lit(0)).alias("_before")), "chunk").withColumn("pos", C("_before") + C("i")).drop("_before")


@dataclass(frozen=True)
class Isotonic:
    """``blocks``: lo, hi and value, rising. Between blocks the value is interpolated; beyond the ends it is the ends' own."""

    blocks: DataFrame

    def knots(self) -> DataFrame:
        ends = F.array_distinct(F.array("lo", "hi"))
        return self.blocks.select(F.explode(ends).alias("_score"), "value")

    def values(self, scores: DataFrame, score: str) -> DataFrame:
        """``(score, value)`` for distinct scores: each is placed between its knots in the order of all, in ranges; a
        range takes the knots around it from the ranges beside it. Both neighbours are running values, the upper one in falling
        order: a frame that reaches to the end would be read again for every row."""
        knots = self.knots().select("_score", C("value").alias("_v"))
        points = scores.select(C(score).cast("double").alias("_score"), F.lit(None).cast("double").alias("_v")).distinct().unionByName(knots)
        points = points.groupBy("_score").agg(F.max("_v").alias("_v")).where(C("_score").isNotNull() & ~F.isnan("_score"))
        ranges = _ranges(materialize(points, "isotonic-points"), "_score", [], [], False)
        knot = F.when(C("_v").isNotNull(), F.struct(C("_score").alias("s"), C("_v").alias("v")))
        here = Window.partitionBy("_range")
        inside = ranges.withColumns({
            "_lo": F.last(knot, True).over(here.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)),
            "_hi": F.last(knot, True).over(here.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0))})
        sides = ranges.groupBy("_range").agg(F.min(knot).alias("_a"), F.max(knot).alias("_b"))
        before = (Window.unboundedPreceding, -1)
        sides = sides.select(
            C("_range").alias("_r"), F.last("_b", True).over(Window.orderBy("_range").rowsBetween(*before)).alias("_left"),
            F.last("_a", True).over(Window.orderBy(F.desc("_range")).rowsBetween(*before)).alias("_right"))
        placed = inside.join(sides, C("_range") == C("_r")).withColumns({"_lo": F.coalesce("_lo", "_left"), "_hi": F.coalesce("_hi", "_right")})
        share = (C("_score") - C("_lo.s")) / F.nullif(C("_hi.s") - C("_lo.s"), F.lit(0.0))
        value = F.coalesce(C("_lo.v") + (C("_hi.v") - C("_lo.v")) * F.coalesce(share, F.lit(0.0)), C("_lo.v"), C("_hi.v"))
        return placed.select(C("_score").alias(score), value.alias("value"))


def fit(df: DataFrame, score: str, label: str, weight: str | None = None, chunk: int | None = None) -> Isotonic:
    """The non-decreasing function of ``score`` nearest to ``label`` in weighted least squares."""
    chunk = chunk or CHUNK
    rows = df.select(C(score).cast("double").alias("_score"), C(label).cast("double").alias("_y"), (F.lit(1.0) if weight is None else C(weight).cast("double")).alias("_w"))
    rows = rows.where(C("_score").isNotNull() & ~F.isnan("_score") & C("_y").isNotNull() & (C("_w") > 0))
    # one zero: the two have one place
    cells = rows.groupBy(F.when(C("_score") == 0, 0.0).otherwise(C("_score")).alias("_score")).agg(F.sum("_w").alias("w"), F.sum(C("_w") * C("_y")).alias("wy"))
    ranges = _ranges(materialize(cells, "isotonic-cells"), "_score", [], [], False)
    placed = _with_offsets(ranges, [], {"rows": F.lit(1).cast("long")})
    blocks = placed.select((C("_o_rows") + C("_at") - C("_first")).alias("pos"), C("_score").alias("lo"), C("_score").alias("hi"), "w", "wy")
    shift = 0
    while True:
        blocks = _pooled(blocks.withColumns({"chunk": F.floor((C("pos") + shift) / chunk), "i": C("pos")}))
        if not _violations(blocks):
            return Isotonic(blocks.select("lo", "hi", (C("wy") / C("w")).alias("value")))
        blocks, shift = _numbered(blocks), chunk // 2 - shift
