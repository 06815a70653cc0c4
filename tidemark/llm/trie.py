"""Prefix trie of conversations: which beginnings are shared, by whom, and what sharing them saves.

A node is a distinct sequence of first turns (role and text); its members are the conversations that start with it. Texts are
read once, for their digest. A prefix is known by 128 bits: four sums, over its turns, of 32 bits of SHA-256(depth, turn's digest),
so the prefix at every depth is a running sum and a conversation of any length is spread over its ranges.

Counters of prefix digests are kept in a count-min sketch of two rows, saturated at two (``screen``). An estimate never falls
below the count, so an estimate of one proves that no other conversation shares the prefix, nor any longer one: that tail's nodes are
emitted where they stand. Only prefixes that may be shared are shuffled and grouped exactly; false alarms of the sketch come out of that
with their one member. Its size follows the number of prefixes up to ``MAX_BITS``; beyond, more is shuffled and nothing else changes.

What a node needs of its subtree needs no walk over the tree: m(c), the depth from which conversation c is the smallest member,
says all. A node's children are its members with m <= depth + 1 that go on; its leaves are its members that are smallest at a childless
end; and each member saves the bytes of its turns from the node's depth up to m(c) - 1, held there by a smaller one.

Defined results: null role or text is empty; turns stand by turn (null first), then role, then digest; rows without conv_id are
one conversation, not rebuilt, the smallest member of nothing it shares, written as empty text; repeated rows are turns of their own;
an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, map_batches, match, placed, runs, ship, store
from tidemark.llm.merkle import CRC_SQL, crc_sql

#: Cells of a sketch row, as powers of two, and cells a prefix. Two rows of 2^27 bits are 32 MB, broadcast.
MIN_BITS, MAX_BITS, CELLS_EACH = 16, 27, 4
#: Cells of a sketch row handled together; prefixes a task counts before it hands them on; ids hashed together.
CHUNK_BITS, PENDING, ID_CHUNK = 16, 1 << 22, 4096
NOTHING = sha256(b"").hexdigest()
LANES = ("s1", "s2", "s3", "s4")
MASK = (1 << 32) - 1


# --- conversations -----------------------------------------------------------------------------------------

def _turns(turns: DataFrame) -> DataFrame:
    """Turns in order: conv_id, digest, bytes, and their place by ``_range`` and ``_at``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    narrow = turns.select("conv_id", "turn", role.alias("role"), told.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("_row"))
    return dealt(store(narrow, "turns"), "conv_id", "turn", "role", "digest", "_row", name="turns-dealt").drop("turn", "role", "_row")


def rebuild(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)`` after each conversation c has taken its first h turns from conversation c - c % group,
    h = crc32(c) % heads. Conversations: conv_id, n. Turns: conv_id, part, depth (from 1), digest, bytes; parts in order hold
    a conversation's turns."""
    ranged = _turns(turns)
    found = runs(ranged, "conv_id")
    own = found.groupBy("conv_id").agg(F.max("_total").alias("own"))
    first = (F.col("conv_id") % group == 0) | F.col("conv_id").isNull()
    heads_of = F.when(first, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    convs = own.withColumns({"h": heads_of, "base": F.col("conv_id") - F.col("conv_id") % group})
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("lent")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = store(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")

    at = F.col("_before") + F.col("_at") - F.col("_first")
    facts = match(found, convs.select("conv_id", "h", "taken"), "conv_id")
    seen = match(ranged, facts, "conv_id", "_range").withColumn("at", at)
    kept = seen.where("at >= h").select("conv_id", F.col("_range").alias("part"), (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "bytes")
    takers = convs.where("taken > 0").select("conv_id", "base", "taken")
    lent = placed(ranged, "conv_id").where((F.col("pos") < heads - 1) & F.col("conv_id").isNotNull()).withColumnRenamed("conv_id", "base").drop("n")
    taken = lent.join(takers, "base").where("pos < taken").select("conv_id", F.lit(-1).cast("long").alias("part"), (F.col("pos") + 1).alias("depth"), "digest", "bytes")
    return convs.select("conv_id", "n"), store(kept.withColumn("part", F.col("part").cast("long")).union(taken), "rebuilt")


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per conversation and depth: the prefix (k1, k2), the one before it (p1, p2), ``upto``, the bytes of the turns before its
    last, ``bytes`` of that, and n and total (bytes) of the conversation. Stored in order of the conversations' turns."""
    told = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    words = turns.withColumn("told", told).select("conv_id", "part", "depth", "bytes", *[F.conv(F.substring("told", 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(LANES)])
    sums = {**{s: s for s in LANES}, "upto": "bytes"}
    parts = words.groupBy("conv_id", "part").agg(*[F.sum(c).alias(f"_{s}") for s, c in sums.items()])
    group = Window.partitionBy("conv_id")
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv_id", "part", *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"o_{s}") for s in sums], F.sum("_upto").over(group).alias("total"))
    offsets = match(offsets, convs, "conv_id")
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = match(words, offsets, "conv_id", "part").withColumns({f"r_{s}": F.sum(c).over(inside) + F.col(f"o_{s}") for s, c in sums.items()})

    def key(a: Column, b: Column) -> Column:
        return F.shiftleft(a.bitwiseAND(F.lit(MASK)), 32).bitwiseOR(b.bitwiseAND(F.lit(MASK)))

    now, before = [F.col(f"r_{s}") for s in LANES], [F.col(f"r_{s}") - F.col(s) for s in LANES]
    return store(rows.select(
        "conv_id", "depth", key(now[0], now[1]).alias("k1"), key(now[2], now[3]).alias("k2"), key(before[0], before[1]).alias("p1"), key(before[2], before[3]).alias("p2"),
        (F.col("r_upto") - F.col("bytes")).alias("upto"), "bytes", "n", "total"), "prefixes")


# --- count-min screening -----------------------------------------------------------------------------------

def _cells(k: np.ndarray, bits: int) -> np.ndarray:
    return (k.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(rows: DataFrame, bits: int) -> list[np.ndarray]:
    """Per sketch row a bit map of the cells that count two or more. Tasks hand on the cells they met, by chunks of the row;
    a chunk's counts are merged as a stream."""
    side = 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(pending):
            for row in range(2):
                cells, counts = np.unique(np.concatenate([p[row] for p in pending]), return_counts=True)
                cuts = np.flatnonzero(np.diff(cells >> CHUNK_BITS)) + 1
                for c, n in zip(np.split(cells, cuts), np.split(counts, cuts), strict=True):
                    low = (c & (side - 1)).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([int(c[0]) >> CHUNK_BITS], pa.int32()), pa.array([low[n == 1].tobytes()], pa.binary()), pa.array([low[n > 1].tobytes()], pa.binary())], ["line", "chunk", "once", "more"])

        pending, held = [], 0
        for batch in batches:
            if batch.num_rows:
                pending.append([_cells(batch.column(i).to_numpy(), bits) for i in range(2)])
                held += batch.num_rows
            if held >= PENDING:
                yield from flush(pending)
                pending, held = [], 0
        if pending:
            yield from flush(pending)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(at, counts):
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["line", "chunk", "shared"])

        at, counts = None, None
        for batch in batches:
            for line, chunk, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (line, chunk) != at:
                    if at is not None:
                        yield out(at, counts)
                    at, counts = (line, chunk), np.zeros(side, np.uint8)
                for found, n in ((once, 1), (more, 2)):
                    low = np.frombuffer(found, np.uint16)  # distinct within one hand-over
                    counts[low] = np.minimum(counts[low] + n, 2)
        if at is not None:
            yield out(at, counts)

    met = map_batches(rows.select("k1", "k2"), count, "line int, chunk int, once binary, more binary")
    merged = map_batches(met.repartition("line", "chunk").sortWithinPartitions("line", "chunk"), merge, "line int, chunk int, shared binary")
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    maps = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(2)]
    for r in merged.toLocalIterator():  # a row per chunk of the sketch, 2^bits / 4 bytes in all
        maps[r.line][r.chunk * side // 8:][:side // 8] = np.frombuffer(r.shared, np.uint8)
    return maps


def screen(rows: DataFrame) -> DataFrame:
    """``rows`` with ``local`` (proven to have one member) and ``edge`` (local, and its parent is not known to be)."""
    spark = rows.sparkSession
    total = rows.count()
    bits = min(MAX_BITS, max(MIN_BITS, (CELLS_EACH * max(total, 1) - 1).bit_length()))
    shared = spark.sparkContext.broadcast(sketch(rows, bits))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # conversation, depth of its first proven prefix, depth of the last row if that is local
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(names.index("conv_id"))
            conv, gone = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            depth = batch.column(names.index("depth")).to_numpy()
            both = np.ones(len(conv), bool)
            for i, name in enumerate(("k1", "k2")):
                cell = _cells(batch.column(names.index(name)).to_numpy(), bits)
                both &= (shared.value[i][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            new = np.ones(len(conv), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (gone[1:] != gone[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
            proof = np.maximum.accumulate(np.where(both, -1, np.arange(len(conv))))  # the latest proven row so far
            local = (proof >= start) & (depth[np.maximum(proof, 0)] <= depth)
            known = np.zeros(len(conv), bool)
            known[1:] = local[:-1] & ~new[1:] & (depth[:-1] == depth[1:] - 1)
            if last is not None and last[0] == (conv[0], gone[0]):
                run_end = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(conv)
                if last[1] is not None:
                    local[:run_end] |= depth[:run_end] > last[1]
                    known[1:run_end] |= local[:run_end - 1] & (depth[:run_end - 1] == depth[1:run_end] - 1)
                known[0] = last[2] is not None and depth[0] == last[2] + 1
            tail = local[start[-1]:]
            least = int(depth[start[-1]:][tail].min()) if tail.any() else None
            if last is not None and start[-1] == 0 and last[0] == (conv[0], gone[0]) and last[1] is not None:
                least = last[1] if least is None else min(least, last[1])
            last = ((conv[-1], gone[-1]), least, int(depth[-1]) if local[-1] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(local & ~known)], [*names, "local", "edge"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", local boolean, edge boolean"
    return store(map_batches(rows, run, schema), "screened")


# --- exact nodes -------------------------------------------------------------------------------------------

def _ends(terminal: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` over rows (depth, k1, k2, conv_id): ids in order, comma-joined. Ids are joined in chunks
    first; the one digest of a node is then a stream over its chunks."""
    keys = ("depth", "k1", "k2")
    ordered = placed(dealt(terminal, *keys, "conv_id", name="ends"), *keys)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "conv_id"))), lambda r: F.coalesce(r["conv_id"].cast("string"), F.lit("")))
    chunks = ordered.groupBy(*keys, F.floor(F.col("pos") / ID_CHUNK).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = key, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*keys, "ends_sha256"])
                done = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, state.hexdigest())], [*keys, "ends_sha256"])

    streamed = chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "ids")
    return map_batches(streamed, run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(turns.sparkSession)
    convs, rebuilt = rebuild(turns.select("conv_id", "turn", "role", "text"), group, heads)
    rows = screen(prefixes(convs, rebuilt))
    shared = rows.where("not local")
    # a node's least member, from the prefixes that may be shared
    nodes = store(shared.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("first"), F.max("n").alias("deepest"), F.min("upto").alias("upto")), "nodes")
    # from which depth on each conversation is the least member, the bytes before, and whether it ends a branch
    edges = rows.where("edge")
    firsts = nodes.select(F.col("first").alias("conv_id"), "depth", "upto", (F.col("deepest") == F.col("depth")).alias("leaf"))
    firsts = firsts.union(edges.select("conv_id", "depth", "upto", F.lit(True)))
    facts = firsts.groupBy("conv_id").agg(F.min("depth").alias("m"), F.min("upto").alias("held"), F.max("leaf").alias("leaf"))
    members = match(shared, facts, "conv_id", how="left").withColumns({
        "m": F.coalesce("m", F.col("n") + 1), "held": F.coalesce("held", "total"), "leaf": F.coalesce("leaf", F.lit(False))})
    own = members.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("m").alias("m"),
        F.count_if((F.col("m") <= F.col("depth") + 1) & (F.col("n") > F.col("depth"))).alias("n_children"), F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("held") - F.col("upto"), F.lit(0))).alias("saved_tokens"))
    ends = _ends(shared.where("depth = n").select("depth", "k1", "k2", "conv_id"))
    exact = store(own.join(ends, ["depth", "k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "exact")

    alone = F.when(F.col("depth") == F.col("n"), F.sha2(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), 256)).otherwise(F.lit(NOTHING))
    tails = rows.where("local").withColumns({
        "n_convs": F.lit(1).cast("long"), "n_children": (F.col("n") > F.col("depth")).cast("long"), "n_leaves": F.lit(1).cast("long"),
        "saved_tokens": F.lit(0).cast("long"), "ends_sha256": alone})
    values = ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

    # the root: everything below its children is theirs
    tops = exact.where("depth = 1").select("conv_id", *values[2:4]).union(tails.where("depth = 1").select("conv_id", *values[2:4]))
    below = tops.agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    bare = convs.where("n = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    least, many = convs.agg(F.min("conv_id"), F.count("*")).first()
    ended = _ends(bare).first()  # the root's own: one row at most
    top = F.lit(least).cast("long")
    root = below.where(F.lit(many > 0)).select(
        top.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(many).cast("long").alias("n_convs"), "n_children",
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.lit(ended["ends_sha256"] if ended else NOTHING).alias("ends_sha256"))

    # parents: a node below one of the same least member, or of none that may be shared, has that member's parent
    sure = exact.where("m < depth and depth > 1").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *values)
    inner = tails.where("not edge and depth > 1").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *values)
    high = exact.where("depth = 1").select("conv_id", "depth", top.alias("parent_conv_id"), *values).union(tails.where("depth = 1").select("conv_id", "depth", top.alias("parent_conv_id"), *values))
    asked = exact.where("m >= depth and depth > 1").select("conv_id", "depth", "p1", "p2", *values).union(tails.where("edge and depth > 1").select("conv_id", "depth", "p1", "p2", *values))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "first")
    found = asked.join(parents, ["depth", "p1", "p2"], "left").select("conv_id", "depth", F.coalesce("first", "conv_id").alias("parent_conv_id"), *values)
    return root.union(high).union(sure).union(inner).union(found)


#: Oracle: whole prefixes as keys, and every pair of a node and a node above it.
TRIE_SQL = f"""
WITH {CRC_SQL.strip()},
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations), polynomial),
r AS (
  SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN o USING (conv_id) WHERE i > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, strlen(text) AS bytes, sha256(strlen(role)::VARCHAR || ':' || role || text) AS k FROM r),
p AS (
  SELECT conv_id, depth, bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY key, depth),
u AS (SELECT key, left(key, greatest(64 * (depth - 1), 0)::BIGINT) AS up, depth > 0 AS below FROM n),
k AS (SELECT up AS key, count(*) AS n_children FROM u WHERE below GROUP BY up),
pairs AS (SELECT DISTINCT a.key AS high, b.key AS low FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (SELECT high AS key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM pairs JOIN n ON n.key = low LEFT JOIN k ON k.key = low GROUP BY high)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN below THEN q.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN u USING (key) JOIN n q ON q.key = up JOIN s ON s.key = n.key LEFT JOIN k ON k.key = n.key
"""
