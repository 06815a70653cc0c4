"""Merkle manifest of a table, and the versions of it that single changed rows make.

Every row is a leaf: SHA-256 over its fields, each as ``-`` if null, else UTF-8 length, colon, value. Leaves of a source stand in
ascending order of their id; 16 consecutive nodes at a time are hashed into one until a source has one node, its subroot. The
subroots, in order of their source, are hashed likewise into the root.

The tree is persistent. A changed leaf makes a version that shares every untouched node and copies only the leaf's ancestors.
Work is dealt in aligned blocks of 256 nodes (two levels): a task holds one block's nodes and copies a version's path inside it;
the block roots are the nodes of the next tier, and a version goes on above its block along the path that the upper tiers hand
down: own place and siblings at every level, a few kilobytes for all versions of a block. Places come from sorted ranges
(``common.placed``), so a source of any size is spread over all tasks, and so are its versions.

Defined results: null ids and null sources stand first, each a value like others; rows that repeat an id are leaves of their own,
ordered by leaf digest; null fields are hashed as such; an empty table has no root and no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_bucket, dealt, map_batches, match, placed, store

#: Nodes hashed into one, levels of a block, and nodes of a block.
FAN, LEVELS = 16, 2
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<at: int, others: array<string>>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields, each with its length in front."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Node(NamedTuple):
    digest: str
    kids: tuple[Node, ...] = ()


def grow(digests: Sequence[str], levels: int) -> Node:
    """The tree over a block's nodes, exactly ``levels`` high."""
    nodes = [Node(d) for d in digests]
    for _ in range(levels):
        runs = [tuple(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)]
        nodes = [Node(digest([k.digest for k in run]), run) for run in runs]
    return nodes[0]


def replaced(node: Node, slot: int, levels: int, leaf: str) -> Node:
    """A version of the tree with another leaf at ``slot``: its ancestors are copied, all other nodes shared."""
    if not levels:
        return Node(leaf)
    at, below = divmod(slot, FAN ** (levels - 1))
    kids = (*node.kids[:at], replaced(node.kids[at], below, levels - 1, leaf), *node.kids[at + 1:])
    return Node(digest([k.digest for k in kids]), kids)


def path_of(node: Node, slot: int, levels: int) -> list[dict]:
    """Own place and siblings of a leaf at every level, from the leaf up."""
    out = []
    for level in range(levels, 0, -1):
        at, slot = divmod(slot, FAN ** (level - 1))
        out.append({"at": at, "others": [k.digest for i, k in enumerate(node.kids) if i != at]})
        node = node.kids[at]
    return out[::-1]


def climb(leaf: str, path: Sequence[dict]) -> list[str]:
    """The ancestors of ``leaf``, recomputed along its path; the last is the root."""
    out = []
    for step in path:
        leaf = digest([*step["others"][:step["at"]], leaf, *step["others"][step["at"]:]])
        out.append(leaf)
    return out


def _levels(n: int) -> int:
    return min(LEVELS, height(n))


# --- tiers of blocks ---------------------------------------------------------------------------------------

def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Nodes ``(source, pos, n, digest)`` in aligned blocks, a row each; ``carried`` columns stay with their node."""
    row = F.struct((F.col("pos") % BLOCK).alias("slot"), "digest", *carried)
    rows = nodes.groupBy("source", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
    return store(rows, "merkle-blocks")


def _roots(blocks: DataFrame) -> DataFrame:
    """``(source, pos, n, digest)``: the roots of the blocks, as nodes of the next tier (``n`` still of this one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            found = [grow(d, _levels(n)).digest for d, n in zip(batch.column(3).to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.string())], ["source", "pos", "n", "digest"])

    return map_batches(blocks.select("source", "block", "n", "rows.digest"), run, f"source {blocks.schema['source'].dataType.simpleString()}, pos long, n long, digest string")


def _tiers(nodes: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every tier, and ``(source, digest, tier)`` of what remains of each source and the tier it ended in."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers, ended = [], []
    while True:
        tiers.append(_blocks(nodes, *(carried if not tiers else ())))
        roots = store(_roots(tiers[-1]), "merkle-roots")
        ended.append(roots.where(F.col("n") <= BLOCK).select("source", "digest", F.lit(len(tiers) - 1).alias("tier")))
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        nodes = roots.where(F.col("n") > BLOCK).withColumn("n", F.ceil(F.col("n") / BLOCK))
    found = ended[0]
    for more in ended[1:]:
        found = found.union(more)
    return tiers, store(found, "merkle-subroots")


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``(source, pos, path, subroot)`` of every node in ``blocks``; ``above`` holds these of the block roots."""
    joined = match(blocks, above.withColumnRenamed("pos", "block"), "source", "block").select("source", "block", "n", "rows.digest", "path", "subroot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = _levels(row["n"])
                tree = grow(row["digest"], levels)
                rows = [{"source": row["source"], "pos": row["block"] * BLOCK + slot, "path": path_of(tree, slot, levels) + row["path"], "subroot": row["subroot"]} for slot in range(len(row["digest"]))]
                yield pa.RecordBatch.from_pylist(rows, schema)

    kind = blocks.schema["source"].dataType
    schema = pa.schema([("source", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))), ("subroot", pa.string())])
    return map_batches(joined, run, f"source {kind.simpleString()}, pos long, path {PATH}, subroot string")


def manifest(leaves: DataFrame, siblings: bool = False) -> DataFrame:
    """The proof of every leaf, and the version that its change makes.

    ``leaves``: id, source (text), leaf, and changed, the leaf after a change (null: unchanged). Returns id, source, leaf, changed,
    subroot, root, proof_sha256 (over the siblings, from the leaf up, left to right), ``folded``, the ancestors recomputed
    from the unchanged leaf and the proof (the last is the root; none over a lone leaf), and ``copied``, the ancestors that the changed
    leaf's version holds in place of the tree's own (null: unchanged). With ``siblings`` the whole proof is returned besides.
    """
    spark = leaves.sparkSession
    kept = store(leaves.select("id", "source", "leaf", "changed").withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    nodes = placed(dealt(kept, "source", "id", "leaf", "_row", name="merkle-dealt"), "source").withColumnRenamed("leaf", "digest")
    tiers, subroots = _tiers(nodes, "id", "changed")
    # the subroots are the leaves of the tree above, in which all sources are one group
    tops = placed(dealt(subroots, "source", name="merkle-sources"))
    tops = tops.select(F.lit("").alias("source"), F.col("source").alias("of"), F.col("digest").alias("subroot"), "digest", "tier", "pos", "n")
    tops = store(tops, "merkle-tops")
    upper, found = _tiers(tops)
    last = found.first()
    root = last["digest"] if last else None
    above = spark.createDataFrame([("", 0, [], None)], f"source string, pos long, path {PATH}, subroot string")
    for blocks in reversed(upper):
        above = store(_descend(blocks, above), "merkle-paths")
    over = above.select("pos", "path").join(tops.select("pos", "of", "subroot", "tier"), "pos")
    over = store(over.select(F.col("of").alias("source"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "tier"), "merkle-paths")
    above = None
    for tier in reversed(range(len(tiers))):
        here = over.where(F.col("tier") == tier).drop("tier")
        above = here if above is None else here.union(above)
        if tier:
            above = store(_descend(tiers[tier], above), "merkle-paths")

    blocks = tiers[0]
    joined = match(blocks, above.withColumnRenamed("pos", "block"), "source", "block").select("source", "n", "rows", "path", "subroot")
    id_type = leaves.schema["id"].dataType.simpleString()
    fields = f"id {id_type}, source string, leaf string, changed string, subroot string, root string, proof_sha256 string, folded array<string>, copied array<string>"
    names = [f.split()[0] for f in fields.split(", ")] + ["siblings"] * siblings
    kinds = [pa.string()] * 7 + [pa.list_(pa.string())] * 2 + [pa.list_(pa.string())] * siblings

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[0] = batch.schema.field("rows").type.value_type.field("id").type
            for row in batch.to_pylist():
                levels, own = _levels(row["n"]), [r["digest"] for r in row["rows"]]
                tree = grow(own, levels)
                high = climb(tree.digest, row["path"])  # shared by all unchanged leaves of the block
                beyond = [x for step in row["path"] for x in step["others"]]
                columns: list[list] = [[] for _ in names]
                for slot, r in enumerate(row["rows"]):
                    inner = path_of(tree, slot, levels)
                    proof = [x for step in inner for x in step["others"]] + beyond
                    low = climb(r["digest"], inner)
                    folded = low + (high if (low or [r["digest"]])[-1] == tree.digest else climb((low or [r["digest"]])[-1], row["path"]))
                    copied = None
                    if r["changed"] is not None:
                        version = replaced(tree, slot, levels, r["changed"])
                        copied = [*_ancestors(version, slot, levels), *climb(version.digest, row["path"])]
                    values = (r["id"], row["source"], r["digest"], r["changed"], row["subroot"], root, digest(proof), folded, copied, proof)
                    for column, value in zip(columns, values, strict=False):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_batches(joined, prove, fields + ", siblings array<string>" * siblings)


def _ancestors(node: Node, slot: int, levels: int) -> list[str]:
    """Digests of the nodes above ``slot``, the nearest first."""
    out = []
    for level in range(levels, 0, -1):
        out.append(node.digest)
        at, slot = divmod(slot, FAN ** (level - 1))
        node = node.kids[at]
    return out[::-1]


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tamper_report(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, where the rows whose crc32(doc_id) five divides have their text's A-Z in lower case (a null id
    is never tampered with): each one's recomputed root, and whether it equals the manifest's."""
    columns = [F.col(c) for c in FIELDS]
    tampered = F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), 5) == 0)
    lowered = [F.translate("text", CAPITALS, CAPITALS.lower()) if c == "text" else F.col(c) for c in FIELDS]
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), leaf_digest(columns).alias("leaf"), F.when(tampered, leaf_digest(lowered)).alias("changed"))
    found = manifest(leaves)
    ancestors = F.when(F.col("changed").isNotNull(), F.col("copied")).otherwise(F.col("folded"))
    folded = F.coalesce(F.try_element_at(ancestors, F.lit(-1)), F.col("changed"), F.col("leaf"))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


#: Checksums written out, since the checking engine has none: a table by eight halvings, then byte by byte.
CRC_SQL = """
polynomial AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR END"


#: Oracle: level by level over all nodes, without blocks or paths.
TAMPER_SQL = f"""
WITH RECURSIVE {CRC_SQL.strip()},
d AS (SELECT doc_id, source, lang, n_chars, text, {crc_sql("doc_id::VARCHAR")} % 5 = 0 AS tampered FROM documents, polynomial),
h AS (SELECT doc_id, source, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
  sha256({" || ".join(map(_field, FIELDS[:-1]))} || {_field("CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS now FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS r FROM h),
low(source, level, pos, digest, n) AS (
  SELECT source, 0, pos, leaf, n FROM l
  UNION ALL SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM low WHERE n > 1 GROUP BY source, level, pos // 16, n),
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM subroots
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
steps AS (
  SELECT l.r, low.level AS step, string_agg(digest, '' ORDER BY low.pos) FILTER (low.pos < (l.pos >> (4 * low.level))) AS before, string_agg(digest, '' ORDER BY low.pos) FILTER (low.pos > (l.pos >> (4 * low.level))) AS after
  FROM l JOIN low ON l.source IS NOT DISTINCT FROM low.source AND low.n > 1 AND low.pos // 16 = (l.pos >> (4 * low.level + 4)) GROUP BY ALL
  UNION ALL
  SELECT l.r, 1000 + high.level, string_agg(high.digest, '' ORDER BY high.pos) FILTER (high.pos < (s.pos >> (4 * high.level))), string_agg(high.digest, '' ORDER BY high.pos) FILTER (high.pos > (s.pos >> (4 * high.level)))
  FROM l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN high ON high.n > 1 AND high.pos // 16 = (s.pos >> (4 * high.level + 4)) GROUP BY ALL),
paths AS (SELECT l.r, l.now, coalesce(list([coalesce(before, ''), coalesce(after, '')] ORDER BY step) FILTER (step IS NOT NULL), []) AS path FROM l LEFT JOIN steps USING (r) GROUP BY ALL),
up(r, k, digest, path) AS (
  SELECT r, 1, now, path FROM paths
  UNION ALL SELECT r, k + 1, sha256(path[k][1] || digest || path[k][2]), path FROM up WHERE k <= len(path))
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(array_to_string(list_transform(up.path, lambda p: p[1] || p[2]), '')) AS proof_sha256,
  up.digest AS folded_root, up.digest = t.digest AS verified
FROM l JOIN up ON up.r = l.r AND up.k = len(up.path) + 1 JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN high t ON t.n = 1
"""
