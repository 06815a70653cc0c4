"""Substring dedup over sliding spans of consecutive sentences.

From every sentence runs the shortest span of at least ``SENTENCES`` sentences and ``WORDS`` words. Spans are hashed and
joined globally; a sentence is removed if it lies in a span whose first occurrence is elsewhere: in a document
with a smaller doc_id, or earlier in the same one. Text outside such spans stays as it is, byte for byte.

A sentence ends behind ``.``, ``!`` or ``?`` before white space, or at a line end; one of more than ``LONGEST`` words is cut
again, behind words whose hash says so (or after ``LONGEST`` words), so that texts without punctuation have spans too and a
passage is cut alike wherever in a sentence it begins. Each document sends a span once, whatever it repeats
inside; frequent spans meet as partial minima, and only the minimum is joined back.

Defined results: null texts have no spans and stay null; texts with too few sentences or words are left alone; rows
that share a doc_id count as one document (neither gives way to the other); null doc_ids come last. Extra columns are
carried (own columns called n_removed or chars_removed are replaced).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, store

SENTENCES, WORDS, LONGEST = 2, 12, 24
#: One word in so many ends a piece of an overlong sentence.
CUT_EVERY = 8
_END = re.compile(r"[.!?]+\s+|\s*\n\s*")
_WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> tuple[list[int], list[list[str]]]:
    """Cut points (first 0, last the length) and the lower-cased words of each sentence between them."""
    cuts, words, begin = [0], [], 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        if end == begin:
            continue
        own = text[begin:end].lower().split()
        if len(own) > LONGEST:
            at = [begin + m.start() for m in _WORD.finditer(text[begin:end])]
            last = 0
            for i in range(1, len(at)):
                if i - last == LONGEST or zlib.crc32(own[i - 1].encode("utf-8", "replace")) % CUT_EVERY == 0:
                    cuts.append(at[i])
                    words.append(own[last:i])
                    last = i
            own = own[last:]
        cuts.append(end)
        words.append(own)
        begin = end
    return cuts, words


def spans(words: list[list[str]]) -> list[tuple[int, int, bytes]]:
    """``(first sentence, end, 128-bit hash)`` of the shortest long enough run from every sentence with words."""
    full = [i for i, w in enumerate(words) if w]  # sentences without words join their neighbours
    joined = [" ".join(words[i]).encode("utf-8", "replace") for i in full]
    sizes = [len(words[i]) for i in full]
    out, end, held = [], 0, 0
    for k in range(len(full)):
        while end < len(full) and (held < WORDS or end - k < SENTENCES):
            held += sizes[end]
            end += 1
        if held < WORDS or end - k < SENTENCES:
            break
        out.append((full[k], full[end - 1] + 1, xxhash.xxh3_128_digest(b" ".join(joined[k:end]))))
        held -= sizes[k]
    return out


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def dedup_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its text less the repeated spans, plus n_removed (sentences) and chars_removed."""
    last = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, digests, again = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[bytes, bool] = {}
                for _, _, digest in spans(sentences(text)[1]):
                    seen[digest] = digest in seen
                owner += [key] * len(seen)
                digests += seen.keys()
                again += seen.values()
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), *_halves(digests), pa.array(again)], ["doc", "h1", "h2", "again"])

    texts = df.where(F.col(text_col).isNotNull()).select(last.alias("doc"), F.col(text_col).alias("text"))
    rows = store(map_batches(texts, emit, "doc long, h1 long, h2 long, again boolean"), "spans")
    owners = rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first < final").select("h1", "h2", "first")
    foreign = rows.join(owners, ["h1", "h2"]).where("doc > first").select("doc", "h1", "h2", F.lit(True).alias("foreign"))
    own = rows.where("again").select("doc", "h1", "h2", F.lit(False).alias("foreign"))
    # at most one entry for each span of a document
    lists = foreign.unionByName(own).groupBy("doc").agg(F.collect_list(F.struct("h1", "h2", "foreign")).alias("spans"))
    lists = store(lists, "repeats")

    added = ("n_removed", "chars_removed")
    carried = [c for c in df.columns if c not in (text_col, *added)]
    # the lists of a partition are hashed and the texts stream past them, unsorted
    joined = df.select(F.struct(*carried).alias("row"), F.col(text_col).alias("text"), last.alias("doc")).join(lists.hint("shuffle_hash"), "doc", "left").select("row", "text", "spans")
    schema = T.StructType([joined.schema["row"], joined.schema["text"]] + [T.StructField(c, T.LongType()) for c in added])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, chars = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                kept, gone = remove(text, found.as_py()) if text is not None and found.is_valid else (text, 0)
                texts.append(kept)
                counts.append(gone)
                chars.append(len(text) - len(kept) if gone else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(chars, pa.int64())], schema.names)

    return map_batches(joined, rewrite, schema).select("row.*", F.col("text").alias(text_col), *added)


def remove(text: str, found: list[dict]) -> tuple[str, int]:
    """The text without the sentences of the listed spans (all occurrences of foreign ones, the later ones of own)."""
    listed = {np.array([s["h1"], s["h2"]], np.int64).tobytes(): s["foreign"] for s in sorted(found, key=lambda s: s["foreign"])}
    cuts, words = sentences(text)
    gone, seen = [False] * len(words), set()
    for first, end, digest in spans(words):
        if digest in listed and (listed[digest] or digest in seen):
            gone[first:end] = [True] * (end - first)
        seen.add(digest)
    return "".join(text[cuts[i]:cuts[i + 1]] for i in range(len(words)) if not gone[i]), sum(gone)
