"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The postings of all training texts, ``(document, position, term)`` for every term that some test item uses, are stored once. A window
is looked up from its two rarest terms, by their frequency in the index: the posting lists of both, shifted by the
terms' offsets in the item, are intersected on (document, shift). What is left are alignments of an item with a document;
the words of the item that its looked-up windows can cover are laid out along each alignment and joined to the postings at
their own places, and runs of equal terms as long as a window are exact occurrences. Lists whose
shifts differ by at most ``SLOP`` words give proximity matches.

Postings are joined to the test side only, which is broadcast while its counted rows are few and shuffled beyond; a term that
stands in every document is rarely among the rarest of a window, and then its list is spread by document and shift. An alignment
meets the postings of its own words alone, so a document that repeats an item costs in proportion to its length.

Defined results: null and empty texts have no words and match nothing; items of fewer than ``WINDOW`` words are one window;
items that share an item_id count once; a null item_id counts as the empty text; repeated document rows get the same result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, store

WINDOW, SLOP = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, once A-Z is lower case
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word in any case
_NO_ID = -(2**63)


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z alone; texts in plain ASCII take the faster ``lower``."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _BREAK), "")


def document_key(id_col: str, text_col: str) -> list[Column]:
    """Equal rows are one document; rows that only share the id are not."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(text_col).alias("h")]


@dataclass
class Index:
    postings: DataFrame  # k, h, pos, term (a 64-bit id)
    item_words: DataFrame  # item, item_id, n, at, term, freq: one row per word of an item
    n_item_words: int
    lists: DataFrame  # k, h, shift, item, p1, p2, side: places of the two rarest words of each window, as shifts of the item


def build(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Index:
    given = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    given = given.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("words"))
    spelled = store(given.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).withColumn("term", F.xxhash64("word")), "items")
    vocabulary = store(spelled.select("word", "term").distinct(), "vocabulary")
    exploded = docs.select(*document_key(id_col, text_col), F.posexplode(words_of(F.col(text_col))).alias("pos", "word"))
    postings = store(exploded.join(small(vocabulary, vocabulary.count()), "word").select("k", "h", "pos", "term"), "postings")

    frequency = postings.groupBy("term").agg(F.count("*").alias("freq"))
    item_words = store(spelled.join(frequency, "term", "left").select("item", "item_id", "n", "at", "term", F.coalesce("freq", F.lit(0)).alias("freq")), "item-words")
    size = F.least("n", F.lit(window))
    begins = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - size + 1), F.least("at", F.col("n") - size))).alias("s")
    ranked = item_words.select("item", begins, F.struct("freq", "at", "term").alias("w")).groupBy("item", "s").agg(F.sort_array(F.collect_list("w")).alias("w"))
    # a window with a term that no document has cannot occur
    rarest, second = F.col("w")[0], F.coalesce(F.get("w", F.lit(1)), F.col("w")[0])
    pairs = ranked.where(rarest["freq"] > 0).select("item", rarest["at"].alias("p1"), rarest["term"].alias("t1"), second["at"].alias("p2"), second["term"].alias("t2")).distinct()
    pairs = store(pairs, "pairs")
    sides = pairs.select("item", "p1", "p2", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"p{i}").alias("p"), F.col(f"t{i}").alias("term")) for i in (1, 2)])).alias("w")).select("item", "p1", "p2", "w.*")
    lists = postings.join(small(sides, 2 * pairs.count()), "term").select("k", "h", (F.col("pos") - F.col("p")).alias("shift"), "item", "p1", "p2", "side")
    return Index(postings, item_words, item_words.count(), store(lists, "lists"))


def _side(index: Index, side: int) -> DataFrame:
    return index.lists.where(F.col("side") == side).drop("side")


def alignments(index: Index) -> DataFrame:
    """``(k, h, item, shift, lo, hi)``: where both rarest terms of a window stand at their distance, and the first and
    last place in the item of all such terms."""
    both = _side(index, 1).join(_side(index, 2), ["k", "h", "shift", "item", "p1", "p2"])
    return store(both.groupBy("k", "h", "item", "shift").agg(F.min(F.least("p1", "p2")).alias("lo"), F.max(F.greatest("p1", "p2")).alias("hi")), "alignments")


def phrase_matches(index: Index, window: int = WINDOW) -> DataFrame:
    """``(k, h, item_id, pos)``: document words inside an exact occurrence of a window, per item."""
    places = alignments(index)
    within = store(places.select("k", "h").distinct(), "aligned-documents")
    # places before an item's first or behind its last word find no word
    reach = F.explode(F.sequence(F.col("lo") - (window - 1), F.col("hi") + (window - 1))).alias("at")
    laid = places.select("k", "h", "item", "shift", reach).join(small(index.item_words.select("item", "item_id", "n", "at", "term"), index.n_item_words), ["item", "at"])
    laid = laid.withColumn("pos", F.col("at") + F.col("shift"))
    own = index.postings.join(small(within, within.count()), ["k", "h"], "left_semi")
    equal = laid.join(own, ["k", "h", "pos", "term"]).select("k", "h", "item", "item_id", "n", "shift", "at", "pos").distinct()
    line = Window.partitionBy("k", "h", "item", "shift").orderBy("at")
    runs = equal.withColumn("run", F.col("at") - F.row_number().over(line))
    long_enough = F.count("*").over(Window.partitionBy("k", "h", "item", "shift", "run")) >= F.least("n", F.lit(window))
    return runs.withColumn("hit", long_enough).where("hit").select("k", "h", "item_id", "pos")


def proximity_matches(index: Index, slop: int = SLOP) -> DataFrame:
    """``(k, h, item_id, shift, gap)``: windows whose two rarest terms stand within ``slop`` words of their distance in the item."""
    cell = slop + 1
    near = _side(index, 1).withColumn("cell", F.floor(F.col("shift") / cell))
    far = _side(index, 2).withColumnRenamed("shift", "shift2")
    far = far.withColumn("cell", F.explode(F.array(*[F.floor(F.col("shift2") / cell) + i for i in (-1, 0, 1)])))
    gap = F.col("shift2") - F.col("shift")
    names = small(index.item_words.select("item", "item_id").distinct(), index.n_item_words)
    return near.join(far, ["k", "h", "item", "p1", "p2", "cell"]).where(F.abs(gap) <= slop).select("k", "h", "item", "shift", gap.alias("gap")).distinct().join(names, "item").select("k", "h", "item_id", "shift", "gap")


RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def flag(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", slop: int = SLOP) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and n_near, the items with a proximity match (own
    columns of these names are replaced)."""
    index = build(docs, items, window, id_col, text_col)
    hits = store(phrase_matches(index, window), "hits")
    words = hits.select("k", "h", "pos").distinct().groupBy("k", "h").agg(F.count("*").alias("n_hit"))
    found = hits.select("k", "h", "item_id").distinct().groupBy("k", "h").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))  # at most the items
    near = proximity_matches(index, slop).select("k", "h", "item_id").distinct().groupBy("k", "h").agg(F.count("*").alias("n_near"))
    found = store(words.join(found, ["k", "h"]).join(near, ["k", "h"], "full"), "contaminated")
    carried = [c for c in docs.columns if c not in RESULT]
    n_words = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(_WORD)).cast("long")
    rows = docs.select(F.struct(*carried).alias("row"), *document_key(id_col, text_col), n_words.alias("n_words"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return rows.join(small(found, found.count()), ["k", "h"], "left").select(
        "row.*", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the result columns for every row of ``docs``."""
    return flag(docs, items, window, id_col, text_col).select(F.col(id_col).alias("doc_id"), *RESULT)


DECONTAMINATE_SQL = r"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
ds AS (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM dw),
m AS (SELECT ds.r, ds.i, ds.n, win.item_id FROM ds JOIN win USING (n, s)),
hit AS (SELECT r, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM m) GROUP BY r),
its AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r),
iw AS (SELECT row_number() OVER () AS item, item_id, w FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
it AS (SELECT item, item_id, len(w) AS n, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS place FROM iw),
terms AS (SELECT DISTINCT term FROM it),
pw AS (SELECT r, pos, term FROM (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d) SEMI JOIN terms USING (term)),
freq AS (SELECT term, count(*) AS f FROM pw GROUP BY term),
ws AS (SELECT item, item_id, place, it.term, coalesce(f, 0) AS f, unnest(range(greatest(1, place - least(n, 10) + 1), least(place, n - least(n, 10) + 1) + 1)) AS s FROM it LEFT JOIN freq ON it.term = freq.term),
rk AS (SELECT *, row_number() OVER (PARTITION BY item, s ORDER BY f, place) AS k FROM ws),
pr AS (SELECT DISTINCT a.item_id, a.term AS t1, coalesce(b.term, a.term) AS t2, coalesce(b.place - a.place, 0) AS apart FROM rk a LEFT JOIN rk b ON a.item = b.item AND a.s = b.s AND b.k = 2 WHERE a.k = 1 AND a.f > 0),
near AS (SELECT DISTINCT x.r, pr.item_id FROM pr JOIN pw x ON x.term = pr.t1 JOIN pw y ON y.r = x.r AND y.term = pr.t2 WHERE abs(y.pos - x.pos - apart) <= 5),
nears AS (SELECT r, count(*)::BIGINT AS n_near FROM near GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN nears USING (r)
"""
