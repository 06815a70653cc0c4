"""Document rules and host verdicts with an empirical beta prior, in DataFrame operations only.

Every document gets base measures of its whole text. Failures are added up by host; the hosts' rates give a beta prior by the
method of moments, and each host's rate is shrunk towards the mean as far as its own number of documents is small. A
host fails if its shrunk rate exceeds ``HOST_RATE`` and its odds are over ``HOST_ODDS`` times those of the mean; its verdict is
joined back to its documents. Where hosts differ no more than chance, all share the mean and none fails.

Texts are read once and never shuffled: repeated windows are found inside a row, over sorted window hashes. Only counts
by host meet, after map-side sums, so one host with a third of all documents costs nothing more.

Defined results: a null or empty text has no words and fails; documents without a host share one; repeated rows count
as documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, let, store

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, HOST_RATE, HOST_ODDS = 5, 10, 20, 0.25, 2.0
_SPACE_CHARS = " \t\n\x0b\f\r"


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more, the first included.

    Windows are compared by 64-bit hashes within one text."""
    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            # a window adds what the next one does not cover again; the last adds all of itself
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(ranked, positions), total)).otherwise(F.lit(0).cast("long"))

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) > WINDOW, let(hashes, covered)).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def measures(df: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """Base measures as expressions over a text column; see the query's contract for their definitions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(_SPACE_CHARS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def all_of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    return {
        "m": let(words, all_of),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def beta_prior(hosts: DataFrame) -> tuple[float, float | None]:
    """(mean failure rate, strength of the prior in documents) by the method of moments; no strength: hosts do not differ more
    than chance, and all share the mean. ``hosts``: (n, failed) per host; five sums are read."""
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    k, total, failed, squares, spread = hosts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0)), F.coalesce(F.sum(n * n), F.lit(0.0)), F.coalesce(F.sum(f * f / n), F.lit(0.0))).first()
    if not total:
        return 0.0, None
    mean = failed / total
    between = spread - total * mean * mean  # sum of n (rate - mean)^2
    scale = mean * (1 - mean)
    room = scale * (total - squares / total - (k - 1))
    rho = (between - scale * (k - 1)) / room if room > 0 else 0.0
    if rho <= 0:
        return mean, None
    return mean, (1 - min(rho, 1.0)) / min(rho, 1.0)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE, host_odds: float = HOST_ODDS) -> DataFrame:
    """Base measures, base_failed, the host's counts and verdict, and kept, for every row of ``df``."""
    m = measures(df, text_col)
    base = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("_host"), *[c.alias(n) for n, c in m.items()])
    base = base.select("doc_id", "_host", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")
    fails = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    base = store(base.withColumn("base_failed", fails), "measures")
    hosts = base.groupBy("_host").agg(F.count("*").alias("n"), F.count_if("base_failed").cast("long").alias("failed"))
    mean, strength = beta_prior(hosts)
    rate = F.lit(mean) if strength is None else (F.col("failed") + mean * strength) / (F.col("n") + strength)
    bad = (rate > host_rate) & (rate * (1 - mean) > host_odds * mean * (1 - rate))
    verdicts = hosts.select("_host", F.col("n").alias("host_docs"), F.col("failed").alias("host_failures"), bad.alias("host_failed"))
    joined = base.join(verdicts, base["_host"].eqNullSafe(verdicts["_host"]), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_docs", "host_failures", "host_failed")


JUDGE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i+4], ' ')) AS times FROM p),
c AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM g WHERE times > 1) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
h AS (SELECT source, count(*)::BIGINT AS host_docs, (count(*) FILTER (base_failed))::BIGINT AS host_failures FROM f GROUP BY source),
s AS (SELECT count(*) AS k, sum(host_docs)::DOUBLE AS n, sum(host_failures) / sum(host_docs)::DOUBLE AS mean, sum(host_docs::DOUBLE * host_docs) AS squares FROM h),
v AS (SELECT any_value(s.mean) AS mean, any_value(s.mean * (1 - s.mean)) AS scale, any_value(s.k) AS k, any_value(s.n - s.squares / s.n - (s.k - 1)) AS room,
  sum(host_docs * (host_failures / host_docs::DOUBLE - s.mean) ** 2) AS between_ FROM h, s),
rho AS (SELECT mean, CASE WHEN scale * room > 0 THEN least((between_ - scale * (k - 1)) / (scale * room), 1.0) ELSE 0 END AS rho FROM v),
shrunk AS (SELECT h.*, mean, CASE WHEN rho <= 0 THEN mean ELSE (host_failures + mean * (1 - rho) / rho) / (host_docs + (1 - rho) / rho) END AS rate FROM h, rho),
verdict AS (SELECT source, host_docs, host_failures, rate > 0.25 AND rate * (1 - mean) > 2 * mean * (1 - rate) AS host_failed FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, host_docs, host_failures, host_failed
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""
