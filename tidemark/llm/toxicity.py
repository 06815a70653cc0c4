"""Toxicity scores from class-conditional Kneser-Ney models.

Two byte n-gram models, one of toxic and one of ordinary texts, are compared by their log-likelihood ratio per symbol. Contexts
run over word borders, words being one space apart, so a word's score depends on what stands before it.
Orders 3 to 5 hold counts of the class (at the top how often, below it in how many
left contexts a gram was seen, as Kneser-Ney asks); orders 1 and 2 are continuation counts of the union of both classes
(left neighbours that both know count once), so rare expressions fall back to the same probabilities and favour no class.

Counts come from every labelled training text. One task turns its texts into distinct top-order grams,
Spark adds them up and derives all lower orders by aggregation. The tables of all orders are exact: every distinct
gram and context of the labelled texts has a row of its own, so what is gathered and broadcast grows with them. Broadcast are the
rows alone: the driver and every executor keep a copy on disk, and each Python worker lays out its slots from it. A logistic
curve from ratio to probability is then fitted on a held-back fold of the training rows, summed up in a histogram.

Defined results: a null or empty text has ratio zero, as has every text when a class is missing from the
training rows. A document with several labels is toxic if one says so; null labels are ignored; repeated rows are scored
alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, store

ORDER, SHARED = 5, 2
#: Least slots of a table; a prime, so that packed bytes spread. A table with more rows has a slot for each.
SLOTS = 1_048_573
DISCOUNT = 0.75
#: Symbols whose grams are looked at together; longer texts go in several steps.
SYMBOLS_HELD = 1 << 20
#: Histogram of ratios for the calibration.
BINS, BIN_WIDTH = 4000, 0.0005


_LEAD = ORDER - 1
_NOTHING = b" " * _LEAD


def line_of(text: str | None) -> bytes:
    """The words of a text one space apart, behind the spaces its first symbols are predicted from; no words: nothing."""
    words = b" ".join((text or "").lower().encode("utf-8", "replace").split())
    return words and _NOTHING + words


def _symbols(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines, each with one space behind it, as bytes; positions that are predicted; the line of each."""
    flat = np.frombuffer(b"".join(x + b" " for x in lines), np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1 - _LEAD
    line = np.repeat(np.arange(len(lines), dtype=np.int32), sizes)
    at = np.arange(len(line)) + _LEAD * (line + 1)  # every line so far has brought its own lead
    return flat, at, line


def _keys(flat: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Packed bytes of the grams that end at ``at``, the predicted byte in the lowest place."""
    key = np.zeros(len(at), np.int64)
    for back in range(order):
        key |= flat[at - back].astype(np.int64) << (8 * back)
    return key


def top_grams(labelled: DataFrame) -> DataFrame:
    """``(gram, toxic, ordinary)``: counts of the top order over all rows of ``(text, toxic)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in (True, False):
                flat, at, _ = _symbols([x for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if toxic is own and (x := line_of(t))])
                for i in range(0, len(at), SYMBOLS_HELD):
                    grams, n = np.unique(_keys(flat, at[i:i + SYMBOLS_HELD], ORDER), return_counts=True)
                    counts = [pa.array(n), pa.array(np.zeros_like(n))]
                    yield pa.RecordBatch.from_arrays([pa.array(grams), *(counts if own else counts[::-1])], ["gram", "toxic", "ordinary"])

    rows = map_batches(labelled.select("text", "toxic"), run, "gram long, toxic long, ordinary long")
    return rows.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def slot_tables(grams: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Per order, (packed bytes, rows of counts by class) of all grams, ``n``, and of all contexts, ``context``: sums and
    distinct grams. Shared orders count the union of both classes, in both columns."""
    out: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    level = grams
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # continuation counts: distinct left neighbours, by class; every row is seen in some class
            level = store(level.groupBy(F.col("gram").bitwiseAND((1 << (8 * order)) - 1).alias("gram")).agg(
                F.count_if(F.col("toxic") > 0).cast("long").alias("toxic"), F.count_if(F.col("ordinary") > 0).cast("long").alias("ordinary"), F.count("*").alias("either")), f"grams{order}")
        classes = ("either", "either") if order <= SHARED else ("toxic", "ordinary")
        of_gram = level.select("gram", *(F.col(c).alias(f"n{i}") for i, c in enumerate(classes)))
        of_context = of_gram.groupBy(F.shiftright("gram", 8).alias("gram")).agg(
            *(F.sum(f"n{i}").alias(f"sum{i}") for i in (0, 1)), *(F.count_if(F.col(f"n{i}") > 0).alias(f"kinds{i}") for i in (0, 1)))
        for name, rows in (("n", of_gram), ("context", of_context)):
            got = rows.select("gram", *(F.col(c).cast("double") for c in rows.columns[1:])).toPandas()
            out[name, order] = got.iloc[:, 0].to_numpy(np.int64), got.iloc[:, 1:].to_numpy(np.float64)
    return out


class Slots:
    """Where packed bytes have their row: at their remainder, or behind all slots if another gram is there."""

    def __init__(self, keys: np.ndarray, span: int):
        self.size = min(max(SLOTS, len(keys) | 1), span)
        self.home = np.full(self.size, -1, np.int64)
        self.home[keys % self.size] = keys  # of grams that share a slot, one keeps it
        self.others = np.sort(keys[self.home[keys % self.size] != keys])

    def __len__(self) -> int:
        return self.size + len(self.others) + 1  # the last row is that of unknown grams

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = keys % self.size
        away = np.flatnonzero(self.home[at] != keys)
        if len(away):
            place = np.searchsorted(self.others, keys[away])
            known = np.append(self.others, -1)[place] == keys[away]
            at[away] = self.size + np.where(known, place, len(self.others))
        return at

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """All packed bytes that have a row, and their rows."""
        at = np.flatnonzero(self.home >= 0)
        return np.concatenate([self.home[at], self.others]), np.concatenate([at, self.size + np.arange(len(self.others))])


class KneserNey:
    """Interpolated probabilities of both classes from the tables of all orders."""

    def __init__(self, tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT):
        rows = {}
        for order in range(1, ORDER + 1):
            (grams, n), (contexts, sums) = tables["n", order], tables["context", order]
            seen = np.maximum(n - discount, 0).astype(np.float32)
            rest = np.stack([sums[:, :2], discount * sums[:, 2:]]).astype(np.float32)  # a total is its kinds at least
            rows[order] = grams, seen, contexts, rest
        self._place(rows)
        self.ready = bool(tables["n", ORDER][1].sum(0).min() > 0) if tables else False

    def _place(self, rows: dict[int, tuple[np.ndarray, ...]]) -> None:
        """Lay out the slots of all orders from (grams, their rows of ``seen``, contexts, their rows of ``rest``)."""
        self.seen, self.rest, self.slots = {}, {}, {}
        for order, (grams, seen, contexts, rest) in rows.items():
            n, context = self.slots["n", order], self.slots["context", order] = Slots(grams, 256 ** order), Slots(contexts, 256 ** (order - 1))
            self.seen[order], self.rest[order] = np.zeros((len(n), 2), np.float32), np.zeros((2, len(context), 2), np.float32)
            self.seen[order][n.find(grams)] = seen
            self.rest[order][:, context.find(contexts)] = rest

    def __getstate__(self) -> dict:
        """The rows without the slots, most of which may be empty."""
        rows = {}
        for order in self.seen:
            (grams, at), (contexts, behind) = self.slots["n", order].kept(), self.slots["context", order].kept()
            rows[order] = grams, self.seen[order][at], contexts, self.rest[order][:, behind]
        return {"rows": rows, "ready": self.ready}

    def __setstate__(self, state: dict) -> None:
        self._place(state["rows"])
        self.ready = state["ready"]

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Probabilities in both classes of the last byte of packed top-order grams behind the others."""
        p = np.full((len(grams), 2), 1 / 256)
        for order in range(1, ORDER + 1):
            key = grams & ((1 << (8 * order)) - 1)
            total, left = self.rest[order][:, self.slots["context", order].find(key >> 8)]
            known = total > 0
            seen = self.seen[order][self.slots["n", order].find(key)]
            safe = np.where(known, total, 1)
            p = np.where(known, seen / safe + left / safe * p, p)
        return p

    def ratios(self, lines: list[bytes]) -> np.ndarray:
        """(log-likelihood ratio, symbols) of each line."""
        flat, at, line = _symbols(lines)
        sums = np.zeros(len(lines))
        for i in range(0, len(at), SYMBOLS_HELD):
            grams, place = np.unique(_keys(flat, at[i:i + SYMBOLS_HELD], ORDER), return_inverse=True)
            p = self.probabilities(grams)
            sums += np.bincount(line[i:i + SYMBOLS_HELD], (np.log(p[:, 0]) - np.log(p[:, 1]))[place], len(lines))
        return np.stack([sums, np.bincount(line, minlength=len(lines))], axis=1)


def ratio(df: DataFrame, model: KneserNey, text_col: str = "text") -> DataFrame:
    """Every row of ``df`` without its text, plus ``ratio``: the log-likelihood ratio per symbol."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the labelled texts have distinct grams
    carried = [c for c in df.columns if c not in (text_col, "ratio")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kn = shared.value
        for batch in batches:
            lines = [line_of(t) if kn.ready else b"" for t in batch.column(text_col).to_pylist()]
            value, has = np.zeros(len(lines)), np.flatnonzero([len(x) for x in lines])
            if len(has):
                parts = kn.ratios([lines[i] for i in has])
                value[has] = parts[:, 0] / parts[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(value)], [*carried, "ratio"])

    inputs = df.select(*carried, text_col)
    schema = ", ".join([f"`{c}` {inputs.schema[c].dataType.simpleString()}" for c in carried] + ["ratio double"])
    return map_batches(inputs, run, schema)


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from ``ratio`` to ``toxic``, by Newton steps on a histogram."""
    half = BINS // 2
    cell = F.least(F.greatest(F.floor(F.col("ratio") / BIN_WIDTH), F.lit(-half)), F.lit(half - 1)).cast("int")
    rows = scored.groupBy(cell.alias("cell")).agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).toPandas().to_numpy(np.float64)
    slope, offset = 100.0, -1.0
    if not len(rows) or rows[:, 1].sum() == 0 or rows[:, 2].sum() == 0:
        return slope, offset
    x, yes, n = (rows[:, 0] + 0.5) * BIN_WIDTH * 100, rows[:, 1], rows[:, 1] + rows[:, 2]
    w, ridge = np.array([1.0, -1.0]), np.diag([1e-3, 1e-6])
    design = np.stack([x, np.ones_like(x)], axis=1)

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float((n * np.logaddexp(0, z) - yes * z).sum() + v @ ridge @ v / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, design.T @ (yes - n * p) - ridge @ w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0) * 100, float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, fold, held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    ``fold(column)`` gives a row's fold from its doc_id. Labels of fold ``held_out`` are never used; the last of the other folds
    serves the calibration, the rest the counts. Only labelled texts are shuffled, once."""
    marks = labels.where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    usable = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != held_out)
    last = max(i for i in range(folds) if i != held_out)
    training = usable.join(marks.hint("merge"), "doc_id")  # the same plan at every size
    grams = store(top_grams(training.where(fold(F.col("doc_id")) != last)), "grams")
    model = KneserNey(slot_tables(grams))
    ratios = store(ratio(docs.select("doc_id", "text"), model), "ratios")
    slope, offset = calibrate(ratios.where(fold(F.col("doc_id")) == last).join(marks, "doc_id"))
    score = 1 / (1 + F.exp(-F.least(F.greatest(slope * F.col("ratio") + offset, F.lit(-500.0)), F.lit(500.0))))
    return ratios.select("doc_id", (fold(F.col("doc_id")) == held_out).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
