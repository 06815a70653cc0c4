"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of one fixed public vocabulary, whatever their length. The probability of
a word of any length is the sum over all ways of cutting it into pieces, computed by a forward pass; a text's log-likelihood
is the sum over its words, and the prediction is the most likely language under equal priors.

Learning counts every occurrence of every piece in the words of all labelled training texts (no sample): each task
counts its words per language, turns distinct words into piece counts with their weights, and one aggregation adds
up at most (pieces x languages) rows per task. The model is a table of that size: bounded by the vocabulary.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was
learned; ties go to the language that sorts first; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

#: Forward values are brought back into range every so many bytes of a word.
RESCALE = 32
#: Bytes of words looked up at once.
BYTES_AT_ONCE = 1_000_000
#: Distinct words a task gathers before it turns them into counts or forgets their scores.
WORDS_HELD = 300_000
#: Added to every piece count.
SMOOTHING = 0.5
#: Piece probabilities are scaled by this factor per byte inside the forward pass, so that products stay in range.
_SCALE = 16.0
#: Forward values below it (or above its inverse) are not trusted.
_FAINT = 1e-150

_LETTER = regex.compile(r"\p{L}")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words at ASCII white space, each with the leading space of byte-level vocabularies."""
    return text.lower().encode("utf-8", "replace").split()


class Pieces:
    """Looks up all pieces of many words at once, in a trie."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.lengths = np.fromiter(map(len, pieces), np.int64, self.size)
        nodes = {b"": 0}
        for p in pieces:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        edges = sorted((nodes[q[:-1]] << 8 | q[-1], node) for q, node in nodes.items() if q)
        self.edges = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([node for _, node in edges], np.int64)
        self.piece = np.full(len(nodes), self.size, np.int64)  # by node; ``size`` where no piece ends
        for i in range(self.size - 1, -1, -1):
            self.piece[nodes[pieces[i]]] = i

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            return cls([base64.b64decode(line.split()[0]) for line in f if line.strip()])

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """(word numbers, longest first; their byte lengths; ``(n, end positions, places of the words, piece numbers)`` of
        all n-byte pieces). Words are padded with their leading space."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        flat = np.frombuffer(b"".join(b" " + words[i] for i in order.tolist()), np.uint8)
        row = np.repeat(np.arange(len(words)), lengths)
        stop = np.cumsum(lengths)
        at = np.arange(len(flat))  # beginnings that are still followed, and their nodes
        node = np.zeros(len(flat), np.int64)
        found, n = [], 0
        while len(at) and len(self.edges):
            key = node << 8 | flat[at + n]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            known = self.edges[place] == key
            at, row, node, n = at[known], row[known], self.child[place[known]], n + 1
            ids = self.piece[node]
            hit = ids < self.size
            if hit.any():
                found.append((n, at[hit] + n - (stop - lengths)[row[hit]], row[hit], ids[hit]))
            more = at + n < stop[row]
            at, row, node = at[more], row[more], node[more]
        return order, lengths, found

    def count(self, weights: dict[bytes, int]) -> np.ndarray:
        """Occurrences of every piece in words that occur so often."""
        total = np.zeros(self.size)
        for words in _parts(list(weights)):
            order, _, found = self.lattice(words)
            each = np.array([weights[w] for w in words], np.float64)[order]
            for _, _, row, ids in found:
                total += np.bincount(ids, each[row], self.size)
        return total

    def score(self, words: list[bytes], scaled: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word under each language; ``scaled``: (pieces + 1) x languages, the last row zero.

        Words whose forward values come near the ends of the number range are scored again in logarithms."""
        out = np.zeros((len(words), scaled.shape[1]))
        with np.errstate(divide="ignore"):
            logs_of = np.log(scaled)
        with np.errstate(over="ignore", invalid="ignore"):  # such words are among those
            self._score(words, scaled, logs_of, out)
        return out

    def _score(self, words: list[bytes], scaled: np.ndarray, logs_of: np.ndarray, out: np.ndarray) -> None:
        number = {w: i for i, w in enumerate(words)}
        for part in _parts(words):
            order, lengths, found = self.lattice(part)
            steps: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}  # by end position
            for n, ends, row, ids in found:
                by_end = np.argsort(ends, kind="stable")
                ends, row, ids = ends[by_end], row[by_end], ids[by_end]
                cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(ends)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    steps.setdefault(int(ends[lo]), []).append((n, row[lo:hi], ids[lo:hi]))
            keep = found[-1][0] if found else 1  # the longest piece that occurs
            back: list[np.ndarray] = [np.ones((len(part), scaled.shape[1]))]  # forward values, newest first
            logs = np.zeros((len(part), scaled.shape[1]))
            faint = np.zeros(len(part), bool)
            for end in range(1, int(lengths[0]) + 1):
                alive = int(np.searchsorted(-lengths, -end, side="right"))
                now = np.zeros((alive, scaled.shape[1]))
                for n, row, ids in steps.get(end, ()):
                    now[row] += back[n - 1][row] * scaled[ids]
                back = [now, *back[: keep - 1]]
                if end % RESCALE == 0:  # carried over the whole word, by word and language
                    top = np.where(now > 0, now, 1.0)
                    logs[:alive] += np.log(top)
                    faint[:alive] |= (now < _FAINT).any(1)
                    back = [b[:alive] / top for b in back]
                    for b in back:
                        faint[:alive] |= (b > 1 / _FAINT).any(1)
                    now = back[0]
                done = slice(int(np.searchsorted(-lengths, -end, side="left")), alive)
                faint[done] |= (now[done] < _FAINT).any(1)
                logs[done] += np.log(np.maximum(now[done], 1e-300)) - end * np.log(_SCALE)
            for i in np.flatnonzero(faint).tolist():
                logs[i] = self.log_score(part[order[i]], logs_of)
            out[[number[part[i]] for i in order.tolist()]] = logs

    def log_score(self, word: bytes, logs_of: np.ndarray) -> np.ndarray:
        """The same for one word, all in logarithms: slower, and exact however unlikely its pieces are."""
        _, lengths, found = self.lattice([word])
        ending: dict[int, list[tuple[int, int]]] = {}
        for n, ends, _, ids in found:
            for end, piece in zip(ends.tolist(), ids.tolist(), strict=True):
                ending.setdefault(end, []).append((end - n, piece))
        size = int(lengths[0])
        forward = np.full((size + 1, logs_of.shape[1]), -np.inf)
        forward[0] = 0.0
        for end in range(1, size + 1):
            for begin, piece in ending.get(end, ()):
                forward[end] = np.logaddexp(forward[end], forward[begin] + logs_of[piece])
        none = np.log(1e-300)  # no segmentation at all
        return np.where(np.isfinite(forward[size]), forward[size], none) - size * np.log(_SCALE)


def _parts(words: list[bytes]) -> Iterator[list[bytes]]:
    """Lists of words of like length, each of few bytes; a longer word is a list of its own."""
    out: list[bytes] = []
    held = 0
    for w in sorted(words, key=len):
        if out and held + len(w) >= BYTES_AT_ONCE:
            yield out
            out, held = [], 0
        out.append(w)
        held += len(w) + 1
    if out:
        yield out


def train(df: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Pieces, np.ndarray]:
    """(languages, pieces, scaled piece probabilities) from all rows of ``df`` with a language and a text."""
    pieces = Pieces.from_file(vocabulary_path)
    shared = df.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        totals: dict[str, np.ndarray] = {}

        def flush() -> None:
            for lang, words in held.items():
                if words:
                    totals[lang] = totals.get(lang, 0) + shared.value.count(words)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > WORDS_HELD:
                flush()
        flush()
        for lang, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["lang", "piece", "n"])

    labelled = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # sums of whole numbers below 2^53: exact in any order
    rows = map_batches(labelled, run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((pieces.size, len(langs)))
    if langs:
        counts[rows["piece"].to_numpy(), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = rows["n"].to_numpy()
    probs = (counts + SMOOTHING) / (counts + SMOOTHING).sum(0) * (_SCALE ** pieces.lengths)[:, None]
    return langs, pieces, np.vstack([probs, np.zeros((1, len(langs)))])


def predict(df: DataFrame, model: tuple[list[str], Pieces, np.ndarray], text_col: str = "text") -> DataFrame:
    """Every row of ``df`` without its text, plus lang_pred and score (the posterior of that language)."""
    langs = model[0]
    shared = df.sparkSession.sparkContext.broadcast((model[1], model[2]))
    carried = [c for c in df.columns if c not in (text_col, "lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, scaled = shared.value
        number: dict[bytes, int] = {}
        scores = np.zeros((0, len(langs)))
        for batch in batches:
            ids, ends, known = [], [], len(number)
            fresh: list[bytes] = []
            readable = []
            for text in batch.column(text_col).to_pylist():
                readable.append(bool(langs) and text is not None and _LETTER.search(text) is not None)
                if readable[-1]:
                    for w in (words := words_of(text)):
                        if w not in number:
                            number[w] = len(number)
                            fresh.append(w)
                    ids += map(number.__getitem__, words)
                ends.append(len(ids))
            if fresh:
                scores = np.vstack([scores[:known], pieces.score(fresh, scaled)])
            preds, posts = [], []
            begin = 0
            index = np.array(ids, np.int64)
            for ok, end in zip(readable, ends, strict=True):
                if ok:
                    total = scores[index[begin:end]].sum(0)
                    best = int(np.argmax(total))
                    preds.append(langs[best])
                    posts.append(float(1 / np.exp(total - total[best]).sum()))
                else:
                    preds.append("und")
                    posts.append(0.0)
                begin = end
            if len(number) > WORDS_HELD:
                number, scores = {}, np.zeros((0, len(langs)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(preds, pa.string()), pa.array(posts, pa.float64())], [*carried, "lang_pred", "score"])

    inputs = df.select(*carried, text_col)
    schema = ", ".join([f"`{c}` {inputs.schema[c].dataType.simpleString()}" for c in carried] + ["lang_pred string", "score double"])
    return map_batches(inputs, run, schema)


def identify(df: DataFrame, vocabulary_path: str, training: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` without its text, with lang_pred and score; learned from the rows where ``training`` holds."""
    return predict(df, train(df if training is None else df.where(training), vocabulary_path, text_col, lang_col), text_col)
