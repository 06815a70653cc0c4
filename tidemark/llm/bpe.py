"""Exact BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can stand last in its encoding: the token that ends there and
that BPE would leave beside the last token of the rest. An Aho-Corasick automaton over the vocabulary (suffix
matches of every prefix) proposes tokens, a pair test that undoes merges accepts one, and back-pointers give
the ids. Words are encoded once per worker and remembered; whole texts pass through one Arrow map, without a shuffle.

Defined results: a null text is the empty text (no ids, empty decoding). Repeated rows are encoded alike, other
columns are carried unchanged.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_batches

#: Ends a word inside the automaton; no byte-level symbol uses it.
END = "￿"
#: Words a worker remembers in each of two generations (a word that is met again moves to the younger one), the longest
#: word remembered, and the pairs remembered.
CACHED_WORDS, CACHED_CHARS, CACHED_PAIRS = 120_000, 64, 200_000

#: Contractions that stand alone in the pre-tokenisation of the word-level BPE file (fixed values of that file).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


_STANDING_ALONE = "|".join(CONTRACTIONS)
#: Words: contractions, runs of letters, single digits, runs of other characters. Plain ASCII texts take the simpler classes.
WORDS = regex.compile(_STANDING_ALONE + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(_STANDING_ALONE + r"|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")
#: Code points below it all have a category, so that most texts need no closer look.
BEYOND = re.compile("[\u0378-\U0010ffff]")


def unassigned() -> re.Pattern:
    """Matches code points without a category in Python's Unicode version; all others have the same one in later versions."""
    out, begin = [], None
    for i in range(0x378, 0x110001):
        inside = i < 0x110000 and unicodedata.category(chr(i)) == "Cn"
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{i - 1:08x}")
            begin = None
    return re.compile("[" + "".join(out) + "]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class PrefixBpe:
    """Encoder for a byte-level BPE file whose words end in a suffix (lower-cased, NFC, white space dropped)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        suffix = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.newer = unassigned()
        self.symbols = dict(enumerate(byte_symbols()))
        self.machine = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            key = token[: -len(suffix)] + END if token.endswith(suffix) and token != suffix else token
            self.machine.add_word(key, (i, len(key)))
        self.machine.make_automaton()
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}  # pair -> when BPE merges it
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (when it is made, left, right)
        for n, (a, b) in enumerate(model["merges"]):
            pair = ids[a], ids[b]
            self.rank.setdefault(pair, n)
            self.parts.setdefault(ids[a + b], (n, *pair))
        self.spec, self.library = spec, None
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE keeps both tokens when they stand next to each other.

        Going back in time, the younger token at the border is cut again and again; if the pieces that then
        touch would have merged before that token was made, the border is not stable. Of equal ranks the
        left one merges first, so a border pair beats an equal merge on its right, not one on its left.
        """
        key = left, right
        if (got := self.fits.get(key)) is not None:
            return got
        now, ok = float("inf"), True  # merges before this moment are still to come at the border
        while True:
            if self.rank.get((left, right), now) < now:
                ok = False
                break
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                break
            if b is None or a is not None and a[0] > b[0]:
                now, left = a[0], a[2]
            else:
                now, right = b[0] + 1, b[1]
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        return self.encode_symbols("".join(map(self.symbols.__getitem__, word.encode("utf-8", "replace"))))

    def encode_symbols(self, symbols: str) -> list[int]:
        text = symbols + END
        last, start = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for end, (token, size) in self.machine.iter(text):
            at = end + 1
            if last[at] < 0:
                before = at - size
                if before == 0 or last[before] >= 0 and self.beside(last[before], token):
                    last[at], start[at] = token, before
        out, at = [], len(text)
        while at > 0:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def lookup(self, word: str) -> tuple[bytes, str]:
        """A word that the younger generation lacks."""
        got = self.older.get(word)
        if got is None:
            got = self.packed(self.encode_word(word))
        if len(word) <= CACHED_CHARS:
            if len(self.known) >= CACHED_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = got
        return got

    def packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.tokens.__getitem__, ids))

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """Per word or special token: its ids as little-endian 32-bit integers, its decoding."""
        if self.specials is not None and "<|" in text:
            out: list[tuple[bytes, str]] = []
            for part in self.specials.split(text):
                out += [(struct.pack("<I", self.special[part]), part)] if part in self.special else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        words = ASCII_WORDS
        if not text.isascii():
            words = WORDS
            if BEYOND.search(text) and self.newer.search(text):
                return self.by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter
        lookup = self.lookup
        out = []
        for w in words.findall(text.lower()):
            out.append(self.known.get(w) or lookup(w))
        return out

    def by_library(self, text: str) -> list[tuple[bytes, str]]:
        """Texts with code points that Python's Unicode tables do not know: the library's own, newer tables split them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [self.packed(self.encode_symbols(w)) for w, _ in words]

    def encode(self, text: str | None) -> list[int]:
        ids = b"".join(p[0] for p in self.pieces(text or ""))
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


_LOADED: dict[str, PrefixBpe] = {}


def load(spec: str) -> PrefixBpe:
    """One encoder per worker and file; its word memory lives as long as the worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = PrefixBpe(spec)
    return _LOADED[key]


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every row of ``df`` without its text, plus n_tokens, ids_sha256 and decoded_sha256 (and, if asked for, ids and decoded).

    ``tokenizer_path`` is read on the driver and broadcast (a vocabulary of fixed size); ``df`` may hold any other columns
    except the added names."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    handle = df.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file: fixed size
    carried = [c for c in df.columns if c != text_col and c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")]
    schema = T.StructType([df.schema[c] for c in carried] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
                          + ([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(handle.value)
        for batch in batches:
            counts, hashes, decodings, ids_out, dec_out = [], [], [], [], []
            for text in batch.column(text_col).to_pylist():
                found = bpe.pieces(text or "")
                ids, decoded = b"".join([p[0] for p in found]), " ".join([p[1] for p in found])
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decodings.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    ids_out.append(list(struct.unpack(f"<{len(ids) // 4}I", ids)))
                    dec_out.append(decoded)
            columns = [batch.column(c) for c in carried] + [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decodings, pa.string())]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(dec_out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return map_batches(df.select(*carried, text_col), run, schema)
