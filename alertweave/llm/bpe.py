"""Byte-level BPE by prefix dynamic programming.

Each prefix of a byte string has exactly one valid encoding, and that encoding without its
last token is the encoding of a shorter prefix. So one number per prefix, its last token,
describes the encodings of all prefixes at once: a token may end a prefix if it may follow
the last token of the prefix before it. Appending computes only the new prefixes; after an
edit the prefixes behind it are recomputed until they agree with the old ones again.

The texts are cut by the tokenizer's pattern first, and each match is encoded on its own.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
import threading
import time
import types
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..functions.staging import ship
from .common import add_columns, give_back, texts_of

ship(__name__)

NONE = -1
#: A space is surely the start of a match if no white space stands beside it.
_UNSURE = re.compile(r" \s|\s ")
#: Words, prefixes and pairs of tokens kept in a Python process, by store; they never change a result.
REMEMBERED = 300_000
#: Tokens that are decoded at once.
SLICE = 1 << 16
#: Rows whose texts, ids and digests are in a Python process at once.
ROWS = 250
#: Longest prefix, in bytes, that is kept for other words.
SHARED_PREFIX = 24


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Prefixes:
    """A byte string and the last token of each of its prefixes (``last[0]`` is NONE)."""

    def __init__(self, data: bytes = b"", last: list[int] | None = None):
        self.data, self.last = data, last or [NONE]


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {token: data for data, token in ranks.items()}
        self.length_of = {token: len(data) for data, token in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        # Every end of a token, with the token that it is itself, or NONE.
        self._ends = {data[i:]: NONE for data in ranks for i in range(1, len(data))} | ranks
        self._pairs: dict[int, bool] = {}
        self.known: dict[bytes, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """Encoding by its definition: merge the pair of the lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks) * 2
        ranks = [self.ranks.get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``b`` can come right after ``a`` (or, after NONE, at the start)."""
        key = (a + 1) << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            left = [a] if a != NONE else []
            data = b"".join(self.bytes_of[t] for t in [*left, b])
            known = self._pairs[key] = self.merged(data) == [*left, b]
        return known

    def _last_token(self, data: bytes, end: int, last: list[int]) -> int:
        found, ends = [], self._ends
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            token = ends.get(data[start:end])
            if token is None:  # no longer token ends here
                break
            if token >= 0:
                found.append((start, token))
        for start, token in reversed(found):
            if self.may_follow(last[start], token):
                return token
        raise ValueError(f"no token for byte {data[end - 1]}")

    def append(self, state: Prefixes, more: bytes) -> Prefixes:
        """The state of the longer string; prefixes that are known stay as they are."""
        data, last = state.data + more, list(state.last)
        for end in range(len(last), len(data) + 1):
            last.append(self._last_token(data, end, last))
        return Prefixes(data, last)

    def edit(self, state: Prefixes, start: int, end: int, new: bytes) -> Prefixes:
        """Replace bytes ``start`` to ``end``; stop where old and new prefixes agree for long."""
        data = state.data[:start] + new + state.data[end:]
        last = list(state.last[: start + 1])
        shift, agreed = len(data) - len(state.data), 0
        for at in range(start + 1, len(data) + 1):
            last.append(self._last_token(data, at, last))
            old = at - shift
            same = at >= start + len(new) and old >= end and state.last[old] == last[-1]
            agreed = agreed + 1 if same else 0
            if agreed >= self.longest:
                return Prefixes(data, last + state.last[old + 1 :])
        return Prefixes(data, last)

    def tokens(self, state: Prefixes) -> list[int]:
        out, at = [], len(state.data)
        while at:
            out.append(state.last[at])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """One match of the pattern; a match that is a token itself is that token.

        The last tokens of short prefixes are kept, for this word and those that begin like it.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > SHARED_PREFIX:
            return self.tokens(self.append(Prefixes(), data))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        while data:
            token = self.last_of(data)
            out.append(token)
            data = data[: -self.length_of[token]]
        return out[::-1]

    def last_of(self, data: bytes) -> int:
        """Last token of a short prefix. It is kept, and so are those of the shorter prefixes
        that it follows; prefixes that no token leads to are not asked for."""
        known, ends, pairs = self.known, self._ends, self._pairs
        if data in known:
            return known[data]
        found = []
        for start in range(len(data) - 1, -1, -1):
            token = ends.get(data[start:])
            if token is None:  # no longer token ends here
                break
            if token >= 0:
                found.append((start, token))
        for start, token in reversed(found):
            before = self.last_of(data[:start]) if start else NONE
            fits = pairs.get((before + 1) << 32 | token)
            if fits or (fits is None and self.may_follow(before, token)):
                known[data] = token
                return token
        raise ValueError(f"no token for byte {data[-1]}")


class _Remembered(dict):
    """Values of a function by key: up to ``most`` new keys and as many that came before them.

    When the new ones are full they become the old ones; what is asked for again is new again.
    """

    def __init__(self, fn: Callable, most: int):
        self.fn, self.most, self.old = fn, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        value = self[key] = self.fn(key) if value is None else value
        return value


class TextEncoder:
    """Encodes texts to little-endian int32 ids, remembering words already seen."""

    def __init__(self, bpe: Bpe, pattern: str):
        self.pattern = regex.compile(pattern)
        # Letters, and marks that end a word, are matches of their own in the public pattern.
        self.by_word = pattern == public_tokenizers.PATTERN
        self.bpe = bpe
        self.packed = {t: t.to_bytes(4, "little") for t in bpe.bytes_of}
        self.mark = {m: self._plain(m) for m in ".,"}
        self.after_space = _Remembered(self._after_space, REMEMBERED // 2)

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.packed[t] for t in self.bpe.encode_piece(piece.encode())])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pattern.findall(text)))

    def _after_space(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(f" {word}")
        if word[-1:] in self.mark and word[:-1].isalpha():
            return self.after_space[word[:-1]] + self.mark[word[-1]]
        return self._plain(f" {word}")

    def encode(self, text: str) -> bytes:
        if not self.by_word or _UNSURE.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self.after_space.__getitem__, rest))


class Decoder:
    """The bytes of ids, by one table of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        ordered = sorted((t, data) for data, t in ranks.items())
        self.flat = np.frombuffer(b"".join(data for _, data in ordered), "u1")
        self.length = np.zeros(ordered[-1][0] + 1 if ordered else 1, "i8")
        for t, data in ordered:
            self.length[t] = len(data)
        self.begin = np.cumsum(self.length) - self.length
        self.decimal = [str(t).encode() for t in range(len(self.length))]

    def bytes_of(self, tokens: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(tokens), SLICE):
            part = tokens[at : at + SLICE].astype("i8")
            sizes = self.length[part]
            # Byte i of the output is byte i - (start of its token) of that token.
            starts = self.begin[part] - (np.cumsum(sizes) - sizes)
            out.append(self.flat[np.repeat(starts, sizes) + np.arange(sizes.sum())].tobytes())
        return b"".join(out)

    def decimals(self, tokens: np.ndarray) -> bytes:
        """The decimal ids joined by commas."""
        return b",".join(map(self.decimal.__getitem__, tokens.tolist()))


class _Kept:
    """A value of a Python process, let go when nobody has asked for it for some seconds."""

    def __init__(self, value, idle: float):
        self.value, self.idle, self.asked = value, idle, time.monotonic()
        self._wait()

    def _wait(self) -> None:
        timer = threading.Timer(self.idle, self._look)
        timer.daemon = True
        timer.start()

    def _look(self) -> None:
        if self.value is not None and time.monotonic() - self.asked < self.idle:
            self._wait()
        else:
            self.value = None
            gc.collect()
            give_back()


def of_process(key: tuple, make: Callable, idle: float = 30.0):
    """``make()``, once in each Python process for ``key`` while tasks that use it follow each other.

    This module travels by value, so its own globals are new in each task. Each batch asks
    anew, and takes far less time than that, so a task keeps it; later stages of other kinds get the memory back.
    """
    name = "process_store_of_corpus_operators"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("made", {})
    kept = store.get(key)
    value = kept.value if kept else None
    if value is None:
        value = make()
        store[key] = _Kept(value, idle)
    else:
        kept.asked = time.monotonic()
    return value


class Vocabulary:
    """A rank file for the tasks of a session: read on the driver, a few MB, sent once.

    ``encoder()`` and ``decoder()`` are called in tasks and made once in each process.
    """

    def __init__(self, df: DataFrame, path: str | None, pattern: str = public_tokenizers.PATTERN):
        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        ranks = read_ranks(path)
        self.pattern = pattern
        self.name = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest()
        self.shared = df.sparkSession.sparkContext.broadcast(ranks)

    def encoder(self) -> TextEncoder:
        return of_process(("encoder", self.name, self.pattern), lambda: TextEncoder(Bpe(self.shared.value), self.pattern))

    def decoder(self) -> Decoder:
        return of_process(("decoder", self.name), lambda: Decoder(self.shared.value))


def _lists(values: np.ndarray, sizes: list[int], kind=pa.ListArray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype="i8")]).astype("i4")
    return kind.from_arrays(pa.array(offsets), pa.array(values))


def encode(
    df: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    text: str = "text",
    out: str = "ids",
) -> DataFrame:
    """Add the token ids of ``text`` as array ``out``, as the tiktoken library gives them.

    Null counts as empty and gives an empty array. Special tokens are never made. Rows are
    independent, so repeated rows give equal arrays. The rank file is read on the driver; it is
    a fixed vocabulary of a few MB and goes to the tasks as one broadcast value.
    """
    vocabulary = Vocabulary(df, path, pattern)

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            encoder = vocabulary.encoder()
            packed = [encoder.encode(x) for x in texts_of(batch, text)]
            values = np.frombuffer(b"".join(packed), "<i4")
            return {out: _lists(values, [len(p) // 4 for p in packed])}

        return fn

    return add_columns(df, make, f"`{out}` array<int>")


def decode(
    df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """Add the bytes that the ids stand for; a null or empty array gives empty bytes."""
    vocabulary = Vocabulary(df, path)

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            decoder = vocabulary.decoder()
            column = batch.column(ids)
            tokens = np.asarray(column.flatten())
            counts = np.nan_to_num(column.value_lengths().to_numpy(False)).astype("i8")
            stops = np.concatenate([[0], np.cumsum(decoder.length[tokens])])[np.cumsum(counts)]
            offsets = np.concatenate([[0], stops]).astype("i4")
            return {
                out: pa.Array.from_buffers(
                    pa.binary(), len(counts),
                    [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(decoder.bytes_of(tokens))],
                )
            }

        return fn

    return add_columns(df, make, f"`{out}` binary")


def round_trip(df: DataFrame, path: str | None = None, text: str = "text", ids: str | None = None) -> DataFrame:
    """Encode ``text``, decode the ids, and add the digests of both, in one pass of one worker.

    Adds ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256``
    and, if ``ids`` names it, the array of ids; input columns of these names are replaced. Null
    counts as empty; rows are independent, so repeated rows give equal results and an empty
    table none.
    """
    vocabulary = Vocabulary(df, path)

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            encoder, decoder = vocabulary.encoder(), vocabulary.decoder()
            sizes, names, decoded, kept = [], [], [], []
            for x in texts_of(batch, text):
                packed = encoder.encode(x)
                tokens = np.frombuffer(packed, "<i4")
                sizes.append(len(tokens))
                names.append(hashlib.sha256(decoder.decimals(tokens)).hexdigest())
                decoded.append(hashlib.sha256(decoder.bytes_of(tokens)).hexdigest())
                if ids:
                    kept.append(packed)
            out = {
                "n_tokens": pa.array(sizes, pa.int64()),
                "ids_sha256": pa.array(names, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            return out | ({ids: _lists(np.frombuffer(b"".join(kept), "<i4"), sizes)} if ids else {})

        return fn

    new = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return add_columns(df, make, new + (f", `{ids}` array<int>" if ids else ""), ROWS)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode ``text``; one row per row with counts and digests of both results.

    Nulls, empty texts, repeats and empty tables: see ``round_trip``.
    """
    return round_trip(df.select("doc_id", "text"), path).drop("text")
