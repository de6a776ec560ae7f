"""Byte-level BPE over a whole corpus as a streaming transducer with bounded lookahead.

Two layers, both left to right. The splitter cuts a text into pieces that merges never cross. It holds back what more text
could still change. Within a piece, merges are settled once enough bytes follow: how many is computed from the merge list.

**Sufficient lookahead.** Compare encoding a piece as far as it is read with encoding it longer. Before any merge the two
differ only from the end on. Let the frontier be the leftmost place where they differ. Ranks only rise while merging, and
the frontier moves left past a token ``u`` only when a rule (u, v) applies in one of the two with ``v`` starting at the
frontier. So going through the rules in rank order, ``reach[x]``, the most bytes from the start of a frontier token ``x``
to the end, satisfies: reach[u] and reach[uv] grow to reach[v] + len(u), and reach[uv] also to reach[u]. The maximum bounds
how far any end can be felt; tokens that end further left are final. For the vocabulary used here it is 129 bytes.

So pieces of any length are encoded through a window of fixed size, and memory doesn't grow with the text.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern by which the public byte-level BPE vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("DOCLAKE_TOKENIZERS", "/opt/tokenizers")
#: Characters that the transducer takes at a time and holds before it must emit, and ids in one output batch.
BLOCK, BATCH_IDS = 1_024, 1_000_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def rules(ranks: dict[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """The merge list, in rank order: which two tokens make each token of two and more bytes."""
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, i = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            yield parts[0], parts[1]


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token that settle it, whatever follows them."""
    reach = dict.fromkeys(ranks, 0)
    for u, v in rules(ranks):
        moved = reach.get(v, 0) + len(u)
        held = reach.get(u, 0)
        reach[u] = max(held, moved)
        reach[u + v] = max(reach.get(u + v, 0), held, moved)
    return max(reach.values(), default=0)


class Tokenizer:
    """A vocabulary with what its transducers need."""

    def __init__(self, data: bytes, lookahead: int | None = None):
        ranks = parse_ranks(data)
        self.lookahead = sufficient_lookahead(ranks) if lookahead is None else lookahead
        self.pieces = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(t) for t in self.bytes_of])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for null and empty. Strings that look like special tokens are plain text."""
        if not text:
            return np.zeros(0, np.uint32)
        e = Encoder(self)
        parts = [e.push(text[i : i + BLOCK]) for i in range(0, len(text), BLOCK)]
        return np.concatenate([*parts, e.finish()])

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


_RUNS = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")]
_SPACE_RUN = _RUNS[2]
_PIECE = regex.compile(PATTERN)


class Encoder:
    """Text in, ids out, each as soon as it is settled. Holds about two blocks of text at most."""

    def __init__(self, tokenizer: Tokenizer, block: int = BLOCK):
        self.t, self.block = tokenizer, max(block, 4 * tokenizer.lookahead + 16)
        self.held = ""
        self.run = None  # the class of the piece that fills the window, when one does
        self.tail = b""  # of that piece, the bytes of a character that are not emitted yet

    def push(self, text: str) -> np.ndarray:
        self.held += text
        return self._drain(False)

    def finish(self) -> np.ndarray:
        return self._drain(True)

    def _drain(self, final: bool) -> np.ndarray:
        out = []
        while True:
            if self.run is not None:
                end = self.run.match(self.held).end()
                if end == len(self.held) and not final:
                    if end >= self.block:
                        out.append(self._settle())
                    break
                # White space before other text leaves its last character to the next piece.
                stop = end - 1 if self.run is _SPACE_RUN and end < len(self.held) else end
                if stop or self.tail:
                    out.append(self._ids(self.tail + self.held[:stop].encode()))
                self.held, self.run, self.tail = self.held[stop:], None, b""
            elif final:
                if self.held:
                    out.append(self.t.pieces.encode_to_numpy(self.held, disallowed_special=()))
                    self.held = ""
                break
            elif len(self.held) < self.block:
                break
            else:
                cut = self._boundary()
                if cut:
                    out.append(self.t.pieces.encode_to_numpy(self.held[:cut], disallowed_special=()))
                    self.held = self.held[cut:]
                    continue
                last = 0
                for m in _PIECE.finditer(self.held):
                    if m.end() > len(self.held) - 3:  # a contraction is decided by two more characters
                        break
                    out.append(self._ids(m[0].encode()))
                    last = m.end()
                self.held = self.held[last:]
                if not last:
                    if _PIECE.match(self.held).end() < len(self.held):
                        break  # the first piece ends at the window's end: a few more characters decide
                    # One piece fills the window; its class is that of its last character.
                    self.run = next(r for r in _RUNS if r.fullmatch(self.held[-1]))
                    out.append(self._settle())
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _boundary(self) -> int:
        """The last space in the held text that follows other text: pieces part there, and what is before it is encoded
        alike with and without what follows. 0 if there is none."""
        at = len(self.held) - 1
        while (at := self.held.rfind(" ", 1, at)) > 0:
            if not self.held[at - 1].isspace():
                return at
        return 0

    def _ids(self, data: bytes) -> np.ndarray:
        return np.array(self.t.pieces._encode_single_piece(data), np.uint32) if data else np.zeros(0, np.uint32)

    def _settle(self) -> np.ndarray:
        """Emit the settled tokens of the piece in the window; all but the window's end."""
        data = self.tail + self.held.encode()
        ids = self._ids(data)
        ends = np.cumsum(self.t.lengths[ids])
        n = int(np.searchsorted(ends, len(data) - self.t.lookahead - 4, side="right"))
        rest = data[int(ends[n - 1]) :] if n else data
        # Keep whole characters as text; the bytes of one that a token has cut stay in front.
        k = 0
        while k < len(rest) and rest[k] & 0xC0 == 0x80:
            k += 1
        self.tail, self.held = rest[:k], rest[k:].decode()
        return ids[:n]


class Decoder:
    """Ids in, text out: bytes of characters that aren't complete wait for the next ids."""

    def __init__(self, tokenizer: Tokenizer):
        self.t = tokenizer
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.t.bytes_of[i] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(data: bytes, lookahead: int) -> Tokenizer:
    key = hashlib.sha1(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(data, lookahead)
    return _loaded[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast((data, sufficient_lookahead(parse_ranks(data))))


def encode_column(df: DataFrame, keys: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keys`` and ``ids`` (array of int) of every row of ``df``: the tokens of column ``text``, whole.

    Null and empty texts give an empty array; rows that are repeated come out repeated; an empty table gives an empty one.
    ``vocabulary`` is the path of a rank file (read by the driver, sent to the workers once: under 1 MB).
    """
    held = _vocabulary(df, vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    names = [*keys, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(*held.value)
        for batch in batches:
            texts = batch.column(len(keys))
            lo, parts, size = 0, [], 0

            def made(hi):
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) for p in parts], out=offsets[1:])
                values = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
                return pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], lists], names=names)

            for i, s in enumerate(texts):
                ids = t.encode(s.as_py())
                if parts and size + len(ids) > BATCH_IDS:
                    yield made(i)
                    lo, parts, size = i, [], 0
                parts.append(ids)
                size += len(ids)
            yield made(batch.num_rows)

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode_column(df: DataFrame, keys: list[str], ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``keys`` and ``text`` of every row of ``df``: the text that the array ``ids`` stands for, decoded BLOCK ids at a time.

    Null and empty arrays give an empty text; ids that end within a character give U+FFFD there; ids that the vocabulary
    hasn't are an error.
    """
    held = _vocabulary(df, vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(*held.value)
        for batch in batches:
            texts = []
            for row in batch.column(len(keys)):
                d = Decoder(t)
                each = row.values.to_numpy() if row.is_valid else ()
                texts.append("".join([*(d.push(each[i : i + BLOCK]) for i in range(0, len(each), BLOCK)), d.finish()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keys, "text"])

    return df.select(*keys, F.col(ids).alias("_ids")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row of ``df``; 0 for null and empty texts."""
    held = _vocabulary(df, vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(*held.value)
        for batch in batches:
            n = np.fromiter((t.count(s.as_py()) for s in batch.column(len(keys))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*keys, "n_tokens"])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)
