"""Byte-level BPE encoding and decoding of whole texts as a tree reduction.

The encodings of adjacent texts form a monoid: a text is halved until the parts are short, the parts are
encoded, and neighbours are joined by encoding anew a window around their border. A window begins and ends at a space behind
another character. It is wide enough when everything outside it has settled on both sides: the next wider window gives the same tokens
for the stretches between the two, the parts themselves have those tokens there, and the splitting pattern, applied to the wider window, ends a match at
both places. From a place where a match ends the rest of a text is split alike whatever precedes it, as long as the pattern does not look behind; so the
tokens outside are those of the whole text. A window that has not settled grows, up to the whole of both parts. Patterns that look behind or at
the ends of lines or texts are refused. Decoding concatenates the decoded parts up a tree.

The rank file is read on the driver from the path given and broadcast: its size is checked.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.textkernel import releasing

MOST_RANK_BYTES = 64 << 20
LEAF = 1 << 11
WINDOW = 64
KINDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


@dataclass(frozen=True)
class Vocabulary:
    """A file of ranks (a base64 token and its rank on each line) and the pattern that splits texts before the merges."""

    path: str
    pattern: str

    def read(self) -> bytes:
        with open(self.path, "rb") as file:
            data = file.read(MOST_RANK_BYTES + 1)
        if len(data) > MOST_RANK_BYTES:
            raise ValueError(f"{self.path} exceeds {MOST_RANK_BYTES} bytes, the most that is broadcast")
        return data


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def _before(text: str, lo: int, mid: int) -> int:
    """The last space behind another character in (lo, mid), else lo."""
    at = text.rfind(" ", lo + 1, mid)
    while at > lo and text[at - 1].isspace():
        at = text.rfind(" ", lo + 1, at)
    return max(at, lo)


def _after(text: str, mid: int, hi: int) -> int:
    """The first such place in (mid, hi), else hi."""
    at = text.find(" ", mid + 1, hi)
    while at > 0 and text[at - 1].isspace():
        at = text.find(" ", at + 1, hi)
    return at if at > 0 else hi


def _same(a: np.ndarray, *parts: np.ndarray) -> bool:
    return len(a) == sum(map(len, parts)) and bool((a == np.concatenate(parts)).all())


Encode = Callable[[str], np.ndarray]


def _joined(text: str, left: np.ndarray, right: np.ndarray, lo: int, mid: int, hi: int, encode: Encode, split: regex.Pattern) -> np.ndarray:
    """The tokens of text[lo:hi] from those of its two parts."""
    begin, end = _before(text, lo, mid), _after(text, mid, hi)
    while begin > lo or end < hi:
        outer, last = _before(text, lo, begin), _after(text, end, hi)
        before, tail, middle, head, behind = (encode(text[i:j]) for i, j in ((outer, begin), (begin, mid), (begin, end), (mid, end), (end, last)))
        ends = {outer + m.end() for m in split.finditer(text[outer:last])} | {lo, hi}
        own = len(before) + len(tail)
        if (
            begin in ends
            and end in ends
            and _same(encode(text[outer:last]), before, middle, behind)
            and _same(left[len(left) - own :], before, tail)
            and _same(right[: len(head) + len(behind)], head, behind)
        ):
            return np.concatenate((left[: len(left) - len(tail)], middle, right[len(head) :]))
        begin, end = outer, last
    return encode(text[lo:hi])


def encode_tree(text: str, encode: Encode, split: regex.Pattern, leaf: int = LEAF, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The token ids of text[lo:hi], by halves."""
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return encode(text[lo:hi])
    mid = (lo + hi) // 2
    return _joined(text, encode_tree(text, encode, split, leaf, lo, mid), encode_tree(text, encode, split, leaf, mid, hi), lo, mid, hi, encode, split)


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    """The compiled pattern, if matches depend on nothing that precedes them."""
    bare = regex.sub(r"\\\\|\[\^", "", pattern)
    if regex.search(r"\(\?<[=!]|\\[bBAzZGmM]|[\^$]", bare):
        raise ValueError(f"the pattern {pattern!r} looks behind or at the ends of lines or texts")
    return regex.compile(pattern)


def decode_tree(ids: np.ndarray, decode: Callable[[list[int]], bytes], leaf: int = LEAF) -> bytes:
    """The bytes of the ids, concatenated up a tree."""
    parts = [decode(ids[i : i + leaf].tolist()) for i in range(0, len(ids), leaf)]
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


def _coder(ranks, pattern: str, columns: tuple[str, ...], text_at: int | None, ids_at: int | None):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = _encoding(ranks.value, pattern), splitter(pattern)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for value in batch.column(text_at if ids_at is None else ids_at):
                if ids_at is None:
                    ids = encode_tree(value.as_py() or "", coder.encode_to_numpy, split).astype("<u4", copy=False)
                else:
                    ids = np.asarray(value.as_py() or [], "<u4")
                decoded = decode_tree(ids, coder.decode_bytes) if {"decoded", "decoded_sha256"} & {*columns} else b""
                for c in columns:
                    if c == "n_tokens":
                        out[c].append(len(ids))
                    elif c == "ids":
                        out[c].append(ids.astype(np.int32))
                    elif c == "decoded":
                        out[c].append(decoded)
                    else:
                        out[c].append(hashlib.sha256(ids.tobytes() if c == "ids_sha256" else decoded).hexdigest())
            keep = [i for i in range(batch.num_columns) if i not in (text_at, ids_at)]
            names = [batch.schema.names[i] for i in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(out[c], _ARROW[c]) for c in columns)], [*names, *columns])

    return run


def _apply(df: DataFrame, vocabulary: Vocabulary, columns: tuple[str, ...], text: str | None, ids: str | None) -> DataFrame:
    splitter(vocabulary.pattern)
    ranks = df.sparkSession.sparkContext.broadcast(vocabulary.read())
    taken = text or ids
    df = df.drop(*(c for c in columns if c != taken))
    at = df.columns.index(taken)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != taken)
    schema = ", ".join(filter(None, [kept, *(f"{c} {KINDS[c]}" for c in columns)]))
    return df.mapInArrow(_coder(ranks, vocabulary.pattern, columns, at if text else None, at if ids else None), schema)


def bpe_encode(docs: DataFrame, vocabulary: Vocabulary, columns: tuple[str, ...] = ("n_tokens", "ids"), text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``columns`` of KINDS: token ids, their number, the bytes decoded from them, digests.

    A null or empty text has no tokens. Control strings in texts are ordinary text. Columns of the same names as
    the new ones give way to them; others, repeated rows and nulls pass through. An empty table gives an empty one.
    """
    return _apply(docs.withColumn(text_col, F.col(text_col).cast("string")), vocabulary, columns, text_col, None)


def bpe_decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the ids replaced by ``decoded``, the bytes of the text. Null ids decode to no bytes; an unknown id fails."""
    return _apply(encoded, vocabulary, ("decoded",), None, ids_col)
