"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector o, rotated at random, is coded by the signs of its coordinates; with the code's unit vector s the correction factor
<o, s> is stored beside the code. For another unit vector q, <q, s> / <o, s> estimates <q, o> without bias; where <q, o> reaches
``least`` it errs by no more than sqrt(1 - least^2) sqrt(1 - <o, s>^2) / <o, s> * spread / sqrt(D - 1) but for a small probability. The
other side of an estimate is q itself in four bits a coordinate, rounded at random, so that the estimate stays unbiased.

Stretches of the code are the bands that bring candidates together. Only codes, factors and four-bit coordinates go to the buckets; the
pairs whose estimate's upper bound reaches the threshold leave the ids of their rows, and only those rows' vectors are fetched and
computed exactly in double precision.

Equal vectors of a label are one class from the start. Small buckets share a task; one of any size is dealt out in pairs of bounded blocks. A pair is
computed in the first band that it shares, so links are counted where they are found: a cell returns a count for each class and a
spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelnet.llm.components import components, shared_ids
from panelnet.llm.storage import saved
from panelnet.llm.textkernel import GOLDEN, U, mix, step

#: Buckets of more than one block are few: up to this number their sizes are broadcast, beyond it they are joined.
MOST_SENT = 200_000
CODED = "id long, h long, copies long, label long, vector binary, code binary"


@dataclass(frozen=True)
class Close:
    """least: cosine of a link; missed: probability that a pair at the threshold shares no band; bucket: rows of a label for each bucket, about."""

    least: float = 0.98
    missed: float = 1e-5
    bucket: int = 512
    spread: float = 5.0
    block_rows: int = 512
    slot_rows: int = 4096
    seed: int = 5

    def band(self, rows: int) -> tuple[int, int]:
        """Bits of a band and number of bands for labels of up to ``rows`` vectors."""
        bits = min(24, max(3, math.ceil(math.log2(max(rows, 1) / self.bucket + 1))))
        same = (1 - math.acos(self.least) / math.pi) ** bits
        return bits, math.ceil(math.log(self.missed) / math.log(1 - same))


@lru_cache(maxsize=64)
def rotation(size: int, which: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, which, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Coder:
    """Codes of vectors of one dimension: signs after as many rotations as the bands need, the first one's correction factor, four-bit coordinates."""

    size: int
    bits: int
    bands: int
    seed: int

    @property
    def turns(self) -> int:
        return max(1, math.ceil(self.bits * self.bands / self.size))

    @property
    def sign_bytes(self) -> int:
        return math.ceil(self.turns * self.size / 8)

    def encode(self, unit: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(vectors, bytes): packed signs, factor, lowest coordinate and step as float32, packed coordinates."""
        turned = np.concatenate([unit @ rotation(self.size, i, self.seed).T for i in range(self.turns)], axis=1)
        first = turned[:, : self.size]
        factor = np.abs(first).sum(axis=1) / math.sqrt(self.size)
        low = first.min(axis=1)
        width = np.maximum((first.max(axis=1) - low) / 15, 1e-12)
        dither = (mix(h.view(U)[:, None] + GOLDEN * np.arange(1, self.size + 1, dtype=U)) >> U(11)) / float(1 << 53)
        q = np.clip(np.floor((first - low[:, None]) / width[:, None] + dither), 0, 15).astype(np.uint8)
        q = np.concatenate((q, np.zeros((len(q), self.size % 2), np.uint8)), axis=1)
        numbers = np.stack((factor, low, width), 1).astype("<f4").view(np.uint8).reshape(len(unit), 12)
        return np.concatenate((np.packbits(turned >= 0, axis=1), numbers, q[:, ::2] << 4 | q[:, 1::2]), axis=1)

    def keys(self, code: np.ndarray) -> np.ndarray:
        """(vectors, bands): the signs of each band as a number."""
        signs = np.unpackbits(code[:, : self.sign_bytes], axis=1)[:, : self.bits * self.bands]
        return (signs.reshape(len(code), self.bands, self.bits) * (1 << np.arange(self.bits))).sum(axis=2)

    def parts(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of the codes, correction factors, the coordinates that four bits give, and their steps."""
        sign = np.where(np.unpackbits(code[:, : self.sign_bytes], axis=1)[:, : self.size], 1.0, -1.0) / math.sqrt(self.size)
        at = self.sign_bytes + 12
        factor, low, width = np.ascontiguousarray(code[:, self.sign_bytes : at]).view("<f4").astype(float).T
        packed = code[:, at:]
        q = np.stack((packed >> 4, packed & 15), 2).reshape(len(code), -1)[:, : self.size]
        return sign, factor, low[:, None] + q * width[:, None], width


def _coding(bits: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy().astype(np.float64)
            first = np.concatenate(([0], np.cumsum(sizes)))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = flat[first[own][:, None] + np.arange(size)]
                x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components would not be finite or zero
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                part = batch.take(pa.array(own))
                code = Coder(int(size), bits, bands, seed).encode(unit, part.column("h").to_numpy())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h", "copies", "label")), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (unit, code))], ["id", "h", "copies", "label", "vector", "code"])

    return run


def _stacked(column: pa.Array | pa.ChunkedArray, kind: type = np.uint8) -> np.ndarray:
    return np.stack([np.frombuffer(b.as_py(), kind) for b in column])


def _exploder(bits: int, bands: int, seed: int, payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector and band: the bucket is a hash of label, dimension, band and the band's signs."""
        for batch in batches:
            size = pa.compute.binary_length(batch.column("vector")).to_numpy() // 8 if batch.num_rows else np.zeros(0, int)
            for d in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                for lo in range(0, part.num_rows, 1024):
                    some = part.slice(lo, 1024)
                    keys = Coder(int(d), bits, bands, seed).keys(_stacked(some.column("code"))).astype(U)
                    h = mix(mix(some.column("label").to_numpy().view(U) + step(3)) + U(d))
                    bucket = mix(h[:, None] + mix(keys + step(1) * np.arange(1, bands + 1, dtype=U)))
                    rows = pa.array(np.repeat(np.arange(len(keys)), bands))
                    more = {"band": np.tile(np.arange(bands, dtype=np.int32), len(keys)), "dim": np.full(len(rows), d, np.int32)} | {c: some.column(c).take(rows) for c in ("id", "h", "code")} if payload else {}
                    yield pa.RecordBatch.from_pydict({"bucket": bucket.ravel().view(np.int64)} | more)

    return run


def _cell_pairs(table: pa.Table, lo: int, hi: int, close: Close, bits: int, bands: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell whose estimate's upper bound reaches the threshold, each in the first band that it shares."""
    bucket, block, band, dim = (table[c].to_numpy() for c in ("bucket", "block", "band", "dim"))
    order = np.argsort(bucket, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(rows) < 2:
            continue
        coder = Coder(int(dim[rows[0]]), bits, bands, close.seed)
        code = _stacked(table["code"].take(pa.array(rows)))
        sign, factor, q, width = coder.parts(code)
        root = math.sqrt(max(coder.size - 1, 1))
        reach = math.sqrt(1 - close.least**2) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor * min(1.0, close.spread / root)
        left, right = (np.flatnonzero(block[rows] == lo), np.flatnonzero(block[rows] != lo)) if lo != hi else (np.arange(len(rows)), np.arange(len(rows)))
        keys = coder.keys(code)[:, : band[rows[0]]]
        for at in range(0, len(left), 128):
            some = left[at : at + 128]
            rounding = close.spread * width[some] / math.sqrt(6)  # of the four-bit side, over a code's unit vector
            bound = (q[some] @ sign[right].T + rounding[:, None]) / factor[right] + reach[right]
            i, j = np.nonzero(bound >= close.least)
            i, j = some[i], right[j]
            ok = (i < j) if lo == hi else np.ones(len(i), bool)
            ok[ok] &= ~(keys[i[ok]] == keys[j[ok]]).any(axis=1)
            yield rows[i[ok]], rows[j[ok]]


def _candidates(close: Close, bits: int, bands: int):
    def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [np.unique(np.concatenate(p)) for p in _cell_pairs(table, key[-2].as_py(), key[-1].as_py(), close, bits, bands)]
        rows = pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))
        return table.select(["slot", "lo", "hi", "block", "bucket", "band", "dim", "id", "h"]).take(rows)

    return cell


def _compare(close: Close, bits: int, bands: int):
    def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, h, copies = (table[c].to_numpy() for c in ("id", "h", "copies"))
        links, label, a, b = np.zeros(len(ids), np.int64), np.arange(len(ids)), [], []
        vectors = [np.frombuffer(v.as_py()) for v in table["vector"]]
        for i, j in _cell_pairs(table, key[-2].as_py(), key[-1].as_py(), close, bits, bands):
            if len(i):
                near = np.einsum("ij,ij->i", np.stack([vectors[x] for x in i]), np.stack([vectors[x] for x in j])) >= close.least
                i, j = i[near], j[near]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for u, v in zip(i.tolist(), j.tolist(), strict=True):
                    if label[u] != label[v]:
                        label[label == label[v]] = label[u]
                        a.append(u)
                        b.append(v)
        some = np.flatnonzero(links)
        first = np.concatenate((some, np.array(a, int)))
        return pa.table({
            "a": pa.array(ids[first], pa.int64()),
            "h": pa.array(h[first], pa.int64()),
            "b": pa.array([None] * len(some) + ids[np.array(b, int)].tolist(), pa.int64()),
            "links": pa.array(np.concatenate((links[some], np.zeros(len(a), np.int64))), pa.int64()),
        })

    return cell


CELL = ["slot", "lo", "hi"]


def _cells(member: DataFrame, large: DataFrame, n_slots: int) -> DataFrame:
    """Rows of small buckets once, many buckets to a slot; those of a large one once for every pair of their block and another."""
    member = member.join(large, "bucket", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    slot = F.when(F.col("n_blocks") > 1, F.concat(F.lit("k"), F.col("bucket"))).otherwise(F.concat(F.lit("s"), F.pmod("bucket", F.lit(n_slots))))
    member = member.withColumns({"slot": slot, "block": F.pmod(F.xxhash64("id", "h"), "n_blocks").cast("int")})
    other = F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")))
    return member.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "n_blocks")


def near_vectors(vectors: DataFrame, close: Close = Close(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: vectors of equal label are linked if their cosine is at least ``least``.

    n_links: other vectors linked directly; component_id: the smallest id that links reach, itself included. A vector that is null, empty,
    zero or holds null or non-finite components, or whose label or id is null, links with nothing and is kept, as are vectors of different
    dimensions among each other. Rows that repeat an id are vectors of their own, each with its own links, that share a component; other columns are ignored;
    an empty table gives an empty one.
    """
    kind = vectors.schema[vector_col].dataType
    v = F.col(vector_col) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.hash("v"), "n": F.size("v")})
    key = ["label", "h", "g", "n"]
    classes = saved(rows.filter("fine").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, bands = close.band(most)
    coded = saved(classes.select("id", "h", "copies", "label", "v").mapInArrow(_coding(bits, bands, close.seed), CODED))

    buckets = coded.mapInArrow(_exploder(bits, bands, close.seed, False), "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
    large = saved(buckets.filter(F.col("n") > close.block_rows).select("bucket", F.ceil(F.col("n") / close.block_rows).alias("n_blocks")))
    large = F.broadcast(large) if large.count() <= MOST_SENT else large
    slots = 1 + coded.count() * bands // close.slot_rows
    member = coded.mapInArrow(_exploder(bits, bands, close.seed, True), "bucket long, band int, dim int, id long, h long, code binary")
    near = _cells(member, large, slots).groupBy(*CELL).applyInArrow(_candidates(close, bits, bands), "slot string, lo int, hi int, block int, bucket long, band int, dim int, id long, h long")
    near = near.join(coded.select("id", "h", "copies", "vector", "code"), ["id", "h"])
    found = saved(near.groupBy(*CELL).applyInArrow(_compare(close, bits, bands), "a long, h long, b long, links long"))

    links = found.filter("b is null").groupBy(F.col("a").alias("id"), "h").agg(F.sum("links").alias("links"))
    members = rows.filter("fine").select("vec_id", *key)
    forest = found.filter("b is not null").select("a", "b")
    if not members.groupBy("vec_id").count().filter("count > 1").isEmpty():
        forest = forest.unionByName(saved(shared_ids(members.join(classes.drop("v"), key), "vec_id", "id")))
    group = components(forest).select(F.col("node").alias("id"), "component")
    classes = classes.drop("v").join(links, ["id", "h"], "left").join(group, "id", "left")
    classes = classes.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("found"))
    fit = members.join(classes, key).select("vec_id", "n_links", F.col("found").alias("component_id"))
    out = fit.unionByName(rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
