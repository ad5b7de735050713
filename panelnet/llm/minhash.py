"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and grouping.

Steps: sketch every whole text; fold texts of equal shingle sets into one representative; join
representatives that share a band where their signatures come near the threshold; the components are families;
within a family compare full shingle sets; the components of the confirmed links are the groups. No candidate is dropped, and a pair
that confirmed links already join needs no comparison of its own.

Buckets and families of any size are dealt out in bounded blocks, so that no task holds a whole one. A first round compares each
block within itself and with the key's first block, in proportion to the rows. Only keys of more than two blocks have a second: rows are labelled
with the components found so far, and those outside a key's largest component are compared with all its blocks. So a dense group costs
its rows, not their square; what remains quadratic is the part of a bucket that truly falls apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.components import components, shared_ids
from panelnet.llm.storage import saved
from panelnet.llm.textkernel import GOLDEN, U, distinct, mix, releasing, shingles, slices, step, word_hashes, words

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary"


@dataclass(frozen=True)
class Near:
    """percent: least similarity of linked sets, in hundredths; words: of a shingle; bands x rows: slots of a signature.

    With 25 bands of 5 rows two sets of similarity 0.85 share no band with probability 4e-7. margin: how far
    below the threshold a signature's estimate may lie for the sets still to be compared (5 standard errors).
    """

    percent: int = 85
    words: int = 5
    bands: int = 25
    rows: int = 5
    margin: float = 0.16
    block_rows: int = 512
    block_shingles: int = 400_000
    slot_rows: int = 8192

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    def may_link(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)


def superminhash(x: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(texts, m) signatures of the sets x[first[t]:first[t + 1]]; an empty set's are all ones.

    Every element visits the m slots in a random order of its own, its j-th visit offering j + r with r in
    [0, 1), and each slot keeps its least offer: ranks within one permutation are correlated, which
    lowers the variance against independent hashes. A set stops as soon as no later visit could win.
    Offers are kept as 64-bit numbers: j in the upper half, r in the lower.
    """
    count = np.diff(first)
    n = len(count)
    best = np.full(n * m, ~U(0), U)
    owner = np.repeat(np.arange(n), count)
    low = U(0xFFFFFFFF)
    order = None
    for j in range(m):
        h = mix(x + step(j + 1))
        k = j + ((h & low) * U(m - j) >> U(32)).astype(np.int64)
        if order is None:
            slot = k
        else:
            at = np.arange(len(x))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(best, owner * m + slot, (U(j) << U(32)) | (h >> U(32)))
        worst = best.reshape(n, m).max(axis=1) >> U(32)
        going = (worst > j)[owner]
        if not going.any():
            break
        if order is None:
            x, owner, k = x[going], owner[going], k[going]
            order = np.tile(np.arange(m, dtype=np.uint16 if m > 255 else np.uint8), (len(x), 1))
            order[np.arange(len(x)), k] = 0
        elif going.mean() < 0.8:
            x, owner, order = x[going], owner[going], order[going]
    return best.reshape(n, m)


def _set_sums(x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit numbers that tell sets apart."""
    sums = [np.concatenate(([U(0)], np.cumsum(mix(x * U(s)), dtype=U))) for s in (3, 5)]
    return [s[first[1:]] - s[first[:-1]] for s in sums]


def _sketcher(near: Near):
    @releasing
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                w = words(data, offs)
                x, first = distinct(*shingles(word_hashes(data, w, fold=True), w, near.words))
                n = np.diff(first)
                sums = _set_sums(x, first)
                signed = np.flatnonzero(n * (100 - near.percent) >= near.percent)  # a smaller set links only with its equals
                part = np.concatenate([x[first[t] : first[t + 1]] for t in signed]) if len(signed) else x[:0]
                sig = superminhash(part, np.concatenate(([0], np.cumsum(n[signed]))), near.slots)
                band = np.zeros((len(signed), near.bands), U)
                for r in range(near.rows):
                    band = mix(band * GOLDEN + mix(sig[:, r :: near.rows] + U(1)))
                band = mix(band + np.arange(near.bands, dtype=U) * GOLDEN)
                byte = (mix(sig) & U(255)).astype(np.uint8)
                has = np.zeros(len(n), bool)
                has[signed] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n.astype(np.int64)),
                        *(pa.array(s.view(np.int64)) for s in sums),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * near.bands))).astype(np.int32)), pa.array(band.ravel().view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(has * near.slots))).astype(np.int32).tobytes()), pa.py_buffer(byte.tobytes())]),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig"],
                )

    return sketch


def _setter(near: Near):
    @releasing
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's shingle set, where it is the one that the row's signature belongs to: a repeated id brings other texts along."""
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                w = words(data, offs)
                x, first = distinct(*shingles(word_hashes(data, w, fold=True), w, near.words))
                own = np.flatnonzero(_set_sums(x, first)[0].view(np.int64) == batch.column(2).slice(lo, hi - lo).to_numpy())
                kept = np.concatenate([np.arange(first[t], first[t + 1]) for t in own]) if len(own) else np.zeros(0, int)
                size = np.concatenate(([0], np.cumsum(np.diff(first)[own])))
                part = batch.slice(lo, hi - lo).take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[3:], pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((size * 8).astype(np.int32).tobytes()), pa.py_buffer(x[kept].tobytes())])],
                    ["id", *batch.schema.names[3:], "shingles"],
                )

    return sets


def _binary(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, width)


Confirm = Callable[[int, int], bool]


def _joined(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray | None, label: np.ndarray, near: Near, confirm: Confirm | None) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest: pairs of left and right, or within left, whose signatures come near the threshold: the likeliest
    first where a link must be confirmed, else in order, so that the many buckets of one group agree on its links.

    A pair that ``label`` shows as joined already is passed over; ``label`` is kept up to date.
    """
    least = (near.percent / 100 - near.margin) * near.slots
    for at, i in enumerate(left.tolist()):
        other = left[at + 1 :] if right is None else right
        other = other[label[other] != label[i]]
        if not len(other):
            continue
        same = (sig[other] == sig[i]).sum(axis=1)
        ok = (same >= least) & near.may_link(n[other], n[i])
        near_ones = other[ok] if confirm is None else other[ok][np.argsort(-same[ok], kind="stable")]
        for j in near_ones.tolist():
            if label[j] != label[i] and (confirm is None or confirm(i, j)):
                label[label == label[j]] = label[i]
                yield i, j


def _cell(near: Near, exact: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The rows of one pair of blocks of a large key, or of many small keys."""
        lo, hi = key[-2].as_py(), key[-1].as_py()
        table = table.sort_by("id")  # so that the cells of a group's many buckets find the same links, which fold into one
        ids, n, block = (table[c].to_numpy() for c in ("id", "n_shingles", "block"))
        label = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        sig, confirm = _binary(table["sig"], near.slots), None
        if exact:
            sets = [np.frombuffer(x.as_py(), U) for x in table["shingles"]]

            def confirm(i: int, j: int) -> bool:
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                return 100 * shared >= near.percent * (len(both) - shared)

        found: list[tuple[int, int]] = []
        if lo != hi:
            found += _joined(sig, n, np.flatnonzero(block == lo), np.flatnonzero(block != lo), label, near, confirm)
        else:
            of = table["key"].to_numpy()
            order = np.argsort(of, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                if len(part) > 1:
                    found += _joined(sig, n, part, None, label, near, confirm)
        a, b = np.array(found, int).reshape(-1, 2).T
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return run


CELL = ["slot", "lo", "hi"]


def _forest(keys: DataFrame, rows_of: Callable[[DataFrame], DataFrame], near: Near, exact: bool, slots: int) -> DataFrame:
    """(a, b): links that join all rows (key, id, n_blocks, n_shingles, sig, ...) that share a key and may or do link.

    ``rows_of`` gives the rows of some of ``keys`` (key, n_blocks): the second round is decided by the keys and reads the rows of large ones only.
    Small keys are dealt to ``slots`` cells, many in each; keys of several blocks have cells of their own, as the head of this module says.
    """
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    cells = lambda df, pairs: df.withColumn("cell", F.explode(pairs)).select(*(c for c in df.columns if c != "n_blocks"), "cell.lo", "cell.hi")
    pair = lambda lo, hi: F.struct(F.least(lo, hi).cast("int").alias("lo"), F.greatest(lo, hi).cast("int").alias("hi"))
    own = F.when(F.col("n_blocks") > 1, F.concat(F.lit("k"), F.col("key"))).otherwise(F.concat(F.lit("s"), F.pmod("key", F.lit(slots))))
    dealt = lambda some: rows_of(some).withColumns({"slot": own, "block": spread(F.col("n_blocks"), 7), "label": F.col("id")})
    zero = F.lit(0)
    within = F.array(pair(F.col("block"), F.col("block")))
    first = F.when(F.col("n_blocks") == 1, F.array(pair(zero, zero))).when(F.col("block") > 0, F.concat(within, F.array(pair(zero, F.col("block")))))
    first = first.otherwise(F.transform(F.sequence(zero, F.col("n_blocks").cast("int") - 1), lambda b: pair(zero, b)))
    links = saved(cells(dealt(keys), first).groupBy(*CELL).applyInArrow(_cell(near, exact), "a long, b long"))

    large = keys.filter("n_blocks > 2")
    if large.isEmpty():
        return links
    large = dealt(large)
    done = saved(components(links).select(F.col("node").alias("id"), "component"))
    large = large.drop("label").join(done, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    parts = large.groupBy("key", "label", "n_blocks").agg(F.count("*").alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.first("n_blocks").alias("blocks")).filter("all > top.n")
    blocks = lambda n: F.ceil(n * F.col("blocks") / F.col("all"))
    parts = parts.select("key", F.col("top.label").alias("main"), blocks(F.col("top.n")).alias("m"), blocks(F.col("all") - F.col("top.n")).alias("r"))
    rest = large.join(parts, "key").withColumn("is_main", F.col("label") == F.col("main"))
    rest = rest.withColumn("block", F.when(F.col("is_main"), spread(F.col("m"), 9)).otherwise(-1 - spread(F.col("r"), 9)))
    side = F.col("block")
    others = F.transform(F.sequence(F.lit(1), F.col("r").cast("int")), lambda x: pair(-x, side))
    mains = F.transform(F.sequence(zero, F.col("m").cast("int") - 1), lambda x: pair(x, side))
    rest = rest.withColumn("pairs", F.when(F.col("is_main"), others).otherwise(F.concat(mains, others))).drop("main", "m", "r", "is_main")
    more = cells(rest, F.col("pairs")).drop("pairs").groupBy(*CELL).applyInArrow(_cell(near, exact), "a long, b long")
    return done.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)  # what is joined already, as stars


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are lower-cased (A-Z); sets with 100 x intersection >= percent x union are linked, which full sets
    confirm. component_id is the smallest id that links reach, itself included. A text that is null, empty or
    without words has an empty set and links with nothing; one of fewer words than a shingle has its whole
    sequence as its only element. Rows that repeat an id are that document: what any of its texts links to belongs to one component, and all its rows
    have the same component_id and kept; n_shingles is the row's own. A null id links with nothing
    and is kept. Other columns are ignored; an empty table gives an empty one. A text is held whole in
    memory, so its length is bounded by a worker's memory only.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = saved(texts.mapInArrow(_sketcher(near), SKETCH))
    some = sketch.filter("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    classes = saved(some.groupBy(*key).agg(F.min("doc_id").alias("id")))
    repeated = not some.groupBy("doc_id").count().filter("count > 1").isEmpty()
    same = saved(shared_ids(some.select("doc_id", *key).join(classes, key), "doc_id", "id")) if repeated else None
    single = some.filter(F.size("bands") > 0).join(classes.select(F.col("id").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    if repeated:
        single = single.dropDuplicates(["doc_id", "set_a", "set_b"])
    single = saved(single.select(F.col("doc_id").alias("id"), "set_a", "n_shingles", "bands", "sig"))

    member = single.select("id", "set_a", F.explode("bands").alias("key"))
    shared = saved(member.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    rows = shared.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = shared.select("key", F.ceil(F.col("size") / near.block_rows).alias("n_blocks"))
    members = lambda keys: member.join(keys, "key").join(single.drop("bands"), ["id", "set_a"]).drop("set_a")
    family = saved(components(_forest(buckets, members, near, False, 1 + rows // near.slot_rows)).select(F.col("node").alias("id"), F.col("component").alias("key")))

    signed = saved(family.join(single.drop("bands"), "id"))
    load = signed.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / near.block_rows), F.ceil(F.sum("n_shingles") / near.block_shingles)).alias("n_blocks"))
    shingles_in_all = signed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]

    def sets(keys: DataFrame) -> DataFrame:
        whole = texts.join(signed.join(keys, "key").withColumnRenamed("id", "doc_id").hint("merge"), "doc_id").select("doc_id", "text", "set_a", "key", "n_blocks", "n_shingles", "sig")
        if repeated:
            whole = whole.dropDuplicates(["doc_id", "set_a", "text"])
        return whole.mapInArrow(_setter(near), "id long, key long, n_blocks long, n_shingles long, sig binary, shingles binary")

    links = _forest(saved(load), sets, near, True, 1 + shingles_in_all // near.block_shingles)
    group = components(links if same is None else links.unionByName(same)).select(F.col("node").alias("id"), "component")

    classes = classes.join(group, "id", "left").select(*key, F.coalesce("component", "id").alias("found"))
    out = sketch.select("doc_id", *key).join(classes, key, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    if repeated:  # a row without words goes with the others of its id
        own = out.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
