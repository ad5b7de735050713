"""Scoring texts with a smoothed bigram model whose counts lie, quantised, in a log-frequency Bloom filter.

Words and bigrams of all training texts are counted, whatever their count. A count c has the level 1 + log(c) / log(base), rounded up or down at random by the
n-gram's hash, so that what is read back is c on average; the filter holds an entry for each level up to it, and repeated membership probes find the
level again. With p1(w) = (c(w) + a) / (N + a (V + 1)) and q(h, w) as read from the filter

    p(w | h) = (q(h, w) + m p1(w)) / (c(h) + m + F),    F = V * 2^-probes

F being the false counts that a head's V words are expected to read, so that the probabilities of a head sum to one on average; m is at least F. A text's first
word has p1. The logarithm is a sum of log p1(w), which is exact and what base_score adds up too, of log (m / (c(h) + m + F)), and for a
bigram that is read of log (1 + q(h, w) / (m p1(w))).

The filter grows with the corpus and is cut into stretches by hash, each as long as its entries need. Texts are read a fixed number of times, however many
stretches there are: what a slice of texts asks of a stretch goes to the stretch's task, with what training adds to it, and the task fills the stretch, reads it and
gives back sums for each text. Nothing is left out of the filter to make it smaller. A word too rare for the broadcast table of exact counts shares a
stretch with the bigrams that it ends, which need its count. Bigrams of two of the most frequent words, which would crowd a stretch, have a small stretch of their
own, whose gains are broadcast. Exact counts of rare words in the other terms are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelnet.llm.storage import saved
from panelnet.llm.textkernel import PLACE, U, mix, release, releasing, slices, step, word_hashes, words

END = int(mix(np.array([97], U))[0])
FLUSH = 1 << 22
SCORE_BYTES = 2 << 20
HELD_TEXTS = 1 << 23
#: Among so many words bigrams are counted apart.
HOT_WORDS = 256
#: Most bits that an entry of 63 levels takes in a filter.
ENTRY_BITS = 768
#: Bits of an n-gram's hash that go to its stretch, which some of the others name.
SHORT = U((1 << 48) - 1)
LOW = U(0xFFFFFFFF)


@dataclass(frozen=True)
class Model:
    """round_bytes, exact_words: bounds of what is broadcast: of the stretch of frequent bigrams and of the exact table; part_tokens: training tokens for each stretch of the filter, about; base: ratio of
    neighbouring levels; probes, more_probes: bits of an entry of the first level and of a further one."""

    round_bytes: int = 96 << 20
    exact_words: int = 1 << 18
    part_tokens: int = 1 << 21
    base: float = 2.0
    probes: int = 16
    more_probes: int = 8
    a: float = 0.1
    m: float = 4.0

    def value(self, level: np.ndarray) -> np.ndarray:
        return np.where(level > 0, np.rint(self.base ** (level - 1.0)), 0.0)

    def level(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The level below or above each count, by the n-gram's hash, such that the value is the count on average."""
        low = np.floor(np.log(count) / math.log(self.base) + 1e-9).astype(np.int64) + 1
        below, above = self.value(low), self.value(low + 1)
        chance = np.where(above > below, (count - below) / np.maximum(above - below, 1e-9), 0.0)
        return low + ((mix(key ^ step(77)) >> U(11)) / float(1 << 53) < chance)


def _salted(key: np.ndarray, kind: int) -> np.ndarray:
    return mix(key ^ step(1000 + kind))


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's word hashes followed by the end's, and the texts' first places."""
    w = words(data, offs)
    first = w.first + np.arange(len(w.first))
    out = np.empty(first[-1], U)
    out[first[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = word_hashes(data, w, fold=True)
    return out, first


def _pairs(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens that follow another in their text, and the bigrams' hashes."""
    follows = np.ones(len(t), bool)
    follows[first[:-1]] = False
    at = np.flatnonzero(follows)
    return at, mix(t[at - 1] * PLACE[0] + t[at] * PLACE[1])


def _combined(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def _batch(key: np.ndarray, count: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": key.view(np.int64), "count": count} | more)


@releasing
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0
    for batch in batches:
        for _, _, data, offs in slices(batch.column(0)):
            key, count = np.unique(_tokens(data, offs)[0], return_counts=True)
            keys.append(key)
            counts.append(count)
            held += len(key)
            if held > FLUSH:
                yield _batch(*_combined(keys, counts))
                keys, counts, held = [], [], 0
    if keys:
        yield _batch(*_combined(keys, counts))


def _find(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, at, -1)


def _home(word: np.ndarray, pair: np.ndarray, exact: np.ndarray, parts: int) -> np.ndarray:
    """The stretch of each bigram: by the word that ends it, or, if that is in the exact table, by the bigram itself, so that no frequent word fills one."""
    by = np.where(_find(exact, word) >= 0, pair, _salted(word, 3))
    return ((by >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _hot(exact: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """For each word of the exact table, and last for none, its number among the ``most`` most frequent ones, or -1."""
    number = np.full(len(exact[0]) + 1, -1, np.int32)
    top = np.lexsort((exact[0], -exact[1]))[:most]
    number[top] = np.arange(len(top))
    return number


def _hot_pairs(t: np.ndarray, at: np.ndarray, exact: tuple[np.ndarray, ...], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the bigrams that end at ``at`` have two frequent words, and those bigrams' numbers."""
    word, where = np.unique(t, return_inverse=True)
    own = hot[_find(exact[0], word)][where]
    both = (own[at] >= 0) & (own[at - 1] >= 0)
    return both, own[at[both] - 1] * (int(hot.max(initial=0)) + 1) + own[at[both]]


def _count_hot(exact, hot):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((int(hot.value.max(initial=0)) + 1) ** 2, np.int64)
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                t, first = _tokens(data, offs)
                _, code = _hot_pairs(t, _pairs(t, first)[0], exact.value, hot.value)
                total += np.bincount(code, minlength=len(total))
        seen = np.flatnonzero(total)
        yield _batch(seen.astype(U), total[seen])

    return run


ASKED = "part int, chunk long, texts int, names binary, keys binary, low binary, high binary, hop binary, hops binary, words binary, counts binary"


def _short(key: np.ndarray) -> np.ndarray:
    """The 48 low bits of each key, as three numbers of 16 bits."""
    return np.ascontiguousarray(key.astype("<u8").view("<u2").reshape(-1, 4)[:, :3])


def _long(*packed: np.ndarray) -> np.ndarray:
    out, at = np.zeros((sum(map(len, packed)) // 3, 4), "<u2"), 0
    for x in packed:
        out[at : at + len(x) // 3, :3] = x.reshape(-1, 3)
        at += len(x) // 3
    return out.view("<u8").ravel()


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and each key's place among them, in 4 bytes a key."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    where = np.empty(len(key), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], where


def _asked(exact, hot, parts: int):
    """For each slice of texts (chunk) and stretch, packed: bigrams in order of the texts, the word that ends each, by its place in the exact table or
    beyond it among the row's ``words``, whether the text is for training, and how many texts further each is; words outside the exact table with their training counts. One row
    of a chunk names its texts."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = exact.value[0]
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(2), SCORE_BYTES):
                name = batch.column(0).slice(lo, hi - lo).to_numpy().view(U)
                learned = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                t, first = _tokens(data, offs)
                owner = np.repeat(np.arange(len(name)), np.diff(first))
                at, pair = _pairs(t, first)
                cold = ~_hot_pairs(t, at, exact.value, hot.value)[0]
                at, pair = at[cold], pair[cold]
                word, where = np.unique(t, return_inverse=True)
                place = _find(table, word)
                seldom = place < 0
                rare, rare_count = word[seldom], np.bincount(where, learned[owner], len(word))[seldom].astype(np.uint32)
                rare_home = _home(rare, rare, table, parts)
                by = np.argsort(rare_home, kind="stable")
                rare, rare_count, rare_home = rare[by], rare_count[by], rare_home[by]
                rare_cut = np.searchsorted(rare_home, np.arange(parts + 1))
                local = np.empty(len(rare), np.int64)
                local[by] = np.arange(len(rare)) - rare_cut[rare_home]
                place[seldom] = len(table) + local
                salted = _salted(word, 3)
                end = where[at]
                home = ((np.where(seldom[end], salted[end], pair) >> U(32)) * U(parts) >> U(32)).astype(np.int32)
                order = np.argsort(home.astype(np.uint16) if parts <= 1 << 16 else home, kind="stable")
                cut = np.searchsorted(home[order], np.arange(parts + 1))
                at, end = at[order], end[order]
                own = owner[at]
                ref = (place[end] << 1 | learned[own]).astype(np.uint32)
                hop = np.diff(own, prepend=0)
                used = np.flatnonzero((np.diff(cut) > 0) | (np.diff(rare_cut) > 0))
                start = cut[used][cut[used] < cut[used + 1]]
                hop[start] = own[start]
                columns = [_short(pair[order]), ref.astype("<u2"), (ref >> 16).astype("<u2"), hop.astype(np.uint8), (hop >> 8).astype("<u2")]
                of_rare = [_short(_salted(rare, 1)), rare_count]
                chunk = mix(np.array([(mix(name + step(5)) * mix(np.arange(1, len(name) + 1, dtype=U))).sum(dtype=U)], U)).view(np.int64)[0]
                for some in np.array_split(used, math.ceil(len(used) / 1024)) if len(used) else []:
                    some = some.tolist()
                    rows = [pa.array([c[of[p] : of[p + 1]].tobytes() for p in some], pa.binary()) for of, some_columns in ((cut, columns), (rare_cut, of_rare)) for c in some_columns]
                    names = pa.array([name.tobytes() if p == used[0] else None for p in some], pa.binary())
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([len(name)] * n, pa.int32()), names, *rows], [c.split()[0] for c in ASKED.split(", ")])

    return run


def _probes(key: np.ndarray, level: int, number: int, width: np.ndarray | int) -> Iterator[np.ndarray]:
    """For each probe of the level's entries the bit among ``width`` bits."""
    h = mix(key + step(level))
    at, stride = h >> U(32), h & LOW | U(1)
    width = np.asarray(width, U)
    for _ in range(number):
        yield (at * width >> U(32)).astype(np.int64)
        at = (at + stride) & LOW


def _bits(gram: np.ndarray, count: np.ndarray, model: Model) -> np.ndarray:
    """The packed bits of a stretch with the counts of distinct n-grams."""
    level = model.level(gram, count)
    entries = len(gram) * model.probes + int((level - 1).sum()) * model.more_probes
    width = max(1 << 10, math.ceil(entries / math.log(2) / 8) * 8)
    bits = np.zeros(width, bool)
    for now in range(1, int(level.max(initial=0)) + 1):
        for place in _probes(gram[level >= now], now, model.probes if now == 1 else model.more_probes, width):
            bits[place] = True
    return np.packbits(bits, bitorder="little")


def _filled(model: Model):
    """A stretch of the filter from the packed counts of all tasks."""

    def part(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        gram, count = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[c]]) for c, kind in (("keys", U), ("counts", np.uint32)))
        gram, count = _combined([gram], [count])
        bits = _bits(gram, count, model)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(bits)], pa.int64()), "n": pa.array([len(gram)], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return part


class Filter:
    """Stretches of bits one after the other; begin[p], width[p]: the bits of stretch p, width 0 if it is not here."""

    def __init__(self, bits: np.ndarray, begin: np.ndarray, width: np.ndarray, model: Model):
        self.bits, self.begin, self.width, self.model = bits, begin, width, model

    def _hit(self, bit: np.ndarray) -> np.ndarray:
        return (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def _has(self, key: np.ndarray, level: int, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The places of the keys that have the level: two probes leave few of the others, which are probed on alone."""
        number = self.model.probes if level == 1 else self.model.more_probes
        alive = np.arange(len(key))
        for place in _probes(key, level, min(2, number), width):
            alive = alive[self._hit((begin + place)[alive])]
        ok = np.ones(len(alive), bool)
        for place in _probes(key[alive], level, number, width[alive]):
            ok &= self._hit(begin[alive] + place)
        return alive[ok]

    def levels(self, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The level read for each n-gram by probing for one after the other, 0 where the first is missing."""
        level = np.zeros(len(key), np.int64)
        going = np.flatnonzero(self.width[part] > 0)
        for now in range(1, 64):
            if not len(going):
                break
            own = part[going]
            going = going[self._has(key[going], now, self.begin[own], self.width[own])]
            level[going] = now
        return level


@releasing
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in b.columns], b.schema.names)


def _sorted_table(values: DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    """The keys, sorted, and the named numbers of a table of bounded size, brought to the driver as packed bytes."""
    columns = [F.col("key"), *(F.col(x).cast("double") for x in names)]
    rows = values.select(*columns).mapInArrow(_pack, ", ".join(f"{x} binary" for x in ("key", *names))).collect()
    key = np.frombuffer(b"".join(r["key"] for r in rows), np.int64).view(U)
    order = np.argsort(key)
    return key[order], *(np.frombuffer(b"".join(r[x] for r in rows))[order] for x in names)


def _least(counts: DataFrame, room: float, weight: Column) -> int:
    """The lowest power of two such that the n-grams of at least that count weigh no more than ``room``; a row for each power reaches the driver."""
    by = counts.groupBy(F.floor(F.log2(F.col("count").cast("double"))).cast("int").alias("p")).agg(F.sum(weight).alias("w")).orderBy(F.desc("p")).collect()
    total, least = 0.0, None
    for r in by:
        total += float(r["w"])
        if total > room:
            break
        least = 1 << r["p"]
    return least if least is not None else 1 << (by[0]["p"] + 1) if by else 1


RARE = "array<struct<key:long,tf:long>>"


def _base(exact, hot, hot_gain):
    """What words in the exact table add to base_score and, as heads, to score, and bigrams of frequent words to score; the others of each text to be joined: base and, for heads, back."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, back = exact.value[:3]
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(2), SCORE_BYTES):
                t, first = _tokens(data, offs)
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                word, where = np.unique(t, return_inverse=True)
                at = _find(keys, word)[where]
                sure = at >= 0
                own, at = owner[sure], at[sure]
                base_sum = np.bincount(own, base[at], len(n))
                back_sum = np.bincount(own, back[at], len(n))
                follows = _pairs(t, first)[0]
                both, code = _hot_pairs(t, follows, exact.value, hot.value)
                back_sum += np.bincount(owner[follows[both]], hot_gain.value[code], len(n))
                of_text, key, tf = _rare(owner[~sure], t[~sure])
                rare_at = np.searchsorted(of_text, np.arange(len(n) + 1)).astype(np.int32)
                asked = pa.ListArray.from_arrays(pa.array(rare_at), pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(tf.astype(np.int64))], ["key", "tf"]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(n.astype(np.int64)), pa.array(np.bincount(own, minlength=len(n)).astype(np.int64)), pa.array(base_sum.astype(np.float64)), pa.array((base_sum + back_sum).astype(np.float64)), asked],
                    ["doc_id", "text_key", "n_tokens", "n_sure", "base_sure", "score_sure", "rare"],
                )

    return run


def _alone(gram: np.ndarray, count: np.ndarray, asked: np.ndarray, model: Model) -> np.ndarray:
    """The values that a stretch filled with the counts gives for the n-grams asked."""
    bits = _bits(gram, count, model)
    return model.value(Filter(bits, np.zeros(1, np.int64), np.array([len(bits) * 8]), model).levels(asked, np.zeros(len(asked), np.int64)))


def _hot_gains(counts: tuple[np.ndarray, np.ndarray], exact: tuple[np.ndarray, ...], hot: np.ndarray, m: float, model: Model) -> np.ndarray:
    """What each bigram of two frequent words adds to a score."""
    n = int(hot.max(initial=0)) + 1
    at = np.full(n, -1)
    at[hot[hot >= 0]] = np.flatnonzero(hot >= 0)
    if at[0] < 0:
        return np.zeros(1)
    word = exact[0][at]
    key = mix(np.repeat(word, n) * PLACE[0] + np.tile(word, n) * PLACE[1])
    code, count = counts
    return np.log10(1 + _alone(key[code.astype(np.int64)], count.astype(np.int64), key, model) / (m * np.tile(10.0 ** exact[1][at], n)))


def _gains(model: Model, m: float, exact, bottom: float):
    """Sums of what bigrams add to the texts' scores, by chunk, over all stretches of a task: rows of a stretch are next to each other."""

    def part(rows: list[pa.RecordBatch], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each bigram's text, by the first one's place of its chunk, and gain."""
        base = exact.value[1]
        whole = lambda c, kind: np.frombuffer(b"".join(x for r in rows for x in r[c].to_pylist()), kind)
        number = lambda c: np.concatenate([pc.binary_length(r[c]).to_numpy() for r in rows]) // 6
        n, n_words = number("keys"), number("words")
        asked = int(n.sum())
        gram, where = _numbered(_long(whole("keys", "<u2"), whole("words", "<u2")))
        learned = (whole("low", "<u2") & 1).astype(bool)
        count = np.bincount(where[:asked][learned], minlength=len(gram))
        count += np.bincount(where[asked:], whole("counts", np.uint32), len(gram)).astype(np.int64)
        del learned
        some = count > 0
        value = _alone(gram[some], count[some], gram, model)
        del gram, count, some
        seen = np.flatnonzero(value[where[:asked]])
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        far = np.cumsum(whole("hop", np.uint8) | whole("hops", "<u2").astype(np.int32) << 8, dtype=np.int64)
        far -= np.concatenate(([0], far))[np.cumsum(n) - n][row]
        far += slot[row]
        far, row = far[seen], row[seen]
        end = (whole("low", "<u2")[seen] | whole("high", "<u2")[seen].astype(np.int64) << 16) >> 1
        sure = end < len(base)
        p1 = np.empty(len(seen))
        p1[sure] = 10.0 ** base[end[sure]]
        own_word = (np.cumsum(n_words) - n_words)[row[~sure]] + end[~sure] - len(base)
        p1[~sure] = (np.maximum(value[where[asked + own_word]], 1) + model.a) / bottom
        return far, np.log10(1 + value[where[seen]] / (m * p1))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            own = batch["part"].to_numpy()
            ends = [*(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if lo < hi:
                    yield int(own[lo]), batch.slice(lo, hi - lo)

    def told(chunk: list[int], name: list[bytes | None], total: list[bytes | None]) -> pa.RecordBatch:
        return pa.record_batch({"chunk": pa.array(chunk, pa.int64()), "names": pa.array(name, pa.binary()), "sums": pa.array(total, pa.binary())})

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[int, int]] = {}
        total, used = np.zeros(0), 0

        def sums() -> Iterator[pa.RecordBatch]:
            held = list(first.items())
            for i in range(0, len(held), 256):
                yield told([c for c, _ in held[i : i + 256]], [None] * len(held[i : i + 256]), [total[a : a + n].tobytes() for _, (a, n) in held[i : i + 256]])

        for _, group in groupby(runs(batches), key=lambda x: x[0]):
            rows, slots = [], []
            for _, r in group:
                named = [(c, x) for c, x in zip(r["chunk"].to_pylist(), r["names"].to_pylist(), strict=True) if x is not None]
                if named:
                    yield told([c for c, _ in named], [x for _, x in named], [None] * len(named))
                for c, n in zip(r["chunk"].to_pylist(), r["texts"].to_pylist(), strict=True):
                    if c not in first:
                        first[c] = used, n
                        used += n
                    slots.append(first[c][0])
                rows.append(r)
            text, gain = part(rows, np.array(slots))
            if used > len(total):
                total = np.concatenate((total, np.zeros(used + used // 4 - len(total))))
            np.add.at(total, text, gain)
            del rows, text, gain
            release()
            if used > HELD_TEXTS:
                yield from sums()
                first, total, used = {}, np.zeros(0), 0
        yield from sums()

    return run


def _of_texts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The texts of a chunk and their sums."""
    name = np.frombuffer(next(x for x in table["names"].to_pylist() if x is not None), np.int64)
    total = np.zeros(len(name))
    for x in table["sums"].to_pylist():
        if x is not None:
            total += np.frombuffer(x)
    return pa.table({"text_key": pa.array(name), "gain": pa.array(total)})


def _rare(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, occurrences) of the distinct pairs, by text."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    return owner[start], key[start], np.diff(np.append(start, len(key)))


def score_texts(docs: DataFrame, training: Column, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row, learning from the rows where ``training`` holds.

    Tokens: words with A-Z lower-cased, then one end. n_known: tokens that training has; train_tokens: its tokens; base_score: the smoothed
    unigram log10 probability by exact counts; score: the bigram model's. A null text is empty: an end alone; a null ``training`` counts as
    false. Without training rows all tokens are unknown and alike. Null ids and rows that repeat one are scored row by row. Other columns are
    ignored; an empty table gives an empty one. The texts are read four times, whatever the size of the filter.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("text_key"), text.alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    train = texts.filter("train").select("text")
    counts = saved(train.mapInArrow(_count_words, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    bottom = total["n"] + model.a * (total["v"] + 1)
    false = total["v"] / 2.0**model.probes
    m = max(model.m, false)

    head = F.when(F.col("key") != int(np.array([END], U).view(np.int64)[0]), F.log10(F.lit(m) / (F.col("count") + (m + false)))).otherwise(0.0)
    values = counts.select("key", "count", F.log10((F.col("count") + model.a) / bottom).alias("base"), head.alias("back"))
    least = _least(counts, model.exact_words, F.lit(1))
    often, seldom = values.filter(F.col("count") >= least), values.filter(F.col("count") < least)
    exact = spark.sparkContext.broadcast(_sorted_table(often, "base", "back"))

    most = min(HOT_WORDS, math.isqrt(model.round_bytes * 8 // ENTRY_BITS))
    hot = spark.sparkContext.broadcast(_hot(exact.value, most))
    pairs = train.mapInArrow(_count_hot(exact, hot), "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
    hot_gain = spark.sparkContext.broadcast(_hot_gains(_sorted_table(pairs, "count"), exact.value, hot.value, m, model))

    parts = max(16, math.ceil(total["n"] / model.part_tokens))
    tasks = min(parts, 4 * spark.sparkContext.defaultParallelism)  # each gives back a sum for every text
    asked = texts.select("text_key", "train", "text").mapInArrow(_asked(exact, hot, parts), ASKED)
    asked = asked.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")
    sums = asked.mapInArrow(_gains(model, m, exact, bottom), "chunk long, names binary, sums binary")
    gains = saved(sums.groupBy("chunk").applyInArrow(_of_texts, "text_key long, gain double").groupBy("text_key").agg(F.sum("gain").alias("gain")))

    scored = texts.select("doc_id", "text_key", "text").mapInArrow(_base(exact, hot, hot_gain), f"doc_id {kind}, text_key long, n_tokens long, n_sure long, base_sure double, score_sure double, rare {RARE}")
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.key", "w.tf").join(seldom.withColumn("known", F.lit(1)), "key", "left")
    base = F.coalesce("base", F.lit(math.log10(model.a / bottom)))
    back = F.coalesce("back", F.lit(math.log10(m / (m + false))))
    rare = rare.groupBy("row").agg(F.sum(F.col("tf") * base).alias("base_rare"), F.sum(F.col("tf") * (base + back)).alias("score_rare"), F.sum(F.when(F.col("known").isNotNull(), F.col("tf")).otherwise(0)).alias("n_rare"))
    again = scored.groupBy("text_key").agg(F.count("*").alias("rows"))  # rows that repeat an id and text have the sum of all of them
    out = scored.drop("rare").join(rare, "row", "left").join(gains.join(again, "text_key"), "text_key", "left")
    score = F.col("score_sure") + F.coalesce("score_rare", F.lit(0.0)) + F.coalesce(F.col("gain") / F.col("rows"), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_sure") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base_sure") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
    )
