"""Language identification of mixed texts: scripts narrow candidates, Viterbi over per-word scores labels spans.

Learning counts byte trigrams of words, hashed into a fixed number of buckets, and letters by script, for each language of a
labelled sample of bounded size. A word's score for a language is the log likelihood of its trigrams; a language that
the sample never shows in the script of a word's letters is no candidate for it. The best path of languages
through a text's words, each change of language costing a penalty, gives the spans.

Words of equal spelling are scored once for each slice of a batch; the path is found for all its texts at once, step by step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelnet.llm.storage import saved
from panelnet.llm.textkernel import LOWER, U, Words, mix, releasing, slices, word_hashes, words

UNKNOWN = "und"
PATH_WORDS = 1 << 20
HELD_LANGS = 64
#: First code points of ranges of scripts, by the blocks of Unicode; ranges of one name are one script.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"),
    (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@dataclass(frozen=True)
class Settings:
    """sample_rows: bound on the labelled texts that are learned from, chosen by a hash; penalty: log likelihood that a change of language costs;
    most_langs: bound on the languages, of which the tables that are broadcast have a column each."""

    sample_rows: int = 20_000
    buckets: int = 1 << 16
    penalty: float = 20.0
    smoothing: float = 0.5
    least_share: float = 0.002
    most_langs: int = 1000


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its script."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    starts = np.array([s for s, _ in SCRIPTS])
    kind = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int8)
    return letter, kind[np.maximum(np.searchsorted(starts, np.arange(0x110000), "right") - 1, 0)]


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of letters' first bytes, and the letters' scripts."""
    letter, script = _alphabet()
    code = np.where(data < 0x80, data, 0).astype(np.int32)
    lead = np.flatnonzero(data >= 0xC0)
    b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
    one, two, three = (b[lead + i] & 0x3F for i in (1, 2, 3))
    head = b[lead]
    code[lead] = np.where(head < 0xE0, (head & 0x1F) << 6 | one, np.where(head < 0xF0, (head & 0x0F) << 12 | one << 6 | two, (head & 7) << 18 | one << 12 | two << 6 | three))
    at = np.flatnonzero(letter[np.minimum(code, 0x10FFFF)])
    return at, script[code[at]]


def _trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of words with one space on either side, A-Z lower-cased, and each one's word."""
    n = end - start
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = start[owner] + place
    here = LOWER[data[at]].astype(U)
    before = np.where(place > 0, LOWER[data[np.maximum(at - 1, 0)]], 32).astype(U)
    after = np.where(place + 1 < n[owner], LOWER[data[np.minimum(at + 1, len(data) - 1)]], 32).astype(U)
    return (mix(before << U(16) | here << U(8) | after) & U(buckets - 1)).astype(np.int64), owner


def _learner(settings: Settings):
    """The counts of each language's buckets and, as negative buckets, of its letters by script: those that occur, combined."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang in grams:
                some, used = np.flatnonzero(grams[lang]), np.flatnonzero(scripts[lang])
                bucket, count = np.concatenate((some, -1 - used)), np.concatenate((grams[lang][some], scripts[lang][used]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(count.astype(np.int64))], ["lang", "bucket", "count"])
            grams.clear()
            scripts.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, offs in slices(batch.column(0)):
                w = words(data, offs)
                at, script = _letters(data)
                bucket, owner = _trigrams(data, w.start, w.end, settings.buckets)
                text_of_gram, text_of_letter = w.text[owner], np.searchsorted(offs, at, "right") - 1
                for lang in set(langs[lo:hi]):
                    own = langs[lo:hi] == lang
                    for store, values, texts, size in ((grams, bucket, text_of_gram, settings.buckets), (scripts, script, text_of_letter, len(NAMES))):
                        store[lang] = store.get(lang, 0) + np.bincount(values[own[texts]], minlength=size)
                if len(grams) > HELD_LANGS:
                    yield from told()
        yield from told()

    return run


@dataclass(frozen=True)
class Learned:
    """langs in order of code point; logp[bucket, lang]; allowed[script, lang]."""

    langs: tuple[str, ...]
    logp: np.ndarray
    allowed: np.ndarray


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang = np.array(b.column(0).to_pylist(), object)
        for x in sorted(set(lang)):
            own = lang == x
            yield pa.RecordBatch.from_arrays([pa.array([x]), *(pa.array([b.column(i).to_numpy()[own].tobytes()], pa.binary()) for i in (1, 2))], b.schema.names)


def learn(docs: DataFrame, labelled: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Learned:
    """Learns from the rows with text and language where ``labelled`` holds, by a hash of the id about ``sample_rows`` of them where there are more.

    Counts are summed in the cluster: the driver gets at most one number for each language and bucket or script, whatever the number of texts
    or partitions. More than ``most_langs`` languages are an error.
    """
    rows = docs.filter(labelled & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), id_col)
    n = rows.count()
    if n > settings.sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64(id_col, "text", F.lit(17)), F.lit(1 << 30)) < int(settings.sample_rows / n * (1 << 30)))
    counted = saved(rows.select("text", "lang").mapInArrow(_learner(settings), "lang string, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count")))
    names = [r["lang"] for r in counted.select("lang").distinct().limit(settings.most_langs + 1).collect()]
    if len(names) > settings.most_langs:
        raise ValueError(f"more than {settings.most_langs} languages")
    sums: dict[str, list[np.ndarray]] = {}
    for r in counted.mapInArrow(_pack, "lang string, bucket binary, count binary").toLocalIterator():
        own = sums.setdefault(r["lang"], [np.zeros(settings.buckets), np.zeros(len(NAMES))])
        bucket, count = np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["count"], np.int64)
        gram = bucket >= 0
        np.add.at(own[0], bucket[gram], count[gram])
        np.add.at(own[1], -1 - bucket[~gram], count[~gram])
    langs = tuple(sorted(sums))
    if not langs:
        return Learned((), np.zeros((settings.buckets, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    grams = np.stack([sums[x][0] for x in langs], 1) + settings.smoothing
    scripts = np.stack([sums[x][1] for x in langs], 1)
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Learned(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), shares >= settings.least_share)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path of its text: score[word, lang], text t having the words first[t]:first[t + 1].

    All texts advance together, longest first, so the number of steps is the longest text's words.
    """
    n = np.diff(first)
    k = score.shape[1]
    order = np.argsort(-n, kind="stable")
    begin, length = first[:-1][order], n[order]
    live = len(n) - np.searchsorted(length[::-1], np.arange(1, length[0] + 1), "left") if len(n) and length[0] else np.zeros(0, int)
    best = np.zeros((len(n), k), np.float32)
    state_type = np.int8 if k < 128 else np.int16
    came = np.zeros((len(score), k), state_type)
    own = np.arange(k, dtype=state_type)
    for t, m in enumerate(live.tolist()):
        at = begin[:m] + t
        if t:
            b = best[:m]
            top = b.argmax(axis=1)
            peak = b[np.arange(m), top] - penalty
            stay = b >= peak[:, None]
            came[at] = np.where(stay, own, top[:, None])
            best[:m] = np.maximum(b, peak[:, None]) + score[at]
        else:
            best[:m] = score[at]
        best[:m] -= best[:m].max(axis=1, keepdims=True)
    out = np.zeros(len(score), state_type)
    state = best.argmax(axis=1).astype(state_type)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        out[at] = state[:m]
        state[:m] = came[at, state[:m]] if t else state[:m]
    return out


def _word_scores(data: np.ndarray, w: Words, learned: Learned, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of every word for every language, and its number of letters; words without letters score 0."""
    _, pick, where = np.unique(word_hashes(data, w, fold=False), return_index=True, return_inverse=True)
    start, end = w.start[pick], w.end[pick]
    at, script = _letters(data)
    inside = np.searchsorted(w.start, at, "right") - 1
    ok = (inside >= 0) & (at < w.end[np.maximum(inside, 0)]) if len(w.start) else np.zeros(len(at), bool)
    letters = np.bincount(inside[ok], minlength=len(w.start))
    used = np.zeros((len(w.start), len(NAMES)), bool)
    used[inside[ok], script[ok]] = True
    bucket, owner = _trigrams(data, start, end, buckets)
    total = np.stack([np.bincount(owner, learned.logp[bucket, j], len(start)) for j in range(len(learned.langs))], 1)
    may = used[pick].astype(np.int32) @ learned.allowed.astype(np.int32) > 0
    may |= ~may.any(axis=1, keepdims=True)
    total = np.where(may, total, total.min(axis=1, keepdims=True) - 1e3)
    total[letters[pick] == 0] = 0
    total -= total.max(axis=1, keepdims=True)
    return np.maximum(total, -200.0).astype(np.float32)[where], letters


def _labeller(learned, settings: Settings, spans: bool):
    def labelled(batch: pa.RecordBatch, count: np.ndarray, score: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
        langs: tuple[str, ...] = learned.value.langs
        k, names = len(langs), np.array([*langs, UNKNOWN], object)
        first = np.concatenate(([0], np.cumsum(count)))
        path = viterbi(score, first, settings.penalty)
        text = np.repeat(np.arange(len(count)), count)
        share = np.zeros((len(count), max(k, 1)))
        np.add.at(share, (text, path), letters)
        total = share.sum(axis=1)
        lang = np.where((total > 0) & (k > 0), share.argmax(axis=1), k)
        conf = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0) * (k > 0)
        columns = [batch.column(0), pa.array(names[lang].tolist(), pa.string()), pa.array(conf)]
        if spans:
            columns.append(_spans(text, first, path, langs, letters))
        more = [batch.column(i) for i in range(2, batch.num_columns)]
        return pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "lang_pred", "score", *["spans"] * spans, *batch.schema.names[2:]])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Learned = learned.value
        k = len(model.langs)
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            begin, n_words = 0, 0
            for _, hi, data, offs in slices(batch.column(1)):
                w = words(data, offs)
                score, letters = _word_scores(data, w, model, settings.buckets) if k else (np.zeros((len(w.start), 1), np.float32), np.zeros(len(w.start), int))
                held.append((w.count, score, letters))
                n_words += len(letters)
                if n_words >= PATH_WORDS or hi == batch.num_rows:
                    yield labelled(batch.slice(begin, hi - begin), *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, begin, n_words = [], hi, 0

    return run


def _spans(text: np.ndarray, first: np.ndarray, path: np.ndarray, langs: tuple[str, ...], letters: np.ndarray) -> pa.Array:
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    rows: list[list] = [[] for _ in range(len(first) - 1)]
    for t, a, b in zip(text[at].tolist(), at.tolist(), np.append(at, len(path))[1:].tolist(), strict=True):
        rows[t].append({"lang": langs[path[a]] if langs else UNKNOWN, "begin": a - int(first[t]), "words": b - a, "letters": int(letters[a:b].sum())})
    return pa.array(rows, pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("words", pa.int64()), ("letters", pa.int64())])))


def identify(docs: DataFrame, learned: Learned, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", spans: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) for every row, from the text alone, and the columns ``more`` as they are, prefixed by ``_``.

    lang_pred: the language whose spans hold most of the text's letters, the first by name at a tie; ``und`` for a text that is null or
    has no letter, or if nothing was learned. score: the share of its letters in those spans; 0 for ``und``. spans: each one's
    language, first word, words and letters. Ids may be null or repeat; other columns are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in more))
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,begin:long,words:long,letters:long>>" * spans + kept
    return rows.mapInArrow(_labeller(sent, settings, spans), schema)
