"""Quality rules: counts of whole texts, fixed limits, and robust multivariate outliers for each language and source.

Transformed shares of a text make its vector; a share of a short text is drawn towards the corpus's. For each language and source the minimum covariance
determinant estimate is sought: the share ``cover`` of the group's texts whose covariance has the least determinant. Four starts (the quartiles alone, and
correlations of bounded scores, of directions and of the inner texts) each make three concentration steps: the texts of least Mahalanobis distance give the next
mean and covariance, whose determinant is never larger. The start of the least determinant goes on until it no longer falls. A text is rejected if
its squared distance exceeds a quantile of the chi-squared distribution.

A group of any size has an estimate of its own, which a prior of ``prior_rows`` rows steadies: their centre and spreads are the corpus's medians and
quartiles. They count in every concentration step, so a group of few texts is judged by about the corpus's spread and a large one by its own.

Every step is an aggregate over all rows; only a group's moments come together, and its covariance is factored where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelnet.llm.storage import saved
from panelnet.llm.textkernel import SPACE, U, mix, releasing, run_hashes, shingles, slices, step, word_hashes, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_lines")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?.,;:-_/\\\"'()[]{}=+@^~`")] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def _repeated(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each hash occurs twice or more in its text."""
    text = np.repeat(np.arange(len(first) - 1, dtype=U), np.diff(first))
    own = mix(h + mix(text + step(41)))
    _, where, count = np.unique(own, return_inverse=True, return_counts=True)
    return count[where] > 1


def counts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text."""
    n_texts = len(offs) - 1
    w = words(data, offs)
    total = lambda mask: np.concatenate(([0], np.cumsum(mask)))[offs[1:]] - np.concatenate(([0], np.cumsum(mask)))[offs[:-1]]
    starts = (data & 0xC0) != 0x80
    space = SPACE[data]
    # lines with a word, compared by hashes of their bytes
    border = np.unique(np.concatenate((offs, np.flatnonzero(data == 10) + 1)))
    begin = border[:-1] if len(border) > 1 else np.zeros(0, np.int64)
    end = border[1:].copy()
    newline = data[end - 1] == 10 if len(end) else np.zeros(0, bool)
    line_of = np.searchsorted(offs, begin, "right") - 1
    sizes = end - newline - begin
    line = run_hashes(data, begin, begin + sizes)
    filled = np.searchsorted(w.start, begin + sizes) > np.searchsorted(w.start, begin)
    lines, owner = line[filled], line_of[filled]
    n_lines = np.bincount(owner, minlength=n_texts)
    kinds = np.unique(mix(lines + mix(owner.astype(U) + step(43))), return_index=True)[1]
    n_dup = n_lines - np.bincount(owner[kinds], minlength=n_texts)
    # words in windows of five that occur again
    h = word_hashes(data, w, fold=False)
    run, first = shingles(h, w, 5)
    again = _repeated(run, first) & (w.count >= 5)[np.repeat(np.arange(n_texts), np.diff(first))]
    at = np.repeat(w.first[:-1] - first[:-1], np.diff(first)) + np.arange(len(run))
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + 5, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[: len(h)]) > 0)))
    letters = starts & ~space & ~SYMBOL[data] & ~MARK[data] & ~DIGIT[data]
    return [w.count, total(starts & ~space), total(SYMBOL[data]), n_dup, covered[w.first[1:]] - covered[w.first[:-1]], total(UPPER[data]), total(letters), total(MARK[data]), n_lines]


@releasing
def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)), *(pa.array(x.astype(np.int64)) for x in counts(data, offs))], ["doc_id", "lang", "source", *COUNTS])


@dataclass(frozen=True)
class Rules:
    """The fixed limits, and the outlier method's: cover of the estimate, concentration steps of every start, most steps in all, gain in the
    logarithm of the determinant below which it has converged, rows that the prior counts as, tail of the chi-squared distribution beyond which a text is rejected,
    words and lines that the corpus's shares count as in a text's, and for each statistic the least standard deviation that it is given."""

    least_words: int = 10
    most_repeat_percent: int = 20
    cover: float = 0.75
    start_steps: int = 3
    most_steps: int = 40
    gain: float = 1e-3
    prior_rows: float = 15.0
    tail: float = 1e-6
    few_words: float = 50.0
    few_lines: float = 3.0
    floors: tuple[float, ...] = (0.05, 0.05, 0.04, 0.05, 0.04, 0.1)


def chi2_cdf(x: float, p: int) -> float:
    """Of the chi-squared distribution with an even number p of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


RATES = ("word_chars", "n_symbols", "n_others", "n_marks", "n_upper", "n_dup_lines")


def corpus_rates(fit: DataFrame) -> list[float]:
    """Characters, symbols and marks a word, characters that are no letters and upper-case ones a character, and repeated lines a line, over all texts."""
    n, chars, lines = (F.greatest(F.sum(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    own = [F.sum("word_chars") / n, F.sum("n_symbols") / n, F.sum(F.greatest(F.col("word_chars") - F.col("n_letters"), F.lit(0))) / chars, F.sum("n_marks") / n, F.sum("n_upper") / chars, F.sum("n_dup_lines") / lines]
    return [float(x or 0.0) for x in fit.agg(*(c.alias(k) for c, k in zip(own, RATES, strict=True))).first()]


def statistics(rates: list[float], rules: Rules) -> list[Column]:
    """Transformed: word length; square roots of symbols and marks a word, of the shares of characters that are no letters or are upper-case, and of lines that repeat."""
    length, symbols, others, marks, upper, dup = rates
    k, lines = rules.few_words, rules.few_lines
    n, chars = F.col("n_words") + k, F.col("word_chars") + k * max(length, 1.0)
    root = lambda own, rate, prior, of: F.sqrt((own + rate * prior) / of)
    return [
        F.log((F.col("word_chars") + k * max(length, 1.0)) / n),
        root(F.col("n_symbols"), symbols, k, n),
        root(F.greatest(F.col("word_chars") - F.col("n_letters"), F.lit(0)), others, k * max(length, 1.0), chars),
        root(F.col("n_marks"), marks, k, n),
        root(F.col("n_upper"), upper, k * max(length, 1.0), chars),
        root(F.col("n_dup_lines"), dup, lines, F.col("n_lines") + lines),
    ]


P = 6


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


STARTS = ("quartiles", "bounded", "directions", "inner")
PARAMS = "group string, start int, centre array<double>, white array<double>, logdet double"
#: Groups up to this number have their estimates broadcast; beyond it they are joined.
MOST_SENT = 50_000


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_SENT else df


def _matrix(cross: list[float]) -> np.ndarray:
    s = np.zeros((P, P))
    for (i, j), x in zip(_pairs(), cross, strict=True):
        s[i, j] = s[j, i] = x
    return s


def combined(n: float, mean: np.ndarray, cov: np.ndarray, prior: tuple[np.ndarray, np.ndarray], rules: Rules, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of n rows and the prior's, with the least spread of each statistic added."""
    k, (at, spread) = rules.prior_rows, prior
    centre = (n * mean + k * at) / (n + k)
    scatter = (n * (scale * cov + np.outer(mean, mean)) + k * (np.diag(spread**2) + np.outer(at, at))) / (n + k) - np.outer(centre, centre)
    return centre, scatter + np.diag(np.array(rules.floors) ** 2)


def _row(centre: np.ndarray, scatter: np.ndarray) -> tuple[list[float], list[float], float]:
    """centre, whitening (rows of the inverse Cholesky factor) and logarithm of the determinant."""
    factor = np.linalg.cholesky(scatter)
    return centre.tolist(), np.linalg.inv(factor).ravel().tolist(), float(2 * np.log(np.diag(factor)).sum())


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["group", "start", "centre", "white", "logdet"])


def _factored(rules: Rules, prior: tuple[np.ndarray, np.ndarray], scale: float):
    """Estimates from the moments about the former centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                m = np.array(r["sums"]) / r["n"]
                cov = _matrix(r["cross"]) / r["n"] - np.outer(m, m)
                rows.append((r["group"], r["start"], *_row(*combined(r["n"], np.array(r["centre"]) + m, cov, prior, rules, scale))))
            yield _table(rows)

    return run


def started(n: float, median: np.ndarray, spread: np.ndarray, moments: list[np.ndarray], prior: tuple[np.ndarray, np.ndarray], rules: Rules) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four first estimates: the spreads without correlation, then with the correlations of three kinds of scores' moments."""
    out = [combined(n, median, np.diag(spread**2), prior, rules, 1.0)]
    for s in moments:
        own = np.sqrt(np.diag(s))
        corr = np.where(np.outer(own, own) > 0, s / np.where(np.outer(own, own) > 0, np.outer(own, own), 1), 0.0)
        np.fill_diagonal(corr, 1.0)
        out.append(combined(n, median, corr * np.outer(spread, spread), prior, rules, 1.0))
    return out


def _starter(rules: Rules, prior: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                first = started(r["n"], np.array(r["median"]), np.array(r["spread"]), [_matrix(r[k]) for k in STARTS[1:]], prior, rules)
                rows += [(r["group"], i, *_row(*x)) for i, x in enumerate(first)]
            yield _table(rows)

    return run


def _distance(rows: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """``rows`` once for each start that their group has in ``params``, with d2, the squared Mahalanobis distance."""
    rows = rows.join(_few(params, n), "group")
    off = [F.col(f"x{i}") - F.get("centre", F.lit(i)) for i in range(P)]
    turned = [sum((F.get("white", F.lit(i * P + j)) * off[j] for j in range(1, i + 1)), F.get("white", F.lit(i * P)) * off[0]) for i in range(P)]
    return rows.withColumn("d2", sum((t * t for t in turned[1:]), turned[0] * turned[0]))


def _quartiles(i: int) -> Column:
    return F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias(f"q{i}")


def consistency(rules: Rules) -> float:
    """What the covariance of the inner share of a normal sample is to be multiplied by."""
    return rules.cover / chi2_cdf(chi2_quantile(rules.cover, P), P + 2)


def concentrated(rows: DataFrame, params: DataFrame, rules: Rules, prior: tuple[np.ndarray, np.ndarray], n: int) -> DataFrame:
    """The next estimates: of the rows of least distance, ``cover`` of each group."""
    near = _distance(rows, params.select("group", "start", "centre", "white"), n)
    cut = saved(near.groupBy("group", "start").agg(F.percentile_approx("d2", rules.cover, 10_000).alias("cut")))
    near = _distance(rows, params.join(cut, ["group", "start"]).select("group", "start", "centre", "white", "cut"), n).filter("d2 <= cut")
    off = [F.col(f"x{i}") - F.get("centre", F.lit(i)) for i in range(P)]
    moments = near.groupBy("group", "start").agg(F.count("*").alias("n"), F.first("centre").alias("centre"), F.array(*(F.sum(x) for x in off)).alias("sums"), F.array(*(F.sum(off[i] * off[j]) for i, j in _pairs())).alias("cross"))
    return saved(moments.mapInArrow(_factored(rules, prior, consistency(rules)), PARAMS))


def estimates(rows: DataFrame, rules: Rules) -> tuple[DataFrame, int]:
    """(one row of PARAMS for each group of ``rows`` (group, x0..), their number)."""
    quarts = saved(rows.groupBy("group").agg(F.count("*").alias("n"), *(_quartiles(i) for i in range(P))))
    every, n = rows.agg(*(_quartiles(i) for i in range(P))).first(), quarts.count()
    if not n:
        return quarts.select("group", F.lit(0).alias("start"), *(F.array().cast("array<double>").alias(c) for c in ("centre", "white")), F.lit(0.0).alias("logdet")), 0
    spread = lambda q, i: max((q[2] - q[0]) / 1.349, rules.floors[i])
    prior = np.array([every[i][1] for i in range(P)]), np.array([spread(every[i], i) for i in range(P)])
    spreads = F.array(*(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(rules.floors[i])) for i in range(P)))
    quarts = quarts.select("group", "n", F.array(*(F.col(f"q{i}")[1] for i in range(P))).alias("median"), spreads.alias("spread"))
    z = [(F.col(f"x{i}") - F.get("median", F.lit(i))) / F.get("spread", F.lit(i)) for i in range(P)]
    scored = rows.join(_few(quarts.select("group", "median", "spread"), n), "group").select("group", *(x.alias(f"z{i}") for i, x in enumerate(z)))
    scored = scored.withColumn("r2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")))
    inner = F.when(F.col("r2") <= chi2_quantile(0.5, P), 1.0).otherwise(0.0)
    kinds = {"bounded": lambda i, j: F.tanh(f"z{i}") * F.tanh(f"z{j}"), "directions": lambda i, j: F.col(f"z{i}") * F.col(f"z{j}") / F.greatest("r2", F.lit(1e-12)), "inner": lambda i, j: inner * F.col(f"z{i}") * F.col(f"z{j}")}
    scores = scored.groupBy("group").agg(*(F.array(*(F.sum(f(i, j)) for i, j in _pairs())).alias(k) for k, f in kinds.items()))
    params = saved(quarts.join(scores, "group").mapInArrow(_starter(rules, prior), PARAMS))
    for _ in range(rules.start_steps):
        params = concentrated(rows, params, rules, prior, n * len(STARTS))
    best = params.groupBy("group").agg(F.min(F.struct("logdet", "start", "centre", "white")).alias("p"))
    params = saved(best.select("group", "p.start", "p.centre", "p.white", "p.logdet"))
    for _ in range(rules.most_steps):
        after = concentrated(rows, params, rules, prior, n)
        fell = F.col("b.logdet") < F.col("a.logdet") - rules.gain
        both = saved(params.alias("a").join(after.alias("b"), "group").select("group", "b.start", *(F.when(fell, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("centre", "white", "logdet")), fell.alias("fell")))
        params = both.drop("fell")
        if both.filter("fell").isEmpty():
            break
    return params, n


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, COUNTS, base_failed, distance, kept) for every row.

    base_failed: fewer than least_words words, or more than most_repeat_percent of a hundred words in windows of five words that occur
    again; distance is null. The others' estimates are made for each language and source, however few texts that has. distance: the squared Mahalanobis distance
    from the estimate. A null text has no words and fails; null languages and sources are
    groups of their own; ids may be null or repeat; other columns are ignored; an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = texts.mapInArrow(_counter, schema).withColumn("base_failed", (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words")))
    counted = saved(counted)
    fit = counted.filter("not base_failed")
    told = lambda c: F.coalesce(F.concat(F.length(c), F.lit("="), c), F.lit(""))
    xs = statistics(corpus_rates(fit), rules)
    fit = fit.withColumn("group", F.concat(told("lang"), F.lit("|"), told("source"))).withColumns({f"x{i}": x for i, x in enumerate(xs)})
    vectors = saved(fit.select("group", *(f"x{i}" for i in range(P))))
    params, n = estimates(vectors, rules)
    columns = ["doc_id", "lang", "source", *COUNTS, "base_failed"]
    far = _distance(fit, params.select("group", "centre", "white"), n)
    far = far.select(*columns, F.col("d2").alias("distance"), (F.col("d2") <= chi2_quantile(1 - rules.tail, P)).alias("kept"))
    failed = counted.filter("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return far.unionByName(failed)
