r"""Deleting repeated runs of lines, found by winnowing over line hashes, in DataFrame operations only.

A window at a line is that line and as many next ones as it takes to hold ``min_words`` words; blank lines do not
count. Winnowing selects the least line hash of every window. Neighbouring windows mostly select the same line, so a text has one row
for each line that is selected, a fingerprint, with what identifies the windows that selected it. Two equal runs of at least
``min_words`` words hold an equal window, which selects the same line in both: a fingerprint that occurs once in the corpus has no match, and is not looked at
again. Positions that share a fingerprint are joined, window by window, with the first position of equal content; a match is extended to the left and
to the right for as long as the neighbouring windows match at the same distance, and the lines of later runs are deleted.

Windows are built inside a text's row, without a shuffle; only fingerprints, hashes and positions are shuffled before the texts meet
their deletions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelnet.llm.mixing import WORD
from panelnet.llm.storage import saved

SPACES = " \t\n\x0b\f\r"
#: Most windows close within so few lines; the others look at min_words lines, which always suffice.
NEAR_LINES = 6


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _words(bare: Column) -> Column:
    """Words of a line without outer white space: its spaces and one where only single spaces part them, else by the pattern."""
    single = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
    return F.when(bare == "", 0).when(bare.rlike("[\\x09-\\x0D]|  "), F.regexp_count(bare, F.lit(WORD))).otherwise(single)


def _line_hashes(text: Column) -> Column:
    """The lines with a word: place p, two hashes h and g of the line without outer white space, number of words n."""
    bare = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)))
    lines = F.transform(bare, lambda b, i: F.struct(i.cast("int").alias("p"), F.xxhash64(b).alias("h"), F.xxhash64(F.lit(7), b).alias("g"), _words(b).alias("n")))
    return F.filter(lines, lambda x: x["n"] > 0)


def _window(some: Column, i: Column, min_words: int) -> Column:
    """What the lines ``some`` from place i on take to hold min_words: words, number of lines k, least hash and its place at."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("least"), i.alias("at"))

    def step(w: Column, x: Column) -> Column:
        less = w["least"].isNull() | (x["h"] < w["least"])
        more = F.struct((w["words"] + x["n"]).alias("words"), (w["k"] + 1).alias("k"), F.when(less, x["h"]).otherwise(w["least"]).alias("least"), F.when(less, i + w["k"]).otherwise(w["at"]).alias("at"))
        return F.when(w["words"] >= min_words, w).otherwise(more)

    return F.aggregate(some, start, step)


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, print, windows): a row for each line that a window selects, with the places b to e and two hashes of the content of the windows that selected it."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _line_hashes(F.col("text")).alias("lines"))
    lines = F.col("lines")

    def window(x: Column, i: Column) -> Column:
        near = _window(F.slice(lines, i + 1, NEAR_LINES), i, min_words)
        whole = lambda w: F.when(w["words"] >= min_words, w).otherwise(_window(F.slice(lines, i + 1, min_words), i, min_words))
        return _bound(near, whole)

    rows = rows.select("doc_id", "text_hash", "lines", F.filter(F.transform(lines, window), lambda w: w["words"] >= min_words).alias("all"))
    windows = F.col("all")

    def described(w: Column, i: Column) -> Column:
        own = F.slice(lines, i + 1, w["k"])
        return F.struct(w["at"].alias("at"), w["least"].alias("print"), F.get(lines, i)["p"].alias("b"), F.get(lines, i + w["k"] - 1)["p"].alias("e"), F.xxhash64(F.transform(own, lambda x: x["h"])).alias("c"), F.xxhash64(F.transform(own, lambda x: x["g"])).alias("d"))

    # no filter on what is built here: Spark would build all of it again to push the filter down
    rows = rows.select("doc_id", "text_hash", F.transform(windows, described).alias("all"))
    changes = F.filter(F.transform(windows, lambda w, j: F.struct(j.alias("j"), w["at"].alias("at"), w["print"].alias("print"))), lambda s: (s["j"] == 0) | (F.get(windows, s["j"] - 1)["at"] != s["at"]))
    own = lambda s: F.filter(F.slice(windows, s["j"] + 1, min_words), lambda w: w["at"] == s["at"])
    selected = F.transform(changes, lambda s: F.struct(s["print"].alias("print"), F.transform(own(s), lambda w: w.dropFields("at", "print")).alias("windows")))
    return rows.select("doc_id", "text_hash", F.explode(selected).alias("s")).select("doc_id", "text_hash", "s.print", "s.windows")


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, b, e, first): windows of ``docs`` (doc_id, text) whose content occurs earlier, with the first such place.

    Both counts combine before their shuffles; the joins back have keys that Spark can split where they are skewed.
    """
    found = saved(fingerprints(docs, min_words))
    several = found.groupBy("print").agg(F.count("*").alias("n"), F.max(F.size("windows")).alias("m")).filter("n > 1").select("print")
    shared = found.join(saved(several), "print").select("doc_id", "text_hash", F.explode("windows").alias("w")).select("doc_id", "text_hash", "w.*")
    shared = saved(shared)
    first = shared.groupBy("c", "d").agg(F.min(F.struct("doc_id", "text_hash", "b", "e")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    match = shared.join(saved(first), ["c", "d"])
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return match.filter(~same | (F.col("b") > F.col("first.e"))).select("doc_id", "text_hash", "b", "e", "first")


def _extended(match: DataFrame, *key: str) -> DataFrame:
    """Matches of equal ``key`` that overlap or follow each other, put together: (key, begin, end)."""
    run = Window.partitionBy(*key).orderBy("b")
    match = match.withColumn("reach", F.max("e").over(run.rowsBetween(Window.unboundedPreceding, -1)))
    match = match.withColumn("run", F.count(F.when(F.col("reach").isNull() | (F.col("b") > F.col("reach") + 1), 1)).over(run))
    return match.groupBy(*key, "run").agg(F.min("b").alias("begin"), F.max("e").alias("end")).drop("run")


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, begin, end, first_doc, first_begin): runs of lines of ``docs`` (doc_id, text) that repeat an earlier run.

    Earlier: in a document of a smaller id, in one of the same id and a smaller hash of its text, or further up in the same one without overlap.
    """
    match = repeated_windows(docs, min_words).withColumns({"first_doc": F.col("first.doc_id"), "first_text": F.col("first.text_hash"), "shift": F.col("b") - F.col("first.b")})
    runs = _extended(match, "doc_id", "text_hash", "first_doc", "first_text", "shift").distinct()
    return runs.select("doc_id", "begin", "end", "first_doc", (F.col("begin") - F.col("shift")).alias("first_begin"))


def _outside(runs: Column, lines: Column) -> Column:
    """The lines between and behind the runs, which are in order and apart."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["end"] + 1)
    between = F.transform(runs, lambda r, i: F.slice(lines, before(i) + 1, r["begin"] - before(i)))
    return F.concat(F.flatten(between), F.slice(lines, F.element_at(runs, -1)["end"] + 2, F.size(lines)))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs of at least ``min_words`` words deleted from the texts, and columns n_lines, n_removed (long).

    Lines are split at \\n and compared without white space at their ends; a deleted run takes the blank lines inside it
    along. The earliest run stays, by id and place in the text; a text without repeated runs stays as it is, null and empty ones too.
    Rows equal in id and text are one document and fare alike; rows that repeat an id with another text are documents of their own, in the order of
    a hash of the text. Rows with a null id stay as they are. Other columns pass through, but for n_lines and n_removed, which give way.
    """
    docs = docs.drop("n_lines", "n_removed")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    match = repeated_windows(texts, min_words).select("doc_id", "text_hash", "b", "e").distinct()
    gone = _extended(match, "doc_id", "text_hash").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("__panelnet_gone"))
    gone = saved(gone.withColumnsRenamed({"doc_id": "__panelnet_id", "text_hash": "__panelnet_text"}))
    out = docs.withColumns({"__panelnet_id": F.col(id_col).cast("long"), "__panelnet_text": F.xxhash64(F.col(text_col).cast("string"))})
    out = out.join(gone.hint("merge"), ["__panelnet_id", "__panelnet_text"], "left")  # deletions grow with the corpus: no broadcast
    runs = F.col("__panelnet_gone")
    kept = _bound(F.split(F.col(text_col), "\n"), lambda lines: F.array_join(_outside(runs, lines), "\n"))
    text = F.when(runs.isNull(), F.col(text_col)).otherwise(kept)
    removed = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"] + 1)
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit("\n")) + 1).cast("long")
    out = out.withColumns({"n_lines": n_lines, "n_removed": F.coalesce(removed, F.lit(0)).cast("long"), text_col: text})
    return out.select(*docs.columns, "n_lines", "n_removed")
