"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is its part of the budget by weight, at most ``most`` times its size; what is cut off goes to the
others by weight until no target is above. Every document is due target / source size copies: the whole part is
certain, the rest is an inclusion probability p. Documents are ranked by the random odds u / (1 - u) over the
inclusion odds p / (1 - p), and the first are taken as long as the size still wanted is not exceeded. What a document that
does not fit leaves goes to the next ones in order of rank that do, and so on, round by round.

All documents of a source have the same p, so the rank grows with u: the cut is found from sums over ranges of u, digit by digit, and then over
ranges of a hash that tells equal rows apart, until few enough rows are left to be summed one by one. A round's outcome is a row for each source;
whether a document is taken follows from it and the document's own place, so the texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelnet.llm.storage import saved

WORD = r"[^\x20\x09-\x0D]+"
DIGIT_BITS = 13
U_DIGITS, DIGITS = 4, 6
#: Rows of one source that are summed one by one; a range of more is cut finer.
FEW = 4096
#: Sources up to this number are broadcast; beyond it they are joined.
MOST_SENT = 100_000


def word_count(text: str) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, weight) with the target of each source.

    Filling: a source is capped if most x size / weight lies at or below the level that the others then share.
    Sorted by that ratio, the capped sources are a prefix, so one pass of running sums finds the level. The
    table has a row for each source; sources without size get 0.
    """
    row = sources.withColumns({"cap": F.lit(most) * F.col("source_size"), "one": F.lit(1)}).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.partitionBy("one").orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("one")
    row = row.withColumns({
        "budget": F.lit(share) * F.sum("source_size").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(everything),
    })
    row = row.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    row = row.withColumn("free", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("free").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("free") * F.col("weight"))
    return row.select("source", "source_size", "weight", target.alias("target"))


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Sources by code point, null last, weigh the numbers of the cycle in turn."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), F.pmod(place, F.lit(len(cycle))).cast("int") + 1))


def _digit(i: int) -> Column:
    """The i-th digit of a row's place: of u first, then of what tells equal rows apart."""
    own, at = ("u", i) if i < U_DIGITS else ("v", i - U_DIGITS)
    return F.shiftright(F.col(own), DIGIT_BITS * (U_DIGITS - 1 - at)).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")


PLACE = ("u", "v", "row")


def _placed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with the columns _key, _size, _text_hash, u, v and row: u is random by id, text and seed, row and its hash v tell equal rows apart."""
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    docs = docs.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")), "_size": word_count(text_col), "_text_hash": text_hash, "row": F.monotonically_increasing_id()})
    top = F.lit((1 << DIGIT_BITS * U_DIGITS) - 1)
    return docs.withColumns({"u": F.xxhash64(F.col(id_col).cast("string"), "_text_hash", "_size", F.lit(seed)).bitwiseAND(top), "v": F.xxhash64("row", F.lit(seed)).bitwiseAND(top)})


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_SENT else df


def _round(rows: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """(_key, rest, seen, limit): the cut of one round over the rows that fit and lie behind the last one looked at.

    seen: the place of the last document taken; limit: the greatest size that this round takes; rest: what is left then.
    """
    place = F.struct(*PLACE)
    ahead = rows.join(_few(state, n_sources), "_key").filter((F.col("_size") > 0) & (F.col("_size") <= F.col("rest")) & (F.col("seen").isNull() | (place > F.col("seen"))))
    ahead = ahead.select("_key", "_size", "rest", *PLACE)
    cuts = state.select("_key", "rest", F.lit(0).cast("double").alias("before"))
    near, open_ = ahead, True
    for i in range(DIGITS):
        sums = near.join(_few(cuts.select("_key", "before"), n_sources), "_key").groupBy("_key", "rest", "before", _digit(i).alias("digit")).agg(F.sum("_size").alias("sum"), F.count("*").alias("n"))
        upto = Window.partitionBy("_key").orderBy("digit")
        sums = sums.withColumn("after", F.col("before") + F.sum("sum").over(upto)).withColumn("crosses", F.col("after") > F.col("rest"))
        hit = sums.groupBy("_key", "rest").agg(
            F.min(F.when(F.col("crosses"), F.struct("digit", (F.col("after") - F.col("sum")).alias("before"), "n"))).alias("cut"),
            F.max("after").alias("all"),
        )
        cuts = saved(hit.select("_key", "rest", F.col("cut.digit").alias("digit"), F.coalesce("cut.before", "all").alias("before"), F.col("cut.n").alias("n")))
        near = near.join(_few(cuts.select("_key", "digit"), n_sources), "_key").filter(_digit(i) == F.col("digit")).drop("digit")
        if (cuts.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    order = Window.partitionBy("_key").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = near.join(_few(cuts.select("_key", "before"), n_sources), "_key").withColumn("after", F.col("before") + F.sum("_size").over(order))
    stop = last.filter("after > rest").groupBy("_key").agg(F.min(F.struct(*PLACE, (F.col("after") - F.col("_size")).alias("taken"))).alias("stop"))
    end = F.struct(*(F.lit((1 << 63) - 1).alias(c) for c in PLACE))
    out = cuts.join(stop, "_key", "left")
    seen = F.when(F.col("stop").isNull(), end).otherwise(F.struct(*(F.col(f"stop.{c}").alias(c) for c in PLACE)))
    return saved(out.select("_key", (F.col("rest") - F.coalesce("stop.taken", "before")).alias("rest"), seen.alias("seen"), F.col("rest").alias("limit")))


def _plan(base: DataFrame, share: float, most: float, cycle: tuple[float, ...], near: float) -> tuple[DataFrame, int]:
    """(a row for each source with source_size, target, whole, cuts; their number): ``base`` has _key, _size, u, v, row."""
    sizes = base.groupBy("_key").agg(F.sum("_size").alias("source_size")).withColumn("source", F.when(F.col("_key") != "", F.expr("substr(_key, 2)")))
    source = targets(cyclic_weights(sizes, cycle), share, most).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    source = saved(source.withColumn("due", due).withColumn("whole", F.floor("due")).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")))
    n = source.count()
    place = base.select(F.struct(*PLACE).alias("p")).schema["p"].dataType
    state = source.filter("wanted > 0").select("_key", F.col("wanted").alias("rest"), F.lit(None).cast(place).alias("seen"))
    target, rounds = source.select("_key", "target"), None
    while not state.isEmpty():
        done = _round(base, state, n).withColumn("round", F.lit(0 if rounds is None else len(rounds)))
        rounds = [done] if rounds is None else [*rounds, done]
        state = done.join(target, "_key").filter((F.col("rest") >= 1) & (F.col("rest") > near * F.col("target"))).select("_key", "rest", "seen")
        state = saved(state.join(_few(_fitting(base, state, n), n), "_key", "left_semi"))
    if rounds:
        every = rounds[0]
        for r in rounds[1:]:
            every = every.unionByName(r)
        cuts = every.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("round", "seen", "limit"))).alias("cuts"))
        source = source.join(cuts, "_key", "left")
    else:
        source = source.withColumn("cuts", F.lit(None).cast("array<struct<round:int,seen:struct<u:bigint,v:bigint,row:bigint>,limit:double>>"))
    return saved(source.select("_key", "source_size", "target", "whole", "cuts")), n


def _fitting(base: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """The sources of which a document behind the last one looked at still fits."""
    rows = base.join(_few(state, n), "_key")
    return rows.filter((F.col("_size") > 0) & (F.col("_size") <= F.col("rest")) & (F.struct(*PLACE) > F.col("seen"))).select("_key").distinct()


def _copies(placed: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """``placed`` with source_size, target and copies. A document behind round i's first cut and before its own is taken if it is no larger than the round's limit."""
    rows = placed.join(_few(plan, n), "_key")
    place = F.struct(*PLACE)
    behind = lambda i: (i == 0) | (place > F.get("cuts", i - 1)["seen"])
    extra = F.exists(F.transform("cuts", lambda c, i: behind(i) & (place < c["seen"]) & (F.col("_size") <= c["limit"])), lambda x: x)
    return rows.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).drop("cuts", "whole")


BASE = ("_key", "_size", *PLACE)


def mix(docs: DataFrame, share: float = 1.0, most: float = 3.0, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 1, near: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies, taken) for every row: ``copies`` of the row belong to the mix.

    size is the text's number of words (null: 0), taken = copies x size. No row is taken more than ``most`` times, rounded up
    to whole copies of a fractional target. What a source lacks of its target is less than ``near`` of it, or less than the size of any document that it
    could still take. A null source is a source of its own, last in order. Reruns agree: the
    random number is a hash of the id, the text and the seed. Equal rows count one by one; null ids are allowed; an empty
    table gives an empty one. A hot source is in no one task: its rows meet only in sums.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    base = saved(_placed(own, seed, "doc_id", "text", "source").drop("text"))
    out = _copies(base, *_plan(base.select(*BASE), share, most, cycle, near))
    return out.select("doc_id", "source", F.col("_text_hash").alias("text_hash"), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.0, most: float = 3.0, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 1, near: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs``, a table that reads the same twice, as often as mix() takes it. Texts are read and repeated, not shuffled."""
    placed = _placed(docs.select(*(F.col(c).alias(f"_in_{c}") for c in docs.columns)), seed, f"_in_{id_col}", f"_in_{text_col}", f"_in_{source_col}")
    out = _copies(placed, *_plan(saved(placed.select(*BASE)), share, most, cycle, near)).filter("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(f"_in_{c}").alias(c) for c in docs.columns))
