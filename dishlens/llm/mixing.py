"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in order of code points (null last) weigh 1, 2, 3, 1, 2, 3 ... and share all words by weight; a source's
target stops at 3 times its words, and what is above is shared again by weight until no target is above.

Copies: a document's expected copies are its source's target over its words, tilted towards documents of a higher priority
(by default longer ones); the tilt keeps the source's expected words and never asks for more than 3 copies. The whole copies
are certain. The rest is an inclusion probability p: documents are ranked by random odds u / (1 - u) over inclusion odds
p / (1 - p), the least first, and taken until the source's words are reached. What is then missing or too much by
the size of one document is mended by the one document that comes closest, if that is nearer.

No source is sorted as a whole. Ranks are counted in ranges of the random number, about ROWS_PER_RANGE documents each;
running sums over ranges tell the range in which a source's words are reached, and only that range is sorted. Sources are
one row each; their weights are numbered in one task, by one window over all sources.

Rows that repeat in doc_id, text and source are one group with a number of rows from the start, summed before anything is
shuffled. They share their random number and stand one behind another in the order: a draw or a mend that ends within a group takes
some of its rows once more than the others. ``mix`` gives each row back; ``mixed`` numbers the rows of such groups, in parts of
at most about ROWS_PER_RANGE, so that it takes exactly what ``mix`` says.

The random number is read from the md5 of the doc_id and the size, so runs agree. Results: null or empty text has no words
and is never taken; null sources are one source; a null doc_id counts as the last of all; texts are counted one at a time,
however long; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishlens.llm import arrays
from dishlens.llm.quality_rules import words
from dishlens.sources.sinks import materialize

WEIGHTS, MAX_COPIES = (1, 2, 3), 3
#: How far priorities tilt the expected copies (0: not at all, 1: at most), and the words at which a document's is one half.
TILT, HALF = 0.5, 256
ROWS_PER_RANGE = 10_000
DIGITS = 13


def priority(size: Column) -> Column:
    """Priority in thousandths, 0 to 999, rising with the size."""
    return F.floor(1000 * size / (size + HALF)).cast("long")


def uniform(key: Column) -> Column:
    """A number above 0 and below 1 from the first hex digits of the key's md5."""
    number = F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long")
    return (number.cast("double") + 0.5) / float(1 << 4 * DIGITS)


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to one row for each source: source, source_size."""
    every = Window.partitionBy()
    order = every.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS) + 1).cast("int")).cast("decimal(38,0)")
    cap = (MAX_COPIES * F.col("source_size")).cast("decimal(38,0)")
    rows = sources.withColumns({"weight": weight, "number": number, "cap": cap})
    # by cap over weight, ascending: a source is capped if its share of what those before it leave is more than its cap
    up = every.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), "number").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    rows = rows.withColumns({
        "left": F.sum(F.col("source_size").cast("decimal(38,0)")).over(every) - F.coalesce(F.sum("cap").over(up), zero),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), zero),
    })
    rows = rows.withColumn("capped", F.col("cap") * F.col("open") < F.col("weight") * F.col("left"))
    total = F.sum(F.col("source_size").cast("decimal(38,0)")).over(every)
    rest = total - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(zero)).over(every)
    shared = F.sum(F.when(F.col("capped"), zero).otherwise(F.col("weight"))).over(every)
    rows = rows.withColumns({"rest": rest.cast("double"), "shared": shared.cast("double")})
    share = F.col("weight").cast("double") * F.col("rest") / F.col("shared")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
    return rows.select("source", "source_size", "n_docs", "priority_sum", target.alias("target"))


def expected_copies(rows: DataFrame, tilt: float) -> DataFrame:
    """Adds whole copies and the probability of one more."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.when(F.col("source_size") > 0, F.col("priority_sum") / F.col("source_size")).otherwise(0.0)
    lean = (F.col("priority") - F.col("mean")) / 1000
    copies = F.col("ratio") * (1 + tilt * (1 - F.col("ratio") / MAX_COPIES) * lean)
    copies = F.least(F.greatest(F.round(copies, 9), F.lit(0.0)), F.lit(float(MAX_COPIES)))
    rows = rows.withColumns({"ratio": ratio, "mean": mean}).withColumn("copies", copies)
    rows = rows.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.round(F.col("copies") - F.col("whole"), 9))
    return rows.withColumn("odds", F.when((F.col("p") > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))


def _joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Columns of a table with one row for each source, added to rows."""
    renamed = sources.withColumnRenamed("source", "of_source")
    return rows.join(renamed, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")


def decided(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tilt: float = TILT) -> DataFrame:
    """One row for each group of equal rows: doc_id, doc_key, text_key, source, size, n, source_size, target, whole, more.

    Each of the ``n`` rows is taken ``whole`` times, and ``more`` of them once more.
    """
    body = F.col(text)
    size = F.coalesce(F.size(words(body)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        arrays.document_key(doc_id).alias("doc_key"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("text_key"),
        F.col(source).alias("source"),
        size.alias("size"),
    )
    rows = rows.groupBy("doc_id", "doc_key", "text_key", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("priority", priority(F.col("size")))
    rows = materialize(rows.withColumn("u", uniform(F.concat_ws(":", "doc_key", "size"))), "sizes")
    sources = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"), F.sum(F.col("priority") * F.col("size") * F.col("n")).alias("priority_sum")
    )
    rows = expected_copies(_joined(rows, targets(sources)), tilt)
    # ranks and sizes by range: odds / (1 + odds) spreads about evenly between 0 and 1
    ranges = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n_docs") / ROWS_PER_RANGE, F.lit(1.0)))))
    rows = rows.withColumn("range", F.floor(ranges * F.col("odds") / (1 + F.col("odds"))).cast("long"))
    rows = materialize(rows.drop("ratio", "mean", "priority", "priority_sum", "n_docs", "copies", "u"), "odds")
    sums = rows.groupBy("source", "range").agg(
        F.sum(F.col("whole") * F.col("size") * F.col("n")).alias("certain"), F.sum(F.col("size") * F.col("n")).alias("words"), F.max("target").alias("target")
    )
    by_source = Window.partitionBy("source")
    sums = sums.withColumns({
        "wanted": F.max("target").over(by_source) - F.sum("certain").over(by_source),
        "upto": F.sum(F.when(F.col("range").isNotNull(), F.col("words")).otherwise(0)).over(by_source.orderBy(F.col("range").asc_nulls_first())),
    }).where("range IS NOT NULL")
    first = F.min(F.when(F.col("upto") >= F.col("wanted"), F.struct("range", (F.col("upto") - F.col("words")).alias("before"))))
    cut = sums.groupBy("source").agg(F.max("wanted").alias("wanted"), first.alias("cut"))
    cut = cut.select("source", "wanted", F.col("cut.range").alias("cut"), F.col("cut.before").alias("before"))
    # written, so that the join may split a source's rows, which the window below could not
    rows = materialize(_joined(rows, cut), "cut")
    inside = (F.col("range") == F.col("cut")) & F.col("cut").isNotNull()
    earlier = F.sum(F.col("size") * F.col("n")).over(by_source.orderBy("odds", "doc_key", "text_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    edge = rows.where(inside).withColumn("earlier", F.col("before") + F.coalesce(earlier, F.lit(0)))
    # a row is taken if that brings the sum nearer: row j of the group if 2 (earlier + j size) - size <= 2 wanted
    fit = F.floor((2 * F.col("wanted") - 2 * F.col("earlier") + F.col("size")) / (2 * F.col("size"))).cast("long")
    edge = edge.withColumn("more", F.least(F.greatest(fit, F.lit(0)), F.col("n"))).drop("earlier")
    rest = rows.where(~F.coalesce(inside, F.lit(False)))
    below = F.col("range").isNotNull() & (F.col("cut").isNull() | (F.col("range") < F.col("cut")))
    rows = materialize(edge.unionByName(rest.withColumn("more", F.when(below, F.col("n")).otherwise(F.lit(0)).cast("long"))), "drawn")
    return _mended(rows)


def _mended(rows: DataFrame) -> DataFrame:
    """One row more, or one copy of a row less, where that brings a source nearer to its target."""
    taken = (F.col("whole") * F.col("n") + F.col("more")) * F.col("size")
    gaps = rows.groupBy("source").agg((F.max("target") - F.sum(taken)).alias("gap"))
    rows = _joined(rows, gaps)
    step = F.when((F.col("gap") > 0) & (F.col("more") < F.col("n")) & (F.col("whole") < MAX_COPIES), 1).when((F.col("gap") < 0) & (F.col("more") > 0), -1)
    change = F.when(F.col("size") > 0, step)
    miss = F.abs(F.col("gap") - F.col("change") * F.col("size"))
    rows = rows.withColumn("change", change).withColumn("miss", miss)
    best = rows.where("miss < abs(gap)").groupBy("source").agg(F.min(F.struct("miss", "doc_key", "text_key")).alias("best"))
    rows = _joined(rows, best.select("source", "best"))
    chosen = F.coalesce(F.struct("miss", "doc_key", "text_key") == F.col("best"), F.lit(False))
    rows = rows.withColumn("more", F.col("more") + F.when(chosen, F.col("change")).otherwise(0))
    return rows.select("doc_id", "doc_key", "text_key", "source", "size", "n", "source_size", "target", "whole", "more")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tilt: float = TILT) -> DataFrame:
    """One row for each document: doc_key, text_key, doc_id, size, source_size, target, copies, taken."""
    groups = materialize(decided(docs, doc_id, text, source, tilt), "decided")
    columns = ["doc_key", "text_key", "doc_id", "size", "source_size", "target"]

    def given(rows: DataFrame, number: Column) -> DataFrame:
        copies = F.col("whole") + F.when(number <= F.col("more"), 1).otherwise(0)
        return rows.withColumn("copies", copies).select(*columns, "copies", (F.col("copies") * F.col("size")).alias("taken"))

    single = given(groups.where("n = 1"), F.lit(1))
    parts = groups.where("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ROWS_PER_RANGE))))
    first = F.col("part") * ROWS_PER_RANGE + 1
    # a group of very many rows is made by many tasks
    many = parts.repartition("doc_key", "text_key", "part").withColumn("number", F.explode(F.sequence(first, F.least(first + ROWS_PER_RANGE - 1, F.col("n")))))
    return single.unionByName(given(many, F.col("number")))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tilt: float = TILT) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with all their columns."""
    names = ("doc_key", "text_key", "own_doc_key", "own_text_key", "origin", "n", "whole", "more", "part", "part_of", "first", "times")
    left, right, own_left, own_right, origin, n, whole, more, part, part_of, first, times = (arrays.unused(docs, f"mix_{name}") for name in names)
    groups = materialize(decided(docs, doc_id, text, source, tilt), "decided").where("whole + more > 0")
    groups = groups.select(*[F.col(old).alias(new) for old, new in (("doc_key", left), ("text_key", right), ("source", origin), ("n", n), ("whole", whole), ("more", more))])
    keyed = docs.withColumns({own_left: arrays.document_key(doc_id), own_right: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    same = (F.col(own_left) == F.col(left)) & (F.col(own_right) == F.col(right)) & F.col(source).eqNullSafe(F.col(origin))

    def taken(rows: DataFrame, number: Column) -> DataFrame:
        return rows.withColumn(times, F.col(whole) + F.when(number <= F.col(more), 1).otherwise(0)).select(*docs.columns, times)

    out = taken(keyed.join(groups.where(F.col(n) == 1), same), F.lit(1))
    repeated = groups.where(F.col(n) > 1)
    if not repeated.isEmpty():
        # rows of repeated groups are numbered within parts, and parts by what comes before them; written, so that both agree
        parts = F.pmod(F.monotonically_increasing_id(), F.floor((F.col(n) - 1) / ROWS_PER_RANGE) + 1)
        rows = materialize(keyed.join(repeated, same).withColumn(part, parts), "repeated")
        by = [left, right, origin]
        before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(*by, part).agg(F.count(F.lit(1)).alias(times)).withColumn(first, F.coalesce(F.sum(times).over(before), F.lit(0)))
        counts = counts.select(F.col(left).alias(own_left), F.col(right).alias(own_right), F.col(origin).alias(part_of), F.col(part).alias(times), first)
        rows = rows.drop(own_left, own_right)
        near = (F.col(left) == F.col(own_left)) & (F.col(right) == F.col(own_right)) & F.col(origin).eqNullSafe(F.col(part_of)) & (F.col(part) == F.col(times))
        number = F.col(first) + F.row_number().over(Window.partitionBy(*by, part).orderBy(F.lit(0)))
        numbered = rows.join(counts, near).withColumn(n, number).drop(times)
        out = out.unionByName(taken(numbered, F.col(n)))
    return out.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)
