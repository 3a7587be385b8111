"""What each of five filters removes, alone, in any order, and as its Shapley share, for every part of a corpus.

Whether filters remove a document depends on the set of filters only, not on their order. One pass over the texts gives each
document five bits; counts by bits then say for each of the 32 coalitions of filters how many documents it removes. From those
follow all 120 orders, whose steps are differences of coalitions, and the shares, which are differences of the Hart and
Mas-Colell potential: P of no filter is 0, and P(S) is the mean over S of P without one filter, plus removed(S) by |S|.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, only, settle

FILTERS = "ABCDE"
#: Fewer words, a smaller percentage of distinct words, or a larger percentage of capitals fail.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
#: The parts' potentials are kept times 60, the least multiple of the sizes of coalitions: integers, without rounding.
SCALE = 60
EVERY = (1 << len(FILTERS)) - 1


def _text_bits(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * n.cast("long"), 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, failed filters and labels: (part, bits, good, toxic, n).

    Of rows with one text, all but those of the smallest doc_id fail E. Copies are counted by text, id and labels before they
    meet, so that the most frequent text is a few rows from each task.
    """
    text = F.coalesce("text", F.lit(""))
    read = only(docs, "doc_id", "lang", "text").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), _text_bits(text).alias("bits"))
    marks = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # the stored marks let a doc_id that many rows repeat be split when the join runs; rows without one don't take part in it
    joined = read.where("doc_id is not null").join(settle(marks, "marks"), "doc_id", "left")
    flagged = settle(
        joined.unionByName(read.where("doc_id is null"), allowMissingColumns=True).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}),
        "failed-filters",
    )
    kind = ["same", "part", "bits", "good", "toxic"]
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    by_text = (
        flagged.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*kind).agg(F.min(rank).alias("first"), F.min_by("n", rank).alias("firsts"), F.sum("n").alias("n"))
    )
    stay = F.when(F.col("first") == F.min("first").over(Window.partitionBy("same")), F.col("firsts")).otherwise(0)
    split = by_text.withColumn("stay", stay).select("part", "good", "toxic", F.inline(F.array(F.struct("bits", F.col("stay").alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - F.col("stay")).alias("n")))))
    return split.where("n > 0").groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows per part: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A part is a value of lang; null and the empty string are one part. Null text counts as empty, which fails A. Of rows with
    one text those of the smallest doc_id pass E, repeated rows alike; a null doc_id comes after all numbers. Of several
    labels of one doc_id any that says 1 counts; labels of null ids or of no document don't. Further columns are ignored. No
    documents give no rows.
    """
    size = F.sum("n")
    removed = lambda which=F.lit(True): F.coalesce(F.sum(F.when(which & (F.col("bits").bitwiseAND(F.col("coalition")) != 0), F.col("n"))), F.lit(0))
    coalitions = (
        _counted(docs, labels).withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(EVERY)))).groupBy("part", "coalition")
        .agg(size.alias("size"), removed().alias("docs"), removed(F.col("good")).alias("good"), removed(F.col("toxic")).alias("toxic"))
        .groupBy("part").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("coalition", "docs", "good", "toxic"))).alias("game"))
    )
    without = "aggregate(sequence(0, 4), 0L, (t, i) -> t + if((s & shiftleft(1, i)) = 0, 0L, p[s ^ shiftleft(1, i)]))"
    potential = F.expr(f"aggregate(sequence(1, {EVERY}), array(0L), (p, s) -> array_append(p, ({SCALE} * game[s].docs + {without}) div bit_count(s)))")
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)]))
    bit = lambda letter: f"shiftleft(1, ascii({letter}) - {ord(FILTERS[0])})"
    steps = (
        coalitions.withColumn("potential", potential).withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("own", F.expr(bit("substring(filter_order, step, 1)")))
        .withColumn("before", F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (t, k) -> if(k < step, t | {bit('substring(filter_order, k, 1)')}, t))"))
        .withColumns({"at": F.expr("game[before | own]"), "was": F.expr("game[before]")})
    )
    return steps.select(
        "part", "filter_order", "step", (F.col("size") - F.col("at.docs")).alias("kept"), (F.col("at.docs") - F.col("was.docs")).alias("removed"),
        F.expr("game[own].docs - at.docs + was.docs").alias("redundant"), F.expr(f"game[{EVERY}].docs - game[{EVERY} ^ own].docs").alias("unique_fails"),
        (F.col("at.good") - F.col("was.good")).alias("good_lost"), (F.col("at.toxic") - F.col("was.toxic")).alias("toxic_lost"),
        F.expr(f"(potential[{EVERY}] - potential[{EVERY} ^ own]) * {120 // SCALE}L").alias("shapley"),
    )
