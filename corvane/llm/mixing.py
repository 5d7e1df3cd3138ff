"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target in words, and every document its own expected number of copies: the source's rate, target over
size, tilted toward longer documents so that the words expected of all documents still sum to the target. The whole part
of that number is certain copies. The fraction p is an inclusion probability of a fixed-size unequal-probability sample:
documents are ranked by their random odds u / (1 - u) divided by the inclusion odds p / (1 - p), and taken in that order
until their words meet what the certain copies leave of the target. The rank is found without sorting a source in one task:
sums over slices of the rank scale locate the one slice in which a source's rest is met, and only that slice is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import WORD
from corvane.session import written

#: Slices of a source's rank scale; the slice that is ordered holds about this part of the source.
SLICES = 4096


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn and divide ``share`` of all words by weight. A
    target stops at ``most`` times its source; the excess is shared by weight again among the others, until none is
    above. In order of cap over weight the capped sources come first, so one running sum finds the final level. The
    running sums see one row per source, not documents, in one task.
    """
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    words_left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    level = ranked.withColumn("level", words_left / weight_left)
    level = level.withColumn("final", F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return level.select("source", "source_size", target.alias("target"))


def copies_expected(size: Column, rate: Column, middle: Column, widest: Column, tilt: float, most: int) -> Column:
    """The expected copies of a document: ``rate``, and up to ``tilt`` of the way from it to 0 or ``most`` by how long the document is.

    ``middle`` is the mean of ``length_class`` over the source's words and ``widest`` its largest distance to that, so the words
    expected of a source are ``rate`` times its size, and none is below 0 or above ``most``.
    """
    lean = F.when(widest > 0, (length_class(size) - middle) / widest).otherwise(0.0)
    return rate + tilt * F.least(rate, most - rate) * lean


def length_class(size: Column) -> Column:
    """Thousandths of the natural logarithm of size + 1, as an integer, so that sums over a source don't depend on their order."""
    return F.floor(F.log(size + 1) * 1000).cast("long")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size) of all rows, written, so that texts are split once."""
    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))


def _decided(docs: DataFrame, id_of: Column, source: Column, size: Column, rows: DataFrame, share: float, weights: tuple[int, ...], most: int, seed: str, tilt: float) -> DataFrame:
    """The rows of ``docs`` with their size, their source's size and target, expected copies and copies, in columns of our own.

    ``rows`` are their ids, sources and sizes; everything about a source comes from these.
    """
    x = length_class(F.col("size"))
    sums = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * x).alias("weighed"), F.min(x).alias("low"), F.max(x).alias("high")))
    middle = F.when(F.col("source_size") > 0, F.col("weighed") / F.col("source_size")).otherwise(0.0)
    same = lambda left, right: F.col(left).eqNullSafe(F.col(right))
    aims = targets(sums.select("source", "source_size"), share, weights, most).withColumnRenamed("source", "of")
    aims = aims.join(sums.drop("source_size"), same("of", "source")).select("of", "source_size", "target", middle.alias("middle"), F.greatest(F.col("high") - middle, middle - F.col("low")).alias("widest"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = written(aims.withColumn("rate", rate).select([F.col(c).alias(f"__corvane_{c}") for c in ("of", "source_size", "target", "middle", "widest", "rate")]))

    def ranked(df: DataFrame, key: Column, source: Column, size: Column) -> DataFrame:
        digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
        # a generated column is made once a row; as a plain one it would be split again in every condition below
        df = df.select("*", F.explode(F.array(F.struct(size.alias("size"), digest.alias("draw")))).alias("__corvane_row"))
        df = df.withColumns({"__corvane_size": F.col("__corvane_row.size"), "__corvane_draw": F.col("__corvane_row.draw")}).drop("__corvane_row").join(aims, source.eqNullSafe(F.col("__corvane_of")))
        df = df.withColumn("__corvane_expected", copies_expected(*(F.col(f"__corvane_{c}") for c in ("size", "rate", "middle", "widest")), tilt, most))
        df = df.withColumn("__corvane_whole", F.floor("__corvane_expected").cast("long"))
        u, p = (F.col("__corvane_draw") + 0.5) / F.lit(float(1 << 52)), F.col("__corvane_expected") - F.col("__corvane_whole")
        df = df.withColumn("__corvane_rank", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
        return df.withColumn("__corvane_slice", F.floor(F.col("__corvane_rank") / (1 + F.col("__corvane_rank")) * SLICES))

    small = ranked(rows, F.col("doc_id"), F.col("source"), F.col("size"))
    inside = F.coalesce(F.sum(F.when(F.col("__corvane_rank").isNotNull(), F.col("__corvane_size"))), F.lit(0))
    sliced = small.groupBy("__corvane_of", "__corvane_slice").agg(inside.alias("inside"), F.sum(F.col("__corvane_whole") * F.col("__corvane_size")).alias("certain"), F.any_value("__corvane_target").alias("target"))
    of_source = Window.partitionBy("__corvane_of")
    upto = of_source.orderBy(F.col("__corvane_slice").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    sliced = sliced.withColumns({"rest": F.greatest(F.lit(0.0), F.col("target") - F.sum("certain").over(of_source)), "before": F.sum("inside").over(upto) - F.col("inside")})
    edge = sliced.where((F.col("__corvane_slice").isNotNull()) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("inside")))
    edge = written(edge.select([F.col(c).alias(f"__corvane_{n}") for c, n in (("__corvane_of", "cut"), ("__corvane_slice", "edge"), ("before", "before"), ("rest", "rest"))]))
    placed = ranked(docs, id_of, source, size).join(edge, same("__corvane_of", "__corvane_cut"), "left")
    slice_, edge_ = F.col("__corvane_slice"), F.col("__corvane_edge")
    beside = placed.where(slice_.isNull() | edge_.isNull() | (slice_ != edge_)).withColumn("__corvane_copies", F.col("__corvane_whole") + F.when(slice_ < F.coalesce(edge_, F.lit(SLICES + 1)), 1).otherwise(0))
    ahead = Window.partitionBy("__corvane_of").orderBy("__corvane_rank", "__corvane_draw", id_of.asc_nulls_last(), "__corvane_size").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.where(slice_ == edge_).withColumn("__corvane_sum", F.col("__corvane_before") + F.coalesce(F.sum("__corvane_size").over(ahead), F.lit(0)))
    within = within.withColumn("__corvane_copies", F.col("__corvane_whole") + F.when(F.col("__corvane_sum") * 2 + F.col("__corvane_size") <= F.col("__corvane_rest") * 2, 1).otherwise(0))
    return beside.unionByName(within.drop("__corvane_sum"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2, seed: str = "mix", tilt: float = 0.5) -> DataFrame:
    """doc_id, source, size, source_size, target, expected, copies and taken (words, repeats counted) for each row of ``docs``.

    The size is the number of words, 0 for a null or empty text. ``expected`` copies lie between 0 and ``most`` and rise with a
    document's length by ``tilt`` (0: the same for all documents of a source). Documents are taken whole, so a source's words
    differ from its target by at most half of one document. Randomness is a digest of ``seed`` and the id: reruns agree; rows with equal
    ids share a draw and are decided each for itself, the smaller first, so only identical rows are interchangeable. A null
    source is a source, a null id an id like any other. Documents of size 0 have taken 0. No rows give no rows; other
    columns are not read.
    """
    rows = _measured(docs, id_col, text_col, source_col)
    out = _decided(rows, F.col("doc_id"), F.col("source"), F.col("size"), rows, share, weights, most, seed, tilt)
    own = [F.col(f"__corvane_{c}").alias(c) for c in ("size", "source_size", "target", "expected", "copies")]
    return out.select("doc_id", "source", *own, (F.col("__corvane_copies") * F.col("__corvane_size")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2, seed: str = "mix", tilt: float = 0.5) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns untouched; every row is decided where it lies, as in ``mix``."""
    rows = _measured(docs, id_col, text_col, source_col)
    taken = _decided(docs, F.col(id_col).cast("long"), F.col(source_col), words(F.col(text_col)), rows, share, weights, most, seed, tilt).where("__corvane_copies > 0")
    return taken.withColumn("__corvane_again", F.explode(F.array_repeat(F.lit(0), F.col("__corvane_copies").cast("int")))).select(*docs.columns)
