"""Quality by hierarchical empirical Bayes.

The text's own evidence is a naive Bayes log-odds over binned measures of its form. A document's site brings a prior: the global
rate of good documents, updated by the host's labels, updated again by those of each level of its path, every level shrunk toward
the one above it by a strength estimated from the spread of that level's rates, so a site with few labels stays near the
sites around it. Everything is learned by grouped aggregation over all labelled rows. A labelled row is judged without its
own labels, so its scores are those of a row that was held out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import written

BINS = 20
MEASURES = ("marks", "capitals", "digits", "distinct", "word_length", "line_length", "length")


def magnitude(n: Column) -> Column:
    """floor(log2(n)) of a positive integer."""
    return F.length(F.bin(n)) - 1


def measures(text: Column) -> list[Column]:
    """Each measure of a text's form in BINS + 1 bins; an empty text is in bin 0 of all."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n
    binned = lambda x: F.least(F.lit(BINS), F.floor(x)).cast("int")
    return [
        binned(share("[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+") * BINS * 2).alias("marks"),
        binned(share("\\p{Lu}+") * BINS).alias("capitals"),
        binned(share("\\p{N}+") * BINS).alias("digits"),
        binned(F.size(F.array_distinct(words)) / n_words * BINS).alias("distinct"),
        binned(n / n_words).alias("word_length"),
        binned(magnitude(F.greatest(F.lit(1), F.floor(n / F.size(F.split(text, "\n")))))).alias("line_length"),
        binned(magnitude(n)).alias("length"),
    ]


def site_levels(url: Column, depth: int = 2) -> list[Column]:
    """Host and the first ``depth`` directories of a URL, as levels for ``classify``; null where a URL has none or is none."""
    host, path = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.split(path, "/")
    return [F.when(host != "", host), *(F.when(F.size(parts) > i + 1, F.get(parts, F.lit(i))) for i in range(depth))]


def _groups(labelled: DataFrame, keys: list[str]) -> tuple[DataFrame, float]:
    """(keys, k, n, p) with the labels of each group and the rate above it, and the strength of the rate above.

    The strength is the method-of-moments one, mean (p (1 - p)) over the variance between groups that sampling does not
    explain, between 1 and 1000 labels; without a second group it is 10.
    """
    groups = written(labelled.groupBy(*keys).agg(F.sum("good").alias("k"), F.count(F.lit(1)).alias("n"), F.avg("above").alias("p")))
    rate = F.col("k") / F.col("n")
    within = F.col("p") * (1 - F.col("p"))
    spread = groups.agg(F.sum(F.col("n") * (rate - F.col("p")) ** 2).alias("between"), F.sum(within).alias("expected"), F.sum("n").alias("labels"), F.sum(F.col("n") * within).alias("weight"), F.count(F.lit(1)).alias("groups"))
    between = F.greatest((F.col("between") - F.col("expected")) / F.col("labels"), F.lit(1e-9))
    strength = F.when(F.col("groups") > 1, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("weight") / F.col("labels") / between))).otherwise(F.lit(10.0))
    return groups, spread.select(strength).first()[0]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _with_groups(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``df`` with k, n and p of its group; null keys are a group of their own."""
    right = groups.select(*(F.col(c).alias(f"of_{c}") for c in keys), "k", "n", "p")
    return df.join(right, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys)), how).drop(*(f"of_{c}" for c in keys))


def classify(docs: DataFrame, labels: DataFrame, levels: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", smoothing: float = 1.0) -> DataFrame:
    """doc_id, evidence (log-odds of the text), prior (rate of its site), p_good and good for each row of ``docs``.

    ``levels`` are the site's levels from the host down, by default ``source``, ``lang`` within it, and the magnitude of the text's
    length within that; ``site_levels`` makes them from a URL. A null is a value of its own on every level. ``labels`` has ids and
    0 or 1; null labels and ids without a document are left out, and an id with several labels counts as often. A level
    without labels takes the rate above it, a host without labels the global one; without any label the prior is 0.5
    and the evidence 0. Null and empty texts, null ids and repeated rows are answered like any others; no rows give no rows.
    """
    levels = [F.col("source"), F.col("lang"), magnitude(F.greatest(F.length(F.coalesce(text_col, F.lit(""))), F.lit(1)))] if levels is None else levels
    names = [f"level_{i}" for i in range(len(levels))]
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), *(x.cast("string").alias(c) for c, x in zip(names, levels, strict=True)), *measures(F.col(text_col))))
    truth = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("good"))
    labelled = written(rows.join(truth, "doc_id"))
    overall = labelled.agg(F.sum("good"), F.count(F.lit(1))).first()
    good, n = overall[0] or 0, overall[1]
    own = truth.groupBy("doc_id").agg(F.sum("good").alias("own_good"), F.count(F.lit(1)).alias("own_n"))
    out = rows.join(own, "doc_id", "left").fillna(0, ["own_good", "own_n"])
    own_good, own_n = F.col("own_good"), F.col("own_n")
    rate = (good - own_good + smoothing) / (n - own_n + 2 * smoothing)
    # naive Bayes: a row for each measure and bin, at most 7 x 21
    bins = labelled.select("good", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in MEASURES))).alias("x")).groupBy("x.measure", "x.bin").agg(F.sum("good").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    evidence = F.lit(0.0)
    for m in MEASURES:
        known = [x for r in bins if r["measure"] == m for x in (F.lit(r["bin"]), F.struct(F.lit(r["k"]).alias("k"), F.lit(r["n"]).alias("n")))]
        if known:
            bin_ = F.element_at(F.create_map(*known), F.col(m))
            yes = (bin_["k"] - own_good + smoothing * rate) / (good - own_good + smoothing)
            no = (bin_["n"] - bin_["k"] - (own_n - own_good) + smoothing * (1 - rate)) / (n - good - (own_n - own_good) + smoothing)
            evidence = evidence + F.coalesce(F.log(yes / no), F.lit(0.0))
    out = out.select("doc_id", *names, "own_good", "own_n", evidence.alias("evidence"), rate.alias("prior"))
    labelled = labelled.select("good", *names, F.lit((good + smoothing) / (n + 2 * smoothing)).alias("above"))
    for i in range(len(names)):
        keys = names[: i + 1]
        groups, strength = _groups(labelled, keys)
        posterior = (F.col("k") + strength * F.col("p")) / (F.col("n") + strength)
        labelled = _with_groups(labelled, groups, keys, "inner").select("good", *names, posterior.alias("above"))
        shrunk = (F.col("k") - own_good + strength * F.col("prior")) / (F.col("n") - own_n + strength)
        out = _with_groups(out, groups, keys).select("doc_id", *names, "own_good", "own_n", "evidence", F.coalesce(shrunk, F.col("prior")).alias("prior"))
    p = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("prior")))))
    return out.select("doc_id", "evidence", "prior", p.alias("p_good")).withColumn("good", F.col("p_good") >= 0.5)
