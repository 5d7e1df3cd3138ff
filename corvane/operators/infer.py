"""Contributors, timelines, subsystems, decisions and evidence as rules over tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as tx
from corvane.operators import graph
from corvane.session import written

# Weights of a contributor's signals, half-life of activity in days, labels of knowledge.
WEIGHTS = {"authored": 0.30, "reviews": 0.20, "commits": 0.15, "subsystem_files": 0.20, "recency": 0.15}
HALF_LIFE = 90.0
LABELS = {"model_inference": "Inferred", "artifact": "Observed", "source_span": "Observed"}


def contributor_activity(commits: DataFrame, commit_files: DataFrame, reviews: DataFrame) -> DataFrame:
    """(contributor_id, authored, reviews, subsystem_files, last_activity) of everyone who authored or reviewed."""
    authored = commits.groupBy(F.col("author_id").alias("contributor_id")).agg(F.count(F.lit(1)).alias("authored"), F.max("ts").alias("last_activity"))
    reviewed = reviews.groupBy(F.col("reviewer_id").alias("contributor_id")).agg(F.count(F.lit(1)).alias("reviews"))
    files = commits.join(commit_files, "sha").groupBy(F.col("author_id").alias("contributor_id")).agg(F.count_distinct("file_id").alias("subsystem_files"))
    out = authored.join(reviewed, "contributor_id", "full_outer").join(files, "contributor_id", "left")
    return out.select("contributor_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("authored", "reviews", "subsystem_files")), "last_activity")


def recency(last: Column, as_of: str) -> Column:
    """halves every HALF_LIFE days; 0 without activity."""
    days = F.greatest(F.datediff(F.lit(as_of).cast("date"), last.cast("date")), F.lit(0))
    return F.coalesce(F.pow(F.lit(0.5), days / HALF_LIFE), F.lit(0.0))


def contributor_score(activity: DataFrame, as_of: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of the signals, each over its maximum; authored commits stand for both authored signals."""
    top = activity.agg(*(F.max(c).alias(f"max_{c}") for c in ("authored", "reviews", "subsystem_files")))  # one row
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col(f"max_{c}")), F.lit(0.0))
    parts = (weights["authored"] + weights["commits"]) * share("authored") + weights["reviews"] * share("reviews") + weights["subsystem_files"] * share("subsystem_files")
    total = parts + weights["recency"] * recency(F.col("last_activity"), as_of)
    return activity.crossJoin(F.broadcast(top)).select("contributor_id", F.round(total + 1e-9, 6).alias("score"))


def contributor_by_subsystem(commits: DataFrame, commit_files: DataFrame, members: DataFrame) -> DataFrame:
    """(subsystem, contributor_id, n) changed files."""
    touched = commits.join(commit_files, "sha").join(members, "file_id")
    return touched.groupBy("subsystem", F.col("author_id").alias("contributor_id")).agg(F.count(F.lit(1)).alias("n"))


def top_per(counts: DataFrame, group: str, item: str) -> DataFrame:
    """Each group's item of the highest n, ties to the smallest."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return counts.withColumn("place", place).where("place = 1").drop("place")


def subsystem_rollup(members: DataFrame, edge_table: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Files, top dependency, top contributor and last activity of each subsystem."""
    files = members.groupBy("subsystem").agg(F.count(F.lit(1)).alias("n_files"))
    edges = graph.subsystem_edges(edge_table, members).select(F.col("src_subsystem").alias("subsystem"), F.col("dst_subsystem").alias("top_dependency"), F.col("n_edges").alias("n"))
    people = top_per(contributor_by_subsystem(commits, commit_files, members), "subsystem", "contributor_id").select("subsystem", F.col("contributor_id").alias("top_contributor"))
    last = commits.join(commit_files, "sha").join(members, "file_id").groupBy("subsystem").agg(F.max("ts").alias("last_activity"))
    return files.join(top_per(edges, "subsystem", "top_dependency").drop("n"), "subsystem", "left").join(people, "subsystem", "left").join(last, "subsystem", "left")


def timeline(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(event_ts, event_type, event_id) of all kinds; each source names its time and id columns."""
    parts = [df.select(F.col(at).alias("event_ts"), F.lit(kind).alias("event_type"), F.col(key).cast("string").alias("event_id")) for kind, (df, at, key) in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def timeline_filter(events: DataFrame, since: str | None = None, types: tuple[str, ...] | None = None, until: str | None = None, **values: tuple) -> DataFrame:
    """By time, type, and values of other columns such as ``subsystem`` or ``contributor_id``; a null value never fits."""
    events = events.where(F.col("event_ts") >= F.lit(since).cast("timestamp_ntz")) if since else events
    events = events.where(F.col("event_ts") < F.lit(until).cast("timestamp_ntz")) if until else events
    events = events.where(F.col("event_type").isin(*types)) if types else events
    return reduce(lambda df, c: df.where(F.col(c[0]).isin(*c[1])), values.items(), events)


def per_period(events: DataFrame, period: str = "week") -> DataFrame:
    """A10."""
    start = F.date_trunc(period, F.col("event_ts").cast("timestamp")).cast("timestamp_ntz")
    return events.groupBy(start.alias(period), "event_type").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str) -> DataFrame:
    """A5: counts and shares of a column's values."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n_files"))
    return counts.withColumn("share", F.round(F.col("n_files") / F.sum("n_files").over(Window.partitionBy()), 6))


def detail(base: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``base`` with n_<kind> and first_<kind> (the smallest, null if none) of each kind of child; each kind names its key and value columns.

    Counted before they are joined, so a key of any number of children is one row in any task. Rows with a null value are no children.
    """
    for kind, (df, own, value) in children.items():
        counted = df.groupBy(F.col(own).alias(key)).agg(F.count(value).alias(f"n_{kind}"), F.min(value).alias(f"first_{kind}"))
        base = base.join(counted, key, "left").withColumn(f"n_{kind}", F.coalesce(f"n_{kind}", F.lit(0)).cast("long"))
    return base


def detail_children(key: str, children: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(key, kind, value as text), a row for each child that ``detail`` counts: a list of any length without an array."""
    return reduce(DataFrame.unionByName, (df.where(F.col(value).isNotNull()).select(F.col(own).alias(key), F.lit(kind).alias("kind"), F.col(value).cast("string").alias("value")) for kind, (df, own, value) in children.items()))


def _pieces(names: list[str], types: list[pa.DataType]):
    """Sorted rows (key, kind, value, lines) as (key, kind, low, high, first, n, text): a row for each key and kind in a batch, with all their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, values, lines = (c.to_pylist() for c in batch.columns)
            out, at = [], 0
            for (key, kind), same in groupby(zip(keys, kinds)):
                to = at + sum(1 for _ in same)
                parts = [x for v, each in zip(values[at:to], lines[at:to]) for x in (each or (v,))]
                out.append((key, kind, values[at], values[to - 1], parts[0], len(parts), "\n".join(parts)))
                at = to
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def nested(base: DataFrame, key: str, children: dict[str, tuple]) -> DataFrame:
    """A row for each text ``key`` of ``base`` with n_<kind>, first_<kind> and <kind>: all children of the kind in order, a line each (null if none).

    A kind may name a fourth column, an array of lines that a row stands for instead of its value, which then only gives the order. All
    children are sorted once over all tasks and become pieces of text of a batch each, whatever key has most of them; only the
    pieces, which a key's row must hold, come together by key. Pieces of a sorted table are in the order of their ends.
    """
    each = lambda df, lines=None: df[lines] if lines else F.lit(None).cast("array<string>")
    rows = [df.where(F.col(value).isNotNull()).select(F.col(own).alias(key), F.lit(kind).alias("kind"), F.col(value).cast("string").alias("value"), each(df, *lines).alias("lines")) for kind, (df, own, value, *lines) in children.items()]
    rows = written(graph.union(*rows).join(base.select(F.col(key).alias("_own")), F.col(key).eqNullSafe(F.col("_own")), "left_semi"))
    names = [key, "kind", "low", "high", "first", "n", "text"]
    kinds = ["long" if c == "n" else "string" for c in names]
    order = [key, "kind", "value"]
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(names, [pa.int64() if c == "long" else pa.string() for c in kinds]), ", ".join(f"{c} {t}" for c, t in zip(names, kinds)))
    known = base.select(key, *(F.lit(None).cast(t).alias(c) for c, t in list(zip(names, kinds))[1:]))
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    counts = [F.coalesce(F.sum(of(k, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{k}") for k in children]
    out = pieces.unionByName(known).groupBy(key).agg(*counts, *(F.array_sort(F.collect_list(of(k, F.struct("low", "high", "first", "text")))).alias(k) for k in children))
    columns = [c for k in children for c in (F.col(f"n_{k}"), F.get(k, F.lit(0))["first"].alias(f"first_{k}"), F.when(F.size(k) > 0, F.array_join(F.transform(k, lambda x: x["text"]), "\n")).alias(k))]
    return out.select(key, *columns)


def subsystem_status(signals: DataFrame, thresholds: dict[str, float], least: int = 2, confidence: float = 0.55) -> DataFrame:
    """Shares of each ``<name>_signal`` column; confirmed with ``least`` agreeing signals and enough mean confidence."""
    shares = signals.groupBy("subsystem").agg(F.count(F.lit(1)).alias("n_files"), *(F.round(F.avg(F.col(f"{s}_signal").cast("int")), 6).alias(f"{s}_share") for s in thresholds))
    agreeing = reduce(lambda a, b: a + b, ((F.col(f"{s}_share") >= v).cast("int") for s, v in thresholds.items()))
    mean = reduce(lambda a, b: a + b, (F.col(f"{s}_share") for s in thresholds)) / len(thresholds)
    out = shares.withColumns({"agreeing": agreeing, "confidence": mean})
    return out.withColumn("status", F.when((F.col("agreeing") >= least) & (F.col("confidence") >= confidence), "confirmed").otherwise("candidate"))


def architecture(subsystems: DataFrame, files: DataFrame) -> DataFrame:
    """Confirmed subsystems, or directories where there is none."""
    good = subsystems.where("status = 'confirmed'")
    none = good.agg(F.count(F.lit(1)).alias("n")).where("n = 0")  # one row at most
    return good.select("subsystem", F.lit("subsystem").alias("basis")).unionByName(files.select(F.col("directory").alias("subsystem")).distinct().crossJoin(F.broadcast(none)).select("subsystem", F.lit("directory").alias("basis")))


def combined_evidence(evidence: DataFrame, keys: list[str], kind: str = "evidence_type", model: str = "model_inference") -> DataFrame:
    """Evidence counts, and 1 - product of (1 - confidence); a certain piece makes the whole certain."""
    c = F.col("confidence")
    product = F.exp(F.sum(F.when(c < 1, F.log(1 - c))))
    return evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if(F.col(kind) != model).alias("n_firm"), F.round(F.when(F.max(c) >= 1, 1.0).otherwise(1 - product) + 1e-9, 6).alias("combined"), F.count_distinct(kind).alias("hops"))


def decision_status(evidence: DataFrame) -> DataFrame:
    """Status of each decision from its evidence; model output alone never confirms."""
    out = combined_evidence(evidence, ["decision_id"]).withColumn("chain", F.round(F.col("hops") / 4, 6))
    status = F.when(F.col("n_firm") == 0, "insufficient_evidence").when((F.col("combined") >= 0.8) & (F.col("n_firm") >= 2), "confirmed").when(F.col("combined") < 0.2, "rejected").otherwise("candidate")
    return out.withColumn("status", status)


def decision_rules(evidence: DataFrame) -> DataFrame:
    """``decision_status`` by all rules: evidence also has ``part`` (context, action or another) and ``contradicts``.

    Confirmed needs firm evidence (not of a model) of the context and of the action, two firm rows in all, enough combined confidence, and no
    stronger contradiction: firm contradicting evidence whose combined confidence is above that of the support rejects. A null ``contradicts``
    is support; without any firm support a decision is insufficient_evidence whatever speaks against it.
    """
    against = F.coalesce("contradicts", F.lit(False))
    firm = F.coalesce(F.col("evidence_type") != "model_inference", F.lit(False))
    support = combined_evidence(evidence.where(~against), ["decision_id"]).select("decision_id", "n_evidence", "n_firm", "combined")
    contrary = combined_evidence(evidence.where(against & firm), ["decision_id"]).select("decision_id", F.col("combined").alias("against"))
    has = lambda part: F.coalesce(F.bool_or(firm & ~against & (F.col("part") == part)), F.lit(False))
    out = evidence.groupBy("decision_id").agg(has("context").alias("has_context"), has("action").alias("has_action"))
    out = out.join(support, "decision_id", "left").join(contrary, "decision_id", "left").fillna(0, ["n_evidence", "n_firm"]).fillna(0.0, ["combined", "against"])
    whole = F.col("has_context") & F.col("has_action") & (F.col("combined") >= 0.8) & (F.col("n_firm") >= 2)
    status = F.when(F.col("n_firm") == 0, "insufficient_evidence").when((F.col("against") > F.col("combined")) | (F.col("combined") < 0.2), "rejected").when(whole, "confirmed").otherwise("candidate")
    return out.withColumn("status", status)


def confidence_band(c: Column) -> Column:
    """P10."""
    return F.when(c >= 0.80, "high").when(c >= 0.55, "medium").otherwise("low")


def knowledge_label(kind: Column) -> Column:
    """P16."""
    return F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[kind]


def publishable(items: DataFrame, evidence: DataFrame, least: float, kinds: tuple[str, ...], statuses: tuple[str, ...] = ("confirmed",)) -> DataFrame:
    """Items of a known kind, with enough confidence, provenance and evidence, verified, and with a status that may be shown.

    By default that is ``confirmed`` only. A null in any of these columns keeps an item back.
    """
    good = items.where((F.col("confidence") >= least) & F.col("evidence_type").isin(*kinds) & F.col("provenance").isNotNull() & F.col("verified") & F.col("status").isin(*statuses))
    return good.join(evidence.select("decision_id"), "decision_id", "left_semi")


def statistics(kinds: dict[str, DataFrame]) -> DataFrame:
    """A4: (kind, n) of the rows of each kind."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, df in kinds.items()))


def commit_chain(commits: DataFrame, commit_files: DataFrame, reviews: DataFrame) -> DataFrame:
    """What hangs on each commit, and the part of its chain that is there."""
    files = commit_files.groupBy("sha").agg(F.count_distinct("file_id").alias("n_files"))
    people = reviews.groupBy("sha").agg(F.count_distinct("reviewer_id").alias("n_reviewers"))
    out = commits.select("sha").join(files, "sha", "left").join(people, "sha", "left").fillna(0, ["n_files", "n_reviewers"])
    hops = 1 + (F.col("n_files") > 0).cast("int") + (F.col("n_reviewers") > 0).cast("int")
    return out.withColumn("completeness", F.round(hops / 3, 6))


def topics(docs: DataFrame, cluster: str, text_col: str, k: int) -> DataFrame:
    """The ``k`` terms of each cluster with the highest tf-idf over clusters, ties by term."""
    tf = docs.select(cluster, F.explode(tx.tokens(F.col(text_col))).alias("term")).groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct(cluster).alias("n"))  # one row
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", F.round(F.col("tf") * F.log((1 + F.col("n")) / F.col("df")), 4))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("weight"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select(cluster, "term", "tf", "weight", "place")


def activity_wording(commits: DataFrame, as_of: str) -> DataFrame:
    """last activity, its recency, and a sentence that claims no more than the data."""
    out = commits.groupBy(F.col("author_id").alias("contributor_id")).agg(F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("n"))
    return out.select(
        "contributor_id",
        "last_activity",
        F.datediff(F.lit(as_of).cast("date"), F.col("last_activity").cast("date")).alias("days"),
        F.round(recency(F.col("last_activity"), as_of), 6).alias("recency"),
        F.date_format(F.col("last_activity").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_iso"),
        F.format_string("The available activity suggests %d commits", "n").alias("wording"),
    )


def semantic_cohesion(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean cosine of each subsystem's vectors (file_id, embedding) to their centroid."""
    rows = members.join(vectors, "file_id")
    mean = rows.select("subsystem", F.posexplode("embedding").alias("i", "x")).groupBy("subsystem", "i").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("subsystem").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("centroid"))
    return rows.join(centre, "subsystem").groupBy("subsystem").agg(F.round(F.avg(tx.cosine(F.col("embedding"), F.col("centroid"))), 6).alias("cohesion"))


def link_artifacts(artifacts: DataFrame, targets: DataFrame) -> DataFrame:
    """(artifact_id, number) for each ``#number`` in the text that names a target."""
    named = artifacts.select("artifact_id", F.explode(tx.issue_references(F.col("text"))).alias("number")).select("artifact_id", F.col("number").try_cast("long").alias("number")).distinct()
    return named.join(targets.select("number"), "number", "left_semi").select("artifact_id", "number")


def release_contents(releases: DataFrame, targets: DataFrame) -> DataFrame:
    """RELEASE_INCLUDES from explicit references in release notes (id, notes)."""
    return link_artifacts(releases.select(F.col("id").alias("artifact_id"), F.col("notes").alias("text")), targets)


def decision_candidates(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts (artifact_id, kind) grouped by links (src, dst); each group's artifact of the most authoritative kind leads."""
    rank = F.create_map(*(F.lit(x) for pair in (("adr", 1), ("discussion", 2), ("pull_request", 3), ("issue", 4), ("commit", 5)) for x in pair))
    parts = graph.components(links).select(F.col("node").alias("artifact_id"), F.col("component").alias("candidate_id"))
    ranked = artifacts.join(parts, "artifact_id").withColumn("authority", rank[F.col("kind")])
    return ranked.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_artifacts"), F.min_by("artifact_id", F.struct("authority", "artifact_id")).alias("lead_id"))


def evidence_paths(issues: DataFrame, pull_requests: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """(issue_id, pr_id, sha, file_id, path, completeness) of each chain from an issue over pull request and commit to a file.

    ``pull_requests`` names its issue_id, ``commits`` (sha) its pr_id, ``files`` (file_id) its sha. A chain ends where its next link is
    missing: ``path`` holds what there is, ``completeness`` is its part of the four hops.
    """
    out = issues.select("issue_id").join(pull_requests.select("issue_id", "pr_id"), "issue_id", "left")
    out = out.join(commits.select("pr_id", "sha"), "pr_id", "left").join(files.select("sha", "file_id"), "sha", "left")
    hop = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")))
    path = F.array_compact(F.array(hop("issue", "issue_id"), hop("pull_request", "pr_id"), hop("commit", "sha"), hop("file", "file_id")))
    return out.select("issue_id", "pr_id", "sha", "file_id", path.alias("path"), F.round(F.size(path) / 4, 6).alias("completeness"))


def attach_evidence(items: DataFrame, evidence: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """Items (nodes, edges, sections or claims) with n_evidence, their combined confidence, and their best evidence.

    All pieces (keys, evidence_id, confidence) count; the array lists the ``most`` of the highest confidence, so it stays small
    for an item that everything points to.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "evidence_id"))
    best = evidence.withColumn("place", place).where(F.col("place") <= most).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "evidence_id", "confidence"))).alias("evidence"))
    c = F.col("confidence")
    counts = evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_evidence"), F.round(F.when(F.max(c) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.when(c < 1, F.log(1 - c))))) + 1e-9, 6).alias("combined"))
    out = items.join(counts, keys, "left").join(best, keys, "left")
    return out.withColumns({"n_evidence": F.coalesce("n_evidence", F.lit(0)), "combined": F.coalesce("combined", F.lit(0.0)), "evidence": F.coalesce("evidence", F.array().cast(best.schema["evidence"].dataType))})


def subsystem_candidates(labels: DataFrame, members: DataFrame, edge_table: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """A candidate per directory with five signals, from 0 to 1, and how many of them agree.

    Directory: the largest part of its files that one community (``labels``: node, label) holds. Community: the part of that
    community that lies in the directory. Imports: the part of its files' import edges that stay inside. Co-change: the same for
    ``pairs`` (file_a, file_b, support), by support. Naming: the part of its files (``names``: file_id, word) with its most frequent word.
    """
    of = members.select(F.col("file_id").alias("node"), "subsystem").join(labels.select("node", "label"), "node", "left")
    cells = of.groupBy("subsystem", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes, inside = cells.groupBy("subsystem").agg(F.sum("n").alias("n_files")), cells.where("label is not null")
    largest = top_per(inside, "subsystem", "label").join(inside.groupBy("label").agg(F.sum("n").alias("n_label")), "label")

    def stays(df: DataFrame, a: str, b: str, weight: Column, name: str) -> DataFrame:
        left, right = members.select(F.col("file_id").alias(a), F.col("subsystem").alias("sa")), members.select(F.col("file_id").alias(b), F.col("subsystem").alias("sb"))
        ends = df.join(left, a).join(right, b).select(weight.alias("w"), F.explode(F.array_distinct(F.array("sa", "sb"))).alias("subsystem"), (F.col("sa") == F.col("sb")).alias("inner"))
        return ends.groupBy("subsystem").agg(F.round(F.sum(F.when(F.col("inner"), F.col("w")).otherwise(0)) / F.sum("w"), 6).alias(name))

    words = members.join(names, "file_id").groupBy("subsystem", "word").agg(F.count_distinct("file_id").alias("n"))
    named = words.groupBy("subsystem").agg(F.max("n").alias("n_named"))
    out = sizes.join(largest.select("subsystem", "label", "n", "n_label"), "subsystem", "left").join(named, "subsystem", "left")
    out = out.join(stays(edge_table, "src", "dst", F.lit(1), "import_signal"), "subsystem", "left").join(stays(pairs, "file_a", "file_b", F.col("support"), "cochange_signal"), "subsystem", "left")
    part = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    out = out.withColumns({"directory_signal": part("n", "n_files"), "community_signal": part("n", "n_label"), "naming_signal": part("n_named", "n_files")}).fillna(0.0, ["import_signal", "cochange_signal"])
    signals = ("directory_signal", "community_signal", "import_signal", "cochange_signal", "naming_signal")
    agreeing = reduce(lambda a, b: a + b, ((F.col(s) >= 0.5).cast("int") for s in signals))
    return out.select("subsystem", "label", "n_files", *signals, agreeing.alias("agreeing"), F.when(agreeing >= 2, "confirmed").otherwise("candidate").alias("status"))


def architecture_inputs(subsystems: DataFrame, dependencies: DataFrame, central: DataFrame, edge_table: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """One table (kind, item, value) of what an architecture is described from.

    Confirmed subsystems with their files, dependencies between subsystems with their edges, central files (node, value), entry points
    (files that import but that no file imports) with their imports, external dependencies (imported, but no file) with their
    importers, and documents (doc_id, n_chars).
    """
    row = lambda df, kind, item, value: df.select(F.lit(kind).alias("kind"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    known = files.select(F.col("file_id").alias("node")).distinct()
    out_of = edge_table.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).join(edge_table.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").join(known, "node", "left_semi")
    outside = edge_table.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).join(known, "node", "left_anti")
    parts = [
        row(subsystems.where("status = 'confirmed'"), "subsystem", F.col("subsystem"), F.col("n_files")),
        row(dependencies, "dependency", F.concat_ws(" > ", "src_subsystem", "dst_subsystem"), F.col("n_edges")),
        row(central, "central_file", F.col("node"), F.col("value")),
        row(out_of, "entry_point", F.col("node"), F.col("n")),
        row(outside, "external", F.col("node"), F.col("n")),
        row(docs, "document", F.col("doc_id"), F.col("n_chars")),
    ]
    return reduce(DataFrame.unionByName, parts)


def section_tables(counts: DataFrame, status: DataFrame) -> DataFrame:
    """Per snapshot and section: items, and whether the section is empty or partial.

    ``status`` has snapshot_id, section and section_status, ``counts`` snapshot_id, section and n_items. A section is empty if it is there but
    holds nothing, and a snapshot's available sections are partial while any other of them isn't available.
    """
    out = status.join(counts, ["snapshot_id", "section"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    there = F.col("section_status") == "available"
    missing = F.sum((~there).cast("int")).over(Window.partitionBy("snapshot_id"))
    return out.withColumns({"is_empty": there & (F.col("n_items") == 0), "is_partial": there & (missing > 0)})


def link_commit_files(changes: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """MODIFIES edges of the changes (sha, file_id) whose commit and file are both known."""
    known = changes.select("sha", "file_id").distinct().join(commits.select("sha").distinct(), "sha", "left_semi").join(files.select("file_id").distinct(), "file_id", "left_semi")
    return graph.edges(known, "MODIFIES", "commit", F.col("sha"), "file", F.col("file_id")).drop("knowledge_kind")


def contributor_detail(commits: DataFrame, commit_files: DataFrame, reviews: DataFrame, members: DataFrame) -> DataFrame:
    """(contributor_id, n_commits, n_reviews, subsystems) of everyone who authored or reviewed; subsystems are distinct before they are nested."""
    who = F.col("author_id").alias("contributor_id")
    authored = commits.groupBy(who).agg(F.count_distinct("sha").alias("n_commits"))
    reviewed = reviews.groupBy(F.col("reviewer_id").alias("contributor_id")).agg(F.count_distinct("sha").alias("n_reviews"))
    places = commits.join(commit_files, "sha").join(members, "file_id").select(who, "subsystem").distinct().groupBy("contributor_id").agg(F.sort_array(F.collect_list("subsystem")).alias("subsystems"))
    out = authored.join(reviewed, "contributor_id", "full_outer").fillna(0, ["n_commits", "n_reviews"]).join(places, "contributor_id", "left")
    return out.withColumn("subsystems", F.coalesce("subsystems", F.array().cast("array<string>")))
