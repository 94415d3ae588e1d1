"""Co-occurrence knowledge: edge and pair tables, the no-acute rule, candidate look-ups (batches of queries as joins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import norm
from ..vocab import (
    CHRONIC_HEADS,
    DEVICE_CANDIDATES,
    DEVICE_HEADS,
    DEVICE_OR_POSTOP_HEADS,
    INCIDENTAL_HEADS,
    NO_ACUTE_CONFIDENCE,
    NO_ACUTE_COUNT,
    NO_ACUTE_NEGATIVES,
    NO_ACUTE_TARGET,
    NON_ACUTE_MODIFIERS,
    NORMAL_HEADS,
)
from .facts import by_text


#: Rows of a table of pairs (some names and numbers, about 150 bytes) up to which it is broadcast.
BROADCAST_ROWS = 200_000


def edge_table(facts: DataFrame) -> DataFrame:
    """(source_head, source_assertion, target_head, target_assertion, source_section, count, confidence, rank).

    confidence: count by the number of facts of the source head that have any edge, whatever its targets; above 1 where a
    fact repeats a target. rank: by count, confidence, then names.
    """
    source = facts.where((F.size("suggestive_of") > 0) & (F.col("head") != ""))
    total = source.groupBy(F.col("head").alias("source_head")).agg(F.count("*").alias("total"))
    e = source.select(F.col("head").alias("source_head"), F.col("assertion").alias("source_assertion"), "section", F.explode("suggestive_of").alias("e"))
    # edges are counted as they are written first: each of those texts is normalized once
    written = F.coalesce(F.nullif(F.col("e.finding"), F.lit("")), F.col("e.head"))
    e = e.select("source_head", "source_assertion", written.alias("raw_target"), F.col("e.assertion").alias("raw_assertion"), (F.col("section") == "finding").alias("is_finding"))
    e = e.groupBy("source_head", "source_assertion", "raw_target", "raw_assertion").agg(F.count("*").alias("count"), F.count_if("is_finding").alias("n_finding"))
    e = e.select("source_head", "source_assertion", norm.head(F.col("raw_target")).alias("target_head"), norm.assertion(F.col("raw_assertion")).alias("target_assertion"), "count", "n_finding")
    n = e.groupBy("source_head", "source_assertion", "target_head", "target_assertion").agg(F.sum("count").alias("count"), F.sum("n_finding").alias("n_finding"))
    # by the count as well: a filter by the target alone would go below both sums and normalize every edge
    n = n.where(F.when(F.col("count") > 0, F.col("target_head") != ""))
    rank = F.row_number().over(W.partitionBy("source_head").orderBy(F.desc("count"), "target_head", "target_assertion", "source_assertion"))
    return n.join(total, "source_head").select("source_head", "source_assertion", "target_head", "target_assertion", F.when(F.col("n_finding") == F.col("count"), "finding").when(F.col("n_finding") == 0, "impression").otherwise("both").alias("source_section"), "count", (F.col("count") / F.col("total")).alias("confidence"), rank.alias("rank"))


def edge_stats(edges: DataFrame, top: int = 10) -> DataFrame:
    """(kind, key, n): sources, edges, occurrences, targets, and the sources with most occurrences."""
    total = edges.agg(F.countDistinct("source_head").alias("unique_source_heads"), F.count("*").alias("unique_edges"), F.sum("count").alias("total_occurrences"), F.countDistinct("target_head").alias("unique_target_heads"))
    rows = total.select(F.explode(F.array(*[F.struct(F.lit("count").alias("kind"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in total.columns])).alias("r")).select("r.*")
    best = edges.groupBy(F.lit("top_source").alias("kind"), F.col("source_head").alias("key")).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return rows.unionByName(best)


def _pairs(items: Column) -> Column:
    """2-combinations of a sorted array, as structs (l, r)."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("l"), y.alias("r")))))


def pair_table(facts: DataFrame, min_pair_count: int = 3, max_candidates: int = 10) -> DataFrame:
    """(left_assertion, left_head, right_assertion, right_head, target_head, target_assertion, count, denominator,
    confidence, rank): what impressions say where two findings meet. Everything counts once a record; records need two
    findings and a target. Pairs are counted alone and with each target in one pass, by few tasks, since keys recur: what is
    exchanged are records once and sums."""
    said = norm.assertion_in(F.col("raw_assertion"), F.col("bucket"))
    # a fact is 'assertion|head' until all is counted: no assertion begins another, so these sort like pairs of the two
    code = lambda a, h: F.concat(a, F.lit("|"), h)
    decoded = lambda c, side: (F.substring_index(c, "|", 1).alias(f"{side}_assertion"), F.expr(f"substring({c}, locate('|', {c}) + 1)").alias(f"{side}_head"))

    def led(edges: Column) -> Column:
        each = F.transform(edges, lambda e: F.struct(norm.head(F.coalesce(F.nullif(e["finding"], F.lit("")), e["head"])).alias("head"), norm.assertion(e["assertion"]).alias("assertion")))
        sound = F.filter(each, lambda t: (t["head"] != "") & (t["assertion"] != "unknown"))
        return F.coalesce(F.transform(sound, lambda t: code(t["assertion"], t["head"])), F.array().cast("array<string>"))

    f = by_text(facts.select("record_id", "section", "head", said.alias("said"), "suggestive_of"), led=("suggestive_of", led))
    f = f.withColumn("item", F.when((F.col("head") != "") & (F.col("said") != "unknown"), code(F.col("said"), F.col("head"))))
    targets = F.concat(F.array_compact(F.array("item")), F.col("led"))
    f = f.select("record_id", F.when(F.col("section") == "finding", F.col("item")).alias("item"), F.when(F.col("section") == "impression", targets).alias("targets"))
    # no filter here: it would go below and normalize every text once more
    r = f.groupBy("record_id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_distinct(F.flatten(F.collect_list("targets"))).alias("targets"))
    r = r.where((F.size("items") > 1) & (F.size("targets") > 0)).coalesce(max(1, facts.sparkSession.sparkContext.defaultParallelism))
    key = ["left_assertion", "left_head", "right_assertion", "right_head"]
    # the null among the targets counts the pair itself
    both = r.select(F.explode(_pairs(F.col("items"))).alias("p"), "targets").select("p", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("targets"))).alias("t"))
    n = both.select("p.l", "p.r", "t").groupBy("l", "r", "t").agg(F.count("*").alias("count"))
    n = n.select(*decoded("l", "left"), *decoded("r", "right"), *decoded("t", "target"), "count")
    alone = F.max(F.when(F.col("target_head").isNull(), F.col("count"))).over(W.partitionBy(*key))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.col("target_head").isNull(), F.desc("count"), "target_head", "target_assertion"))
    n = n.withColumn("denominator", alone).withColumn("rank", rank).where((F.col("denominator") >= min_pair_count) & F.col("target_head").isNotNull() & (F.col("rank") <= max_candidates))
    return n.select(*key, "target_head", "target_assertion", "count", "rank", "denominator").withColumn("confidence", F.col("count") / F.col("denominator"))


def non_acute(head: Column, modifiers: Column) -> Column:
    """Whether a head with its (normalized) modifiers speaks of nothing acute."""
    words = F.array(*[F.lit(x) for x in NON_ACUTE_MODIFIERS])
    aged = F.arrays_overlap(modifiers, words)
    aged_head = F.arrays_overlap(F.split(head, " "), words)
    return head.isin(*NORMAL_HEADS, *DEVICE_OR_POSTOP_HEADS, *INCIDENTAL_HEADS) | (head.isin(*CHRONIC_HEADS) & aged) | ((aged | aged_head) & head.rlike("fracture|deformity"))


def no_acute(facts: DataFrame) -> DataFrame:
    """(record_id, evidence) of the records whose findings speak of no acute disease: nothing present or uncertain that
    isn't allowed, and at least one fact. evidence: heads in fact order, then the first negative ones."""
    f = facts.where("section = 'finding' and head <> ''")
    mods = F.filter(F.transform(F.coalesce("modifiers", F.array().cast("array<string>")), lambda m: norm.head(m)), lambda m: m != "")
    said = norm.assertion_in(F.col("raw_assertion"), F.col("bucket"))
    f = f.select("record_id", "bucket", "bucket_ord", "pos", "head", said.alias("said"), non_acute(F.col("head"), mods).alias("allowed"))
    seen = (F.col("bucket") != "negative") & (F.col("said") != "absent")
    order = F.struct(F.when(F.col("bucket") == "other", 9).when(F.col("bucket") == "uncertain", 8).otherwise(F.col("bucket_ord")).alias("o"), "pos", "head", "said")
    g = f.groupBy("record_id").agg(
        F.bool_or(seen & ~F.col("allowed") & F.col("said").isin("present", "uncertain")).alias("blocked"),
        F.bool_or(seen).alias("seen"),
        F.array_sort(F.collect_list(F.when(seen & F.col("allowed"), order))).alias("good"),
        F.array_sort(F.collect_list(F.when(F.col("bucket") == "negative", order))).alias("negative"),
    )
    heads = lambda c: F.transform(c, lambda x: x["head"])
    return g.where(~F.col("blocked") & (F.col("seen") | (F.size("negative") > 0))).select("record_id", F.concat(heads(F.col("good")), F.slice(heads(F.col("negative")), 1, NO_ACUTE_NEGATIVES)).alias("evidence"))


def score(confidence: Column, count: Column) -> Column:
    return F.round(confidence * F.pow(count, F.lit(0.3)), 6)


CANDIDATE = ("target_head", "target_assertion", "source_assertion", "source_section", "count", "confidence")


def candidates(queries: DataFrame, edges: DataFrame, fired: DataFrame | None = None, min_count: int = 3, min_confidence: float = 0.0, topk: int | None = None) -> DataFrame:
    """Candidates of a batch of queries: (query_id, head, assertion[, record_id]) -> query_id, CANDIDATE, score, rank.

    head is normalized; a null assertion doesn't filter. fired (record_id, ...): records in which the no-acute rule
    holds; its row comes without filters, and alone for heads that have no stored rows. Device heads of which no stored
    row reaches min_count get two fixed rows. Order: score, then device, rule and stored rows by their rank.
    """
    q = queries.select("query_id", "head", "assertion", *(["record_id"] if fired is not None else []))
    has = edges.groupBy(F.col("source_head").alias("head")).agg(F.max("count").alias("most"))
    q = q.join(has, "head", "left")
    q = q.join(fired.select("record_id", F.lit(True).alias("fired")), "record_id", "left").drop("record_id") if fired is not None else q.withColumn("fired", F.lit(False))
    q = q.withColumn("fired", F.coalesce("fired", F.lit(False)))
    fixed = lambda t, a, s, sec, n, c, o, r: F.struct(F.lit(t).alias("target_head"), F.lit(a).alias("target_assertion"), F.lit(s).alias("source_assertion"), F.lit(sec).alias("source_section"), F.lit(n).cast("long").alias("count"), F.lit(c).alias("confidence"), F.lit(o).alias("o"), F.lit(r).alias("r"))
    rule = fixed(NO_ACUTE_TARGET, "absent", "mixed", "rule:no_acute", NO_ACUTE_COUNT, NO_ACUTE_CONFIDENCE, 1, 0)
    device = [fixed(t, a, "present", "rule", n, c, 0, i) for i, (t, a, n, c) in enumerate(DEVICE_CANDIDATES)]
    alone = F.col("fired") & F.col("most").isNull()
    given = F.array_compact(F.array(F.when(F.col("fired"), rule), *[F.when(~alone & F.col("head").isin(*DEVICE_HEADS) & (F.coalesce("most", F.lit(0)) < min_count), d) for d in device]))
    out = q.select("query_id", F.explode(given).alias("x")).select("query_id", "x.*")
    stored = q.join(edges.withColumnRenamed("source_head", "head"), "head").where((F.col("count") >= min_count) & (F.col("confidence") >= min_confidence) & (F.col("assertion").isNull() | (F.col("assertion") == F.col("source_assertion"))))
    out = out.unionByName(stored.select("query_id", *CANDIDATE, F.lit(2).alias("o"), F.col("rank").alias("r")))
    out = out.withColumn("score", score(F.col("confidence"), F.col("count")))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "o", "r")))
    return (out.where(F.col("rank") <= topk) if topk else out).drop("o", "r")


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, broadcast if it has few rows: what it is joined to then stays where it is, and hits aren't exchanged."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def pair_candidates(facts: DataFrame, pairs: DataFrame, min_count: int = 3, min_confidence: float = 0.0, topk: int = 5, legacy: DataFrame | None = None) -> DataFrame:
    """Candidates of each record's finding pairs: record_id, CANDIDATE, score, n_pairs, supporting_pairs, rank. Counts and
    confidences are those of the best pair, scores add up.

    legacy: a table keyed by heads only (left_head < right_head, then target and counts as in pairs), for the pairs of
    which `pairs` has no row.
    """
    f = facts.where("section = 'finding' and head <> ''")
    items = f.groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("assertion", "head"))).alias("items"), F.count("*").alias("n")).where("n > 1")
    p = items.select("record_id", F.explode(_pairs(F.col("items"))).alias("p")).select("record_id", F.col("p.l.assertion").alias("left_assertion"), F.col("p.l.head").alias("left_head"), F.col("p.r.assertion").alias("right_assertion"), F.col("p.r.head").alias("right_head"))
    # scores and names are made once a table row and once a pair, not once a hit; whole millionths add up alike in any order
    scored = lambda df: df.where((F.col("count") >= min_count) & (F.col("confidence") >= min_confidence)).withColumn("s", F.round(score(F.col("confidence"), F.col("count")) * 1e6).cast("long"))
    p = p.withColumn("name", F.concat_ws(" + ", F.concat_ws("|", "left_assertion", "left_head"), F.concat_ws("|", "right_assertion", "right_head")))
    key, row = ["left_assertion", "left_head", "right_assertion", "right_head"], ["target_head", "target_assertion", "count", "confidence", "s"]
    hit = p.join(small(scored(pairs).select(*key, *row)), key).select("record_id", "name", *row)
    if legacy is not None:
        old = scored(legacy).withColumnsRenamed({"left_head": "a", "right_head": "b"}).select("a", "b", *row)
        missing = p.join(small(pairs.select(*key).distinct()), key, "left_anti")
        more = missing.join(small(old), (F.least("left_head", "right_head") == F.col("a")) & (F.greatest("left_head", "right_head") == F.col("b")))
        hit = hit.unionByName(more.select("record_id", "name", *row))
    g = hit.groupBy("record_id", "target_head", "target_assertion").agg(F.max("count").alias("count"), F.max("confidence").alias("confidence"), F.sum("s").alias("s"), F.count("*").alias("n_pairs"), F.array_sort(F.collect_list("name")).alias("supporting_pairs"))
    g = g.select("record_id", "target_head", "target_assertion", F.lit("mixed").alias("source_assertion"), F.lit("pair").alias("source_section"), "count", "confidence", (F.col("s").cast("double") / 1e6).alias("score"), "n_pairs", "supporting_pairs")
    g = g.withColumn("rank", F.row_number().over(W.partitionBy("record_id").orderBy(F.desc("score"), F.desc("count"), "target_head", "target_assertion")))
    return g.where(F.col("rank") <= topk)


def fused(facts: DataFrame, edges: DataFrame, pairs: DataFrame, topk: int = 10, per_fact: int = 5, min_count: int = 3) -> DataFrame:
    """Candidates of each record: the best of each finding fact in fact order, then those of its pairs; of equal (target,
    assertion) the first counts; ranked by score."""
    f = facts.where("section = 'finding' and head <> ''")
    f = f.join(no_acute(facts).select("record_id", F.lit(True).alias("fired")), "record_id", "left")
    f = f.select("record_id", "bucket_ord", "pos", F.struct("head", F.when(F.coalesce("raw_assertion", F.lit("")) != "", F.col("assertion")).alias("assertion"), F.coalesce("fired", F.lit(False)).alias("fired")).alias("query_id"))
    # candidates depend on head, assertion and rule only: each such case is ranked once, however many facts ask for it
    cases = f.select("query_id").distinct().select("query_id", "query_id.head", "query_id.assertion", F.col("query_id.fired").cast("string").alias("record_id"))
    rule = cases.select("record_id").where("record_id = 'true'").distinct()
    best = candidates(cases, edges, rule, min_count=min_count, topk=per_fact)
    key = [F.col("query_id.head").alias("asked"), F.coalesce("query_id.assertion", F.lit("any")).alias("want"), F.col("query_id.fired").alias("fired")]
    one = f.select("record_id", "bucket_ord", "pos", *key).join(best.select(*key, "rank", *CANDIDATE, "score"), ["asked", "want", "fired"])
    one = one.select("record_id", F.struct(F.lit(0).alias("late"), F.col("bucket_ord").alias("b"), F.col("pos").alias("p"), F.col("rank").alias("r")).alias("o"), *CANDIDATE, "score")
    two = pair_candidates(facts, pairs, min_count=min_count).select("record_id", F.struct(F.lit(1).alias("late"), F.lit(0).alias("b"), F.lit(0).alias("p"), F.col("rank").alias("r")).alias("o"), *CANDIDATE, "score")
    every = one.unionByName(two)
    first = every.groupBy("record_id", "target_head", "target_assertion").agg(F.min_by(F.struct("o", "source_assertion", "source_section", "count", "confidence", "score"), "o").alias("x"))
    out = first.select("record_id", "target_head", "target_assertion", "x.*")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("record_id").orderBy(F.desc("score"), "o"))).where(F.col("rank") <= topk).drop("o")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """(kind, key, n): pairs, rows, targets and the largest denominator of a pair table; an empty table counts nothing."""
    x = pairs.agg(F.countDistinct("left_assertion", "left_head", "right_assertion", "right_head").alias("pairs"), F.count("*").alias("rows"), F.countDistinct("target_head").alias("targets"), F.coalesce(F.max("denominator"), F.lit(0)).alias("largest_denominator"))
    return x.select(F.explode(F.array(*[F.struct(F.lit("count").alias("kind"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in x.columns])).alias("r")).select("r.*")


def write(path: str, edges: DataFrame, pairs: DataFrame | None = None) -> None:
    """Knowledge as Parquet tables below path: edges, and pairs where given."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    if pairs is not None:
        pairs.write.mode("overwrite").parquet(f"{path}/pairs")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(edges, pairs) from write(); pairs are found beside the edges, or None."""
    from pyspark.errors import AnalysisException

    edges = spark.read.parquet(f"{path}/edges")
    try:
        return edges, spark.read.parquet(f"{path}/pairs")
    except AnalysisException:
        return edges, None


def as_json(edges: DataFrame) -> DataFrame:
    """(source_head, rows): the edge table keyed by head, rows as a JSON array in rank order."""
    row = F.struct("rank", "target_head", "target_assertion", "source_assertion", "source_section", "count", F.round("confidence", 4).alias("confidence"))
    return edges.groupBy("source_head").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("rows"))


def pairs_as_json(pairs: DataFrame) -> DataFrame:
    """(pair, rows): the pair table keyed by 'assertion|head + assertion|head', rows as a JSON array in rank order."""
    name = F.concat_ws(" + ", F.concat_ws("|", "left_assertion", "left_head"), F.concat_ws("|", "right_assertion", "right_head"))
    row = F.struct("rank", "target_head", "target_assertion", "count", "denominator", F.round("confidence", 4).alias("confidence"))
    return pairs.groupBy(name.alias("pair")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("rows"))
