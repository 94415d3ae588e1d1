"""Schemas, and records (nested fact graphs) as flat facts.

A record has an id and two graphs, one per section; a graph has four buckets of facts. Flat facts are the input of every
operator: one row per fact, in the order (bucket_ord, pos) within (record_id, section).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocab import BUCKETS

EDGE = "struct<head:string,finding:string,assertion:string>"
FACT = f"struct<head:string,assertion:string,locations:array<string>,modifiers:array<string>,suggestive_of:array<{EDGE}>>"
GRAPH = f"struct<{','.join(f'{b}:array<{FACT}>' for b in BUCKETS)}>"
RECORD = f"id string, findings_graph_compact {GRAPH}, impression_graph_compact {GRAPH}"
SECTIONS = {"finding": "findings_graph_compact", "impression": "impression_graph_compact"}
FACT_KEY = ("record_id", "section", "bucket_ord", "pos")
RAW_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "findings_graph_compact", "impression_graph_compact")])


def parse_graph(json: Column) -> Column:
    """A graph from JSON text that may hold unions: facts, edges and texts of the wrong kind are skipped one by one
    (a whole-array parse would lose the sound ones). Locations may be texts or objects (text, finding), modifiers texts or
    objects (head, finding), edges objects or texts, assertions texts or objects (raw, value)."""
    items = lambda s: F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))
    field = lambda s, n: F.get_json_object(s, f"$.{n}")
    is_object = lambda s: F.coalesce(F.startswith(s, F.lit("{")), F.lit(False))  # noqa: E731  texts come unquoted
    as_text = lambda s, *n: F.when(is_object(s), F.coalesce(*[F.nullif(field(s, x), F.lit("")) for x in n])).otherwise(s)

    def assertion(s: Column) -> Column:
        return F.when(is_object(s), F.coalesce(field(s, "raw"), field(s, "value"))).otherwise(s)

    def fact(s: Column) -> Column:
        edges = F.transform(
            items(field(s, "suggestive_of")),
            lambda e: F.when(is_object(e), F.struct(field(e, "head").alias("head"), field(e, "finding").alias("finding"), assertion(field(e, "assertion")).alias("assertion"))).otherwise(F.struct(e.alias("head"), F.lit(None).cast("string").alias("finding"), F.lit(None).cast("string").alias("assertion"))),
        )
        return F.struct(
            field(s, "head").alias("head"),
            assertion(field(s, "assertion")).alias("assertion"),
            F.transform(items(field(s, "locations")), lambda x: as_text(x, "text", "finding")).alias("locations"),
            F.transform(items(field(s, "modifiers")), lambda x: as_text(x, "head", "finding")).alias("modifiers"),
            edges.alias("suggestive_of"),
        )

    return F.struct(*[F.transform(F.filter(items(field(json, b)), is_object), fact).alias(b) for b in BUCKETS])


def parse_records(raw: DataFrame) -> DataFrame:
    """Records of RECORD's types from (id, findings_graph_compact, impression_graph_compact) as JSON texts."""
    return raw.select("id", *[parse_graph(F.coalesce(F.col(c), F.lit("{}"))).alias(c) for c in SECTIONS.values()])


def facts(records: DataFrame) -> DataFrame:
    """One row per fact: record_id, section, bucket, bucket_ord, pos, raw_head, raw_assertion, locations, modifiers,
    suggestive_of. Missing and null graphs and buckets are empty; null facts are skipped."""

    def bucket(section: str, column: str, k: int, b: str) -> Column:
        source = F.coalesce(F.col(f"{column}.{b}"), F.expr(f"cast(array() as array<{FACT}>)"))
        return F.transform(F.filter(source, lambda f: f.isNotNull()), lambda f, i: F.struct(F.lit(section).alias("section"), F.lit(b).alias("bucket"), F.lit(k).alias("bucket_ord"), (i + 1).alias("pos"), f.alias("f")))

    every = F.concat(*[bucket(s, c, k, b) for s, c in SECTIONS.items() for k, b in enumerate(BUCKETS)])
    rows = records.select(F.col("id").alias("record_id"), F.explode(every).alias("x"))
    return rows.select("record_id", "x.section", "x.bucket", "x.bucket_ord", "x.pos", F.col("x.f.head").alias("raw_head"), F.col("x.f.assertion").alias("raw_assertion"), "x.f.locations", "x.f.modifiers", "x.f.suggestive_of")


def records(flat: DataFrame) -> DataFrame:
    """The inverse of facts(): nested records, facts in their order. A record is one row, so its facts meet in one task."""
    f = F.struct(F.col("raw_head").alias("head"), F.col("raw_assertion").alias("assertion"), "locations", "modifiers", "suggestive_of")
    g = flat.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("section", "bucket_ord", "pos", f.alias("f")))).alias("all"))

    def graph(section: str) -> Column:
        return F.struct(*[F.transform(F.filter("all", lambda x: (x["section"] == section) & (x["bucket_ord"] == k)), lambda x: x["f"]).alias(b) for k, b in enumerate(BUCKETS)])  # noqa: B023

    return g.select(F.col("record_id").alias("id"), *[graph(s).alias(c) for s, c in SECTIONS.items()])


def any_fact(graph: Column) -> Column:
    """Whether any bucket of a graph has a fact."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.size(graph[b]), F.lit(0)) > 0 for b in BUCKETS])
