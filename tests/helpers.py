"""Small records for tests."""

import json

from radmine.operators.facts import normalized
from radmine.schema import RECORD, facts


def fact(head, assertion="definitely present", locations=(), modifiers=(), edges=()):
    return {"head": head, "assertion": assertion, "locations": list(locations), "modifiers": list(modifiers), "suggestive_of": [{"finding": e[0], "assertion": e[1]} for e in edges]}


def graph(positive=(), negative=(), uncertain=(), other=()):
    return {"positive": list(positive), "negative": list(negative), "uncertain": list(uncertain), "other": list(other)}


def record(id_, finding=None, impression=None):
    return {"id": id_, "findings_graph_compact": finding, "impression_graph_compact": impression}


def records_of(spark, *rows):
    return spark.read.schema(RECORD).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def facts_of(spark, *rows):
    return normalized(facts(records_of(spark, *rows)))
