from pyspark.sql import functions as F

from helpers import fact, facts_of, graph, record
from radmine.operators import knowledge


def edge_corpus(spark):
    p, a = ("pneumonia", "uncertain"), ("atelectasis", "uncertain")
    return facts_of(
        spark,
        record("1", graph([fact("opacity", edges=[p, a]), fact("opacities", edges=[p])]), graph([fact("opacity", edges=[p])])),
        record("2", graph([fact("opacity", edges=[p]), fact("opacity", edges=[a])]), None),
    )


def test_edges(spark_session):
    rows = {r.target_head: r for r in knowledge.edge_table(edge_corpus(spark_session)).collect()}
    assert (rows["pneumonia"]["count"], rows["pneumonia"].confidence, rows["pneumonia"].source_section, rows["pneumonia"].rank) == (4, 0.8, "both", 1)
    assert (rows["atelectasis"]["count"], rows["atelectasis"].confidence, rows["atelectasis"].source_section) == (2, 0.4, "finding")
    assert rows["pneumonia"].source_assertion == "present" and rows["pneumonia"].target_assertion == "uncertain"


def test_edge_stats(spark_session):
    stats = {(r.kind, r.key): r.n for r in knowledge.edge_stats(knowledge.edge_table(edge_corpus(spark_session))).collect()}
    assert stats == {("count", "unique_source_heads"): 1, ("count", "unique_edges"): 2, ("count", "total_occurrences"): 6, ("count", "unique_target_heads"): 2, ("top_source", "opacity"): 6}


def pair_corpus(spark):
    heads = [fact(h) for h in ("alpha", "beta", "gamma", "delta", "epsilon")]
    return facts_of(
        spark,
        record("1", graph(heads), graph([fact("pneumonia")])),
        record("2", graph(heads + heads[:1]), graph(negative=[fact("pneumonia", "definitely absent")])),
        record("3", graph(heads[:1]), graph([fact("pneumonia")])),
        record("4", graph(heads), None),
    )


def test_pairs(spark_session):
    f = pair_corpus(spark_session)
    rows = knowledge.pair_table(f, min_pair_count=1).collect()
    de = [r for r in rows if (r.left_head, r.right_head) == ("delta", "epsilon")]
    assert {(r.target_assertion, r["count"], r.confidence) for r in de} == {("present", 1, 0.5), ("absent", 1, 0.5)}
    assert {(r.left_head, r.right_head) for r in rows} >= {("alpha", "epsilon")} and len(rows) == 20
    assert all(0 < r.confidence <= 1 for r in rows)
    assert knowledge.pair_table(f, min_pair_count=3).count() == 0


def test_pair_candidates(spark_session):
    f = pair_corpus(spark_session)
    pairs = knowledge.pair_table(f, min_pair_count=1)
    got = knowledge.pair_candidates(f.where("record_id = '4' and head in ('delta', 'epsilon')"), pairs, min_count=1).collect()
    assert len(got) == 2 and {r.source_assertion for r in got} == {"mixed"}
    assert [r.supporting_pairs for r in got] == [["present|delta + present|epsilon"]] * 2


def test_pairs_of_older_tables(spark_session):
    f = pair_corpus(spark_session)
    pairs = knowledge.pair_table(f, min_pair_count=1).where("left_head <> 'alpha'")
    old = spark_session.createDataFrame([("alpha", "beta", "edema", "present", 7, 0.5), ("delta", "epsilon", "never", "present", 9, 0.9)], "left_head string, right_head string, target_head string, target_assertion string, count long, confidence double")
    got = knowledge.pair_candidates(f.where("record_id = '4'"), pairs, min_count=1, topk=9, legacy=old).collect()
    assert {r.target_head for r in got} == {"pneumonia", "edema"}
    assert [r.supporting_pairs for r in got if r.target_head == "edema"] == [["present|alpha + present|beta"]]


def fired(spark, finding):
    return [r.evidence for r in knowledge.no_acute(facts_of(spark, record("1", finding, None))).collect()]


def test_no_acute(spark_session):
    negatives = [fact(h, "definitely absent") for h in ("effusion", "pneumothorax", "edema")]
    allowed = [fact("nipple shadows"), fact("clips"), fact("rib fracture", modifiers=["remote"]), fact("chronic deformity")]
    assert fired(spark_session, graph(allowed, negatives)) == [["nipple shadow", "clip", "rib fracture", "chronic deformity", "effusion", "pneumothorax", "edema"]]
    assert fired(spark_session, graph([fact("consolidation")], negatives)) == []
    assert fired(spark_session, graph(negative=negatives, uncertain=[fact("nodule", "uncertain")])) == []
    assert fired(spark_session, graph(negative=negatives * 4)) == [["effusion", "pneumothorax", "edema"] * 2 + ["effusion", "pneumothorax"]]
    assert fired(spark_session, graph()) == []
    assert fired(spark_session, graph([fact("rib fracture")])) == []
    assert fired(spark_session, graph(negative=[fact("mass", "definitely present")])) == [["mas"]]  # in the negative bucket whatever it says
    assert fired(spark_session, graph(other=[fact("odd", "")])) == [[]]


def ask(spark, edges, head, assertion=None, rule=None, **options):
    q = spark.createDataFrame([(1, head, assertion, "r")], "query_id int, head string, assertion string, record_id string")
    f = None if rule is None else spark.createDataFrame([("r",)] if rule else [], "record_id string")
    return [(r.target_head, r.target_assertion, r["count"], r.rank) for r in knowledge.candidates(q, edges, f, **options).orderBy("rank").collect()]


def test_candidates(spark_session):
    edges = knowledge.edge_table(edge_corpus(spark_session))
    assert ask(spark_session, edges, "opacity") == [("pneumonia", "uncertain", 4, 1)]
    assert len(ask(spark_session, edges, "opacity", min_count=1)) == 2
    assert ask(spark_session, edges, "opacity", "absent") == []
    assert ask(spark_session, edges, "opacity", min_confidence=0.9) == []
    assert ask(spark_session, edges, "picc") == [("atelectasis", "present", 250, 1), ("pneumothorax", "present", 200, 2)]
    assert ask(spark_session, edges, "picc", rule=False, topk=1) == [("atelectasis", "present", 250, 1)]
    rule = ("acute cardiopulmonary abnormality", "absent", 100000, 1)
    assert ask(spark_session, edges, "picc", rule=True) == [rule]
    assert ask(spark_session, edges, "opacity", rule=True) == [rule, ("pneumonia", "uncertain", 4, 2)]


def test_store(spark_session, tmp_path):
    edges = knowledge.edge_table(edge_corpus(spark_session))
    knowledge.write(str(tmp_path / "a"), edges)
    back, pairs = knowledge.load(spark_session, str(tmp_path / "a"))
    assert pairs is None and back.exceptAll(edges).count() == 0
    knowledge.write(str(tmp_path / "b"), edges, knowledge.pair_table(pair_corpus(spark_session), 1))
    assert knowledge.load(spark_session, str(tmp_path / "b"))[1].count() == 20
    assert '"target_head":"pneumonia"' in knowledge.as_json(edges).first().rows


def test_bucket_order_does_not_matter(spark_session):
    f = edge_corpus(spark_session)
    shuffled = f.orderBy(F.rand(3)).repartition(3)
    assert knowledge.edge_table(f).exceptAll(knowledge.edge_table(shuffled)).count() == 0


def test_pairs_are_not_exchanged(spark_session):
    """neither the pairs of each record nor what the table has for them may be written for other tasks, only sums."""
    heads = [f"thing {x}" for x in "abcdefghijkl"]
    f = facts_of(spark_session, *[record(str(i), graph([fact(h) for h in heads]), graph([fact("edema"), fact("pneumonia")])) for i in range(200)])
    sc = spark_session.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    pairs = knowledge.pair_table(f).persist()
    rows = pairs.collect()
    assert len(rows) == 132 and {(r["count"], r.denominator, r.confidence) for r in rows} == {(200, 200, 1.0)}
    got = knowledge.pair_candidates(f, pairs).collect()
    assert len(got) == 400 and {r.n_pairs for r in got} == {66}
    assert written() - before < 10_000  # of 13,200 pairs and 26,400 hits
    pairs.unpersist()
