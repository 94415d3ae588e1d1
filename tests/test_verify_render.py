import pytest
from pyspark.sql import functions as F

from helpers import fact, facts_of, graph, record
from radmine.operators import facts as ops
from radmine.operators import metrics, verify
from radmine.schema import facts, records

FOUND = graph([fact("consolidation", locations=["left lower lobe"]), fact("opacity", locations=["left lower lobe"])])


def check(spark, impression, finding=FOUND):
    return {(r.head, r.assertion): r for r in verify.checks(facts_of(spark, record("1", finding, impression))).collect()}


def test_good_and_bad(spark_session):
    good = facts_of(spark_session, record("1", FOUND, graph([fact("pneumonia", locations=["left lower lobe"])])))
    t = verify.trace(verify.checks(good)).first()
    assert (t.passed, t.n_facts, t.n_passed_facts, t.errors, t.warnings, t.infos) == (True, 1, 1, 0, 0, 0)
    bad = check(spark_session, graph([fact("pneumonia", locations=["right lower lobe"]), fact("weird thing")], [fact("consolidation", "definitely absent")]))
    assert bad["pneumonia", "present"].laterality == "error:re-locate"
    assert bad["weird thing", "present"].head_legal == "warning:review"
    assert bad["consolidation", "absent"].assertion_check == "warning:review"


def test_sides(spark_session):
    def side(place, *found):
        return check(spark_session, graph([fact("pneumonia", locations=[place])]), graph([fact("opacity", locations=[x]) for x in found]))["pneumonia", "present"].laterality

    assert side("bilateral lung", "left lung", "right lung") == "ok"
    assert side("bilateral lung", "left lung") == "error:re-locate"
    assert side("left lung", "bilateral lung") == "ok"
    assert side("left lung", "heart") == "skip"
    assert side("lung", "left lung") == "skip"
    assert check(spark_session, graph([fact("pneumonia", locations=["left lung"])]), None)["pneumonia", "present"].assertion_check == "skip"


def test_conflict_and_redundancy(spark_session):
    def outcome(a, b):
        return [(r.conflict, r.redundancy) for r in check(spark_session, graph([fact("pneumonia", a[0], [a[1]])], [fact("pneumonia", b[0], [b[1]])]), None).values()]

    assert outcome(("definitely present", "left lung"), ("definitely absent", "right lung")) == [("ok", "ok")] * 2
    assert outcome(("definitely present", "left lung"), ("definitely absent", "left lung")) == [("error:drop", "ok")] * 2
    assert outcome(("definitely present", "left lung"), ("definitely present", "Left  lung")) == [("ok", "warning:merge")]
    assert [r.head_legal for r in check(spark_session, graph([fact("")]), None).values()] == ["error:drop"]


def test_flip_is_caught(spark_session):
    f = facts_of(spark_session, record("1", FOUND, graph([fact("pneumonia", locations=["left lower lobe"])])), record("2", FOUND, graph([fact("pneumonia")])))
    bad = ops.normalized(ops.flipped(f.drop("head", "assertion", "loc")))
    assert verify.caught(f, bad).first().asDict() == {"n_injected": 1, "n_caught": 1, "n_laterality": 1}


def told(spark, *facts_):
    return ops.told(facts_of(spark, record("1", None, graph(list(facts_))))).first()


def test_sentences(spark_session):
    t = told(
        spark_session,
        fact("pneumonia", "definitely present", ["left lower lobe"], ["multifocal"]),
        fact("pleural effusion", "definitely absent", ["right pleural space"]),
        fact("focal opacity", "uncertain", ["right upper lobe"], edges=[("nodule", "uncertain")]),
    )
    assert t.sentences == ["Multifocal pneumonia in the left lower lobe.", "No pleural effusion in the right pleural space.", "Possible focal opacity in the right upper lobe, suggestive of possible nodule."]
    assert t.text == " ".join(t.sentences)
    assert told(spark_session, fact("x", locations=["a", " ", "b", "c"], modifiers=["m", "n"])).text == "M and n x in the a, b and c."
    assert told(spark_session, fact("x 1", locations=["lobe", " segment 1", "\u00a0 ", "1 c 2\u00a0"])).text == "X 1 in the lobe, segment 1 and 1 c 2."


def test_what_cannot_be_told(spark_session):
    t = told(spark_session, fact("x", "foo"), fact("", "uncertain"))
    assert (t.sentences, t.n_facts) == ([], 2)
    with pytest.raises(Exception, match="a fact needs a head"):
        ops.told(facts_of(spark_session, record("1", None, graph([fact("x", "foo")]))), strict=True).collect()


def test_tokens_and_texts(spark_session):
    f = facts_of(spark_session, record("1", graph([fact("opacities", locations=["left lower lobe", "heart size"]), fact("", locations=["right lung"])], [fact("pleural effusion", "definitely absent")], [fact("nodule", "")]), graph([fact("opacity", edges=[("Pneumonias", "uncertain"), ("", "x")])])))
    assert ops.case_tokens(f).first().tokens == ["asppre", "opacity", "lat_left", "reg_lobe", "lobe_lower", "lat_none", "reg_heart", "lat_right", "reg_lung", "aspabs", "pleural_effusion", "aspunc", "nodule"]
    t = ops.case_texts(f).first()
    assert t.finding_text == "+ opacity | left lobe lower; heart\n- pleural effusion\n= nodule"
    assert t.impression_text == "+ opacity  >> pneumonia"


def test_nested_round_trip(spark_session):
    flat = facts_of(spark_session, record("1", FOUND, graph(uncertain=[fact("edema", "uncertain")]))).drop("head", "assertion", "loc")
    assert facts(records(flat)).exceptAll(flat).count() == 0


def test_f1(spark_session):
    f = facts_of(spark_session, record("1", graph([fact("a", locations=["left lung"]), fact("a", locations=["left lung"]), fact("b")]), graph([fact("a", locations=["left lung"]), fact("a", locations=["heart"]), fact("c")])), record("2", None, graph([fact("a")])))
    keys = lambda s: metrics.fact_keys(f.where(F.col("section") == s))
    ids = spark_session.createDataFrame([("1",), ("2",), ("3",)], "record_id string")
    got = {r.record_id: r for r in metrics.record_metrics(keys("finding"), keys("impression"), ids).collect()}
    assert abs(got["1"].head_f1 - 2 / 3) < 1e-12 and abs(got["1"].hal_f1 - 1 / 3) < 1e-12 and got["1"].location_error_rate == 0.5
    assert (got["2"].head_f1, got["3"].head_f1, got["3"].location_error_rate) == (0.0, 1.0, 0.0)
    assert metrics.macro(metrics.record_metrics(keys("finding"), keys("impression"), ids)).first().n_records == 3
