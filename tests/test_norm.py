import pytest
from pyspark.sql import functions as F

from radmine.functions import norm

HEADS = {
    "Effusions": "effusion", "effusion": "effusion", "opacities": "opacity", "pneumothoraces": "pneumothorax", "within normal limits": "normal",
    "normal limits": "normal", "hyperinflated": "hyperinflation", "calcified": "calcification", "atelectasis": "atelectasis", "nodules": "nodule",
    "fractures": "fracture", "gas": "gas", "disease": "disease", "scoliosis": "scoliosis", "boxes": "box", "dishes": "dish",
    "focal opacities": "focal opacity", "acute infiltrate": "acute infiltrate", "ties": "tie", "basis": "basi", "mass": "mas", "masses": "mass",
    "bilateral pneumothoraces": "bilateral pneumothorace", "": "", None: "", "  Pleural  Effusions ": "pleural effusion", "is": "is",
}
PLACES = {
    "left pleural": "left/pleura/none", "left lower lobe": "left/lobe/lower", "right upper lobe": "right/lobe/upper", "bilateral airspace": "bilateral/lung/none",
    "lungs bilaterally": "bilateral/lung/none", "interstitial bilaterally": "bilateral/lung/none", "bilateral perihilar": "bilateral/hilar/none",
    "heart size": "none/heart/none", "mediastinal contours": "none/mediastinum/none", "left - sided": "left/other/none", "right - sided pleural": "right/pleura/none",
    "right hemidiaphragm": "right/pleura/none", "left costophrenic angle": "left/pleura/none", "osseous structures": "none/bone/none", "left basilar": "left/lung/lower",
    "bibasilar": "none/lung/lower", "pulmonary": "none/lung/none", "pulmonary venous": "none/vasculature/none", "bony thorax": "none/bone/none",
    "thoracic spine": "none/bone/none", "chest": "none/chest/none", "hila": "none/hilar/none", "stomach": "none/abdomen/none", "": "none/other/none",
    "cardiopulmonary": "none/lung/none", "chest wall": "none/chest/none", "midline": "none/device/none", "basal": "none/other/lower", None: "none/other/none",
    "éleft": "none/other/none", "RIGHT Middle Lobe": "right/lobe/middle",
}


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_heads(spark_session):
    assert dict(zip(HEADS, column(spark_session, HEADS, norm.head), strict=True)) == HEADS


def test_guarded_heads_are_idempotent(spark_session):
    once = column(spark_session, HEADS, lambda c: norm.head(c, compat=False))
    assert column(spark_session, once, lambda c: norm.head(c, compat=False)) == once
    assert dict(zip(HEADS, once, strict=True))["mass"] == "mass"


def test_places(spark_session):
    got = column(spark_session, PLACES, norm.location)
    assert {k: f"{v.laterality}/{v.region}/{v.lobe}" for k, v in zip(PLACES, got, strict=True)} == PLACES


def test_review_flags(spark_session):
    got = column(spark_session, ["left and right", "unilateral", "bilateral unilaterally", "bilateral", "left"], norm.location)
    assert [(v.laterality, v.needs_review) for v in got] == [("bilateral", True), ("none", True), ("bilateral", True), ("bilateral", False), ("left", False)]


@pytest.mark.parametrize(("raw", "want"), [("measurement::definitely present", "present"), ("Definitely Absent", "absent"), ("uncertain", "uncertain"), ("", "unknown"), ("foo", "unknown"), (None, "unknown"), ("absent present", "absent"), ("uncertain present", "uncertain")])
def test_assertions(spark_session, raw, want):
    assert column(spark_session, [raw], norm.assertion) == [want]


def test_assertion_policies(spark_session):
    by = lambda f: column(spark_session, ["", "positive", "negative"], f)
    assert by(norm.assertion_short) == ["unc"] * 3
    assert by(lambda c: norm.assertion_in(c, F.lit("negative"))) == ["absent"] * 3
    assert by(lambda c: norm.assertion_in(c, F.lit("other"))) == ["unknown"] * 3
    assert by(lambda c: norm.assertion_prompt(c, F.lit("positive"))) == ["present", "present", "absent"]


def test_flip(spark_session):
    assert column(spark_session, ["left lung", "Right base", "left and right", "LEFT", "hila", None], norm.flip_side) == ["right lung", "Left base", "right and right", "LEFT", "hila", None]
