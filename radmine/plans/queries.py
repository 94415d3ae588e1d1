"""The engine's queries over the star-schema tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import norm, render
from ..operators import facts as ops
from ..operators import infer, knowledge, metrics, retrieval, sections, verify
from ..schema import facts as flat_facts
from ..schema import any_fact
from ..schema import records as nested_records
from ..sources import reports as sources
from ..vocab import BUCKETS
from .adapters import documents, fact_view, facts, reports, table, words

# Raw texts with published canonical forms, and some that are easily got wrong.
HEAD_GOLDENS = ("Effusions", "effusion", "opacities", "pneumothoraces", "within normal limits", "normal limits", "hyperinflated", "calcified", "atelectasis", "nodules", "fractures", "fracture", "gas", "disease", "scoliosis", "boxes", "dishes", "focal opacities", "acute infiltrate", "ties", "basis", "mass", "bilateral pneumothoraces", "")
PLACE_GOLDENS = ("left pleural", "left lower lobe", "right upper lobe", "bilateral airspace", "lungs bilaterally", "interstitial bilaterally", "bilateral perihilar", "heart size", "mediastinal contours", "left - sided", "right - sided pleural", "right hemidiaphragm", "left costophrenic angle", "osseous structures", "left basilar", "bibasilar", "pulmonary", "pulmonary venous", "bony thorax", "thoracic spine", "chest", "hila", "stomach", "", "cardiopulmonary", "chest wall", "midline", "basal", "left and right")
SAID = ("measurement::definitely present", "Definitely Absent", "uncertain", "", "foo", "positive", "negative", "absent present", "uncertain present")
ANSWERS = (
    'Sure: [{"head": "pneumonia", "assertion": "Present", "locations": ["left lower lobe"]}, {"head": " ", "assertion": "absent"}, 7, {"head": "edema"}] done',
    "no array", "[broken", '<think>[{"head": "x"}]</think>[{"head":"nodule","assertion":"maybe","modifiers":["small"]}]', "[]", '[{"assertion":"present"}]',
)

#: A dictionary of plurals for head_lemmas.
LEMMAS = {"opacities": "opaque area", "lines": "line", "masses": "mass", "catheters": "drain"}


def _values(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


_held: list[DataFrame] = []


def _kept(df: DataFrame, also: bool = False) -> DataFrame:
    """df kept in memory and on disk while the next results are computed; what an earlier query kept is let go (also: and
    what this query has kept so far stays)."""
    while _held and not also:
        _held.pop().unpersist()
    _held.append(df.persist())
    return df


def head_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fact_view(spark, sf_dir).select(F.col("raw_head").alias("raw")).unionByName(_values(spark, HEAD_GOLDENS, "raw")).distinct()
    return raw.select("raw", norm.head(F.col("raw")).alias("canonical"), norm.head(F.col("raw"), compat=False).alias("guarded"))


def assertion_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fact_view(spark, sf_dir).select(F.col("raw_assertion").alias("raw"), "bucket")
    made = _values(spark, SAID, "raw").crossJoin(_values(spark, BUCKETS, "bucket"))
    a, b = F.col("raw"), F.col("bucket")
    return own.unionByName(made).distinct().select("raw", "bucket", norm.assertion(a).alias("plain"), norm.assertion_short(a).alias("short"), norm.assertion_in(a, b).alias("with_bucket"), norm.assertion_prompt(a, b).alias("for_prompt"))


def location_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fact_view(spark, sf_dir).select(F.explode("locations").alias("raw")).unionByName(_values(spark, PLACE_GOLDENS, "raw")).distinct()
    return raw.withColumn("x", norm.location(F.col("raw"))).select("raw", "x.laterality", "x.region", "x.lobe", "x.needs_review")


def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.norm_stats(facts(spark, sf_dir))


def region_other_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unplaced(fact_view(spark, sf_dir))


def suggestive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.edge_table(facts(spark, sf_dir))


def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.edge_stats(suggestive_edges(spark, sf_dir))


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.pair_table(facts(spark, sf_dir))


def candidates_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (head, assertion) of the findings as a query, with and without the assertion as filter."""
    f = facts(spark, sf_dir)
    pairs = f.where("section = 'finding' and head <> ''").select("head", "assertion").distinct()
    asked = pairs.unionByName(pairs.select("head", F.lit(None).cast("string").alias("assertion")).distinct())
    asked = asked.withColumn("query_id", F.struct("head", F.coalesce("assertion", F.lit("any")).alias("asked")))
    return knowledge.candidates(asked, knowledge.edge_table(f), topk=5).select("query_id.*", *knowledge.CANDIDATE, "score", "rank")


def no_acute_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.no_acute(facts(spark, sf_dir)).select("record_id", F.array_join("evidence", ";").alias("evidence"))


def candidates_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _kept(facts(spark, sf_dir))
    return knowledge.pair_candidates(f, knowledge.pair_table(f)).withColumn("supporting_pairs", F.array_join("supporting_pairs", ";"))


def candidates_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _kept(facts(spark, sf_dir))  # read for edges, pairs, the rule and both kinds of candidates
    return knowledge.fused(f, knowledge.edge_table(f), knowledge.pair_table(f))


def case_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.case_tokens(facts(spark, sf_dir)).select("record_id", F.array_join("tokens", " ").alias("tokens"))


def case_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.case_texts(facts(spark, sf_dir))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.build(documents(spark, sf_dir))
    return index.terms.select("token", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words(F.col("text")).alias("tokens"))
    top = retrieval.search(asked, retrieval.build(documents(spark, sf_dir)), 10)
    return top.select("qid", "rank", "did", F.round("score", 6).alias("score"))


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose id is divisible by 100, asked of all cases."""
    f = facts(spark, sf_dir)
    asked = f.select("record_id").distinct().where("record_id % 100 = 0")
    return retrieval.evaluate_recall(asked, ops.case_tokens(f), retrieval.impression_heads(f))


def knowledge_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _kept(facts(spark, sf_dir))
    return metrics.knowledge_recall(metrics.knowledge_ranks(f, knowledge.edge_table(f)))


def knowledge_recall_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _kept(facts(spark, sf_dir))
    return metrics.knowledge_recall(metrics.knowledge_ranks(f, knowledge.edge_table(f)), compat=True)


def knowledge_by_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _kept(facts(spark, sf_dir))
    return metrics.knowledge_by_head(metrics.knowledge_ranks(f, knowledge.edge_table(f)))


def verify_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.checks(facts(spark, sf_dir))


def verify_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.trace(verify_checks(spark, sf_dir))


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.report(verify_checks(spark, sf_dir))


def inject_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fact_view(spark, sf_dir)
    return verify.caught(ops.normalized(raw), ops.normalized(ops.flipped(raw)))


def _scored(spark: SparkSession, sf_dir: str, small: bool) -> DataFrame:
    f = _kept(facts(spark, sf_dir))
    keys = lambda s: metrics.fact_keys(f.where(F.col("section") == s), small)
    return metrics.record_metrics(keys("finding"), keys("impression"), f.select("record_id").distinct())


def fact_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, False)


def fact_f1_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True)


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(_scored(spark, sf_dir, False))


def verbalize_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fact_view(spark, sf_dir)
    return f.select("record_id", "pos", render.sentence(*[F.col(c) for c in ("raw_head", "raw_assertion", "modifiers", "locations", "suggestive_of")]).alias("sentence"))


def verbalize_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.told(fact_view(spark, sf_dir)).drop("sentences")


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.metadata(reports(spark, sf_dir))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = reports(spark, sf_dir).select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return sections.carried(lines, "path", "n").groupBy(F.coalesce("section", F.lit("none")).alias("section")).agg(F.count("*").alias("n_lines"))


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.counters(reports(spark, sf_dir))


def max_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 reports seen, of which those with an impression are written: the limit is the feature."""
    return sections.metadata(reports(spark, sf_dir), require_impression=True, max_records=25).select("id", "report_path")


def parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = table(spark, sf_dir, "events").select(F.concat(F.lit('answer [{"head": "h'), F.get_json_object("props", "$.k"), F.lit('", "assertion": "ABSENT"}]')).alias("answer"))
    parsed = props.unionByName(_values(spark, ANSWERS, "answer")).select("answer", infer.parse_facts(infer.strip_thinking(F.col("answer"))).alias("facts"))
    rows = parsed.select(F.explode("facts").alias("f")).select("f.head", "f.assertion", F.array_join("f.locations", ";").alias("locations"), F.array_join("f.modifiers", ";").alias("modifiers"))
    return rows.groupBy("head", "assertion", "locations", "modifiers").agg(F.count("*").alias("n"))


def repacked_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the buckets of all answers, and how many answers have them."""
    props = table(spark, sf_dir, "events").select(F.concat(F.lit('[{"head": "h'), F.get_json_object("props", "$.k"), F.lit('", "assertion": "'), "event_type", F.lit('"}, {"head": "x", "assertion": "Absent"}]')).alias("answer"))
    parsed = props.unionByName(_values(spark, ANSWERS, "answer")).select(infer.parse_facts(infer.strip_thinking(F.col("answer"))).alias("facts"))
    sizes = ops.repacked(parsed).select(*[F.size(f"graph.{b}").cast("long").alias(b) for b in BUCKETS])
    return sizes.groupBy(*BUCKETS).agg(F.count("*").alias("n"))


def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question part of each record's prompt with its fused candidates: number of messages and last content."""
    f = facts(spark, sf_dir)
    c = candidates_fused(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", "target_head", "target_assertion", "confidence", "source_section"))).alias("c"))
    x = ops.case_texts(f).join(c, "record_id", "left")
    none = F.expr("cast(array() as array<struct<finding_text:string,impression_json:string>>)")
    m = x.select("record_id", infer.prompt(F.col("finding_text"), none, F.coalesce("c", F.expr("cast(array() as array<struct<rank:int,target_head:string,target_assertion:string,confidence:double,source_section:string>>)"))).alias("m"))
    return m.select("record_id", F.size("m").cast("long").alias("n_messages"), F.element_at("m", -1)["content"].alias("question"))


def _told(flat: DataFrame) -> DataFrame:
    said = lambda c: F.array_join(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""), "|").alias(c)
    return flat.select(F.col("record_id").cast("long").alias("record_id"), "section", "bucket", "raw_head", "raw_assertion", said("locations"), said("modifiers"), F.size("suggestive_of").cast("long").alias("n_edges"))


def records_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records written as JSON lines, read by their schema and made flat again."""
    path = sources.scratch(spark, "records")
    sources.write_records(nested_records(fact_view(spark, sf_dir)), path)
    return _told(flat_facts(sources.read_records(spark, path, strict=True)))


def records_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as JSON lines in which every other record has its locations as objects, read part by part."""
    objects = lambda f: f.withField("locations", F.transform(f["locations"], lambda x: F.struct(x.alias("text"))))
    graph = lambda c: F.struct(*[F.transform(F.col(c)[b], objects).alias(b) for b in BUCKETS]).alias(c)
    names = ("findings_graph_compact", "impression_graph_compact")
    r = nested_records(fact_view(spark, sf_dir))
    line = F.when(F.col("id") % 2 == 0, F.to_json(F.struct("id", *names))).otherwise(F.to_json(F.struct("id", *[graph(c) for c in names])))
    path = sources.scratch(spark, "unions")
    r.select(line.alias("value")).write.text(path)
    return _told(flat_facts(sources.read_records(spark, path)))


def with_impression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose impression has a fact."""
    r = nested_records(fact_view(spark, sf_dir))
    return r.where(any_fact(F.col("impression_graph_compact"))).select(F.col("id").alias("record_id"))


def reports_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.scratch(spark, "zips")
    sources.write_zips(reports(spark, sf_dir), path)
    return sections.metadata(sources.read_zip(spark, path))


def reports_in_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.scratch(spark, "folders")
    subject, study = sections.ids_from_path(F.col("path"))
    reports(spark, sf_dir).select(subject.alias("subject"), study.alias("study"), "text").write.partitionBy("subject", "study").text(path)
    found = sources.read_folder(spark, path)
    at = lambda name: F.regexp_extract("path", f"{name}=([^/]+)", 1).alias(name)
    return found.select(at("subject"), at("study"), sections.sections(F.col("text")).alias("s")).select("subject", "study", "s.findings", "s.impression")


def knowledge_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table as a keyed JSON export, read back."""
    path = sources.scratch(spark, "edges")
    sources.write_json_table(knowledge.as_json(suggestive_edges(spark, sf_dir)), path)
    row = "array<struct<rank:int,target_head:string,target_assertion:string,source_assertion:string,source_section:string,count:long,confidence:double>>"
    return spark.read.schema("source_head string, rows string").json(path).select("source_head", F.explode(F.from_json("rows", row)).alias("r")).select("source_head", "r.*")


def pair_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.scratch(spark, "pairs")
    sources.write_json_table(knowledge.pairs_as_json(pair_table(spark, sf_dir)), path)
    row = "array<struct<rank:int,target_head:string,target_assertion:string,count:long,denominator:long,confidence:double>>"
    return spark.read.schema("pair string, rows string").json(path).select("pair", F.explode(F.from_json("rows", row)).alias("r")).select("pair", "r.*")


def norm_map_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of heads and of locations as JSON exports, read back as (kind, raw, value)."""
    f, path = fact_view(spark, sf_dir), sources.scratch(spark, "maps")
    sources.write_json_table(ops.head_map(f), f"{path}/heads")
    sources.write_json_table(ops.location_map(f), f"{path}/locations")
    heads = spark.read.schema("raw string, canonical string").json(f"{path}/heads").select(F.lit("head").alias("kind"), "raw", F.col("canonical").alias("value"))
    places = spark.read.schema("raw string, laterality string, region string, lobe string, needs_review boolean").json(f"{path}/locations")
    return heads.unionByName(places.select(F.lit("location").alias("kind"), "raw", F.concat_ws("|", "laterality", "region", "lobe", F.col("needs_review").cast("string")).alias("value")))


def knowledge_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of pairs from knowledge tables that were saved and loaded."""
    f, path = _kept(facts(spark, sf_dir)), sources.scratch(spark, "knowledge")
    knowledge.write(path, knowledge.edge_table(f), knowledge.pair_table(f))
    edges, pairs = knowledge.load(spark, path)
    return knowledge.fused(f, edges, pairs)


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.pair_stats(pair_table(spark, sf_dir))


def candidates_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair candidates from a table of which the pairs with something present are known by heads only, as in older tables."""
    f = facts(spark, sf_dir)  # read twice for a few columns; what is kept is the pair table
    pairs = _kept(knowledge.pair_table(f))
    both = [F.least("left_head", "right_head").alias("left_head"), F.greatest("left_head", "right_head").alias("right_head")]
    old = pairs.groupBy(*both, "target_head", "target_assertion").agg(F.max("count").alias("count"), F.max("confidence").alias("confidence"))
    found = knowledge.pair_candidates(f, pairs.where("right_assertion <> 'present'"), legacy=old)
    return found.withColumn("supporting_pairs", F.array_join("supporting_pairs", ";"))


def bm25_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk with an index that was saved and loaded."""
    path = sources.scratch(spark, "index")
    retrieval.build(documents(spark, sf_dir)).write(path)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words(F.col("text")).alias("tokens"))
    return retrieval.search(asked, retrieval.Index.load(spark, path), 10).select("qid", "rank", "did", F.round("score", 6).alias("score"))


def score_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that are no finite numbers: how many lines have which."""
    odd = lambda x: F.lit(x).cast("double")
    score = F.when(F.col("l_tax") == 0, odd("NaN")).when(F.col("l_discount") == 0, odd("-Infinity")).when(F.col("l_quantity") > 45, odd("Infinity")).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(retrieval.finite(score).alias("score")).groupBy("score").agg(F.count("*").alias("n"))


def head_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads by a dictionary that goes before the rule."""
    raw = fact_view(spark, sf_dir).select(F.col("raw_head").alias("raw")).distinct()
    return raw.select("raw", norm.head(F.col("raw"), lemmas=LEMMAS).alias("canonical"))


def verify_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.details(verify_checks(spark, sf_dir))


def verify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.as_json(verify_checks(spark, sf_dir))


def impression_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.impression_json(fact_view(spark, sf_dir))


def infer_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole inference with a stand-in for the model: records whose id is divisible by 100 are asked, with the most similar
    of all other records as examples."""
    f = _kept(facts(spark, sf_dir, once=True))
    # what is asked and the tables of knowledge are small, and read several times
    asked, edges, pairs = (_kept(x, also=True) for x in (f.where("record_id % 100 = 0"), knowledge.edge_table(f), knowledge.pair_table(f)))
    answer = lambda messages: f'<think>[]</think>[{{"head": "n{len(messages)}", "assertion": "present"}}]'
    out = infer.infer_impressions(asked, edges, pairs, answer, cases=f)
    first = F.when(F.size("messages") > 6, F.get("messages", F.lit(5))["content"])
    return out.select("record_id", F.size("messages").cast("long").alias("n_messages"), first.alias("first_shot"), F.get("facts", F.lit(0))["head"].alias("head"), "error")


def infer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run over all records with a stand-in that fails or says nothing by the length of the question."""
    f = _kept(facts(spark, sf_dir))

    def answer(messages: list[dict]) -> str:
        n = len(messages[-1]["content"])
        if n % 7 == 0:
            raise ValueError("no answer")
        return "nothing" if n % 5 == 0 else '[{"head": "pneumonia", "assertion": "present"}]'

    prompts = infer.prompts(f, knowledge.edge_table(f), knowledge.pair_table(f))
    out = sources.stored(infer.infer(prompts, answer), "answers")
    said = ops.normalized(infer.predicted_facts(out))
    every = f.where("section = 'finding'").select(*said.columns).unionByName(said)
    return infer.counters(out, verify.trace(verify.checks(every)))


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of 100 orders: the smallest hashes of seed and id."""
    return sections.sampled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, seed=42)


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text another has too: redundancy over whole texts, by a count next to each row's digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    again = d.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return d.join(again, "digest").select("doc_id", "digest", "n")


QUERIES = {f.__name__: f for f in (
    head_norm, assertion_norm, location_norm, norm_stats, region_other_top, suggestive_edges, edge_stats, pair_table, candidates_single, no_acute_rule,
    candidates_pair, candidates_fused, case_tokens, case_text, bm25_stats, bm25_topk, retrieval_recall, knowledge_recall, knowledge_recall_compat,
    knowledge_by_head, verify_checks, verify_trace, verify_report, inject_catch, fact_f1, fact_f1_small, eval_summary, verbalize_fact, verbalize_record,
    report_sections, report_lines, ingest_counters, max_records, parse_facts, repacked_graph, prompt_messages, sample_records, duplicate_texts,
    records_strict, records_unions, with_impression, reports_zipped, reports_in_folders, knowledge_export, pair_export, norm_map_export, knowledge_reload,
    pair_stats, candidates_legacy, bm25_reload, score_scrub, head_lemmas, verify_details, verify_json, impression_answers, infer_shots, infer_counters,
)}
