"""Reports in sections: header lines open one, other lines belong to the last opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import norm
from ..vocab import SECTION_HEADERS

# Forms of header lines, line ends and report paths.
HEADER = r"^[\s\x1c-\x1f\x85\xa0]*([A-Z][A-Z0-9 /,()\-]+?)\s*:\s*(.*)$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
REPORT_PATH = r"(?:^|/)files/p\d+/p(\d+)/s(\d+)\.txt$"


def clean(text: Column) -> Column:
    """One line: all white space to single spaces."""
    return norm.squeeze(text)


def sections(text: Column) -> Column:
    """struct(findings, impression) of a report's text, folded over its lines. A header with other names closes a section;
    what follows a colon belongs to the section; sections that come again are continued. Null text: empty sections."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    start = F.struct(F.lit(None).cast("string").alias("now"), F.lit("").alias("findings"), F.lit("").alias("impression"))

    def step(state: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?U)\s+$", "")
        label = F.regexp_extract(line, HEADER, 1)
        is_header = label != ""
        now = F.when(is_header, norm.lookup(SECTION_HEADERS, F.regexp_replace(norm.squeeze(label), r"\.+$", ""))).otherwise(state["now"])
        more = F.when(is_header, F.regexp_extract(line, HEADER, 2)).otherwise(line)
        add = lambda s: F.when(now == s, F.concat(state[s], F.lit("\n"), more)).otherwise(state[s]).alias(s)
        return F.struct(now.alias("now"), add("findings"), add("impression"))

    return F.aggregate(lines, start, step, lambda s: F.struct(clean(s["findings"]).alias("findings"), clean(s["impression"]).alias("impression")))


def ids_from_path(path: Column) -> tuple[Column, Column]:
    """(subject id, study id) from a report's path; empty texts where it has another form."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_extract(p, REPORT_PATH, 1), F.regexp_extract(p, REPORT_PATH, 2)


def metadata(reports: DataFrame, dataset: str = "reports", require_findings: bool = False, require_impression: bool = False, max_records: int = -1, keep_raw: bool = False) -> DataFrame:
    """Rows (id, source_dataset, subject_id, study_id, report_path, Findings, Impression[, raw_report]) of (path, text).

    max_records counts reports seen, in path order, before any filter (-1: all). Reports without both sections go. The id
    is the study's, or a digest of the path where that has none.
    """
    if max_records < -1:
        raise ValueError("max_records must be -1 or more")

    subject, study = ids_from_path(F.col("path"))
    r = reports.withColumns({"subject_id": subject, "study_id": study, "s": sections(F.col("text"))})
    if max_records >= 0:
        r = r.orderBy("path").limit(max_records)
    r = r.where((F.col("s.findings") != "") | (F.col("s.impression") != ""))
    r = r.where(F.col("s.findings") != "") if require_findings else r
    r = r.where(F.col("s.impression") != "") if require_impression else r
    name = F.when(F.col("study_id") != "", F.concat(F.lit("s"), "study_id")).otherwise(F.concat(F.lit("report-"), F.md5(F.col("path").cast("binary"))))
    out = [name.alias("id"), F.lit(dataset).alias("source_dataset"), "subject_id", "study_id", F.col("path").alias("report_path"), F.col("s.findings").alias("Findings"), F.col("s.impression").alias("Impression")]
    return r.select(*out, *([F.col("text").alias("raw_report")] if keep_raw else []))


def counters(reports: DataFrame) -> DataFrame:
    """One row: reports seen, without findings, without impression, with both."""
    s = reports.select(sections(F.col("text")).alias("s"))
    no = lambda c: F.count_if(F.col(f"s.{c}") == "")
    return s.agg(F.count("*").alias("seen"), no("findings").alias("missing_findings"), no("impression").alias("missing_impression"), F.count_if((F.col("s.findings") != "") & (F.col("s.impression") != "")).alias("both"))


def sampled(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of n rows: those with the smallest hashes of seed and id (ties by id). Fewer rows: all."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)


def carried(lines: DataFrame, by: str, order: str) -> DataFrame:
    """The same carry-forward where a report's lines are rows: (by, order, line) with section, the last header's at or
    before each line (header lines included), null where another header closed it."""
    label = F.regexp_extract(F.regexp_replace("line", r"(?U)\s+$", ""), HEADER, 1)
    opened = F.when(label != "", F.coalesce(norm.lookup(SECTION_HEADERS, norm.squeeze(label)), F.lit("")))
    last = F.last(opened, ignorenulls=True).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("section", F.nullif(last, F.lit("")))
