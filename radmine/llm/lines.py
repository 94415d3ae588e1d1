"""Deletion of repeated runs of lines by winnowing over line hashes (DataFrame functions only).

The non-blank lines of a document are hashed. Of every window of `window` consecutive lines the line with the smallest hash
is selected as the window's fingerprint, so a run of that many lines has one wherever it occurs; a line of at least
`min_chars` characters is a window of its own. Fingerprints that occur at one place only are dropped, which is most. What
is left is extended to its whole window, before and behind, and windows that match an earlier place go. Windows overlap,
so a longer run goes as a whole, each of its windows having a fingerprint. Only keys are aggregated and joined: no pairs of
occurrences are made, whatever the number of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

#: Lines of a window; characters of a line that counts by itself.
WINDOW, MIN_CHARS = 2, 30


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, window: int, min_chars: int) -> DataFrame:
    """(kd, kt, no_id, at, lines, fp, wh): the windows of each row; `at` is the index of the line that was selected, fp its
    hash, wh the hash of the whole window, lines the indexes of its lines. Windows of which every line counts by itself are
    left out: they match where their lines do."""
    a = F.filter(F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda a: a["x"] != "")
    d = docs.select(F.col(id_col).alias("kd"), F.xxhash64(F.col(text_col)).alias("kt"), F.transform(a, lambda a: F.struct(a["i"].alias("i"), F.xxhash64(a["x"]).alias("h"), F.xxhash64(F.lit("line"), a["x"]).alias("h2"), (F.length(a["x"]) >= min_chars).alias("long"))).alias("a"))
    d = d.where(F.size("a") > 0)

    def unit(i: Column) -> Column:
        part = F.slice("a", i + 1, window)
        least = F.array_min(F.transform(part, lambda a: F.struct(a["h"].alias("h"), a["i"].alias("i"))))
        whole = F.struct(least["i"].alias("at"), F.transform(part, lambda a: a["i"]).alias("lines"), least["h"].alias("fp"), F.xxhash64(F.transform(part, lambda a: a["h2"])).alias("wh"))
        return F.when(F.exists(part, lambda a: ~a["long"]), whole)

    none = F.expr("cast(array() as array<struct<at:int,lines:array<int>,fp:bigint,wh:bigint>>)")
    windows = F.when(F.size("a") >= window, F.array_compact(F.transform(F.sequence(F.lit(0), F.size("a") - window), unit))).otherwise(none)
    alone = F.transform(F.filter("a", lambda a: a["long"]), lambda a: F.struct(a["i"].alias("at"), F.array(a["i"]).alias("lines"), a["h"].alias("fp"), a["h2"].alias("wh")))
    return d.select("kd", "kt", F.explode(F.concat(windows, alone)).alias("u")).select("kd", "kt", F.col("kd").isNull().alias("no_id"), "u.at", "u.lines", "u.fp", "u.wh")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with `text_col` rid of later repeated runs, plus removed (indexes of the deleted lines), n_lines (non-blank).

    A line goes if it is part of `window` consecutive non-blank lines (compared without spaces at their ends), or is by
    itself a line of at least `min_chars` characters, that occur before in (id, position) order, in another document or the
    same one. Blank lines neither count nor go. What stays is joined by newlines as it was.

    Null text stays null, with no lines. Null ids come last in the order and each text of theirs is a document. Rows that
    repeat one id and text are one document: all keep the same lines. Empty tables give empty results; other columns
    pass through, whatever their names other than removed and n_lines, which are replaced.
    """
    units = stored(fingerprints(docs, id_col, text_col, window, min_chars), "fingerprints")
    selected = F.struct("no_id", "kd", "kt", "at")
    repeated = units.groupBy("fp").agg(F.min(selected).alias("first"), F.max(selected).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("fp")
    matched = stored(units.join(repeated, "fp", "left_semi"), "matched-fingerprints")
    place = F.struct("no_id", "kd", "kt", F.col("lines")[0].alias("start"))
    firsts = matched.groupBy("fp", "wh").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = matched.join(firsts, ["fp", "wh"]).where(~place.eqNullSafe(F.col("origin")))
    base = docs.drop("removed", "n_lines")
    names = base.columns
    kd, kt, found = (fresh(x, *names, "removed", "n_lines") for x in ("kd", "kt", "gone"))
    gone = later.select("kd", "kt", F.explode("lines").alias("i")).groupBy("kd", "kt").agg(F.collect_set("i").alias("gone")).select(F.col("kd").alias(kd), F.col("kt").alias(kt), F.col("gone").alias(found))
    out = base.join(gone, F.col(kd).eqNullSafe(base[id_col]) & (F.xxhash64(base[text_col]) == F.col(kt)), "left")
    lines = _lines(base[text_col])
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda a: ~F.array_contains(found, a["i"])), lambda a: a["x"]), "\n")
    return out.select(
        *[(F.when(F.col(found).isNull(), base[c]).otherwise(kept).alias(c) if c == text_col else base[c]) for c in names],
        F.array_sort(F.coalesce(found, F.expr("cast(array() as array<int>)"))).alias("removed"),
        F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)).alias("n_lines"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "text")


def stage(docs: DataFrame) -> DataFrame:
    """For the pipeline: documents of which nothing but blank lines stays, but had lines, go; n_chars follows the text. Null
    and empty texts stay; so do repeated rows, which keep the same lines. Columns called removed or n_lines are left alone."""
    names = docs.columns
    inside = docs.select(F.struct(*names).alias("row"), "doc_id", "text")
    out = dedup_lines(inside).where((F.size("removed") == 0) | (F.size("removed") < F.col("n_lines")))
    changed = F.size("removed") > 0
    of = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in names else {"text": F.col("text")}
    return out.select(*[of.get(c, F.col("row")[c]).alias(c) for c in names])


#: Lines gone, by SQL: {docs} is the table.
GONE_SQL = r"""
l0 AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, trim(unnest(string_split(text, chr(10))), ' ') AS x FROM {docs}),
l AS (SELECT *, lead(x) OVER w AS y, lead(i) OVER w AS j FROM l0 WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT doc_id, i, j, x, y, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, i) AS nth FROM l WHERE y IS NOT NULL),
v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS nth FROM l WHERE length(x) >= 30),
g AS (SELECT doc_id, i FROM u WHERE nth > 1 UNION SELECT doc_id, j FROM u WHERE nth > 1 UNION SELECT doc_id, i FROM v WHERE nth > 1),
k AS (SELECT l0.doc_id, string_agg(raw.x, chr(10) ORDER BY l0.i) FILTER (g.i IS NULL) AS text, count(*) FILTER (l0.x <> '') AS n_lines, count(g.i) AS n_removed
      FROM l0 JOIN (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS x FROM {docs}) raw ON raw.doc_id = l0.doc_id AND raw.i = l0.i
      LEFT JOIN g ON g.doc_id = l0.doc_id AND g.i = l0.i GROUP BY l0.doc_id)"""

OP2_SQL = "WITH" + GONE_SQL.format(docs="documents") + """
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
