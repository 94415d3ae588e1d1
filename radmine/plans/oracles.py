"""The queries as SQL that DuckDB runs on the same tables: name -> statement. Written against the tables, not against the
engine: normalization is spelt out once per distinct text and joined."""

from __future__ import annotations

from ..operators import infer, verify
from ..vocab import (
    BUCKETS,
    CHRONIC_HEADS,
    DEVICE_HEADS,
    DEVICE_OR_POSTOP_HEADS,
    HEAD_ALIASES,
    INCIDENTAL_HEADS,
    IRREGULAR_PLURALS,
    LEGAL_HEADS,
    LOBES,
    NON_ACUTE_MODIFIERS,
    NORMAL_HEADS,
    NOT_PLURAL,
    REGIONS,
)
from .adapters import HEADS, MODIFIERS, PLACES
from .queries import ANSWERS, HEAD_GOLDENS, LEMMAS, PLACE_GOLDENS, SAID


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


def _array(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _case(table: dict[str, str], x: str, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in table.items()) + f" ELSE {other} END"


def said(x: str, other: str = "'unknown'") -> str:
    return f"CASE WHEN contains(lower({x}), 'absent') THEN 'absent' WHEN contains(lower({x}), 'uncertain') THEN 'uncertain' WHEN contains(lower({x}), 'present') THEN 'present' ELSE {other} END"


BY_BUCKET = "CASE bucket WHEN 'positive' THEN 'present' WHEN 'negative' THEN 'absent' WHEN 'uncertain' THEN 'uncertain' ELSE 'unknown' END"


def heads_cte(source: str) -> str:
    """hn(raw, canon, guarded) for the texts of a one-column source."""

    def one(keep: str) -> str:
        return f"""CASE WHEN w IN {_list(IRREGULAR_PLURALS)} THEN {_case(IRREGULAR_PLURALS, "w", "w")}
        WHEN NOT ends_with(w, 's') OR w IN {_list(NOT_PLURAL)} {keep} THEN w
        WHEN ends_with(w, 'ies') AND length(w) > 4 THEN w[:-4] || 'y'
        WHEN length(w) > 3 AND regexp_matches(w, '(x|s|z|ch|sh)es$') THEN w[:-3]
        WHEN length(w) > 3 THEN w[:-2] ELSE w END"""

    return f"""
hn0 AS (SELECT DISTINCT raw, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')),
    '\\bwithin normal limits?\\b', 'normal', 'g'), '\\bwithin normal\\b', 'normal', 'g'), '\\bnormal limits?\\b', 'normal', 'g') AS s FROM ({source})),
hn1 AS (SELECT raw, s, split_part(s, ' ', -1) AS w FROM hn0),
hn AS (SELECT raw, {_case(HEAD_ALIASES, "s", f"left(s, length(s) - length(w)) || {one('')}")} AS canon,
    {_case(HEAD_ALIASES, "s", f"left(s, length(s) - length(w)) || {one("OR regexp_matches(w, '(ss|sis|us)$')")}")} AS guarded FROM hn1)"""


def places_cte(source: str) -> str:
    """pn(raw, lat, review, region, lobe)."""
    region = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, {_q(w)})" for w in words) + f" THEN {_q(name)}" for name, words in REGIONS) + " ELSE 'other' END"
    return f"""
pn0 AS (SELECT DISTINCT raw, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS t FROM ({source})),
pn1 AS (SELECT *, regexp_matches(t, '\\bbilateral(ly)?\\b') AS bi, regexp_matches(t, '\\bleft\\b') AS le, regexp_matches(t, '\\bright\\b') AS ri,
    regexp_matches(t, '\\bunilateral(ly)?\\b') AS un, regexp_extract(t, '\\b(upper|middle|lower|apical|basilar|basal)\\b|bibasilar') AS lb FROM pn0),
pn AS (SELECT raw, CASE WHEN bi OR (le AND ri) THEN 'bilateral' WHEN le THEN 'left' WHEN ri THEN 'right' ELSE 'none' END AS lat,
    CASE WHEN NOT bi AND le AND ri THEN true ELSE un END AS review, {region} AS region, {_case(LOBES, "lb", "'none'")} AS lobe FROM pn1)"""


VIEW = f"""
v0 AS (SELECT l_orderkey AS record_id, CASE WHEN l_linenumber <= 3 THEN 'finding' ELSE 'impression' END AS section,
    CASE WHEN l_quantity < 3 THEN 'other' WHEN l_returnflag = 'A' THEN 'positive' WHEN l_returnflag = 'N' THEN 'negative' ELSE 'uncertain' END AS bucket,
    {_array(HEADS)}[l_partkey % {len(HEADS)} + 1] AS raw_head,
    CASE WHEN l_discount = 0 THEN '' ELSE CASE WHEN l_linestatus = 'F' THEN 'measurement::' ELSE '' END
      || CASE l_returnflag WHEN 'A' THEN 'definitely present' WHEN 'N' THEN 'Definitely Absent' ELSE 'uncertain' END END AS raw_assertion,
    CASE WHEN l_partkey % 3 <> 0 THEN [{_array(PLACES)}[l_suppkey % {len(PLACES)} + 1]] ELSE [] END
      || CASE WHEN l_linenumber % 2 = 0 THEN [{_array(PLACES)}[l_partkey % {len(PLACES)} + 1]] ELSE [] END AS locations,
    CASE WHEN l_quantity > 25 THEN [{_array(MODIFIERS)}[l_suppkey % {len(MODIFIERS)} + 1]] ELSE [] END
      || CASE WHEN l_quantity > 40 THEN [{_array(MODIFIERS)}[l_partkey % {len(MODIFIERS)} + 1]] ELSE [] END AS modifiers,
    CASE WHEN l_tax > 0.04 THEN {_array(HEADS)}[(l_partkey * 7) % {len(HEADS)} + 1] END AS t1,
    CASE WHEN l_discount > 0.05 THEN 'uncertain' ELSE 'present' END AS a1,
    CASE WHEN l_tax > 0.06 THEN {_array(HEADS)}[(l_partkey * 11 + l_suppkey) % {len(HEADS)} + 1] END AS t2,
    l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem),
v1 AS (SELECT *, CASE bucket WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 WHEN 'uncertain' THEN 2 ELSE 3 END AS bucket_ord FROM v0),
v AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY section, bucket_ord, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS pos FROM v1)"""
TEXTS = f"SELECT unnest({_array(HEADS)} || {_array(MODIFIERS)}) AS raw"
#: f: facts; e: edges (t by finding else head, tf by finding only); loc: places of facts, blank ones left out.
BASE = f"""WITH {VIEW[1:]},{heads_cte(TEXTS)},{places_cte(f"SELECT unnest({_array(PLACES)}) AS raw")},
f AS (SELECT record_id, section, bucket, bucket_ord, pos, raw_head, raw_assertion, locations, modifiers, t1, a1, t2, hn.canon AS head, {said("raw_assertion")} AS assertion
    FROM v JOIN hn ON hn.raw = v.raw_head),
e AS (SELECT record_id, section, bucket_ord, pos, head, assertion, 1 AS i, h.canon AS t, h.canon AS tf, a1 AS ta FROM f JOIN hn h ON h.raw = t1
    UNION ALL SELECT record_id, section, bucket_ord, pos, head, assertion, 2, h.canon, '', 'absent' FROM f JOIN hn h ON h.raw = t2),
loc AS (SELECT record_id, section, pos, i, pn.* FROM (SELECT record_id, section, pos, unnest(locations) AS raw, generate_subscripts(locations, 1) AS i FROM f) x JOIN pn USING (raw) WHERE trim(raw) <> '')"""

EDGES = """,
tot AS (SELECT head AS source_head, count(*) AS total FROM f WHERE t1 IS NOT NULL AND head <> '' GROUP BY head),
ec AS (SELECT head AS source_head, assertion AS source_assertion, t AS target_head, ta AS target_assertion, count(*) AS "count",
    CASE WHEN min(section) = max(section) THEN min(section) ELSE 'both' END AS source_section FROM e WHERE head <> '' AND t <> '' GROUP BY ALL),
ed AS (SELECT source_head, source_assertion, target_head, target_assertion, source_section, "count", "count" / total AS confidence,
    row_number() OVER (PARTITION BY source_head ORDER BY "count" DESC, target_head, target_assertion, source_assertion)::INT AS rank FROM ec JOIN tot USING (source_head))"""

PAIRS = f""",
fk AS (SELECT DISTINCT record_id, section, head, {said("raw_assertion", BY_BUCKET)} AS a FROM f WHERE head <> ''),
pi AS (SELECT * FROM fk WHERE section = 'finding' AND a <> 'unknown'),
pt AS (SELECT DISTINCT record_id, head AS target_head, a AS target_assertion FROM fk WHERE section = 'impression' AND a <> 'unknown'
    UNION SELECT record_id, t, ta FROM e WHERE section = 'impression' AND t <> ''),
pp AS (SELECT x.record_id, x.a AS left_assertion, x.head AS left_head, y.a AS right_assertion, y.head AS right_head FROM pi x JOIN pi y ON x.record_id = y.record_id AND (x.a, x.head) < (y.a, y.head)
    WHERE x.record_id IN (SELECT record_id FROM pt)),
pd AS (SELECT left_assertion, left_head, right_assertion, right_head, count(*) AS denominator FROM pp GROUP BY ALL HAVING count(*) >= 3),
pc AS (SELECT left_assertion, left_head, right_assertion, right_head, target_head, target_assertion, count(*) AS "count" FROM pp JOIN pt USING (record_id) GROUP BY ALL),
pr AS (SELECT *, "count" / denominator AS confidence, row_number() OVER (PARTITION BY left_assertion, left_head, right_assertion, right_head ORDER BY "count" DESC, target_head, target_assertion)::INT AS rank
    FROM pc JOIN pd USING (left_assertion, left_head, right_assertion, right_head)),
pair AS (SELECT * FROM pr WHERE rank <= 10)"""

_words = _list(NON_ACUTE_MODIFIERS)
RULE = f""",
rf AS (SELECT record_id, bucket, bucket_ord, pos, head, {said("raw_assertion", BY_BUCKET)} AS said,
    head IN {_list((*NORMAL_HEADS, *DEVICE_OR_POSTOP_HEADS, *INCIDENTAL_HEADS))}
    OR (head IN {_list(CHRONIC_HEADS)} AND list_has_any(mods, {_array(NON_ACUTE_MODIFIERS)}))
    OR (list_has_any(mods || string_split(head, ' '), {_array(NON_ACUTE_MODIFIERS)}) AND (contains(head, 'fracture') OR contains(head, 'deformity'))) AS allowed
    FROM (SELECT f.*, [(SELECT canon FROM hn WHERE raw = m) FOR m IN []::VARCHAR[]] || list_transform(modifiers, lambda m: trim(lower(m))) AS mods FROM f) z WHERE section = 'finding' AND head <> ''),
rs AS (SELECT *, bucket <> 'negative' AND said <> 'absent' AS seen FROM rf),
neg AS (SELECT record_id, head, row_number() OVER (PARTITION BY record_id ORDER BY pos, head, said) AS n FROM rs WHERE bucket = 'negative'),
ok AS (SELECT record_id FROM rs GROUP BY record_id HAVING NOT bool_or(seen AND NOT allowed AND said IN ('present', 'uncertain')) AND (bool_or(seen) OR bool_or(bucket = 'negative'))),
ev AS (SELECT record_id, head, 0 AS late, CASE bucket WHEN 'positive' THEN 0 WHEN 'uncertain' THEN 8 ELSE 9 END AS o, pos FROM rs WHERE seen AND allowed
    UNION ALL SELECT record_id, head, 1, 0, n FROM neg WHERE n <= 8),
fired AS (SELECT record_id, coalesce(string_agg(head, ';' ORDER BY late, o, pos, head), '') AS evidence FROM ok LEFT JOIN ev USING (record_id) GROUP BY record_id)"""
RULE = RULE.replace("[(SELECT canon FROM hn WHERE raw = m) FOR m IN []::VARCHAR[]] || ", "")

SCORE = 'round(confidence * pow("count", 0.3), 6)'


def candidate_cte(asked: str, by: str, topk: int) -> str:
    """cand for asked(by..., head, want, fired)."""
    fixed = lambda t, a, s, sec, n, c, o, r: f"SELECT {by}, '{t}', '{a}', '{s}', '{sec}', {n}::BIGINT, {c}::DOUBLE, {o}, {r} FROM ask"
    device = f"WHERE NOT (fired AND most IS NULL) AND head IN {_list(DEVICE_HEADS)} AND coalesce(most, 0) < 3"
    return f""",
most AS (SELECT source_head AS head, max("count") AS most FROM ed GROUP BY source_head),
ask AS (SELECT a.*, most FROM ({asked}) a LEFT JOIN most USING (head)),
c0({by}, target_head, target_assertion, source_assertion, source_section, "count", confidence, o, r) AS (
    {fixed("acute cardiopulmonary abnormality", "absent", "mixed", "rule:no_acute", 100000, 0.9, 1, 0)} WHERE fired
    UNION ALL {fixed("atelectasis", "present", "present", "rule", 250, 0.3, 0, 0)} {device}
    UNION ALL {fixed("pneumothorax", "present", "present", "rule", 200, 0.25, 0, 1)} {device}
    UNION ALL SELECT {by}, target_head, target_assertion, source_assertion, source_section, "count", confidence, 2, rank FROM ask JOIN ed ON ed.source_head = ask.head
      WHERE "count" >= 3 AND (want IS NULL OR want = source_assertion)),
c1 AS (SELECT *, {SCORE} AS score FROM c0),
cand AS (SELECT * EXCLUDE (o, r), row_number() OVER (PARTITION BY {by} ORDER BY score DESC, o, r)::INT AS rank FROM c1 {f"QUALIFY rank <= {topk}" if topk else ""})"""


PAIR_CANDIDATES = f""",
px AS (SELECT DISTINCT record_id, head, assertion FROM f WHERE section = 'finding' AND head <> ''),
pq AS (SELECT x.record_id, x.assertion AS left_assertion, x.head AS left_head, y.assertion AS right_assertion, y.head AS right_head FROM px x JOIN px y ON x.record_id = y.record_id AND (x.assertion, x.head) < (y.assertion, y.head)),
ph AS (SELECT *, {SCORE} AS s, left_assertion || '|' || left_head || ' + ' || right_assertion || '|' || right_head AS name FROM pq JOIN pair USING (left_assertion, left_head, right_assertion, right_head) WHERE "count" >= 3),
pg AS (SELECT record_id, target_head, target_assertion, 'mixed' AS source_assertion, 'pair' AS source_section, max("count") AS "count", max(confidence) AS confidence,
    sum((s * 1e6)::DECIMAL(20, 0))::DOUBLE / 1e6 AS score, count(*) AS n_pairs, string_agg(name, ';' ORDER BY name) AS supporting_pairs FROM ph GROUP BY record_id, target_head, target_assertion),
pcand AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, "count" DESC, target_head, target_assertion)::INT AS rank FROM pg QUALIFY rank <= 5)"""

FUSED = (
    BASE + EDGES + PAIRS + RULE
    + candidate_cte("SELECT f.record_id, bucket_ord, pos, head, CASE WHEN raw_assertion <> '' THEN assertion END AS want, fired.record_id IS NOT NULL AS fired FROM f LEFT JOIN fired USING (record_id) WHERE section = 'finding' AND head <> ''", "record_id, bucket_ord, pos", 5)
    + PAIR_CANDIDATES
    + """,
fu AS (SELECT record_id, target_head, target_assertion, source_assertion, source_section, "count", confidence, score, 0 AS late, bucket_ord, pos, rank AS r FROM cand
    UNION ALL SELECT record_id, target_head, target_assertion, source_assertion, source_section, "count", confidence, score, 1, 0, 0, rank FROM pcand),
fd AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY record_id, target_head, target_assertion ORDER BY late, bucket_ord, pos, r) = 1),
fused AS (SELECT record_id, target_head, target_assertion, source_assertion, source_section, "count", confidence, score,
    row_number() OVER (PARTITION BY record_id ORDER BY score DESC, late, bucket_ord, pos, r)::INT AS rank FROM fd QUALIFY rank <= 10)"""
)

SHORT = f"CASE {said('raw_assertion')} WHEN 'absent' THEN 'abs' WHEN 'present' THEN 'pre' ELSE 'unc' END"
TOKENS = f""",
tk AS (SELECT record_id, pos, 0 AS i, 'asp' || {SHORT} || ' ' || replace(head, ' ', '_') AS t FROM f WHERE section = 'finding' AND head <> ''
    UNION ALL SELECT record_id, pos, i, 'lat_' || lat || ' reg_' || region || CASE WHEN lobe <> 'none' THEN ' lobe_' || lobe ELSE '' END FROM loc WHERE section = 'finding'),
toks AS (SELECT record_id, string_agg(t, ' ' ORDER BY pos, i) AS tokens FROM tk GROUP BY record_id)"""

PLACE = "concat_ws(' ', nullif(lat, 'none'), nullif(region, 'other'), nullif(lobe, 'none'))"
CASE_TEXTS = f""",
pl AS (SELECT record_id, section, pos, string_agg({PLACE}, '; ' ORDER BY i) FILTER ({PLACE} <> '') AS places FROM loc GROUP BY ALL),
tg AS (SELECT record_id, section, pos, string_agg(tf, ', ' ORDER BY i) FILTER (tf <> '') AS targets FROM e GROUP BY ALL),
tl AS (SELECT f.record_id, f.section, f.bucket_ord, f.pos, CASE {SHORT} WHEN 'pre' THEN '+' WHEN 'abs' THEN '-' ELSE '=' END || ' ' || head AS start, places, targets
    FROM f LEFT JOIN pl USING (record_id, section, pos) LEFT JOIN tg USING (record_id, section, pos) WHERE head <> ''),
ct AS (SELECT record_id, coalesce(string_agg(start || CASE WHEN places <> '' THEN ' | ' || places ELSE '' END, chr(10) ORDER BY bucket_ord, pos) FILTER (section = 'finding'), '') AS finding_text,
    coalesce(string_agg(start || CASE WHEN targets <> '' THEN '  >> ' || targets ELSE '' END, chr(10) ORDER BY bucket_ord, pos) FILTER (section = 'impression'), '') AS impression_text FROM tl GROUP BY record_id),
texts AS (SELECT r.record_id, coalesce(finding_text, '') AS finding_text, coalesce(impression_text, '') AS impression_text FROM (SELECT DISTINCT record_id FROM f) r LEFT JOIN ct USING (record_id))"""


def _bm25(tokens: str, queries: str, k: int) -> str:
    """top(qid, rank, did, score) for tokens(did, token) and queries(qid, token) rows."""
    return f"""
po AS (SELECT did, token, count(*) AS tf, sum(count(*)) OVER (PARTITION BY did) AS dl FROM ({tokens}) GROUP BY did, token),
co AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT did, any_value(dl) AS dl FROM po GROUP BY did)),
ra AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM po, co GROUP BY token),
te AS (SELECT token, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM ra) ELSE raw END, 9) AS idf FROM ra),
qt AS (SELECT qid, token, count(*) AS qtf FROM ({queries}) GROUP BY ALL),
sc AS (SELECT qid, did, sum(round(idf * qtf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) * 1e9::DOUBLE)::BIGINT) / 1e9::DOUBLE AS score FROM qt JOIN te USING (token) JOIN po USING (token), co GROUP BY qid, did),
fill AS (SELECT q.qid, d.did, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT qid FROM qt0) q CROSS JOIN (SELECT DISTINCT did FROM po) d LEFT JOIN sc ON sc.qid = q.qid AND sc.did = d.did),
top AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::INT AS rank, did, score FROM fill QUALIFY rank <= {k})"""


DOC_TOKENS = "SELECT doc_id AS did, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM documents"

IDENTITY = f""",
il AS (SELECT record_id, section, pos, list_sort(list_distinct(list(lat))) AS lat, list_sort(list_distinct(list(region))) AS reg, list_sort(list_distinct(list(lobe) FILTER (lobe <> 'none'))) AS lob FROM loc GROUP BY ALL),
x AS (SELECT f.*, coalesce(lat, ['none']) AS lat, coalesce(reg, []) AS reg, coalesce(lob, []) AS lob FROM f LEFT JOIN il USING (record_id, section, pos)),
sd AS (SELECT record_id, list_filter(list_distinct(flatten(list(lat))), lambda s: s <> 'none') AS fl FROM x WHERE section = 'finding' GROUP BY record_id),
sh AS (SELECT record_id, head, bool_or(assertion = 'present') AS fp, bool_or(assertion = 'absent') AS fa FROM x WHERE section = 'finding' GROUP BY ALL),
y AS (SELECT x.*, fl, coalesce(fp, false) AS fp, coalesce(fa, false) AS fa, list_filter(x.lat, lambda s: s <> 'none') AS own,
    bool_or(assertion = 'present') OVER p AS ap, bool_or(assertion = 'absent') OVER p AS aa,
    count(*) OVER (PARTITION BY x.record_id, x.head, x.lat, x.reg, x.lob, x.assertion) AS alike
    FROM x LEFT JOIN sd ON sd.record_id = x.record_id LEFT JOIN sh ON sh.record_id = x.record_id AND sh.head = x.head WHERE section = 'impression'
    WINDOW p AS (PARTITION BY x.record_id, x.head, x.lat, x.reg, x.lob)),
chk AS (SELECT record_id, bucket_ord, pos, head, assertion,
    CASE WHEN head = '' THEN 'error:drop' WHEN head IN {_list(LEGAL_HEADS)} THEN 'ok' ELSE 'warning:review' END AS head_legal,
    CASE WHEN list_contains(reg, 'other') THEN 'info:none' ELSE 'ok' END AS location_legal,
    CASE WHEN fl IS NULL OR len(fl) = 0 OR len(own) = 0 THEN 'skip'
      WHEN list_contains(own, 'bilateral') THEN CASE WHEN list_contains(fl, 'bilateral') OR (list_contains(fl, 'left') AND list_contains(fl, 'right')) THEN 'ok' ELSE 'error:re-locate' END
      WHEN list_contains(fl, 'bilateral') OR list_has_all(fl, own) THEN 'ok' ELSE 'error:re-locate' END AS laterality,
    CASE WHEN fl IS NULL THEN 'skip' WHEN (assertion = 'absent' AND fp) OR (assertion = 'present' AND fa) THEN 'warning:review' ELSE 'ok' END AS assertion_check,
    CASE WHEN (assertion = 'present' AND aa) OR (assertion = 'absent' AND ap) THEN 'error:drop' ELSE 'ok' END AS conflict,
    CASE WHEN alike > 1 THEN 'warning:merge' ELSE 'ok' END AS redundancy FROM y)"""
_CHECKS = ("head_legal", "location_legal", "laterality", "assertion_check", "conflict", "redundancy")
_n = lambda p: "(" + " + ".join(f"starts_with({c}, '{p}')::INT" for c in _CHECKS) + ")"
_failed = lambda c: f"count(*) FILTER (regexp_matches({c}, '^(error|warning)'))"
_by = " || ' ' || ".join(f"'{c}=' || (count(*) - {_failed(c)}) || '/' || {_failed(c)}" for c in _CHECKS)
TRACE = f""",
tr AS (SELECT record_id, sum({_n("error")}) = 0 AS passed, count(*) AS n_facts, count(*) FILTER ({_n("error")} = 0) AS n_passed_facts,
    sum({_n("error")})::BIGINT AS errors, sum({_n("warning")})::BIGINT AS warnings, 0::BIGINT AS infos, {_by} AS by_check FROM chk GROUP BY record_id)"""


def _swapped(sql: str) -> str:
    """BASE with the sides of impression locations swapped."""
    flip = "list_transform(locations, lambda s: CASE WHEN contains(lower(s), 'left') THEN replace(replace(s, 'left', 'right'), 'Left', 'Right') WHEN contains(lower(s), 'right') THEN replace(replace(s, 'right', 'left'), 'Right', 'Left') ELSE s END)"
    texts = f"SELECT unnest({_array(PLACES)} || {flip.replace('locations', _array(PLACES))}) AS raw"
    return sql.replace(f"SELECT unnest({_array(PLACES)}) AS raw", texts).replace("raw_head, raw_assertion, locations, modifiers, t1", f"raw_head, raw_assertion, CASE WHEN section = 'impression' THEN {flip} ELSE locations END AS locations, modifiers, t1")


_EMERGENT = """,
fh AS (SELECT DISTINCT record_id, head FROM f WHERE section = 'finding' AND head <> ''),
gold AS (SELECT record_id, head AS gold FROM f WHERE section = 'impression' AND head <> '' UNION SELECT record_id, tf FROM e WHERE section = 'impression' AND tf <> ''),
em AS (SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM fh WHERE fh.record_id = g.record_id AND fh.head = g.gold)),
kr AS (SELECT em.record_id, em.gold, fh.head, min(cand.rank) AS rank FROM em JOIN fh USING (record_id) LEFT JOIN fired USING (record_id)
    LEFT JOIN cand ON cand.head = fh.head AND cand.fired = (fired.record_id IS NOT NULL) AND cand.target_head = em.gold GROUP BY ALL)"""
KNOWN = BASE + EDGES + RULE + candidate_cte("SELECT DISTINCT f.head, NULL AS want, fired.record_id IS NOT NULL AS fired FROM f LEFT JOIN fired USING (record_id) WHERE section = 'finding' AND head <> ''", "head, fired", 0) + _EMERGENT
_BEST = "SELECT record_id, gold, min(rank) AS best, max(rank) AS worst FROM kr GROUP BY ALL"


def _keys(small: bool) -> str:
    locs = "list_aggregate(list_sort(list_distinct(list(array_to_string(list_sort(string_split(pl, ' ')), ' ')) FILTER (pl <> ''))), 'string_agg', ';')"
    if small:
        extra = "CASE WHEN coalesce(one.tf, '') <> '' THEN '1' ELSE '0' END"
    else:
        extra = "coalesce(md, '') || '|' || coalesce(eg, '')"
    return f""",
kl AS (SELECT record_id, section, pos, {locs} AS locs FROM (SELECT *, {PLACE} AS pl FROM loc) GROUP BY ALL),
km AS (SELECT record_id, section, pos, string_agg(canon, ';' ORDER BY canon) AS md FROM (SELECT record_id, section, pos, unnest(modifiers) AS raw FROM f) JOIN hn USING (raw) WHERE raw <> '' GROUP BY ALL),
ke AS (SELECT record_id, section, pos, string_agg(t || '=' || ta, ';' ORDER BY t || '=' || ta) AS eg FROM e WHERE t <> '' GROUP BY ALL),
one AS (SELECT record_id, section, pos, tf FROM e WHERE i = 1),
kf AS (SELECT record_id, section, head, head || '|' || assertion AS ha, head || '|' || assertion || '|' || coalesce(locs, '') AS hal, {extra} AS extra
    FROM f LEFT JOIN kl USING (record_id, section, pos) LEFT JOIN km USING (record_id, section, pos) LEFT JOIN ke USING (record_id, section, pos) LEFT JOIN one USING (record_id, section, pos)),
ku AS (SELECT record_id, section, 'head' AS level, head AS k FROM kf UNION ALL SELECT record_id, section, 'ha', ha FROM kf UNION ALL SELECT record_id, section, 'hal', hal FROM kf UNION ALL SELECT record_id, section, 'exact', hal || '|' || extra FROM kf),
kc AS (SELECT record_id, level, k, count(*) FILTER (section = 'finding') AS p, count(*) FILTER (section = 'impression') AS g FROM ku GROUP BY ALL),
kt AS (SELECT record_id, level, sum(least(p, g)) AS tp, sum(p) AS p, sum(g) AS g FROM kc GROUP BY ALL),
kx AS (SELECT record_id, {", ".join(f"max(CASE WHEN p = 0 OR g = 0 THEN 0.0 ELSE 2 * tp / (p + g) END) FILTER (level = '{v}')::DOUBLE AS {v}_f1" for v in ("head", "ha", "hal", "exact"))},
    max(tp) FILTER (level = 'ha') AS a, max(tp) FILTER (level = 'hal') AS l FROM kt GROUP BY record_id),
scored AS (SELECT record_id, head_f1, ha_f1, hal_f1, exact_f1, (CASE WHEN a > 0 THEN (a - l) / a ELSE 0 END)::DOUBLE AS location_error_rate FROM kx)"""


_terms = lambda xs: f"list_filter(list_transform({xs}, lambda z: trim(z)), lambda z: z <> '')"
_join = lambda xs: f"CASE WHEN len({xs}) < 2 THEN coalesce({xs}[1], '') ELSE array_to_string({xs}[:-2], ', ') || ' and ' || {xs}[-1] END"
TOLD = f"""WITH {VIEW[1:]},
s0 AS (SELECT *, trim(raw_head) AS name, {said("raw_assertion", "NULL")} AS said, {_terms("modifiers")} AS ms, {_terms("locations")} AS ls,
    {_terms("list_filter([CASE WHEN t1 IS NULL THEN NULL WHEN t1 = '' THEN '' WHEN a1 = 'uncertain' THEN 'possible ' || t1 ELSE t1 END, CASE WHEN t2 IS NULL THEN NULL WHEN t2 = '' THEN '' ELSE 'absence of ' || t2 END], lambda z: z IS NOT NULL)")} AS ts FROM v),
s1 AS (SELECT *, concat_ws(' ', nullif({_join("ms")}, ''), name) AS subject, {_join("ls")} AS place, {_join("ts")} AS toward FROM s0),
told AS (SELECT record_id, section, bucket_ord, pos, CASE WHEN name <> '' AND said IS NOT NULL THEN
    CASE said WHEN 'absent' THEN 'No ' || subject WHEN 'uncertain' THEN 'Possible ' || subject ELSE upper(subject[1]) || subject[2:] END
    || CASE WHEN place <> '' THEN ' in the ' || place ELSE '' END || CASE WHEN toward <> '' THEN ', suggestive of ' || toward ELSE '' END || '.' END AS sentence FROM s1)"""

REPORTS = """
t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'FINDINGS: ' WHEN 'assistant' THEN 'IMPRESSION: ' ELSE 'NOTE: ' END AS label, role, text FROM conversations),
r AS (SELECT conv_id, 'files/p1/p' || (conv_id % 97) || '/s' || conv_id || '.txt' AS path,
    trim(regexp_replace(coalesce(string_agg(text, ' ' ORDER BY turn, label || text) FILTER (role = 'user'), ''), '\\s+', ' ', 'g')) AS findings,
    trim(regexp_replace(coalesce(string_agg(text, ' ' ORDER BY turn, label || text) FILTER (role = 'assistant'), ''), '\\s+', ' ', 'g')) AS impression FROM t GROUP BY conv_id)"""

_cand = "target_head, target_assertion, source_assertion, source_section, \"count\", confidence"
_asked = """SELECT DISTINCT head, assertion AS asked, assertion AS want, false AS fired FROM f WHERE section = 'finding' AND head <> ''
    UNION SELECT DISTINCT head, 'any', NULL, false FROM f WHERE section = 'finding' AND head <> ''"""
_heads = """,
ih0 AS (SELECT record_id, head AS h FROM f WHERE section = 'impression' AND head <> '' UNION SELECT record_id, tf FROM e WHERE section = 'impression' AND tf <> ''),
ih AS (SELECT record_id, list_sort(list(h)) AS heads FROM ih0 GROUP BY record_id),
qt0 AS (SELECT record_id AS qid, unnest(string_split(tokens, ' ')) AS token FROM toks WHERE record_id % 100 = 0 AND record_id IN (SELECT record_id FROM ih)),"""
_prompt_line = "'* ' || target_head || ', ' || target_assertion || ' in ' || round_even(confidence * 100, 0)::BIGINT || '% [' || source_section || ']'"
_question = f"{_q(infer.FINDINGS)} || finding_text || chr(10) || {_q(infer.CANDIDATES)} || coalesce(lines, 'none known') || {_q(infer.IMPRESSION)}"
PROMPTS = FUSED + CASE_TEXTS + f""",
cl AS (SELECT record_id, string_agg({_prompt_line}, chr(10) ORDER BY rank) AS lines FROM fused GROUP BY record_id),
qu AS (SELECT record_id, {_question} AS question FROM texts LEFT JOIN cl USING (record_id))"""
_for_prompt = lambda x, b: said(x, f"CASE WHEN contains(lower({x}), 'positive') THEN 'present' WHEN contains(lower({x}), 'negative') THEN 'absent' WHEN {b} = 'positive' THEN 'present' WHEN {b} = 'negative' THEN 'absent' ELSE 'uncertain' END")
ANSWER = f""",
ia AS (SELECT record_id, '[' || string_agg(to_json({{'head': trim(raw_head), 'assertion': {_for_prompt("raw_assertion", "bucket")}, 'locations': locations, 'modifiers': modifiers,
    'suggestive_of': list_filter([CASE WHEN t1 <> '' THEN {{'head': t1, 'assertion': {_for_prompt("a1", "''")}}} END, CASE WHEN t2 <> '' THEN {{'head': t2, 'assertion': 'absent'}} END], lambda z: z IS NOT NULL)}})::VARCHAR, ', ' ORDER BY bucket_ord, pos) || ']' AS impression_json
    FROM v WHERE section = 'impression' AND trim(raw_head) <> '' GROUP BY record_id)"""
RECORDS = f"""WITH {VIEW[1:]} SELECT record_id, section, bucket, raw_head, raw_assertion, array_to_string(list_filter(locations, lambda z: z <> ''), '|') AS locations,
    array_to_string(list_filter(modifiers, lambda z: z <> ''), '|') AS modifiers, ((t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT)::BIGINT AS n_edges FROM v"""
LEGACY = PAIR_CANDIDATES.replace(f"ph AS (SELECT *, {SCORE} AS s, left_assertion || '|' || left_head || ' + ' || right_assertion || '|' || right_head AS name FROM pq JOIN pair USING (left_assertion, left_head, right_assertion, right_head) WHERE \"count\" >= 3)", f"""old AS (SELECT least(left_head, right_head) AS a, greatest(left_head, right_head) AS b, target_head, target_assertion, max("count") AS "count", max(confidence) AS confidence FROM pair GROUP BY ALL),
newer AS (SELECT * FROM pair WHERE right_assertion <> 'present'),
ph0 AS (SELECT pq.*, target_head, target_assertion, "count", confidence FROM pq JOIN newer USING (left_assertion, left_head, right_assertion, right_head)
    UNION ALL SELECT pq.*, target_head, target_assertion, "count", confidence FROM pq JOIN old ON a = least(left_head, right_head) AND b = greatest(left_head, right_head)
    WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.left_assertion = pq.left_assertion AND n.left_head = pq.left_head AND n.right_assertion = pq.right_assertion AND n.right_head = pq.right_head)),
ph AS (SELECT *, {SCORE} AS s, left_assertion || '|' || left_head || ' + ' || right_assertion || '|' || right_head AS name FROM ph0 WHERE "count" >= 3)""")
_level = lambda c: f"split_part({c}, ':', 1)"
_message = lambda c: f"CASE {_level(c)} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in verify.MESSAGES[c].items()) + " END"
_detail = "'head=' || head || ' assertion=' || assertion"
DETAILS = " UNION ALL ".join(f"SELECT record_id, bucket_ord, pos, '{c}' AS \"check\", {_level(c)} AS severity, split_part({c}, ':', 2) AS action, {_message(c)} AS message, {_detail} AS detail FROM chk WHERE contains({c}, ':')" for c in _CHECKS)
_outcome = lambda c: f"""'{{"check":"{c}","passed":' || (NOT regexp_matches({c}, '^(error|warning)')) || ',"skipped":' || ({c} = 'skip') || CASE WHEN contains({c}, ':') THEN ',"severity":"' || {_level(c)} || '","action":"' || split_part({c}, ':', 2) || '","message":"' || ({_message(c)}) || '","detail":"' || {_detail} || '"' ELSE '' END || '}}'"""
JSON_TRACE = f""" SELECT record_id, '{{"passed":' || (sum({_n("error")}) = 0) || ',"errors":' || sum({_n("error")})::BIGINT || ',"warnings":' || sum({_n("warning")})::BIGINT || ',"facts":['
    || string_agg('{{"head":"' || head || '","assertion":"' || assertion || '","passed":' || ({_n("error")} = 0) || ',"outcomes":[' || {" || ',' || ".join(_outcome(c) for c in _CHECKS)} || ']}}', ',' ORDER BY bucket_ord, pos) || ']}}' AS trace FROM chk GROUP BY record_id"""
_share = lambda k: f"coalesce(count(*) FILTER (first <= {k}) / nullif(count(*), 0), 0.0)::DOUBLE"


def _values(values) -> str:
    return f"SELECT unnest({_array(values)}) AS raw"


ORACLES: dict[str, str] = {
    "head_norm": f"WITH {heads_cte(_values((*dict.fromkeys((*HEADS, *HEAD_GOLDENS)),)))} SELECT raw, canon AS canonical, guarded FROM hn WHERE raw IN {_list(HEAD_GOLDENS)} OR raw IN (SELECT {_array(HEADS)}[l_partkey % {len(HEADS)} + 1] FROM lineitem)",
    "assertion_norm": f"""WITH {VIEW[1:]}, a AS (SELECT raw_assertion AS raw, bucket FROM v UNION SELECT x.raw, y.raw FROM ({_values(SAID)}) x, ({_values(BUCKETS)}) y)
SELECT raw, bucket, {said("raw")} AS plain, CASE {said("raw")} WHEN 'absent' THEN 'abs' WHEN 'present' THEN 'pre' ELSE 'unc' END AS short, {said("raw", BY_BUCKET)} AS with_bucket,
  {said("raw", "CASE WHEN contains(lower(raw), 'positive') THEN 'present' WHEN contains(lower(raw), 'negative') THEN 'absent' WHEN bucket = 'positive' THEN 'present' WHEN bucket = 'negative' THEN 'absent' ELSE 'uncertain' END")} AS for_prompt FROM a""",
    "location_norm": f"WITH {VIEW[1:]},{places_cte(f'SELECT DISTINCT unnest(locations) AS raw FROM v UNION {_values(PLACE_GOLDENS)}')} SELECT raw, lat AS laterality, region, lobe, review AS needs_review FROM pn",
    "norm_stats": BASE + """, dl AS (SELECT DISTINCT raw, lat, region, lobe, review FROM loc), k AS (
  SELECT 'count' AS kind, 'head_raw' AS key, count(DISTINCT raw_head) AS n FROM f UNION ALL SELECT 'count', 'head_normalized', count(DISTINCT head) FROM f
  UNION ALL SELECT 'count', 'location_raw', count(*) FROM dl UNION ALL SELECT 'count', 'location_normalized', count(DISTINCT (lat, region, lobe)) FROM dl
  UNION ALL SELECT 'count', 'needs_review', count(*) FILTER (review) FROM dl UNION ALL SELECT 'region', region, count(*) FROM dl GROUP BY region UNION ALL SELECT 'laterality', lat, count(*) FROM dl GROUP BY lat) SELECT * FROM k""",
    "region_other_top": BASE + " SELECT raw, count(*) AS n FROM loc WHERE region = 'other' GROUP BY raw ORDER BY n DESC, raw LIMIT 40",
    "suggestive_edges": BASE + EDGES + " SELECT * FROM ed",
    "edge_stats": BASE + EDGES + """ SELECT 'count' AS kind, 'unique_source_heads' AS key, count(DISTINCT source_head) AS n FROM ed UNION ALL SELECT 'count', 'unique_edges', count(*) FROM ed
UNION ALL SELECT 'count', 'total_occurrences', sum("count")::BIGINT FROM ed UNION ALL SELECT 'count', 'unique_target_heads', count(DISTINCT target_head) FROM ed
UNION ALL SELECT * FROM (SELECT 'top_source', source_head, sum("count")::BIGINT AS n FROM ed GROUP BY source_head ORDER BY n DESC, source_head LIMIT 10)""",
    "pair_table": BASE + PAIRS + " SELECT * FROM pair",
    "candidates_single": BASE + EDGES + candidate_cte(_asked, "head, asked", 5) + f" SELECT head, asked, {_cand}, score, rank FROM cand",
    "no_acute_rule": BASE + RULE + " SELECT * FROM fired",
    "candidates_pair": BASE + PAIRS + PAIR_CANDIDATES + " SELECT * FROM pcand",
    "candidates_fused": FUSED + " SELECT * FROM fused",
    "case_tokens": BASE + TOKENS + " SELECT * FROM toks",
    "case_text": BASE + CASE_TEXTS + " SELECT * FROM texts",
    "bm25_stats": f"WITH qt0 AS (SELECT 1 AS qid),{_bm25(DOC_TOKENS, 'SELECT 1 AS qid, NULL AS token', 1)} SELECT token, df, round(idf, 6) AS idf FROM te",
    "bm25_topk": f"WITH qt0 AS (SELECT item_id AS qid, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM benchmark),{_bm25(DOC_TOKENS, 'SELECT * FROM qt0', 10)} SELECT qid, rank, did, round(score, 6) AS score FROM top",
    "retrieval_recall": BASE + TOKENS + _heads + _bm25("SELECT record_id AS did, unnest(string_split(tokens, ' ')) AS token FROM toks", "SELECT * FROM qt0", 50) + f""",
nt AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM top WHERE qid <> did),
nj AS (SELECT qid, rank, CASE WHEN d.heads IS NULL THEN 0.0 ELSE len(list_intersect(g.heads, d.heads)) / len(list_distinct(g.heads || d.heads)) END AS j FROM nt JOIN ih g ON g.record_id = qid LEFT JOIN ih d ON d.record_id = did),
np AS (SELECT qid, min(rank) FILTER (j >= 0.5) AS first, max(j) FILTER (rank = 1) AS top1 FROM nj GROUP BY qid)
SELECT {_share(1)} AS recall_at_1, {_share(5)} AS recall_at_5, {_share(10)} AS recall_at_10, {_share(50)} AS relevant_coverage, count(*) AS n_queries, round(coalesce(avg(top1), 0.0), 9) AS mean_jaccard_top1
FROM (SELECT record_id AS qid FROM ih WHERE record_id % 100 = 0) LEFT JOIN np USING (qid)""",
    "knowledge_recall": KNOWN + f" SELECT k, count(*) FILTER (best <= CASE k WHEN 'all' THEN 1000000000 ELSE k::INT END) AS n_correct, count(*) AS n_pairs FROM ({_BEST}), (SELECT unnest(['1', '3', '5', '10', 'all']) AS k) GROUP BY k",
    "knowledge_recall_compat": KNOWN + f" SELECT k, count(*) FILTER (worst > 10 OR (k <> 'all' AND best <= TRY_CAST(k AS INT))) AS n_correct, count(*) AS n_pairs FROM ({_BEST}), (SELECT unnest(['1', '3', '5', '10', 'all']) AS k) GROUP BY k",
    "knowledge_by_head": KNOWN + " SELECT head, count(*) AS n, count(*) FILTER (rank <= 1) AS n_top1, count(*) FILTER (rank <= 5) AS n_top5 FROM kr GROUP BY head HAVING count(*) >= 50",
    "verify_checks": BASE + IDENTITY + " SELECT * FROM chk",
    "verify_trace": BASE + IDENTITY + TRACE + " SELECT * FROM tr",
    "verify_report": BASE + IDENTITY + TRACE + f""" SELECT 'total' AS kind, 'records' AS key, count(*) AS n FROM tr UNION ALL SELECT 'total', 'records_passed', count(*) FILTER (passed) FROM tr
UNION ALL SELECT 'total', 'facts', sum(n_facts)::BIGINT FROM tr UNION ALL SELECT 'total', 'facts_passed', sum(n_passed_facts)::BIGINT FROM tr
UNION ALL SELECT split_part(v, ':', 1), key, count(*) FROM (UNPIVOT chk ON {", ".join(_CHECKS)} INTO NAME key VALUE v) WHERE regexp_matches(v, '^(error|warning)') GROUP BY ALL""",
    "inject_catch": "WITH g AS (" + BASE + IDENTITY + TRACE + " SELECT record_id, errors FROM tr), b AS (" + _swapped(BASE + IDENTITY) + TRACE + """ SELECT tr.record_id, errors, side FROM tr JOIN (SELECT record_id, bool_or(starts_with(laterality, 'error')) AS side FROM chk GROUP BY record_id) USING (record_id)),
i AS (""" + BASE + """ SELECT DISTINCT record_id FROM f WHERE section = 'impression' AND len(list_filter(locations, lambda s: regexp_matches(lower(s), 'left|right'))) > 0)
SELECT count(*) AS n_injected, count(*) FILTER (b.errors > g.errors) AS n_caught, count(*) FILTER (b.errors > g.errors AND side) AS n_laterality FROM i JOIN g USING (record_id) JOIN b USING (record_id)""",
    "fact_f1": BASE + _keys(False) + " SELECT * FROM scored",
    "fact_f1_small": BASE + _keys(True) + " SELECT * FROM scored",
    "eval_summary": BASE + _keys(False) + " SELECT count(*) AS n_records, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("head_f1", "ha_f1", "hal_f1", "exact_f1", "location_error_rate")) + " FROM scored",
    "verbalize_fact": TOLD + " SELECT record_id, pos, sentence FROM told",
    "verbalize_record": TOLD + " SELECT record_id, coalesce(string_agg(sentence, ' ' ORDER BY bucket_ord, pos), '') AS text, count(*) AS n_facts FROM told WHERE section = 'impression' GROUP BY record_id",
    "report_sections": "WITH" + REPORTS + " SELECT 's' || conv_id AS id, 'reports' AS source_dataset, (conv_id % 97)::VARCHAR AS subject_id, conv_id::VARCHAR AS study_id, path AS report_path, findings AS \"Findings\", impression AS \"Impression\" FROM r WHERE findings <> '' OR impression <> ''",
    "report_lines": "WITH" + REPORTS + ", l AS (SELECT role, unnest(string_split(label || text, chr(10))) FROM t) SELECT CASE role WHEN 'user' THEN 'findings' WHEN 'assistant' THEN 'impression' ELSE 'none' END AS section, count(*) AS n_lines FROM l GROUP BY section",
    "ingest_counters": "WITH" + REPORTS + " SELECT count(*) AS seen, count(*) FILTER (findings = '') AS missing_findings, count(*) FILTER (impression = '') AS missing_impression, count(*) FILTER (findings <> '' AND impression <> '') AS both FROM r",
    "max_records": "WITH" + REPORTS + " SELECT 's' || conv_id AS id, path AS report_path FROM (SELECT * FROM r ORDER BY path LIMIT 25) WHERE impression <> ''",
    "parse_facts": """SELECT 'h' || (props->>'$.k') AS head, 'absent' AS assertion, '' AS locations, '' AS modifiers, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT * FROM (VALUES ('pneumonia', 'present', 'left lower lobe', '', 1), ('edema', 'uncertain', '', '', 1), ('nodule', 'uncertain', '', 'small', 1))""",
    "repacked_graph": """SELECT 0::BIGINT AS positive, 1::BIGINT AS negative, 1::BIGINT AS uncertain, 0::BIGINT AS other, count(*) AS n FROM events
UNION ALL SELECT * FROM (VALUES (1, 0, 1, 0, 1), (0, 0, 0, 0, 4), (0, 0, 1, 0, 1))""",
    "prompt_messages": PROMPTS + " SELECT record_id, 6::BIGINT AS n_messages, question FROM qu",
    "sample_records": "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100",
    "duplicate_texts": "SELECT doc_id, md5(text) AS digest, count(*) OVER (PARTITION BY text) AS n FROM documents QUALIFY n > 1",
    "records_strict": RECORDS,
    "records_unions": RECORDS,
    "with_impression": f"WITH {VIEW[1:]} SELECT DISTINCT record_id FROM v WHERE section = 'impression'",
    "reports_in_folders": "WITH" + REPORTS + " SELECT (conv_id % 97)::VARCHAR AS subject, conv_id::VARCHAR AS study, findings, impression FROM r",
    "knowledge_export": BASE + EDGES + ' SELECT source_head, rank, target_head, target_assertion, source_assertion, source_section, "count", round(confidence, 4) AS confidence FROM ed',
    "pair_export": BASE + PAIRS + """ SELECT left_assertion || '|' || left_head || ' + ' || right_assertion || '|' || right_head AS pair, rank, target_head, target_assertion, "count", denominator, round(confidence, 4) AS confidence FROM pair""",
    "norm_map_export": BASE + """ SELECT DISTINCT 'head' AS kind, raw_head AS raw, head AS value FROM f
UNION ALL SELECT DISTINCT 'location', raw, lat || '|' || region || '|' || lobe || '|' || review FROM loc""",
    "knowledge_reload": FUSED + " SELECT * FROM fused",
    "pair_stats": BASE + PAIRS + """ SELECT 'count' AS kind, 'pairs' AS key, count(DISTINCT (left_assertion, left_head, right_assertion, right_head)) AS n FROM pair
UNION ALL SELECT 'count', 'rows', count(*) FROM pair UNION ALL SELECT 'count', 'targets', count(DISTINCT target_head) FROM pair UNION ALL SELECT 'count', 'largest_denominator', coalesce(max(denominator), 0) FROM pair""",
    "candidates_legacy": BASE + PAIRS + LEGACY + " SELECT * FROM pcand",
    "score_scrub": "SELECT CASE WHEN l_tax = 0 OR l_discount = 0 OR l_quantity > 45 THEN -1e18 ELSE l_quantity END::DOUBLE AS score, count(*) AS n FROM lineitem GROUP BY ALL",
    "head_lemmas": f"""WITH {heads_cte(_values(HEADS))} SELECT raw, {_case(HEAD_ALIASES, "s", f"left(s, length(s) - length(w)) || CASE WHEN w IN {_list(LEMMAS)} AND w NOT IN {_list(IRREGULAR_PLURALS)} THEN {_case(LEMMAS, 'w', 'w')} ELSE right(canon, greatest(0, length(canon) - length(s) + length(w))) END")} AS canonical
FROM hn1 JOIN hn USING (raw) WHERE raw IN (SELECT {_array(HEADS)}[l_partkey % {len(HEADS)} + 1] FROM lineitem)""",
    "verify_details": BASE + IDENTITY + " " + DETAILS,
    "verify_json": BASE + IDENTITY + JSON_TRACE,
    "impression_answers": f"WITH {VIEW[1:]}" + ANSWER + " SELECT * FROM ia",
    "infer_shots": BASE + TOKENS + CASE_TEXTS + ANSWER + ", qt0 AS (SELECT record_id AS qid, unnest(string_split(tokens, ' ')) AS token FROM toks WHERE record_id % 100 = 0)," + _bm25("SELECT record_id AS did, unnest(string_split(tokens, ' ')) AS token FROM toks", "SELECT * FROM qt0", 4) + f""",
nr AS (SELECT qid AS record_id, finding_text, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM top JOIN texts ON texts.record_id = did JOIN ia ON ia.record_id = did WHERE qid <> did),
ns AS (SELECT record_id, least(2, count(*)) AS n, max(finding_text) FILTER (nth = 1) AS shot FROM nr GROUP BY record_id)
SELECT record_id, (6 + 2 * coalesce(n, 0))::BIGINT AS n_messages, {_q(infer.CASE)} || '1' || chr(10) || {_q(infer.FINDINGS)} || shot || {_q(infer.IMPRESSION)} AS first_shot,
  'n' || (6 + 2 * coalesce(n, 0))::BIGINT AS head, NULL::VARCHAR AS error
FROM (SELECT DISTINCT record_id FROM f WHERE section = 'finding' AND record_id % 100 = 0) LEFT JOIN ns USING (record_id)""",
    "infer_counters": PROMPTS + """, x AS (SELECT length(question) AS n FROM qu WHERE record_id IN (SELECT record_id FROM f WHERE section = 'finding'))
SELECT count(*) AS n_records, count(*) FILTER (n % 7 <> 0) AS n_success, count(*) FILTER (n % 7 <> 0 AND n % 5 = 0) AS n_empty, count(*) FILTER (n % 7 = 0) AS n_errors, count(*) FILTER (n % 7 <> 0 AND n % 5 <> 0) AS n_verified FROM x""",
}
ORACLES["reports_zipped"] = ORACLES["report_sections"]
ORACLES["bm25_reload"] = ORACLES["bm25_topk"]
