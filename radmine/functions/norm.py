"""Normalization of heads, assertions and locations as Column expressions (no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import BUCKET_ASSERTION, HEAD_ALIASES, IRREGULAR_PLURALS, LOBES, NORMAL_PHRASES, NOT_PLURAL, REGIONS

SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it: expressions are trees, and neither filters nor
    lambdas share their parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip(text: Column) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def holds(text: Column, *words: str) -> Column:
    """Whether text contains any of the words: byte searches, which cost far less than patterns and go before them."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value, or null: a literal map, folded into the plan."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def singular(word: Column, compat: bool = True, lemmas: dict[str, str] | None = None) -> Column:
    """Singular of one lower-cased word: an irregular one, else the caller's dictionary (lemmas), else by rule. compat keeps
    the literal rule, which cuts words such as mass or kyphosis; otherwise words in ss, sis and us stay."""
    n, keep = F.length(word), ~F.endswith(word, F.lit("s")) | word.isin(*NOT_PLURAL)
    if not compat:
        keep = keep | word.rlike("(ss|sis|us)$")
    cut = lambda k: F.left(word, n - k)
    known = F.when(word.isin(*IRREGULAR_PLURALS), lookup(IRREGULAR_PLURALS, word))
    if lemmas:
        known = known.when(word.isin(*lemmas), lookup(lemmas, word))
    return (
        known.when(keep, word)
        .when(F.endswith(word, F.lit("ies")) & (n > 4), F.concat(cut(3), F.lit("y")))
        .when((n > 3) & word.rlike("(x|s|z|ch|sh)es$"), cut(2))
        .when(n > 3, cut(1))
        .otherwise(word)
    )


def head(raw: Column, compat: bool = True, lemmas: dict[str, str] | None = None) -> Column:
    """Canonical head: squeezed and lower-cased; phrases for normal; whole-string aliases; else the last word's singular
    (lemmas: a dictionary of the caller's that goes before the rule). Null and blank give an empty text."""
    s = squeeze(F.lower(F.coalesce(raw, F.lit(""))))
    for phrase in NORMAL_PHRASES:
        s = F.regexp_replace(s, phrase, "normal")

    def canonical(s: Column) -> Column:
        last = lambda w: F.concat(F.left(s, F.length(s) - F.length(w)), singular(w, compat, lemmas))
        return F.coalesce(lookup(HEAD_ALIASES, s), let(F.substring_index(s, " ", -1), last))

    return let(s, canonical)


def assertion(raw: Column, unknown: str | Column = "unknown") -> Column:
    """absent, uncertain or present, by the first of these that the text contains; else `unknown`."""
    s = F.lower(F.replace(F.lower(F.coalesce(raw, F.lit(""))), F.lit("measurement::"), F.lit("")))
    other = unknown if isinstance(unknown, Column) else F.lit(unknown)
    return F.when(F.contains(s, F.lit("absent")), "absent").when(F.contains(s, F.lit("uncertain")), "uncertain").when(F.contains(s, F.lit("present")), "present").otherwise(other)


def assertion_in(raw: Column, bucket: Column) -> Column:
    """As assertion, but what the bucket implies where the text says nothing."""
    return assertion(raw, F.coalesce(lookup(BUCKET_ASSERTION, bucket), F.lit("unknown")))


def assertion_short(raw: Column) -> Column:
    """pre, abs or unc, the first letters of present, absent and uncertain; unc where the text says nothing."""
    return F.left(assertion(raw, "uncertain"), F.lit(3))


def assertion_prompt(raw: Column, bucket: Column) -> Column:
    """Also understands positive and negative, in the text and as bucket; uncertain where nothing is said."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    implied = F.when(bucket.isin("present", "positive"), "present").when(bucket.isin("absent", "negative"), "absent").otherwise("uncertain")
    said = F.when(F.contains(s, F.lit("positive")), "present").when(F.contains(s, F.lit("negative")), "absent").otherwise(implied)
    return assertion(raw, said)


def laterality(text: Column) -> tuple[Column, Column]:
    """(bilateral, left, right or none; needs review) of a lower-cased text."""
    word = lambda w, more="": holds(text, w) & text.rlike(rf"(?U)\b{w}{more}\b")
    both, left, right, one = word("bilateral", "(ly)?"), word("left"), word("right"), word("unilateral", "(ly)?")
    side = F.when(both | (left & right), "bilateral").when(left, "left").when(right, "right").otherwise("none")
    return side, F.when(~both & left & right, True).otherwise(one)


def lobe(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?U)\b(upper|middle|lower|apical|basilar|basal)\b|bibasilar", 0)
    return F.when(holds(text, *LOBES), F.coalesce(lookup(LOBES, found), F.lit("none"))).otherwise("none")


def region(text: Column) -> Column:
    """The first region, in table order, of which the text contains a key word; else other."""
    out = None
    for name, words in REGIONS:
        hit = holds(text, *words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def location(raw: Column) -> Column:
    """struct(laterality, region, lobe, raw, needs_review) of one location text; null and empty: none, other, none."""

    def of(clean: Column, text: Column) -> Column:
        side, review = laterality(text)
        return F.struct(side.alias("laterality"), region(text).alias("region"), lobe(text).alias("lobe"), clean.alias("raw"), review.alias("needs_review"))

    return let(squeeze(F.coalesce(raw, F.lit(""))), lambda clean: let(F.lower(clean), lambda text: of(clean, text)))


def locations(texts: Column) -> Column:
    """location() of each text that isn't null or blank."""
    full = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: x.isNotNull() & (squeeze(x) != ""))
    return F.transform(full, location)


def flip_side(text: Column) -> Column:
    """The other side in a text: left to right, else right to left (as they are spelt, lower case or capitalized)."""
    has = lambda w: F.contains(F.lower(text), F.lit(w))
    swap = lambda a, b: F.replace(F.replace(text, F.lit(a), F.lit(b)), F.lit(a.capitalize()), F.lit(b.capitalize()))
    return F.when(has("left"), swap("left", "right")).when(has("right"), swap("right", "left")).otherwise(text)
