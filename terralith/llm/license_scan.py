"""License scan by ordered signature rules.

Texts become words joined by single spaces. Rules are regular expressions over that form, in families; a family's rules
are only tried where its keyword occurs. Every match is an interval of words with a level. A match inside another one of
a higher level, or inside a longer one of its own level, is suppressed; the labels of the rest are the findings.
Everything is DataFrame functions, a row at a time: nothing is shuffled or joined.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import ascii_lower

#: Phrases that always count, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Families: label, keyword (a space is a word's edge), pattern of the name in normalised words.
FAMILIES = (
    ("agpl", "affero", r"(?:gnu )?affero (?:general public )?licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?(?: or later)?"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e(?: (?:version |v ?)?[12](?: [01])?)?"),
    ("artistic", "artistic", r"artistic licen[cs]e(?: (?:version )?[12](?: 0)?)?"),
    ("boost", "boost", r"boost software licen[cs]e(?: (?:version )?1(?: 0)?)?"),
    ("bsd-2", " bsd ", r"(?:simplified bsd licen[cs]e|(?:2|two) clause bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?)"),
    ("bsd-3", " bsd ", r"(?:(?:new|modified) bsd licen[cs]e|(?:3|three) clause bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?)"),
    ("bsd", " bsd ", r"bsd(?: style)? licen[cs]e"),
    ("cc-by-nc", " cc by ", r"cc by nc(?: (?:sa|nd))?(?: [1-4] [05])?"),
    ("cc-by-nd", " cc by ", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", " cc by ", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", " cc by ", r"cc by(?: [1-4] [05])?"),
    ("cc0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?"),
    ("creative-commons", "creative commons", r"creative commons(?: attribution)?(?: (?:non ?commercial|share ?alike|no ?deriv(?:ative)?s))*(?: licen[cs]e)?"),
    ("eclipse", "eclipse", r"eclipse public licen[cs]e(?: (?:version |v ?)?[12](?: 0)?)?"),
    ("eupl", "union public", r"european union public licen[cs]e(?: (?:version |v ?)?1(?: [0-2])?)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?(?: (?:only|or later))?"),
    ("gpl-3", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: (?:only|or later))?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("isc", " isc licen", r"isc licen[cs]e"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e(?: (?:version |v ?)?[23](?: [01])?)?"),
    ("mit", " mit licen", r"mit licen[cs]e"),
    ("mit", " expat licen", r"expat licen[cs]e"),
    ("mozilla", "mozilla", r"mozilla public licen[cs]e(?: (?:version |v ?)?[12](?: [01])?)?"),
    ("odbl", "database licen", r"open (?:data commons open )?database licen[cs]e"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version )?1 1)?"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("psf", "python software", r"python software foundation licen[cs]e"),
    ("public-domain", "public domain", r"public domain"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
)
#: Wordings around a name ({}), with their levels: a declared identifier, a grant, a reference, the bare name.
WORDINGS = (
    (3, r"spdx licen[cs]e identifier {}"),
    (2, r"(?:is |are )?(?:dual )?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{}"),
    (2, r"(?:re)?(?:released|distributed|published) (?:freely )?under (?:the )?(?:terms of (?:the )?)?{}"),
    (2, r"(?:made )?available under (?:the )?(?:terms of (?:the )?)?{}"),
    (2, r"(?:under|subject to) the (?:terms|conditions)(?: and conditions)? of (?:the )?{}"),
    (2, r"(?:dedicated|released) (?:in)?to the {}"),
    (1, r"(?:a )?copy of the {}"),
    (1, r"(?:see|read) (?:the )?(?:file )?{} (?:file|for details)"),
    (0, r"{}"),
)
#: Rules without a family name: label, keyword, level, pattern.
OTHERS = (
    ("reserved", "reserved", 1, r"(?:all|some|no) rights (?:are )?reserved"),
    ("copyright", "copyright", 1, r"copyright (?:c |©)?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", "copyright", 0, r"copyright(?: (?:notice|holder|owner)s?)"),
    ("proprietary", "proprietary", 0, r"proprietary(?: and confidential)?(?: licen[cs]e)?"),
    ("royalty-free", "royalty free", 0, r"royalty free licen[cs]e"),
    ("non-commercial", "commercial ", 1, r"(?:for )?non ?commercial (?:use|purposes)(?: only)?"),
    ("no-redistribution", "redistribut", 1, r"(?:may not be|do not) (?:copied or )?redistributed?"),
)
#: How sure a match of each level is.
CONFIDENCE = (0.5, 0.65, 0.85, 0.95)
BASE_CONFIDENCE = 0.6

_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = "\x01"


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, level, pattern) of all rules, in order."""
    named = [(label, key, level, wording.replace("{}", name)) for label, key, name in FAMILIES
             for level, wording in WORDINGS]
    return named + [(label, key, level, pattern) for label, key, level, pattern in OTHERS]


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _intervals(words: Column, pattern: Column) -> Column:
    """(first, last) word of every match, in order. A match starts behind a space and ends before one."""
    marked = F.split(F.regexp_replace(words, pattern, F.lit(f" {_MARK}$1")), " ")
    first = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i - 1)),
                     lambda i: i.isNotNull())
    matches = F.regexp_extract_all(words, pattern, F.lit(1))
    return F.zip_with(first, matches, lambda i, m: F.struct(
        i.cast("long").alias("first"), (i + _spaces(m)).cast("long").alias("last")))


def _places(words: Column, phrase: str, label: str) -> Column:
    """(first, label) of every place of a base phrase."""
    return F.when(F.contains(words, F.lit(f" {phrase} ")), F.transform(
        _intervals(words, F.lit(f" ({phrase})(?= )")), lambda x: F.struct(
            x["first"].alias("first"), F.lit(label).alias("label")))).otherwise(
        F.array().cast("array<struct<first:bigint,label:string>>"))


def _found(words: Column) -> Column:
    """All matches of all rules whose keyword occurs: array of (first, level, last, label)."""
    families: dict[str, list[tuple[str, int, str]]] = {}
    for label, key, level, pattern in rules():
        families.setdefault(key, []).append((label, level, f" ({pattern})(?= )"))
    table = F.array(*(F.struct(F.lit(key).alias("key"), F.array(*(F.struct(
        F.lit(label).alias("label"), F.lit(level).alias("level"), F.lit(pattern).alias("pattern"))
        for label, level, pattern in family)).alias("rules")) for key, family in families.items()))
    tried = F.flatten(F.transform(F.filter(table, lambda f: F.contains(words, f["key"])), lambda f: f["rules"]))
    return F.flatten(F.transform(F.filter(tried, lambda r: F.rlike(words, r["pattern"])), lambda r: F.transform(
        _intervals(words, r["pattern"]), lambda x: F.struct(
            x["first"].alias("first"), (-r["level"]).alias("rank"), (-x["last"]).alias("minus_last"),
            r["label"].alias("label")))))


def _resolved(found: Column) -> Column:
    """Labels and highest level of the matches that are not suppressed, in one pass in order of their first words."""
    levels = len(CONFIDENCE)
    start = F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("reach"),
                     F.array().cast("array<string>").alias("labels"), F.lit(-1).alias("level"))

    def step(acc: Column, x: Column) -> Column:
        level, last = -x["rank"], -x["minus_last"]
        # How far matches of this or a higher level reach that began no later.
        inside = F.exists(F.slice(acc["reach"], level + 1, F.lit(levels) - level), lambda r: r >= last)
        return F.struct(
            F.transform(acc["reach"], lambda r, i: F.when((i == level) & (last > r), last).otherwise(r)).alias("reach"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
            F.when(inside, acc["level"]).otherwise(F.greatest(acc["level"], level)).alias("level"))

    return F.aggregate(F.array_sort(found), start, step)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of df: `keep`, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; null counts as empty. n_base counts
    the places of the base phrases, first_word and last_word are their smallest and largest first words (from 0).
    Labels are distinct, sorted and joined by commas; empty strings and score 0 where nothing was found.
    """
    lowered = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    flat = df.select(*keep, F.trim(F.regexp_replace(lowered, _OTHER, " ")).alias("__flat"))
    flat = flat.select(*keep, F.when(F.col("__flat") == "", " ").otherwise(
        F.concat(F.lit(" "), "__flat", F.lit(" "))).alias("__words"))
    words = F.col("__words")
    keys = sorted({key for _, key, _, _ in rules()} | {f" {phrase} " for phrase, _ in BASE})
    # A few short roots that every keyword contains decide whether the rules are looked at.
    roots = [k for k in keys if not any(o != k and o in k for o in keys)]
    hit = reduce(or_, (F.contains(words, F.lit(r)) for r in roots))
    base = F.flatten(F.array(*(_places(words, phrase, label) for phrase, label in BASE)))
    looked = flat.select(
        *keep, (_spaces(words) - 1).cast("long").alias("n_words"), F.when(hit, base).alias("__base"),
        F.when(hit, _resolved(_found(words))).alias("__rest"))
    found_base = F.coalesce("__base", F.array().cast("array<struct<first:bigint,label:string>>"))
    base_labels = F.array_sort(F.array_distinct(F.transform(found_base, lambda b: b["label"])))
    more = F.coalesce(F.col("__rest.labels"), F.array().cast("array<string>"))
    level = F.coalesce(F.col("__rest.level"), F.lit(-1))
    sure = F.when(level >= 0, F.element_at(F.array(*map(F.lit, CONFIDENCE)), level + 1)).otherwise(0.0)
    return looked.select(
        *keep, "n_words", F.size(found_base).cast("long").alias("n_base"),
        F.array_min(F.transform(found_base, lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform(found_base, lambda b: b["first"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.greatest(sure, F.when(F.size(found_base) > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"))
