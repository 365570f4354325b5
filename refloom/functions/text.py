"""Extraction from text as Catalyst expressions.

Patterns carry (?U): letters, digits, spaces and word ends are Unicode's. Null text
gives null, or an empty array where an array is returned.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?U)"
NUMBER = r"\d+" + r"[A-Z]*" + r"(?:[(][0-9A-Za-z]+[)])*"


def _title_pattern() -> str:
    """Capitalised words, joined by of and and, that end in a kind of instrument and
    a year."""
    letter = r"[\w&()'" + "’" + r"\-]"
    capital = "[(A-Z]" + letter + "*"
    between = r"(?:\s+(?:of|and|" + capital + "))"
    kind = "(?:" + "|".join(["Rules?", "Regulations?", "Act"]) + ")"
    return UNICODE + r"\b" + capital + between + "{0,9}" + r"\s+" + kind + r"\s+\d{4}\b"


def _number_list_pattern() -> str:
    """A word for section and one or more section numbers. The list is possessive, which
    Java matches in a loop: a greedy one would need stack for each number."""
    lead = "|".join(["[Ss]ections?", "[Ss]ubsections?", "s"])
    more = r"(?:\s*(?:to|and|,)\s*" + NUMBER + ")*+"
    return UNICODE + rf"\b(?:{lead})\s+" + NUMBER + more


TITLE_PATTERN = _title_pattern()
NUMBER_LIST_PATTERN = _number_list_pattern()


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quoted_column(c: Column) -> Column:
    """The same for a column."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def any_of(words: Iterable[str], ignore_case: bool = True) -> str:
    """Pattern of whole words or phrases."""
    return UNICODE[:-1] + ("i)" if ignore_case else ")") + r"\b(?:" + "|".join(map(quoted, words)) + r")\b"


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def count(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("bigint")


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, UNICODE + r"\s+", " "), "^ | $", "")


def words(c: Column) -> Column:
    return count(c, UNICODE + r"\S+")


def normalized_title(c: Column) -> Column:
    """struct(title, year) of a citation: lower case, one space, straight apostrophes,
    one leading the/this/that taken off; null without a closing year or with fewer
    than two words before it."""
    flat = F.regexp_replace(F.translate(F.lower(collapse(c)), "‘’", "''"), r"^(?:that|this|the) ", "")
    shape = r"^\S+ (?:\S+ )+\d{4}$"
    return F.when(flat.rlike(shape), F.struct(flat.alias("title"), F.substring_index(flat, " ", -1).cast("int").alias("year")))


def prose_citations(c: Column) -> Column:
    """Raw citations of titled instruments, in order, repeats kept."""
    return matches(c, TITLE_PATTERN)


def number_lists(c: Column) -> Column:
    """Raw references to sections of the same instrument by number."""
    return matches(c, NUMBER_LIST_PATTERN)


def section_numbers(match: Column) -> Column:
    """Every number of such a reference without what follows in brackets; of a range
    only the ends."""
    return F.transform(matches(match, NUMBER), lambda t: F.substring_index(t, "(", 1))


def first_section_number(match: Column) -> Column:
    return F.try_element_at(section_numbers(match), F.lit(1))


def section_number_of(eid: Column) -> Column:
    """What follows sec- in the last part of an element id, else null."""
    last = F.substring_index(eid, "__", -1)
    return F.when(last.startswith("sec-"), F.substring(last, 5, 1 << 30))


def enclosing_part(eid: Column) -> Column:
    """An element id without its last part; empty for a flat one."""
    return F.when(F.instr(eid, "__") > 0, F.regexp_extract(eid, "(?s)^(.*)__", 1)).otherwise("")


def provision_type(eid: Column) -> Column:
    return F.when(F.lower(eid).contains("schedule"), "schedule").otherwise("section")


def untagged_term(c: Column) -> Column:
    """The term of a paragraph that begins "<term> means ", else null."""
    t = F.regexp_extract(c, "^([A-Za-z]" + "[A-Za-z0-9' -]{2,60}" + ") means ", 1)
    return F.when(t != "", F.trim(t))


def recurrences(full_text: Column, term: Column) -> Column:
    """Whole-word occurrences of term, whatever its case."""
    pattern = F.concat(F.lit(r"(?iU)\b"), quoted_column(term), F.lit(r"\b"))
    return F.regexp_count(full_text, pattern).cast("bigint")


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")


def chunks(c: Column, token_ceiling: int = 6000) -> Column:
    """Text cut after full stops and semicolons into chunks of at most the ceiling,
    filled greedily; a longer sentence stays whole, and so does a text under it."""
    most = token_ceiling * 4
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, seg: Column) -> Column:
        fits = F.length(acc["open"]) + 1 + F.length(seg) <= most
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), seg.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), seg).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), seg.alias("open")))
        )

    packed = F.aggregate(F.split(c, UNICODE + r"(?<=[.;])\s+"), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.when(estimated_tokens(c) <= token_ceiling, F.array(c)).otherwise(packed)


def search_fragments(title: Column, least: int = 6) -> Column:
    """Fragments to search a title by: without its year, then without one and two
    leading words, then the same without bracketed parts; short ones left out."""
    bare = F.regexp_replace(F.regexp_replace(title, r"\s*\d{4}$", ""), r"^[) ]+", "")
    plain = collapse(F.regexp_replace(bare, r"\([^)]*\)", " "))

    def tails(c: Column) -> Column:
        parts = F.split(c, " ")
        return F.transform(F.sequence(F.lit(0), F.least(F.lit(2), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), " "))

    return F.array_distinct(F.filter(F.concat(tails(bare), tails(plain)), lambda f: F.length(f) >= least))
