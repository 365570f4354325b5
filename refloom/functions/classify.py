"""Labels, tags and identifiers as Catalyst expressions.

Lexicons are parameters; the defaults are those of legislative drafting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

OFFICES = tuple(sorted("agency authority commissioner court department minister ombudsman registrar regulator secretary tribunal".split()))
CONDITIONS = tuple(sorted("but except if notwithstanding provided unless when whenever where".split()))
OBLIGATIONS_SHORT = ("may not", "must", "prohibited", "required", "shall")
OBLIGATIONS = tuple(sorted((*OBLIGATIONS_SHORT, "cannot be", "may only")))
VAGUE = tuple(r"(?iU)" + p for p in (r"fair\w*", r"good faith", r"reasonabl\w*", r"unfair\w*", r"unjust\w*"))
RELATIONS = {
    "amends": r"(?iU)\bamend\w*\b",
    "references_definition": r"(?iU)\b(?:as defined in|has the same meaning as|within the meaning of)\b",
    "repeals": r"(?iU)\brepeal\w*\b",
}
WINDOW = 80
JUNK_WORDS = tuple(sorted("and at but for in include includes means of on or the to".split())) + (r"does\snot", r"is\snot")
JUNK = "(?i)^(?:" + "|".join(JUNK_WORDS) + r")(?:\s.*)?$"


def relation(ref_text: Column, section_text: Column, patterns: dict[str, str] = RELATIONS, window: int = WINDOW) -> Column:
    """struct(relation, confidence) by the words near a citation's first occurrence,
    the citation itself left out. One kind of word: that relation, .85; none, or the
    citation not found: cites, .75; several: null, for a scorer to settle."""
    i = F.instr(section_text, ref_text)
    before = F.substring(section_text, F.greatest(F.lit(1), i - window), F.least(F.lit(window), i - 1))
    after = F.substring(section_text, i + F.length(ref_text), F.lit(window))
    near = F.concat(before, F.lit(" "), after)
    kinds = F.filter(F.array(*[F.when(near.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda k: k.isNotNull())
    cites = F.struct(F.lit("cites").alias("relation"), F.lit(0.75).alias("confidence"))
    one = F.struct(F.try_element_at(kinds, F.lit(1)).alias("relation"), F.lit(0.85).alias("confidence"))
    return F.when(ref_text.isNull() | section_text.isNull() | (i == 0) | (F.size(kinds) == 0), cites).when(F.size(kinds) == 1, one)


def settled(found: Column, scored: Column | None = None) -> Column:
    """A relation with the scorer's word (.6) where it is null, or cites (.3) without
    a scorer or with a reply that is no relation."""
    guess = F.struct(F.lit("cites").alias("relation"), F.lit(0.3).alias("confidence"))
    if scored is None:
        return F.coalesce(found, guess)
    known = scored.isin("amends", "cites", "references_definition", "repeals")
    return F.coalesce(found, F.when(known, F.struct(scored.alias("relation"), F.lit(0.6).alias("confidence"))), guess)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def entity_type(term: Column, keywords: Sequence[str] = OFFICES) -> Column:
    """The longest keyword among the words of a term (of equals the last in order),
    else null."""
    own = F.array_intersect(T.matches(F.lower(term), "[a-z]+"), F.array(*map(F.lit, keywords)))
    return F.array_max(F.transform(own, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def density_tag(n: Column) -> Column:
    return F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low")


def obligations(c: Column, words: Sequence[str] = OBLIGATIONS) -> Column:
    return T.count(c, T.any_of(words))


def conditions(c: Column, words: Sequence[str] = CONDITIONS) -> Column:
    return T.count(c, T.any_of(words))


def vague_terms(c: Column, patterns: Sequence[str] = VAGUE) -> Column:
    """Sum over the patterns, so that unfair counts twice (as fair, too)."""
    return sum((T.count(c, p) for p in patterns[1:]), T.count(c, patterns[0]))


def agreement(tag: Column, vagueness: Column, density: Column) -> Column:
    """full, partial or none by the number of different tags, vagueness inverted."""
    turned = F.when(vagueness == "high", "low").when(vagueness == "low", "high").otherwise(vagueness)
    kinds = F.size(F.array_distinct(F.array(tag, turned, density)))
    return F.when(tag.isNull() | vagueness.isNull(), "not_computed").when(kinds == 1, "full").when(kinds == 2, "partial").otherwise("none")


def unfenced(reply: Column) -> Column:
    """A scorer's reply without a json fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```json\s*", ""), r"\s*```$", ""))


def variant_string(v: Column, field: str) -> Column:
    """A field of a variant, null unless it is a string there."""
    is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) == "STRING"
    return F.when(is_text, F.try_variant_get(v, f"$.{field}", "string"))


def parsed_signal(reply: Column) -> Column:
    """struct(tag, reasoning) of a scorer's JSON reply, in a json fence or bare; null
    unless tag is high, medium or low and reasoning a string."""
    v = F.try_parse_json(unfenced(reply))
    tag, why = F.try_variant_get(v, "$.tag", "string"), variant_string(v, "reasoning")
    return F.when(tag.isin("high", "medium", "low") & why.isNotNull(), F.struct(tag.alias("tag"), why.alias("reasoning")))


def request_id(signal: str, node_id: Column) -> Column:
    return F.concat(F.lit(signal + "_"), F.substring(F.sha2(F.concat(F.lit(signal + ":"), node_id), 256), 1, 16))


def is_junk_term(term: Column) -> Column:
    return (F.length(term) < 4) | term.rlike(JUNK)


def deep_link(title_id: Column, base: str = "https://www.legislation.gov.au/") -> Column:
    return F.when(F.length(title_id) > 0, F.concat(F.lit(base), title_id, F.lit("/latest/text")))


def slug(term: Column) -> Column:
    return F.translate(term, " -", "__")


def section_node(act: Column, eid: Column) -> Column:
    return F.concat(act, F.lit("#"), eid)


def term_node(act: Column, term: Column, occurrence: Column) -> Column:
    base = F.concat(act, F.lit("#term-"), slug(term))
    return F.when(occurrence > 1, F.concat(base, F.lit("__"), occurrence.cast("string"))).otherwise(base)


def relation_prompt(ref_text: Column, section_text: Column) -> Column:
    return F.concat(F.lit("Name the relation of this citation to its source (amends, repeals, references_definition or cites) as JSON.\nCitation: "), ref_text, F.lit("\nText: "), section_text)


def signal_prompt(text: Column, question: str) -> Column:
    return F.concat(F.lit(question + '\nReply with JSON: {"tag": "high|medium|low", "reasoning": "..."}\nProvision: '), text)


def definition_prompt(text: Column, terms: Column) -> Column:
    return F.concat(F.lit("Quote word for word the definition of each of these terms, as a JSON list of term and definition_text.\nTerms: "), F.array_join(terms, "; "), F.lit("\nSection: "), text)


def batch_request(signal: str, node_id: Column, prompt: Column) -> Column:
    return F.struct(request_id(signal, node_id).alias("custom_id"), prompt.alias("prompt"))
