"""Mention patterns, cleaning and prompt texts as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greek letters and how they are spelt in Latin.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta",
    "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon",
    "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
#: Sections of an article that are read.
SECTIONS = ["RESULTS", "FIG", "DISCUSSION", "DISCUSS", "CONCLUSION", "FIGURE", "CONCL", "TABLE", "SUPPL"]
#: English words that carry no meaning in a product description, and four more.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than
too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
using based via data
""".split()


def term_pattern(term: Column) -> Column:
    """Regular expression for a term in running text.

    Letters and digits must not touch the match; letters directly followed by digits may be split by one hyphen; any run
    of underscore, hyphen and space matches any such run.  All other characters stand for themselves."""
    t = F.regexp_replace(term, r"[_\-\s]+", "\u0001")
    t = F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|/#&~])", r"\\$1")
    joined = F.when(term.rlike("^[A-Za-z]+[0-9]+$"), F.regexp_replace(t, "^([A-Za-z]+)([0-9]+)$", "$1-?$2")).otherwise(t)
    joined = F.replace(joined, F.lit("\u0001"), F.lit(r"[-_\s]+"))
    return F.concat(F.lit("(?iU)(?<![A-Za-z0-9])(?:"), joined, F.lit(")(?![A-Za-z0-9])"))


def mentions(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text``; 0 for an empty term or null."""
    n = F.regexp_count(text, term_pattern(term))
    return F.when(F.trim(term) == "", F.lit(0)).otherwise(F.coalesce(n, F.lit(0))).cast("long")


def any_term_pattern(terms: Column, shortest: int = 3) -> Column:
    """Alternation over an array of terms in their order, without those shorter than ``shortest``; null if none is left."""
    kept = F.filter(terms, lambda t: F.length(t) >= shortest)
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, term_pattern), "|"))


def longest_fragment(term: Column) -> Column:
    """The longest run of letters and digits in a term, lower-cased: a text without it cannot mention the term."""
    runs = F.filter(F.split(F.lower(term), "[^a-z0-9]+|(?<=[a-z])(?=[0-9])"), lambda x: x != "")
    best = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return F.coalesce(best["x"], F.lit(""))


def greek_to_latin(c: Column) -> Column:
    out = F.lower(c)
    for g, latin in GREEK.items():
        out = F.replace(out, F.lit(g), F.lit(latin))
    return F.replace(out, F.lit("ς"), F.lit("sigma"))


def strip_symbols(c: Column, symbols: Column) -> Column:
    """Remove whole words that are in the array ``symbols``, the longest first."""
    longest = F.array_sort(F.filter(symbols, lambda s: s != ""), lambda a, b: F.when(F.length(a) == F.length(b), F.when(a < b, -1).when(a > b, 1).otherwise(0)).otherwise(F.length(b) - F.length(a)))
    escaped = F.transform(longest, lambda s: F.regexp_replace(s, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"))
    return F.when(F.size(longest) > 0, F.regexp_replace(c, F.concat(F.lit(r"(?i)\b("), F.array_join(escaped, "|"), F.lit(r")\b")), F.lit(""))).otherwise(c)


def tokens(c: Column, stop: Sequence[str] = STOP_WORDS, lemma=None) -> Column:
    """Lower-case words, split at white space; each that is no stop word, as its base form (``lemma`` maps a column; by default the
    word itself) with Greek letters spelt out, is split at -_.(),/\\, and parts that hold a letter and are no stop words stay."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: ~w.isin(list(stop)))
    base = words if lemma is None else F.transform(words, lemma)
    parts = F.flatten(F.transform(F.transform(base, greek_to_latin), lambda w: F.split(w, r"[-_.(),/\\]")))
    return F.filter(F.transform(parts, lambda w: F.trim(w)), lambda w: w.rlike("[a-z]") & ~w.isin(list(stop)))


def clean_text(c: Column, symbols: Column | None = None, lemma=None) -> Column:
    """The tokens of a description without the symbols, joined by spaces; '' for null."""
    t = c if symbols is None else strip_symbols(c, symbols)
    return F.coalesce(F.array_join(tokens(t, lemma=lemma), " "), F.lit(""))


def plain_mentions(text: Column, terms: Sequence[str]) -> Column:
    """Array of (term, n) for terms of ASCII letters alone, as ``mentions`` counts them.

    Such a term matches a whole run of letters and digits or none of it, so one pass finds all terms."""
    if not all(re.fullmatch("[A-Za-z]+", t) for t in terms):
        raise ValueError("terms of ASCII letters only")
    found = F.regexp_extract_all(text, F.lit("(?iU)(?<![A-Za-z0-9])(?:" + "|".join(terms) + ")(?![A-Za-z0-9])"), F.lit(0))
    low = F.transform(F.coalesce(found, F.array().cast("array<string>")), F.lower)
    return F.transform(F.array(*map(F.lit, terms)), lambda t: F.struct(t.alias("term"), F.size(F.filter(low, lambda w: w == F.lower(t))).cast("long").alias("n")))


def known_as(name: Column, aliases: Column) -> Column:
    """'G (also known as A or B)', or the name alone."""
    return F.when(F.size(aliases) > 0, F.concat(name, F.lit(" (also known as "), F.array_join(aliases, " or "), F.lit(")"))).otherwise(name)


def known_as_list(name: Column, aliases: Column) -> Column:
    return F.when(F.size(aliases) > 0, F.concat(name, F.lit(", also known as "), F.array_join(aliases, ", "))).otherwise(name)


def fill_template(template: Column, values: Mapping[str, object]) -> Column:
    """Each [KEY] replaced by its value, in the order given.  A value is a column, or a constant: text as it is, anything else as JSON
    indented by two."""
    for key, value in values.items():
        held = value.cast("string") if isinstance(value, Column) else F.lit(value if isinstance(value, str) else json.dumps(value, indent=2))
        template = F.replace(template, F.lit(f"[{key}]"), F.coalesce(held, F.lit("")))
    return template


def numbered(items: Column, code: str = "evidence_code", text: str = "description") -> Column:
    """Array of structs as lines '1. text [evidence_code: X]'."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x[text], F.lit("")), F.lit(f" [{code}: "), F.coalesce(x[code], F.lit("")), F.lit("]"))
    return F.array_join(F.transform(items, line), "\n")


def article_text(passages: Column, sections: Sequence[str] = SECTIONS) -> Column:
    """Texts of passages (section_type, text) in the wanted sections, each followed by a line break."""
    wanted = F.filter(passages, lambda p: F.upper(p["section_type"]).isin(list(sections)))
    return F.array_join(F.transform(wanted, lambda p: F.concat(F.coalesce(p["text"], F.lit("")), F.lit("\n"))), "")


def strip_tags(c: Column) -> Column:
    """Markup as text: tags become spaces, runs of white space one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
