"""Scalar expressions over ids, flags, numbers and identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that read as missing in delimited files.
MISSING = ["", "NA", "NaN", "nan", "N/A", "null", "NULL", "None"]


def truth(c: Column, also_one: bool = False) -> Column:
    """Boolean of a text flag: TRUE in any case, and 1 if asked for; anything else, null included, is false."""
    accepted = ["TRUE", "1"] if also_one else ["TRUE"]
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin(accepted), F.lit(False))


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def whole_number(c: Column) -> Column:
    """Text as a long through double ('12.0' is 12), 0 where it is none."""
    return F.coalesce(c.try_cast("double").cast("long"), F.lit(0).cast("long"))


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(MISSING), c)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Half-even rounded percentage; null where ``whole`` is 0."""
    return F.bround(F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def strip_chars_left(c: Column, chars: str) -> Column:
    """Leading characters that are in the set ``chars`` go, one by one."""
    return F.ltrim(c, F.lit(chars))


def clean_pmid(c: Column) -> Column:
    """Trimmed digits without a trailing '.0'; null for anything else."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(t.rlike("^[0-9]+$"), t)


def before_dot(c: Column) -> Column:
    return F.trim(F.split_part(c.cast("string"), F.lit("."), F.lit(1)))


def normal_pmcid(c: Column) -> Column:
    """Ids that already start with PMC, upper-cased; null for others."""
    u = F.upper(F.trim(c))
    return F.when(u.startswith("PMC"), u)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def norm_key(c: Column) -> Column:
    """Upper case, letter O as zero, letters and digits only."""
    return F.regexp_replace(F.translate(F.upper(c), "O", "0"), "[^A-Z0-9]", "")


def genus(c: Column) -> Column:
    """First word; the text nan for null."""
    return F.coalesce(F.split(F.trim(c), r"\s+").getItem(0), F.lit("nan"))


def join_non_blank(parts: Sequence[Column], sep: str = "; ") -> Column:
    return F.array_join(F.filter(F.array(*[F.trim(blank(p)) for p in parts]), lambda x: x != ""), sep)


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def extension(c: Column) -> Column:
    """Lower-case extension with its dot, '' without one."""
    return F.lower(F.regexp_extract(file_name(c), r"[^.](\.[^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"(?<=[^.])\.[^.]*$", "")


def snippet(c: Column, length: int = 200) -> Column:
    return F.translate(F.left(c, F.lit(length)), "\n", " ")


def truncated(c: Column, cap: int, marker: str = "…[truncated]") -> Column:
    return F.when(F.length(c) > cap, F.concat(F.left(c, F.lit(cap)), F.lit(marker))).otherwise(c)


def bucket(c: Column, edges: Sequence[tuple[int, int | None, str]]) -> Column:
    """Label of the range (low, high, label) that holds the value; a null high is open."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(edges):
        inside = (c >= low) if high is None else c.between(low, high)
        out = F.when(inside, label).otherwise(out)
    return out


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c.cast("long"))


def split_list(c: Column, sep: str = ",") -> Column:
    """Trimmed non-blank entries of a separated list, in order; empty for null."""
    return F.filter(F.transform(F.split(blank(c), sep), lambda x: F.trim(x)), lambda x: x != "")
