"""JSON in free text: exact extraction, repair of cut texts, usage counts, schema conformance."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
#: Evidence codes.
EVIDENCE_CODES = "EXP IDA IPI IMP IGI IEP HTP HDA HMP HGI HEP ISS ISO ISA ISM IGC RCA TAS NAS IC IEA".split()


def find_json(text: str | None) -> str | None:
    """The JSON value in a text, as compact JSON; null where there is none.

    A fenced block decides alone.  Otherwise the span from the first { to the last }, then from the first [ to the last ],
    then the whole text is tried."""
    if text is None:
        return None
    fence = _FENCE.search(text)
    spans = [fence.group(1)] if fence else [text[text.find(a) : text.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= text.find(a) < text.rfind(b)] + [text]
    for s in spans:
        try:
            return json.dumps(json.loads(s), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            pass
    return None


def close_json(text: str | None, reach: int = 3000) -> str | None:
    """Repair of a text cut off inside its JSON: shorten it from the end and close open brackets until it parses."""
    if not text:
        return None
    body = text[max(0, text.find("{")) :]
    for end in range(len(body), max(0, len(body) - reach), -1):
        stack, quoted, escaped = [], False, False
        for c in body[:end]:
            if quoted:
                quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        if quoted:
            continue
        try:
            return json.dumps(json.loads(body[:end].rstrip().rstrip(",") + "".join(reversed(stack))), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def extract_json(c: pd.Series) -> pd.Series:
    return c.map(find_json, na_action="ignore")


@F.pandas_udf(StringType())
def repair_json(c: pd.Series) -> pd.Series:
    return c.map(lambda t: find_json(t) or close_json(t), na_action="ignore")


def extract_json_fast(c: Column) -> Column:
    """The same without Python: the fenced block decides alone; else from the first { to the last }, else from the first [ to the
    last ], else the whole text, the first of them that is JSON."""
    fence = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)

    def value(t: Column) -> Column:  # in brackets, as the parser stops behind a first value
        held = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>")
        return F.when(F.size(held) == 1, F.to_json(F.get(held, F.lit(0))))

    spans = [F.regexp_extract(c, p, 1) for p in (r"(?s)(\{.*\})", r"(?s)(\[.*\])")]
    return F.when(c.rlike(r"(?is)```(?:json)?\s*.*?```"), value(fence)).otherwise(F.coalesce(*map(value, spans), value(c)))


#: Where providers put token counts, by our name.
USAGE_KEYS = {"input": ["input", "input_tokens", "prompt_tokens"], "output": ["output", "output_tokens", "completion_tokens"], "total": ["total", "total_tokens"]}


def usage(raw: Column, what: str) -> Column:
    """A token count from a usage object given as JSON, whatever the provider's spelling; total falls back to the sum."""
    found = F.coalesce(*[F.get_json_object(raw, f"$.{k}").try_cast("double").cast("long") for k in USAGE_KEYS[what]])
    return F.coalesce(found, usage(raw, "input") + usage(raw, "output")) if what == "total" else found


def cache_note(raw: Column) -> Column:
    """What a usage object (JSON text) says of cached tokens, as 'cached=1,234 write=5 cost=0.1'; the cost only if it is there."""
    count = lambda k: F.format_number(F.coalesce(F.get_json_object(raw, f"$.prompt_tokens_details.{k}").try_cast("double").cast("long"), F.lit(0)), 0)
    return F.concat_ws(" ", F.concat(F.lit("cached="), count("cached_tokens")), F.concat(F.lit("write="), count("cache_write_tokens")), F.concat(F.lit("cost="), F.get_json_object(raw, "$.cost")))


def valid_evidence(c: Column) -> Column:
    """Known codes, separated by a semicolon and at most one space."""
    one = "(?:" + "|".join(EVIDENCE_CODES) + ")"
    return F.coalesce(c.rlike(f"^{one}(?:; ?{one})*$"), F.lit(False))


def conforms(raw: Column, required: Sequence[str], enums: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Whether a JSON object has all required keys and its enumerated fields hold one of their values."""
    keys = F.json_object_keys(raw)
    ok = F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) == 0, F.lit(False))
    for field, values in (enums or {}).items():
        v = F.get_json_object(raw, f"$.{field}")
        ok = ok & (v.isNull() | v.isin(list(values)))
    return ok
