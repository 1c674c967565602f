"""Similarity of descriptions: token sets, edit ratios, character TF-IDF, embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _both(a: Column, b: Column, value: Column) -> Column:
    """Null where either side is null or empty."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    return F.when(~empty(a) & ~empty(b), value)


def exact_match(a: Column, b: Column) -> Column:
    return _both(a, b, (a == b).cast("double"))


def _sets(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Sizes of a - b, b - a, and the intersection of two token arrays taken as sets."""
    return F.size(F.array_except(a, b)), F.size(F.array_except(b, a)), F.size(F.array_intersect(a, b))


def one_word_off(a: Column, b: Column) -> Column:
    """1 where two texts differ by one word: of as many words with one changed (or the same ones in another order), or one word
    more; 0 elsewhere, equal texts included.  Words are compared as sets once their numbers allow it.  Null where either is null or empty."""
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    x, y = words(a), words(b)
    left, right, _ = _sets(x, y)
    apart = F.size(x) - F.size(y)
    level = (apart == 0) & ((left + right == 0) | (left + right == 2))
    more = ((apart == 1) & (right == 0) & (left == 1)) | ((apart == -1) & (left == 0) & (right == 1))
    return _both(a, b, ((a != b) & (level | more)).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def precision_jaccard(reference: Column, candidate: Column) -> Column:
    """Share of the candidate's distinct tokens that the reference has: 0 for an empty reference, null for an empty candidate."""
    known = F.coalesce(reference, F.array().cast("array<string>"))
    return F.when(F.size(candidate) > 0, F.size(F.array_intersect(known, candidate)) / F.size(F.array_distinct(candidate)))


def edit_similarity(a: Column, b: Column) -> Column:
    return _both(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with a row of bits per character."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = at.get(c, 0) & row
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any part of the longer one of its length, or a shorter part at an end."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    return max(_ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / total length; null where either side is null or empty."""
    return pd.Series([_ratio(x, y) if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def soft_jaccard(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """Mean over the candidate's tokens, repeats included, of the best partial ratio with any reference token."""
    return pd.Series([sum(max(_partial_ratio(t, r) for r in ref) for t in can) / len(can) if ref is not None and can is not None and len(ref) and len(can) else None for ref, can in zip(reference, candidate, strict=True)], dtype="float64")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null for null, empty, unequal length or zero vectors."""
    d = lambda c: c.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm)


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Array of the character n-grams inside words padded by spaces, repeats included; empty for null."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(w: Column, n: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
        return F.when(F.length(w) >= n, parts).otherwise(F.array().cast("array<string>"))

    grams = lambda w: F.concat(*[of_size(w, n) for n in range(low, high + 1)])
    return F.coalesce(F.flatten(F.transform(padded, grams)), F.array().cast("array<string>"))


#: Fixed value: a vocabulary of at most so many grams is broadcast, some 20 MB.
BROADCAST_GRAMS = 200_000


def vocabulary(fit_on: DataFrame, text: str) -> DataFrame:
    """gram and df, the number of rows whose text has it; equal texts are taken apart once."""
    once = fit_on.groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_rows"))
    return once.select("_rows", F.explode(F.array_distinct(char_grams(F.col("_text")))).alias("gram")).groupBy("gram").agg(F.sum("_rows").alias("df"))


def tfidf_cosine(pairs: DataFrame, key: list[str], a: str, b: str, fit_on: DataFrame, fit_text: str) -> DataFrame:
    """key and tfidf_cosine of the texts in columns a and b; the vocabulary is fitted on ``fit_text`` of ``fit_on``'s rows.

    Weights are (1 + ln tf) * idf, idf = ln((1 + n) / (1 + df)) + 1; grams that the vocabulary lacks are dropped.  Texts are dealt out
    by key before they are taken apart, so their grams are counted where they arise.  The optimiser takes grams for no more
    than the texts they come from, so all joins say how they are done."""
    from paperloom.operators.stages import written

    spark = pairs.sparkSession
    fitted, n = written(vocabulary(fit_on, fit_text)), fit_on.count()
    fitted = fitted.hint("broadcast" if fitted.count() <= BROADCAST_GRAMS else "merge")
    dealt = pairs.select(*key, F.col(a).alias("_a"), F.col(b).alias("_b")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    both = dealt.select(*key, char_grams(F.col("_a")).alias("_a"), char_grams(F.col("_b")).alias("_b"))
    grams = both.select(*key, F.size("_a").alias("_n"), F.posexplode(F.concat("_a", "_b")).alias("_i", "gram")).groupBy(*key, "gram").agg(F.count_if(F.col("_i") < F.col("_n")).alias("_a"), F.count_if(F.col("_i") >= F.col("_n")).alias("_b"))
    idf = F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1
    weight = lambda c: F.when(F.col(c) > 0, (1 + F.log(c)) * idf).otherwise(0.0)
    w = grams.join(fitted, "gram").select(*key, weight("_a").alias("_x"), weight("_b").alias("_y"))
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    by = w.groupBy(*key).agg(dot("_x", "_y").alias("_xy"), dot("_x", "_x").alias("_xx"), dot("_y", "_y").alias("_yy"))
    cosine = F.when(F.col("_xy") > 0, F.col("_xy") / (F.sqrt("_xx") * F.sqrt("_yy"))).otherwise(0.0)
    return pairs.select(*key).join(by.hint("merge"), key, "left").select(*key, cosine.alias("tfidf_cosine"))


def score_pairs(pairs: DataFrame, key: list[str], target: str, candidates: list[str], symbols: str, fit_on: DataFrame, fit_text: str, embedded: dict[str, str] | None = None, lemma=None) -> DataFrame:
    """All similarities of candidate descriptions to a target: key and, for each candidate column, ``SemSim_<column>_<measure>`` and
    ``<column>_<flag>``; all null where the cleaned candidate is empty.

    ``symbols`` is a column of symbols that count as names, not words.  ``embedded`` maps a text column to one of its
    embedding, for an embedding cosine; ``lemma`` maps words to their base forms."""
    from paperloom.functions.text import clean_text, strip_symbols, tokens

    empty = F.array().cast("array<string>")
    d = pairs.withColumn("_s", F.coalesce(F.col(symbols), empty))
    for c in [target, *candidates]:
        raw = F.lower(F.coalesce(F.col(c), F.lit("")))
        d = d.withColumns({f"_raw_{c}": raw, f"_no_{c}": strip_symbols(raw, F.col("_s")), f"_clean_{c}": clean_text(F.col(c), F.col("_s"), lemma)})
        d = d.withColumn(f"_tok_{c}", tokens(F.col(f"_no_{c}"), lemma=lemma))
    out = d
    for c in candidates:
        vectors = tfidf_cosine(d.select(*key, f"_raw_{c}", f"_raw_{target}"), key, f"_raw_{c}", f"_raw_{target}", fit_on, fit_text)
        out = out.join(vectors.withColumnRenamed("tfidf_cosine", f"_tfidf_{c}"), key, "left")
    columns = []
    for c in candidates:
        some = F.size(f"_tok_{c}") > 0
        name = lambda m, c=c: f"SemSim_{c}_{m}"
        mine, goal = F.col(f"_tok_{c}"), F.col(f"_tok_{target}")
        measures = {name("jaccard"): jaccard(mine, goal), name("soft_jaccard"): soft_jaccard(goal, mine), name("prec_jaccard"): precision_jaccard(goal, mine), name("levenshtein"): indel_ratio(F.col(f"_clean_{c}"), F.col(f"_clean_{target}")), name("tfidf_cosine"): F.col(f"_tfidf_{c}")}
        if embedded:
            measures[name("embed_cosine")] = cosine(F.col(embedded[c]), F.col(embedded[target]))
        for kind in ("raw", "no", "clean"):
            x, y = F.col(f"_{kind}_{c}"), F.col(f"_{kind}_{target}")
            label = {"no": "nosym"}.get(kind, kind)
            measures |= {f"{c}_Exact_{label}": exact_match(x, y), f"{c}_OneWord_{label}": one_word_off(x, y)}
        columns += [F.when(some, m).alias(n) for n, m in measures.items()]
    return out.select(*key, *columns)
