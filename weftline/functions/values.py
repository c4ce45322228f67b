"""Values: casts that never fail, vocabularies known by their pattern, scores and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import strip

#: Cells that stand for no value in typed columns.
NO_VALUE = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "[Not Available]", "[Unknown]", "[Discrepancy]"]
TRUE_WORDS = ["1", "true", "yes"]

#: Fixed values: (vocabulary, pattern, whether case counts, words one of which must be in the context), in the order in which they are tried.
VOCABULARIES = [
    ("ICD-10", r"^[A-TV-Z]\d[\dA-Z](\.[\dA-Z]{1,4})?$", False, []),
    ("AJCC Staging", r"^stage\s+(0|I{1,3}V?|IV)(A\d?|B\d?|C\d?)?$", False, []),
    ("TNM Classification", r"^T\d[a-c]?N\d[a-c]?M\d[a-c]?$", False, []),
    ("LOINC", r"^\d{1,5}-\d$", True, []),
    ("NDC", r"^(?:\d{4}-\d{4}-\d{2}|\d{5}-\d{3}-\d{2}|\d{5}-\d{4}-\d{1}|\d{5}-\d{4}-\d{2})$", True, []),
    ("HGNC", r"^HGNC:\d+$", False, []),
    ("CPT", r"^\d{5}$", True, ["cpt", "procedure", "proc", "service", "billing", "claim", "surgery"]),
    ("NAICS", r"^\d{2,6}$", True, ["naics", "industry", "sector", "classification"]),
    ("SIC", r"^\d{4}$", True, ["sic", "industry", "sector", "standard"]),
    ("CUSIP", r"^[A-Z0-9]{9}$", False, ["cusip", "security", "bond", "equity", "isin"]),
    ("ISIN", r"^[A-Z]{2}[A-Z0-9]{10}$", False, ["isin", "security", "international"]),
    ("SWIFT/BIC", r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$", True, ["swift", "bic", "bank", "routing"]),
    ("LEI", r"^[A-Z0-9]{20}$", False, ["lei", "entity", "legal", "identifier"]),
    ("ZIP", r"^\d{5}(-\d{4})?$", True, ["zip", "postal", "address", "location", "city", "state", "mailing"]),
    ("FIPS", r"^\d{2,5}$", True, ["fips", "county", "state", "geographic"]),
    ("ISO-3166", r"^[A-Z]{2,3}$", True, ["country", "nation", "iso", "territory"]),
    ("ISO-4217", r"^[A-Z]{3}$", True, ["currency", "ccy", "money", "fx"]),
]
#: Sources of claims by their standing.
PRECEDENCE = {"human": 100, "atlan": 80, "dbt": 60, "unity_catalog": 40, "llm_interpretation": 20, "heuristic": 15, "pattern_match": 10}
#: What kinds of match add to a score.
MATCH_BOOST = {"lexical_exact": 0.3, "vector": 0.0, "graph": -0.1}


def text_cast(c: Column, kind: str) -> Column:
    """A text as ``kind``, null if it doesn't fit. Texts that cannot be numbers are told by a pattern: a cast that fails costs far more."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.when(c.rlike(r"^[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*$"), c.try_cast(kind))
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.when(c.rlike(r"(?i)[0-9]|nan|inf"), c.try_cast(kind))
    return c.try_cast(kind)


def typed(c: Column, kind: str) -> Column:
    """A text cell as ``kind``; cells that do not fit are null (SRC-17)."""
    if kind == "string":
        return c
    cell = F.when(strip(c).isin(NO_VALUE), None).otherwise(strip(c))
    if kind == "boolean":
        return F.lower(cell).isin(TRUE_WORDS)
    if kind in ("bigint", "int", "smallint"):
        return F.coalesce(text_cast(cell, kind), text_cast(cell, "double").try_cast(kind))
    return text_cast(cell, kind)


def vocabulary_pattern(i: int) -> str:
    _, pattern, cased, _ = VOCABULARIES[i]
    return pattern if cased else f"(?i){pattern}"


def pattern_confidence(ratio: Column) -> Column:
    """FN-17: null below a ratio of 0.6."""
    return F.when(ratio >= 0.6, F.least(0.9 + (ratio - 0.6) * 0.25, F.lit(1.0)))


def model_confidence(agrees: Column, keyword: Column, values: Column) -> Column:
    """FN-18."""
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.lit(0.5) + add(agrees, 0.15) + add(keyword, 0.1) + add(values >= 5, 0.05)


def precedence(source: Column) -> Column:
    """FN-24; 0 for unknown sources."""
    out = F.lit(0)
    for name, n in PRECEDENCE.items():
        out = F.when(source == name, n).otherwise(out)
    return out


def final_score(score: Column, confidence: Column, match: Column) -> Column:
    """FN-23; score and confidence default to 0.5, the match to "vector"."""
    boost = F.lit(0.0)
    for name, x in MATCH_BOOST.items():
        boost = F.when(match == name, x).otherwise(boost)
    return F.coalesce(score, F.lit(0.5)) * 0.4 + F.coalesce(confidence, F.lit(0.5)) * 0.3 + boost + 0.3


def frequency_bucket(n: Column) -> Column:
    """AGG-15."""
    return F.when(n >= 1000, "high").when(n >= 100, "medium").otherwise("low")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a vector without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
