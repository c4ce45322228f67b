"""Keys and names as column expressions.

Null inputs give null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what parts the fields of hashed keys.
UNIT = "\x1f"

#: Type names that count as one family when keys are compared.
INTEGER_TYPES = ["int", "integer", "bigint", "smallint", "tinyint", "long"]
TEXT_TYPES = ["string", "varchar", "char", "text", "uuid"]

#: Columns of these names say little about a join.
GENERIC_COLUMNS = ["id", "name", "type", "status", "value", "code", "description", "created_at", "updated_at"]


def strip(c: Column) -> Column:
    """Without white space at both ends, tabs and line ends included (FN-27, ID-01)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space values (FLT-09)."""
    return F.coalesce(strip(c), F.lit("")) == ""


def surrogate_id(*parts: Column) -> Column:
    """A stable bigint from the parts: the first 60 bits of their md5 (FN-01)."""
    joined = F.concat(*(x for i, p in enumerate(parts) for x in ([F.lit(UNIT)] if i else []) + [p.cast("string")]))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def entity_uid(namespace: Column, key: Column) -> Column:
    """FN-02."""
    return F.sha2(F.concat(namespace, F.lit(UNIT), key), 256)


def family_key(subject: Column, predicate: Column, identity: Column, target: Column) -> Column:
    """The key of competing claims; null parts count as empty (FN-03)."""
    return F.sha2(F.concat_ws("|", subject, predicate, *(F.coalesce(c, F.lit("")) for c in (identity, target))), 256)


def row_key(rule: Column, **refs: Column) -> Column:
    """FN-04: a digest of a rule and its named values, in the order given."""
    return F.sha2(F.concat_ws("|", rule, *(F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit(""))) for n, c in refs.items())), 256)


def profile_hash(signature: Column) -> Column:
    """FN-33: a digest of a JSON signature, the same for any order of its keys; null for what is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(signature)), 256)


def cache_key(prefix: Column, *versions: Column) -> Column:
    """FN-33: what a prompt's answer is kept by: the digest of its prefix and the versions that made it. The source it is about is no part of it."""
    return F.sha2(F.concat_ws("|", F.sha2(prefix, 256), *(F.coalesce(v.cast("string"), F.lit("")) for v in versions)), 256)


def leaks(prefix: Column, ref: Column) -> Column:
    """FN-33: whether a prefix names the source it is sent for, so that no two calls would share it; an empty reference is a fault too."""
    return F.coalesce((ref == "") | F.contains(prefix, ref), F.lit(True))


def text_digest(c: Column) -> Column:
    """FN-05."""
    return F.sha2(c, 256)


def join_digest(pairs: Column) -> Column:
    """12 hex digits for an array of "a=b" strings in any order (FN-06)."""
    return F.substring(F.sha2(F.array_join(F.array_sort(pairs), "|"), 256), 1, 12)


def normal_name(c: Column) -> Column:
    """One space between words, none outside; case is kept (FN-07). Texts are taken to be composed (NFC) already: see ``functions.text``."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def safe_schema_name(prefix: str, c: Column, longest: int = 63, digits: int = 10) -> Column:
    """``prefix_name`` with lower-case letters, digits and single underscores; long ones end in a digest (FN-08). Null when nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", "")
    whole = F.concat(F.lit(f"{prefix}_"), plain)
    room = longest - len(prefix) - 2 - digits
    short = F.concat(F.lit(f"{prefix}_"), F.regexp_replace(F.substring(plain, 1, room), "_+$", ""), F.lit("_"), F.substring(F.sha2(c, 256), 1, digits))
    return F.when(plain == "", None).when(F.length(whole) <= longest, whole).otherwise(short)


def bare_column_name(c: Column) -> Column:
    """Without a type that was written behind the name; empty when there is no name (FN-09)."""
    return F.regexp_extract(strip(c), r"^([^\s(\[:]+)\s*(?:[(\[:].*)?$", 1)


def base_type(c: Column) -> Column:
    """Lower case, without parameters (FN-10)."""
    return strip(F.lower(F.substring_index(c, "(", 1)))


def same_type_family(left: Column, right: Column) -> Column:
    a, b = base_type(left), base_type(right)
    return (a == b) | (a.isin(INTEGER_TYPES) & b.isin(INTEGER_TYPES)) | (a.isin(TEXT_TYPES) & b.isin(TEXT_TYPES))


def key_root(c: Column) -> Column:
    """The entity that a foreign-key name speaks of, empty if none (FN-11)."""
    return F.regexp_extract(F.lower(c), "^(.+?)_(id|key|code)$", 1)


def is_key_name(c: Column) -> Column:
    """FN-12."""
    return F.lower(c).rlike("_id$|_key$|_pk$|_fk$|^id$|^key$")


def name_tokens(c: Column) -> Column:
    """FN-14."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "-", "_"), "_"), lambda t: t != "")
