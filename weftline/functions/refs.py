"""References to tables and columns, such as ``databricks://workspace/catalog/schema/table/column`` (D7, FN-25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of references, in the order in which they are tried, with the parts of their groups. The
#: dotted form of a column comes before the one with slashes.
FORMS = [
    ("databricks", r"^databricks://([^/]+)/([^/]+)/([^/]+)/([^.]+)\.(.+)$", ["source", "catalog", "schema", "table", "column"]),
    ("databricks", r"^databricks://([^/]+)/([^/]+)/([^/]+)/([^/]+)(?:/(.+))?$", ["source", "catalog", "schema", "table", "column"]),
    ("postgres", r"^postgres://([^/]+)/([^/]+)/([^/]+)/([^/]+)(?:/(.+))?$", ["host", "catalog", "schema", "table", "column"]),
    ("mysql", r"^mysql://([^/]+)/([^/]+)/([^/]+)(?:/(.+))?$", ["host", "catalog", "table", "column"]),
    ("unity", r"^unity://([^.]+)\.([^.]+)\.([^.]+)(?:\.(.+))?$", ["catalog", "schema", "table", "column"]),
]


def parse_ref(ref: Column) -> Column:
    """A struct (source, catalog, schema, table, column); null when no form fits."""
    out = F.lit(None).cast("struct<source:string,catalog:string,schema:string,table:string,column:string>")
    for platform, pattern, names in reversed(FORMS):
        group = {n: F.nullif(F.regexp_extract(ref, pattern, i), F.lit("")) for i, n in enumerate(names, 1)}
        source = group.get("source") if "source" in group else F.concat_ws("/", group["host"], group["catalog"]) if "host" in group else F.lit(platform)
        none = F.lit(None).cast("string")
        parts = [source.alias("source"), *(group.get(n, none).alias(n) for n in ("catalog", "schema", "table", "column"))]
        out = F.when(ref.rlike(pattern), F.struct(*parts)).otherwise(out)
    return out


def table_key(ref: Column) -> Column:
    """One name for a table whatever form its reference has, so that references join by equality (JOIN-30)."""
    p = parse_ref(ref)
    return F.when(p.isNotNull(), F.concat_ws(".", F.coalesce(p["catalog"], F.lit("")), F.coalesce(p["schema"], F.lit("")), p["table"]))


def translate_ref(ref: Column, workspace: str) -> Column:
    """Dotted references of the ``unity`` form as slashed ones; others stay."""
    pattern = FORMS[-1][1]
    group = lambda i: F.regexp_extract(ref, pattern, i)
    slashed = F.concat_ws("/", F.lit(f"databricks://{workspace}"), group(1), group(2), group(3), F.nullif(group(4), F.lit("")))
    return F.when(ref.rlike(pattern), slashed).otherwise(ref)
