"""From source codes and keys to staged rows, child and parent tables, and back after identities were collapsed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from weftline.operators import identity, quality, resolve


@dataclass
class Shape:
    child: DataFrame
    parent: DataFrame
    registry: DataFrame
    missing: DataFrame


def stage(source: DataFrame, code: str, row_ref: str, concepts: DataFrame, relations: DataFrame, policy: resolve.Policy, schema: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(staged rows, decisions)."""
    decisions = resolve.resolve(source.select(source[code].alias("code")), concepts, relations, policy)
    return resolve.stage(source, code, row_ref, decisions, schema, table), decisions


def shape(source: DataFrame, registry: DataFrame | None, decisions: DataFrame, *, namespace: str, key: str, code: str, row_ref: str, schema: str, table: str, run_id: str) -> Shape:
    """FKC-01: the registry first, then children on its ids, then parents from all of it."""
    from pyspark.sql import functions as F

    found = identity.normal_keys(source, key).select(F.lit(namespace).alias("source_namespace"), F.col(key).alias("source_key"))
    full = identity.register(registry, found, run_id)
    child = identity.children(source, full, decisions, namespace=namespace, key=key, code=code, row_ref=row_ref, schema=schema, table=table)
    return Shape(child, identity.parents(full), full, identity.missing_keys(source, key))


def collapse(made: Shape, groups: DataFrame, namespace: str) -> Shape:
    """FKC-02."""
    full = identity.remap(made.registry, identity.collapse_plan(made.registry, groups))
    child, parent = identity.rebuild(made.child, full, namespace)
    return Shape(child, parent, full, made.missing)


def closed(made: Shape) -> bool:
    """QA-04: no child without a parent."""
    return quality.orphans(made.child, made.parent, "parent_id", "entity_id").limit(1).count() == 0


def require_uniform(shapes: dict[str, tuple]) -> None:
    """FKC-03: studies that are collapsed together have one parent, child, registry, decisions and default. ``shapes``: these for each study."""
    first = next(iter(shapes.values()), None)
    other = [name for name, shape in shapes.items() if shape != first]
    if other:
        raise ValueError(f"these studies have another shape than {next(iter(shapes))}: {', '.join(other)}")
