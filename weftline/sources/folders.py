"""Study folders as one source: all files of a kind are read in one scan, each by its own header.

One job finds the headers of all files, which are small; a second one reads the lines of all files and takes each line's fields by the header of its file. So a
hundred files cost as many jobs as one, and a file's lines may be read by many tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.values import typed
from weftline.sources import files
from weftline.sources.files import Header

#: Kinds of study files by their name; the first that fits counts (SRC-09 to SRC-16).
KINDS = {
    "clinical": r"data_clinical_.*", "mutations": r"data_mutations(_extended)?\.txt", "variants": r"data_sv\.txt", "copy_numbers": r"data_cna\.txt", "gene_panels": r"data_gene_panel_matrix\.txt",
    "segments": r".*\.seg", "timeline": r"data_timeline_.*", "resource": r"data_resource_.*",
}

#: Headers that are sent to all tasks at once; of more files they are shuffled.
SENT_FILES = 20_000


def study_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, name, study, kind, length) of the files of all studies under ``root`` that are taken (SRC-21); study: the folder a file is in. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"), "length")
    parts = F.split("file", "/")
    named = found.select("file", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("study"), "length")
    kind = F.lit(None).cast("string")
    for k, pattern in reversed(KINDS.items()):
        kind = F.when(F.col("name").rlike(f"^({pattern})$"), k).otherwise(kind)
    skip = F.lit(False)
    for start in files.SKIP_STARTS:
        skip = skip | F.col("name").startswith(start)
    return named.withColumn("kind", kind).where(F.col("kind").isNotNull() & (~skip | F.col("name").endswith(files.TAKE_ENDS[0])))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(paths)
    return text.select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).where("value <> ''")


def heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, names, comments, pointer): of each file the first line that is no comment, as names, and the fields of its first three comments.

    Only lines of a file's first block are looked at. Files without a line of names are left out; pointers to files that were not fetched are marked (SRC-22).
    """
    first = _lines(spark, paths).where("start = 0").withColumn("at", F.monotonically_increasing_id())
    order = Window.partitionBy("file", "comment").orderBy("at")
    near = first.withColumn("comment", F.col("value").startswith("#")).withColumn("n", F.row_number().over(order)).where("n <= 3")
    names = F.min_by(F.when(~F.col("comment"), F.col("value")), F.when(~F.col("comment"), F.col("n")))
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("comment"), F.struct("n", "value")))), lambda c: F.split(F.regexp_replace(c["value"], "^#+", ""), "\t"))
    found = near.groupBy("file").agg(names.alias("line"), told.alias("comments")).where("line is not null")
    return found.select("file", F.split("line", "\t", -1).alias("names"), "comments", F.col("line").startswith(files.POINTER).alias("pointer"))


@dataclass
class _Head(Header):
    line: str = ""


def _known(found: DataFrame) -> dict[str, _Head]:
    """The headers of all files by name, with names that differ in case only made unique, and the line they come from."""
    out = {}
    for r in found.where("not pointer").orderBy("file").collect():  # one row a file
        told = [c if len(c) == len(r["names"]) else [] for c in [*r["comments"], [], [], []][:3]]
        out[r["file"]] = _Head(files.unique_names(r["names"]), *told, line="\t".join(r["names"]))
    return out


def _types(kind: str | None, known: dict[str, _Head]) -> dict[str, str]:
    """The type of each column, if all files that have it agree; else it is text."""
    found: dict[str, set[str]] = {}
    for h in known.values():
        lab = files.LAB_COLUMNS <= {n.upper() for n in h.names}
        for i, n in enumerate(h.names):
            of = "string"
            if kind == "clinical" and h.kinds:
                of = {"NUMBER": "double", "BOOLEAN": "boolean"}.get(h.kinds[i].strip().upper(), "string")
            elif (kind == "mutations" and n in files.MUTATION_INTEGERS) or (kind == "variants" and n.endswith(files.VARIANT_INTEGER_ENDS)):
                of = "bigint"
            elif kind == "timeline" and lab and n.upper() == "VALUE":
                of = "double"
            elif kind == "segments":
                of = files.SEGMENT_TYPES.get(files.SEGMENT_NAMES.get(n.strip(), n), "string")
            found.setdefault(n.lower(), set()).add(of)
    return {n: kinds.pop() if len(kinds) == 1 else "string" for n, kinds in found.items()}


def _fields(spark: SparkSession, paths: list[str], known: dict[str, _Head], columns: list[str]) -> DataFrame:
    """(file, n_names, slots, f): the fields of every line that is no comment and no header, with the place of each of ``columns`` in its file."""
    rows = []
    for file, h in known.items():
        at = {n.lower(): i for i, n in enumerate(h.names)}
        rows.append((file, h.line, len(h.names), [at.get(c.lower()) for c in columns]))
    table = spark.createDataFrame(rows, "file string, header string, n_names int, slots array<int>")
    lines = _lines(spark, paths).where(~F.col("value").startswith("#"))
    met = lines.join(F.broadcast(table) if len(rows) <= SENT_FILES else table, "file").where("value <> header")
    return met.select("file", "n_names", "slots", F.split("value", "\t", -1).alias("f"))


def read_files(spark: SparkSession, paths: list[str], kind: str | None = None) -> DataFrame:
    """Rows of all files under ``paths`` in one scan, with the columns of all their headers and ``source_file`` (SRC-08 to SRC-16, SRC-31).

    A column that a file lacks is null there; lines with another number of fields than their file's header are left out, see ``malformed``; descriptions in the headers become column
    comments, the first by file name. Names that differ in case only are one column. Pointers and files without names give no rows. Columns come in the order in which files, by name, first have them.
    """
    known = _known(heads(spark, paths))
    spelled: dict[str, str] = {}
    for h in known.values():
        for n in h.names:
            spelled.setdefault(n.lower(), n)
    columns = list(spelled.values())
    if not columns:
        return spark.createDataFrame([], "source_file string")
    types, notes = _types(kind, known), {}
    for h in known.values():
        for n, d in zip(h.names, h.descriptions):
            if d.strip():
                notes.setdefault(n.lower(), d)
    good = _fields(spark, paths, known, columns).where(F.size("f") == F.col("n_names"))
    out = []
    for i, n in enumerate(columns):
        name = files.SEGMENT_NAMES.get(n.strip(), re.sub(r"\.", "_", n.strip())) if kind == "segments" else n
        c = typed(F.get("f", F.get("slots", F.lit(i))), types[n.lower()])
        out.append(c.alias(name, metadata={"comment": notes[n.lower()]}) if n.lower() in notes else c.alias(name))
    return good.select(*out, F.col("file").alias("source_file"))


def malformed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, n_rows, n_malformed) of every file with names."""
    known = _known(heads(spark, paths))
    if not known:
        return spark.createDataFrame([], "source_file string, n_rows long, n_malformed long")
    bad = F.size("f") != F.col("n_names")
    met = _fields(spark, paths, known, []).groupBy(F.col("file").alias("source_file")).agg(F.count_if(~bad).alias("n_rows"), F.count_if(bad).alias("n_malformed"))
    every = spark.createDataFrame([(f,) for f in known], "source_file string")
    return every.join(met, "source_file", "left").select("source_file", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_rows", "n_malformed")))


def comments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, column, comment) from the headers of all files in one job (SRC-31)."""
    found = heads(spark, paths).where(~F.col("pointer") & (F.size("comments") >= 2)).withColumn("told", F.get("comments", F.lit(1))).where(F.size("told") == F.size("names"))
    each = found.select("file", F.explode(F.arrays_zip("names", "told")).alias("c"))
    return each.where(F.trim("c.told") != "").select(F.col("file").alias("source_file"), F.col("c.names").alias("column"), F.col("c.told").alias("comment"))
