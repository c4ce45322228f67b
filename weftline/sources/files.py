"""Tab-separated study files, read by Spark as lines.

Rows whose number of fields is not that of the header are left out and counted by ``malformed``; a plain CSV reader would pad or cut
them. Only the first lines of a file come to the driver, for its header.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import typed
from weftline.operators.reshape import unpivot

#: Fixed values of the file formats: integer columns of mutation files, endings of integer columns of structural variants, names
#: and types of segment columns, columns that make a lab timeline.
MUTATION_INTEGERS = ["Start_Position", "End_Position", "t_depth", "t_ref_count", "t_alt_count", "n_depth", "n_ref_count", "n_alt_count"]
VARIANT_INTEGER_ENDS = ("_Position", "_Entrez_Gene_Id")
SEGMENT_NAMES = {"ID": "sample_id", "chrom": "chrom", "loc.start": "loc_start", "loc.end": "loc_end", "num.mark": "num_mark", "seg.mean": "seg_mean"}
SEGMENT_TYPES = {"loc_start": "bigint", "loc_end": "bigint", "num_mark": "bigint", "seg_mean": "double"}
LAB_COLUMNS = {"TEST", "VALUE", "UNITS"}
#: Which files of a study are taken.
TAKE_NAMES = {"meta_study.txt", "data_mutations.txt", "data_mutations_extended.txt", "data_sv.txt", "data_cna.txt", "data_gene_panel_matrix.txt"}
TAKE_ENDS = (".seg",)
TAKE_STARTS = ("data_clinical_", "data_timeline_", "data_resource_")
SKIP_STARTS = ("data_expression_", "data_methylation_", "data_log2_cna", "data_linear_cna", "data_armlevel_cna", "data_mrna_", "data_rppa")
#: Fixed value: how a file begins that only points to the real one.
POINTER = "version https://git-lfs"


@dataclass
class Header:
    """Names, and for clinical files what the lines before them say (SRC-09). Lists whose length differs from the names' are dropped."""

    names: list[str]
    labels: list[str] = field(default_factory=list)
    descriptions: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)


def wanted(name: str) -> bool:
    """SRC-21."""
    if name in TAKE_NAMES or name.endswith(TAKE_ENDS):
        return True
    return not name.startswith(SKIP_STARTS) and name.startswith(TAKE_STARTS)


def unique_names(names: list[str]) -> list[str]:
    """Names that differ in case only get _2, _3 and so on (SRC-10)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
        out.append(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}")
    return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_header(spark: SparkSession, path: str) -> Header:
    """The names are in the first line that is no comment and not blank, however many come before it; the first three comments may describe them.

    Files that are pointers are refused (SRC-22), and so are files with lines but without names.
    """
    text = lines(spark, path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    comment = F.col("value").startswith("#")
    first = text.where(~comment & (F.col("value") != "")).limit(1).collect()
    if not first:
        if not text.where("value <> ''").isEmpty():
            raise ValueError(f"{path} has comments but no line of names")
        return Header([])
    if first[0]["value"].startswith(POINTER):
        raise ValueError(f"{path} is a pointer to a file that was not fetched")
    names = first[0]["value"].split("\t")
    comments = [r["value"].lstrip("#").split("\t") for r in text.where(comment).limit(3).collect()]
    return Header(names, *(c if len(c) == len(names) else [] for c in [*comments, [], [], []][:3]))


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Fields of the data lines; the header's own line, wherever a part of the file has it, is left out."""
    text = lines(spark, path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    data = text.where(~F.col("value").startswith("#") & (F.col("value") != "") & (F.col("value") != "\t".join(names)))
    return data.select(F.split("value", "\t", -1).alias("f"))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many data lines have another number of fields than the header."""
    names = read_header(spark, path).names
    return _rows(spark, path, names).agg(F.count_if(F.size("f") != len(names)).alias("n_malformed"))


def read_tsv(spark: SparkSession, path: str, types: dict[str, str] | None = None, header: Header | None = None) -> DataFrame:
    """SRC-08, SRC-16: all columns are texts but those of ``types`` (SRC-17). Descriptions become column comments."""
    header = header or read_header(spark, path)
    names, types = unique_names(header.names), types or {}
    good = _rows(spark, path, header.names).where(F.size("f") == len(names))
    notes = dict(zip(names, header.descriptions)) if header.descriptions else {}
    columns = []
    for i, n in enumerate(names):
        c = typed(F.col("f")[i], types.get(n, "string"))
        columns.append(c.alias(n, metadata={"comment": notes[n]}) if notes.get(n, "").strip() else c.alias(n))
    return good.select(*columns)


def read_clinical(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: types and comments come from the lines before the names."""
    header = read_header(spark, path)
    kinds = {"NUMBER": "double", "BOOLEAN": "boolean"}
    types = {n: kinds.get(k.strip().upper(), "string") for n, k in zip(unique_names(header.names), header.kinds)}
    return read_tsv(spark, path, types, header)


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10."""
    return read_tsv(spark, path, dict.fromkeys(MUTATION_INTEGERS, "bigint"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11."""
    header = read_header(spark, path)
    return read_tsv(spark, path, {n: "bigint" for n in header.names if n.endswith(VARIANT_INTEGER_ENDS)}, header)


def read_copy_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, hugo_symbol, entrez_gene_id, cna_value), blank cells null (SRC-12)."""
    wide = read_tsv(spark, path)
    low = {c.strip().lower(): c for c in wide.columns}
    if "hugo_symbol" not in low:
        raise ValueError(f"{path} has no Hugo_Symbol column")
    hugo, entrez = low["hugo_symbol"], low.get("entrez_gene_id")
    samples = [c for c in wide.columns if c not in (hugo, entrez)]
    gene = wide.select(F.col(f"`{hugo}`").alias("hugo_symbol"), (F.col(f"`{entrez}`") if entrez else F.lit("")).alias("entrez_gene_id"), *(F.col(f"`{c}`") for c in samples))
    long = unpivot(gene, ["hugo_symbol", "entrez_gene_id"], samples, "sample_id", "cna_value")
    return long.select("sample_id", "hugo_symbol", "entrez_gene_id", F.nullif(F.trim("cna_value"), F.lit("")).alias("cna_value"))


def read_gene_panels(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, panel_id, assay) of the cells that are not blank (SRC-13)."""
    wide = read_tsv(spark, path)
    sample = next((c for c in wide.columns if c.strip().lower() in ("sample_id", "sample id")), wide.columns[0])
    long = unpivot(wide, [sample], [c for c in wide.columns if c != sample], "assay", "panel_id", keep_blanks=False)
    return long.select(F.col(f"`{sample}`").alias("sample_id"), F.trim("panel_id").alias("panel_id"), "assay")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14."""
    text = read_tsv(spark, path)
    names = [SEGMENT_NAMES.get(c.strip(), c.strip().replace(".", "_")) for c in text.columns]
    return text.toDF(*names).select(*(typed(F.col(n), SEGMENT_TYPES.get(n, "string")).alias(n) for n in names))


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15, SRC-16: of lab timelines the values are numbers."""
    header = read_header(spark, path)
    lab = LAB_COLUMNS <= {n.upper() for n in header.names}
    return read_tsv(spark, path, {n: "double" for n in header.names if lab and n.upper() == "VALUE"}, header)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: tab-separated, all texts, quotes are letters like others."""
    names = lines(spark, path).first()["value"].rstrip("\r").split("\t")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path, schema=schema)
    return rows.select(*(F.col(f"`{n}`") for n in names))  # without what the names of folders add


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-23: blank lines and those with # are left out."""
    text = lines(spark, path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return text.select(F.from_json("value", schema).alias("r")).select("r.*")


#: Types of declared tables, by the first word of the declaration.
DECLARED = {
    "integer": "int", "int": "int", "bigint": "bigint", "smallint": "smallint", "varchar": "string", "text": "string", "char": "string", "character": "string",
    "numeric": "double", "decimal": "double", "real": "double", "float": "double", "double": "double", "date": "date", "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp", "boolean": "boolean",
}
_NO_COLUMN = ("constraint", "primary", "foreign", "unique", "check")


def declared_tables(ddl: str) -> dict[str, T.StructType]:
    """Schemas of the CREATE TABLE statements of a script (SRC-19)."""
    out = {}
    for name, body in re.findall(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"@]+)\s*\((.*?)\)\s*;", ddl, re.IGNORECASE | re.DOTALL):
        parts, depth, at = [], 0, ""
        for ch in body + ",":
            depth += (ch == "(") - (ch == ")")
            if ch == "," and not depth:
                parts.append(at.strip())
                at = ""
            else:
                at += ch
        fields = []
        for p in parts:
            words = p.split()
            if len(words) < 2 or words[0].lower() in _NO_COLUMN:
                continue
            kind = re.match(r"\w+", words[1].lower())[0]
            kind = "timestamptz" if kind == "timestamp" and re.search(r"with\s+time\s+zone", p, re.IGNORECASE) else kind
            fields.append(T.StructField(words[0].strip('"'), T._parse_datatype_string(DECLARED.get(kind, "string"))))
        out[name.rpartition(".")[2].strip('"').lower()] = T.StructType(fields)
    return out


def empty_tables(spark: SparkSession, ddl: str) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in declared_tables(ddl).items()}


def field_comments(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: (table, column, comment) from a CSV file with these names, tables and columns in lower case; blank comments and repeats of a column are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = rows.select(F.lower(F.trim(rows[0])).alias("table"), F.lower(F.trim(rows[1])).alias("column"), F.trim(rows[2]).alias("comment"))
    return named.where("comment <> ''").groupBy("table", "column").agg(F.min("comment").alias("comment"))


def study_comments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """SRC-31: (table, column, comment) from the headers of a study's clinical files; no rows are read."""
    found = []
    for table, path in paths.items():
        header = read_header(spark, path)
        found += [(table, n, d) for n, d in zip(header.names, header.descriptions) if d.strip()]
    return spark.createDataFrame(found, "table string, column string, comment string")
