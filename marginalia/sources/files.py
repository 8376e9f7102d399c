"""Policy files on storage: contract, manifest, Markdown and DOCX text, rejects."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from marginalia.functions.text import heading_level, markdown_lines

#: "<anything> - <policy> v<version>.<suffix>"
CONTRACT = r"^.* - (.+) v([0-9]+(?:\.[0-9]+)*)\.(?:pdf|docx|md)$"
MANIFEST = "map<string,struct<department:string,doc_type:string,classification:string,status:string,effective_from:string>>"
DEFAULTS = {"department": "general", "doc_type": "policy", "classification": "internal", "status": "active", "effective_from": ""}
CLASSIFICATIONS, STATUSES = ("public", "internal", "top-secret"), ("active", "retired")
#: Fixed value: the name space of the XML in a DOCX file.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_name(path: Column) -> Column:
    """The last part of a path, with its escapes undone."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def _paragraph(p: ElementTree.Element) -> str:
    """A paragraph's text, with tabs and line breaks."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter())


@F.pandas_udf(StructType().add("lines", ArrayType(StringType())).add("reject", StringType()))
def docx_lines(content: pd.Series) -> pd.DataFrame:
    """The paragraphs of DOCX files, those in tables too; null for null."""

    def read(raw: bytes | None) -> tuple[list[str] | None, str | None]:
        if raw is None:
            return None, None
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, OSError, ValueError) as broken:
            return None, f"broken file: {type(broken).__name__}"
        return [line for p in body.iter(f"{_W}p") for line in _paragraph(p).split("\n")], None

    return pd.DataFrame([read(raw) for raw in content], columns=["lines", "reject"])


def with_lines(files: DataFrame) -> DataFrame:
    """files (file, content) with lines, or with a reject that says why there are none: unsupported format, broken file or empty text."""
    suffix = F.lower(F.substring_index("file", ".", -1))
    docx = docx_lines(F.when(suffix == "docx", F.col("content")))
    text = F.col("content").cast("string")
    rows = files.withColumns({"__suffix": suffix, "__docx": docx, "__utf8": F.coalesce(F.is_valid_utf8(text), F.lit(False))})
    lines = F.when(F.col("__suffix") == "docx", F.col("__docx.lines")).when((F.col("__suffix") == "md") & F.col("__utf8"), markdown_lines(text))
    empty = ~F.coalesce(F.exists("lines", lambda x: F.trim(x) != ""), F.lit(False))
    reject = (
        F.when(~F.col("__suffix").isin("md", "docx"), F.concat(F.lit("unsupported format: "), F.col("__suffix"))).when(F.col("__docx.reject").isNotNull(), F.col("__docx.reject"))
        .when((F.col("__suffix") == "md") & ~F.col("__utf8"), "broken file: not UTF-8").when(empty, "empty text")
    )
    return rows.withColumn("lines", lines).withColumn("reject", reject).drop("__suffix", "__docx", "__utf8")


def policy_files(spark: SparkSession, directory: str, strategy: str = "structural") -> DataFrame:
    """Files that follow the contract: path, file, policy, version, file_hash, lines, reject (null where the file can be read).

    Spark lists no files of zero bytes, so such a file counts as none.
    """
    raw = spark.read.format("binaryFile").load(directory).withColumn("file", file_name(F.col("path"))).where(F.col("file").rlike(CONTRACT))
    digest = F.sha2(F.concat(F.encode(F.lit(strategy), "utf-8"), F.unhex(F.lit("00")), "content"), 256)
    return with_lines(raw).select("path", "file", F.regexp_extract("file", CONTRACT, 1).alias("policy"), F.regexp_extract("file", CONTRACT, 2).alias("version"), digest.alias("file_hash"), "lines", "reject")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's rows, by file."""
    text = spark.read.text(path, wholetext=True)
    whole = F.coalesce(F.get_json_object("value", "$.documents"), F.col("value"))
    return text.select(F.explode(F.from_json(whole, MANIFEST)).alias("file", "entry")).select("file", "entry.*")


def title_lines(lines: Column) -> Column:
    """Lines before the first heading, squeezed, blank ones left out."""
    squeezed = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    first = F.array_position(F.transform(squeezed, lambda x: heading_level(x).isNotNull()), True)
    return F.when(first > 0, F.slice(squeezed, F.lit(1), (first - 1).cast("int"))).otherwise(squeezed)


def with_manifest(files: DataFrame, entries: DataFrame) -> DataFrame:
    """files with their manifest fields, defaults where missing, and top-secret where a title says so.

    What the manifest itself says of a file stays in the struct ``given``, and ``problem`` names a field that has no valid value.
    """
    names = list(DEFAULTS)
    joined = files.join(entries.select("file", F.struct(*names).alias("given")), "file", "left")
    banner = F.coalesce(F.exists(title_lines(F.col("lines")), lambda x: F.upper(x).rlike("TOP[ -]SECRET")), F.lit(False))
    fields = {k: F.coalesce(F.col(f"given.{k}"), F.lit(v)) for k, v in DEFAULTS.items()}
    fields["classification"] = F.when(banner, "top-secret").otherwise(fields["classification"])
    bad = lambda name, ok: F.when(~ok, F.concat(F.lit(f"bad {name}: "), F.col(name)))
    day = F.col("effective_from")
    return joined.withColumns(fields).withColumn(
        "problem", F.coalesce(bad("classification", F.col("classification").isin(*CLASSIFICATIONS)), bad("status", F.col("status").isin(*STATUSES)), bad("effective_from", (day == "") | (day.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date(day).isNotNull())))
    )
