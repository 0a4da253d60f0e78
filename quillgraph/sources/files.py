"""File sources: text, PDF, DOCX and JSON corpora as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import text as tx
from quillgraph.operators import evaluation

DOCUMENT = "doc_id string, title string, text string, ord int, path string"
STATUTE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "title", "source_type", "content", "law_name", "chapter", "article_no")]
)
CASE = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "doc_id", "title", "source_type", "content", "case_id", "court", "case_type", "dispute_focus", "judgment"
        )
    ]
)
FAQ = T.StructType([T.StructField(n, T.StringType()) for n in ("faq_id", "question", "answer", "source_type", "topic")])
KB_LAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "law_name", "article_no", "chapter", "effective_date", "text")]
    + [T.StructField("keywords", T.ArrayType(T.StringType()))]
)
KB_CASE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("case_id", "case_type", "court", "facts", "holding")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("issues", "cited_laws", "keywords")]
)
KB_FAQ = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("question", "answer", "topic")]
    + [T.StructField("related_laws", T.ArrayType(T.StringType()))]
)
BENCHMARK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("category", "query", "question_type", "source_type", "expected_retrieval_strategy")],
        T.StructField("requires_multiturn", T.BooleanType()),
        *[
            T.StructField(n, T.ArrayType(T.StringType()))
            for n in ("expected_entities", "expected_evidence_paths", "expected_answer_keywords", "expected_evidence_ids")
        ],
    ]
)


def _has_files(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern matches anything on its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, "([^/]+)$", 1))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


# --- one file, one document -----------------------------------------------------------
def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files; a byte order mark stays in the text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pdf_text(content: bytes) -> str:
    """Stripped page texts joined by newlines (needs a PDF library on the executors)."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        pages = [(page.extract_text() or "").strip() for page in pdf.pages]
    return "\n".join(p for p in pages if p).strip()


def docx_text(content: bytes) -> str:
    """Stripped paragraph texts joined by newlines."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{space}body")
    lines = []
    for paragraph in body.findall(f"{space}p"):
        text = "".join(
            node.text or "" if node.tag == f"{space}t" else "\t" if node.tag == f"{space}tab" else "\n"
            for node in paragraph.iter()
            if node.tag in (f"{space}t", f"{space}tab", f"{space}br")
        ).strip()
        if text:
            lines.append(text)
    return "\n".join(lines).strip()


def read_binary(spark: SparkSession, path: str, parse: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of binary documents, parsed file by file inside the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [parse(c) for c in batch["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


READERS = {
    "txt": read_text,
    "pdf": lambda spark, path: read_binary(spark, path, pdf_text),
    "docx": lambda spark, path: read_binary(spark, path, docx_text),
}


def _named(df: DataFrame, position: int) -> DataFrame:
    name = _file_name(F.col("path"))
    return df.select(
        _stem(name).alias("doc_id"), name.alias("title"), F.col("text"), F.lit(position).alias("ord"), "path"
    )


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """One document by suffix; an unknown suffix is an error."""
    suffix = re.sub(r"^.*\.", "", path).lower()
    if suffix not in READERS:
        raise ValueError(f"Unsupported file type: .{suffix}")
    return _named(READERS[suffix](spark, path), 0)


def load_documents(spark: SparkSession, directory: str) -> DataFrame:
    """All txt, pdf and docx documents of a directory with non-blank text.

    Order is (``ord``, ``path``): format first, then path.
    """
    out = spark.createDataFrame([], DOCUMENT)
    for position, (suffix, reader) in enumerate(READERS.items()):
        pattern = f"{directory.rstrip('/')}/*.{suffix}"
        if _has_files(spark, pattern):
            out = out.unionByName(_named(reader(spark, pattern), position))
    return out.filter(tx.strip(F.col("text")) != "")


# --- records ---------------------------------------------------------------------------
def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSONL or JSON (array or object) rows; malformed lines and non-objects are dropped."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("encoding", "UTF-8")
    if path.lower().endswith(".jsonl"):
        return reader.json(path)
    return reader.option("multiLine", True).json(path)


def load_raw_items(spark: SparkSession, directory: str, phase: str, schema: T.StructType) -> DataFrame:
    """Rows of ``*_{phase}.json*`` files, else of all JSON files; empty without any."""
    base = directory.rstrip("/")
    chosen = next(
        (
            stem
            for stem in (f"{base}/*_{phase}", f"{base}/*")
            if _has_files(spark, f"{stem}.jsonl") or _has_files(spark, f"{stem}.json")
        ),
        None,
    )
    out = spark.createDataFrame([], schema)
    for suffix in ("json", "jsonl"):
        if chosen and _has_files(spark, f"{chosen}.{suffix}"):
            out = out.unionByName(read_records(spark, f"{chosen}.{suffix}", schema))
    return out


def load_benchmark(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """Benchmark questions from a JSON array or an object with ``examples``."""
    wrapped = T.StructType([T.StructField("examples", T.ArrayType(BENCHMARK)), *BENCHMARK.fields])
    rows = spark.read.schema(wrapped).option("multiLine", True).json(path)
    names = [f.name for f in BENCHMARK.fields]
    flat = rows.filter("examples IS NULL").select(*names).unionByName(
        rows.filter("examples IS NOT NULL").select(F.explode("examples").alias("e")).select("e.*")
    )
    return evaluation.normalize_benchmark(flat) if normalize else flat


def load_status(spark: SparkSession, path: str) -> DataFrame:
    """(suggestion_id, status) from a JSON object; an absent file is an empty table."""
    from quillgraph.functions import rules

    if not _has_files(spark, path):
        return spark.createDataFrame([], "suggestion_id string, status string")
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return text.select(F.explode("m").alias("suggestion_id", "status")).withColumn("status", rules.status(F.col("status")))
