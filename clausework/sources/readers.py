"""Readers of contract texts and data sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import text


def read_texts(spark: SparkSession, path: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """contract_id (from the content), path and text of UTF-8 files; undecodable bytes are left out."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    d = d.orderBy("path").limit(limit) if limit is not None else d

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"contract_id": pdf["id"], "path": pdf["path"], "text": [bytes(b).decode("utf-8", "ignore") for b in pdf["content"]]})

    return d.select(F.substring(F.sha2("content", 256), 1, 8).alias("id"), "path", "content").mapInPandas(run, "contract_id string, path string, text string")


PAGE = "array<struct<text:string,width:double,height:double>>"


def form_feed_pages(content: bytes) -> dict:
    """Pages of a text file, which form feeds divide; they have no size. Undecodable bytes are left out."""
    return {"metadata": {"encoding": "utf-8"}, "pages": [{"text": x, "width": None, "height": None} for x in content.decode("utf-8", "ignore").split("\f")]}


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], dict] = form_feed_pages, pattern: str = "*") -> DataFrame:
    """path, page_number (from 1), total_pages, width, height, text, metadata and error of every page of every file.

    ``parse`` turns a file's bytes into ``{"metadata": {name: value}, "pages": [{"text", "width", "height"}]}``; a library for a format such as PDF is the
    caller's. A file that it fails on has one row with the error and no page; a file without pages has one row with neither. Files
    without content are passed over, as Spark's file sources do.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pages, metadata, errors = [], [], []
            for b in pdf["content"]:
                try:
                    read = parse(bytes(b))
                    sized = [{k: p.get(k) if k == "text" or p.get(k) is None else float(p[k]) for k in ("text", "width", "height")} for p in read.get("pages") or ()]
                    about, error = {str(k): None if v is None else str(v) for k, v in (read.get("metadata") or {}).items()}, None
                except Exception as e:  # noqa: BLE001  a bad file must not end the job
                    sized, about, error = [], {}, f"{type(e).__name__}: {e}"
                pages.append(sized)
                metadata.append(about)
                errors.append(error)
            yield pd.DataFrame({"path": pdf["path"], "pages": pages, "metadata": metadata, "error": errors})

    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    d = d.mapInPandas(run, f"path string, pages {PAGE}, metadata map<string,string>, error string").withColumn("total_pages", F.size("pages"))
    d = d.select("path", "total_pages", "metadata", "error", F.posexplode_outer("pages").alias("at", "page"))
    return d.select("path", (F.col("at") + 1).alias("page_number"), "total_pages", "page.width", "page.height", F.coalesce("page.text", F.when(F.col("at").isNotNull(), "")).alias("text"), "metadata", "error")


def whole_documents(pages: DataFrame) -> DataFrame:
    """path, text (pages with text, a blank line between), total_pages, metadata and error of every file."""
    said = F.col("page_number").isNotNull() & (F.col("text") != "")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(said, F.struct("page_number", "text")))), lambda x: x["text"]), "\n\n")
    return pages.groupBy("path").agg(texts.alias("text"), F.max("total_pages").alias("total_pages"), F.any_value("metadata").alias("metadata"), F.max("error").alias("error"))


def read_paged(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """path, pages (page_number and text), total_pages, text and error of every file, by a parser that gives its pages' texts."""
    pages = read_pages(spark, path, lambda b: {"pages": [{"text": x} for x in parse(b)]}, pattern)
    item = F.when(F.col("page_number").isNotNull(), F.struct("page_number", "text"))
    lists = pages.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("pages"))
    return lists.join(whole_documents(pages), "path").select("path", "pages", "total_pages", "text", "error")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, category string, contract_id string").json(path)


def read_question_answers(spark: SparkSession, path: str, least: int = 21) -> DataFrame:
    """contract_id, question, answer from nested question-answer JSON; short answers are dropped."""
    schema = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<question:string,answers:array<struct<text:string>>>>>>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("c"))
    d = d.select(F.col("c.title").alias("contract_id"), F.explode(F.col("c.paragraphs")[0]["qas"]).alias("q"))
    d = d.select("contract_id", "q.question", F.explode("q.answers").alias("a")).select("contract_id", "question", text.strip(F.col("a.text")).alias("answer"))
    return d.where(F.char_length("answer") >= least)


def flatten_clauses(contracts: DataFrame) -> DataFrame:
    """text, category and contract_id of every clause of contracts with a list of clauses; contracts without any are left out."""
    return contracts.select(F.explode("clauses").alias("c")).select("c.text", "c.category", "c.contract_id")


def of_type(contracts: DataFrame, word: str = "NDA", column: str = "contract_type") -> DataFrame:
    return contracts.where(F.contains(F.col(column), F.lit(word)))


def read_calibration(spark: SparkSession, path: str | None) -> tuple[float, float]:
    """Platt parameters from JSON, or the defaults."""
    from clausework.functions import dims

    if path is not None:
        row = spark.read.schema("A double, B double").json(path).first()
        if row is not None and row.A is not None and row.B is not None:
            return row.A, row.B
    return dims.PLATT_A, dims.PLATT_B
