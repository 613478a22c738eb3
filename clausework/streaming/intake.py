"""Contracts that arrive as files: taken in once each by content, or set aside with a reason, then listed with their analysis.

Files of other kinds than ``SUFFIXES`` and those that cannot be read are dead letters; files without content are passed over, as Spark's file
sources do. A contract's id comes from its content, so a file that is
sent again, under whatever name, is the same contract. Intake is a stream: a restart goes on from its checkpoint, and a batch that was
cut short is written again to the same keys.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausework.sources.keyed import KeyedTable
from clausework.sources.readers import form_feed_pages

SUFFIXES = (".pdf", ".txt", ".md")  # fixed values
CONTRACT = "contract_id string, filename string, size long, received timestamp, text string, status string"
LETTER = "path string, reason string, size long"


class EmptyRequestError(ValueError):
    """A deletion that names no contract, or finds none."""


class Portfolio:
    """Contracts and dead letters under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.contracts = KeyedTable(spark, f"{path}/contracts", ["contract_id"], CONTRACT, buckets)
        self.letters = KeyedTable(spark, f"{path}/letters", ["path"], LETTER, buckets)

    def take_in(self, folder: str, checkpoint: str, parse: Callable[[bytes], dict] | None = None, per_batch: int = 1000, remember: str = "1 day") -> StreamingQuery:
        """Read the files that ``folder`` has now and the checkpoint does not know. ``parse`` reads PDF files' pages; without it they are dead letters.

        Repeated contents within ``remember`` of each other's arrival are dropped in the stream, later ones by their key.
        """
        schema = "path string, modificationTime timestamp, length long, content binary"
        files = self.spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).load(folder)
        named = files.withColumn("contract_id", F.substring(F.sha2("content", 256), 1, 16))
        once = named.withWatermark("modificationTime", remember).dropDuplicatesWithinWatermark(["contract_id", "path"])

        def each(batch: DataFrame, _: int) -> None:
            batch = batch.persist()
            try:
                judged = judge(batch, parse)
                self.contracts.upsert(judged.where("reason IS NULL").withColumn("status", F.lit("uploaded")), "received")
                self.letters.upsert(judged.where("reason IS NOT NULL"), "received")
            finally:
                batch.unpersist()

        return once.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def listing(self, clauses: DataFrame, scores: DataFrame) -> DataFrame:
        """contract_id, filename, status, total_clauses, labels_found, score and level of every contract, analysed or not.

        ``clauses`` has contract_id and label for each clause found, ``scores`` contract_id, score and level.
        """
        found = clauses.groupBy("contract_id").agg(F.count("*").alias("total_clauses"), F.count_distinct("label").alias("labels_found"))
        d = self.contracts.read().select("contract_id", "filename", "status").join(found, "contract_id", "left").join(scores.select("contract_id", "score", "level"), "contract_id", "left")
        status = F.when(F.col("score").isNotNull(), F.lit("analyzed")).otherwise(F.col("status"))
        return d.select("contract_id", "filename", status.alias("status"), F.coalesce("total_clauses", F.lit(0)).alias("total_clauses"), F.coalesce("labels_found", F.lit(0)).alias("labels_found"), "score", "level")

    def delete(self, ids: list[str] | DataFrame | None = None, everything: bool = False) -> int:
        """Remove contracts by id, or all; gives how many there were. A request that names none is an error, and so is removing all of nothing."""
        if everything:
            gone = self.contracts.read().select("contract_id")
        elif isinstance(ids, DataFrame):
            gone = ids.select("contract_id")
        elif ids:
            gone = self.spark.createDataFrame([(i,) for i in ids], "contract_id string")
        else:
            raise EmptyRequestError("name contracts, or ask for all")
        n = self.contracts.find(gone).count()
        if everything and not n:
            raise EmptyRequestError("there are no contracts")
        if n:
            self.contracts.delete(gone)
        return n


def judge(files: DataFrame, parse: Callable[[bytes], dict] | None = None) -> DataFrame:
    """Files with filename, size, received, text, and the reason why one is set aside, null for those that are taken."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    d = files.select("contract_id", "path", F.col("modificationTime").alias("received"), F.col("length").alias("size"), "content", name.alias("filename"), suffix.alias("suffix"))

    @F.pandas_udf("text string, error string")
    def read(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for b, k in zip(content, kind, strict=True):
            try:
                if k == ".pdf" and parse is None:
                    raise ValueError("no parser of pages was given")
                pages = (parse if k == ".pdf" else form_feed_pages)(bytes(b))["pages"]
                texts.append("\n\n".join(p["text"] for p in pages if p.get("text")))
                errors.append(None)
            except Exception as e:  # noqa: BLE001  a bad file must not end the stream
                texts.append(None)
                errors.append(f"cannot be read: {e}")
        return pd.DataFrame({"text": texts, "error": errors})

    wanted = F.col("suffix").isin(*SUFFIXES)
    d = d.withColumn("read", F.when(wanted, read(F.when(wanted, F.col("content")).otherwise(F.lit(b"")), F.col("suffix"))))
    reason = F.when(~F.col("suffix").isin(*SUFFIXES), F.concat(F.lit("unsupported kind of file: "), "suffix")).otherwise(F.col("read.error"))
    return d.select("contract_id", "path", "received", "size", "filename", F.col("read.text").alias("text"), reason.alias("reason"))
