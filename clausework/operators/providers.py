"""Steps done by outside models, as joins with a table of replies, so that reruns give the same rows.

A reply table has prompt_key and reply. A row without reply takes the path without a model. ``compute_missing`` fills the
table with any batch function; nothing here calls a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import dims, text

ENTITY = "array<struct<name:string,type:string,confidence:string>>"
RELATION = "array<struct<subject:string,predicate:string,object:string,confidence:string>>"
REPLY = f"struct<entities:{ENTITY},relationships:{RELATION},extracted_values:array<struct<field:string,value:string,confidence:double>>>"
# fixed values: questions that are suggested
SUGGESTED_QUESTIONS = [
    "Who are the parties to this contract?",
    "What IP rights are licensed?",
    "What are the key obligations of each party?",
    "What restrictions apply to the parties?",
    "What are the liability caps and limitations?",
    "What is the governing law?",
    "What are the key dates and deadlines?",
    "What are the termination conditions?",
    "Are there any non-compete provisions?",
    "What warranties are provided?",
]
# fixed values: questions that are asked by name, and aspects of a comparison
CANNED_QUESTIONS = {
    "licensing": "What are the licensing terms and IP rights granted?",
    "obligations": "What are the key obligations of each party?",
    "restrictions": "What restrictions or limitations apply?",
    "liability": "What are the liability provisions and caps?",
    "termination": "What are the termination conditions and notice requirements?",
    "governing_law": "What is the governing law and jurisdiction?",
}
PARTY_QUESTION = "What are the obligations of %s?"
COMPARE_QUESTIONS = {
    "licensing": "Compare the licensing terms across contracts",
    "obligations": "Compare the obligations across contracts",
    "restrictions": "Compare the restrictions across contracts",
    "liability": "Compare the liability provisions across contracts",
    "all": "Compare the key terms across contracts including licensing, obligations, restrictions, and liability",
}


def canned_question(name: Column, party: Column) -> Column:
    """The question of that name; obligations may be asked of one party. Unknown names give null."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in CANNED_QUESTIONS.items() for x in kv]), name)
    return F.when((name == "obligations") & (F.coalesce(party, F.lit("")) != ""), F.format_string(PARTY_QUESTION, party)).otherwise(known)


def compare_question(aspect: Column) -> Column:
    """The question that compares contracts on an aspect; an unknown one asks for all."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COMPARE_QUESTIONS.items() for x in kv]), aspect), F.lit(COMPARE_QUESTIONS["all"]))


def extracted(contracts: DataFrame, replies: DataFrame, model: str = "none") -> tuple[DataFrame, DataFrame]:
    """Entities (the first of equal name and type) and triples of a contract's chunks, from replies to their prompts."""
    from pyspark.sql import Window

    chunks = contracts.select("contract_id", F.posexplode(text.chunks("text")).alias("chunk", "text"))
    parsed = with_reply(chunks, replies, prompt_key(model, F.col("text"))).where("reply IS NOT NULL").withColumn("parsed", parse(F.col("reply")))
    found = parsed.select("contract_id", "chunk", F.posexplode("parsed.entities").alias("at", "e"))
    order = found.withColumn("ord", F.row_number().over(Window.partitionBy("contract_id").orderBy("chunk", "at")))
    entities = parsed_entities(order.groupBy("contract_id").agg(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "e"))), lambda x: x["e"]).alias("entities")).alias("parsed")))
    w = Window.partitionBy("contract_id", text.normalize_name(F.col("name")), "type").orderBy("ord")
    entities = entities.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return entities, parsed_triples(parsed)


def suggested(spark: SparkSession) -> DataFrame:
    """query_id (from 1) and text of the suggested questions, ready to be searched for."""
    return spark.createDataFrame(list(enumerate(SUGGESTED_QUESTIONS, 1)), "query_id long, text string")


CLAUSE_REPLY = "struct<values:array<struct<field:string,value:string,confidence:double>>,entities:array<string>,relationships:array<struct<subject:string,predicate:string,object:string>>>"
VALUE_CONFIDENCE, EXTRACT_LEAST = 0.5, 0.45  # fixed values


def extraction_prompts(clauses: DataFrame, least: float = EXTRACT_LEAST) -> DataFrame:
    """Clauses that are confident enough to be extracted, with the prompt that asks for what a clause of their label holds."""
    tasks = F.broadcast(dims.dim(clauses.sparkSession, "dim_task"))
    task = F.coalesce("task", F.concat(F.lit("Extract: key terms, values, entities, and obligations related to "), "label"))
    prompt = F.concat(F.lit('Clause labeled "'), "label", F.lit('":\n'), F.coalesce("text", F.lit("")), F.lit("\n\n"), task)
    return clauses.where(F.col("confidence") >= least).join(tasks, "label", "left").withColumn("prompt", prompt).drop("task")


def clause_extractions(clauses: DataFrame, replies: DataFrame, model: str = "none", least: float = EXTRACT_LEAST) -> DataFrame:
    """Confident clauses with values, entities and relationships from the replies to their prompts; without a reply, or with one that is no JSON, all are empty."""
    d = with_reply(extraction_prompts(clauses, least), replies, prompt_key(model, F.col("prompt"))).drop("prompt", "prompt_key")
    d = d.withColumn("parsed", F.from_json(text.fenced_json(F.col("reply")), CLAUSE_REPLY)).drop("reply")
    empty = lambda c: F.coalesce(f"parsed.{c}", F.from_json(F.lit("[]"), _part(c)))
    values = F.transform(empty("values"), lambda v: F.struct(F.coalesce(v["field"], F.lit("")).alias("field"), F.coalesce(v["value"], F.lit("")).alias("value"), F.coalesce(v["confidence"], F.lit(VALUE_CONFIDENCE)).alias("confidence")))
    return d.select("*", values.alias("values"), empty("entities").alias("entities"), empty("relationships").alias("relationships")).drop("parsed")


def _part(name: str) -> str:
    return {"values": "array<struct<field:string,value:string,confidence:double>>", "entities": "array<string>", "relationships": "array<struct<subject:string,predicate:string,object:string>>"}[name]


def extracted_values(extractions: DataFrame) -> DataFrame:
    """contract_id, clause_index, label, at, field, value, confidence: a row for each value, ready for ``key_findings``."""
    d = extractions.select("contract_id", "clause_index", "label", F.posexplode("values").alias("at", "v"))
    return d.select("contract_id", "clause_index", "label", "at", "v.field", "v.value", "v.confidence")


def prompt_key(model: str, prompt: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{model}:"), prompt))


def with_reply(rows: DataFrame, replies: DataFrame, key: Column) -> DataFrame:
    return rows.withColumn("prompt_key", key).join(replies.select("prompt_key", "reply"), "prompt_key", "left")


def compute_missing(rows: DataFrame, replies: DataFrame, key: Column, prompt: Column, batch: Callable[[list[str]], list[str]]) -> DataFrame:
    """Replies for prompts that the table lacks, each distinct prompt once."""
    todo = rows.select(key.alias("prompt_key"), prompt.alias("prompt")).dropDuplicates(["prompt_key"]).join(replies, "prompt_key", "left_anti")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"prompt_key": pdf["prompt_key"], "reply": batch(pdf["prompt"].tolist())})

    return todo.mapInPandas(run, "prompt_key string, reply string")


def parse(reply: Column) -> Column:
    """The reply's JSON, or null; malformed parts are null."""
    return F.from_json(text.fenced_json(reply), REPLY)


def parsed_entities(parsed: DataFrame) -> DataFrame:
    """Named entities with mapped types and confidences; rows with a confidence outside [0, 1] are dropped."""
    d = parsed.select("contract_id", F.posexplode("parsed.entities").alias("ord", "e")).where(F.coalesce(F.col("e.name"), F.lit("")) != "")
    d = d.select("contract_id", "ord", "e.name", text.entity_type(F.coalesce("e.type", F.lit(""))).alias("type"), text.confidence(F.col("e.confidence")).alias("confidence"))
    return d.where(F.col("confidence").between(0, 1))


def parsed_triples(parsed: DataFrame) -> DataFrame:
    d = parsed.select("contract_id", F.posexplode("parsed.relationships").alias("ord", "r")).select("contract_id", "ord", "r.subject", "r.predicate", "r.object", text.confidence(F.col("r.confidence")).alias("confidence"))
    return d.where("subject <> '' AND predicate <> '' AND object <> '' AND confidence BETWEEN 0 AND 1")


def key_findings(values: DataFrame, least: float = 0.7, first: int = 20) -> DataFrame:
    """Confident extracted values of each contract, the first in clause order."""
    from pyspark.sql import Window

    w = Window.partitionBy("contract_id").orderBy("clause_index", "field")
    return values.where(F.col("confidence") >= least).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first).drop("rn")


def answers(questions: DataFrame, cache: DataFrame, replies: DataFrame, contexts: DataFrame, model: str = "none") -> DataFrame:
    """Cached answers, else answers parsed from replies, else a notice with confidence 0."""
    d = questions.join(cache.select("query_id", F.col("answer").alias("cached"), F.col("confidence").alias("cached_confidence")), "query_id", "left").join(contexts, "query_id", "left")
    d = with_reply(d, replies, prompt_key(model, F.concat_ws("\n", "text", "context")))
    own = text.answer_envelope(F.col("reply"))
    return d.select("query_id", F.coalesce("cached", own["answer"], F.lit("No answer is available.")).alias("answer"), F.coalesce("cached_confidence", F.when(F.col("reply").isNotNull(), own["confidence"]), F.lit(0.0)).alias("confidence"))
