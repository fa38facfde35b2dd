"""One query for each operator of this subpackage, over the whole of its table, and the SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.llm import (
    arc_to_warc,
    bottom_k,
    exact_dedup,
    host_reputation,
    jaccard_join,
    marked_words,
    merge_automaton,
    phrase_mining,
    source_mixing,
    token_alignment,
    token_records,
    tool_calls,
    toxicity,
)
from paracorpus.llm.common import checkpoint_dir, crc_fold, table

TOKENIZER = "word_bpe_49k.json"
PIECES, BYTE_LEVEL = "piece_bpe_32k.model", "byte_bpe_50k.json"
END_ID = 1
FOLDS = 5
FOLD = f"coalesce(crc32(cast(cast(doc_id as string) as binary)) % {FOLDS}, 0)"
# Fixed values of the contract: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The tools that the turns of a conversation stand for.
TOOLS = {
    "search": {"limit": ("integer", True), "query": ("string", True)},
    "summarise": {"query": ("string", True), "words": ("integer", False)},
}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def turn_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from chat turns: a user's turn calls a tool with its text as the query, the
    turn after it is the result, and a call uses the result of the user's turn two places before."""
    turn = F.col("turn")
    call_id = F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    name = F.when(turn % 4 < 2, "search").when(turn % 8 < 6, "summarise").otherwise("translate")
    query = tool_calls.json_string(F.col("text"))
    # Keys are not in order and there is white space, as callers write them; one in five has no limit.
    limit = F.when(F.length("text") % 5 > 0, F.concat(F.lit(', "limit": '), (F.length("text") % 7).cast("string"))).otherwise("")
    calls = turns.where("role = 'user'").select(
        "conv_id", call_id.alias("call_id"), "turn", name.alias("name"),
        F.concat(F.lit('{ "query": '), query, limit, F.lit(" }")).alias("arguments"),
        F.concat_ws("-", F.col("conv_id").cast("string"), (turn - 2).cast("string")).alias("parent_id"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", F.concat_ws("-", F.col("conv_id").cast("string"), (turn - 1).cast("string")).alias("call_id"),
        "turn", F.col("text").alias("content"),
    )
    return calls, results


def op1_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = turn_calls(table(spark, folder, "conversations"))
    return tool_calls.link_tool_calls(calls, results, TOOLS)


def op2_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    legacy = arc_to_warc.write_arc(pages, "page_id", "url", "html")
    arc_to_warc.write_warc(arc_to_warc.convert(legacy), path)
    return arc_to_warc.describe_records(arc_to_warc.read_warc(spark, path, payloads=False))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents", "doc_id", "text"))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, folder, "documents", "doc_id", "text", "source"))


def op5_token_records(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_records.write_token_records(table(spark, folder, "documents", "doc_id", "text"), path, tokenizer_path(), END_ID)
    return token_records.describe_token_records(spark, path)


def page_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, good: a page shows the document whose number ends its path; it is good if that
    document's labels say good quality and not toxic."""
    number = F.regexp_extract(host_reputation.url_path(F.col("url")), r"^/[a-z]+/([0-9]{1,18})", 1)
    numbered = table(spark, folder, "pages", "page_id", "url").select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")
    return numbered.join(table(spark, folder, "labels").select("doc_id", good), "doc_id").select("page_id", "good")


def op6_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url")
    return host_reputation.judge_urls(pages, page_outcomes(spark, folder), RULES)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    models, scale = toxicity.fit_toxicity(docs, table(spark, folder, "labels"), FOLD)
    scored = toxicity.score_toxicity(docs, models, scale)
    return scored.select("doc_id", (crc_fold(folds=FOLDS) == 0).alias("held_out"), "score", "predicted")


def op8_merge_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return merge_automaton.encode_digests(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path())


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents", "doc_id", "text"))


def op10_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return bottom_k.fingerprint_edits(table(spark, folder, "documents", "doc_id", "text"))


def op11_marked_words(spark: SparkSession, folder: str) -> DataFrame:
    return marked_words.encode_digests(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path(PIECES))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, folder, "documents", "text", "lang"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return token_alignment.align_tokens(docs, tokenizer_path(BYTE_LEVEL), tokenizer_path(PIECES))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


REGISTRY = {
    f.__name__: f
    for f in (
        op1_tool_calls, op2_arc_to_warc, op3_exact_dedup, op4_source_mix, op5_token_records,
        op6_host_reputation, op7_toxicity, op8_merge_automaton, op9_jaccard_join, op10_bottom_k, op11_marked_words,
        op12_collocations, op13_token_alignment, pipeline,
    )
}
