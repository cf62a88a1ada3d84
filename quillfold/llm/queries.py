"""The operators as registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm import bpe, ivfpq, jaccard, langid, lines, merkle, mixing, mtree, packing, prefix_trie, repeats, toolcalls, toxicity
from quillfold.llm.common import table


def public_ranks() -> tuple[bytes, str]:
    """The rank file and the split pattern of the installed public vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_ranks()
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern, digests=True)


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_inner_products(table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op5_ivfpq_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.nearest(table(spark, sf_dir, "embeddings"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op7_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_ranks()
    return packing.pack_documents(table(spark, sf_dir, "documents"), ranks, pattern)


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.dialogue_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.link_calls(calls, results, {"reply": toolcalls.REPLY})


def op10_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_documents(docs, langid.fit(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_toxicity_nnpu": op1_toxicity_nnpu,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_ivfpq_ann": op5_ivfpq_ann,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op10_rank_order_langid": op10_rank_order_langid,
    "op7_bfd_packing": op7_bfd_packing,
    "op9_tool_calls": op9_tool_calls,
    "op8_byte_bpe": op8_byte_bpe,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op6_poisson_mixing": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_line_dedup": lines.ORACLE,
}
