"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, jaccard, maxent, mixing, passages, phrases, pieces, quality, rules, simhash, trie, warc


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: _table(s, d, "documents")
    return {
        "op1_lm_scoring": lambda s, d: maxent.op1(docs(s, d)),
        "op2_jaccard_join": lambda s, d: jaccard.op2(docs(s, d)),
        "op3_quality_rules": lambda s, d: rules.op3(docs(s, d)),
        "op4_mix_sources": lambda s, d: mixing.op4(docs(s, d)),
        "op5_phrase_fingerprint": lambda s, d: phrases.op5(docs(s, d)),
        "op6_chat_format": lambda s, d: chat.op6(_table(s, d, "conversations")),
        "op7_warc_salvage": lambda s, d: warc.op7(_table(s, d, "pages")),
        "op8_sentencepiece": lambda s, d: pieces.digest_documents(docs(s, d), tokenizer_file()),
        "op9_quality_classifier": lambda s, d: quality.op9(docs(s, d), _table(s, d, "labels")),
        "op10_substring_dedup": lambda s, d: passages.op10(docs(s, d)),
        "op11_collocations": lambda s, d: collocations.op11(docs(s, d)),
        "op12_simhash": lambda s, d: simhash.op12(docs(s, d)),
        "op13_prefix_trie": lambda s, d: trie.op13(_table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": chat.ORACLE, "op11_collocations": collocations.ORACLE, "op13_prefix_trie": trie.ORACLE}
