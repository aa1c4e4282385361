"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from surveyloom.llm import compression, decontaminate, lexical, line_dedup, ngram_join, packing, quality_rules, simhash, spelling, suffix_dedup, token_counts, token_files, warc
from surveyloom.llm.common import work_folder
from surveyloom.llm.registry import query, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_token_files")
def op1_token_files(spark, folder):
    docs = table(spark, folder, "documents")
    out = work_folder(spark, "op1")
    manifest = token_files.write_token_files(docs, out, WORDS, end_id=2)
    back = token_files.read_token_files(manifest, docs.schema["doc_id"].dataType)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_warc")
def op2_warc(spark, folder):
    pages = table(spark, folder, "pages")
    out = work_folder(spark, "op2")
    back = warc.read_archives(warc.write_archives(pages, out), out, payloads=False)
    kind = pages.schema["page_id"].dataType
    return back.select(
        F.col("record_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "intact",
    )


@query("op7_token_counts")
def op7_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"), PIECES, limit=4096)


@query("op10_quality_rules", quality_rules.SQL)
def op10_quality_rules(spark, folder):
    out = work_folder(spark, "op10")
    judged = quality_rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"), out)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_simhash")
def op3_simhash(spark, folder):
    groups = simhash.near_duplicates(table(spark, folder, "documents"), work_folder(spark, "op3"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_packing")
def op4_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), work_folder(spark, "op4"), WORDS, end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_compression")
def op5_compression(spark, folder):
    docs = table(spark, folder, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = compression.fit(docs, table(spark, folder, "labels"), learn=remainder != 1)
    scored = compression.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op8_decontamination", decontaminate.SQL)
def op8_decontamination(spark, folder):
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_line_dedup", line_dedup.SQL)
def op9_line_dedup(spark, folder):
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"), work_folder(spark, "op9"))
    return kept.select("row.doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, folder):
    kept = suffix_dedup.remove_repeats(table(spark, folder, "documents"), work_folder(spark, "op6"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_spelling")
def op13_spelling(spark, folder):
    found = spelling.variants(table(spark, folder, "documents"), work_folder(spark, "op13"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_lexical", lexical.SQL)
def op12_lexical(spark, folder):
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), work_folder(spark, "op12"), k=50)


@query("op11_ngram_join")
def op11_ngram_join(spark, folder):
    return ngram_join.join(table(spark, folder, "documents"), work_folder(spark, "op11"))
