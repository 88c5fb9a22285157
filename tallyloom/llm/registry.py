"""The queries op1 to op10 and pipeline, with production parameters over their whole tables."""

from __future__ import annotations

from tallyloom.llm import decontaminate, jaccard_join, mixing, near_dedup, negatives, repeats
from tallyloom.llm import line_dedup as lines
from tallyloom.llm.alignment import align
from tallyloom.llm.common import job, table
from tallyloom.llm.fingerprints import edited_fingerprints
from tallyloom.llm.html_text import extract
from tallyloom.llm.language_id import predicted
from tallyloom.llm.token_counts import token_counts
from tallyloom.llm.url_filter import seed_urls, url_filter


def op1_token_counts(spark, sf_dir):
    """Words and longest-match pieces of every document: doc_id, n_words, n_tokens."""
    return token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_html_extraction(spark, sf_dir):
    """The article of every page: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op3_line_dedup(spark, sf_dir):
    """Every document without its source's boilerplate lines: doc_id, text, n_removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.line_dedup(docs, removed="n_removed").select("doc_id", "text", "n_removed")


def op4_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, with their likeness: see edited_fingerprints for nulls, ties, repeats and long texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    """The words that the mix takes of every document: see mix for nulls, ties, repeats and long texts."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_near_dedup(spark, sf_dir):
    """Every document's component by two-word shingles: doc_id, n_shingles, component_id, kept."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_suffix_array_dedup(spark, sf_dir):
    """What is left of every document without bytes that 100-byte strings repeat: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page's url."""
    return url_filter(table(spark, sf_dir, "pages"), seed_urls(spark), keep=["page_id"])


def op9_decontamination(spark, sf_dir):
    """Every document that holds a benchmark item: doc_id, item_id, item_shingles, shared, containment."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark, sf_dir):
    """The predicted language of every document: doc_id, held_out, lang_pred, score."""
    return predicted(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark, sf_dir):
    """Every document's component by four-word shingles at 0.85: see jaccard_join for nulls, repeats and long texts."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark, sf_dir):
    """How the tokens of two tokenizers end together in every document: see align for nulls, repeats and long texts."""
    docs = table(spark, sf_dir, "documents")
    return align(docs, keep=["doc_id"], groups="groups_sha256", digest=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector: see hard_negatives for nulls, ties, repeats."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def queries():
    found = (op1_token_counts, op2_html_extraction, op3_line_dedup, op4_fingerprints, op5_mixing, op6_near_dedup, op7_suffix_array_dedup, op8_url_filter, op9_decontamination, op10_language_id)
    found += (op11_jaccard_join, op12_token_alignment, op13_hard_negatives)
    return {f.__name__: job(f) for f in found}


def oracle_sql():
    return {
        "op3_line_dedup": lines.SQL,
        "op5_mixing": mixing.SQL,
        "op6_near_dedup": near_dedup.SQL,
        "op7_suffix_array_dedup": repeats.SQL,
        "op9_decontamination": decontaminate.SQL,
        "op11_jaccard_join": jaccard_join.SQL,
        "op13_hard_negatives": negatives.SQL,
    }
