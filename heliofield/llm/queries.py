"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from heliofield.llm import collocations, decontam, html_extract, lm, mixing, near_dedup, pu_quality, quality, secrets, suffix_dedup, token_align, token_output, url_filter
from heliofield.llm.runtime import table


def op4_quality_rules(spark, sf_dir):
    return quality.apply_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")  # which rule came first is a matter of cost


def op5_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_html_text(spark, sf_dir):
    return html_extract.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_token_shards": token_output.op3_token_shards,
        "op4_quality_rules": op4_quality_rules,
        "op5_secret_scan": op5_secret_scan,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_lm_scores": lm.op7_lm_scores,
        "op8_decontaminate": decontam.op8_decontaminate,
        "op9_url_templates": url_filter.op9_url_templates,
        "op10_html_text": op10_html_text,
        "op11_pu_quality": pu_quality.op11_pu_quality,
        "op12_collocations": collocations.op12_collocations,
        "op13_token_align": token_align.op13_token_align,
    }


def oracle_sql():
    return {"op2_source_mix": mixing.SQL, "op4_quality_rules": quality.SQL, "op9_url_templates": url_filter.SQL, "op12_collocations": collocations.SQL}
