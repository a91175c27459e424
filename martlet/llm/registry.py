"""The operators bound to the driver tables: ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from .alignment import alignment_report
from .bloom_lm import lm_report
from .chat_format import CHAT_ORACLE, chat_digest, with_injection
from .common import table
from .decontaminate import leaks
from .importance import importance_report
from .license_scan import license_report
from .mixing import mixing_report
from .packing import packing_report
from .pii_surrogates import pii_report
from .quality_rules import quality_report
from .simhash import near_duplicate_report
from .suffix_dedup import repeat_report
from .toxicity import toxicity_report


def op1_suffix_dedup(spark, sf_dir):
    return repeat_report(table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    return chat_digest(with_injection(table(spark, sf_dir, "conversations")))


def op3_toxicity(spark, sf_dir):
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark, sf_dir):
    return mixing_report(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark, sf_dir):
    return pii_report(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return license_report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op10_bloom_lm(spark, sf_dir):
    return lm_report(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark, sf_dir):
    return importance_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers as public
    return alignment_report(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"),
                            public.PATTERN, public.path("piece_bpe_32k.model"))


def op13_best_fit_packing(spark, sf_dir):
    import public_tokenizers as public
    return packing_report(table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_chat_format, op3_toxicity, op4_decontamination, op5_mixing,
    op6_pii_surrogates, op7_license_scan, op8_simhash, op9_quality_rules, op10_bloom_lm,
    op11_importance_resampling, op12_tokenizer_alignment, op13_best_fit_packing)}
ORACLE = {"op2_chat_format": CHAT_ORACLE}
