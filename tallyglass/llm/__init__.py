"""Operators for training-data pipelines. Nothing outside this package imports it."""

import importlib

OPERATORS = ("quality_rules", "bpe", "quality_classifier", "toxicity", "minhash", "line_dedup", "packing",
             "token_counts", "fingerprint", "warc", "decontamination", "conversations", "collocations")


def load_all() -> None:
    """Import the operator modules, which register their queries."""
    for name in OPERATORS:
        importlib.import_module(f"{__name__}.{name}")
