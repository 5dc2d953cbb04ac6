"""Query catalogue. Importing the family modules registers their queries."""

import importlib

FAMILIES = ("text", "corpus", "retrieval", "guard", "spend", "traffic", "runs", "history", "stores", "streams")


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
