"""Queries of this subpackage and their SQL, by name."""

from importlib import import_module

MODULES = ("token_files", "warc", "language", "topk", "secrets", "mixing", "simhash", "quality", "lm_scoring", "packing", "runs", "itq", "divergence")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").SQL.items()}
