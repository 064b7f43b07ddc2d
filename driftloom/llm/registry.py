"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, hmm_lm, licenses, packing, pii, pu_quality, quality_rules, simhash, token_files, warc

MODULES = (simhash, packing, quality_rules, licenses, pii, decontamination, hmm_lm, pu_quality, warc, token_files)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
