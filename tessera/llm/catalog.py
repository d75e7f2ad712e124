"""The registered queries of this package and their SQL."""

from __future__ import annotations

import importlib

from tessera.sources.shipping import shipped

#: Query name and module; each module has ``query(spark, sf_dir)`` and may have ``ORACLE_SQL``.
MODULES = {
    "op9_winnowing": "op09_winnowing",
    "op8_wavelet_shards": "op08_wavelet_shards",
    "op3_vector_packing": "op03_vector_packing",
    "op1_warc_writer": "op01_warc_writer",
    "op10_license_notices": "op10_license_notices",
    "op5_url_templates": "op05_url_templates",
    "op7_nbsvm_quality": "op07_nbsvm_quality",
    "op4_multiset_hash": "op04_multiset_hash",
    "op2_set_relation_join": "op02_set_relation_join",
    "op6_secret_ledger": "op06_secret_ledger",
    "op11_prefix_trie": "op11_prefix_trie",
    "op12_collocations": "op12_collocations",
    "op13_token_counts": "op13_token_counts",
}
_LOADED = {name: importlib.import_module(f"{__package__}.{module}") for name, module in MODULES.items()}
QUERIES = {name: shipped(module.query) for name, module in _LOADED.items()}
ORACLE_SQL = {name: module.ORACLE_SQL for name, module in _LOADED.items() if getattr(module, "ORACLE_SQL", None)}
