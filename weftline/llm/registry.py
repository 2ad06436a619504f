"""The queries of this folder and their SQL, by name."""

from weftline.llm import conversations, decontaminate, language_id, line_dedup, packing, quality_knn, quality_rules, simhash, suffix_dedup, token_counts

MODULES = (quality_rules, simhash, token_counts, packing, decontaminate, line_dedup, suffix_dedup, conversations, quality_knn, language_id)
QUERIES = {name: fn for m in MODULES for name, fn in vars(m).items() if name.startswith("op") and name[2:3].isdigit() and callable(fn)}
ORACLE_SQL = {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
