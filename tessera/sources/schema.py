"""The stored tables' schemas."""

from __future__ import annotations

ITEM = (
    "repo string, id string, asset_type string, title string, content string, summary string, metadata map<string,string>, source_type string, branch string, commit_sha string, file_hash string, "
    "indexed_at timestamp, index_batch_id string, path string, start_line int, end_line int, symbol string, table_name string, column_name string, heading_path string, language string, symbol_type string"
)
SYMBOL = (
    "repo string, symbol_id string, path string, language string, kind string, name string, qualified_name string, start_line int, end_line int, source_item_id string, branch string, commit_sha string, "
    "file_hash string, indexed_at timestamp, index_batch_id string"
)
EMBEDDING = "repo string, item_id string, provider string, model string, dimension int, embedding array<double>"
SCHEMAS = {"items": ITEM, "symbols": SYMBOL, "embeddings": EMBEDDING}
KEYS = {"items": ("repo", "id"), "symbols": ("repo", "symbol_id"), "embeddings": ("repo", "item_id", "provider", "model", "dimension")}


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]
