"""Schemas of the stored tables."""

from __future__ import annotations

_MEMORY = (
    "id string, content string, compressed string, summary string, headline string, memory_type string, state string, scope string, author string, room string, "
    "tags array<string>, entities array<string>, source_type string, source_detail string, confidence double, importance double, access_count bigint, last_accessed timestamp, "
    "created_at timestamp, updated_at timestamp, verified_at timestamp, endorsed_by array<string>, disputed_by array<string>"
)
MEMORY_FIELDS = [f.split()[0] for f in _MEMORY.split(", ")]
_ANALYSIS = "relation string, confidence double, reasoning string, key_difference string, suggested_action string, existing_id string, tier int"
TABLES = {
    "memories": f"{_MEMORY}, embedding array<float>, in_index boolean, embedded_at timestamp",
    "edges": "id string, source_id string, target_id string, edge_type string, created_at timestamp, created_by string",
    "sessions": "id string, ide string, cwd string, room string, started_at timestamp, ended_at timestamp, metadata string",
    "observations": "id string, session_id string, kind string, content string, compressed string, created_at timestamp, metadata string",
    "conflicts": f"id string, new_memory struct<{_MEMORY}>, existing_memory_ids array<string>, analysis struct<{_ANALYSIS}>, state string, resolution struct<action string, context string, merged_content string>, created_at timestamp, expires_at timestamp, resolved_at timestamp, resolved_by string",
    "timeline": "id string, memory_id string, event_type string, detail string, actor string, created_at timestamp",
    "cache": "id string, query string, query_embedding array<float>, answer string, source_ids array<string>, room string, created_at timestamp, expires_at timestamp, hits bigint",
    "embed_queue": "id bigint, target_type string, target_id string, content string, priority bigint, status string, created_at timestamp, processed_at timestamp, worker string, lease_until timestamp",
    "meta": "key string, value string",
}
KEYS = dict.fromkeys(TABLES, "id") | {"meta": "key"}
EXPORTED = _MEMORY
