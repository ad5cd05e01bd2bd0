"""Explicit schemas and closed vocabularies."""

from __future__ import annotations

#: Event types that a reader knows.
EVENT_TYPES = ("user/message", "assistant/message", "assistant/chunk", "tool/call", "tool/result", "step/start", "step/end", "turn/start", "turn/end", "session/title")
SURFACES = ("current", "shadowed", "log-only")
AVAILABILITY = ("live", "persisted")

SESSION = "id string, version bigint, created_at bigint, cwd string, parent_session string, seed_length bigint, origin string, delegation_depth bigint, agent_preset string, incarnation string, revision bigint"
EVENT = "session_id string, seq bigint, type string, time bigint, data string, source_event_seqs array<bigint>, surface_op struct<op:string,start:bigint,end:bigint>, ignorable boolean"
CHUNK = "chunk_id string, file_path string, chunk_index bigint, start_line bigint, end_line bigint, text string"
MEMORY = "memory_id string, revision bigint, scope string, kind string, status string, content string, updated_at bigint"
