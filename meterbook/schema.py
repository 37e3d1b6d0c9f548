"""Schemas of the canonical tables."""

from __future__ import annotations

USAGE_EVENTS = (
    "event_hash string, timestamp timestamp, source_id long, session_id long, source_session_id string, project_id long, event_type string, provider string, model string, message_role string, "
    "input_tokens long, output_tokens long, reasoning_tokens long, cache_read_tokens long, cache_write_tokens long, tool_tokens long, total_tokens long, cost_usd double, exactness string, confidence double, "
    "raw_json string, raw_source_path string, ignored boolean, created_at timestamp"
)
MODEL_PRICING = (
    "provider string, model string, input_price_per_million double, output_price_per_million double, reasoning_price_per_million double, cache_read_price_per_million double, cache_write_price_per_million double, "
    "context_window_tokens long, currency string, effective_date string, is_local boolean, source string, updated_at string"
)
SESSIONS = "id long, source_session_id string, source_id long, project_id long, title string, started_at timestamp, last_seen_at timestamp"
DAILY_USAGE = "date date, provider string, model string, project_id long, input_tokens long, output_tokens long, reasoning_tokens long, cache_read_tokens long, cache_write_tokens long, total_tokens long, cost_usd double, sessions_count long"
ALERTS = "type string, threshold int, severity string, title string, message string, date date, acknowledged_at timestamp"
SOURCES = "id long, name string, kind string, path string, enabled boolean, last_scanned_at timestamp, last_error string"

TOKEN_COLUMNS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens"]
EXACTNESS = ["exact", "estimated", "mixed", "unknown"]
