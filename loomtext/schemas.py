"""Canonical tables of the engine.

Order is carried by explicit ordinals; grapheme semantics are reduced to code
points; optional values are nullable columns; tagged unions are a ``tag`` with
nullable fields.
"""

from __future__ import annotations

RAW_FILES = "url string, kind string, byte_count long, content binary"
DETECTIONS = "url string, kind string, encoding string, byte_count long, is_empty boolean, markdown_score int, confidence int"
LINES = "doc_id long, line_no int, content string, line_ending string"
SEGMENT = "ordinal int, id string, source_text string, prefix string, suffix string, kind string, translates boolean"
SEGMENTS = f"doc_id long, {SEGMENT}"
CHUNKS = "doc_id long, chunk int, id string, segment_ids array<string>, character_count long, estimated_token_count long"
BLOCK_REQUESTS = "page_index int, ordinal int, id string, text string"
BLOCK_RESPONSES = "page_index int, id string, text string"
LAYOUT_LINES = (
    "page int, id string, text string, x double, y double, w double, h double, size double, color string, "
    "source string, column_index int, reading_order int"
)
LIVE_EVENTS = "seq long, ordinal int, tag string, text string, language_code string, data binary"
MESSAGES = "conv_id long, id string, speaker string, original string, translated string, seq long"
HISTORY = (
    "id string, source_text string, translated_text string, source_language string, target_language string, "
    "backend string, provider string, model string, created_at timestamp"
)
CONVERSATIONS_STORE = (
    "conversations array<struct<id:string,title:string,createdAt:timestamp,updatedAt:timestamp,"
    "messages:array<struct<id:string,speaker:string,originalText:string,translatedText:string,createdAt:timestamp>>>>, "
    "selectedConversationID string"
)
MODELS = "id string, model string, display_name string, description string, is_default boolean"

# The language dimension, source side first.
LANGUAGES = [
    ("auto", "Auto", True, False),
    ("en", "English", True, True),
    ("ko", "Korean", True, True),
    ("ja", "Japanese", True, True),
    ("zh-CN", "Chinese (Simplified)", True, True),
    ("zh-TW", "Chinese (Traditional)", True, True),
    ("es", "Spanish", True, True),
    ("fr", "French", True, True),
    ("de", "German", True, True),
]
