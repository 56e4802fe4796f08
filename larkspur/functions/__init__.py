"""Column functions over JSON text and document values."""

from larkspur.functions.checks import json_check, json_text, json_valid
from larkspur.functions.numbers import format_position, json_number
from larkspur.functions.values import (
    allow_duplicate_keys,
    json_each,
    json_equal,
    json_get,
    json_is_close,
    json_keys,
    json_make,
    json_members,
    json_parse,
    json_set,
    json_size,
    json_typeof,
)

__all__ = [
    "allow_duplicate_keys", "format_position", "json_check", "json_each", "json_equal", "json_get", "json_is_close", "json_keys", "json_make", "json_members", "json_number",
    "json_parse", "json_set", "json_size", "json_text", "json_typeof", "json_valid",
]
