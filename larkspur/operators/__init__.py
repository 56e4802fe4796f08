"""Operators over rows of JSON text."""

from larkspur.operators.chunks import json_assemble
from larkspur.operators.events import accumulate, json_events, json_render, json_tokens
from larkspur.operators.joins import asof_join, range_join
from larkspur.operators.table import register_json_events

__all__ = ["accumulate", "asof_join", "json_assemble", "json_events", "json_render", "json_tokens", "range_join", "register_json_events"]
