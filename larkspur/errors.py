"""The error catalogue: fixed values (category, code, name, message)."""

from __future__ import annotations

PARSER = {
    "none": (0, "none"),
    "bad_unicode_code_point": (1, "bad UNICODE code point"),
    "expected_array_member": (2, "expected array member"),
    "expected_close_quote": (3, "expected close quote"),
    "expected_colon": (4, "expected colon"),
    "expected_digits": (5, "expected digits"),
    "expected_object_key": (6, "expected object key"),
    "expected_object_member": (7, "expected object member"),
    "expected_token": (8, "expected token"),
    "invalid_escape_char": (9, "invalid escape character"),
    "invalid_hex_char": (10, "invalid hexadecimal escape character"),
    "nesting_too_deep": (11, "objects are too deeply nested"),
    "number_out_of_range": (12, "number out of range"),
    "unexpected_extra_input": (13, "unexpected extra input"),
    "unrecognized_token": (14, "unrecognized token"),
    "string_too_long": (15, "string too long"),
}
DOM = {
    "too_many_array_members": (1, "Too many array members for DOM"),
    "too_many_object_members": (2, "Too many object members for DOM"),
}


def describe(name: str) -> dict:
    """The catalogue's entry as a row; other names come from a user's own handler."""
    for category, table in (("parser", PARSER), ("dom", DOM)):
        if name in table:
            return {"category": category, "code": table[name][0], "name": name, "message": table[name][1]}
    return {"category": "user", "code": None, "name": name, "message": name}
