"""What a parse allows."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Policy:
    """Limits and number types of a parse.

    max_length: UTF-8 bytes of a string or key. max_stack_depth: entries of the parse stack (see checker). float: "double",
    "float" or None (no floating point). int_bits: 16, 32, 64 or 128. max_array_size, max_object_size: members of the
    arrays and objects of a document value. positions: whether line and column are reported.
    """

    max_length: int = 64
    max_stack_depth: int = 8
    positions: bool = True
    float: str | None = "double"
    int_bits: int = 32
    max_array_size: int = 50
    max_object_size: int = 50

    def __post_init__(self):
        if self.max_length < 0 or self.max_array_size < 0 or self.max_object_size < 0:
            raise ValueError("limits must not be negative")
        if self.max_stack_depth < 2:
            raise ValueError("max_stack_depth must be at least 2")
        if self.float not in ("double", "float", None):
            raise ValueError("float must be 'double', 'float' or None")
        if self.int_bits not in (16, 32, 64, 128):
            raise ValueError("int_bits must be 16, 32, 64 or 128")

    @property
    def int_min(self) -> int:
        return -(1 << (self.int_bits - 1))

    @property
    def int_max(self) -> int:
        return (1 << (self.int_bits - 1)) - 1

    def but(self, **changes) -> Policy:
        return replace(self, **changes)

    @classmethod
    def relaxed(cls) -> Policy:
        """For data at large: long strings, deep nesting, large arrays and objects, 64-bit integers."""
        return cls(max_length=1 << 30, max_stack_depth=512, int_bits=64, max_array_size=1 << 30, max_object_size=1 << 30)
