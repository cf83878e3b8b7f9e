"""Pieces of the SQL that results are compared with."""

from __future__ import annotations

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def crc32_table() -> str:
    """The remainders of all bytes as a list."""
    return f"list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: xor(c >> 1, {POLYNOMIAL} * (c & 1)), n))"


def crc32(text: str, table: str) -> str:
    """The unsigned CRC-32 of ASCII text; ``table`` names a column of ``crc32_table``."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda acc, b: xor(acc >> 8, {table}[(xor(acc, b) & 255) + 1]), 4294967295), 4294967295)"
