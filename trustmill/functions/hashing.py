"""Hash-derived numbers that any SQL engine can compute: bits of SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column) -> Column:
    """The first 32 bits of the SHA-256 of the parts joined by colons, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    return hash32(*parts) / F.lit(4294967296.0)


def stable_seed(root: Column, path: Column, view: Column, replicate: Column | None = None) -> Column:
    """First 8 bytes, big-endian, of the SHA-256 of the parts joined by NUL, modulo 2^63 - 1."""
    parts = [root, path, view] + ([] if replicate is None else [replicate])
    digest = F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 16)
    return (F.conv(digest, 16, 10).cast("decimal(20,0)") % F.lit(9223372036854775807).cast("decimal(20,0)")).cast("long")


def view_id(path: Column, view: Column, replicate: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", path.cast("string"), view, replicate.cast("string")), 256), 1, 20)
