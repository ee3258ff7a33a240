"""Names of stored objects.

A URI names a bucket and a key. Scheme and its case, doubled or leading slashes and ``.`` steps do not change which
object is named, so ``S3://b/k``, ``s3a://b//k`` and ``s3://b/./k`` are one object. The normal form is ``bucket/key``.
Null gives null; text without a scheme is taken as bucket and key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_name(uri: Column | str) -> Column:
    u = F.trim(F.col(uri) if isinstance(uri, str) else uri)
    bare = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "")
    return F.regexp_replace(bare, "(/\\.(?=/))|(/(?=/))", "")


def object_position(name: Column | str) -> Column:
    """The position that starts the last step of ``epoch/schema/table/position-uuid.parquet``; null if there is none."""
    n = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.upper(F.regexp_extract(n, "([0-9A-Fa-f]{16})-[^/]*$", 1)), F.lit(""))
