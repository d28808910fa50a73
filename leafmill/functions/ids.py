"""Content hashes and name-based document ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of URLs of name-based UUIDs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def uuid5(name: Column) -> Column:
    """Version-5 UUID of a string in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(h.substr(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws(
        "-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12)
    )


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s:%05d", document_id, index)
