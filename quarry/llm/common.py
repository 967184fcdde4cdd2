"""What the training-data operators share: white space, texts, row keys; stage tables come from quarry.plans.stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans.stages import delete, run_dir, shared_dir, stored

__all__ = ["SPACE", "delete", "row_key", "run_dir", "shared_dir", "stored", "text_of"]

#: The white space that every operator on words or normalised text splits at.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share a doc_id but not a text; equal rows share it."""
    return F.xxhash64(doc_id.isNull(), text)
