"""Value checks: formats, closed domains and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.schemas import DOCUMENT_TYPES, TENDER_STATUSES, UPLOAD_CONTENT_TYPES, UPLOAD_MAX_BYTES, UPLOAD_SUFFIXES
from bidlake.functions.text import file_suffix

# Identifier formats.
CIG_FORMAT = "^[0-9]{10}$"
UUID_FORMAT = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def is_cig(code: str | Column) -> Column:
    return F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit("")).rlike(CIG_FORMAT)


def is_uuid(value: str | Column) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")).rlike(UUID_FORMAT)


def _in_domain(value: str | Column, domain: tuple[str, ...]) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.isNull() | value.isin(*domain)


def is_tender_status(value: str | Column) -> Column:
    return _in_domain(value, TENDER_STATUSES)


def is_document_type(value: str | Column) -> Column:
    return _in_domain(value, DOCUMENT_TYPES)


def upload_error(filename: str | Column, length: str | Column) -> Column:
    """Reason to refuse an uploaded file, or null."""
    suffix = file_suffix(filename)
    length = F.col(length) if isinstance(length, str) else length
    return (
        F.when(F.coalesce(filename if isinstance(filename, Column) else F.col(filename), F.lit("")) == "",
               F.lit("Filename is required"))
        .when(~suffix.isin(*UPLOAD_SUFFIXES), F.concat(F.lit("Unsupported file type: "), suffix))
        .when(length == 0, F.lit("Uploaded file is empty"))
        .when(length > UPLOAD_MAX_BYTES, F.lit("File too large"))
    )


def is_upload_content_type(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.isin(*UPLOAD_CONTENT_TYPES)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts; empty when the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
