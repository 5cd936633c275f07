"""Schemas and closed value domains of the relational, document, vector and graph models."""

from __future__ import annotations

from pyspark.sql import types as T

# Status and document-type domains, heading names, accepted upload types.
TENDER_STATUSES = ("draft", "published", "open", "closed", "awarded", "cancelled")
DOCUMENT_TYPES = ("bando", "capitolato", "disciplinare", "rettifica", "avviso", "chiarimenti", "qa", "altro")
UPLOAD_SUFFIXES = (".pdf", ".docx")
UPLOAD_CONTENT_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
)
UPLOAD_MAX_BYTES = 50 * 1024 * 1024

TENDERS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("buyer", T.StringType()),
    T.StructField("publish_date", T.DateType()),
    T.StructField("closing_date", T.DateType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

LOTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("tender_id", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("value_estimated", T.DecimalType(18, 2)),
    T.StructField("currency", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

DOCUMENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("tender_id", T.StringType(), False),
    T.StructField("lot_id", T.StringType()),
    T.StructField("filename", T.StringType(), False),
    T.StructField("document_type", T.StringType()),
    T.StructField("uploaded_at", T.TimestampNTZType()),
    T.StructField("storage_bucket", T.StringType()),
    T.StructField("storage_path", T.StringType()),
])

BLOCK = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("raw_cells", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("font_size", T.DoubleType()),
    T.StructField("font_name", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

PAGE = T.StructType([
    T.StructField("page_number", T.IntegerType(), False),
    T.StructField("blocks", T.ArrayType(BLOCK)),
])

PARSED_DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("language", T.StringType()),
    T.StructField("pages", T.ArrayType(PAGE)),
])

SECTION_CHUNK = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("heading_level", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
    T.StructField("page_numbers", T.ArrayType(T.IntegerType())),
    T.StructField("tender_id", T.StringType()),
    T.StructField("lot_id", T.StringType()),
    T.StructField("section_type", T.StringType()),
])

TOKEN_CHUNK = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("section_path", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("page_numbers", T.ArrayType(T.IntegerType())),
    T.StructField("source_chunk_id", T.StringType()),
    T.StructField("tender_id", T.StringType()),
    T.StructField("lot_id", T.StringType()),
    T.StructField("section_type", T.StringType()),
])

CHUNK_COLLECTION = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("section_path", T.StringType()),
    T.StructField("tender_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("page_numbers", T.ArrayType(T.IntegerType())),
    T.StructField("source_chunk_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

# Collection field type names and the Spark type that stores each.
COLLECTION_TYPES: dict[str, T.DataType] = {
    "BOOL": T.BooleanType(),
    "INT8": T.ByteType(),
    "INT16": T.ShortType(),
    "INT32": T.IntegerType(),
    "INT64": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "JSON": T.MapType(T.StringType(), T.StringType()),
    "ARRAY": T.ArrayType(T.StringType()),
    "FLOAT_VECTOR": T.ArrayType(T.FloatType()),
    "BINARY_VECTOR": T.BinaryType(),
    "FLOAT16_VECTOR": T.ArrayType(T.FloatType()),
    "BFLOAT16_VECTOR": T.ArrayType(T.FloatType()),
    "SPARSE_FLOAT_VECTOR": T.MapType(T.IntegerType(), T.FloatType()),
}

# Uniqueness rules and lookup columns of the graph labels.
UNIQUE_KEYS = {"Tender": "code", "Lot": "id", "Requirement": "id", "Deadline": "id", "Organization": "cf"}
LOOKUP_COLUMNS = {
    "Tender": ("cpv_code", "buyer_name", "publication_date"),
    "Requirement": ("mandatory",),
    "Deadline": ("date",),
    "Lot": ("cpv_code",),
}
