"""Names of uploaded files, and what is told of errors with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import NO_COMPONENTS, NO_FILE, NO_PERMISSION, NOT_PDF, NOT_VALID, UNEXPECTED, VALID

MOST_BYTES = 100 << 20


def upload_status(name: Column) -> Column:
    """The first complaint about an uploaded file's name, or that it is valid."""
    return F.when(name.isNull() | (name == ""), NO_FILE).when(~F.lower(name).endswith(".pdf"), NOT_PDF).otherwise(VALID)


def safe_name(name: Column) -> Column:
    """Letters, digits and `._-` of the name."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}._-]", "")


def stamped_name(name: Column, at: Column) -> Column:
    return F.concat_ws("_", F.date_format(at, "yyyyMMddHHmmss"), safe_name(name))


def error_message(error: Column) -> Column:
    """What is told of a row's `error` ("Kind: text", as the adapters give it), by its kind; null without one."""
    kind, text = F.substring_index(error, ": ", 1), F.regexp_replace(error, r"(?s)^[^:]*: ?", "")
    return (
        F.when(error.isNull(), F.lit(None).cast("string"))
        .when(kind == "PdfReadError", NOT_VALID)
        .when(kind == "ValueError", text)
        .when(kind == "FileNotFoundError", NO_COMPONENTS)
        .when(kind == "PermissionError", NO_PERMISSION)
        .otherwise(F.format_string(UNEXPECTED, text))
    )
