"""Language resolution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.text import has, lookup, strip


def normalize_language(col: Column) -> Column:
    """Trimmed, lowered, alias resolved; the empty string gives null."""
    norm = F.lower(strip(col))
    return F.when(col == "", None).otherwise(F.coalesce(lookup(norm, fixed.ALIASES), norm))


def _extension(col: Column) -> Column:
    return F.when(col.contains("."), F.lower(F.substring_index(col, ".", -1)))


def language_from_filename(col: Column) -> Column:
    return lookup(_extension(col), fixed.REVIEW_EXTENSIONS)


def language_from_path(col: Column) -> Column:
    """Suffix of the last path part; a leading or a final dot makes no suffix."""
    # Trailing slashes and '.' parts are not part of the name.
    base = F.regexp_extract(col, r"([^/]*?)(?:/+\.?)*\z", 1)
    suffix = F.regexp_extract(base, r"(?s)\A.+\.([^.]+)\z", 1)
    return lookup(F.lower(suffix), fixed.CLEAN_EXTENSIONS)


def language_from_code(col: Column) -> Column:
    return (F.when(has(col, fixed.CPP_HINT, "iu"), "cpp")
            .when(has(col, fixed.JAVA_HINT, "iu"), "java"))


def resolve_review_language(language: Column, filename: Column, code: Column) -> Column:
    """File name, then declared language, then code hints, then python."""
    declared = normalize_language(language)
    return F.coalesce(
        language_from_filename(filename),
        F.when(declared.isin(fixed.SUPPORTED), declared),
        language_from_code(code),
        F.lit("python"),
    )


def resolve_row_language(language: Column, path: Column) -> Column:
    declared = normalize_language(language)
    return F.when(declared.isin(fixed.SUPPORTED), declared).otherwise(language_from_path(path))


def upload_language(filename: Column, chosen: Column) -> Column:
    """Upload screen: suffix, else the chosen language, else python."""
    return F.coalesce(lookup(_extension(filename), fixed.APP_UPLOAD_EXTENSIONS),
                      lookup(chosen, {"Python": "python", "C++": "cpp", "Java": "java"}),
                      F.lit("python"))


def _tail(filename: Column) -> Column:
    """Text after the last dot, the whole name if there is none."""
    return F.lower(F.substring_index(filename, ".", -1))


def dashboard_review_language(filename: Column) -> Column:
    return F.coalesce(lookup(_tail(filename), fixed.DASHBOARD_REVIEW_EXTENSIONS), F.lit("python"))


def dashboard_display_language(filename: Column) -> Column:
    return F.coalesce(lookup(_tail(filename), fixed.DASHBOARD_DISPLAY_EXTENSIONS),
                      F.lit("plaintext"))
