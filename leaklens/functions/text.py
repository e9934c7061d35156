"""Column functions of leak matching: canonical text, value variants, matchers."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Patterns of US postal codes and of units in an address.
ZIP = r"(?U)\b\d{5}(?:-\d{4})?\b"
UNIT = r"(?iU)\b(?:Apt|Suite|Ste|Unit|#)[\.\s]*\w+"
#: The written forms of a date besides the ISO one.
DATE_FORMS = ("MMMM dd, yyyy", "MMMM d, yyyy", "dd MMMM yyyy", "d MMMM yyyy", "MM/dd/yyyy", "M/d/yyyy")


def canon(t: Column) -> Column:
    """Lower case, white space (Unicode's too) as single spaces, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " "))


def date_variants(v: Column) -> Column:
    """The value and, if it is an ISO date, its six written forms."""
    day = F.try_to_date(v, "yyyy-MM-dd")
    return F.when(day.isNull(), F.array(v)).otherwise(F.array(v, *[F.date_format(day, f) for f in DATE_FORMS]))


def address_variants(v: Column) -> Column:
    """The address, without its postal code, and without its unit too, edges stripped of commas and spaces."""
    no_zip = F.regexp_replace(v, ZIP, "")
    return F.array(v, F.btrim(no_zip, F.lit(", ")), F.btrim(F.regexp_replace(no_zip, UNIT, ""), F.lit(", ")))


def match_variants(field: Column, v: Column) -> Column:
    """Canonical variants by the kind of field."""
    kinds = F.when(field == "date_of_birth", date_variants(v)).when(field == "address", address_variants(v)).otherwise(F.array(v))
    return F.transform(kinds, canon)


#: The patterns of each personal field, the first that is found counts. (?d): only \n ends a line.
PII = {
    "name": (r"^([A-Z][a-z]+ [A-Z][a-z]+)",),
    "date_of_birth": (r"(?dU)born on ([A-Z][a-z]+ \d{1,2}, \d{4})",),
    "phone": (r"(?dU)phone (?:number )?(?:is |at )?(\d{3}-\d{3}-\d{4})", r"(?dU)(\d{3}-\d{3}-\d{4})"),
    "email": (r"(?dU)email (?:is |at )?\[?([^\]\s@]+@[^\]\s)]+)", r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9\-.]+)"),
    "ssn": (r"(?dU)(?:Social Security [Nn]umber|SSN) (?:is )?(\d{3}-\d{2}-\d{4})",),
    "address": (r"(?d)(?:address|resides at)(?: is)? (.+?)(?:\.|$)",),
}


@F.pandas_udf(ArrayType(StructType([StructField("channel", StringType()), StructField("cer", IntegerType()), StructField("aer", IntegerType())])))
def leak_entries(stored: pd.Series) -> pd.Series:
    """Leak entries that a file holds as text: JSON, or a Python literal; empty where it is neither."""

    def read(t: str | None) -> list:
        for parse in (json.loads, ast.literal_eval):
            try:
                found = parse(t or "[]")
            except (ValueError, SyntaxError):
                continue
            rows = found if isinstance(found, list) else []
            return [{"channel": x.get("channel"), "cer": int(x.get("cer") or 0), "aer": int(x.get("aer") or 0)} for x in rows if isinstance(x, dict)]
        return []

    return stored.map(read)


def pii_fields(t: Column) -> dict[str, Column]:
    """Name, date of birth, phone, e-mail, SSN and address in a text; null where there is none."""
    out = {f: F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns]) for f, patterns in PII.items()}
    return out | {"email": F.replace(out["email"], F.lit("\\"), F.lit("")), "address": F.regexp_replace(out["address"], r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")}


def tokens(t: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), 1))


def leaks(text: Column, variants: Column) -> Column:
    """1 if a non-empty variant is in the text."""
    return F.coalesce(F.exists(variants, lambda v: (v != "") & F.contains(text, v)), F.lit(False)).cast("int")


def token_leaks(text: Column, variants: Column) -> Column:
    """1 if a token of three letters or more of a variant is in the text."""
    long = lambda v: F.filter(F.split(v, r"[\s,/-]+"), lambda t: F.length(t) >= 3)
    hit = F.exists(variants, lambda v: F.exists(long(v), lambda t: F.contains(text, t)))
    return (F.coalesce(hit, F.lit(False)) & (text != "")).cast("int")


def word_leaks(text: Column, value: Column) -> Column:
    """1 if the value, of two letters or more, stands in the text between word boundaries."""
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), value, F.lit(r"\E(?!\w)"))
    return (F.rlike(text, pattern) & (F.length(value) >= 2)).cast("int")


def any_word_leaks(text: Column, variants: Column) -> Column:
    """1 if a variant of two letters or more stands in the text between word boundaries."""
    return F.coalesce(F.exists(variants, lambda v: word_leaks(text, v) == 1), F.lit(False)).cast("int")


def severity(text: Column, variants: Column) -> Column:
    """1 for a leak, else the best share of a variant's tokens that the text has; 0 without text or value."""
    have = tokens(text)
    recall = F.transform(F.filter(F.transform(variants, tokens), lambda t: F.size(t) > 0), lambda t: F.size(F.array_intersect(t, have)) / F.size(t))
    return F.when(text == "", 0.0).when(leaks(text, variants) == 1, 1.0).otherwise(F.coalesce(F.array_max(recall), F.lit(0.0)))


def channel_text(observations: Column) -> Column:
    """Canonical text of a list of lists of observations, or of a list."""
    return canon(F.array_join(observations, " "))


def name_in_question(q: Column) -> Column:
    """The name that a question asks about; the whole question if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(q, r"^(?:What is|Who is|Where does)\s+(.+?)'s\s", 1), F.lit("")), q)
