"""Text expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def heading_slug(text: Column | str) -> Column:
    """Anchor of a heading: lower case, blanks become hyphens, only letters, digits, ``-`` and ``_`` stay."""
    return F.regexp_replace(F.replace(F.lower(_c(text)), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}_-]", "")


def strip(text: Column | str) -> Column:
    """Trim every Unicode blank, not only U+0020."""
    return F.regexp_replace(_c(text), r"\A[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+\z", "")


def landing_slug(name: Column | str) -> Column:
    """A name as one URL segment: lower case, every run of other characters than letters and digits one hyphen."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(name)), r"[^\p{L}\p{Nd}]+", "-"), r"\A-+|-+\z", "")
    return F.when(slug == "", "corpus").otherwise(slug)


def version_key(version: Column | str) -> Column:
    """A semantic version as a comparable value; NULL if it is none. A leading ``v`` and the build after ``+`` don't count.

    ``(major, minor, patch, released, parts)``: a release comes after its
    pre-releases, whose parts compare as numbers, before words, or as words.
    """
    v = F.regexp_replace(_c(version), r"\Av", "")
    ok = v.rlike(r"\A\d{1,9}\.\d{1,9}\.\d{1,9}(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?(?:\+.*)?\z")
    part = lambda i: F.regexp_extract(v, r"\A(\d+)\.(\d+)\.(\d+)", i).try_cast("int")
    pre = F.regexp_extract(v, r"\A[^-+]*-([^+]*)", 1)
    numeric = lambda x: x.rlike(r"\A\d{1,18}\z")
    parts = F.transform(F.filter(F.split(pre, r"\."), lambda x: x != ""), lambda x: F.struct((~numeric(x)).alias("word"), F.coalesce(F.when(numeric(x), x).try_cast("long"), F.lit(0)).alias("number"), x.alias("text")))
    return F.when(ok, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("released"), parts.alias("parts")))
