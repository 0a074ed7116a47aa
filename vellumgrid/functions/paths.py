"""Root-absolute paths as column expressions: normalising, relative spelling, globs, prefixes."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"/[^/]*\z", "")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def depth(path: Column | str) -> Column:
    """Folders below the root."""
    return F.size(F.split(F.regexp_replace(_c(path), r"\A/+|/+\z", ""), "/")) - 1


def has_prefix(path: Column | str, prefix: str) -> Column:
    """Plain string prefix; one leading slash is ignored on both sides."""
    return F.regexp_replace(_c(path), r"\A/", "").startswith(prefix.removeprefix("/"))


def _fold(parts: Column) -> Column:
    """Resolve ``.`` and ``..``: struct of the kept parts and whether the root was left."""
    kind = "struct<st:array<string>,esc:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("st"), F.lit(False).alias("esc")).cast(kind)
    return F.aggregate(
        F.filter(parts, lambda p: (p != "") & (p != ".")),
        start,
        lambda acc, p: F.when(
            p == "..",
            F.struct(F.when(F.size(acc["st"]) > 0, F.slice(acc["st"], 1, F.greatest(F.size(acc["st"]) - 1, F.lit(0)))).otherwise(acc["st"]).alias("st"), (acc["esc"] | (F.size(acc["st"]) == 0)).alias("esc")),
        ).otherwise(F.struct(F.array_append(acc["st"], p).alias("st"), acc["esc"].alias("esc"))).cast(kind),
    )


def normalise_link(source: Column | str, target: Column | str) -> Column:
    """Struct ``(path, anchor, escapes)``: the target as the document ``source`` sees it, from the root.

    A leading slash is the root; anything else is relative to the document's
    folder. Parts that climb above the root set ``escapes``.
    """
    t = _c(target)
    bare = F.regexp_replace(t, r"#[\s\S]*\z", "")
    anchor = F.when(t.contains("#"), F.regexp_replace(t, r"\A[^#]*#", ""))
    full = F.when(bare.startswith("/"), bare).when(bare == "", _c(source)).otherwise(F.concat(dirname(source), F.lit("/"), bare))
    done = _fold(F.split(full, "/"))
    return F.struct(F.concat(F.lit("/"), F.array_join(done["st"], "/")).alias("path"), anchor.alias("anchor"), done["esc"].alias("escapes"))


def relative_link(source: Column | str, target: Column | str) -> Column:
    """Spelling of the absolute ``target`` as seen from the document ``source``: ``./x`` or ``../x``."""
    a = F.filter(F.split(dirname(source), "/"), lambda p: p != "")
    b = F.filter(F.split(_c(target), "/"), lambda p: p != "")
    # the common folders: positions up to the first difference
    shared = F.aggregate(
        F.zip_with(a, F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda x, y: x.eqNullSafe(y) & x.isNotNull()),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct((acc["n"] + F.when(acc["on"] & same, 1).otherwise(0)).alias("n"), (acc["on"] & same).alias("on")),
        lambda acc: acc["n"],
    )
    ups = F.size(a) - shared
    tail = F.array_join(F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0))), "/")
    return F.concat(F.when(ups > 0, F.repeat(F.lit("../"), ups)).otherwise(F.lit("./")), tail)


def canonical_resource(document: Column | str, resource: Column | str) -> Column:
    """A resource from the project root, or NULL if it leaves it: ``./`` and ``../`` count from the document."""
    r = _c(resource)
    full = F.when(r.startswith("./") | r.startswith("../"), F.concat(dirname(document), F.lit("/"), r)).otherwise(r)
    done = _fold(F.split(full, "/"))
    return F.when(~done["esc"] & (F.size(done["st"]) > 0), F.array_join(done["st"], "/"))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a path glob: ``*``, ``?``, ``[...]`` within a segment, ``**`` any segments.

    Malformed patterns match nothing.
    """
    out = []
    for seg in pattern.strip("/").split("/"):
        if seg == "**":
            out.append("(?:/[^/]+)*")
            continue
        part, i = "/", 0
        while i < len(seg):
            ch = seg[i]
            if ch == "*":
                part += "[^/]*"
            elif ch == "?":
                part += "[^/]"
            elif ch == "[":
                end = seg.find("]", i + 2 if seg[i + 1 : i + 2] in ("^", "!") else i + 1)
                if end < 0 or end == i + 1:
                    return "(?!)"
                body = seg[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                part += "[" + ("^/" + body[1:] if body[:1] in ("^", "!") else body) + "]"
                i = end
            elif ch == "\\":
                if i + 1 == len(seg):
                    return "(?!)"
                i += 1
                part += re.escape(seg[i])
            else:
                part += re.escape(ch)
            i += 1
        out.append(part)
    return r"\A" + "".join(out) + r"\z"


def matches_glob(path: Column | str, pattern: str) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(_c(path), r"\A/+|/+\z", "")).rlike(glob_regex(pattern))


def clean(path: str) -> str:
    """The driver-side twin of path cleaning."""
    return posixpath.normpath("/" + path.strip("/"))


def slug_name(path: Column | str) -> Column:
    """A file name without blanks: runs of white space become one hyphen, outer ones go."""
    return F.array_join(F.filter(F.split(_c(path), r"\s+"), lambda x: x != ""), "-")


def canonical_key(path: Column | str) -> Column:
    """Lower-cased path in which letters followed by one of the listed combining marks are composed."""
    p = _c(path)
    for base, mark, whole in COMPOSED:
        p = F.replace(p, F.lit(base + mark), F.lit(whole))
    return F.lower(p)


# Letter, combining mark, and the letter composed of both.
COMPOSED = (
    ("a", "\u0301", "á"),
    ("e", "\u0301", "é"),
    ("i", "\u0301", "í"),
    ("o", "\u0301", "ó"),
    ("u", "\u0301", "ú"),
    ("A", "\u0301", "Á"),
    ("E", "\u0301", "É"),
    ("I", "\u0301", "Í"),
    ("O", "\u0301", "Ó"),
    ("U", "\u0301", "Ú"),
    ("a", "\u0300", "à"),
    ("e", "\u0300", "è"),
    ("i", "\u0300", "ì"),
    ("o", "\u0300", "ò"),
    ("u", "\u0300", "ù"),
    ("A", "\u0300", "À"),
    ("E", "\u0300", "È"),
    ("I", "\u0300", "Ì"),
    ("O", "\u0300", "Ò"),
    ("U", "\u0300", "Ù"),
    ("a", "\u0308", "ä"),
    ("e", "\u0308", "ë"),
    ("i", "\u0308", "ï"),
    ("o", "\u0308", "ö"),
    ("u", "\u0308", "ü"),
    ("A", "\u0308", "Ä"),
    ("E", "\u0308", "Ë"),
    ("I", "\u0308", "Ï"),
    ("O", "\u0308", "Ö"),
    ("U", "\u0308", "Ü"),
    ("a", "\u0303", "ã"),
    ("n", "\u0303", "ñ"),
    ("o", "\u0303", "õ"),
    ("A", "\u0303", "Ã"),
    ("N", "\u0303", "Ñ"),
    ("O", "\u0303", "Õ"),
    ("a", "\u030a", "å"),
    ("A", "\u030a", "Å"),
    ("c", "\u0327", "ç"),
    ("C", "\u0327", "Ç"),
)
