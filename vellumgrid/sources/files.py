"""Markdown trees and project files as relations.

Listing, configuration and ignore rules are read on the driver; contents are
read by the executors.
"""

from __future__ import annotations

import json
import os
import re
import tomllib
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions.paths import glob_regex


@dataclass(frozen=True)
class Project:
    """A project's settings."""

    root: str
    name: str = ""
    corpus: str = "."
    output: str = "dist"
    spec: str = "0.2"
    types: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    ignore_orphans: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()  # templates, data, logos, sites: no sources
    unknown: tuple[str, ...] = field(default=())

    @property
    def dir(self) -> str:
        return os.path.normpath(os.path.join(self.root, self.corpus))


KEYS = ("name", "corpus", "output", "spec", "types", "ignore", "ignore_orphans", "exclude")
# Specifications and the format version each embeds.
SPECS = {"0.1": "0.1", "0.2": "0.2"}


def safe_relative(path: str) -> str:
    """``path`` cleaned, if it stays below the root; else ``ValueError``."""
    clean = os.path.normpath(path.replace("\\", "/"))
    if os.path.isabs(path) or clean == ".." or clean.startswith("../") or re.match(r"[A-Za-z]:", path):
        raise ValueError(f"path leaves the project: {path}")
    return clean


def load_project(path: str) -> Project:
    """Read a TOML file; unknown keys are kept by name, paths must stay inside."""
    data = tomllib.loads(Path(path).read_text("utf-8"))
    own = {k: v for k, v in data.items() if k in KEYS}
    for k, v in own.items():
        if k in ("types", "ignore", "ignore_orphans", "exclude"):
            if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
                raise ValueError(f"{k} must be a list of strings")
            own[k] = tuple(v)
        elif not isinstance(v, str):
            raise ValueError(f"{k} must be a string")
    for k in ("corpus", "output"):
        if k in own:
            own[k] = safe_relative(own[k])
    if own.get("spec", "0.2") not in SPECS:
        raise ValueError(f"unknown spec: {own['spec']}")
    unknown = tuple(sorted(k for k in data if k not in KEYS and k != "tool"))
    return Project(root=os.path.dirname(os.path.abspath(path)), unknown=unknown, **own)


def discover_project(start: str, config: str = "project.toml") -> Project:
    """The nearest project at or above ``start``."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / config).is_file():
            return load_project(str(folder / config))
    raise FileNotFoundError(f"no {config} at or above {start}")


def _skip(rel: Column, project: Project) -> Column:
    hidden = F.exists(F.split(F.regexp_replace(rel, r"/[^/]*\z", ""), "/"), lambda s: s.startswith("."))
    out = os.path.relpath(os.path.join(project.root, project.output), project.dir)
    tests = [hidden] + [rel.rlike(glob_regex(g)) for g in project.ignore]
    if not out.startswith(".."):
        tests.append(rel.startswith(f"/{out}/"))
    return reduce(lambda a, b: a | b, tests)


_FILES = "path string, content binary, modified timestamp"


def _listed(spark: SparkSession, folder: str, suffix: str = "", contents: bool = True) -> DataFrame:
    """``(path, content, modified)`` of a folder all executors see; paths begin with a slash below it.

    The driver lists names, in sorted order, and the executors read the files.
    Spark's own file source would pass over hidden and empty files. A folder with
    a scheme (``hdfs://`` …) is left to that source all the same.
    """
    if "://" in folder:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
        return df.select(F.substr("path", F.lit(len(folder.rstrip("/")) + 1)).alias("path"), "content", F.col("modificationTime").alias("modified"))
    base = os.path.abspath(folder)
    names = sorted(os.path.join(at, n)[len(base) :].replace(os.sep, "/") for at, _, files in os.walk(base) for n in files if n.endswith(suffix))
    plan = spark.createDataFrame([(n,) for n in names], "path string")
    if not contents:
        return plan
    spread = plan.repartition(max(1, min(len(names) // 64 + 1, 4096)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with open(base + name, "rb") as f:
                    data, at = f.read(), os.fstat(f.fileno()).st_mtime_ns // 1000
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([at], pa.timestamp("us", "UTC"))], names=["path", "content", "modified"])

    return spread.mapInArrow(read, _FILES)


def refuse_links(folder: str) -> None:
    for at, dirs, names in os.walk(folder):
        for n in dirs + names:
            if os.path.islink(os.path.join(at, n)):
                raise ValueError(f"symbolic link in the corpus: {os.path.join(at, n)}")


def corpus_files(spark: SparkSession, project: Project) -> DataFrame:
    """``(path, content, modified)`` of the corpus: Markdown files (``.md`` exactly) outside hidden, ignored and output folders."""
    refuse_links(project.dir)
    df = _listed(spark, project.dir, ".md").select("path", F.decode("content", "UTF-8").alias("content"), "modified")
    return df.where(~_skip(F.col("path"), project))


def assets(spark: SparkSession, project: Project) -> DataFrame:
    """``(path)`` of all other files a link may name; contents are not read."""
    return _listed(spark, project.dir, contents=False).where(~F.col("path").endswith(".md") & ~_skip(F.col("path"), project))


def compiled_corpus(files: DataFrame, max_docs: int | None = None, max_bytes: int | None = None, max_each: int | None = None) -> DataFrame:
    """``(path, content)`` with valid UTF-8, LF line ends and a final LF.

    The limits are gates that raise, not filters: no document is dropped.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.when(text.isNull(), F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string")).otherwise(text)
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    out = files.select("path", F.when(lf.endswith("\n") | (lf == ""), lf).otherwise(F.concat(lf, F.lit("\n"))).alias("content"))
    if (max_docs, max_bytes, max_each) != (None, None, None):
        size = F.octet_length("content").cast("long")
        r = out.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.max(size).alias("m")).first()
        for name, limit, got in (("documents", max_docs, r.n), ("bytes", max_bytes, r.b or 0), ("bytes in one document", max_each, r.m or 0)):
            if limit is not None and got > limit:
                raise ValueError(f"{got} {name}; the limit is {limit}")
    return out


# --- ignore files ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file: where it applies, what it matches, whether it takes back."""

    domain: str
    regex: str
    negated: bool
    folders_only: bool


def parse_ignore(text: str, domain: str = "") -> list[IgnoreRule]:
    """The rules of an ignore file in the folder ``domain`` (relative, no slashes around)."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +\Z", "", line.rstrip("\r"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        if line.startswith(("\\#", "\\!")):
            line = line[1:]
        folders_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        parts = [p for p in line.split("/") if p]
        if not parts:
            continue
        inside = parts[-1] == "**"
        body = glob_regex("/".join(parts[:-1] if inside and len(parts) > 1 else parts))
        body = body.removeprefix(r"\A").removesuffix(r"\z")
        if inside and len(parts) > 1:
            body += "/.+"
        prefix = "/" + re.escape(domain) if domain else ""
        rules.append(IgnoreRule(domain, rf"\A{prefix}{'' if anchored else '(?:/[^/]+)*'}{body}\z", negated, folders_only))
    return rules


def ignored(path: Column | str, rules: Sequence[IgnoreRule]) -> Column:
    """Whether a file (relative path) is ignored: the last matching rule decides, an ignored folder takes all below it."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(F.regexp_replace(p, r"\A/+", ""), "/")

    def verdict(full: Column, is_folder: Column) -> Column:
        out = F.lit(False)
        for r in rules:  # a later rule wraps, and so overrides, the earlier ones
            hit = full.rlike(r.regex) & (is_folder if r.folders_only else F.lit(True))
            out = F.when(hit, F.lit(not r.negated)).otherwise(out)
        return out

    n = F.size(parts)
    return F.exists(F.sequence(F.lit(1), n), lambda k: verdict(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")), k < n))


def read_ignore_rules(root: str, names: Iterable[str] = (".gitignore",)) -> list[IgnoreRule]:
    """The rules of all ignore files of a tree, outer folders first, in the order of ``names``."""
    rules: list[IgnoreRule] = []
    for at, dirs, files in sorted(os.walk(root)):
        domain = os.path.relpath(at, root).replace(os.sep, "/")
        for name in names:
            if name in files:
                rules += parse_ignore(Path(at, name).read_text("utf-8", "replace"), "" if domain == "." else domain)
    return rules


def source_files(spark: SparkSession, root: str, rules: Sequence[IgnoreRule] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """``(path, content)`` of a source tree, without ignored and excluded files; paths are relative."""
    df = _listed(spark, root).select(F.substr("path", F.lit(2)).alias("path"), "content")
    for x in exclude:
        x = safe_relative(x)
        df = df.where((F.col("path") != x) & ~F.col("path").startswith(x + "/"))
    return df.where(~ignored("path", rules)) if rules else df


URL = r"https?://[^\s\"'<>`“”‘’]+"


def literal_urls(sources: DataFrame) -> DataFrame:
    """``(path, line_no, url)``: URLs written in source files, trailing punctuation dropped."""
    rows = sources.select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n", -1)).alias("_p", "line")).where(F.col("line").contains("://"))
    found = rows.select("path", (F.col("_p") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(URL), F.lit(0))).alias("url"))
    return found.select("path", "line_no", F.regexp_replace("url", r"[.,;:!?)\]}]+\z", "").alias("url")).where(F.col("url").rlike(r"\Ahttps?://."))


# --- locks and ledgers -----------------------------------------------------------------------------------------------

INVENTORY = "path string, type string, bytes long, sha256 string"


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """The inventory of a lock file of version "0"; paths must stay inside, digests be SHA-256."""
    data = json.loads(Path(path).read_text("utf-8"))
    if data.get("version") != "0":
        raise ValueError(f"unknown lock version: {data.get('version')}")
    rows = []
    for p, f in data.get("files", {}).items():
        if safe_relative(p) != p or not re.fullmatch(r"[0-9a-f]{64}", f.get("sha256", "")):
            raise ValueError(f"bad lock entry: {p}")
        rows.append((p, f.get("type"), f.get("bytes"), f["sha256"]))
    return spark.createDataFrame(rows, INVENTORY)


def write_lock(inventory: DataFrame, path: str, revision: str = "", replace: bool = False) -> None:
    """Write an inventory as a lock file, sorted; an existing one is only replaced on demand."""
    files = {r["path"]: {"type": r["type"], "bytes": r["bytes"], "sha256": r["sha256"]} for r in inventory.orderBy("path").toLocalIterator()}
    text = json.dumps({"version": "0", "revision": revision, "files": files}, indent=2, ensure_ascii=False) + "\n"
    if replace:
        from vellumgrid.operators.rewrite import write_file

        write_file(path, text)
    else:
        # written beside and linked: the lock is whole or not there, and an existing one stays
        temp = f"{path}.{uuid.uuid4().hex}"
        try:
            with open(temp, "x", encoding="utf-8") as f:
                f.write(text)
            os.link(temp, path)
        finally:
            os.unlink(temp)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of generated files as a ledger of version "0" lists them; no file is an empty ledger."""
    if not os.path.exists(path):
        return spark.createDataFrame([], "path string, sha256 string")
    data = json.loads(Path(path).read_text("utf-8"))
    if data.get("version") != "0" or not isinstance(data.get("files"), dict):
        raise ValueError("unknown ledger")
    for p, digest in data["files"].items():
        if safe_relative(p) != p or not re.fullmatch(r"[0-9a-f]{64}", str(digest)):
            raise ValueError(f"bad ledger entry: {p}")
    return spark.createDataFrame(list(data["files"].items()), "path string, sha256 string")


#: Bytes of one published file.
PUBLISHED_BYTES = 64 << 20


def publication(spark: SparkSession, folder: str, limit: int = PUBLISHED_BYTES) -> DataFrame:
    """``(path, bytes, sha256, content)`` of a publication in a folder; a file beyond ``limit`` bytes is refused, none is cut."""
    size = F.octet_length("content").cast("long")
    content = F.when(size > limit, F.raise_error(F.concat(F.lit("too large: "), F.col("path"))).cast("binary")).otherwise(F.col("content"))
    return _listed(spark, folder).select("path", size.alias("bytes"), F.sha2(content, 256).alias("sha256"), content.alias("content"))


def read_data(path: str) -> dict:
    """A JSON object for templates; anything else is refused."""
    data = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not an object")
    return data


def head_revision(root: str) -> str:
    """The commit a work tree stands at, read from its repository's files; empty if there is none."""
    git = Path(root, ".git")
    try:
        head = (git / "HEAD").read_text("utf-8").strip()
        if not head.startswith("ref: "):
            return head
        name = head.removeprefix("ref: ")
        if (git / name).is_file():
            return (git / name).read_text("utf-8").strip()
        packed = (git / "packed-refs").read_text("utf-8").splitlines()
        return next((x.split()[0] for x in packed if x.endswith(f" {name}")), "")
    except OSError:
        return ""


def quarantine_lines(found: DataFrame, existing: str) -> list[str]:
    """Ignore patterns, one a quarantined path, that the ignore file doesn't hold yet."""
    have = set(existing.splitlines())
    new = ("/" + re.sub(r"([\\*?\[\] !#])", r"\\\1", r["path"]) for r in found.select("path").distinct().orderBy("path").toLocalIterator())
    return [x for x in new if x not in have]
