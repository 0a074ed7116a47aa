"""Inventories, drift, health, merge plans, ledgers, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions.paths import basename


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The source type of each file extension.
EXTENSIONS = {
    "c": "c",
    "h": "c",
    "cc": "cpp",
    "cpp": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "cs": "csharp",
    "css": "css",
    "go": "go",
    "graphql": "graphql",
    "html": "html",
    "htm": "html",
    "java": "java",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "json": "json",
    "kt": "kotlin",
    "md": "markdown",
    "markdown": "markdown",
    "php": "php",
    "proto": "protobuf",
    "py": "python",
    "rb": "ruby",
    "rs": "rust",
    "scss": "scss",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "fish": "shell",
    "sql": "sql",
    "svelte": "svelte",
    "swift": "swift",
    "toml": "toml",
    "ts": "typescript",
    "tsx": "typescript",
    "vue": "vue",
    "xml": "xml",
    "yaml": "yaml",
    "yml": "yaml",
}
# The source type of whole file names.
FILE_NAMES = {
    "Dockerfile": "dockerfile",
    "Containerfile": "dockerfile",
    "Makefile": "make",
    "GNUmakefile": "make",
    ".gitignore": "ignore",
}
# Folders of dependencies and caches anywhere, of builds at the root.
DEPENDENCY_FOLDERS = (".git", "node_modules", "vendor", ".cache", ".next", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox")
BUILD_FOLDERS = ("target", "build", "dist", "out", "bin", "obj", "coverage")
# Names and suffixes of credential files, and the reason each gives.
SECRET_NAMES = {
    "environment_credentials": (".env", ".envrc"),
    "credential_filename": (".netrc", ".npmrc", ".pypirc", ".pgpass", ".git-credentials", ".htpasswd", "credentials", "credentials.json", "service-account.json", "serviceaccount.json"),
    "private_key_filename": ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"),
}
SAMPLE_SUFFIXES = (".example", ".sample", ".template", ".defaults")
CONTAINER_SUFFIXES = (".key", ".p12", ".pfx", ".jks", ".keystore", ".ppk")
# Kinds of private key blocks.
KEY_BLOCKS = ("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def source_type(path: Column | str, ignore_files: tuple[str, ...] = ()) -> Column:
    """The kind of a file by its name or extension, else ``other``."""
    name = basename(path)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))
    by_name = FILE_NAMES | dict.fromkeys(ignore_files, "ignore")
    look = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return F.coalesce(look(by_name, name), look(EXTENSIONS, ext), F.lit("other"))


def pruned(path: Column | str, own_folders: tuple[str, ...] = ()) -> Column:
    """Whether a file lies in a dependency folder (anywhere) or a build folder (at the root)."""
    folders = F.split(F.regexp_replace(F.regexp_replace(_c(path), r"\A/+", ""), r"/?[^/]*\z", ""), "/")
    return F.arrays_overlap(folders, F.array(*map(F.lit, DEPENDENCY_FOLDERS + tuple(own_folders)))) | F.coalesce(F.get(folders, 0).isin(*BUILD_FOLDERS), F.lit(False))


def secret_name(path: Column | str) -> Column:
    """Why a file's name suggests credentials, or NULL; samples of environment files are none."""
    name = F.translate(basename(path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    exact = [(name.isin(*names), F.lit(reason)) for reason, names in SECRET_NAMES.items()]
    env = name.startswith(".env.") & (F.length(name) > 5)
    rest = [
        (env & _any([name.endswith(x) for x in SAMPLE_SUFFIXES]), F.lit(None).cast("string")),
        (env, F.lit("environment_credentials")),
        (_any([name.endswith(x) for x in CONTAINER_SUFFIXES]), F.lit("private_key_container")),
    ]
    cases = exact + rest
    return reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))


def secret_content(content: Column | str) -> Column:
    """``private_key_block`` if the text holds a complete private key."""
    whole = [_c(content).contains(f"-----BEGIN {kind}-----") & _c(content).contains(f"-----END {kind}-----") for kind in KEY_BLOCKS]
    return F.when(_any(whole), "private_key_block")


def is_binary(data: Column | str) -> Column:
    """A NUL among the first 8 KiB."""
    return F.position(F.lit(b"\x00"), F.substring(_c(data), 1, 8192)) > 0


def inventory(files: DataFrame, path: str = "path", content: str = "content", max_bytes: int = 5 << 20) -> tuple[DataFrame, DataFrame]:
    """``(inventory, quarantine)`` of ``(path, content)``: what may be read, and what is kept out and why."""
    c = F.col(content)
    data = c.cast("binary")
    text = F.try_validate_utf8(c.cast("string")) if dict(files.dtypes)[content] == "binary" else c
    reason = F.coalesce(
        F.when(pruned(path), "pruned"),
        secret_name(path),
        F.when(F.octet_length(data) > max_bytes, "too_large").when(is_binary(data), "binary"),
        secret_content(text),
    )
    rows = files.where(c.isNotNull()).select(F.col(path).alias("path"), source_type(path).alias("type"), F.octet_length(data).cast("long").alias("bytes"), F.sha2(data, 256).alias("sha256"), reason.alias("reason"))
    kept = rows.where(F.col("reason").isNull()).drop("reason")
    return kept, rows.where(F.col("reason").isNotNull() & (F.col("reason") != "pruned")).select("path", "reason")


def drift(base: DataFrame, now: DataFrame, *key: str, digest: str = "sha256") -> DataFrame:
    """``(key..., status)`` of rows added, removed or modified between two inventories."""
    b, n = (d.select(*key, F.col(digest).alias(x), F.lit(True).alias(f"_{x}")) for d, x in ((base, "b"), (now, "n")))
    both = b.join(n, list(key), "full")
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("n")), "modified")
    return both.select(*key, status.alias("status")).where(F.col("status").isNotNull())


def affected(resources: DataFrame, source: str) -> DataFrame:
    """Documents one of whose resources (from the project root) is ``source``."""
    if "://" in source or not source.strip("/"):
        raise ValueError(f"not a project path: {source}")
    return resources.where(F.col("resource") == source.strip("/")).select("path").distinct()


#: Health signals in the order they are reported.
SIGNALS = ("missing_sources", "source_missing", "source_not_in_baseline", "source_changed", "orphan", "unreachable")


def health(docs: DataFrame, resources: DataFrame, base: DataFrame, now: DataFrame, orphan: DataFrame, unreach: DataFrame, *key: str) -> DataFrame:
    """``(key..., path, signal, source)``: what needs attention.

    ``docs(key..., path)``, ``resources(key..., path, resource)`` with NULL for one
    outside the project; ``base`` and ``now`` are inventories ``(key..., path,
    sha256)``. Unreachable documents that are orphans count as orphans only;
    ``/index.md`` needs no sources.
    """
    k = list(key)
    b, n = (d.select(*k, F.col("path").alias("resource"), F.col("sha256").alias(x), F.lit(True).alias(f"in_{x}")) for d, x in ((base, "b"), (now, "n")))
    r = resources.where(F.col("resource").isNotNull()).select(*k, "path", "resource").distinct().join(b, k + ["resource"], "left").join(n, k + ["resource"], "left")
    signal = (
        F.when(F.col("in_n").isNull(), "source_missing")
        .when(F.col("in_b").isNull(), "source_not_in_baseline")
        .when(~F.col("b").eqNullSafe(F.col("n")), "source_changed")
    )
    of_sources = r.select(*k, "path", signal.alias("signal"), F.col("resource").alias("source")).where(F.col("signal").isNotNull())
    none = lambda d, s: d.select(*k, "path", F.lit(s).alias("signal"), F.lit("").alias("source"))
    bare = docs.where(F.col("path") != "/index.md").join(resources, k + ["path"], "left_anti")
    lone = orphan.select(*k, "path")
    return of_sources.unionByName(none(bare, "missing_sources")).unionByName(none(lone, "orphan")).unionByName(none(unreach.join(lone, k + ["path"], "left_anti"), "unreachable"))


def health_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def signal_rank(signal: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, SIGNALS)), _c(signal))


def merge_plan(base: DataFrame, draft: DataFrame, current: DataFrame, generated: DataFrame, *key: str) -> DataFrame:
    """``(key..., change)`` of a three-way check-in: ``apply``, ``workspace``, ``converged`` or ``conflict``.

    A path changed in the draft conflicts if it is generated or changed otherwise
    in the workspace; changed in the workspace alone it stays.
    """
    k = list(key)
    side = lambda d, x: d.select(*k, F.col("sha256").alias(x))
    rows = side(base, "b").join(side(draft, "d"), k, "full").join(side(current, "c"), k, "full").join(generated.select(*k).distinct().withColumn("g", F.lit(True)), k, "left")
    drafted, moved = ~F.col("d").eqNullSafe(F.col("b")), ~F.col("c").eqNullSafe(F.col("b"))
    change = (
        F.when(drafted & F.col("g").isNotNull(), "conflict")
        .when(drafted & moved & F.col("d").eqNullSafe(F.col("c")), "converged")
        .when(drafted & moved, "conflict")
        .when(drafted, "apply")
        .when(moved, "workspace")
    )
    return rows.select(*k, change.alias("change")).where(F.col("change").isNotNull())


def ledger_plan(old: DataFrame, new: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """``(key..., action)`` for generated files: ``write``, ``delete``, ``edited`` or ``overwrite`` (the last two are refusals).

    ``old`` and ``new`` are ledgers, ``existing`` the files there are, all with ``sha256``.
    """
    k = list(key)
    side = lambda d, x: d.select(*k, F.col("sha256").alias(x), F.lit(True).alias(f"in_{x}"))
    rows = side(old, "o").join(side(new, "n"), k, "full").join(side(existing, "e"), k, "left")
    action = (
        F.when(F.col("in_o").isNotNull() & F.col("in_e").isNotNull() & ~F.col("o").eqNullSafe(F.col("e")), "edited")
        .when(F.col("in_n").isNull() & F.col("in_e").isNotNull(), "delete")
        .when(F.col("in_o").isNull() & F.col("in_e").isNotNull() & ~F.col("n").eqNullSafe(F.col("e")), "overwrite")
        .when(F.col("in_n").isNotNull() & (F.col("in_e").isNull() | ~F.col("n").eqNullSafe(F.col("e"))), "write")
    )
    return rows.select(*k, action.alias("action")).where(F.col("action").isNotNull())


def verify_manifest(declared: DataFrame, files: DataFrame, *key: str) -> DataFrame:
    """``(key..., problem)``: ``missing``, ``mismatch`` or ``undeclared`` between declared digests and real bytes."""
    k = list(key)
    d = declared.select(*k, F.lower("sha256").alias("want"), F.lit(True).alias("_d"))
    f = files.select(*k, F.sha2(F.col("content").cast("binary"), 256).alias("have"), F.lit(True).alias("_f"))
    rows = d.join(f, k, "full")
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_d").isNull(), "undeclared").when(~F.col("want").eqNullSafe(F.col("have")), "mismatch")
    return rows.select(*k, problem.alias("problem")).where(F.col("problem").isNotNull())


def collisions(docs: DataFrame, key: Column, *group: str) -> DataFrame:
    """``(group..., key, n)``: paths that fall together under ``key``."""
    return docs.groupBy(*group, key.alias("key")).agg(F.count_distinct("path").alias("n")).where(F.col("n") > 1)


def budgets(docs: DataFrame, *group: str) -> DataFrame:
    return docs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("content").cast("long")).alias("n_bytes"), F.max(F.octet_length("content").cast("long")).alias("largest"), F.max(utf16_length("content").cast("long")).alias("longest"))


def utf16_length(text: Column | str) -> Column:
    return F.octet_length(F.encode(_c(text), "UTF-16LE")) / 2


def valid_hash(digest: Column | str) -> Column:
    return _c(digest).rlike(r"\A[0-9a-f]{64}\z")


def merged_coverage(blocks: DataFrame) -> DataFrame:
    """``blocks(file, span, statements, hits)`` merged: per file the statements and the covered ones; a block is covered if any run hit it."""
    once = blocks.groupBy("file", "span").agg(F.max("hits").alias("hits"), F.min("statements").alias("low"), F.max("statements").alias("high"))
    checked = once.withColumn("n", F.when(F.col("low") == F.col("high"), F.col("high")).otherwise(F.raise_error(F.concat(F.lit("inconsistent block "), F.col("file"), F.lit(":"), F.col("span"))).cast("long")))
    return checked.groupBy("file").agg(F.sum("n").alias("statements"), F.sum(F.when(F.col("hits") > 0, F.col("n")).otherwise(0)).alias("covered"))


# --- publications --------------------------------------------------------------------------------------------------


def _clean(path: Column) -> Column:
    """No empty, ``.`` or ``..`` part."""
    return ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))


def document_path(path: Column | str) -> Column:
    """Whether a path may name a published document: from the root, clean, ``.md``, without backslash, hash or query."""
    p = _c(path)
    return F.coalesce(p.startswith("/") & ~p.rlike(r"[\\#?]") & _clean(F.regexp_replace(p, r"\A/", "")) & F.lower(p).endswith(".md"), F.lit(False))


def artifact_path(path: Column | str) -> Column:
    """Whether a path may name another published file: relative, clean, nothing hidden, no control character, none of the names of documents and manifests."""
    p = _c(path)
    name = F.lower(p)
    ok = ~p.startswith("/") & ~p.rlike(r"[\\#?%]") & ~p.rlike(r"\p{Cc}") & _clean(p) & ~F.exists(F.split(p, "/"), lambda x: x.startswith("."))
    return F.coalesce(ok & ~name.isin("graph.json", "llms.txt") & ~name.endswith(".md"), F.lit(False))


def graph_address(url: Column | str) -> Column:
    """Whether a URL is the canonical address of a published graph: https, lower-case host, a clean path to ``graph.json``, nothing behind it."""
    u = _c(url)
    path = F.regexp_extract(u, r"\Ahttps://[^/?#@]+/(.*)\z", 1)
    host = F.regexp_extract(u, r"\Ahttps://([^/?#@]+)/", 1)
    return F.coalesce((host != "") & (host == F.lower(host)) & ~path.rlike(r"[?#]") & _clean(path) & F.lower(F.concat(F.lit("/"), path)).endswith("/graph.json"), F.lit(False))


def reference_issues(refs: DataFrame, *key: str) -> DataFrame:
    """``(key..., pos, rule)`` of external references ``(key..., pos, from, line, url, origin, root, sha256)`` listed by ``pos``.

    Order is by declaring file, line, address and origin; each address may occur once.
    """
    k = list(key)
    rank = F.struct(F.col("from"), F.col("line"), F.col("url"), F.col("origin"))
    order = Window.partitionBy(*k).orderBy("pos")
    once = F.row_number().over(Window.partitionBy(*k, "url").orderBy("pos"))
    bad_name = (F.col("from") == "") | F.col("from").contains("\\") | F.col("from").contains("..") | F.col("from").rlike(r"\p{Cc}")
    rows = refs.withColumn("_before", F.lag(rank).over(order)).withColumn("_n", once)
    rules = F.array(
        F.when(~graph_address("url") | (F.col("root") != "/index.md"), "address"),
        F.when(F.col("_n") > 1, "repeated address"),
        F.when(~valid_hash("sha256"), "hash"),
        F.when(bad_name, "declaring file"),
        F.when(~F.col("origin").isin("corpus", "source"), "origin"),
        F.when(F.col("line") < 1, "line"),
        F.when(F.col("_before") > rank, "order"),
    )
    return rows.select(*k, "pos", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


def publication_issues(declared: DataFrame, files: DataFrame, *key: str) -> DataFrame:
    """``(key..., path, problem)`` of a publication: bad names, and files missing, changed or not declared.

    ``declared(key..., path, kind, sha256)`` with kind ``document`` or
    ``artifact``; ``files(key..., path, sha256)`` are those there are.
    """
    k = [*key, "path"]
    named = declared.select(*k, F.when((F.col("kind") == "document") & ~document_path("path") | (F.col("kind") == "artifact") & ~artifact_path("path"), "bad path").when(~valid_hash("sha256"), "bad hash").alias("problem"))
    d = declared.select(*k, F.col("sha256").alias("_d"), F.lit(True).alias("_in_d"))
    f = files.select(*k, F.col("sha256").alias("_f"), F.lit(True).alias("_in_f"))
    state = F.when(F.col("_in_f").isNull(), "missing").when(F.col("_in_d").isNull(), "undeclared").when(~F.col("_d").eqNullSafe(F.col("_f")), "mismatch")
    return named.unionByName(d.join(f, k, "full").select(*k, state.alias("problem"))).where(F.col("problem").isNotNull())


def label_changes(derived: DataFrame, current: DataFrame, *key: str, prefix: str = "", complete: bool = True) -> DataFrame:
    """``(key..., label, change)``: labels to ``add``, and those with ``prefix`` to ``remove`` where what was derived is complete."""
    k = [*key, "label"]
    d, c = derived.select(*k).distinct(), current.where(F.col("label").startswith(prefix)).select(*k).distinct()
    add = d.join(c, k, "left_anti").withColumn("change", F.lit("add"))
    return add.unionByName(c.join(d, k, "left_anti").withColumn("change", F.lit("remove"))) if complete else add
