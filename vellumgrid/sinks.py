"""Writing results: single files for people, Spark's writers for everything large."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import chain
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions.urls import link_label, link_target
from vellumgrid.operators.rewrite import write_file


def cell(value: Any) -> str:
    """A value as text: lists joined by ``; ``, NULL empty, booleans in lower case."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "; ".join(map(cell, value))
    return str(value)


def go_json(data: Any, indent: int | None = 2) -> str:
    """JSON that is safe inside HTML: ``<``, ``>``, ``&`` and the two line separators are escaped."""
    text = json.dumps(data, indent=indent, ensure_ascii=False)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text + "\n"


def write_rows(df: DataFrame, out: TextIO, form: str = "text") -> None:
    """A result as ``text``, ``json``, ``csv`` or ``tsv``, in the frame's order, one partition at a time.

    Only the aligned text form takes the rows twice, once for the widths.
    """
    names = df.columns
    rows = lambda: (r.asDict(recursive=True) for r in df.toLocalIterator())
    if form == "json":
        first = True
        for r in rows():
            item = go_json(r).rstrip("\n").replace("\n", "\n  ")
            out.write(("[\n  " if first else ",\n  ") + item)
            first = False
        out.write("[]\n" if first else "\n]\n")
    elif form == "text":
        width = [len(n.encode()) for n in names]
        for r in rows():
            width = [max(w, len(cell(r[n]).encode())) for w, n in zip(width, names)]
        for line in chain([names], ([cell(r[n]) for n in names] for r in rows())):
            out.write("  ".join(c + " " * (w - len(c.encode())) for c, w in zip(line, width)).rstrip() + "\n")
    elif form in ("csv", "tsv"):
        lines = csv.writer(out, delimiter="," if form == "csv" else "\t", lineterminator="\n")
        lines.writerow(names)
        lines.writerows([cell(r[n]) for n in names] for r in rows())
    else:
        raise ValueError(f"unknown format: {form}")


def emit(df: DataFrame, form: str = "text") -> str:
    """:func:`write_rows` as a string, for results people read."""
    out = io.StringIO()
    write_rows(df, out, form)
    return out.getvalue()


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A result of any size: parquet, json, csv or tsv parts; lists joined for the delimited forms."""
    if form in ("csv", "tsv"):
        flat = [F.array_join(F.transform(n, lambda x: x.cast("string")), "; ").alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
        df.select(*flat).write.csv(path, header=True, sep="," if form == "csv" else "\t")
    else:
        df.write.format(form).save(path)


#: Bytes of a graph manifest.
MANIFEST_BYTES = 32 << 20


def graph_json(files: DataFrame, nav: DataFrame, root: str = "/index.md", limit: int = MANIFEST_BYTES) -> str:
    """The manifest of one bundle: sorted files with title, size, digest and links; sorted navigation.

    It is refused as soon as it has more than ``limit`` bytes.
    """
    out: dict[str, Any] = {"version": "0", "root": root, "files": {}, "nav": {}}
    size = len(go_json(out).encode())

    def add(group: str, path: str, value: dict) -> None:
        nonlocal size
        out[group][path] = value
        size += len(json.dumps([path, value], ensure_ascii=False).encode())
        if size > limit:
            raise ValueError(f"the manifest has more than {limit} bytes")

    for r in files.orderBy("path").toLocalIterator():
        add("files", r["path"], {k: r[k] for k in ("title", "bytes", "sha256", "links") if k in files.columns})
    for r in nav.orderBy("path").toLocalIterator():
        add("nav", r["path"], {k: r[k] for k in nav.columns if k not in ("path", "bundle") and r[k] is not None})
    text = go_json(out)
    if len(text.encode()) > limit:
        raise ValueError(f"the manifest has more than {limit} bytes")
    return text


def write_json(path: str, data: Any) -> None:
    write_file(path, go_json(data))


def archive(folder: str, names: Sequence[str], path: str) -> None:
    """A zip of files below ``folder``: sorted, without times or modes, so that equal contents give equal bytes."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(names):
            with open(os.path.join(folder, name), "rb") as f:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f.read(), zipfile.ZIP_DEFLATED)


@contextmanager
def swapped(folder: str) -> Iterator[str]:
    """A new folder to fill; it takes the place of ``folder`` in the end, or nothing changes."""
    temp, old = f"{folder}.new-{uuid.uuid4().hex}", f"{folder}.old-{uuid.uuid4().hex}"
    os.makedirs(temp)
    try:
        yield temp
        had = os.path.exists(folder)
        if had:
            os.rename(folder, old)
        try:
            os.rename(temp, folder)
        except OSError:
            if had:
                os.rename(old, folder)
            raise
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(temp, ignore_errors=True)


def apply_files(pairs: Sequence[tuple[str, str]]) -> None:
    """Copy files over others, or delete those whose original is gone; if one fails, all are put back."""
    undo: list[tuple[str, bytes | None]] = []
    try:
        for source, target in pairs:
            was = None
            if os.path.exists(target):
                with open(target, "rb") as f:
                    was = f.read()
            undo.append((target, was))
            if not os.path.exists(source):
                os.remove(target)
                continue
            with open(source, encoding="utf-8", newline="") as f:
                text = f.read()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            write_file(target, text)
    except OSError:
        for target, was in reversed(undo):
            if was is None:
                if os.path.exists(target):
                    os.remove(target)
            else:
                with open(target, "wb") as f:
                    f.write(was)
        raise


def llms_lines(order: DataFrame) -> DataFrame:
    """``(seq, line)``: the reading order ``(path, seq, title)`` as Markdown list items."""
    target = F.regexp_replace("path", r"\A/", "")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\r\n]", " "))
    label = F.when(title == "", link_label(target)).otherwise(link_label(title))
    return order.select("seq", F.concat(F.lit("- ["), label, F.lit("]("), link_target(target), F.lit(")")).alias("line"))


def llms_txt(name: str, order: DataFrame) -> str:
    name = " ".join(name.split()) or "Corpus"
    items = [r["line"] for r in llms_lines(order).orderBy("seq").toLocalIterator()]
    text = f"# {name}\n\nAgent-native documentation corpus for {name}.\n\n- [Start](index.md)\n- [Manifest](graph.json)\n"
    return text + ("\n## Reading order\n\n" + "\n".join(items) + "\n" if items else "")
