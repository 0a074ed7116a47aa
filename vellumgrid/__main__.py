"""``python -m vellumgrid [--root DIR] COMMAND …``: the corpus commands on the command line."""

from __future__ import annotations

import argparse
import sys

from vellumgrid import sinks
from vellumgrid.commands import CommandError, Corpus, init
from vellumgrid.runtime import session
from vellumgrid.sources.files import discover_project, head_revision, write_lock


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vellumgrid", description="Query a Markdown corpus with Spark.")
    top.add_argument("--root", default=".", help="folder at or below the project")
    top.add_argument("--config", default="project.toml", help="name of the settings file")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, narrowed: bool = False, counted: bool = False, aliases: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        p = sub.add_parser(name, aliases=list(aliases))
        p.set_defaults(command=name)
        for a in args:
            p.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
        p.add_argument("--format", choices=("text", "json", "csv", "tsv"), default="text")
        if narrowed or counted:
            p.add_argument("--prefix")
            p.add_argument("--where", action="append", default=[])
        if counted:
            p.add_argument("--sort", choices=("name", "count"), default="name")
        return p

    command("status")
    p = command("list", narrowed=True, aliases=("ls",))
    p.add_argument("--sort", choices=("path", "timestamp"), default="path")
    p.add_argument("--reverse", action="store_true")
    for name in ("read", "outline", "links", "backlinks", "affected"):
        command(name, "name")
    command("table", "name").add_argument("--n", type=int)
    p = command("search", "query", narrowed=True)
    p.add_argument("--any", action="store_true")
    p.add_argument("--exact", action="store_true")
    p.add_argument("--lines", action="store_true")
    p = command("checkboxes", "name?", narrowed=True)
    p.add_argument("--all", action="store_true")
    p.add_argument("--done", action="store_true")
    command("tags", counted=True)
    command("properties", counted=True)
    command("property", "name", counted=True)
    for name in ("unresolved", "orphans", "gate", "publish", "references"):
        command(name)
    command("check").add_argument("--fix", action="store_true")
    p = command("set", "name", "field")
    p.add_argument("value", nargs="*")
    p.add_argument("--list", action="store_true")
    command("checkout", "folder")
    command("checkin", "folder").add_argument("--apply", action="store_true")
    p = command("tidy")
    for f in ("links", "slug", "wikilinks"):
        p.add_argument(f"--{f}", action="store_true")
    p = command("move", "old", "new", aliases=("mv",))
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--references", action="store_true", help="respell frontmatter references too")
    p = command("scan")
    p.add_argument("--lock", default="sources.lock.json")
    p.add_argument("--quarantine", metavar="IGNORE_FILE", help="append what is kept out to this ignore file")
    p.add_argument("--accept", action="store_true")
    for name in ("drift", "health"):
        command(name).add_argument("--lock", default="sources.lock.json" if name == "drift" else None)
    command("manifest")
    command("init", "name")
    command("llms")
    return top


def run(spark, a: argparse.Namespace) -> int:
    """Print the command's result; the exit code is 0, 1 for a negative answer, 2 for a refusal."""
    c = Corpus(spark, discover_project(a.root, a.config))
    narrowed = {k: getattr(a, k) for k in ("prefix", "where") if hasattr(a, k)}
    code = 0
    if a.command == "list":
        df = c.list(sort=a.sort, reverse=a.reverse, **narrowed)
    elif a.command == "search":
        if a.any and a.exact:
            raise CommandError("--any and --exact exclude each other")
        df = c.search(a.query, "any" if a.any else "exact" if a.exact else "all", a.lines, **narrowed)
        code = int(df.isEmpty())
    elif a.command == "checkboxes":
        df = c.checkboxes(a.name, None if a.all else a.done, **narrowed)
    elif a.command in ("tags", "properties"):
        df = getattr(c, a.command)(by=a.sort, **narrowed)
    elif a.command == "property":
        df = c.property(a.name, a.sort, **narrowed)
    elif a.command == "table":
        df = c.table(a.name, a.n)
    elif a.command in ("read", "outline", "backlinks", "affected"):
        df = getattr(c, a.command)(a.name)
    elif a.command == "links":
        df = c.outgoing(a.name)
    elif a.command == "tidy":
        some = a.links or a.slug or a.wikilinks
        df = c.tidy(a.links or not some, a.slug or not some, a.wikilinks or not some).cache()
        sinks.write_rows(df, sys.stdout, a.format)
        if some:  # without a choice it only shows
            c.apply_tidy(a.links, a.slug, a.wikilinks)
        return 0
    elif a.command == "move":
        df = c.move(a.old, a.new, a.references).cache()
        sinks.write_rows(df, sys.stdout, a.format)
        if not a.dry_run:
            c.apply_move(a.old, a.new, a.references)
        return 0
    elif a.command == "set":
        c.set_fields(a.name, {a.field: a.value if a.list else a.value[0] if a.value else None})
        return 0
    elif a.command in ("checkout", "checkin"):
        df = c.checkout(a.folder) if a.command == "checkout" else c.checkin(a.folder, a.apply)
    elif a.command == "publish":
        print(c.publish())
        return 0
    elif a.command == "references":
        df = c.external_references()
    elif a.command == "scan":
        kept, out = c.inventory()
        write_lock(kept, a.lock, head_revision(c.project.root), replace=a.accept)
        if a.quarantine:
            c.quarantine(a.quarantine)
        df = out.orderBy("path")
    elif a.command in ("drift", "health"):
        df = getattr(c, a.command)(a.lock)
    elif a.command == "check" and a.fix:
        df = c.fix()
    elif a.command == "check":
        df = c.check().cache()
        code = int(not df.where("level = 'error'").isEmpty())
    elif a.command == "gate":
        df = c.gate()
        code = int(not df.isEmpty())
    elif a.command == "manifest":
        print(sinks.graph_json(*c.manifest()), end="")
        return 0
    elif a.command == "llms":
        files, nav = c.manifest()
        from vellumgrid.operators.graph import reading_order

        print(sinks.llms_txt(c.project.name, reading_order(c.files, c.links).join(files.select("path", "title"), "path")), end="")
        return 0
    else:
        df = getattr(c, a.command)()
    sinks.write_rows(df, sys.stdout, a.format)
    return code


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "init":
        print(*init(a.root, a.name, a.config), sep="\n")
        return 0
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, a)
    except CommandError as e:
        print(e, file=sys.stderr)
        return e.code
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
