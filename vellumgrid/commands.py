"""The corpus commands over a Markdown tree: each returns a DataFrame, or a plan and what applied it.

>>> c = Corpus(spark, discover_project("."))
>>> c.search("monthly rent", mode="any")
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid import sinks
from vellumgrid.functions.paths import basename, canonical_resource, normalise_link, relative_link
from vellumgrid.operators import checks, graph, parse, provenance, rewrite, search
from vellumgrid.sources import files as source
from vellumgrid.sources.files import Project

BUNDLE = "bundle"
#: What a draft started from, in its folder.
DRAFT = ".draft.json"


class CommandError(Exception):
    """A refusal; ``code`` is the exit code."""

    def __init__(self, message: str, code: int = 2):
        super().__init__(message)
        self.code = code


def init(folder: str, name: str, config: str = "project.toml") -> list[str]:
    """A new project: settings, a root document and a log; files that are there stay. The names written."""
    files = {
        config: f'name = "{name}"\ncorpus = "docs"\nspec = "0.2"\n',
        "docs/index.md": f'---\nokf_version: "{source.SPECS["0.2"]}"\n---\n# {name}\n',
        "docs/log.md": "# Log\n",
    }
    written = []
    for path, text in files.items():
        full = os.path.join(folder, path)
        if not os.path.exists(full):
            os.makedirs(os.path.dirname(full), exist_ok=True)
            rewrite.write_file(full, text)
            written.append(path)
    return written


def walk_key(path: Column | str) -> Column:
    """Sorts paths as a folder walk meets them: segment by segment."""
    return F.split(F.col(path) if isinstance(path, str) else path, "/")


class Corpus:
    """The relations of one project, built lazily and cached for the session's commands."""

    def __init__(self, spark: SparkSession, project: Project, files: DataFrame | None = None, assets: DataFrame | None = None):
        self.spark, self.project = spark, project
        self._files, self._assets = files, assets

    @cached_property
    def files(self) -> DataFrame:
        f = self._files if self._files is not None else source.corpus_files(self.spark, self.project)
        return f.withColumn(BUNDLE, F.lit(self.project.name)).cache()

    @cached_property
    def assets(self) -> DataFrame:
        return self._assets if self._assets is not None else source.assets(self.spark, self.project)

    @cached_property
    def entries(self) -> DataFrame:
        """``(bundle, path, modified, type, properties, …)``."""
        keep = [BUNDLE, "path"] + (["modified"] if "modified" in self.files.columns else [])
        return parse.entries(self.files, "content", *keep).withColumn("type", F.coalesce(F.get(checks.property("type"), 0), F.lit(""))).cache()

    @cached_property
    def headings(self) -> DataFrame:
        return parse.headings(self.files, "content", BUNDLE, "path")

    @cached_property
    def _inline(self) -> DataFrame:
        rows = parse.inline_links(self.files, "content", BUNDLE, "path").where(F.col("kind") != "external")
        return rows.withColumn("n", normalise_link("path", "raw")).cache()

    @cached_property
    def wikilinks(self) -> DataFrame:
        """``(bundle, path, line_no, pos, raw, name, anchor, display, embed, to)``: wikilinks and what they mean."""
        w = parse.wikilinks(self.files, "content", BUNDLE, "path").withColumn("wiki_id", F.xxhash64("path", "line_no", "pos"))
        aliases = graph.alias_map(parse.fm_values(self.entries, BUNDLE, "path"))
        found = graph.resolve_wikilinks(w.select(BUNDLE, F.col("path").alias("from_path"), "wiki_id", F.col("target").alias("name")), self.files, aliases)
        return w.withColumnRenamed("target", "name").join(found.select("wiki_id", F.col("path").alias("to")), "wiki_id").cache()

    @cached_property
    def links(self) -> DataFrame:
        """The edges: absolute, then relative links, then wikilinks; links that leave the corpus or only name an anchor are none."""
        inner = self._inline.where(F.col("kind").isin("absolute", "relative") & ~F.col("n.escapes"))
        bucket = F.when(F.col("kind") == "absolute", 0).otherwise(1)
        cols = [BUNDLE, F.col("path").alias("from_path")]
        md = inner.select(*cols, F.col("text").alias("link_text"), "raw", F.col("n.path").alias("target"), F.col("n.anchor").alias("anchor"), "line_no", F.lit(False).alias("wikilink"), bucket.alias("_b"), "pos")
        wiki = self.wikilinks.where(F.col("to").isNotNull()).select(*cols, F.when(F.col("display") != "", F.col("display")).otherwise(F.col("name")).alias("link_text"), "raw", F.col("to").alias("target"), F.col("anchor"), "line_no", F.lit(True).alias("wikilink"), F.lit(2).alias("_b"), "pos")
        order = Window.partitionBy("from_path").orderBy("_b", "line_no", "pos")
        return md.unionByName(wiki).withColumn("ord", F.row_number().over(order)).withColumn("link_id", F.xxhash64("from_path", "ord")).drop("_b", "pos").cache()

    @cached_property
    def known(self) -> DataFrame:
        """All paths a link may name: documents and other files."""
        return self.files.select(BUNDLE, "path").unionByName(self.assets.select(F.lit(self.project.name).alias(BUNDLE), "path"))

    @cached_property
    def resources(self) -> DataFrame:
        """``(bundle, path, resource)``: declared sources from the project root, NULL outside it."""
        doc = F.concat(F.lit(self._corpus_at), F.col("path"))
        return self.entries.select(BUNDLE, "path", F.explode("resources").alias("r"), doc.alias("_d")).select(BUNDLE, "path", canonical_resource("_d", "r").alias("resource"))

    # --- queries ---------------------------------------------------------------------------------------------------

    def _one(self, name: str) -> str:
        hits = [r.path for r in search.resolve(self.files.select("path"), name).limit(3).collect()]
        if len(hits) != 1:
            raise CommandError(f"{name}: " + ("no such document" if not hits else "ambiguous: " + ", ".join(sorted(hits))))
        return hits[0]

    def _narrowed(self, prefix: str | None, where: Sequence[str]) -> DataFrame:
        return search.list_entries(self.entries, prefix=prefix, where=list(where))

    def status(self) -> DataFrame:
        def n(df: DataFrame, name: str) -> DataFrame:
            return df.agg(F.count(F.lit(1)).alias(name))

        tags = parse.fm_values(self.entries, "path").where(F.col("key") == "tags").select("value").distinct()
        counts = [n(self.files, "entries"), n(self.links, "links"), n(tags, "tags"), n(parse.checkboxes(self.files, "content", "path"), "checkboxes"), n(self.unresolved(), "broken"), n(self.orphans(), "orphans")]
        out = self.spark.createDataFrame([(self.project.dir, self.project.spec)], "dir string, spec string")
        for c in counts:  # one row each
            out = out.crossJoin(F.broadcast(c))
        return out

    def list(self, prefix: str | None = None, where: Sequence[str] = (), sort: str = "path", reverse: bool = False) -> DataFrame:
        df = self._narrowed(prefix, where)
        if sort == "path":
            keys = [F.col("path").desc() if reverse else F.col("path").asc()]
        elif sort == "timestamp":  # newest first; the reverse turns the ties too
            stamp = F.get(checks.property("timestamp"), 0)
            at = F.when(checks.valid_timestamp(stamp), F.try_to_timestamp(stamp))
            at = F.coalesce(at, F.col("modified")) if "modified" in df.columns else at
            keys = [at.asc(), F.col("path").desc()] if reverse else [at.desc(), F.col("path").asc()]
        else:
            raise CommandError(f"unknown sort: {sort}")
        return df.orderBy(*keys).select(F.col("path").alias("_path"), "type")

    def read(self, name: str) -> DataFrame:
        return self.entries.where(F.col("path") == self._one(name)).select(F.col("path").alias("_path"), "type", "body")

    def outline(self, name: str) -> DataFrame:
        return self.headings.where(F.col("path") == self._one(name)).orderBy("line_no").select("level", "text", F.col("line_no").alias("line"))

    def table(self, name: str, n: int | None = None) -> DataFrame:
        cells = parse.table_cells(self.files.where(F.col("path") == self._one(name)), "content", "path").cache()
        count = cells.agg(F.max("table_n").alias("m")).first().m or 0
        if count == 0 or n is not None and not 1 <= n <= count:
            raise CommandError("no such table", 1)
        if n is None and count > 1:
            raise CommandError(f"{count} tables; say which")
        one = cells.where(F.col("table_n") == (n or 1))
        names = [r.header for r in one.where(F.col("row_n") == 1).orderBy("col_n").collect()]
        wide = one.groupBy("row_n").agg(F.array_sort(F.collect_list(F.struct("col_n", "cell"))).alias("c")).orderBy("row_n")
        return wide.select(*[F.get("c", i)["cell"].alias(h) for i, h in enumerate(names)])

    def search(self, query: str, mode: str = "all", lines: bool = False, prefix: str | None = None, where: Sequence[str] = ()) -> DataFrame:
        if not query.strip():
            raise CommandError("the query is blank")
        kept = self._narrowed(prefix, where).select("path", "type")
        if lines:
            hits = search.search_lines(self.files, "content", query, "path", mode=mode)
            return hits.join(kept, "path").orderBy("path", "line_no").select(F.col("path").alias("_path"), "type", F.col("line_no").alias("line"), F.col("line").alias("text"))
        return search.search(self.files, "content", query, "path", mode=mode).join(kept, "path").orderBy("path").select(F.col("path").alias("_path"), "type", "matches")

    def checkboxes(self, name: str | None = None, done: bool | None = False, prefix: str | None = None, where: Sequence[str] = ()) -> DataFrame:
        """Open ones; ``done``: ticked ones; NULL: all."""
        boxes = parse.checkboxes(self.files, "content", "path")
        boxes = boxes.where(F.col("path") == self._one(name)) if name else boxes.join(self._narrowed(prefix, where).select("path"), "path", "left_semi")
        if done is not None:
            boxes = boxes.where(F.col("done") == done)
        return boxes.orderBy(walk_key("path"), "line_no").select(F.col("path").alias("entry"), F.col("line_no").alias("line"), "done", "text")

    def property(self, name: str, by: str = "name", prefix: str | None = None, where: Sequence[str] = ()) -> DataFrame:  # noqa: A003
        return search.ordered_counts(search.value_counts(parse.fm_values(self._narrowed(prefix, where), "path"), name, "path"), by)

    def tags(self, **kw) -> DataFrame:
        return self.property("tags", **kw)

    def properties(self, by: str = "name", prefix: str | None = None, where: Sequence[str] = ()) -> DataFrame:
        return search.ordered_counts(search.value_counts(parse.fm_keys(self._narrowed(prefix, where), "path"), None, "path", column="key"), by)

    def unresolved(self) -> DataFrame:
        rows = graph.broken(self.links, self.known)
        return rows.orderBy(walk_key("from_path"), "line_no").select(F.col("from_path").alias("from"), F.col("target").alias("to"), F.col("line_no").alias("line"))

    def orphans(self) -> DataFrame:
        return graph.orphans(self.entries, self.links, self.project.ignore_orphans).orderBy("path").select(F.col("path").alias("_path"), "type")

    def unreachable(self) -> DataFrame:
        return graph.unreachable(self.files, self.links, globs=self.project.ignore_orphans).orderBy("path")

    def _as_refs(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("from_path").alias("from"), F.col("target").alias("to"), F.col("link_text").alias("text"), F.col("line_no").alias("line"))

    def outgoing(self, name: str) -> DataFrame:
        return self._as_refs(graph.outgoing(self.links.where(F.col("from_path") == self._one(name))).orderBy("ord"))

    def backlinks(self, name: str) -> DataFrame:
        return self._as_refs(graph.backlinks(self.links, self._one(name)).orderBy("from_path", "line_no"))

    # --- checks ----------------------------------------------------------------------------------------------------

    def check(self) -> DataFrame:
        """``(level, entry, msg)``."""
        rules = checks.document_issues(self.entries, "path", types=self.project.types or None).select("level", F.col("path").alias("entry"), F.col("rule").alias("msg"))
        anchors = self.headings.select(BUNDLE, "path", F.col("final_slug").alias("slug"))
        edges = checks.graph_issues(self.links, self.known, anchors)
        selves = self._inline.where(F.col("kind") == "self").select(BUNDLE, F.col("path").alias("from_path"), F.col("path").alias("target"), F.col("n.anchor").alias("anchor"))
        own = checks.graph_issues(selves, self.known, anchors)
        found = edges.unionByName(own).select("level", F.col("path").alias("entry"), F.concat_ws(" -> ", "rule", "detail").alias("msg"))
        warn = lambda df, msg: df.select(F.lit("warning").alias("level"), F.col("path").alias("entry"), msg.alias("msg"))
        outside = warn(self._inline.where(F.col("n.escapes") & ~F.col("raw").isin(*self.project.ignore)), F.concat(F.lit("out-of-bundle link -> "), F.col("raw")))
        wiki = warn(self.wikilinks.groupBy("path").agg(F.count(F.lit(1)).alias("n")), F.concat(F.col("n").cast("string"), F.lit(" wikilink(s)")))
        logs = warn(self.headings.where((basename("path") == "log.md") & checks.odd_date("text")), F.concat(F.lit("date is not ISO: "), F.col("text")))
        version = warn(checks.version_issues(self.entries.where(F.col("path") == "/index.md"), source.SPECS[self.project.spec]), F.col("rule"))
        keys = self.spark.createDataFrame([("warning", "", f"unknown setting: {k}") for k in self.project.unknown], "level string, entry string, msg string")
        out = keys
        for part in (rules, wiki, logs, found, outside, version):
            out = out.unionByName(part)
        return out.orderBy(walk_key("entry"), "level", "msg")

    # --- sources ---------------------------------------------------------------------------------------------------

    def inventory(self, ignore_files: Sequence[str] = (".gitignore",)) -> tuple[DataFrame, DataFrame]:
        """``(inventory, quarantine)`` of the project's sources, without its corpus and output."""
        return provenance.inventory(self._sources(ignore_files))

    def _sources(self, ignore_files: Sequence[str] = (".gitignore",)) -> DataFrame:
        root = self.project.root
        out = [x for x in (self.project.output, self.project.corpus, *self.project.exclude) if x != "."]
        return source.source_files(self.spark, root, source.read_ignore_rules(root, ignore_files), out)

    def quarantine(self, ignore_file: str = ".gitignore") -> list[str]:
        """Append the quarantined paths to an ignore file, each once; the lines added."""
        path = os.path.join(self.project.root, ignore_file)
        old = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
        new = source.quarantine_lines(self.inventory((ignore_file,))[1], old)
        if new:
            rewrite.write_file(path, old + ("\n" if old and not old.endswith("\n") else "") + "\n".join(new) + "\n")
        return new

    def drift(self, lock: str) -> DataFrame:
        return provenance.drift(source.read_lock(self.spark, lock), self.inventory()[0], "path").orderBy("path", "status")

    def health(self, lock: str | None = None) -> DataFrame:
        """``(document, signal, source, status)``."""
        now = self.inventory()[0].withColumn(BUNDLE, F.lit(self.project.name))
        base = source.read_lock(self.spark, lock).withColumn(BUNDLE, F.lit(self.project.name)) if lock else now
        lone, far = (d.select(F.lit(self.project.name).alias(BUNDLE), F.col("_path" if "_path" in d.columns else "path").alias("path")) for d in (self.orphans(), self.unreachable()))
        found = provenance.health(self.files, self.resources, base, now, lone, far, BUNDLE)
        rows = found.select(F.col("path").alias("document"), "signal", "source", F.lit("finding").alias("status"))
        if not lock:
            none = self.spark.createDataFrame([("", "source_baseline", "", "unavailable")], rows.schema)
            rows = none.unionByName(rows)
        return rows.orderBy("document", provenance.signal_rank("signal"), "source")

    def affected(self, path: str) -> DataFrame:
        try:
            return provenance.affected(self.resources, path).orderBy("path")
        except ValueError as e:
            raise CommandError(str(e)) from e

    # --- rewrites --------------------------------------------------------------------------------------------------

    def tidy(self, links: bool = True, slug: bool = True, wikilinks: bool = True) -> DataFrame:
        """``(entry, field, from, to, skip)``: what tidying would change, and what it would leave and why."""
        parts = []
        none = F.lit(None).cast("string").alias("skip")
        if links:
            raw = self._inline.where(F.col("kind") == "absolute").select(F.col("path").alias("from_path"), "raw")
            parts.append(rewrite.tidy_links_plan(raw).select(F.col("from_path").alias("entry"), F.lit("link").alias("field"), F.col("old").alias("from"), F.col("new").alias("to"), none))
        if slug:
            taken = F.when(F.col("collides"), "the name is taken").alias("skip")
            parts.append(rewrite.slug_plan(self.files).select(F.col("path").alias("entry"), F.lit("path").alias("field"), F.col("path").alias("from"), F.col("new_path").alias("to"), taken))
        if wikilinks:
            w = self.wikilinks.select(BUNDLE, F.col("path").alias("from_path"), "raw", "anchor", "display", "embed", F.col("to").alias("path"))
            parts.append(rewrite.wikilink_plan(w).select(F.col("from_path").alias("entry"), F.lit("wikilink").alias("field"), F.col("old").alias("from"), F.col("new").alias("to"), "skip"))
        return reduce(DataFrame.unionByName, parts).orderBy("entry", "field", "from")

    def apply_tidy(self, links: bool = False, slug: bool = False, wikilinks: bool = False) -> None:
        """Carry out :meth:`tidy`; renames last, each with the links to it. The corpus must be loaded again afterwards."""
        plan = self.tidy(links, slug, wikilinks).where(F.col("skip").isNull())
        self._rewrite(plan.where(F.col("field") != "path").select("entry", "field", "from", "to"))
        renames = [(r["from"], r["to"]) for r in plan.where(F.col("field") == "path").collect()] if slug else []
        for old, new in renames:
            Corpus(self.spark, self.project).apply_move(old, new)

    def move(self, old: str, new: str, references: bool = False) -> DataFrame:
        """``(entry, field, from, to)``: what to respell when a document moves: links, wikilinks, declared sources.

        ``references``: also frontmatter values that name it as a ``.md`` path.
        """
        old = self._one(old)
        new = "/" + source.safe_relative(new.lstrip("/"))
        if self.known.where(F.col("path") == new).limit(1).count():
            raise CommandError(f"{new} exists")
        moved = F.col("path") == old
        home = F.when(moved, F.lit(new)).otherwise(F.col("path"))
        row = lambda field: [F.col("path").alias("entry"), field.alias("field"), F.col("raw").alias("from"), F.col("_new").alias("to")]

        own = self._inline.where(F.col("kind").isin("absolute", "relative") & ~F.col("n.escapes")).select("path", "raw", "kind", F.col("n.path").alias("target"), F.col("n.anchor").alias("anchor"))
        goal = F.when(F.col("target") == old, F.lit(new)).otherwise(F.col("target"))
        spelled = F.when(F.col("kind") == "absolute", goal).otherwise(relative_link(home, goal))
        full = F.concat(spelled, F.coalesce(F.concat(F.lit("#"), F.col("anchor")), F.lit("")))
        links = own.where(moved & (F.col("kind") == "relative") | (F.col("target") == old)).withColumn("_new", full)

        # a wikilink that meant the document is respelled as the path it then has
        name = F.regexp_replace(F.lit(new.lstrip("/")), r"\.md\z", "")
        rest = F.concat(F.when(F.col("anchor") != "", F.concat(F.lit("#"), F.col("anchor"))).otherwise(""), F.when(F.col("display") != "", F.concat(F.lit("|"), F.col("display"))).otherwise(""))
        bang = F.when(F.col("embed"), "!").otherwise("")
        wiki = self.wikilinks.where(F.col("to") == old).select("path", F.concat(bang, F.lit("[["), F.col("raw"), F.lit("]]")).alias("raw"), F.concat(bang, F.lit("[["), name, rest, F.lit("]]")).alias("_new"))

        here = self._corpus_at
        declared = self.entries.select("path", F.explode("resources").alias("raw"))
        is_relative = F.col("raw").startswith("./") | F.col("raw").startswith("../")
        resolved = canonical_resource(F.concat(F.lit(here), F.col("path")), "raw")
        to_moved = resolved == (here + old).lstrip("/")
        goal = F.concat(F.lit("/"), F.when(to_moved, F.lit((here + new).lstrip("/"))).otherwise(resolved))
        kept = F.when(is_relative, relative_link(F.concat(F.lit(here), home), goal)).otherwise(F.regexp_replace(goal, r"\A/", ""))
        sources = declared.where(resolved.isNotNull() & (to_moved | moved & is_relative)).withColumn("_new", kept)

        plan = links.select(*row(F.lit("link"))).unionByName(wiki.select(*row(F.lit("wikilink")))).unionByName(sources.select(*row(F.lit("sources"))))
        if references:
            values = parse.fm_values(self.entries, "path").where((F.col("key") != "sources") & F.regexp_replace("value", r"#[\s\S]*\z", "").endswith(".md"))
            n = normalise_link("path", "value")
            values = values.select("path", "key", F.col("value").alias("raw"), n.alias("n")).where(~F.col("n.escapes") & (moved | (F.col("n.path") == old)))
            target = F.concat(F.when(F.col("n.path") == old, F.lit(new)).otherwise(F.col("n.path")), F.coalesce(F.concat(F.lit("#"), F.col("n.anchor")), F.lit("")))
            plan = plan.unionByName(values.withColumn("_new", target).select(*row(F.col("key"))))
        return plan.distinct().where(F.col("from") != F.col("to")).orderBy("entry", "field", "from")

    @cached_property
    def _corpus_at(self) -> str:
        """The corpus folder from the project root, with a slash before it, empty for the root itself."""
        return ("/" + os.path.relpath(self.project.dir, self.project.root).replace(os.sep, "/").removeprefix(".").lstrip("/")).rstrip("/")

    def _rewrite(self, plan: DataFrame) -> None:
        """Apply ``(entry, field, from, to)``: one document after another is read, respelled and replaced."""
        steps = plan.groupBy("entry").agg(F.collect_list(F.struct("field", "from", "to")).alias("steps"))
        for r in steps.toLocalIterator():  # as much as one document's links at a time
            path = self.project.dir + r["entry"]
            with open(path, encoding="utf-8", newline="") as f:
                text = f.read()
            in_body = [(x["from"], x["to"]) for x in r["steps"] if x["field"] in ("link", "wikilink")]
            values: dict[str, dict[str, str]] = {}
            for x in r["steps"]:
                if x["field"] not in ("link", "wikilink"):
                    values.setdefault(x["field"], {})[x["from"]] = x["to"]
            rewrite.write_file(path, rewrite.respell_values(rewrite.apply_plan(text, in_body), values))

    def apply_move(self, old: str, new: str, references: bool = False) -> None:
        """Carry out :meth:`move`: rewrite each document once, then rename. The corpus must be loaded again afterwards."""
        old = self._one(old)
        self._rewrite(self.move(old, new, references))
        goal = self.project.dir + "/" + source.safe_relative(new.lstrip("/"))
        os.makedirs(os.path.dirname(goal), exist_ok=True)
        os.rename(self.project.dir + old, goal)

    def fix(self, apply: bool = True) -> DataFrame:
        """``(entry, field, from, to)``: the root document's declared version, set to the one of the settings."""
        want = source.SPECS[self.project.spec]
        root = self.entries.where(F.col("path") == "/index.md")
        broken = root.where(F.col("fm_error").isNotNull()).limit(1).collect()
        if broken:
            raise CommandError(f"/index.md: {broken[0]['fm_error']}")
        got = F.coalesce(F.get(checks.property("okf_version"), 0), F.lit(""))
        plan = root.select(F.col("path").alias("entry"), F.lit("okf_version").alias("field"), got.alias("from"), F.lit(want).alias("to")).where(got != want)
        if apply and not plan.isEmpty():
            self.set_fields("/index.md", {"okf_version": want})
        return plan

    def set_fields(self, name: str, fields: dict[str, str | list[str] | None]) -> None:
        """Set (NULL: remove) frontmatter keys of one document, all or none."""
        path = self._one(name)
        try:
            with open(self.project.dir + path, encoding="utf-8", newline="") as f:
                text = f.read()
            reserved = path != "/index.md" and os.path.basename(path) in ("index.md", "log.md")
            rewrite.write_file(self.project.dir + path, rewrite.set_fields(text, fields, reserved))
        except ValueError as e:
            raise CommandError(str(e)) from e

    # --- drafts ----------------------------------------------------------------------------------------------------

    def checkout(self, folder: str) -> DataFrame:
        """Copy the corpus into an empty folder, with the digests it starts from; ``(path, sha256)``."""
        os.makedirs(folder, exist_ok=True)
        if os.listdir(folder):
            raise CommandError(f"{folder} is not empty")
        base = self._digests(self.files).cache()
        for r in self.files.select("path", "content").toLocalIterator():
            os.makedirs(os.path.dirname(folder + r["path"]), exist_ok=True)
            rewrite.write_file(folder + r["path"], r["content"])
        sinks.write_json(os.path.join(folder, DRAFT), {"version": "0", "corpus": self.project.dir, "files": {r["path"]: r["sha256"] for r in base.toLocalIterator()}})
        return base.orderBy("path")

    def checkin(self, folder: str, apply: bool = False) -> DataFrame:
        """``(path, change)`` of a draft against its base and the corpus; ``apply`` carries out what is to apply.

        A conflict refuses all of it. What was replaced is kept until the last file
        is in place and put back if one fails.
        """
        with open(os.path.join(folder, DRAFT), encoding="utf-8") as f:
            data = json.load(f)
        if data.get("version") != "0" or data.get("corpus") != self.project.dir:
            raise CommandError("not a draft of this corpus")
        base = self.spark.createDataFrame(list(data["files"].items()), "path string, sha256 string")
        draft = self._digests(source.corpus_files(self.spark, replace(self.project, root=os.path.abspath(folder), corpus=".", output=".none")))
        generated = self._digests(self.files).where(F.lit(False))
        plan = provenance.merge_plan(base, draft, self._digests(self.files), generated, "path").orderBy("path").cache()
        if apply:
            rows = plan.where(F.col("change").isin("apply", "conflict")).collect()
            clash = [r["path"] for r in rows if r["change"] == "conflict"]
            if clash:
                raise CommandError("conflicts: " + ", ".join(clash), 1)
            sinks.apply_files([(folder + r["path"], self.project.dir + r["path"]) for r in rows])
        return plan

    def _digests(self, files: DataFrame) -> DataFrame:
        return files.select("path", F.sha2("content", 256).alias("sha256"))

    # --- publication -----------------------------------------------------------------------------------------------

    def manifest(self) -> tuple[DataFrame, DataFrame]:
        """``(files, nav)`` of the published corpus."""
        rows = self.files.join(self.entries.select("path", F.col("type").alias("entry_type"), F.get(checks.property("title"), 0).alias("title")), "path")
        return graph.graph_rows(rows, self.links, F.col("title")), graph.navigation(self.files, self.links)

    def gate(self) -> DataFrame:
        """``(entry, msg)``: what keeps the corpus from being published."""
        said = F.when(F.col("detail") == "", F.col("rule")).otherwise(F.concat_ws(" -> ", "rule", "detail"))
        text = checks.gate_issues(self.files, "content", "path").select(F.col("path").alias("entry"), said.alias("msg"))
        found = self.check()
        lost = F.col("msg").startswith("broken link ->") | F.col("msg").startswith("anchor not found ->")
        wrong = found.where((F.col("level") == "error") | lost).select("entry", "msg")
        return text.unionByName(wrong).distinct().orderBy(walk_key("entry"), "msg")

    def external_references(self) -> DataFrame:
        """``(from, line, url, origin)``: published graphs the corpus and its sources name, in order."""
        cols = [F.col("url"), F.col("line"), F.col("from")]
        here = parse.inline_links(self.files, "content", "path").where(F.col("kind") == "external").select(F.col("raw").alias("url"), F.col("line_no").alias("line"), F.col("path").alias("from"), F.lit("corpus").alias("origin"))
        there = source.literal_urls(self._sources()).select("url", F.col("line_no").alias("line"), F.col("path").alias("from"), F.lit("source").alias("origin"))
        rows = here.unionByName(there).select(*cols, "origin").where(provenance.graph_address("url"))
        return rows.distinct().orderBy("from", "line", "url", "origin").select("from", "line", "url", "origin")

    def publish(self, folder: str | None = None) -> str:
        """Build the publication (documents, manifest, reading order, archive) beside its place and swap it in; the folder's name."""
        refused = self.gate().limit(1).collect()
        if refused:
            raise CommandError(f"{refused[0]['entry']}: {refused[0]['msg']}", 1)
        out = os.path.abspath(folder or os.path.join(self.project.root, self.project.output))
        docs = source.compiled_corpus(self.files)
        files, nav = self.manifest()
        order = graph.reading_order(self.files, self.links).join(files.select("path", "title"), "path")
        with sinks.swapped(out) as temp:
            ledger = {}
            for r in docs.select("path", "content", F.sha2("content", 256).alias("sha256")).toLocalIterator():
                os.makedirs(os.path.dirname(temp + r["path"]), exist_ok=True)
                rewrite.write_file(temp + r["path"], r["content"])
                ledger[r["path"].lstrip("/")] = r["sha256"]
            rewrite.write_file(os.path.join(temp, "graph.json"), sinks.graph_json(files, nav))
            rewrite.write_file(os.path.join(temp, "llms.txt"), sinks.llms_txt(self.project.name, order))
            sinks.archive(temp, sorted(ledger), os.path.join(temp, "corpus.zip"))
            sinks.write_json(os.path.join(temp, "ledger.json"), {"version": "0", "files": dict(sorted(ledger.items()))})
        return out
