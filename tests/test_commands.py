"""The commands end to end over small trees."""

import json

import pytest

from vellumgrid.__main__ import main, parser, run
from vellumgrid.commands import CommandError, Corpus
from vellumgrid.sources import files
from vellumgrid.sources.files import discover_project

FINANCE = {
    "project.toml": 'name = "fin"\ntypes = ["note", "concept", "task", "dataset"]\n',
    "index.md": "---\nokf_version: 0.2\n---\n# Home\n\n- [Finance](finance/index.md)\n- [Tasks](/tasks/index.md)\n",
    "finance/index.md": "[Income](income.md) [Expenses](./expenses.md#rent)\n",
    "finance/income.md": "---\ntype: concept\ntags: [eu, salary]\n---\n# Income\n\nKept by monthly tracking of\nincome.\n\nSee [receipts](q1-receipts.md) and [x](expenses.md#no-such-heading).\n",
    "finance/expenses.md": "---\ntype: dataset\ntags: out-of-pocket\n---\n# Expenses\n\n## Rent\n\n| month | category | amount |\n|---|---|---|\n| 2026-01 | rent | 900 |\n| 2026-01 | food | 300 |\n",
    "tasks/index.md": "[Reconcile](reconcile.md) [out](../../etc/x.md)\n",
    "tasks/reconcile.md": "---\ntype: task\n---\n- [ ] reconcile the bank statement\n- [x] file the report\n",
}


@pytest.fixture(scope="module")
def finance(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("finance")
    write(root, FINANCE)
    return Corpus(spark, discover_project(str(root)))


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def all_of(df):
    return [tuple(r) for r in df.collect()]


def test_status_and_lists(finance):
    r = finance.status().first()
    assert (r.entries, r.links, r.tags, r.checkboxes, r.broken, r.orphans) == (6, 7, 3, 2, 1, 0)
    assert all_of(finance.list(where=["type=concept"])) == [("/finance/income.md", "concept")]
    assert all_of(finance.list(where=["tags=out-of-pocket"])) == [("/finance/expenses.md", "dataset")]
    assert [r[0] for r in all_of(finance.list(prefix="fin"))] == ["/finance/expenses.md", "/finance/income.md", "/finance/index.md"]
    assert [r[0] for r in all_of(finance.list(reverse=True))][0] == "/tasks/reconcile.md"
    assert len(all_of(finance.list(sort="timestamp"))) == 6
    assert all_of(finance.tags()) == [("eu", 1), ("out-of-pocket", 1), ("salary", 1)]
    assert all_of(finance.properties(by="count"))[0] == ("type", 3)
    assert all_of(finance.property("type", by="count"))[0] == ("concept", 1)


def test_documents(finance):
    assert all_of(finance.outline("expenses")) == [(1, "Expenses", 5), (2, "Rent", 7)]
    t = finance.table("finance/expenses.md")
    assert t.columns == ["month", "category", "amount"] and all_of(t)[0] == ("2026-01", "rent", "900")
    with pytest.raises(CommandError) as e:
        finance.table("income")
    assert e.value.code == 1
    with pytest.raises(CommandError, match="ambiguous"):
        finance.read("index")
    assert finance.read("reconcile").first().body.startswith("- [ ]")
    assert all_of(finance.checkboxes()) == [("/tasks/reconcile.md", 4, False, "reconcile the bank statement")]
    assert all_of(finance.checkboxes(done=True, where=["type=task"]))[0][3] == "file the report"
    assert len(all_of(finance.checkboxes("reconcile", done=None))) == 2


def test_search(finance):
    paths = lambda *a, **k: [r[0] for r in all_of(finance.search(*a, **k))]
    assert paths("monthly tracking") == ["/finance/income.md"]
    assert paths("monthly rent") == []
    assert paths("monthly rent", mode="any") == ["/finance/expenses.md", "/finance/income.md", "/finance/index.md"]
    assert paths("tracking monthly", mode="exact") == []
    assert all_of(finance.search("category", lines=True))[0][2:] == (9, "| month | category | amount |")


def test_graph_and_check(finance):
    assert all_of(finance.unresolved()) == [("/finance/income.md", "/finance/q1-receipts.md", 10)]
    assert [r[0] for r in all_of(finance.outgoing("/index.md"))] == ["/index.md"] * 2
    assert {r[0] for r in all_of(finance.backlinks("expenses"))} == {"/finance/index.md", "/finance/income.md"}
    got = {(r.level, r.entry, r.msg) for r in finance.check().collect()}
    assert got == {
        ("warning", "/finance/income.md", "broken link -> /finance/q1-receipts.md"),
        ("warning", "/finance/income.md", "anchor not found -> /finance/expenses.md#no-such-heading"),
        ("warning", "/tasks/index.md", "out-of-bundle link -> ../../etc/x.md"),
    }
    files, nav = finance.manifest()
    assert files.count() == 6 and {r.path: r.next for r in nav.collect()} == {"/tasks/index.md": "/finance/index.md", "/finance/index.md": None}
    assert {r.msg for r in finance.gate().collect()} == {"root-absolute link -> /tasks/index.md", "link leaves the corpus -> ../../etc/x.md", "broken link -> /finance/q1-receipts.md", "anchor not found -> /finance/expenses.md#no-such-heading"}


def test_wikilinks_and_rewrites(spark, tmp_path):
    write(tmp_path, {"project.toml": 'name = "w"\n', "index.md": "[a](/a.md)\n", "a.md": "[[b]] and [[sub/c|the C]] `[[no]]` [[none]]\n", "b.md": "[a](a.md#x) [self](b.md)\n", "sub/c.md": "x", "two words.md": "[b](/b.md)\n"})
    c = Corpus(spark, discover_project(str(tmp_path)))
    assert [r[0] for r in all_of(c.backlinks("/b.md"))] == ["/a.md", "/b.md", "/two words.md"]
    assert [r[0] for r in all_of(c.orphans())] == ["/two words.md"]
    assert all_of(c.tidy()) == [
        ("/a.md", "wikilink", "[[b]]", "[b](./b.md)", None),
        ("/a.md", "wikilink", "[[none]]", None, "no such document"),
        ("/a.md", "wikilink", "[[sub/c|the C]]", "[the C](./sub/c.md)", None),
        ("/index.md", "link", "/a.md", "./a.md", None),
        ("/two words.md", "link", "/b.md", "./b.md", None),
        ("/two words.md", "path", "/two words.md", "/two-words.md", None),
    ]
    assert all_of(c.move("/b.md", "sub/b.md")) == [("/a.md", "wikilink", "[[b]]", "[[sub/b]]"), ("/b.md", "link", "a.md#x", "../a.md#x"), ("/b.md", "link", "b.md", "./b.md"), ("/two words.md", "link", "/b.md", "/sub/b.md")]
    with pytest.raises(CommandError):
        c.move("/b.md", "a.md")
    c.apply_move("/b.md", "sub/b.md")
    after = Corpus(spark, discover_project(str(tmp_path)))
    assert after.unresolved().count() == 0 and (tmp_path / "sub/b.md").read_text() == "[a](../a.md#x) [self](./b.md)\n"
    assert "/a.md" in [r[0] for r in all_of(after.backlinks("/sub/b.md"))]


def test_moves_keep_code_and_declared_sources(spark, tmp_path):
    a = "---\ntype: note\nsources:\n  - resource: ./b.md\n  - resource: docs/b.md\nsee: [b.md, x]\n---\n[b](b.md) `[b](b.md)` <b.md>\n```\n[b](b.md) [[b]]\n```\n![[b|B]] [b](<b.md>)\n"
    b = "---\nsources: [{resource: ../src/x.go}]\n---\n[a](a.md)\n"
    write(tmp_path, {"project.toml": 'name = "m"\ncorpus = "docs"\n', "src/x.go": "1", "docs/a.md": a, "docs/b.md": b})
    c = Corpus(spark, discover_project(str(tmp_path)))
    got = all_of(c.move("b", "in/c.md", references=True))
    assert ("/a.md", "sources", "docs/b.md", "docs/in/c.md") in got and ("/a.md", "see", "b.md", "/in/c.md") in got and len(got) == 7
    c.apply_move("b", "in/c.md")
    assert (tmp_path / "docs/a.md").read_text() == a.replace("./b.md", "./in/c.md").replace("docs/b.md", "docs/in/c.md").replace("---\n[b](b.md)", "---\n[b](./in/c.md)").replace("![[b|B]] [b](<b.md>)", "![[in/c|B]] [b](<./in/c.md>)")
    assert (tmp_path / "docs/in/c.md").read_text() == b.replace("../src", "../../src").replace("(a.md)", "(../a.md)")


def test_tidy_fix_and_fields(spark, tmp_path, capsys):
    write(tmp_path, {"project.toml": 'name = "t"\n', "index.md": "---\nokf_version: 0.1\n---\n[a](/a b.md) [[c]]\n", "a b.md": "---\ntype: note\n---\n[[gone]] [c](/c.md)\n", "c.md": "---\ntype: note\n---\nx\n", "sub/index.md": "y"})
    args = lambda *a: parser().parse_args(["--root", str(tmp_path), *a])
    assert run(spark, args("tidy", "--format", "csv")) == 0 and (tmp_path / "a b.md").exists()
    assert run(spark, args("tidy", "--links", "--slug", "--wikilinks")) == 0
    assert (tmp_path / "a-b.md").read_text().endswith("[[gone]] [c](./c.md)\n") and "[c](./c.md)" in (tmp_path / "index.md").read_text()
    capsys.readouterr()
    assert run(spark, args("check", "--fix", "--format", "csv")) == 0
    assert capsys.readouterr().out.splitlines()[1] == "/index.md,okf_version,0.1,0.2" and 'okf_version: "0.2"' in (tmp_path / "index.md").read_text()
    assert run(spark, args("set", "--list", "c", "tags", "x", "a, b")) == 0 and run(spark, args("set", "c", "type")) == 0
    assert (tmp_path / "c.md").read_text() == '---\ntags: [x, "a, b"]\n---\nx\n'
    with pytest.raises(CommandError):
        run(spark, args("set", "sub/index.md", "type", "x"))


def test_drafts(spark, tmp_path):
    write(tmp_path, {"project.toml": 'name = "d"\n', "a.md": "1", "b.md": "1", "c.md": "1", "d.md": "1"})
    c = Corpus(spark, discover_project(str(tmp_path)))
    draft = str(tmp_path.parent / f"{tmp_path.name}-draft")
    assert c.checkout(draft).count() == 4
    with pytest.raises(CommandError):
        c.checkout(draft)
    write(tmp_path.parent / f"{tmp_path.name}-draft", {"a.md": "2", "b.md": "2", "e.md": "new"})
    (tmp_path.parent / f"{tmp_path.name}-draft" / "d.md").unlink()
    write(tmp_path, {"c.md": "3"})
    fresh = lambda: Corpus(spark, discover_project(str(tmp_path)))
    assert all_of(fresh().checkin(draft)) == [("/a.md", "apply"), ("/b.md", "apply"), ("/c.md", "workspace"), ("/d.md", "apply"), ("/e.md", "apply")]
    write(tmp_path, {"b.md": "4"})
    with pytest.raises(CommandError, match="/b.md"):
        fresh().checkin(draft, apply=True)
    assert (tmp_path / "a.md").read_text() == "1"
    write(tmp_path, {"b.md": "2"})
    fresh().checkin(draft, apply=True)
    assert [(tmp_path / f"{n}.md").read_text() for n in "abce"] == ["2", "2", "3", "new"] and not (tmp_path / "d.md").exists()


def test_publish(spark, tmp_path):
    write(tmp_path, {"project.toml": 'name = "p"\ncorpus = "docs"\nexclude = ["site"]\n', "site/x.go": "https://h.org/x/graph.json", "src/x.go": "// https://h.org/y/graph.json\n", "docs/index.md": "[a](a.md) [e](https://h.org/z/graph.json)\r\n", "docs/a.md": "---\ntype: note\n---\n`[[x]]` and `<a href=x>`"})
    c = Corpus(spark, discover_project(str(tmp_path)))
    assert all_of(c.external_references()) == [("/index.md", 1, "https://h.org/z/graph.json", "corpus"), ("src/x.go", 1, "https://h.org/y/graph.json", "source")]
    assert all_of(c.gate()) == []
    out = c.publish()
    names = sorted(p.name for p in (tmp_path / "dist").iterdir())
    assert names == ["a.md", "corpus.zip", "graph.json", "index.md", "ledger.json", "llms.txt"] and out == str(tmp_path / "dist")
    first = (tmp_path / "dist/corpus.zip").read_bytes()
    c.publish()
    assert (tmp_path / "dist/corpus.zip").read_bytes() == first and (tmp_path / "dist/index.md").read_bytes().endswith(b"json)\n")
    assert {r.path for r in files.read_ledger(spark, str(tmp_path / "dist/ledger.json")).collect()} == {"a.md", "index.md"}
    write(tmp_path, {"docs/a.md": "---\ntype: note\n---\n[[x]]\n[b](javascript:x) [t][r]\n\n[r]: y\n[u](../../u.md) [v](%zz.md)"})
    bad = Corpus(spark, discover_project(str(tmp_path)))
    assert {r[1].split(" ->")[0] for r in all_of(bad.gate())} >= {"wikilink", "forbidden scheme", "reference link", "link leaves the corpus", "invalid escape"}
    with pytest.raises(CommandError):
        bad.publish()
    assert (tmp_path / "dist/corpus.zip").read_bytes() == first and not [p for p in tmp_path.iterdir() if ".new-" in p.name]


def test_sources(spark, tmp_path, capsys, monkeypatch):
    write(tmp_path, {"project.toml": 'name = "s"\ncorpus = "docs"\n', "src/a.go": "1", "src/b.go": "1", ".env": "K", "docs/index.md": "[g](g.md) [m](m.md)", "docs/g.md": "---\ntype: note\nsources:\n  - resource: ../src/a.go\n---\n", "docs/m.md": "---\ntype: note\nsources:\n  - resource: src/gone.go\n---\n", "docs/lone.md": "x"})
    monkeypatch.chdir(tmp_path)
    args = lambda *a: parser().parse_args(["--root", str(tmp_path), *a])
    assert run(spark, args("scan", "--format", "csv")) == 0
    assert capsys.readouterr().out == "path,reason\n.env,environment_credentials\n"
    c = Corpus(spark, discover_project(str(tmp_path)))
    assert c.quarantine(".keepout") == ["/.env"] and c.quarantine(".keepout") == []
    (tmp_path / ".keepout").unlink()
    (tmp_path / "src/a.go").write_text("2")
    (tmp_path / "src/b.go").unlink()
    assert run(spark, args("drift", "--format", "csv")) == 0
    assert capsys.readouterr().out == "path,status\nsources.lock.json,added\nsrc/a.go,modified\nsrc/b.go,removed\n"
    assert run(spark, args("health", "--lock", "sources.lock.json", "--format", "csv")) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ["/g.md,source_changed,src/a.go,finding", "/lone.md,missing_sources,,finding", "/lone.md,orphan,,finding", "/m.md,source_missing,src/gone.go,finding"]
    assert run(spark, args("affected", "src/a.go", "--format", "tsv")) == 0
    assert capsys.readouterr().out == "path\n/g.md\n"
    assert run(spark, args("check")) == 1
    capsys.readouterr()
    assert run(spark, args("search", "nothing here")) == 1
    assert run(spark, args("llms")) == 0
    assert "- [g.md](g.md)" in capsys.readouterr().out
    assert run(spark, args("manifest")) == 0
    assert "/g.md" in json.loads(capsys.readouterr().out)["files"]


def test_init(spark, tmp_path, capsys):
    assert main(["--root", str(tmp_path), "init", "New"]) == 0
    assert capsys.readouterr().out.split() == ["project.toml", "docs/index.md", "docs/log.md"]
    assert main(["--root", str(tmp_path), "init", "New"]) == 0
    c = Corpus(spark, discover_project(str(tmp_path)))
    assert c.check().count() == 0 and c.gate().count() == 0 and c.fix().count() == 0
