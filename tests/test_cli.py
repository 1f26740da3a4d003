"""The command line from a repository to an answer."""

import json
import os
import subprocess

import pytest

from tessera import cli
from tessera.operators import cells


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("origin"))
    run = lambda *a: subprocess.run(["git", "-C", at, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    body = "\n".join(f"\tsum += scale(n, {k}) // step {k} of the payment" for k in range(30))
    files = {"pay/pay.go": f"package pay\n\n// Pay settles a payment.\nfunc Pay(n int) int {{\n\tsum := 0\n{body}\n\treturn sum\n}}\n", "README.md": "# Pay\n\n" + "The service settles payments of customers every night. " * 30, "bad.go": "func ("}
    for name, content in files.items():
        os.makedirs(os.path.dirname(os.path.join(at, name)) or at, exist_ok=True)
        with open(os.path.join(at, name), "w") as f:
            f.write(content)
    run("add", "-A")
    run("commit", "-qm", "one")
    return at


def test_from_index_to_answer(spark, repo, tmp_path):
    root, said = str(tmp_path / "data"), []
    run = lambda *a, **b: cli.main(["--root", root, *a], spark=spark, say=said.append, **b)
    assert run("product", "list") == 0 and not said
    assert run("index", "git", "--url", repo, "--product", "bank") == 0
    first = json.loads(said.pop())
    assert first["files"] == 3 and first["failed"] == 1 and first["chunks"] >= 2 and not first["skipped"]
    assert run("index", "git", "--url", repo, "--product", "bank") == 0 and json.loads(said.pop())["skipped"]
    assert run("index", "git", "--url", repo, "--product", "bank", "--force-init", "--generate-wiki") == 0
    assert not json.loads(said[0])["skipped"] and len(said) == 5 and all(os.path.exists(x.split(": ")[1]) for x in said[1:])
    said.clear()
    assert run("product", "list") == 0 and json.loads(said[0])["sources"] == 1 and json.loads(said.pop())["versions"] == 1
    assert run("product", "show", "bank") == 0 and json.loads(said.pop())["url"] == repo
    assert run("product", "show", "nothing") == 1 and not said
    assert run("source", "list", "--product", "bank") == 0
    source = json.loads(said.pop())["id"]
    assert run("source", "show", source) == 0 and json.loads(said.pop())["indexed"] is True
    assert run("ask", "--product", "bank", "--show-sources", "how does the service settle payments of customers") == 0
    assert "## Code\n### 1. " in said[0] and {json.loads(x)["path"] for x in said[1:]} <= {"pay/pay.go", "README.md"} and len(said) > 1
    said.clear()
    assert run("find", "--product", "bank", "payments", "settles") == 0
    hits = [json.loads(x) for x in said]
    assert hits and {h["path"] for h in hits} <= {"pay/pay.go", "README.md"} and [h["keyword"] for h in hits] == sorted((h["keyword"] for h in hits), reverse=True)
    said.clear()
    assert run("coverage", "--product", "bank") == 0
    domains = [json.loads(x) for x in said]
    assert sum(d["total_files"] for d in domains) == 3 and sum(d["indexed_files"] for d in domains) == 2
    said.clear()
    assert run("coverage", "--product", "nothing") == 0 and not said
    assert run("wiki", "generate", "--product", "bank", "--out", str(tmp_path / "w"), model=lambda prompt: "page") == 0
    assert open(tmp_path / "w" / "README.md").read() == "page"


def test_a_later_push_is_seen(spark, tmp_path):
    """S-03, S-04: the branch follows its remote, a moved tag moves, a commit stays, a dropped branch is gone."""
    origin, root, said = str(tmp_path / "origin"), str(tmp_path / "data"), []
    os.makedirs(origin)
    run = lambda *a: subprocess.run(["git", "-C", origin, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout.strip()

    def push(text):
        with open(os.path.join(origin, "README.md"), "w") as f:
            f.write(f"# Title\n\n{text} ")
        run("add", "-A")
        run("commit", "-qm", text[:9])
        return run("rev-parse", "HEAD")

    def index(*ref):
        assert cli.main(["--root", root, "index", "git", "--url", origin, "--product", "p", *ref], spark=spark, say=said.append) == 0
        got = json.loads(said.pop())
        return got["version"], got["skipped"]

    run("init", "-q", "-b", "main")
    one = push("the first words of the readme " * 30)
    run("tag", "moving")
    run("branch", "side")
    assert index("--ref", "main") == (one, False) and index("--ref", "main") == (one, True)
    two = push("some other words of the readme " * 30)
    assert index("--ref", "main") == (two, False)
    assert index("--ref", "moving") == (one, True)
    run("tag", "-f", "moving")
    assert index("--ref", "moving") == (two, True)
    three = push("the third words " * 60)
    assert index() == (three, False) and index("--ref", one) == (one, True) and index("--ref", "main") == (three, True)
    assert index("--ref", "side") == (one, True)
    run("branch", "-D", "side")
    with pytest.raises(RuntimeError):
        index("--ref", "side")
    # Questions read the latest version's partitions alone.
    find = cli.Store(spark, root).find("p")
    code, _ = find([1.0] * 64)
    versions = {r["snapshot_id"]: r["n"] for r in spark.read.parquet(f"{root}/cells/vectors").groupBy("snapshot_id").count().withColumnRenamed("count", "n").collect()}
    index_ = cells.CellIndex(spark, f"{root}/cells")
    found = index_.search([1.0] * 64, versions=cli.Store(spark, root).latest("p"))
    assert len(versions) == 3 and {found.rows} == {n for s, n in versions.items() if three in s}
    assert code.count() == found.hits.count() > 0
