from graphloom.__main__ import main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# Alpha\n\nAbout alpha and [[b]].\n")
    (tmp_path / "docs/b.md").write_text("# Beta\n\nAbout beta.\n")
    run = lambda *a: main(["--root", str(tmp_path), *a], spark)
    assert run("sync") == 1 and "error" in capsys.readouterr().err
    assert run("init") == 0 and run("sync") == 0
    assert run("query", "alpha") == 0 and "docs/a" in capsys.readouterr().out
    assert run("graph", "alpha") == 0 and "docs/b" in capsys.readouterr().out
    assert run("context", "alpha", "--format", "xml") == 0 and "<context" in capsys.readouterr().out
    assert run("scopes", "add", "team", "docs") == 0 and run("scopes", "detect", "docs/x") == 0 and "team" in capsys.readouterr().out
    assert run("query", "!!!") == 1
