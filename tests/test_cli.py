from callweave import cli


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("def main():\n    helper()\n\n\ndef helper():\n    pass\n")
    assert cli.main(["a.py:main", "--project", str(tmp_path), "--format", "text"]) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["main (a.py:1) [function]", "└── helper (a.py:5) [function]"]
    assert cli.main(["nothing", "--project", str(tmp_path)]) == 1
    assert cli.main(["the helper", "--describe", "--project", str(tmp_path), "--format", "mermaid", "--output", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o").read_text().startswith("graph LR")
