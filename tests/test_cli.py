import json

import pytest

from wordkiln import __version__, cli


def test_help_and_version(capsys):
    for argv, want in ((["--version"], __version__), (["squeeze", "--help"], "--target"), (["brew", "--help"], "hierarchical")):
        with pytest.raises(SystemExit) as e:
            cli.main(argv)
        assert e.value.code == 0 and want in capsys.readouterr().out


def test_commands(spark, capsys, tmp_path):
    cli.main(["squeeze", "крч шо там"])
    assert capsys.readouterr().out.strip() == "що там"
    cli.main(["squeeze", "привіт", "--target", "cloud"])
    assert capsys.readouterr().out.strip() == "hi"
    f = tmp_path / "t.txt"
    f.write_text("звіт готовий\n\nкотик спить\n", encoding="utf-8")
    cli.main(["sniff", "--file", str(f), "--categories", "котик, звіт"])
    assert [r["category"] for r in json.loads(capsys.readouterr().out)] == ["звіт", "котик"]
    cli.main(["sip", "--file", str(f), "--topics", "котик,море", "--threshold", "0.3"])
    assert {k: len(v) for k, v in json.loads(capsys.readouterr().out).items()} == {"котик": 1, "море": 0}
    cli.main(["stir", str(f), "--index", str(tmp_path / "ix")])
    cli.main(["mumble", "котик", "--index", str(tmp_path / "ix")])
    assert len(json.loads(capsys.readouterr().out)) == 1
    cli.main(["nibble", "крч шо"])
    assert json.loads(capsys.readouterr().out)[0]["tokens_saved"] == {"words": 1}
