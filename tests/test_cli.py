"""Commands end to end."""

import json

from lexigauge import cli


def test_commands(spark, tmp_path, capsys):
    a, b, rows = tmp_path / "a.md", tmp_path / "b.md", tmp_path / "rows.jsonl"
    a.write_text("# T\n\nLemma 1. Keep `x`. One. Two.", encoding="utf-8")
    b.write_text("# T\n\nLemma 1. Keep `y`. One. Two.", encoding="utf-8")
    own = {"schema": "style-observation/1", "component_id": "c", "source": "web", "condition": "HUMAN", "split": "TRAIN", "profile": "p", "units": {"F": "u"}, "features": {"F": 2.0}}
    rows.write_text("".join(json.dumps(own | {"id": f"i{k}"}) + "\n" for k in range(3)) + "\n", encoding="utf-8")
    said = {}
    for name, paths in (("analyze", [a]), ("read-paper", [a]), ("summarize", [rows])):
        assert cli.main([name, *map(str, paths)]) == 0
        said[name] = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(said["analyze"]) == 8 and said["read-paper"][0]["nodes"][0]["kind"] == "lemma" and said["summarize"][0]["mean"] == 2.0
    assert cli.main(["check", str(a), str(a)]) == 0 and cli.main(["check", str(a), str(b)]) == 2
