"""The ensemble takes all wordings of a question or none."""

import json

import pytest

from scriptloom import cli


@pytest.mark.parametrize("count", [100, 101])
def test_no_wording_is_left_out(spark, tmp_path, count):
    yes = lambda v: {"type": "noul", "value_num": v, "max_probability": max(v, 1 - v), "probabilities": [{"label": "true", "p": v}, {"label": "false", "p": 1 - v}]}
    (tmp_path / "scripts").mkdir()
    (tmp_path / "run").mkdir()
    for i in range(2):
        (tmp_path / "scripts" / f"q{i}.sql").write_text("select a from t" if i else "select a from t where b in (select b from u)")
        answers = {f"has_subquery_p{k}": yes(k % 10 / 10) for k in range(count)}
        (tmp_path / "run" / f"s{i}.json").write_text(json.dumps({"script_id": f"s{i}", "origin": f"q{i}", "answers": answers, "input_tokens": 10, "elapsed_ms": 5.0}))
    args = cli.parser().parse_args(["ensemble", "--scripts", f"{tmp_path}/scripts", "--run", f"{tmp_path}/run"])
    if count > 100:
        with pytest.raises(ValueError, match="wordings"):
            cli.run(args, spark)
    else:
        assert cli.run(args, spark).count() > 0
