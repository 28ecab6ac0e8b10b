"""Files round trip, and commands run from scripts to results."""

import json

import pytest
from pyspark.sql import functions as F

from scriptloom import cli
from scriptloom.plans.relational import SCRIPTS
from scriptloom.plans.scripts import EXTRA, census, corpus
from scriptloom.sources import files

QUESTIONS = ("has_subquery", "has_window_function", "multi_source")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    (top / "scripts").mkdir()
    (top / "migrated").mkdir()
    for name, sql in {**SCRIPTS, **EXTRA}.items():
        (top / "scripts" / f"{name}.sql").write_text(sql)
        (top / "migrated" / f"{name}.sql").write_text(sql.replace("select", "SELECT") if len(name) % 2 else f"SELECT * FROM ({sql.rstrip(';')}) x")
    (top / "run").mkdir()
    for i, (name, sql) in enumerate(sorted({**SCRIPTS, **EXTRA}.items())):
        p = (i * 37 % 101) / 100
        yes = lambda v: {"type": "noul", "value_num": v, "max_probability": max(v, 1 - v), "probabilities": [{"label": "true", "p": v}, {"label": "false", "p": 1 - v}]}
        answers = {q: yes(p) for q in QUESTIONS} | {f"has_subquery_p{k}": yes((p + k / 7) % 1) for k in range(1, 4)} | {f"has_subquery_v{k}": yes(p if k < 3 else 1 - p) for k in range(1, 4)}
        answers["migration_complexity"] = {"type": "score", "value_num": 1.0, "max_probability": 0.6, "probabilities": [{"label": b, "p": x} for b, x in zip(("low", "medium", "high"), (0.6 - p / 2, 0.3, 0.1 + p / 2))]}
        (top / "run" / f"s{i}.json").write_text(json.dumps({"script_id": f"s{i}", "origin": name, "answers": answers, "input_tokens": 10 + i, "elapsed_ms": 5.0}, indent=1))
    (top / "points.csv").write_text("card_tokens,ms\n1,3\n2,5\n3,7\n")
    (top / "judgements.json").write_text("\n".join(json.dumps({"origin": n, "purpose": f"about {n}", "rewrite_strategy": "refactor", "needs_human_review": len(n) % 2 == 0}) for n in SCRIPTS))
    (top / "questions.json").write_text(json.dumps([{"qid": q, "type": "noul"} for q in QUESTIONS]))
    return top


def test_census_csv(spark, folder):
    made = census(corpus(spark)).select("name", "points", "band", "nonportable_markers", "distinct_sources", "graph_density", "has_having").cache()
    files.write_census(made, f"{folder}/census.csv")
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(files.read_census(spark, f"{folder}/census.csv", made)) == key(made)


def test_scripts_in_natural_order(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"query{n}.sql").write_text("select 1")
    (tmp_path / "notes.txt").write_text("no")
    found = files.scripts(spark, f"{tmp_path}")
    assert [r.name for r in found.orderBy(files.natural_key("name")).collect()] == ["query1", "query2", "query10"]


def test_runs(spark, folder):
    answers = files.read_run(spark, f"{folder}/run")
    files.write_run(answers, f"{folder}/again", "r1")
    again = files.read_run(spark, f"{folder}/again", lines=True)
    columns = ["script", "question", "type", "value_num", "max_probability"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, answers.select(columns).collect()))


@pytest.mark.parametrize(
    "command,extra,rows",
    [
        ("features", [], 46), ("census", [], 45), ("sample", ["--n", "12"], 12), ("card", ["--judgements", "{top}/judgements.json"], 45), ("calibrate", ["--points", "{top}/points.csv"], 1),
        ("derive-labels", ["--migrated", "{top}/migrated"], 46), ("decide", [], 45), ("report", [], 4), ("baseline", [], 6), ("compare", ["--other", "{top}/run"], 3), ("paired", ["--splits", "5"], 7),
        ("ensemble", [], 6), ("variants", [], 1), ("business", [], 1),
    ],
)
def test_commands(spark, folder, command, extra, rows):
    args = cli.parser().parse_args([command, "--scripts", f"{folder}/scripts", "--run", f"{folder}/run", *[x.format(top=folder) for x in extra]])
    found = cli.run(args, spark)
    got = found.collect()
    assert len(got) == rows or command == "decide" and len(got) >= rows
    if command == "calibrate":
        assert (round(got[0].slope, 6), round(got[0].intercept, 6)) == (2, 1)


def test_exports(spark, folder):
    args = ["--scripts", f"{folder}/scripts", "--run", f"{folder}/run"]
    cli.main(["export-training", *args, "--questions", f"{folder}/questions.json", "--out", f"{folder}/training"])
    assert spark.read.json(f"{folder}/training").where(F.length("family") == 12).count() == 45
    cli.main(["decide", *args, "--out", f"{folder}/decisions"])
    assert spark.read.option("header", "true").csv(f"{folder}/decisions").count() > 100
