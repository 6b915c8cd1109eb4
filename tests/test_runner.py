import json
import shutil

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as command
from tessera import runner
from tessera.runner import ContractError, Stage
from tessera.sources.contracts import Settings


def table(name):
    return lambda spark, data, before, settings: spark.read.parquet(f"{data}/{name}.parquet")


def doubled(spark, data, before, settings):
    return before["a"]["rows"].select((F.col("x") * 2).alias("y"), F.lit(settings.alpha).alias("alpha"))


STAGES = (Stage("a", ("t",), {"rows": table("t")}), Stage("b", ("u",), {"rows": table("u")}), Stage("c", ("t",), {"rows": doubled}, {"a": {"rows": ("x",)}}))


@pytest.fixture
def folders(spark, tmp_path):
    for name in ("t", "u"):
        spark.range(3).select(F.col("id").alias("x")).write.parquet(f"{tmp_path}/in/{name}.parquet")
    return f"{tmp_path}/in", f"{tmp_path}/out"


def test_a_second_run_reads_and_a_change_runs_what_depends_on_it(spark, folders):
    data, out = folders
    go = lambda **x: runner.run(spark, data, out, stages=STAGES, **x)
    assert go() == {"a": "made", "b": "made", "c": "made"}
    assert sorted(r.y for r in spark.read.parquet(f"{out}/c/rows").collect()) == [0, 2, 4]
    assert go() == dict.fromkeys("abc", "resumed")
    spark.read.parquet(f"{data}/t.parquet").repartition(3).write.parquet(f"{data}/moved")  # other files, the same rows
    shutil.rmtree(f"{data}/t.parquet")
    shutil.move(f"{data}/moved", f"{data}/t.parquet")
    assert go() == dict.fromkeys("abc", "resumed")
    spark.range(5).select(F.col("id").alias("x")).write.mode("overwrite").parquet(f"{data}/t.parquet")
    assert go() == {"a": "made", "b": "resumed", "c": "made"}
    assert spark.read.parquet(f"{out}/c/rows").count() == 5
    assert go(settings=Settings(alpha=0.1)) == dict.fromkeys("abc", "made")
    assert go(only=["c"], settings=Settings(alpha=0.1)) == {"a": "resumed", "c": "resumed"}
    assert go(again=True, only=["b"], settings=Settings(alpha=0.1)) == {"b": "made"}


def test_unfinished_and_foreign_contracts(spark, folders):
    data, out = folders
    runner.run(spark, data, out, stages=STAGES)
    shutil.rmtree(f"{out}/a/metadata")  # as if the run had stopped
    assert runner.run(spark, data, out, stages=STAGES) == {"a": "made", "b": "resumed", "c": "resumed"}
    made = runner.metadata(spark, f"{out}/a")["made_from"]
    assert set(runner.hand_over(spark, f"{out}/a", {"rows": ("x",)}, made)) == {"rows"}
    for needs, of, what in (({"rows": ("x", "z")}, made, "rows.z"), ({"more": ()}, made, "more"), ({}, "0", "something else")):
        with pytest.raises(ContractError, match=what):
            runner.hand_over(spark, f"{out}/a", needs, of)
    with pytest.raises(ContractError, match="no finished"):
        runner.hand_over(spark, f"{out}/nowhere", {}, made)
    lacking = (STAGES[0], Stage("c", ("t",), {"rows": doubled}, {"a": {"rows": ("w",)}}))
    with pytest.raises(ContractError, match="rows.w"):
        runner.run(spark, data, f"{out}/new", stages=lacking)
    with pytest.raises(ValueError, match="no such stage"):
        runner.run(spark, data, out, stages=STAGES, only=["z"])


def test_command_line_gives_all_contracts(spark, tmp_path, capsys):
    (tmp_path / "s.json").write_text('{"match_threshold": 0.4}')
    args = ["run", "--data", "/root/testdata/sf0.001", "--out", f"{tmp_path}/out", "--settings", f"{tmp_path}/s.json"]
    assert command.main(args) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {f"p{i}": "made" for i in range(1, 6)}
    for stage in runner.STAGES:
        found = runner.metadata(spark, f"{tmp_path}/out/{stage.name}")
        assert set(found["sections"]) == set(stage.sections) and all(x["rows"] for x in found["sections"].values())
    kept = spark.read.parquet(f"{tmp_path}/out/p5/candidates")
    assert kept.where("combined < 0.4").count() == 0
    words = spark.read.parquet(f"{tmp_path}/out/p5/constraints")
    assert words.where("placed > signs").count() == 0 and words.where("placed > 0").count() > 0
    assert command.main(args) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {f"p{i}": "resumed" for i in range(1, 6)}
    (tmp_path / "bad.json").write_text('{"alfa": 1}')
    assert command.main([*args[:-1], f"{tmp_path}/bad.json"]) == 2
    assert command.main(["query", "nothing", "--data", "x"]) == 2
    assert command.main(["list"]) == 0 and "p5_validation_gates" in capsys.readouterr().out
