import zipfile

from tidewheel.sources import files


def test_zip_to_category(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("c1_raw.csv", "a,b\n1,2\n")
        z.writestr("c1_alarms.csv", "é\n")
        z.writestr("notes.txt", "x")
    rows = files.unzip_lines(spark, str(tmp_path)).collect()
    assert {(r.member, r.category, r.line_number, r.line) for r in rows} == {
        ("c1_raw.csv", "raw", 0, "a,b"), ("c1_raw.csv", "raw", 1, "1,2"), ("c1_alarms.csv", "alarms", 0, "é"), ("notes.txt", None, 0, "x"),
    }


def test_csv_by_category(spark, tmp_path):
    (tmp_path / "a_liftlog.csv").write_text("movementid,movementtype,started,movementduration\n1,5,2024-01-01 00:00:00,2.5\n")
    (tmp_path / "a_raw.csv").write_text("x\n1\n")
    df = files.read_csv(spark, str(tmp_path), files.LIFTLOG_SCHEMA, "liftlog", "file")
    assert [(r.movementid, r.movementtype, r.movementduration) for r in df.collect()] == [(1, 5, 2.5)]
    listed = {r.name: r.category for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"a_liftlog.csv": "liftlog", "a_raw.csv": "raw"}


def test_model_files(spark, tmp_path):
    files.write_model(spark, str(tmp_path / "m"), {"trees": 3}, {"nodes": spark.range(4), "scaler": spark.range(2)})
    config, tables = files.read_model(spark, str(tmp_path / "m"))
    assert config == {"trees": 3} and tables["nodes"].count() == 4 and tables["scaler"].count() == 2


def test_entry_imports_without_the_optional_parts():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.split('.')[:2] == ['tidewheel', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_managed_tables_are_overwritten(spark):
    import uuid

    name = f"t_{uuid.uuid4().hex}"
    try:
        files.save_table(spark.createDataFrame([(1, "a")], "k long, x string"), name)
        files.save_table(spark.createDataFrame([(2, 1.5)], "k long, y double"), name, merge_schema=True)
        assert spark.table(name).columns == ["k", "y", "x"] and [tuple(r) for r in spark.table(name).collect()] == [(2, 1.5, None)]
        files.save_table(spark.createDataFrame([(3,)], "k long"), name)
        assert [tuple(r) for r in spark.table(name).collect()] == [(3,)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_scratch_folders_are_deleted(spark, tmp_path):
    import os

    from tidewheel.sources.scratch import kept, scratch

    with scratch(spark) as path:
        spark.range(5).write.parquet(path)
        rows = kept(spark.read.parquet(path))
        where = path.removeprefix("file://").removeprefix("file:")
        assert os.path.isdir(where)
    assert not os.path.exists(where) and rows.count() == 5
