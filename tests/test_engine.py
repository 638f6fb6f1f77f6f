import os
import sys
import uuid

import pytest
from brindle import errors as E
from brindle.session import Engine


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


@pytest.fixture
def s(spark, path):
    engine = Engine.open(spark, path)
    s = engine.session()
    s.execute("create table table1 (id int64, name varchar(25), age int8)")
    s.begin()
    for i in range(20):
        s.execute("insert into table1 (id, name, age) values (?, ?, ?)", i * 64, f"user {i}", i % 5)
    s.commit()
    yield s
    s.close()
    engine.close()


def got(s, text, *args):
    return sorted(tuple(r) for r in s.query(text, *args).collect())


def test_reopen_and_products(spark, path, s):
    s.execute("create table table2 (age int8, job varchar(20))")
    s.execute("insert into table2 (age, job) values (3, 'j')")
    s.engine.close()
    again = Engine.open(spark, path).session()
    assert got(again, "select id from table1 where id = 1") == []  # 64 * 4 = 256 is not 0 truncated to 8 bits
    assert len(got(again, "select id, job from table1, table2")) == 20
    assert len(got(again, "select id, age from table1, table2 where age = 3")) == 4  # the left input's age
    with pytest.raises(E.FieldNotFound):
        again.query("select nope from table1")
    with pytest.raises(E.FieldNotFound):
        again.query("select id from table1 where nope = 1")


def test_commands(s):
    assert s.execute("update table1 set age = 99, name = 'updated' where age = 2") == 4
    assert s.execute("delete from table1 where age = 99") == 4
    assert s.execute("delete from table1 where age = 98") == 0
    assert len(got(s, "select id from table1")) == 16
    for bad, kind in (("insert into table1 (id) values ('x')", E.ExecuteError), ("insert into table1 (age) values (300)", E.ExecuteError), ("insert into table1 (id, age) values (1)", E.ExecuteError), ("insert into table1 (x) values (1)", E.FieldNotFound), ("insert into table1 (name) values ('01234567890123456789012345')", E.ExecuteError), ("create table table1 (id int8)", E.TableExists), ("delete from nope", E.TableNotFound), ("select id from table1", E.InvalidStatement)):
        with pytest.raises(kind):
            s.execute(bad)
    with pytest.raises(E.BadSyntax):
        s.query("delete from table1")
    assert len(got(s, "select id from table1")) == 16


def test_transactions(s):
    other = s.engine.session()
    other.begin()
    s.execute("update table1 set name = 'new' where id = 64")
    assert got(other, "select name from table1 where id = 64") == [("new",)]  # the snapshot is taken at the first statement
    s.execute("update table1 set name = 'newer' where id = 64")
    assert got(other, "select name from table1 where id = 64") == [("new",)]
    with pytest.raises(E.LockTimeout):
        other.execute("delete from table1")
    with pytest.raises(E.TransactionAlreadyStarted):
        other.begin()
    other.rollback()
    s.begin()
    s.execute("delete from table1")
    assert got(s, "select id from table1") == []
    with pytest.raises(E.LockTimeout):
        other.execute("delete from table1 where id = 0")
    s.rollback()
    assert len(got(other, "select id from table1")) == 20


def test_views_indexes_plans(s):
    s.execute("create table homes (owner int64, town varchar(20))")
    s.execute("create view near as select owner, town from homes where town = 'X'")
    plan = s.explain("select name, town from near, table1 where owner = id")
    assert plan == "choose name, town from (select from (join (choose owner, town from (select from (scan table homes) where town = 'X')) to (scan table table1)) where owner = id)"
    s.execute("create view a as select id from b")
    s.execute("create view b as select id from a")
    with pytest.raises(E.ViewCycle):
        s.query("select id from a")
    s.execute("create index i on table1 (age)")
    for bad, kind in (("create index i on table1 (id)", E.IndexExists), ("create index k on table1 (age)", E.FieldIndexed), ("create index k on table1 (id, name)", E.ExecuteError), ("create index k on table1 (x)", E.FieldNotFound), ("create view a as select id from b", E.ViewExists)):
        with pytest.raises(kind):
            s.execute(bad)
    p = s.index_select("table1", "age", 3)
    assert p.output().count() == 4 and p.records() == 4 and p.distinct("age") == 5 and p.distinct("id") == 1
    j = s.index_join("table1", "table1", "age")
    assert j.frame().count() == 80 and "on index" in str(j)
    info = s.stats("table1")
    assert info.records == 20 and info.distinct == {"id": 20, "name": 20, "age": 5}
    assert s.plan("select id from table1 where age = 3").plan.reduction_factor() == 5


def test_a_crash_in_a_commit_is_survived(spark, path, s):
    storage = s.engine.storage
    for content in (b"", b'{"tables": {"tab'):
        out = storage._fs.create(storage._path(f"manifests/{storage.latest()[0] + 1:012d}.json"), False)
        out.write(bytearray(content))
        out.close()
        again = Engine(spark, path, {}).session()
        assert len(got(again, "select id from table1")) == 20
        again.execute("insert into table1 (id) values (1)")
        again.execute("delete from table1 where id = 1")
    assert len(got(Engine(spark, path, {}).session(), "select id from table1")) == 20


def test_two_processes_do_not_overwrite_each_other(spark, path, s):
    one, two = (Engine(spark, path, {}).session() for _ in range(2))
    one.execute("update table1 set name = 'one'")
    with pytest.raises(E.LockTimeout):
        two.execute("update table1 set name = 'two'")
    assert {r[0] for r in got(Engine(spark, path, {}).session(), "select name from table1")} == {"one"}


def test_opening_leaves_parts_of_others(spark, path, s):
    s.begin()
    s.load("table1", spark.createDataFrame([(9999, "late", 1)], "id long, name string, age int").coalesce(1))
    old = s.engine.session()
    old.begin()
    before = old.query("select id from table1")
    Engine(spark, path, {})  # opens and cleans
    s.commit()
    assert len(got(s, "select id from table1")) == 21 and before.count() == 20
    s.execute("delete from table1 where id = 9999")
    left = sum(len(s.engine.storage._listed(f"tables/{t}")) for t in ("table1",))
    s.engine.storage.clean(grace=-10)
    assert sum(len(s.engine.storage._listed(f"tables/{t}")) for t in ("table1",)) < left and len(got(s, "select id from table1")) == 20


def test_views_and_indexes_conflict(s):
    other = s.engine.session()
    for first, second, kind in (("create view v as select id from table1", "create view v as select age from table1", E.ViewExists), ("create index i on table1 (id)", "create index i on table1 (age)", E.IndexExists), ("create index k on table1 (name)", "create index m on table1 (name)", E.FieldIndexed)):
        other.begin()
        other.execute(second)
        s.execute(first)
        with pytest.raises(kind):
            other.commit()
    assert s.engine.catalog.views == {"v": "select id from table1"} and set(s.engine.catalog.indexes) == {"i", "k"}


def test_statistics_are_those_of_a_version(s):
    other = s.engine.session()
    s.begin()
    s.execute("delete from table1 where age = 1")
    assert s.stats("table1").records == 16 and other.stats("table1").records == 20
    s.rollback()
    assert s.stats("table1").records == other.stats("table1").records == 20
    s.execute("delete from table1 where age = 1")
    assert s.stats("table1").records == other.stats("table1").records == 16
    assert s.analyse()["table1"].records == 16 and s.stats("sdb_tables").records == 5


def test_changes_replace_only_files_that_match(spark, s):
    s.execute("create table big (k int64, v varchar(5))")
    s.begin()
    for i in range(4):
        s.load("big", spark.range(i * 100, i * 100 + 100).selectExpr("id as k", "'a' as v").repartition(3))
    s.commit()
    before = list(s.engine.catalog.parts["big"])
    files = {f for p in before for f in s.engine.storage.files(p)}
    assert s.execute("update big set v = 'b' where k = 150") == 1
    after = s.engine.catalog.parts["big"]
    assert {before[0], before[2], before[3]} <= set(after)
    kept = {f for p in after for f in s.engine.storage.files(p)} & files
    assert len(kept) == len(files) - 1  # of the touched part the other files stay
    assert s.execute("update big set v = 'b' where k = -1") == 0 and s.engine.catalog.parts["big"] == after
    assert s.execute("delete from big where v = 'b'") == 1 and len(got(s, "select k from big where v = 'a'")) == 399
    assert s.execute("delete from big") == 399 and got(s, "select k from big") == [] and s.execute("delete from big") == 0


def test_inserts_are_merged_by_levels(s, monkeypatch):
    monkeypatch.setattr("brindle.session.MOST_PARTS", 3)
    s.execute("create table log (k int64)")
    for i in range(11):
        s.execute("insert into log (k) values (?)", i)
    parts = s.engine.catalog.parts["log"]
    assert got(s, "select k from log") == [(i,) for i in range(11)] and sorted(p[-3:] for p in parts) == ["-l0", "-l0", "-l2"]


def test_session_housekeeping(s):
    assert s.ping() and s.is_valid() and s.last_insert_id == -1
    s.begin()
    s.execute("delete from table1")
    s.reset()
    assert len(got(s, "select id from table1")) == 20
    with pytest.raises(E.NoTransaction):
        s.commit()


def test_iterators(s):
    from brindle.operators.iterate import for_each_field, for_each_value

    df, names, values = s.query("select id, name, age from table1 where id = 64"), [], []
    for_each_field(df, lambda name, kind: names.append((name, kind.simpleString())))
    assert names == [("id", "bigint"), ("name", "string"), ("age", "tinyint")]
    for row in s.rows("select id, name, age from table1 where id = 64"):
        for_each_value(df, row, lambda name, kind, value: values.append((name, value)) or name == "name")
    assert values == [("id", 64), ("name", "user 1")]
    with pytest.raises(ZeroDivisionError):
        s.for_each("select id from table1", lambda row: 1 / 0)


def test_unknown_index_type(s):
    from brindle.sources.catalog import Index

    with pytest.raises(E.UnknownIndexType):
        s._snapshot().create_index(Index("x", "table1", "id", "tree"))


def test_entry_without_the_optional_packages(spark, tmp_path):
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in (".git", "corpus_pipeline.py", "tests"):
            (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "brindle" / "llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries())[0], any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == ["catalog_fields", "False"], out.stderr
