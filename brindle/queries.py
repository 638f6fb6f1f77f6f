"""Queries over the provided tables, one or more per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .functions import cost
from .operators.iterate import for_each_field, for_each_value
from .plans.parser import parse
from .session import Engine, Session, parse_dsn
from .sources.storage import work_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session of a new, empty database that sees the provided tables read-only."""
    engine = Engine(spark, work_dir(spark), {})
    for t in TABLES:
        engine.external[t] = _Lazy(spark, f"{sf_dir}/{t}.parquet")
    return engine.session()


class _Lazy:
    """A table that is opened when it is used."""

    def __init__(self, spark: SparkSession, path: str):
        self._open: Callable[[], DataFrame] = lambda: spark.read.parquet(path)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        df = self._open()
        self._open = lambda: df
        return getattr(df, name)


FLAGSHIP = "select c_name, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).query(FLAGSHIP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _select(key: str, text: str, oracle: str | None = None) -> None:
    QUERIES[key] = lambda spark, sf_dir: session(spark, sf_dir).query(text)
    ORACLES[key] = oracle or text


def _query(key: str, oracle: str | None = None):
    def add(f: Callable[[Session], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f(session(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


_select("table_scan", "select r_regionkey, r_name from region")
_select("project", "select o_orderstatus, o_orderkey from orders")
_select("project_unknown_field", "select n_name, nope from nation", "select n_name from nation")
_select("select_eq_int", "select l_orderkey, l_partkey from lineitem where l_linenumber = 1")
_select("select_const_left", "select l_orderkey, l_partkey from lineitem where 1 = l_linenumber")
_select("select_eq_string", "select c_custkey from customer where c_mktsegment = 'BUILDING'")
_select("select_eq_field", "select l_orderkey, l_linenumber from lineitem where l_partkey = l_orderkey")
_select("select_and", "select l_orderkey, l_partkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 2")
_select("select_const_true", "select n_name, n_nationkey from nation where 1 = 1")
_select("select_const_false", "select n_name, n_nationkey from nation where 1 = 2")
_select("select_uncomparable", "select n_name from nation where n_name = 1", "select n_name from nation where false")
_select("product", "select n_name, r_name from nation, region")
_select("equi_join_2", "select n_name, r_name from nation, region where n_regionkey = r_regionkey")
_select("equi_join_3", "select c_custkey, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey")
_select("equi_join_4", "select l_orderkey, l_linenumber, c_name, n_name from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey")
_select("join_plus_filter", FLAGSHIP)
_select("comments_and_case", "SELECT R_Name FROM region -- all of them\nWHERE /* one */ R_REGIONKEY = 2", "select r_name from region where r_regionkey = 2")


@_query("view_simple", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def _(s: Session) -> DataFrame:
    s.execute("create view building as select c_custkey, c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'")
    return s.query("select c_custkey, c_name from building")


@_query("view_nested", "select c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7")
def _(s: Session) -> DataFrame:
    s.execute("create view building as select c_custkey, c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'")
    s.execute("create view seven as select c_name from building where c_nationkey = 7")
    return s.query("select c_name from seven")


@_query("view_join_table", "select c_name, n_name from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING'")
def _(s: Session) -> DataFrame:
    s.execute("create view building as select c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'")
    return s.query("select c_name, n_name from building, nation where c_nationkey = n_nationkey")


@_query("view_shadows_table", "select r_name from region where r_regionkey = 3")
def _(s: Session) -> DataFrame:
    s.execute("create view nation as select r_name from region where r_regionkey = 3")
    return s.query("select r_name from nation")


@_query("index_select", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey = 42")
def _(s: Session) -> DataFrame:
    return s.index_select("customer", "c_custkey", 42).output()


@_query("index_join_same_name", "select d.doc_id, quality, toxic, text, lang, source, n_chars from labels l join documents d on l.doc_id = d.doc_id")
def _(s: Session) -> DataFrame:
    p = s.index_join("labels", "documents", "doc_id")
    names = ["doc_id", "quality", "toxic", "text", "lang", "source", "n_chars"]
    return p.frame().select(*[F.col(p.find(n).column).alias(n) for n in names])


def _filled(s: Session) -> Session:
    s.execute("create table users (id int64, name varchar(25), age int8)")
    s.begin()
    for i in range(6):
        s.execute("insert into users (id, name, age) values (?, ?, ?)", 1000 * i, f"user {i}", i % 3)
    s.commit()
    return s


_USERS = "(select * from (values (0, 'user 0', 0), (1000, 'user 1', 1), (2000, 'user 2', 2), (3000, 'user 3', 0), (4000, 'user 4', 1), (5000, 'user 5', 2)) t(id, name, age))"
_TYPED = "select cast(id as bigint) id, name, cast(age as tinyint) age from "


@_query("insert_rows", f"{_TYPED} {_USERS}")
def _(s: Session) -> DataFrame:
    return _filled(s).query("select id, name, age from users")


@_query("insert_defaults", f"{_TYPED} (values (7, '', 0), (0, 'x', 0)) t(id, name, age)")
def _(s: Session) -> DataFrame:
    s.execute("create table users (id int64, name varchar(25), age int8)")
    s.execute("insert into users (id) values (7)")
    s.execute("insert into users (name) values ('x')")
    return s.query("select id, name, age from users")


def _own_orders(s: Session, slices: int = 4) -> Session:
    """A table of our own with the orders, loaded in several parts."""
    s.execute("create table own_orders (okey int64, status varchar(1), priority varchar(15), ckey int64)")
    orders = s.table("orders").selectExpr("o_orderkey as okey", "o_orderstatus as status", "o_orderpriority as priority", "o_custkey as ckey")
    s.begin()
    for i in range(slices):
        s.load("own_orders", orders.where(f"pmod(okey, {slices}) = {i}"))
    s.commit()
    return s


_ORDERS = "select o_orderkey as okey, o_orderstatus as status, {priority} as priority, {ckey} as ckey from orders"
_OWN = "select okey, status, priority, ckey from own_orders"


@_query("load_parts", _ORDERS.format(priority="o_orderpriority", ckey="o_custkey"))
def _(s: Session) -> DataFrame:
    return _own_orders(s).query(_OWN)


@_query("update_where", _ORDERS.format(priority="case when o_orderstatus = 'P' then 'moved' else o_orderpriority end", ckey="o_custkey"))
def _(s: Session) -> DataFrame:
    _own_orders(s).execute("update own_orders set priority = 'moved' where status = 'P'")
    return s.query(_OWN)


@_query("update_one_row", _ORDERS.format(priority="case when o_orderkey = 7 then 'one' else o_orderpriority end", ckey="case when o_orderkey = 7 then -1 else o_custkey end"))
def _(s: Session) -> DataFrame:
    _own_orders(s).execute("update own_orders set priority = 'one', ckey = -1 where okey = 7")
    return s.query(_OWN)


@_query("update_all", _ORDERS.format(priority="'all'", ckey="o_custkey"))
def _(s: Session) -> DataFrame:
    _own_orders(s).execute("update own_orders set priority = 'all'")
    return s.query(_OWN)


@_query("delete_where", _ORDERS.format(priority="o_orderpriority", ckey="o_custkey") + " where not (o_orderstatus = 'F' and o_orderpriority = '2-HIGH')")
def _(s: Session) -> DataFrame:
    _own_orders(s).execute("delete from own_orders where status = 'F' and priority = '2-HIGH'")
    return s.query(_OWN)


@_query("delete_all", _ORDERS.format(priority="o_orderpriority", ckey="o_custkey") + " where false")
def _(s: Session) -> DataFrame:
    _own_orders(s).execute("delete from own_orders")
    return s.query(_OWN)


@_query("tx_commit", f"select cast(id as bigint) id, case when id = 1000 then 'new' else name end as name, cast(age as tinyint) age from {_USERS}")
def _(s: Session) -> DataFrame:
    _filled(s).begin()
    s.execute("update users set name = 'new' where id = 1000")
    s.commit()
    return s.query("select id, name, age from users")


@_query("tx_rollback", f"{_TYPED} {_USERS}")
def _(s: Session) -> DataFrame:
    _filled(s).begin()
    s.execute("update users set name = 'new' where id = 1000")
    s.execute("delete from users where age = 0")
    s.rollback()
    return s.query("select id, name, age from users")


_PARAMS = "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '2-HIGH'"


@_query("params_positional", _PARAMS)
def _(s: Session) -> DataFrame:
    return s.query("select o_orderkey from orders where o_orderstatus = ? and o_orderpriority = ?", "F", "2-HIGH")


@_query("params_named", _PARAMS)
def _(s: Session) -> DataFrame:
    return s.query("select o_orderkey from orders where o_orderstatus = :s and o_orderpriority = :p", s="F", p="2-HIGH")


@_query("params_mixed", _PARAMS)
def _(s: Session) -> DataFrame:
    return s.prepare("select o_orderkey from orders where o_orderstatus = ? and o_orderpriority = :p").query("F", p="2-HIGH")


def _catalogued(s: Session) -> Session:
    s.execute("create table users (id int64, name varchar(25), age int8)")
    s.execute("create view names as select name from users")
    s.execute("create index users_id on users (id) using btree")
    return s


@_query("catalog_tables", "select tblname, cast(slotsize as bigint) slotsize from (values ('sdb_tables', 141), ('sbb_tables_fields', 282), ('sdb_views', 937), ('sdb_indexes', 398), ('users', 114)) t(tblname, slotsize)")
def _(s: Session) -> DataFrame:
    return _catalogued(s).query("select tblname, slotsize from sdb_tables")


@_query("catalog_fields", "select tblname, fldname, cast(type as tinyint) as type, cast(length as bigint) as length, cast(\"offset\" as bigint) as \"offset\" from (values ('users', 'id', 1, 0, 1), ('users', 'name', 2, 25, 9), ('users', 'age', 3, 0, 113)) t(tblname, fldname, type, length, \"offset\")")
def _(s: Session) -> DataFrame:
    return _catalogued(s).query("select tblname, fldname, type, length, offset from sbb_tables_fields where tblname = 'users'")


@_query("catalog_views", "select 'names' as viewname, 'select name from users' as viewdef")
def _(s: Session) -> DataFrame:
    return _catalogued(s).query("select viewname, viewdef from sdb_views")


@_query("catalog_indexes", "select cast(2 as tinyint) as indextype, 'users_id' as indexname, 'users' as tablename, 'id' as fieldname")
def _(s: Session) -> DataFrame:
    return _catalogued(s).query("select indextype, indexname, tablename, fieldname from sdb_indexes")


@_query("stat_records", " union all ".join(f"select '{t}' as tblname, count(*) as records from {t}" for t in TABLES))
def _(s: Session) -> DataFrame:
    rows = [(t, s.stats(t).records) for t in TABLES]
    return s.spark.createDataFrame(rows, "tblname string, records long")


_COUNTED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")


@_query("stat_distinct", " union all ".join(f"select '{c}' as fldname, count(distinct {c}) as exact_values, true as within_five_percent from lineitem" for c in _COUNTED))
def _(s: Session) -> DataFrame:
    found = s.stats("lineitem")
    exact = s.table("lineitem").agg(*[F.count_distinct(c).alias(c) for c in _COUNTED]).first()
    rows = [(c, exact[c], abs(found.distinct_values(c)[0] - exact[c]) <= 0.05 * exact[c]) for c in _COUNTED]
    return s.spark.createDataFrame(rows, "fldname string, exact_values long, within_five_percent boolean")


@_query("plan_cost", "select name, cast(cost as bigint) as cost from (values ('hash', 1234), ('btree', 2), ('unknown', -1), ('product', 1030), ('index join', 610)) t(name, cost)")
def _(s: Session) -> DataFrame:
    rows = [(k, cost.search_cost(k, 123456, 987654)) for k in ("hash", "btree", "unknown")]
    rows += [("product", cost.product_blocks(30, 100, 10)), ("index join", cost.index_join_blocks(10, 200, 2, 200))]
    return s.spark.createDataFrame(rows, "name string, cost long")


@_query("for_each_stop", "select cast(10 as bigint) as visited, count(*) as members from (select o_orderkey from orders where o_orderkey is not null limit 10)")
def _(s: Session) -> DataFrame:
    seen: list[int] = []
    n = s.for_each("select o_orderkey from orders", lambda row: seen.append(row[0]) or len(seen) == 10)
    members = s.table("orders").where(F.col("o_orderkey").isin(seen)).count()
    return s.spark.createDataFrame([(n, members)], "visited long, members long")


@_query("for_each_field", "select * from (values ('n_nationkey', 'int'), ('n_name', 'string')) t(fldname, fldtype)")
def _(s: Session) -> DataFrame:
    seen: list[tuple] = []
    for_each_field(s.query("select n_nationkey, n_name, n_regionkey from nation"), lambda name, kind: seen.append((name, kind.simpleString())) or len(seen) == 2)
    return s.spark.createDataFrame(seen, "fldname string, fldtype string")


@_query("for_each_value", "select 'r_regionkey' as fldname, '2' as val union all select 'r_name', r_name from region where r_regionkey = 2")
def _(s: Session) -> DataFrame:
    df, seen = s.query("select r_regionkey, r_name from region where r_regionkey = 2"), []
    s.for_each("select r_regionkey, r_name from region where r_regionkey = 2", lambda row: for_each_value(df, row, lambda name, _, v: seen.append((name, str(v))) and None))
    return s.spark.createDataFrame(seen, "fldname string, val string")


def _text(s: Session, rows: list[tuple[str, str]]) -> DataFrame:
    return s.spark.createDataFrame(rows, "name string, val string")


_PLANS = {
    "one table": ("select r_name from region where r_regionkey = 3", "choose r_name from (select from (scan table region) where r_regionkey = 3)"),
    "no condition": ("select r_name from region", "choose r_name from (select from (scan table region) where true)"),
    "three tables": ("SELECT c_name FROM customer, nation, region WHERE c_nationkey=n_nationkey AND n_regionkey = r_regionkey", "choose c_name from (select from (join (join (scan table customer) to (scan table nation)) to (scan table region)) where c_nationkey = n_nationkey and n_regionkey = r_regionkey)"),
    "view": ("select hn from hot, region", "choose hn from (select from (join (choose hn from (select from (scan table own) where hr = 1)) to (scan table region)) where true)"),
}


def _values(rows: list[tuple[str, str]]) -> str:
    quoted = ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in rows)
    return f"select * from (values {quoted}) t(name, val)"


@_query("explain_text", _values([(k, want) for k, (_, want) in _PLANS.items()]))
def _(s: Session) -> DataFrame:
    s.execute("create table own (hn varchar(9), hr int8)")
    s.execute("create view hot as select hn from own where hr = 1")
    return _text(s, [(k, s.explain(text)) for k, (text, _) in _PLANS.items()])


@_query("index_info", "select 'text' as name, 'by_age on users(age) using btree' as val union all select 'records', '2' union all select 'distinct of the field', '3' union all select 'distinct of another', '1'")
def _(s: Session) -> DataFrame:
    _filled(s).execute("create index by_age on users (age) using btree")
    i = s.index_info("users", "age")
    return _text(s, [("text", str(i)), ("records", str(i.records())), ("distinct of the field", str(i.distinct("age"))), ("distinct of another", str(i.distinct("id")))])


@_query("reduction_factor", "select text as name, cast(factor as varchar) as val from (values ('n_regionkey = 1', 5), ('n_regionkey = n_nationkey', 25), ('1 = 1', 1), ('n_regionkey = 1 and n_nationkey = 2', 125)) t(text, factor)")
def _(s: Session) -> DataFrame:
    texts = ["n_regionkey = 1", "n_regionkey = n_nationkey", "1 = 1", "n_regionkey = 1 and n_nationkey = 2"]
    return _text(s, [(t, str(s.plan(f"select n_name from nation where {t}").plan.reduction_factor())) for t in texts])


@_query("predicate_parts", _values([("constant of a", "5"), ("field of b", "a"), ("select a, c", "a = 5 and c = 'x'"), ("join a to b", "a = b"), ("join a to c", "none"), ("applies to a, b", "False"), ("applies to all", "True"), ("conjoined", "a = b and a = 5 and c = 'x' and d = 1")]))
def _(s: Session) -> DataFrame:
    p, q = (parse(f"select a from t where {w}").where for w in ("a = b and a = 5 and c = 'x'", "d = 1"))
    return _text(s, [
        ("constant of a", str(p.equates_with_constant("a"))), ("field of b", p.equates_with_field("b")), ("select a, c", str(p.sub_select({"a", "c"}))), ("join a to b", str(p.sub_join({"a"}, {"b"}))),
        ("join a to c", str(p.sub_join({"a"}, {"c"}) or "none")), ("applies to a, b", str(p.applies_to({"a", "b"}))), ("applies to all", str(p.applies_to({"a", "b", "c"}))), ("conjoined", str(p.conjoin(q))),
    ])


@_query("dsn_options", _values([("path", "/data/db"), ("block_size", "4096"), ("transaction_lock_timeout", "90.0"), ("unknown key", "BadDSN"), ("bad value", "BadDSN")]))
def _(s: Session) -> DataFrame:
    path, options = parse_dsn("/data/db?block_size=4096&transaction_lock_timeout=1m30s")

    def failure(dsn: str) -> str:
        try:
            return str(parse_dsn(dsn))
        except EngineError as e:
            return type(e).__name__

    return _text(s, [("path", path), *((k, str(v)) for k, v in options.items()), ("unknown key", failure("/d?colour=red")), ("bad value", failure("/d?block_size=big"))])


def _outcome(call: Callable[[], object]) -> str:
    try:
        call()
        return "done"
    except EngineError as e:
        return type(e).__name__


@_query("tx_conflicts", _values([("stale writer", "LockTimeout"), ("same view", "ViewExists"), ("same index", "IndexExists"), ("other table", "done")]))
def _(s: Session) -> DataFrame:
    """Two transactions of one snapshot: the second must not undo what the first has committed."""
    _filled(s).execute("create table more (id int64)")
    out = []
    for name, first, second in (("stale writer", "update users set age = 1", "delete from users"), ("same view", "create view v as select id from users", "create view v as select id from more"), ("same index", "create index i on users (id)", "create index i on more (id)"), ("other table", "update users set age = 2", "insert into more (id) values (1)")):
        other = s.engine.session()
        other.begin()
        other.query("select id from users")

        def run(other=other, second=second) -> None:
            other.execute(second)
            other.commit()

        s.execute(first)
        out.append((name, _outcome(run)))
        other.close()
    return _text(s, out)


@_query("tx_recovery", f"{_TYPED} {_USERS}")
def _(s: Session) -> DataFrame:
    """After a crash that left a part without a manifest and an unreadable manifest, the database opens at its last commit and takes new ones."""
    _filled(s).begin()
    s.execute("delete from users where age = 0")
    s._flush("users")  # parts are written, the commit is not
    storage = s.engine.storage
    out = storage._fs.create(storage._path(f"manifests/{s.engine.version + 1:012d}.json"), False)
    out.write(bytearray(b'{"tables": {"us'))
    out.close()
    again = Engine(s.spark, storage.path, {}).session()
    again.execute("create table after_crash (id int64)")
    return Engine(s.spark, storage.path, {}).session().query("select id, name, age from users")


@_query("concurrent_open", f"{_TYPED} {_USERS}")
def _(s: Session) -> DataFrame:
    """Opening a database leaves the parts of transactions that are under way elsewhere."""
    s.execute("create table users (id int64, name varchar(25), age int8)")
    s.begin()
    s.load("users", s.spark.createDataFrame([(1000 * i, f"user {i}", i % 3) for i in range(6)], "id long, name string, age int"))
    Engine(s.spark, s.engine.storage.path, {})
    s.commit()
    return s.query("select id, name, age from users")
