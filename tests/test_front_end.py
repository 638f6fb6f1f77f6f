"""The statement language: statements are generated from the grammar; broken ones are made of them by dropping, doubling or replacing a token."""

import pytest
from brindle.errors import BadDSN, BadSyntax, EngineError, InvalidStatement, PlaceholderError, UnserializableValue
from brindle.functions.cost import MOST, search_cost, term_reduction
from brindle.plans import ast, binder
from brindle.plans.lexer import KEYWORDS, tokens
from brindle.plans.parser import parse, read
from brindle.session import parse_dsn
from hypothesis import given, settings
from hypothesis import strategies as st

names = st.from_regex(r"[a-z_][a-z0-9_]{0,6}", fullmatch=True).filter(lambda x: x not in KEYWORDS)
consts = st.one_of(st.integers(-(2**63), 2**63 - 1), st.text(max_size=8)).map(ast.Const)
exprs = st.one_of(names.map(ast.Name), consts)
several = lambda x: st.lists(x, min_size=1, max_size=4).map(tuple)
wheres = st.lists(st.builds(ast.Term, exprs, exprs), max_size=3).map(lambda x: ast.Predicate(tuple(x)))
selects = st.builds(ast.Select, several(names), several(names), wheres)
fields = st.one_of(st.builds(ast.FieldDef, names, st.sampled_from(["int8", "int64"])), st.builds(ast.FieldDef, names, st.just("varchar"), st.integers(0, 999)))
statements = st.one_of(
    selects,
    st.builds(ast.Insert, names, several(names), several(consts)),
    st.builds(ast.Delete, names, wheres),
    st.builds(ast.Update, names, several(st.tuples(names, consts)), wheres),
    st.builds(ast.CreateTable, names, several(fields)),
    st.builds(ast.CreateView, names, selects),
    st.builds(ast.CreateIndex, names, names, several(names), st.sampled_from(["hash", "btree"])),
)


@given(statements)
def test_canonical_text_parses_back(stmt):
    assert parse(str(stmt)) == stmt


@given(statements, st.data())
def test_case_space_and_comments_do_not_matter(stmt, data):
    out = []
    for t in tokens(str(stmt)):
        body = ast.Const(t.text) if t.kind == "string" else t.text
        out.append(str(body) if t.kind == "string" else data.draw(st.sampled_from([body, body.upper()])))
    gap = data.draw(st.sampled_from([" ", "\n\t ", " -- note\n", " /* note */ "]))
    assert parse(gap.join(out)) == stmt


@settings(max_examples=200)
@given(statements, st.data())
def test_a_broken_statement_is_another_one_or_an_error(stmt, data):
    """What a dropped, doubled or replaced token leaves is rejected, or is a statement whose own text parses back."""
    found = tokens(str(stmt))
    i = data.draw(st.integers(0, len(found) - 1))
    how = data.draw(st.sampled_from(["drop", "double", "replace"]))
    other = data.draw(st.sampled_from(tokens("select from where ( ) , = + 7 'x' w values int8")))
    changed = found[:i] + {"drop": [], "double": [found[i]] * 2, "replace": [other]}[how] + found[i + 1 :]
    try:
        again = read(changed)
    except (BadSyntax, InvalidStatement):
        return
    assert parse(str(again)) == again


@given(statements, st.sampled_from(["extra", ";", "7", ")", "or a = b", "order by a"]))
def test_nothing_may_follow(stmt, tail):
    # after a condition-less table list a word is no alias
    with pytest.raises(BadSyntax):
        parse(f"{stmt} {tail}")


@pytest.mark.parametrize("sign", ["<", ">", "<>", "!=", "<=", "like", "in", "+", "-"])
def test_equality_is_the_only_comparison(sign):
    with pytest.raises(BadSyntax):
        parse(f"select price from goods where price {sign} 3")


@pytest.mark.parametrize("value", ["0x10", "2.25", "1e3", "9223372036854775808", "cost", "3*4", '"quoted"', "null"])
def test_values_are_integers_or_strings(value):
    for text in (f"insert into goods (price) values ({value})", f"update goods set price = {value}"):
        with pytest.raises(BadSyntax):
            parse(text)


@pytest.mark.parametrize("kind", ["text", "varchar", "varchar()", "varchar('5')", "varchar(x)", "int16", "float", ""])
def test_unknown_types(kind):
    with pytest.raises(BadSyntax):
        parse(f"create table goods (price {kind})")


def test_unknown_statements():
    for text in ("", "drop table goods", "explain select price from goods", "goods", "7"):
        with pytest.raises(InvalidStatement):
            parse(text)


def test_types_of_constants():
    assert [ast.Const(x).kind for x in (-128, -127, 127, 128, "a")] == ["int64", "int8", "int8", "int64", "varchar"]


@given(st.lists(st.tuples(st.sampled_from(["id", "age", "town"]), st.one_of(st.sampled_from([ast.Name("id"), ast.Name("home")]), consts)), max_size=4))
def test_predicate_parts_divide_the_terms(pairs):
    p = ast.Predicate(tuple(ast.Term(ast.Name(a), b) for a, b in pairs))
    left, right = {"id", "age"}, {"town", "home"}
    own, theirs, both = p.sub_select(left), p.sub_select(right), p.sub_join(left, right)
    assert sorted(map(str, p.terms)) == sorted(map(str, own.terms + theirs.terms + (both.terms if both else ())))
    assert own.applies_to(left) and p.applies_to(left | right) and own.conjoin(theirs).terms == own.terms + theirs.terms
    for name in ("id", "age", "town", "home"):
        c, f = p.equates_with_constant(name), p.equates_with_field(name)
        assert (c is None) == (not any(ast.Name(name) in (t.left, t.right) and isinstance(t.right, ast.Const) for t in p.terms))
        assert f is None or any({t.left, t.right} == {ast.Name(name), ast.Name(f)} for t in p.terms)


def test_placeholders():
    split = binder.split
    assert split("pick /* not :this or ? */") == [("text", "pick /* not :this or ? */")]
    assert split("pick 'open :end ?") == [("text", "pick 'open :end ?")]
    assert split(r"a 'it\'s ?' b") == [("text", r"a 'it\'s ?' b")]
    assert split("x = :low, ? : y") == [("text", "x = "), ("named", "low"), ("text", ", "), ("mark", ""), ("text", " : y")]
    with pytest.raises(PlaceholderError):
        split("x = :low?")
    text = "select town from homes where size = :n and door = ? and owner = ?"
    bound = binder.bind(binder.statement(text), (7, "d'Arc"), {"n": 900})
    assert str(bound) == r"select town from homes where size = 900 and door = 7 and owner = 'd\'Arc'"
    for args, named in (((), {}), ((7,), {"n": 1}), ((7, 8), {"m": 1})):
        with pytest.raises(PlaceholderError):
            binder.bind(binder.statement(text), args, named)
    for value in (2.5, None, True, b"x", 2**63):
        with pytest.raises(UnserializableValue):
            binder.bind(binder.statement("delete from homes where size = ?"), (value,))


@given(st.one_of(st.integers(-(2**63), 2**63 - 1), st.text()))
def test_bound_values_are_never_read_as_text(value):
    bound = binder.bind(binder.statement("delete from homes where owner = ?"), (value,))
    assert bound.where.terms[0].right == ast.Const(value) and parse(str(bound)) == bound


def test_dsn():
    assert parse_dsn("/srv/data") == ("/srv/data", {})
    assert parse_dsn("/srv/data?block_size=512&transaction_lock_timeout=2h30m&log_file_name=x") == ("/srv/data", {"block_size": 512, "transaction_lock_timeout": 9000.0, "log_file_name": "x"})
    for key in ("block_size", "buffers_pool_len", "pin_lock_timeout", "transaction_lock_timeout"):
        for value in ("", "-1", "much", "1 s", "5sec"):
            with pytest.raises(BadDSN):
                parse_dsn(f"/srv/data?{key}={value}")
    for bad in ("", "?block_size=512", "/srv/data?speed=9", "/srv/data?block_size=512&speed=9"):
        with pytest.raises(BadDSN):
            parse_dsn(bad)


def test_costs():
    assert [search_cost(k, 123456, 987654) for k in ("hash", "btree", "x")] == [1234, 2, -1]
    assert term_reduction(5, 9, None) == 9 and term_reduction(None, 7, None) == 7 and term_reduction(None, None, True) == 1 and term_reduction(None, None, False) == MOST
    assert issubclass(BadSyntax, EngineError)
