"""Rules that look at other rows, and quoted fields."""

from collections import Counter

from tablewright.functions.scale import checkpointed
from tablewright.operators import features
from tablewright.operators.rules import Rule, check_rules, quarantine, tag_failures
from tablewright.operators.structure import parse_delimited


def test_unique_and_foreign_keys_by_row(spark):
    # a third of the rows hold one key, a sixth none
    rows = [(i, "hot" if i % 3 == 0 else None if i % 6 == 1 else f"k{i // 4}", i % 7) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k string, m int")
    parent = spark.createDataFrame([("hot",), ("k10",), ("k11",), ("k11",), (None,)], "k string")
    rules = [Rule("low", "range", "m", low=1), Rule("twice", "unique", "k"), Rule("both", "unique", ["k", "m"]), Rule("orphan", "foreign_key", "k", parent=parent)]
    one, two = Counter(k for _, k, _ in rows), Counter((k, m) for _, k, m in rows)
    want = {}
    for i, k, m in rows:
        broken = [("low", m < 1), ("twice", k and one[k] > 1), ("both", k and two[k, m] > 1), ("orphan", k and k not in ("hot", "k10", "k11"))]
        want[i] = [name for name, hit in broken if hit]
    good, bad = quarantine(df, rules)
    assert good.columns == ["id", "k", "m"]
    got = {r.id: r.failed_rules for r in bad.collect()}
    assert got == {i: names for i, names in want.items() if names}
    assert {r.id for r in good.collect()} == {i for i, names in want.items() if not names}
    counted = {r.rule: r.violations for r in check_rules(df, rules).collect()}
    assert counted == Counter(name for names in want.values() for name in names)


def test_rules_on_an_empty_table_and_repeated_rows(spark):
    rules = [Rule("twice", "unique", "k"), Rule("orphan", "foreign_key", "k", parent=spark.createDataFrame([], "p string"), parent_column="p")]
    assert tag_failures(spark.createDataFrame([], "k string, _salty int"), rules).collect() == []
    same = spark.createDataFrame([("a", {"x": 1})] * 3 + [(None, None)], "k string, `a.b` map<string,int>")
    assert sorted(r.failed_rules for r in tag_failures(same, rules).collect()) == [[], *[["twice", "orphan"]] * 3]


def test_quoted_fields(spark):
    lines = {
        'a,b': ["a", "b", None],
        '"a,b",c': ["a,b", "c", None],
        '"say ""x""",,"",d': ['say "x"', "", ""],
        '"open,b': ['"open', "b", None],
        '"a"b,c': ['"a"b', "c", None],
        ',x,"two\nlines"': ["", "x", "two\nlines"],
        "": ["", None, None],
        '"' + "y," * 20000 + '",z': ["y," * 20000, "z", None],
    }
    df = spark.createDataFrame([(t,) for t in lines] + [(None,)], "t string")
    got = {r.t: [r.p, r.q, r.r] for r in parse_delimited(df, "t", ",", ["p", "q", "r"]).collect()}
    assert got == lines | {None: [None] * 3}
    pipes = spark.createDataFrame([('"a||b"||.*',)], "t string")
    assert parse_delimited(pipes, "t", "||", ["p", "q"]).first()[1:] == ("a||b", ".*")


def test_foreign_keys_count_and_merge_values_in_different_tasks(spark, monkeypatch):
    """The task that counts the values of a column held a second table of them, as text, that merged nothing."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(features, "checkpointed", seen)
    tables = {"a": spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int"), "b": spark.createDataFrame([(1,), (2,), (3,)], "y long")}
    got = features.foreign_keys(tables, {"a": ["x"], "b": ["y"]}).collect()
    assert {(r["child"], r["parent"], r["child_values"], r["found"], r["parent_unique"], r["is_foreign_key"]) for r in got} == {
        ("a.x", "b.y", 2, 2, True, True), ("b.y", "a.x", 3, 2, False, False)
    }
    lines = plans[0].split("\n")
    above = lines[: next(i for i, x in enumerate(lines) if "Union" in x)]
    dealt = next(i for i, x in enumerate(above) if "Exchange hashpartitioning(value" in x)
    assert not any("Aggregate" in x for x in above[dealt:])
