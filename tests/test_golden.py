"""Golden values: fingerprints, graph ranks, policy, parsing and state rules."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import graph as N
from tablewright.operators import parse as P
from tablewright.operators import policy as O
from tablewright.operators import profile as B
from tablewright.plans.catalog import ACTIONS, action_catalog, action_summary
from tablewright.sources.tables import html_tables, normalise_status
from tablewright.streaming.events import stage_events

CAFE = "transaction_id string, timestamp string, customer_name string, product string, quantity double, unit_price double, total_sale double, payment_method string, location string"


@pytest.fixture(scope="module")
def cafe(spark):
    return spark.createDataFrame(
        [
            ("TXN_000000", "2023-01-01 00:00:00", "Iris", "Espresso", 1.0, 6.425672, 6.425672, "Card", "Airport"),
            ("TXN_000003", "2023-01-01 03:00:00", "Jack", "Cortado", 4.0, 79.977885, 16.198138, "MOBILE", "Airport"),
            ("TXN_000004", "2023-01-01 04:00:00", "Eve", "Macchiato", None, 4.249785, float("nan"), None, "Office"),
        ],
        CAFE,
    )


def test_profile_shape(cafe):
    rows = {r["data_field_name"]: r for r in B.profile_summary(cafe).collect()}
    assert B.profile_summary(cafe).columns == ["data_field_name", "data_type", "null_counts", "unique_counts", "mean", "min", "max"]
    assert rows["quantity"]["null_counts"] == 1 and rows["quantity"]["unique_counts"] is None
    assert rows["total_sale"]["null_counts"] == 1 and rows["total_sale"]["max"] == 16.198138
    assert rows["location"]["unique_counts"] == 2 and rows["location"]["mean"] is None
    assert rows["payment_method"]["null_counts"] == 1 and rows["payment_method"]["unique_counts"] == 2


def test_profile_of_an_empty_table(cafe):
    rows = {r["data_field_name"]: r for r in B.profile_summary(cafe.limit(0)).collect()}
    assert len(rows) == 9 and rows["location"]["unique_counts"] == 0 and rows["quantity"]["mean"] is None
    assert B.duplicate_count(cafe.limit(0)).first()[0] == 0
    assert {r["columns"] for r in B.candidate_keys(cafe.limit(0), ["product", "location"]).collect()} == {"product", "location", "product,location"}


def test_fingerprints(cafe):
    assert B.pattern_code(cafe.schema, "reference") == "OTX6OBO0ODT0ODT0NCO0CBI0OTX0OUK0"
    assert B.pattern_code(cafe.schema) == "OBO0ODT0NCO3CBI0OTX6OUK0"


def test_facts_fingerprint(spark):
    facts = spark.createDataFrame(
        [("a", "numerical", "continuous"), ("b", "numerical", "continuous"), ("c", "categorical", "binary-label"), ("d", "others", "text")],
        "data_field_name string, data_type_category string, data_type_subcategory string",
    )
    assert B.field_pattern_from_facts(facts).first()[0] == "N2C1O1NC2ND0NN0NO0CB1CM0OD0OG0OT1OB0OI0"


WEB = [
    ("Home", ["Search", "News", "Blog", "Search"]),
    ("Search", ["News", "News", "Home"]),
    ("News", ["Blog", "Blog", "Home", "Search"]),
    ("Blog", ["Blog", "Home", "Blog"]),
]


def test_web_graph(spark):
    edges = N.edges_from_lists(spark.createDataFrame(WEB, "page string, links array<string>"), "page", "links")
    steps = [(r["node"], r["p"]) for r in N.next_step(edges, "Search").collect()]
    assert steps == [("News", pytest.approx(2 / 3)), ("Home", pytest.approx(1 / 3)), ("Blog", 0.0), ("Search", 0.0)]
    assert N.next_step(edges, "Shop").count() == 0
    ranks = {r["node"]: r["rank"] for r in N.pagerank(edges).collect()}
    assert ranks == pytest.approx({"Blog": 0.3905578, "Home": 0.23950027, "News": 0.19023036, "Search": 0.17971157}, abs=1e-7)
    more = N.edges_from_lists(
        spark.createDataFrame([("Search", ["Blog", "Blog", "Home", "Home", "News"])], "page string, links array<string>"), "page", "links"
    )
    merged = N.merge_edges(edges, more)
    steps = {r["node"]: r["p"] for r in N.next_step(merged, "Search").collect()}
    assert steps == pytest.approx({"Home": 0.375, "News": 0.375, "Blog": 0.25, "Search": 0.0})


# Columns of the matrices: source -> weights to nodes 0..3.
MATRICES = {
    "identity": ([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], [0.25] * 4),
    "chain": ([[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0]], [0.0375, 0.069375, 0.09646875, 0.79665625]),
    "cycle": ([[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0]], [0.25] * 4),
}


@pytest.mark.parametrize("name", sorted(MATRICES))
def test_matrix_ranks(spark, name):
    weights, want = MATRICES[name]
    rows = [(str(s), str(t), float(w)) for s, out in enumerate(weights) for t, w in enumerate(out)]
    ranks = {r["node"]: r["rank"] for r in N.pagerank(spark.createDataFrame(rows, "src string, dst string, cnt double")).collect()}
    assert [ranks[str(i)] for i in range(4)] == pytest.approx(want, abs=1e-8)


def test_hub_is_split(spark, monkeypatch):
    rows = [("hub", f"n{i}", 1.0) for i in range(50)] + [(f"n{i}", "hub", 1.0) for i in range(50)] + [("n1", "n2", 3.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, cnt double")
    whole = {r["node"]: r["rank"] for r in N.pagerank(edges, eps=None, max_iter=2).collect()}
    monkeypatch.setattr(N, "_EDGES_PER_TASK", 8)
    parts = {r["node"]: r["rank"] for r in N.pagerank(edges, eps=None, max_iter=2).collect()}
    assert parts == pytest.approx(whole)


def test_online_update(spark):
    adj = spark.createDataFrame([("a", "b", 0.3), ("a", "c", 0.7)], "src string, dst string, p double")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    links = spark.createDataFrame([("a", "b")] * 3 + [("x", "a")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["p"] for r in N.online_transition_update(adj, links, nodes).collect()}
    moved = 0.28070625
    assert got == pytest.approx({("a", "b"): moved / (moved + 0.7), ("a", "c"): 0.7 / (moved + 0.7)})
    assert [r[0] for r in N.unseen_sources(links, nodes).collect()] == ["x"]


def test_components(spark):
    rows = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (200, 5)]
    got = {r["node"]: r["component"] for r in N.connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert {n for n, c in got.items() if c == 0} == set(range(21)) | {200}
    assert {n for n, c in got.items() if c == 100} == {100, 101, 102}


def test_catalog(spark):
    assert action_catalog(spark).count() == 53
    assert action_catalog(spark, "encoding").count() == len(ACTIONS["encoding"]) == 7
    assert action_summary("encoding").startswith("one_hot_encoding: ")
    with pytest.raises(KeyError, match="Unknown transformation stage"):
        action_catalog(spark, "cooking")


def test_select_actions(spark):
    catalog = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("t", "c", 0), ("t", "d", 1), ("t", "e", 2), ("t", "f", 3)], "stage string, action string, action_pos int")
    log = spark.createDataFrame(
        [("p", "b", {"a": 0.2, "b": 0.8}), ("p", "a", {"a": 0.5, "b": 0.5})], "field_pattern string, action string, space map<string,double>"
    )
    asks = spark.createDataFrame([(1, "p", "s"), (2, "new", "t"), (3, "p", "t"), (4, "p", "u")], "session_id int, field_pattern string, stage string")
    got = {r["session_id"]: r for r in O.select_actions(asks, log, catalog).collect()}
    assert (got[1]["action"], got[1]["proba"]) == ("b", pytest.approx(0.65))
    assert got[2]["proba"] == 0.25 and got[2]["action"] in "cdef"
    assert got[3]["error"] == "Action space mismatch with recorded actions." and got[3]["action"] is None
    assert got[4]["error"] == "Unknown transformation stage 'u'"


def test_status_rules(spark):
    rows = [(1, False, 200, None), (2, False, 404, "x"), (3, True, 200, None)]
    got = normalise_status(spark.createDataFrame(rows, "sessionId int, success boolean, statusCode int, errorMessage string")).orderBy("sessionId").collect()
    assert [(r["statusCode"], r["errorMessage"]) for r in got] == [
        (500, "StateMessage failed without specific error message."), (404, "x"), (200, None)]
    assert got[0]["sessionId"] == "1"


def test_responses(spark):
    texts = ['text ```json {"steps":["x","y"]} ```', "no fence", '```json {"steps": [} ```', '```json {"steps": "x"} ```']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = P.plan_steps(df, "t").orderBy("id", "step_pos").collect()
    assert [(r["id"], r["step_pos"], r["step"]) for r in got] == [(0, 0, "x"), (0, 1, "y"), (1, None, None), (2, None, None), (3, None, None)]
    assert [r["error"] for r in got] == [None, None, P.NO_JSON, P.BAD_JSON, P.NO_STEPS]
    code = spark.createDataFrame([("```python\nx = 1\n```",), ("```\ny\n``` z",), ("  raw \n",)], "t string")
    assert [r["code"] for r in P.extract_code(code, "t").collect()] == ["x = 1", "y", "raw"]


def test_stage_events(spark):
    sessions = spark.createDataFrame([("s1",), ("s2",)], "id string")
    rows = stage_events(sessions, "id").where("sessionId = 's1'").orderBy("pos").collect()
    assert [r["content"] for r in rows] == [
        "Processing 1 / 4 stage: data-ingestion", "Processing 2 / 4 stage: data-cleaning", "Processing 3 / 4 stage: data-analytics",
        "Processing 4 / 4 stage: data-quality-check", "[END]"]
    (error,) = stage_events(sessions, "id", []).where("sessionId = 's2'").collect()
    assert (error["content"], error["statusCode"]) == ("[ERROR]", 500)


def test_html_tables(spark):
    html = "```html <table><tr><th>A &amp; B</th><th>n</th></tr><tr><td> x <b>y</b></td><td>1</td></tr></table><table><tr><td>z</td></tr></table>```"
    got = html_tables(spark.createDataFrame([(7, html)], "id int, h string"), "h", "id").collect()
    assert [(r["table_idx"], r["row_idx"], r["cells"]) for r in got] == [(0, 0, ["A & B", "n"]), (0, 1, ["x y", "1"]), (1, 0, ["z"])]
