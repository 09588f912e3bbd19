"""Properties: brute-force equality, round trips, skew, models, streams."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import anomalies as A
from tablewright.operators import bins as B
from tablewright.operators import corrupt as M
from tablewright.operators import dedup as E
from tablewright.operators import encode as G
from tablewright.operators import missing as D
from tablewright.operators import outliers as O
from tablewright.operators import reduce as K
from tablewright.operators import repair as R
from tablewright.operators import scaling as H
from tablewright.operators import structure as C
from tablewright.operators import neighbours
from tablewright.operators.neighbours import nearest
from tablewright.operators.profile import degradation_report, duplicate_count
from tablewright.operators.rules import Rule, check_rules, quarantine
from tablewright.plans.apply import OPERATORS, Step, apply_plan, resolve
from tablewright.plans.catalog import ACTIONS
from tablewright.streaming import events as Q
from tablewright.streaming import run as S


@pytest.fixture(scope="module")
def points(spark):
    """A third of the points lie on one spot, some far away from all."""
    rng = random.Random(9)
    rows = [(i, 1.0, 2.0) for i in range(60)]
    rows += [(60 + i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(110)]
    rows += [(170 + i, rng.gauss(5000, 1), -3e5) for i in range(6)] + [(180, 1e7, 1e7)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def _brute(rows, k):
    out = {}
    for i, x, y in rows:
        near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in rows if j != i)
        out[i] = near[:k]
    return out


def test_nearest_is_exact(points):
    rows, df = points
    got = {}
    for r in nearest(df, df, ["x", "y"], 4, "id", exclude_self=True).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    want = _brute(rows, 4)
    assert got.keys() == want.keys()
    for i in want:
        assert [n for _, n in got[i]] == [n for _, n in want[i]]


def test_nearest_in_small_blocks(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 5.0), (3, "b", 1.0)], "id long, g string, x double")
    got = nearest(df, df, ["x"], 3, "id", block=["g"], exclude_self=True).collect()
    assert {(r["id"], r["neighbour"]) for r in got} == {(1, 2), (2, 1)}


def test_nearest_lays_no_row_on_several_cells(points):
    _, df = points
    plan = nearest(df, df, ["x", "y"], 4, "id", exclude_self=True)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapCoGroups" in plan


def test_nearest_over_many_tiles_is_exact(spark, points, monkeypatch):
    rows, df = points
    monkeypatch.setattr(neighbours, "TILE", 32)
    monkeypatch.setattr(neighbours, "SAMPLED", 32)
    got = {}
    for r in nearest(df, df, ["x", "y"], 4, "id", exclude_self=True).collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    assert {i: [n for _, n in sorted(near)] for i, near in got.items()} == {i: [n for _, n in near] for i, near in _brute(rows, 4).items()}


def test_dbscan_noise_is_exact(points):
    rows, df = points
    eps, need = 0.6, 4
    near = {i: [j for j, u, v in rows if (x - u) ** 2 + (y - v) ** 2 <= eps * eps] for i, x, y in rows}
    core = {i for i, n in near.items() if len(n) >= need}
    want = {i for i, n in near.items() if i not in core and not core & set(n)}
    assert {r["id"] for r in A.dbscan_noise(df, ["x", "y"], "id", eps, need).collect()} == want


def test_isolation_forest_finds_the_far_points(points):
    _, df = points
    scores = {r["id"]: r["anomaly_score"] for r in A.isolation_forest_detection(df, ["x", "y"], "id", trees=40, sample=64).collect()}
    assert set(sorted(scores, key=scores.get)[-7:]) == {*range(170, 176), 180} and len(scores) == 177
    again = {r["id"]: r["anomaly_score"] for r in A.isolation_forest_detection(df.repartition(7), ["x", "y"], "id", trees=40, sample=64).collect()}
    assert again == pytest.approx(scores)


def test_fuzzy_matches_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    rows = [(i, w) for i, w in enumerate(words)] + [(1000 + i, words[0]) for i in range(500)]

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]

    got = E.fuzzy_matches(spark.createDataFrame(rows, "id long, w string"), "id", "w", None, 2).collect()
    want = {(a, b): lev(a, b) for a in words for b in words if a < b and lev(a, b) <= 2}
    assert {(r["value_a"], r["value_b"]): r["distance"] for r in got} == want
    assert all(r["n_a"] == 501 for r in got if r["value_a"] == words[0])


def test_types_and_tokens_round_trip(spark):
    clean = spark.range(400).selectExpr("id", "cast(id * 3 as int) as n")
    dirty = M.corrupt_types(clean, "id", ["n"], rate=0.2)
    hit = dirty.where(F.expr("try_cast(n as double) is null")).count()
    assert 40 < hit < 130
    fixed = R.to_number(R.null_tokens(dirty, ["n"]), ["n"])
    assert fixed.where("n_bad").count() == 0
    assert fixed.where("n is null").count() == hit
    assert fixed.where("n is not null and n != id * 3").count() == 0


def test_whitespace_and_duplicates_round_trip(spark):
    clean = spark.range(300).selectExpr("id", "concat('word ', id) as t")
    dirty = M.corrupt_whitespace(clean, "id", ["t"], rate=0.5)
    assert dirty.exceptAll(clean).count() > 50
    assert R.normalise_whitespace(dirty, ["t"]).exceptAll(clean).count() == 0
    twice = M.corrupt_duplicates(clean, "id", rate=0.2)
    assert duplicate_count(twice).first()[0] == twice.count() - 300 > 0
    assert E.dedup_exact(twice).exceptAll(clean).count() == 0


def test_corruption_ignores_partitioning(spark):
    clean = spark.range(500).selectExpr("id", "cast(id as double) as v", "concat('name ', id % 7) as t")
    specs = {"missing_values": {"rate": 0.2}, "categorical_typos": {"cols": ["t"]}, "outliers": {"cols": ["v"]}, "duplicates": {}}
    one = M.corrupt_table(clean.coalesce(1), "id", specs)
    many = M.corrupt_table(clean.repartition(8), "id", specs)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    exact = M.corrupt_missing(clean, "id", ["v"], rate=0.1, exact=True)
    assert exact.where("v is null").count() == 50


def test_mnar_hits_high_values_only(spark):
    clean = spark.range(1000).selectExpr("id", "cast(id as double) as v")
    gone = M.corrupt_missing(clean, "id", ["v"], pattern="mnar").where("v is null")
    assert 60 < gone.count() < 140 and gone.agg(F.min("id")).first()[0] > 748
    assert M.corrupt_missing(clean.withColumn("t", F.lit("x")), "id", ["v"], pattern="mar", reference="t").where("v is null").count() == 0


def test_degradation_report(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    after = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", None)], "id string, t string")
    rows = {(r["metric"], r["column"]): (r["clean"], r["dirty"]) for r in degradation_report(before, after).collect()}
    assert rows[("rows", "")] == ("2", "3") and rows[("duplicates", "")] == ("0", "1")
    assert rows[("missing_values", "t")] == ("0", "1") and rows[("type", "id")] == ("int", "string")


def test_rules_with_nulls(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (None, 50)], "k int, v int")
    rules = [Rule("r", "range", "v", low=0, high=10), Rule("n", "not_null", "v"), Rule("u", "unique", "k")]
    got = {r["rule"]: (r["rows"], r["violations"]) for r in check_rules(df, rules).collect()}
    assert got == {"r": (3, 1), "n": (3, 1), "u": (3, 2)}
    good, bad = quarantine(df, rules[:2])
    assert good.count() == 1 and bad.count() == 2


def test_zero_spread_and_empty(spark):
    flat = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, None)], "id int, v double")
    for scale in (H.min_max_scaling, H.standard_scaling, H.robust_scaling):
        assert [r["v"] for r in scale(flat, ["v"]).orderBy("id").collect()] == [0.0, 0.0, None]
        assert scale(flat.limit(0), ["v"]).count() == 0
    assert [r["v_bin"] for r in B.equal_width_binning(flat, "v", 3).orderBy("id").collect()] == [0, 0, None]
    assert O.iqr_clipping(flat, ["v"]).where("v is null").count() == 1
    assert D.mean_imputation(flat.limit(0), ["v"]).count() == 0
    assert H.quantile_transform(flat, ["v"]).orderBy("id").first()["v"] == 0.5


def test_quantile_transform_to_normal(spark):
    df = spark.range(1001).selectExpr("id", "cast(id * id as double) as v")
    got = H.quantile_transform(df, ["v"], "normal", 1000).orderBy("id").collect()
    assert got[500]["v"] == pytest.approx(0.0, abs=1e-6)
    assert got[841]["v"] == pytest.approx(0.99858, abs=1e-3)


def test_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    assert D.mode_imputation(df, ["t"]).where("t = 'a'").count() == 3


def test_too_many_levels(spark):
    with pytest.raises(ValueError, match="more than 3 levels"):
        G.find_levels(spark.range(10).selectExpr("cast(id as string) as t"), "t", most=3)


def test_title_case_and_formats(spark):
    df = spark.createDataFrame([("flat WHITE",)], "t string")
    assert R.normalise_case(df, ["t"], "title").first()["t"] == "Flat White"
    stamps = spark.createDataFrame([("03/02/2023",), ("2023-02-03",), ("2023",)], "d string")
    got = [str(r["d"]) for r in R.to_timestamp_multi(stamps, "d", ["yyyy-MM-dd", "dd/MM/yyyy"]).collect()]
    assert got == ["2023-02-03 00:00:00", "2023-02-03 00:00:00", "None"]


def test_unnest_and_flatten_keep_empty_rows(spark):
    df = spark.createDataFrame([(1, [1, 2], {"k": 1}), (2, [], None)], "id int, xs array<int>, m map<string,int>")
    assert C.unnest(df, "xs").count() == 3 and C.unnest(df, "xs", outer=False).count() == 2
    assert {tuple(r) for r in C.unnest(df.select("id", "m"), "m", with_pos=False).collect()} == {(1, "k", 1), (2, None, None)}


def _matrix_rows(n=300, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3
    return x


def test_pca_equals_numpy(spark):
    x = _matrix_rows()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double").repartition(5)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    load = vectors[:, ::-1][:, :2]
    load = load * np.where(load[np.abs(load).argmax(axis=0), range(2)] < 0, -1, 1)
    want = centred @ load
    got = np.array([[r["pc1"], r["pc2"]] for r in K.pca(df, list("abcd"), 2).orderBy("id").collect()])
    assert got == pytest.approx(want, abs=1e-8)
    loadings, variances, means = K.incremental_pca([df.where("id < 100"), df.where("id >= 100")], list("abcd"), 2)
    assert loadings == pytest.approx(load, abs=1e-8) and variances == pytest.approx(values[::-1][:2])
    svd = np.linalg.svd(x)[2][:1].T
    svd = svd * np.sign(svd[np.abs(svd).argmax()])
    got = np.array([[r["sv1"]] for r in K.truncated_svd(df, list("abcd"), 1).orderBy("id").collect()])
    assert got == pytest.approx(x @ svd, abs=1e-8)


def test_autoencoder_and_kernel_pca(spark):
    x = _matrix_rows(200)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    one = K.autoencoder_projection(df.coalesce(1), "v", 2, epochs=3).orderBy("id").toPandas()
    many = K.autoencoder_projection(df.repartition(6), "v", 2, epochs=3).orderBy("id").toPandas()
    assert one["ae1"].to_numpy() == pytest.approx(many["ae1"].to_numpy(), abs=1e-9)
    assert K.kernel_pca(df, "v", 2, gamma=0.1).where("kpc1 is not null").count() == 200


def test_iterative_imputation_recovers_a_line(spark):
    rows = [(i, float(i % 13), 2.0 * (i % 13) + 1 if i % 5 else None, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = D.iterative_imputation(df, ["a", "b", "c"], rounds=2).collect()
    assert all(r["b"] == pytest.approx(2 * r["a"] + 1, abs=1e-6) for r in got)
    got = D.regression_imputation(df, "b", ["a", "c"]).collect()
    assert all(r["b"] == pytest.approx(2 * r["a"] + 1, abs=1e-6) for r in got)


def test_tree_and_kmeans_bins(spark):
    df = spark.range(100).selectExpr("id", "cast(id as double) as v", "case when id < 40 then 0.0 when id < 70 then 5.0 else 1.0 end as y")
    assert B.tree_thresholds(df, "v", "y", 2) == pytest.approx([39.5, 69.5], abs=0.6)
    bins = B.kmeans_binning(spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.0, 100.0, 101.0, 500.0]], "v double"), "v", 3, 20)
    assert [r["v_bin"] for r in bins.orderBy("v").collect()] == [0, 0, 0, 1, 1, 2]


def test_every_label_has_an_operator():
    for stage, actions in ACTIONS.items():
        for action in actions:
            assert callable(resolve(Step(stage, action)))
    assert len(OPERATORS) == 52  # robust_scaling belongs to two stages


def test_plan_limits(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    step = Step("missing-values-handling", "drop_rows", {"cols": ["v"]})
    assert apply_plan(df, [step]).count() == 1
    with pytest.raises(ValueError):
        apply_plan(df, [step] * 6)
    with pytest.raises(KeyError):
        apply_plan(df, [Step("encoding", "drop_rows")])


def _batches(spark, tmp_path):
    """Four files, read one per batch; the last one holds a row that is too late."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    files = [
        [(1, at(0), "u", 1.0), (2, at(3), "u", None), (3, at(4), "v", 5.0)],
        [(4, at(30), "u", 2.0), (1, at(31), "u", 1.0)],
        [(7, at(45), "v", 4.0)],
        [(5, at(1), "u", 9.0), (6, at(90), "v", 3.0)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "id long, ts timestamp, who string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return S.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)


def test_late_rows_are_dropped(spark, tmp_path):
    stream = _batches(spark, tmp_path)
    out = Q.stream_profile(stream, "ts", ["value"], delay="10 minutes", window="5 minutes")
    S.append_to_table(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = {str(r["window_start"])[11:16]: (r["n_rows"], r["value_nulls"], r["value_max"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"00:00": (3, 1, 5.0), "00:30": (2, 0, 2.0), "00:45": (1, 0, 4.0)}


def test_streams_survive_a_restart(spark, tmp_path):
    stream = _batches(spark, tmp_path)
    state = Q.stream_policy(stream.selectExpr("who as field_pattern", "'x' as action", "value > 1 as success", "value"), value="value")
    for _ in range(2):
        S.update_table(state, str(tmp_path / "state"), str(tmp_path / "cp"))
    rows = {r["field_pattern"]: (r["n"], r["successes"]) for r in S.latest_rows(spark, str(tmp_path / "state"), ["field_pattern", "action"]).collect()}
    assert rows == {"u": (5, 2), "v": (3, 3)}
    first = Q.stream_dedup(_batches(spark, tmp_path / "d"), ["id"], "ts", "1 day")
    S.append_to_table(first, str(tmp_path / "dedup"), str(tmp_path / "cp2"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "dedup")).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_moments_keep_their_digits(spark):
    """Features with a mean of 1e15 and a spread of a few units."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 3, (400, 2)).round()
    df = spark.createDataFrame([(float(1e15 + a), float(1e15 + b)) for a, b in x], "a double, b double").repartition(6)
    parts = [K.moments(df.where(c), ["a", "b"]) for c in ("a < 1e15", "a >= 1e15")]
    row = K.merge_moments(parts[0].unionByName(parts[1])).first()
    assert row["n"] == 400
    assert np.allclose(np.array(row["m2"]).reshape(2, 2) / 399, np.cov(x.T), rtol=1e-9)
    _, variances, _ = K.incremental_pca([df.where("b < 1e15"), df.where("b >= 1e15")], ["a", "b"], 2)
    assert np.allclose(variances, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1], rtol=1e-9)


def test_projections_and_forests_keep_every_row(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i * i % 11)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    for out, name in (
        (K.pca(df, ["a", "b"], 1), "pc1"),
        (K.truncated_svd(df, ["a", "b"], 1), "sv1"),
        (K.kernel_pca(df, ["a", "b"], 1), "kpc1"),
        (K.autoencoder_projection(df, ["a", "b"], 1, epochs=2), "ae1"),
        (A.isolation_forest_detection(df, ["a", "b"], "id", trees=5), "anomaly_score"),
    ):
        got = out.select("id", "b", name).collect()
        assert len(got) == 100 and all((r[name] is None) == (r["b"] is None) for r in got), name


def test_exact_corruption_never_multiplies_rows(spark):
    df = spark.createDataFrame([(i // 4, float(i)) for i in range(400)], "k long, v double")
    out = M.corrupt_missing(df, "k", ["v"], rate=0.1, exact=True)
    assert out.count() == 400 and out.where("v is null").count() == 40
    assert M.corrupt_duplicates(df, "k", rate=0.1, exact=True).count() == 440
    assert M.corrupt_missing(df, "k", ["v"], rate=0.0, exact=True).where("v is null").count() == 0


def test_wrong_answers_of_nulls_ties_and_capitals(spark):
    from tablewright.operators import features, policy, profile

    words = spark.createDataFrame([("Expresso",), ("ESPR3SSO",), ("Latte",), (None,)], "w string")
    assert {r[0] for r in R.repair_categories(words, "w", ["Espresso", "ESPRESSO", "Latte"], max_dist=1).collect()} == {"Espresso", "ESPRESSO", "Latte", None}
    links = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "c int, p string")
    assert features.hierarchy(links, [("c", "p")]).first()["is_hierarchy"]
    days = spark.createDataFrame([(f"2024-01-{i:02d}" if i % 5 else None,) for i in range(1, 21)], "d string")
    assert "nominal" not in str(profile.classify_columns(days).first().asDict().values())
    log = spark.createDataFrame([("p", {"a": 0.0, "b": 0.0})], "field_pattern string, space map<string,double>")
    assert policy.policy_table(log, ["a"]).first()["a"] is None
    rows = spark.createDataFrame([("k", 1, 5), ("k", 1, 9), ("k", 2, None)], "k string, id int, t int")
    assert {(r.dropped_id, r.reason) for r in E.dedup_audit(rows, ["k"], "id", "t").collect()} == {(1, "older version"), (2, "no instant")}


def test_near_duplicates(spark):
    text = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:-3])), (3, " ".join(text).upper()), (4, "something else"), (5, None), (6, ""), (None, " ".join(text)), (7, "something  else"), (8, " ".join(text[:30]))]
    got = E.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (7, 4)}


def test_near_duplicates_that_share_a_passage_with_a_third_text(spark):
    # heads share a passage with all texts at about 0.7; the near copies only have each other
    rows, want = [], set()
    for group in range(12):
        passage = [f"p{group}w{i}" for i in range(400)]
        for i in range(6):
            rows.append((group * 100 + i, " ".join(passage + [f"h{group}x{i}y{j}" for j in range(86)])))
        tail = [f"t{group}y{j}" for j in range(86)]
        for i in range(2):
            rows.append((group * 100 + 50 + i, " ".join(passage + tail[:60] + [f"u{group}x{i}y{j}" for j in range(26)])))
            want.add((group * 100 + 50 + i, group * 100 + 50))
    got = E.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", bands=4)
    runs = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    assert len(runs[50] & runs[51]) / len(runs[50] | runs[51]) > 0.85
    assert len(runs[0] & runs[1]) / len(runs[0] | runs[1]) < 0.75
    assert {tuple(r) for r in got.collect()} == want
