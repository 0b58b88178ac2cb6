"""Operators on small literal tables: what is easy to get wrong."""

import math
import os
import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexora import registry
from lexora.functions import stats, text
from lexora.operators import agreement, calibrate, canonical, reports, sampling, similarity, structures, trials, vocab
from lexora.plans import q_reports, q_vocab, study
from lexora.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "clean", "shown"), [(" An apple", "apple", "apple"), ("a an x", "an x", "an x"), ("my tea", "my tea", "tea"), ("a  x", " x", "x"), ("the", "the", "the")])
def test_two_clean_rules(spark, raw, clean, shown):
    assert one(spark, text.clean_word(F.lit(raw))) == clean
    assert one(spark, text.normalize_display(F.lit(raw))) == shown


@pytest.mark.parametrize(("raw", "key"), [("berries", "berry"), ("ties", "tie"), ("boxes", "box"), ("dishes", "dish"), ("bus", "bus"), ("buses", "buse"), ("glass", "glass"), ("cats", "cat"), ("is", "is"), ("an a-b c", "abc")])
def test_match_key(spark, raw, key):
    assert one(spark, text.match_key(F.lit(raw))) == key


def test_strict_boolean(spark):
    assert one(spark, text.parse_bool(F.lit("maybe"))) is False
    with pytest.raises(PySparkException):
        one(spark, text.parse_bool(F.lit("maybe"), True))


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert text.fingerprint(a).first() == text.fingerprint(a.orderBy(F.desc("a")).repartition(3)).first()
    assert text.fingerprint(a).first() != text.fingerprint(a.limit(1)).first()
    assert text.fingerprint(a.limit(0)).first()["rows"] == 0


def test_orderings_are_permutations_and_do_not_depend_on_partitions(spark):
    src = spark.createDataFrame([("c", f"t{i}", float(i % 4)) for i in range(20)], "context string, token string, weight double")
    a = {(r.rep, r.token): r.position for r in sampling.sample_orderings(src, 6).collect()}
    b = {(r.rep, r.token): r.position for r in sampling.sample_orderings(src.repartition(7), 6).collect()}
    assert a == b
    for rep in range(6):
        assert sorted(p for (r, _), p in a.items() if r == rep) == list(range(20))
        assert all(a[rep, f"t{i}"] >= 15 for i in range(0, 20, 4))  # no weight: after all others


def test_heavier_tokens_come_first(spark):
    src = spark.createDataFrame([("c", "big", 9.0), ("c", "small", 1.0)], "context string, token string, weight double")
    first = sampling.sample_orderings(src, 4000).where("token = 'big' and position = 0").count() / 4000
    assert abs(first - 0.9) < 0.02


def test_sampled_disjunction_needs_both_words(spark):
    cells = spark.createDataFrame([("c", "t", "q")], "context string, trigger string, query string")
    pos = spark.createDataFrame([("c", 0, "q", 0), ("c", 1, "q", 4), ("c", 1, "t", 5)], "context string, rep int, token string, position int")
    r = structures.sampled_probabilities(cells, pos, 2, [3]).first()
    assert (r.p_set, r.p_ordering, r.p_conjunction, r.p_disjunction) == (0.5, 0.5, 0.0, 0.5)


def test_log_likelihood_floor(spark):
    assert one(spark, stats.loglik(F.lit(0.0), F.lit(1))) == pytest.approx(math.log(1e-10))
    assert one(spark, stats.loglik(F.lit(0.0), F.lit(0))) == 0.0


def test_pair_order(spark):
    q, t = F.lit(0), F.lit(0)
    assert one(spark, structures.pair_order_counts(q, t, F.lit(False))) is None
    assert one(spark, structures.pair_order_counts(F.lit(3), F.lit(1), F.lit(False))) == 0.75
    assert one(spark, structures.pair_order_logprob(F.lit(-1.0), F.lit(-1.0), F.lit(True))) == 0.0


@pytest.mark.parametrize(("lq", "lt"), [(-1.2, -1.8), (10_000.0, -10_000.0), (-10_000.0, 10_000.0), (0.0, 0.0)])
def test_threshold_structures(spark, lq, lt):
    p = {k: one(spark, v) for k, v in stats.structure_probs(F.lit(lq), F.lit(lt), F.lit(-1.5), F.lit(1.0)).items()}
    assert all(0 <= x <= 1 and math.isfinite(x) for x in p.values())
    assert p["conjunction"] <= min(p["set"], p["ordering"]) + 1e-12 and p["disjunction"] >= max(p["set"], p["ordering"]) - 1e-12
    assert p["disjunction"] == pytest.approx(p["set"] + p["ordering"] - p["conjunction"])


def test_small_probability_is_kept(spark):
    assert one(spark, stats.p_set(F.lit(-60.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(8.756510762696521e-27)


def test_threshold_is_recovered(spark):
    rows = [(i % 8, -8 + 0.5 * i, -6 + 0.3 * i) for i in range(16)]
    df = spark.createDataFrame(rows, "fold int, lq double, lt double").withColumn("total", F.lit(10_000))
    df = df.withColumn("yes", F.round(stats.p_set(F.col("lq"), F.lit(-3.0), F.lit(1.0)) * 10_000).cast("long"))
    df = df.withColumns({"family": F.lit("f"), "dataset": F.lit("d"), "group": F.col("fold"), "rate": F.col("yes") / F.col("total")})
    fitted = lambda low, high: calibrate.fit_threshold(df, "set", 1.0, F.lit(low), F.lit(high)).first()
    assert abs(fitted(-18.0, 9.5)["theta"] + 3) < 0.01 and not fitted(-18.0, 9.5)["at_bound"]
    assert fitted(0.0, 9.5)["at_bound"] and fitted(-18.0, -3.0 - 1e-4)["at_bound"]
    cv = calibrate.logo_cv(df, "set", 1.0)
    assert cv.count() == 16 and cv.where("abs(theta + 3) > 0.01").count() == 0
    with pytest.raises(ValueError):
        calibrate.fit_threshold(df, "ordering", 1.0, F.lit(-6.0), F.lit(0.0))


def likelihood(rows, theta):
    """Mean over families of summed log-likelihoods by responses, in plain Python. rows: (family, dataset, group, lq, lt, yes, total)."""
    by = {}
    for family, _, _, lq, _, yes, total in rows:
        p = min(1 - 1e-10, max(1e-10, -math.expm1(-math.exp(lq - theta))))
        ll, n = by.get(family, (0.0, 0))
        by[family] = ll + yes * math.log(p) + (total - yes) * math.log1p(-p), n + total
    return sum(ll / n for ll, n in by.values()) / len(by)


def study_rows():
    """Two families and two datasets with groups of the same names; one family has a single group."""
    rows = []
    for i in range(24):
        family, dataset, group = ("a", "ab"[i % 2], f"g{i % 3}") if i < 18 else ("b", "a", "g0")
        rows.append((family, dataset, group, -6 + 0.3 * i, -4.0, (i * 37) % 90 + 5, 100 + i))
    return rows


def test_one_fold_a_group_of_its_family_and_dataset(spark):
    rows = study_rows()
    df = spark.createDataFrame(rows, "family string, dataset string, group string, lq double, lt double, yes long, total long").withColumn("rate", F.col("yes") / F.col("total"))
    got = {(r["family"], r["dataset"], r["group"]): (r["theta"], r["baseline"]) for r in calibrate.logo_cv(df, "set", 1.0).collect()}
    assert len(got) == len({r[:3] for r in rows}) == 7
    low, high = min(min(r[3:5]) for r in rows) - 10, max(max(r[3:5]) for r in rows) + 10
    for key, (theta, baseline) in got.items():
        train = [r for r in rows if r[:3] != key]
        assert baseline == pytest.approx(sum(r[5] for r in train) / sum(r[6] for r in train))
        best = max(likelihood(train, low + i * (high - low) / 4000) for i in range(4001))
        assert likelihood(train, theta) >= best - 1e-7


def test_leave_one_group_out_needs_two_groups(spark):
    df = spark.createDataFrame([("a", "d", "g", -1.0, -2.0, 1, 2), ("a", "d", "g", -2.0, -1.0, 1, 2)], "family string, dataset string, group string, lq double, lt double, yes long, total long").withColumn("rate", F.lit(0.5))
    with pytest.raises(PySparkException, match="no rows to train on"):
        calibrate.logo_cv(df, "set", 1.0).collect()


def test_tables_reject_unknown_rows_and_mixed_statuses(spark):
    names = [f"p_{k}" for k in calibrate.STRUCTURES]
    df = spark.createDataFrame([("a", "d", "exact"), ("a", "d", "rate_only")], "family string, dataset string, status string").withColumns({c: F.rand(1) for c in [*names, "rate", "lq", "x"]})
    with pytest.raises(PySparkException, match="count status"):
        calibrate.correlation_table(df, ["a-d"]).collect()
    with pytest.raises(PySparkException, match="unknown table row"):
        calibrate.correlation_table(df.where("status = 'exact'"), ["b-d"]).collect()


def test_response_scores_need_exact_counts_in_every_row(spark):
    df = spark.createDataFrame([("a", "d", "exact"), ("a", "d", "rate_only"), ("a", "e", "exact")], "family string, dataset string, status string")
    df = df.withColumns({f"p_{k}": F.lit(0.5) for k in calibrate.STRUCTURES} | {"intercept": F.lit(0.25), "rate": F.lit(0.5), "yes": F.lit(1), "total": F.lit(2)})
    got = {(r["analysis_id"], r["model"]): r for r in calibrate.score_table(df).collect()}
    assert len(got) == 10 and got["a-d", "set"]["response_ll"] is None and got["a-e", "set"]["response_score"] == pytest.approx(math.log(0.5))
    assert got["a-d", "set"]["delta_item_score"] == pytest.approx(math.log(0.5) - 0.5 * math.log(0.25 * 0.75)) and got["a-d", "intercept"]["delta_item_score"] == 0


def test_a_run_of_ties_over_several_ranges_has_one_rank(spark):
    rows = [("a", float(v)) for v in [*range(50), *[50] * 4_000, *range(51, 101)]] + [("b", 1.0), (None, 2.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {(r["k"], r["v"]): r["r"] for r in stats.average_rank(df, ["k"], "v", "r").distinct().collect()}
    assert got["a", 0.0] == 1 and got["a", 50.0] == 50 + 4_001 / 2 and got["a", 51.0] == 4_051 and got["a", 100.0] == 4_100 and got["b", 1.0] == 1 and got[None, 2.0] == 1.5
    assert len(got) == 103


def test_correlation_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 3.0, 9.0)], "g string, x double, y double")
    got = {r.group: r for r in agreement.correlation_report(df, "g", "x", "y").collect()}
    assert [got[g].undefined_reason for g in "abc"] == ["fewer_than_two_points", "constant_x", None]
    assert got["c"].rho == pytest.approx(0.8660254) and got["c"].r == pytest.approx(0.8660254)
    assert got["ALL"].n == 6 and 0 <= got["ALL"].p_value <= 1


def test_p_value(spark):
    df = spark.createDataFrame([(0.5, 20), (0.3, 11), (1.0, 5), (0.2, 2)], "r double, n long").select(agreement.p_value("r", "n").alias("p"))
    p = [r.p for r in df.collect()]
    assert p[0] == pytest.approx(0.0247, abs=2e-4) and p[1] == pytest.approx(0.3701, abs=2e-4) and p[2:] == [0.0, None]
    # By the normal distribution for very many rows: z = r * sqrt(n)
    many = spark.createDataFrame([(1e-5, 10_000_000_000), (1.96e-4, 100_000_000), (0.0, 50), (-0.3, 11)], "r double, n long").select(agreement.p_value("r", "n").alias("p"))
    p = [r.p for r in many.collect()]
    assert p[0] == pytest.approx(math.erfc(1 / math.sqrt(2)), abs=1e-7) and p[1] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-7) and p[2] == 1 and p[3] == pytest.approx(0.3701, abs=2e-4)


def test_spearman_of_several_grouping_sets(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "ALL"]), rng.choice(["u", "v"]), float(rng.randint(0, 4)) if rng.random() < 0.9 else None, float(rng.randint(0, 5))) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, h string, x double, y double").repartition(5)
    got = {(r["set"], r["g"], r["h"]): (r["n"], r["rho"]) for r in stats.spearman_sets(df, [["h"], ["h", "g"]], "x", "y").collect()}

    def want(own):
        ranks = pd.DataFrame(own, columns=["x", "y"]).rank()
        return len(own), pytest.approx(ranks["x"].corr(ranks["y"]))

    full = [r for r in rows if r[2] is not None]
    expected = {(0, g, h): want([r[2:] for r in full if r[:2] == (g, h)]) for g in ("a", "b", None, "ALL") for h in "uv"}
    expected |= {(1, None, h): want([r[2:] for r in full if r[1] == h]) for h in "uv"}  # keys in order h, g: the id's low bit stands for g
    assert got == expected
    told = [(r.group, r.n) for r in agreement.correlation_report(df, "g", "x", "y").collect()]  # a group may be called ALL
    assert len(told) == 5 and sorted(n for g, n in told if g == "ALL")[1] == len(full) and (None, sum(r[0] is None for r in full)) in told
    assert agreement.correlation_report(df.limit(0), "g", "x", "y").count() == 0


def test_run_folder_is_emptied(spark, tmp_path):
    def held(path):
        return [f for _, _, names in os.walk(path.removeprefix("file://")) for f in names if f.endswith(".parquet") and not f.startswith(".")]

    with files.run_folder(spark) as path:
        kept = stats.spearman(spark.range(50).selectExpr("id % 2 AS k", "id AS x", "-id AS y").selectExpr("k", "double(x) AS x", "double(y) AS y"), ["k"], "x", "y")
        kept.write.parquet(str(tmp_path / "kept"))
        assert len(held(path)) > 1
        with files.run_folder(spark) as inner:
            assert inner.startswith(path) and files.scratch_path(spark, "x").startswith(inner)
    assert len(held(path)) <= 1 and spark.read.parquet(str(tmp_path / "kept")).count() == 2  # the overwrite's own empty file
    with pytest.raises(ZeroDivisionError), files.run_folder(spark) as path:
        files.saved(spark.range(10), "t")
        1 / 0
    assert len(held(path)) <= 1 and not files.scratch_path(spark, "x").startswith(path)


def test_missing_trigger_drops_all_structures(spark):
    t = spark.createDataFrame([("c", "t", "q", 1), ("c", "x", "q", 0)], "context string, trigger string, query string, neg int")
    w = spark.createDataFrame([("c", "t"), ("c", "q")], "context string, token string")
    assert trials.missing_trials(t, w, [3], ["set", "ordering"]).count() == 1
    assert trials.missing_trials(t, w, [3], ["set"]).count() == 0


def test_background_cut_prefers_larger_token(spark):
    df = spark.createDataFrame([("a b", 1, 0.5), ("c d", 1, 0.5), ("e f", 9, 0.9)], "token string, count long, score double")
    assert {r.token: r.background_rank for r in vocab.background_bigrams(df, 2).collect()} == {"e f": 1, "c d": 2}


def test_restricted_cloze_sums_to_one(spark):
    df = spark.createDataFrame([("c", "a b", 0.2), ("c", "a b", 0.2), ("c", "x y z", 0.5), ("c", "q", 0.1)], "context string, word string, cloze_probability double")
    got = {r.word: (r.p, r.sources) for r in vocab.restrict_cloze(df, 2).collect()}
    assert got["a b"] == (pytest.approx(0.8), 2) and set(got) == {"a b", "q"}


def test_empty_mass_is_an_error(spark):
    df = spark.createDataFrame([("c", "a", 0.0)], "context string, word string, cloze_probability double")
    with pytest.raises(PySparkException):
        vocab.cloze_source(df).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns: c"):
        files.read_table(spark, str(tmp_path / "t.csv"), ["a", "c"])
    (tmp_path / "v.txt").write_text("one\n\ntwo\n")
    assert [(r.line, r.token) for r in files.read_vocab(spark, str(tmp_path / "v.txt")).collect()] == [(1, "one"), (3, "two")]
    for s in ("set_results_m1", "ordering_results_m2"):
        (tmp_path / "r").mkdir(exist_ok=True)
        (tmp_path / "r" / f"{s}.csv").write_text("x\n1\n")
    got = {(r.structure, r.source) for r in files.collect_results(spark, str(tmp_path / "r"), ["set", "ordering"], ["m2"]).collect()}
    assert got == {("ordering", "m2")}


def test_checked_join_and_single_key(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert canonical.checked_join(a, a, ["k"]).count() == 2
    with pytest.raises(ValueError, match="one_to_one.*'right_repeats': 1"):
        canonical.checked_join(a, b, ["k"])
    with pytest.raises(ValueError, match="many_to_one.*'right_repeats': 1"):
        canonical.checked_join(a, b, ["k"], "many_to_one")
    with pytest.raises(ValueError, match="'right_only': 1"):
        canonical.checked_join(a.where("k = 1"), a, ["k"])
    with pytest.raises(ValueError, match="'left_only': 1"):
        canonical.checked_join(b, a.where("k = 1"), ["k"], "many_to_one")
    with pytest.raises(ValueError, match="'left_only': 1"):
        canonical.checked_join(spark.createDataFrame([(None,), (1,)], "k int"), a, ["k"], "many_to_one")
    many = canonical.checked_join(b.withColumn("v", F.lit(1)), a.where("k < 9").withColumn("w", F.col("k") * 2), ["k"], "many_to_one")
    assert sorted(map(tuple, many.collect())) == [(1, 1, 2), (1, 1, 2), (2, 1, 4)]
    assert canonical.checked_join(a.limit(0), a.limit(0), ["k"]).count() == 0


def test_selected_scores_are_checked_as_they_are_saved(spark):
    schema = "dataset_family string, generation_frame string, source_row_id string, trigger_logprob_sum double, query_logprob_sum double"
    good = [("f", "no_frame", "1", -1.0, -2.0), ("f", "x_but_not_y", "2", None, -2.0), ("g", "no_frame", "1", None, None)]
    frame = lambda *more: spark.createDataFrame([*good, *more], schema)
    assert [r.source_row_id for r in canonical.select_scores(frame(), "f", "no_frame").collect()] == ["1"]
    assert canonical.select_scores(frame(), "h", "no_frame").count() == 0
    for bad, name in ((("f", "no_frame", "3", None, -2.0), "'wrong': 1"), (("f", "no_frame", "1", -1.0, -2.0), "'repeats': 1"), (("f", "no_frame", None, -1.0, -2.0), "'repeats': 1")):
        with pytest.raises(ValueError, match=name):
            canonical.select_scores(frame(bad), "f", "no_frame")


def test_classification_of_nothing(spark):
    r = agreement.classification_report(spark.createDataFrame([], "a int, b int"), F.col("a"), F.col("b")).first()
    assert r.accuracy is None


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "v double")
    assert [(r.bin, r.n) for r in reports.histogram(df, "v", 4).orderBy("bin").collect()] == [(0, 1), (1, 0), (2, 1), (3, 1)]


@pytest.mark.parametrize("bad", [{"s": 0.0}, {"s": -1.0}, {"s": float("inf")}, {"s": float("nan")}, {"q": float("nan")}, {"t": float("inf")}, {"theta": float("-inf")}])
def test_threshold_models_reject_what_is_not_finite(spark, bad):
    v = {"q": -1.0, "t": -2.0, "theta": -1.5, "s": 1.0} | bad
    q, t, theta, s = (F.lit(v[k]) for k in ("q", "t", "theta", "s"))
    with pytest.raises(PySparkException, match="finite"):
        spark.range(1).select(*[p.alias(k) for k, p in stats.structure_probs(q, t, theta, s).items()]).collect()


@pytest.mark.parametrize(("yes", "total", "p"), [(-1, 3, 0.5), (4, 3, 0.5), (1, 3, 1.5), (None, 3, 0.5)])
def test_invalid_counts_are_an_error(spark, yes, total, p):
    with pytest.raises(PySparkException, match="counts"):
        one(spark, stats.binom_ll(F.lit(p), F.lit(yes), F.lit(total)))


def test_group_folds_guards(spark):
    df = spark.createDataFrame([("a", "d", "g1"), ("a", "d", "g2"), ("b", "d", "g0"), ("b", "d", "g1"), ("b", "e", "g1"), ("b", "e", "g9")], "family string, dataset string, group string")
    with pytest.raises(PySparkException, match="fewer groups"):
        calibrate.group_folds(df, 3).collect()
    folds = {tuple(r)[:3]: r["fold"] for r in calibrate.group_folds(df, 2).collect()}  # one name in three datasets is three groups
    assert folds["a", "d", "g1"] == 0 and folds["b", "d", "g1"] == 1 and folds["b", "e", "g1"] == 0 and len(folds) == 6
    with pytest.raises(ValueError, match="two folds"):
        calibrate.group_folds(df, 1)


def test_held_out_rows_do_not_steer_a_fold(spark):
    rows = [("a", "d", f, -8 + 0.5 * i, -6 + 0.3 * i, y / 100) for f in (0, 1) for i, y in enumerate([5, 10, 20, 40, 60, 80, 90, 95] if f else [95, 5, 80, 20, 60, 40, 90, 10])]
    df = spark.createDataFrame(rows, "family string, dataset string, fold int, lq double, lt double, rate double")
    changed = df.withColumn("rate", F.when(F.col("fold") == 0, 1 - F.col("rate")).otherwise(F.col("rate")))
    a, b = ({r.fold: (r.theta, r.scale) for r in calibrate.fit_threshold_scale(x, F.lit(-12.0), F.lit(0.0), folds=["fold"]).collect()} for x in (df, changed))
    assert a[0] == b[0] and a[1] != b[1]


def canonical_rows(spark):
    cells = spark.createDataFrame([("c", "t", "q", 1, 2, 0.5)], "context string, trigger string, query string, human_yes long, human_total long, human_rate double")
    names = [f"{w}_{p} {k}" for w in ("trigger", "query") for p, k in (("logprob_sum", "double"), ("logprob_mean", "double"), ("token_count", "int"), ("tokenization_mode", "string"))]
    scores = spark.createDataFrame([("c", "t", "q", "say ", -1.0, -1.0, 1, "word", -2.0, -1.0, 2, "word", "m", "r")], "context string, trigger string, query string, generation_prompt string, " + ", ".join(names) + ", model_name string, model_revision string")
    return canonical.canonical(cells, scores, None, family="f", dataset="d", condition="b", human_file="h", score_file="s")


def test_canonical_table(spark):
    good = canonical_rows(spark)
    broken = lambda df: {r.rule for r in canonical.validate(df).where("violations > 0").collect()}
    assert broken(good) == set() and canonical.combine(good).columns[:35] == list(canonical.COLUMNS)
    assert canonical.COLUMNS[16:24] == ("trigger_logprob_sum", "query_logprob_sum", "trigger_logprob_mean", "query_logprob_mean", "trigger_token_count", "query_token_count", "trigger_tokenization_mode", "query_tokenization_mode")
    assert broken(good.withColumn("trigger_logprob_sum", F.lit(None).cast("double"))) == {"trigger_score"}
    assert broken(good.select(*reversed(good.columns))) == {"column_order"}
    with pytest.raises(ValueError, match="unique_key"):
        canonical.combine(good, good)


def test_shards_contexts_and_grids_must_be_there(spark, tmp_path):
    spark.createDataFrame([("th", "the\t2000\t3\t1")], "prefix2 string, value string").write.partitionBy("prefix2").text(str(tmp_path / "s"))
    assert files.scan_ngrams(spark, str(tmp_path / "s"), prefixes=["th"]).first()["count"] == 3
    with pytest.raises(ValueError, match="no shard for: zz"):
        files.scan_ngrams(spark, str(tmp_path / "s"), prefixes=["th", "zz"])
    t = spark.createDataFrame([("c", "t", "q", 1), ("d", "t", "q", 0)], "context string, trigger string, query string, neg int")
    kept, dropped = trials.keep_available(t, t.where("context = 'c'"))
    assert (kept.count(), dropped) == (1, 1)
    with pytest.raises(ValueError, match="context"):
        trials.keep_available(t, t.limit(0))
    with pytest.raises(ValueError, match="not 2 pairs"):
        trials.pair_grid(t, 2)
    words = spark.createDataFrame([("a", 0)], "token string, count long")
    with pytest.raises(ValueError, match="no required token"):
        vocab.frequency_source(words, words.select("token"))


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"c{i % 3}", i * 37 % 101) for i in range(101)], "context string, v int")
    for n in (1, 5):
        got = vocab.numbered(df.repartition(n), [F.asc("v")], "line", ("context",)).collect()
        assert len(got) == 101
        for c in (None, "c1", "c2"):
            own = sorted((r.v, r.line) for r in got if r.context == c)
            assert [k for _, k in own] == list(range(1, len(own) + 1))
    assert vocab.with_total(df, F.sum("v"), "t").count() == 101


def test_vocab_lines_of_many_parts(spark, tmp_path):
    words = [f"w{i:03d}" if i % 7 else "" for i in range(200)]
    spark.createDataFrame([(i, "c", w) for i, w in enumerate(words)], "i int, context string, token string").repartitionByRange(4, "i").sortWithinPartitions("i").select("context", "token").write.partitionBy("context").text(str(tmp_path / "v"))
    got = {r.line: (r.token, r.context) for r in files.read_vocab(spark, str(tmp_path / "v")).collect()}
    assert got == {i + 1: (w, "c") for i, w in enumerate(words) if w}


def test_neighbours_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    t = df.where("vec_id % 10 = 0").selectExpr("vec_id AS target", "embedding AS _t")
    a, b = ({(r.target, r.vec_id, round(r.cosine, 9)) for r in similarity.nearest(df, t, 4, block_bytes=n).collect()} for n in (1 << 20, 200))
    assert a == b and len(a) == 24


def test_candidates_are_scored_in_bounded_groups(spark):
    rows = [("p", f"c{i}", f"d{i}") for i in range(90)]
    m = spark.createDataFrame(rows, "generation_prompt string, query string, trigger string").withColumns({"score_trigger": F.lit(True), "score_query": F.lit(True)})
    out = canonical.score_candidates(m, lambda prompt, cs: [[-float(len(cs))] for _ in cs], block=10)
    got = out.select(F.max(-F.col("query_logprob_sum")).alias("most"), F.count("*").alias("n")).first()
    assert got.n == 90 and got.most < 40


def small_manifest(spark, n=40):
    rows = [(f"r{i}", "1.1", f"p{i % 3} ", f"q{i}", f"t{i}", i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "source_row_id string, manifest_version string, generation_prompt string, query string, trigger string, score_trigger boolean").withColumn("score_query", F.lit(True))


def test_token_scores_add_up(spark):
    m = small_manifest(spark)
    scorer = lambda prompt, cs: [[(c[0], -1.0), (c[1:], -float(c[1:]))] for c in cs]
    tokens = canonical.token_scores(m, scorer)
    assert tokens.count() == 2 * (40 + 20) and {tuple(r) for r in tokens.where("candidate = 'q7'").collect()} == {("p1 ", "q7", 0, "q", -1.0), ("p1 ", "q7", 1, "7", -7.0)}
    row = canonical.score_candidates(m, scorer).where("source_row_id = 'r6'").first()
    assert row["query_logprob_sum"] == -7 and row["trigger_token_count"] == 2 and row["difference"] == 0 and [t["token"] for t in row["query_tokens"]] == ["q", "6"]
    framed = canonical.score_candidates(m, scorer).where("source_row_id = 'r7'").first()
    assert framed["trigger_logprob_sum"] is None and framed["trigger_tokens"] is None


def test_scoring_stops_between_parts_and_resumes(spark, tmp_path):
    m, path, seen = small_manifest(spark), str(tmp_path / "log"), spark.sparkContext.accumulator(0)

    def scorer(prompt, candidates):
        seen.add(len(candidates))
        return [[-1.0] for _ in candidates]

    parts = sorted({r[0] for r in m.select(F.pmod(F.xxhash64("source_row_id"), F.lit(4))).collect()})
    first = m.where(F.pmod(F.xxhash64("source_row_id"), F.lit(4)) == parts[0]).count()
    calls, real = [], canonical.score_candidates

    def once(*args):
        if calls:
            raise RuntimeError("lost")
        calls.append(1)
        return real(*args)

    with pytest.MonkeyPatch.context() as patch, pytest.raises(RuntimeError, match="lost"):
        patch.setattr(canonical, "score_candidates", once)
        canonical.resume_scoring(m, scorer, path, "1.1", "s", parts=4)
    assert spark.read.parquet(path).count() == first
    out = canonical.resume_scoring(m, scorer, path, "1.1", "s", parts=4)
    assert out.count() == 40 == out.select("source_row_id").distinct().count() and seen.value == 60
    assert canonical.resume_scoring(m, scorer, path, "1.1", "s", parts=4).count() == 40 and seen.value == 60
    for manifest, version, settings, why in ((m, "1.1", "t", "'other_settings': 40"), (m, "1.0", "s", "'other_version': 40"), (m.withColumn("query", F.lit("x")), "1.1", "s", "'other_manifest': 40"), (small_manifest(spark, 39), "1.1", "s", "'unknown': 1")):
        with pytest.raises(ValueError, match=why):
            canonical.resume_scoring(manifest, scorer, path, version, settings)


def test_repeated_scores_are_an_error(spark):
    m = small_manifest(spark, 3)
    sha = text.fingerprint(m).first()["sha256"]
    done = spark.createDataFrame([("r1", "1.1", sha, "s")] * 2, "source_row_id string, manifest_version string, manifest_sha256 string, settings string")
    with pytest.raises(ValueError, match="'repeated': 1"):
        canonical.pending(m, done, "1.1", "s")
    assert canonical.pending(m, done.distinct(), "1.1", "s").count() == 2


def test_neighbours_equal_brute_force_and_skip_blocks(spark):
    import numpy as np

    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16)) * 4
    x = np.concatenate([centres[i % 12] + r.normal(size=16) * 0.2 for i in range(600)]).reshape(600, 16)
    x[7] = x[8] = x[9]  # equal cosines go by id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 16), (901, None), (902, [1.0] * 3), (903, [float("nan")] * 16), (904, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    targets = df.where("vec_id % 50 = 9 or vec_id >= 900").select(F.col("vec_id").alias("target"), F.col("embedding").alias("_t"))
    got = sorted((q["target"], -round(q["cosine"], 9), q["vec_id"]) for q in similarity.nearest(df, targets, 4, pivots=8, sample=200).collect())
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = []
    for t in range(9, 600, 50):
        cosine = np.round(unit @ unit[t], 9)
        want += sorted((t, -c, i) for i, c in enumerate(cosine.tolist()) if i != t)[:4]
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted(want)]
    points = similarity.pivots_of(df, 16, 8, 200)
    own = similarity.distance(unit @ points.T)
    block = own.argmin(axis=1) * similarity.RINGS + np.minimum((own.min(axis=1) * similarity.RINGS / 2).astype(int), similarity.RINGS - 1)
    asked = np.arange(9, 600, 50)
    least = np.array([-sorted(c for a, c, _ in want if a == t)[-1] for t in asked])
    compared = sum(len(similarity.wanted(own[asked], int(b), least)) * int((block == b).sum()) for b in np.unique(block))
    assert compared < 0.1 * len(asked) * 600


def test_neighbours_of_no_targets(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert similarity.nearest(df, df.where("false").select(F.col("vec_id").alias("target"), F.col("embedding").alias("_t")), 3).count() == 0


def test_pilot_changes_no_row_and_short_contexts_keep_all(spark):
    rows = [("big", f"w{i}", float(1 + i % 50)) for i in range(900)] + [("big", f"z{i}", 0.0) for i in range(100)] + [("short", f"s{i}", float(i < 3)) for i in range(12)]
    src = spark.createDataFrame(rows, "context string, token string, weight double").repartition(5)
    got = lambda pilot: {(r.context, r.rep, r.token): r.position for r in sampling.sample_orderings(src, 6, k=8, pilot=pilot).collect()}
    assert got(0) == got(4) == got(1) and len(got(4)) == 2 * 6 * 8
    kept = {r.context: r.n for r in sampling.within_pilot(src, 6, 8).groupBy("context").agg(F.count("*").alias("n")).collect()}
    assert kept["short"] == 6 * 12  # three tokens race, so no bound: all of the context goes on
    assert kept["big"] < 6 * 1000 / 4


def test_exact_median(spark):
    rows = [("a", float(i % 7)) for i in range(40)] + [("b", 1.0), ("b", 4.0), ("c", None), (None, 2.0), (None, 2.0), (None, 9.0), ("d", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {r.g: r.median for r in stats.exact_median(df, ["g"], "v").collect()} == {k: v for k, v in want.items() if v is not None}


@pytest.mark.parametrize(("rq", "rt", "name"), [(2, 1, "A"), (1, 2, "B"), (3, 6, "B"), (5, 4, "C"), (4, 5, "D")])
def test_regions(spark, rq, rt, name):
    """A: inside and below the trigger, where the set negates and the ordering doesn't; D: outside and above, the other way round."""
    assert one(spark, reports.region(F.lit(rq), F.lit(rt))) == name
    inside, above = rq <= 3, rq < rt
    assert (name in structures.NEGATED["set"], name in structures.NEGATED["ordering"]) == (inside, above)


def test_region_reports(spark):
    cell = ("c", "t", "q")
    trials = spark.createDataFrame([(*cell, "B"), (*cell, "A"), (*cell, None), ("c", "t", "r", "D"), ("c", "t", "r", "D"), ("c", "t", "r", "A")], "context string, trigger string, query string, region string")
    modal = reports.modal_regions(trials)
    assert {(r.query, r.region) for r in modal.collect()} == {("q", "A"), ("r", "D")}
    res = spark.createDataFrame([("m", "set", "c", "t", "q", -1.0, 0.2), ("m", "set", "c", "t", "r", -3.0, 0.4), ("m", "set", "c", "t", "none", -5.0, 0.9), ("m", "set", "e", "t", "q", -2.0, 0.1)], "source string, structure string, context string, trigger string, query string, log_likelihood double, negation_probability double")
    got = {r.context: r for r in reports.region_summary(res, modal, 30, 6).collect()}
    assert (got["c"].ll, got["c"].ll_critical, got["c"].cells, got["c"].critical_cells, got["c"].missing_cells, got["c"].missing_critical) == (-3.0, -2.0, 3, 2, 27, 4)
    assert got["e"].ll_critical is None and got["e"].missing_critical == 6
    assert {(r.context, r.region): r.p for r in reports.region_means(res, modal).collect()} == {("ALL", "A"): 0.2, ("ALL", "D"): 0.4, ("c", "A"): 0.2, ("c", "D"): 0.4}


def test_bootstrap_is_the_plain_one(spark):
    import hashlib

    import numpy as np

    means = {f"c{i}": float(i * i % 11) for i in range(9)}
    uniforms = lambda c, b: (int(hashlib.md5(f"boot|{c}|{b}".encode()).hexdigest()[:7], 16) + 0.5) / 2**28
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    drawn = []
    for b in range(1, 201):
        w = np.array([sum(uniforms(c, b) >= e for e in edges) for c in means])
        drawn.append((w * np.array(list(means.values()))).sum() / w.sum())
    df = spark.createDataFrame([("s", c, m) for c, m in means.items()], "structure string, context string, m double").repartition(4)
    r = reports.bootstrap_interval(df, ["structure"], "context", "m", 200).first()
    assert np.allclose([r.ci_low, r.ci_high], np.quantile(drawn, [0.025, 0.975]))


def test_ordered_matrix_and_human_cells(spark):
    cells = spark.createDataFrame([("c", "b", "x", 2, 0.5), ("c", "a", "y", 1, 0.1)], "context string, trigger string, query string, rank int, p double")
    rows, base = reports.axis(cells, "trigger", "appearance", "rank"), reports.axis(cells, "query", "base", "p")
    got = [(r.row, r.column, r.p) for r in reports.ordered_matrix(cells, rows, base, "p").orderBy("row", "column").collect()]
    assert got == [(1, 1, None), (1, 2, 0.1), (2, 1, 0.5), (2, 2, None)]
    assert [r.word for r in reports.axis(cells, "trigger", "alphabet").orderBy("place").collect()] == ["a", "b"]
    res = spark.createDataFrame([("ordering", 5, "c", "t", "q", 1), ("ordering", 10, "c", "t", "q", 0), ("set", 5, "c", "t", "q", 1)], "structure string, set_boundary int, context string, trigger string, query string, neg int")
    assert reports.human_cells(res).first()["human_rate"] == 0.5
    assert reports.human_cells(res.where("structure = 'set'")).first()["human_rate"] == 1.0


def test_gradation_fits_each_structure_in_its_regions(spark):
    rows = [("c", "A", 2, 1, 1), ("c", "A", 2, 1, 0), ("c", "A", 2, 2, 1), ("c", "D", 4, 1, 1), ("c", "D", 4, 2, 1), ("c", "C", 5, 2, 0)]
    fitted, likelihood = structures.query_gradation(spark.createDataFrame(rows, "context string, region string, query_rank int, half int, neg int"))
    assert {(r.structure, r.query_rank): (r.total, r.p) for r in fitted.collect()} == {("set", 2): (2, 0.5), ("ordering", 4): (1, 1.0), ("disjunction", 2): (1, 1.0), ("disjunction", 4): (1, 1.0)}
    got = {r.structure: (r.n, r.log_likelihood) for r in likelihood.collect()}
    assert got["set"] == (3, pytest.approx((math.log(0.5) + math.log(1e-10)) / 3)) and got["disjunction"] == (3, pytest.approx(0.0))
    assert got["conjunction"] == (3, pytest.approx(2 * math.log(1e-10) / 3))


def test_budgets_must_be_met(spark):
    need = spark.createDataFrame([("c", "a"), ("c", "b")], "context string, token string")
    family = spark.createDataFrame([("c", "a x", 0.5)], "context string, token string, score double")
    back = spark.createDataFrame([("b y", 1), ("b z", 2)], "token string, background_rank int")
    got = vocab.select_bigrams(need, family, back, 5, 1).orderBy("line_no").collect()
    assert [r.selection_source for r in got] == ["required", "required", "family", "background_core", "background_overflow"]
    with pytest.raises(PySparkException, match="more required"):
        vocab.select_bigrams(need, family, back, 1, 1).collect()
    with pytest.raises(PySparkException, match="fewer tokens"):
        vocab.select_bigrams(need, family, back, 6, 1).collect()
    assert vocab.select_bigrams(need, family, back, 6, 1, exact=False).count() == 5


def test_unit_and_provenance_rules(spark):
    good = canonical_rows(spark).withColumn("analysis_inclusion_status", F.lit("included"))
    assert canonical.analysis_units(good, {"d": 1}).count() == 1
    with pytest.raises(ValueError, match="expected"):
        canonical.analysis_units(good, {"d": 2})
    with pytest.raises(PySparkException, match="repeats"):
        canonical.analysis_units(good.unionByName(good)).collect()
    with pytest.raises(PySparkException, match="finite"):
        canonical.analysis_units(good.withColumn("query_logprob_mean", F.lit(float("nan")))).collect()
    df = spark.createDataFrame([("m", "r1", "/x/r1/", -1.0), ("m", "r1", "/x/r2/", float("inf"))], "model string, rev string, path string, s double")
    got = {r.field: (r.n_values, r.fault) for r in canonical.provenance(df, ["model", "rev"], revision="rev", path="path", scores=("s",)).collect()}
    assert got == {"model": (1, None), "rev": (1, None), "path": (2, "path"), "s": (1, "finite")}


def test_condition_manifests(spark):
    rows = lambda *r: spark.createDataFrame(r, "item_id string, trigger string, query string, prompt string")
    own, bare = rows(("1", "some", "all", "B: it is "), ("2", "warm", "hot", "B: so ")), rows(("1", "some", "all", None), ("2", "warm", "hot", None))
    m = canonical.condition_manifest({"ESI": own, "Eonly": bare}, "f")
    assert {r.generation_prompt for r in m.where("condition = 'Eonly'").collect()} == {"B: it is ", "B: so "}
    assert [r.item_id for r in canonical.combined_manifest(m).collect()] == ["ESI::1", "ESI::2", "Eonly::1", "Eonly::2"]
    with pytest.raises(PySparkException, match="no prompt of ESI"):
        canonical.condition_manifest({"ESI": own.limit(1), "Eonly": bare}, "f").collect()
    changed = m.withColumn("query", F.when(F.col("item_id") == "Eonly::2", None).otherwise(F.col("query"))).where("item_id <> 'ESI::1'")
    assert {(r.group_id, r.fault) for r in canonical.condition_faults(changed).collect()} == {("1", "coverage"), ("2", "differs")}
    with pytest.raises(ValueError, match="matched_conditions"):
        canonical.combined_manifest(changed)


def test_checks_while_writing_see_all_rows_and_empty_tables(spark):
    df = spark.range(100).repartition(7)
    kept, seen = files.observed(df, "t", F.col("id") < 10, n=F.count("*"), low=F.count_if(F.col("id") < 3))
    assert kept.count() == 10 and seen == {"n": 100, "low": 3}
    none, seen = files.observed(df.limit(0), "t", n=F.count("*"))
    assert none.count() == 0 and seen == {"n": 0}


def scored_plan(spark, tmp_path):
    """Scored trials whose 400,000 rows are a few KB on disk, and their plan."""
    rows = spark.range(400_000).select(F.lit("c").alias("context"), F.lit("t").alias("trigger"), F.concat(F.lit("q"), (F.col("id") % 4).cast("string")).alias("query"), (F.col("id") % 2).cast("int").alias("neg"))
    rows.repartition(1).write.parquet(str(tmp_path / "trials"))
    seen = spark.read.parquet(str(tmp_path / "trials"))
    pos = spark.range(4).select(F.lit("c").alias("context"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("token"), F.lit(0).alias("rep"), F.col("id").alias("position"))
    out = structures.run_experiment(seen, pos, 1, [2], ["set"], "x")
    return out, out._jdf.queryExecution().sparkPlan().toString()


def test_trials_are_never_the_broadcast_side(spark, tmp_path):
    out, plan = scored_plan(spark, tmp_path)
    assert "BuildLeft" not in plan
    got = out.groupBy("query").agg(F.count("*").alias("n"), F.sum("negation_probability").alias("p")).collect()
    assert {r["query"]: (r["n"], r["p"]) for r in got} == {f"q{i}": (100_000, 100_000.0 * (i < 2)) for i in range(4)}


def below(lines, i):
    """The lines of a printed plan that belong to the tree below line i."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    end = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(lines[i])), len(lines))
    return range(i + 1, end)


@pytest.mark.parametrize(
    "name",
    [
        "f15_counterfactual",
        "f25_ll_totals",
        "f6_log_likelihood",
        "i16_region_means",
        "i16_region_summary",
        "i17_context_spread",
        "i1_ll_by_context",
        "i20_diagnostics",
        "i2_ll_rollup",
        "i5_rate_points",
        "i6_rate_correlations",
        "i7_human_cells",
        "i15_mean_se",
        "i21_likelihoods_long",
        "i4_model_rates",
    ],
)
def test_no_query_broadcasts_answers(spark, name):
    """Answers go to every task only once they are summed up: each scan of the saved trials below a broadcast has an aggregate between."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        lines = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert any("/trials-" in line for line in lines)
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            tree = below(lines, i)
            summed = {k for a in tree if "Aggregate" in lines[a] for k in below(lines, a)}
            assert not [lines[k] for k in tree if "/trials-" in lines[k] and k not in summed]


def test_many_cells_are_joined_by_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(structures, "CELLS", 3)
    out, plan = scored_plan(spark, tmp_path)
    assert "Broadcast" not in plan.split("Scan")[0] and out.count() == 400_000


def test_word_counts_are_joined_by_key(spark):
    assert "Broadcast" not in q_reports._both(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()


def test_answers_are_made_by_tasks_for_their_number(spark, tmp_path):
    os.symlink("/root/testdata/sf0.001/documents.parquet", tmp_path / "documents.parquet")
    spark.range(3_000).select(F.col("id").alias("user_id")).repartition(1).write.parquet(str(tmp_path / "events.parquet"))
    made = study.trials(spark, str(tmp_path))
    assert made.count() == 3_000 * 120 and len(made.inputFiles()) >= 7


def test_a_task_of_the_sink_reads_few_files_of_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(study, "ANSWERS", 2_000)
    os.symlink("/root/testdata/sf0.001/documents.parquet", tmp_path / "documents.parquet")
    spark.range(3_000).select(F.col("id").alias("user_id")).repartition(1).write.parquet(str(tmp_path / "events.parquet"))
    sizes = [r["count"] for r in study.trials(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3_000 * 120 and max(sizes) <= 32 * 2_000 * 1.5  # hashed users: the largest files, which one task reads, hold more than the mean


TEXTS = ["The cat, the CAT", "?the cat", "the cat1", "12", "", None, "cat", "été a"]


def texts_at(spark, tmp_path):
    """documents of TEXTS below tmp_path."""
    rows = [(i, t, "en", "src1") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_words_and_pairs_of_odd_texts(spark, tmp_path):
    d = texts_at(spark, tmp_path)
    assert {r["token"]: r["n"] for r in study.unigrams(spark, d).collect()} == {"the": 4, "cat": 5, "t": 1, "a": 1}
    assert {r["token"]: r["count"] for r in study.bigrams(spark, d).collect()} == {"the cat": 4, "cat the": 1, "t a": 1}


def test_pairs_cut_a_text_once_and_are_shuffled_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(study, "saved", lambda df, label: df)
    d = texts_at(spark, tmp_path)
    plan = q_vocab.gbi(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(text") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["d13_bigram_scores", "d14_background_bigrams", "p1_corpus_bigram_scorer"])
def test_scored_pairs_read_the_documents_once(spark, tmp_path, monkeypatch, name):
    d, read, documents = texts_at(spark, tmp_path), [], study.documents
    monkeypatch.setattr(study, "documents", lambda *a: read.append(a) or documents(*a))
    got = {r["token"]: r["score" if "score" in r else "logprob"] for r in registry.queries()[name](spark, d).collect()}
    want = {"the cat": 1.0, "cat the": 0.2, "t a": 1.0}
    assert len(read) == 1 and got == pytest.approx({k: math.log(v) for k, v in want.items()} if name[0] == "p" else want)


def test_shard_lines_are_counted_once(spark, tmp_path):
    lines = q_vocab._lines(spark, texts_at(spark, tmp_path))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert sorted(tuple(r) for r in lines.collect()) == [("ca", "Cat\t1901\t5\t4"), ("ca", "cat_X\t1900\tmany\t1"), ("th", "The\t1901\t4\t3"), ("th", "the\t1900")]
