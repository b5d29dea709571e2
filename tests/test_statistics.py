"""Statistics against published reference values of a twelve-row data set, and their guards."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import special
from tallyframe.operators import association, compare, describe, evaluate, features, profile, relate, segment

#: The rows of the validation data set. The numbers expected of them below are fixed values too.
ROWS = [
    (1, "A", "A", 72, 60, 66, 21, "High"), (2, "A", "A", 81, 65, 68, 22, "High"), (3, "A", "A", 77, 70, 74, 24, "Medium"), (4, "A", "A", 85, 68, 72, 23, "High"),
    (5, "A", "B", 79, 72, 75, 25, "Medium"), (6, "A", "B", 88, 75, 80, 20, "High"), (7, "B", "B", 88, 64, 68, 20, "High"), (8, "B", "B", 91, 69, 72, 22, "High"),
    (9, "B", "C", 79, 71, 75, 25, "Medium"), (10, "B", "C", 94, 73, 76, 24, "High"), (11, "B", "C", 86, 76, 80, 23, "High"), (12, "B", "C", 90, 78, 82, 26, "Medium"),
]


def close(a, b, rel=1e-6):
    assert a == pytest.approx(b, rel=rel, abs=1e-9), (a, b)


@pytest.fixture(scope="module")
def twelve(spark):
    rows = [tuple(float(v) if 3 <= i <= 6 else v for i, v in enumerate(r)) for r in ROWS]
    return spark.createDataFrame(rows, "ID int, Group2 string, Group3 string, Score double, Pre double, Post double, Age double, Satisfaction string").persist()


def test_t_tests(twelve):
    one = compare.ttest_one(twelve, "Score", 80.0).first()
    for name, value in {"n": 12, "mean": 84.1666666667, "t": 2.19957772, "df": 11, "p": 0.05012306, "diff": 4.166666666666671, "ci_low": -0.002666114927277974, "ci_high": 8.33599944826062, "effect": 0.6349633948381789}.items():
        close(one[name], value)
    welch = compare.ttest_welch(twelve, "Score", "Group2").first()
    for name, value in {"t": -2.43526041, "df": 9.903610618764063, "p": 0.03535206, "diff": -7.666666666666671, "ci_low": -14.690540065941644, "ci_high": -0.6427932673916992, "effect": -1.2978445424590728}.items():
        close(welch[name], value)
    seen = compare.ttest_welch(twelve.withColumn("o", -F.col("ID")), "Score", "Group2", "first_seen", "o").first()
    close(seen["diff"], 7.666666666666671)
    paired = compare.ttest_paired(twelve, "Post", "Pre").first()
    for name, value in {"t": 15.06962036, "p": 1.0854287e-08, "diff": 3.9166666666666665, "ci_low": 3.344620058883157, "ci_high": 4.488713274450176, "effect": 4.350224687146681}.items():
        close(paired[name], value)


def test_anova_and_tukey(twelve):
    a = compare.anova(twelve, "Score", "Group3").first()
    for name, value in {"f": 2.68887015, "p": 0.12147403, "df_between": 2, "df_within": 9, "eta_squared": 0.3740323715693174, "omega_squared": 0.2196512775523632}.items():
        close(a[name], value)
    close(a["ss_between"] + a["ss_within"], sum((r[3] - 1010 / 12) ** 2 for r in ROWS))
    b = compare.brown_forsythe(twelve, "Score", "Group3").first()
    close(b["f"], 0.2671232876712329)
    close(b["p"], 0.771440765620534)
    want = {"AB": (-7.75, 0.19143071903444164, -19.081629941655855, 3.5816299416558532), "AC": (-8.5, 0.1459734670534687, -19.831629941655855, 2.8316299416558532), "BC": (-0.75, 0.9813892803021028, -12.081629941655853, 10.581629941655853)}
    for r in compare.tukey(twelve, "Score", "Group3").collect():
        for got, value in zip((r["diff"], r["p"], r["ci_low"], r["ci_high"]), want[r["level1"] + r["level2"]], strict=True):
            close(got, value)
    two = compare.group_rows(twelve, "Score", "Group2")
    pooled = compare.one_way(two, 2).first()["f"]
    close(pooled, (7.666666666666671 / math.sqrt((5.715476 ** 2 + 5.176872 ** 2) / 6)) ** 2, 1e-4)
    assert compare.anova(twelve, "Score", "Group2").count() == 0 and compare.ttest_welch(twelve, "Score", "Group3").count() == 0


def test_correlation(twelve):
    p = relate.pearson(twelve, "Score", "Age").first()
    for name, value in {"r": -0.019872306088922622, "p": 0.9511212379924456, "ci_low": -0.5870784410723632, "ci_high": 0.560420768900868}.items():
        close(p[name], value)
    s = relate.spearman(twelve, "Score", "Age").first()
    close(s["r"], -0.06725759, 1e-6)
    close(s["p"], 0.83547754)
    exact = relate.pearson(twelve.withColumn("Twice", 2 * F.col("Age")), "Age", "Twice").first()
    assert exact["r"] == 1 and exact["p"] == 0 and (exact["ci_low"], exact["ci_high"]) == (1, 1)
    assert relate.pearson(twelve.withColumn("One", F.lit(1.0)), "Age", "One").first()["r"] is None
    with pytest.raises(ValueError):
        relate.pearson(twelve, "Age", "Age")


def test_chi_square(twelve):
    c = relate.chi_square(twelve, "Group3", "Satisfaction").first()
    for name, value in {"chi2": 0.75, "df": 2, "p": 0.6872892787909721, "cramers_v": 0.25, "min_expected": 1.3333333333333333, "pct_expected_lt_5": 100}.items():
        close(c[name], value)
    assert c["warning"] and relate.crosstab_table(twelve, "Group3", "Satisfaction").count() == 3


def test_regression(twelve):
    one = relate.ols_fit(twelve, "Score", ["Age"])
    close(one["r2"], 0.00039490854929180585)
    close(one["f_p"], 0.9511212379924502)
    two = relate.ols_fit(twelve, "Score", ["Age", "Pre", "Score"])
    for name, value in {"r2": 0.39664687185829217, "adj_r2": 0.2625683989379126, "f": 2.958318835372141, "f_p": 0.10293713088753945, "rmse": 5.63509109686583}.items():
        close(two[name], value)
    want = {"Intercept": (51.181260155262734, 24.342883080007, 2.1025143154591373, 0.06485310630909817, -3.886167167334328, 106.24868747785979), "Pre": (0.9341036288138662, 0.38421461017643205, 2.431202781135585, 0.03790769901047126, 0.06494979635153042, 1.803257461276202)}
    for row in two["coefficients"]:
        if row["term"] in want:
            for got, value in zip(list(row.values())[1:], want[row["term"]], strict=True):
                close(got, value)
    residual = relate.ols_residuals(twelve, "Score", ["Age", "Pre"]).agg(F.sum("residual")).first()[0]
    assert abs(residual) < 1e-9
    for predictors, more in ((["Age", "Double"], twelve.withColumn("Double", 2 * F.col("Age"))), (["Age"], twelve.limit(2)), ([], twelve)):
        with pytest.raises(ValueError):
            relate.ols_fit(more, "Score", predictors)


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, "b"), (5.0, None), (7.0, "b"), (None, "")], "x double, g string")
    assert compare.ttest_one(df, "x", 0.0).first()["n"] == 4 and compare.ttest_one(df, "x", 0.0, missing="zero").first()["n"] == 6
    assert {r["value"]: r["n"] for r in describe.frequency(df, "g").collect()} == {"a": 2, "b": 2}
    assert describe.valid_counts(df, "g").first().asDict() == {"valid": 4, "missing": 2, "distinct": 2}
    with pytest.raises(ValueError):
        compare.ttest_one(df, "x", 0.0, missing="mean").first()
    single = describe.describe(df.limit(1), ["x"]).first()
    assert single["sd"] == 0 and single["n"] == 1


def test_shape_and_plots(twelve):
    s = describe.shape(twelve, ["Score"]).first()
    close(s["skewness"], -0.343175, 1e-5)
    close(s["kurtosis"], -0.701373, 1e-5)
    h = describe.histogram(twelve, "Score").collect()
    assert len(h) == 5 and sum(r["n"] for r in h) == 12
    q = sorted(describe.qq_points(twelve, "Age").collect(), key=lambda r: r["rank"])
    assert [r["observed"] for r in q] == sorted(r[6] for r in ROWS) and q[0]["theoretical"] == pytest.approx(-q[-1]["theoretical"])
    b = {r["level"]: r for r in describe.boxplot(twelve, "Score", "Group2").collect()}
    assert b["A"]["median"] == 80 and b["A"]["whisker_low"] >= 72
    assert describe.fit_line(twelve.withColumn("One", F.lit(1.0)), "One", "Score").first()["slope"] is None
    ranks = relate.average_ranks(twelve, "Age")
    assert ranks.join(twelve.withColumnRenamed("Age", "value"), "value").agg(F.sum("rank")).first()[0] == 78


def test_distributions():
    close(special.t_critical(11.0), 2.200985160082949)
    close(special.chi2_tail(3.841458820694124, 1), 0.05)
    close(special.f_tail(4.256494729093746, 2, 9), 0.05)
    close(special.tukey_tail(3.948492, 3, 9), 0.05, 1e-4)
    close(special.t_two_sided(0.5, 3), 0.6514481, 1e-5)
    assert special.t_two_sided(40.0, 10) == pytest.approx(2.3496e-12, rel=1e-3)
    assert math.isnan(special.f_tail(float("nan"), 1, 1)) and special.beta_inc(2, 3, 0) == 0 and special.beta_inc(2, 3, 1) == 1
    assert compare.p_text(1e-9) == "< .001" and compare.verdict(0.2).startswith("Not")


def test_profile(spark, twelve):
    levels = {v.name: (v.storage, v.level) for v in profile.infer_variables(twelve)}
    assert levels["Score"] == ("numeric", "Scale") and levels["Satisfaction"] == ("text", "Ordinal") and levels["Group2"] == ("text", "Nominal")
    odd = spark.createDataFrame([("12d", "0x1F", "1", "3"), ("1f", "Infinity", "2.5", "1"), ("NaN", "1_000", " 12 ", "2"), ("7", "5", "", "3")], "a string, b string, c string, my_rating string")
    assert [v.storage for v in profile.infer_variables(odd)] == ["text", "text", "numeric", "numeric"]
    assert profile.infer_variables(odd)[3].level == "Ordinal"
    variables = profile.relabel(profile.infer_variables(twelve), "Age", "Age in years", "Ordinal")
    assert "Age" not in profile.scale_variables(variables) and "Age" in profile.group_variables(variables) and profile.advice(variables)
    rows = [(i, 1, i % 2, i % 20, i, f"2024-01-{i % 28 + 1:02d}", "x" if i % 3 else None) for i in range(60)]
    f = profile.field_roles(spark.createDataFrame(rows, "row_id int, same int, two int, twenty int, many int, start_date string, gap string"))
    assert f.excluded == ["row_id", "same"] and (f.binary, f.discrete, f.continuous, f.datetime, f.categorical) == (["two"], ["twenty"], ["many"], ["start_date"], ["gap"])


def test_associations(spark, twelve):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11), "ab"[i % 2], "xyz"[i % 3], float(3 * i)) for i in range(90)], "id int, a double, b double, c string, d string, e double")
    pairs = association.associations(df).collect()
    assert len(pairs) == 3 + 1 + 6 and all(0 <= r["q_value"] <= 1 and r["q_value"] >= r["p_value"] - 1e-12 for r in pairs)
    ordered = sorted(pairs, key=lambda r: r["p_value"])
    assert all(x["q_value"] <= y["q_value"] + 1e-12 for x, y in zip(ordered, ordered[1:], strict=False))
    spear = next(r for r in pairs if {r["field_1"], r["field_2"]} == {"a", "b"})
    close(spear["signed_effect"], relate.spearman(df, "a", "b").first()["r"])
    tied = df.select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert association.numeric_pairs(tied, ["x", "y"]).first()["effect"] is None
    with pytest.raises(ValueError):
        association.associations(df.select("id", "a"))


def test_measures(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    m = evaluate.binary_metrics(d, "y", "s", 0.5).first()
    close(m["pr_auc"], 0.8333333333)
    close(m["roc_auc"], 0.75)
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (1, 1, 0, 2)
    points = spark.createDataFrame([(0, 0.0, 0.0), (0, 0.0, 1.0), (1, 5.0, 5.0), (1, 5.0, 6.0)], "c int, x double, y double")
    assert evaluate.silhouette(points, ["x", "y"], "c") == pytest.approx(0.8588, abs=2e-3)
    none = evaluate.selective(spark.createDataFrame([(0, [0.4, 0.35, 0.25])], "y int, p array<double>"), "y", "p").first()
    assert none["coverage"] == 0 and none["selective_accuracy"] is None


def test_features(spark):
    df = spark.createDataFrame([(1980, "05-03-2020", 1.0, "a"), (1990, "31/12/2021", None, None), (None, "bad", 5.0, "a")], "Year_Birth int, Dt_Customer string, x double, c string")
    rows = features.derived_fields(df).collect()
    assert [r["Customer_Age"] for r in rows] == [46, 36, None] and [r["Customer_Tenure_Days"] for r in rows] == [2128, 1462, None]
    filled = features.impute(df, features.medians(df, ["x"]), features.modes(df, ["c"])).collect()
    assert [r["x"] for r in filled] == [1, 3, 5] and [r["c"] for r in filled] == ["a", "a", "a"]
    prep = features.Preprocessor(df.select("x", "c"), ["x", "c"])
    out = prep.transform(spark.createDataFrame([(2.0, "new"), (2.0, "a")], "x double, c string")).collect()
    assert [r["features"].toArray().tolist() for r in out] == [[2, 0], [2, 1]]


def test_segments(spark):
    df = spark.createDataFrame([(20.0, 1.0, 2.0, 0), (22.0, 1.5, 2.0, 1), (21.0, 1.2, 3.0, 0), (80.0, 9.0, 8.0, 1), (85.0, 9.5, 9.0, 0), (82.0, 9.1, 8.0, 1)], "Income double, MntWines double, NumStorePurchases double, Response int")
    labelled, evidence = segment.segments(df)
    groups = [sorted(r[0] for r in labelled.filter(F.col("segment") == k).select("Income").collect()) for k in (0, 1)]
    assert sorted(groups) == [[20, 21, 22], [80, 82, 85]] and evidence["silhouette"] > 0.8
    with pytest.raises(ValueError):
        segment.segments(df.select("Income", "Response"))
