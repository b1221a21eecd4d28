import random

from foldmill.operators import folds, manifest, pooling
from foldmill.operators.align import align, with_folds


def rows(spark, n=300, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(f"g{r.randrange(60)}", r.choice("abc"), i) for i in range(n)], "g string, label string, id int")


def test_groups_stay_whole_and_classes_even(spark):
    df = rows(spark)
    placed = folds.assign_folds(df, folds.group_folds(df, "g", "label"), "g")
    folds.check_folds(placed, "g")
    groups = folds.group_folds(df, "g", "label").toPandas()
    for _, part in groups.groupby("label"):
        sizes = part.groupby("fold").size().reindex(range(5), fill_value=0)
        assert sizes.max() - sizes.min() <= 1
    again = folds.group_folds(df.orderBy("id", ascending=False), "g", "label").toPandas()
    assert dict(zip(groups.g, groups.fold)) == dict(zip(again.g, again.fold))


def test_majority_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2), ("q", 2), ("q", 1), ("r", None)], "g string, label int")
    assert {r.g: r.label for r in folds.majority_label(df, "g", "label").collect()} == {"p": 1, "q": 2}


def test_balanced_groups(spark):
    df = rows(spark, 2000)
    placed = folds.assign_folds(df, folds.balanced_group_folds(df, "g", "label"), "g")
    folds.check_folds(placed, "g")


def test_split_rule(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "fold int")
    got = {(r.test_fold, r.fold): r.split for r in folds.split_table(df).collect()}
    assert got[4, 4] == "test" and got[4, 0] == "val" and {got[4, k] for k in (1, 2, 3)} == {"train"} and len(got) == 25


def test_leaks_are_found(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("b", 2)], "g string, fold int")
    assert [r.g for r in folds.leaking_groups(df, "g").collect()] == ["a"]
    assert [r.g for r in folds.shared_groups(df, "g", 0).collect()] == ["a"] and folds.shared_groups(df, "g", 2).count() == 0


def test_two_diagnoses_make_two_groups_in_one_fold(spark):
    v = spark.createDataFrame([("P1", "DN", 0, 3, [1.0, 2.0]), ("P1", "DN", 0, 3, [3.0, 4.0]), ("P1", "MIA", 1, 3, [5.0, 5.0])], "patient_id string, diagnosis string, label int, fold int, features array<float>")
    got = {r.group_id: (r.features, r.n_rows, r.fold) for r in pooling.pool_patients(v).collect()}
    assert got == {"P1__DN": ([2.0, 3.0], 2, 3), "P1__MIA": ([5.0, 5.0], 1, 3)}
    texts = spark.createDataFrame([(" P1\n", "x")], "patient_id string, full_report string")
    assert align(pooling.pool_patients(v), texts).count() == 2
    assert pooling.inconstant(v, ["patient_id"], ["fold"]).count() == 0


def test_missing_fold_is_an_error(spark):
    import pytest

    groups = spark.createDataFrame([("a",), ("b",)], "group_id string")
    known = spark.createDataFrame([("a", 1)], "group_id string, fold int")
    assert with_folds(groups.where("group_id = 'a'"), known).first().fold == 1
    with pytest.raises(Exception, match="no fold for group b"):
        with_folds(groups, known).collect()


def test_manifest_operators(spark):
    df = rows(spark).withColumnRenamed("id", "key")
    assert manifest.sample_per_class(df, "key", "label", 7).groupBy("label").count().toPandas()["count"].tolist() == [7, 7, 7]
    assert manifest.sample(df, "key", 5).collect() == manifest.sample(df, "key", 5).collect()
    done = df.where("key < 290").select("key")
    assert sorted(r.key for r in manifest.pending(df, done, "key").collect()) == list(range(290, 300))
    wide = manifest.fold_class_table(folds.stratified_folds(df, "key", "label"), "g", "label", ["a", "b", "c"])
    assert wide.count() == 5


def test_image_choice_and_defaults(spark):
    df = spark.createDataFrame([("a.jpg", "s/a.png", "DN", "P1"), ("b.jpg", "s/b.png", "MIA", "P2"), ("c.jpg", None, "Other", "P3")], "image_path string, segmented_path string, diagnosis string, patient_id string")
    files = spark.createDataFrame([("s/a.png",), ("b.jpg",), ("a.jpg",)], "path string")
    assert {r.image for r in manifest.choose_images(df, files).collect()} == {"s/a.png", "b.jpg", "c.jpg"}
    assert {r.image for r in manifest.choose_images(df.drop("segmented_path"), files).collect()} == {"a.jpg", "b.jpg", "c.jpg"}
    from foldmill.schema import CLASSES, name_of

    full = manifest.with_defaults(df, CLASSES)
    assert {(r.label, r.folder_name) for r in full.collect()} == {(0, "P1"), (1, "P2"), (None, "P3")}
    assert manifest.with_defaults(full, CLASSES).columns == full.columns
    assert [r[0] for r in full.select(name_of(full.label)).collect()] == ["DN", "MIA", None]
    assert [r.image_path for r in manifest.missing_images(df, files).collect()] == ["c.jpg"]
    crops = spark.createDataFrame([(True, True), (False, True), (False, False)], "fallback boolean, readable boolean")
    assert manifest.crop_counters(crops).first().asDict() == {"n": 3, "n_fallback": 1, "n_unreadable": 1}


def unevenness(held, totals, n):
    return sum((held[f][c] / (totals[c] / n) - 1) ** 2 for f in range(n) for c in range(len(totals)) if totals[c])


def test_greedy_folds_of_skewed_groups_like_enumeration(spark):
    """One class lies in three groups: no assignment of them spreads it better by more than one group, and the rest fills up."""
    import itertools

    n, rows = 3, []
    sizes = {"a": [40, 30, 20], "b": [6, 5, 4, 3, 2, 2, 2, 1, 1, 1], "c": [9, 1]}
    group = 0
    for c, counts in sizes.items():
        for m in counts:
            rows += [(f"g{group}", c)] * m
            group += 1
    rows += [("g0", "b")] * 3 + [("both", "b"), ("both", "c"), (None, "a"), ("none", None)]
    df = spark.createDataFrame(rows, "g string, c string")
    got = {r.g: r.fold for r in folds.greedy_group_folds(df, "g", "c", n).collect()}
    assert set(got) == {r[0] for r in rows if r[0] and r[1]} and set(got.values()) <= set(range(n))
    known = [r for r in rows if r[0] and r[1]]
    totals = [sum(c == k for _, c in known) for k in "abc"]
    by_group = {g: [sum(r == (g, k) for r in known) for k in "abc"] for g in got}

    def held(placed):
        return [[sum(by_group[g][k] for g in placed if placed[g] == f) for k in range(3)] for f in range(n)]

    large = ["g0", "g1", "g2"]
    best = min(unevenness(held({**got, **dict(zip(large, f))}), totals, n) for f in itertools.product(range(n), repeat=3))
    assert unevenness(held(got), totals, n) <= best + 1e-9
    mine = held(got)
    for k in (1, 2):  # within one group of even
        assert max(abs(row[k] - totals[k] / n) for row in mine) <= max(v[k] for v in by_group.values())
    assert folds.greedy_group_folds(df.limit(0), "g", "c", n).collect() == []


def test_kinds_fill_what_is_open():
    given = folds.placed_kinds([((90, 0), 1), ((1, 1), 60), ((1, 0), 90), ((0, 1), 60)], [240, 120], 3)
    held = [[90 * given[0][f] + given[1][f] + given[2][f], given[1][f] + given[3][f]] for f in range(3)]
    assert [sum(g) for g in given] == [1, 60, 90, 60]
    assert all(abs(a - 80) <= 10 for a, _ in held if a != 90) and all(abs(b - 40) <= 1 for _, b in held)
    import random

    r = random.Random(1)
    for _ in range(50):
        kinds = [([r.randrange(0, 5) for _ in range(3)], r.randrange(1, 40)) for _ in range(r.randrange(1, 12))]
        totals = [sum(p[c] * m for p, m in kinds) for c in range(3)]
        given = folds.placed_kinds(sorted(kinds, reverse=True), totals, 5)
        assert [sum(g) for g in given] == [m for _, m in sorted(kinds, reverse=True)] and all(x >= 0 for g in given for x in g)


def test_more_kinds_than_are_placed(spark, monkeypatch):
    monkeypatch.setattr(folds, "KINDS", 3)
    rows = [(f"g{i}", c) for i in range(60) for c in "ab" for _ in range(1 + i % 7 if c == "a" else i % 3)]
    df = spark.createDataFrame(rows, "g string, c string")
    got = {r.g: r.fold for r in folds.greedy_group_folds(df, "g", "c", 3).collect()}
    assert set(got) == {g for g, _ in rows} and set(got.values()) == {0, 1, 2}
