import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import cleaning as C, comparison as X, joins as J, splits as S
from corvane.sources import logs, readers, sinks
from tests.conftest import rows


def test_dedup_keeps_the_first_row_and_conflicting_labels(spark):
    df = spark.createDataFrame([(3, "k", 1), (1, "k", 1), (2, "k", 0), (4, "j", 1)], "id int, key string, y int")
    assert rows(C.dedup_first(df, ["key", "y"], "id"), "id") == [(1, "k", 1), (2, "k", 0), (4, "j", 1)]
    assert [r["key"] for r in C.label_conflicts(df, "key", "y").collect()] == ["k"]


def test_keys(spark):
    df = spark.createDataFrame([("  A  b\nC ",), ("   ",), (None,)], "k string")
    assert [r[0] for r in df.select(C.normalise_key("k")).collect()] == ["a b c", None, None]
    assert C.valid_key(df, "k").count() == 1


def test_sanitize_median_zero_and_all_null(spark):
    df = spark.createDataFrame([("1",), ("x",), ("NaN",), ("Infinity",), ("3",), ("1e9",)], "v string").withColumn("e", F.lit(None).cast("string"))
    got = [tuple(r) for r in C.sanitize(df, ["v", "e"]).collect()]
    assert [g[0] for g in got] == [1.0, 3.0, 3.0, 3.0, 3.0, 1e6] and {g[1] for g in got} == {0.0}
    assert [r[0] for r in C.sanitize(df, ["v"], 0.0, limit=None).collect()] == [1.0, 0.0, 0.0, 0.0, 3.0, 1e9]


def test_unseen_class_is_null_and_one_hot_has_other(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",)], "c string")
    fit = df.where("c <> 'z'")
    assert {r["c"]: r["code"] for r in C.encode_labels(df, "c", "code", fit).collect()} == {"a": 0, "b": 1, "z": None}
    assert [r[0] for r in df.select(C.one_hot("c", ["a", "b"])).collect()] == [[0, 1, 0], [1, 0, 0], [0, 0, 1]]


def greedy(sizes, train, valid):
    n = sum(s for _, s, _ in sizes)
    t = v = 0
    out = {}
    for g, s, _ in sorted(sizes, key=lambda x: (-x[1], x[2])):
        if t + s <= train * n:
            t += s
            out[g] = "train"
        elif t + v + s <= (train + valid) * n:
            v += s
            out[g] = "valid"
        else:
            out[g] = "test"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_group_split_equals_the_sequential_fill(spark, seed):
    rng = random.Random(seed)
    data, i, sizes = [], 0, []
    for g in range(rng.randint(5, 60)):
        n = rng.choice([1, 1, 1, 2, 2, 3, 5, 8, 40 if seed % 2 else 4])
        sizes.append((f"g{g}", n, i))
        data += [(i + j, f"g{g}") for j in range(n)]
        i += n
    got = {r["g"]: r["split"] for r in S.group_split(spark.createDataFrame(data, "id int, g string"), "g", "id").select("g", "split").distinct().collect()}
    assert got == greedy(sizes, 0.8, 0.1)


def test_folds_are_even_and_stratified(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    for strata in (None, ["y"]):
        n = S.folds(df, "id", 5, strata=strata).groupBy(*(strata or []), "fold").count().toPandas()
        per = n.groupby(strata[0])["count"] if strata else [(0, n["count"])]
        assert all(c.max() - c.min() <= 1 for _, c in per)


def test_arms_must_cover_the_same_rows(spark):
    df = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 0, 1), ("a", 2, 1, 1)], "arm string, row_id int, y int, pred int")
    with pytest.raises(Exception, match="same rows"):
        J.pair_arms(df, "arm", "a", "b", ["row_id"]).collect()
    assert J.pair_arms(df, "arm", "a", "b", ["row_id"], check=False).count() == 1


def test_join_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "dup", 5), (1, "dup", 6)], "k int, v string, w int")
    assert J.join_features(a, b, key="k").columns == ["k", "v", "w"] and J.join_features(a, b, key="k").count() == 2
    with pytest.raises(ValueError, match="not unique"):
        J.join_features(a, b, key="k", assert_unique=True)
    with pytest.raises(ValueError, match="without a match"):
        J.require_match(a, b.select("k", "w"), "k")


def test_overlap_counts_agree_with_all_pairs(spark):
    rng = random.Random(1)
    ci = [("d", f"m{i}", lo, lo + rng.randint(0, 6)) for i, lo in enumerate(rng.choices(range(20), k=25))]
    got = {r["method"]: (r["n_below"], r["n_above"], r["n_overlap"]) for r in J.overlap_counts(spark.createDataFrame(ci, "d string, method string, ci_lo int, ci_hi int"), ["d"]).collect()}
    for _, m, lo, hi in ci:
        below, above = sum(h < lo for *_, h in ci), sum(x[2] > hi for x in ci)
        assert got[m] == (below, above, len(ci) - 1 - below - above)


def test_scan_skips_interval_files_and_reads_path_columns(spark, tmp_path):
    for ds, model, name in (("en", "gbt", "CatBoost_metrics"), ("en", "gbt", "CatBoost_ci_metrics"), ("fr", "rf", "XGBoost_metrics")):
        d = tmp_path / ds / model
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{name}.json").write_text(json.dumps({"MCC": 0.5}))
    got = rows(readers.scan_metrics(spark, str(tmp_path), "MCC double, RMSE double", ["dataset", "model"], "*_metrics.json"), "dataset")
    assert got == [(0.5, None, "en", "gbt", "CatBoost_metrics"), (0.5, None, "fr", "rf", "XGBoost_metrics")]


def test_aliased_header_and_missing_split(spark, tmp_path):
    (tmp_path / "a.tab").write_text('ID\tX\tY\n1\t"a ""q"" b"\t2.5\n')
    df = readers.read_aliased(spark, str(tmp_path / "a.tab"), {"ID": "id", "X": "e", "Y": "y"}, {"id": "bigint", "e": "string", "y": "double"})
    assert rows(df) == [(1, 'a "q" b', 2.5)]
    (tmp_path / "t.csv").write_text("k,y\na,1\n")
    data, status = readers.read_if_exists(spark, {"train": str(tmp_path / "t.csv"), "valid": str(tmp_path / "no.csv")}, "k string, y int")
    assert rows(data) == [("a", 1, "train")] and dict(rows(status)) == {"train": "read", "valid": "missing"}


def test_text_tables_carry_label_and_header(spark):
    text = [r"\label{tab:s2_x}", "Modality & MCC \\\\", r"\midrule", r"\textbf{Full} & $0.51^{*}$ \\", r"FT & 0.4 & extra \\", r"\label{tab:s3_y}", r"PC & 0.3 \\"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc string, line_no bigint, line string")
    got = logs.extract_text_tables(lines, r"\\label\{tab:(\w+)\}", r"^Modality &", r"&.*\\\\$").where("`column` = 'MCC'")
    assert [(r["label"], r["line_no"], r["number"]) for r in got.orderBy("line_no").collect()] == [("s2_x", 3, 0.51), ("s3_y", 6, 0.3)]


def test_last_block_runs_to_the_last_line_and_unstamped_lines_are_skipped(spark):
    text = ["2024-01-01 23:59:00 | Block dataset=a", "  no stamp Block dataset=z", "2024-01-02 00:00:30 | Block dataset=b", "2024-01-02 00:02:00 | done"]
    log = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "log string, line_no bigint, line string")
    parsed = logs.parse_log(log, "Block", "dataset")
    got = X.block_durations(parsed, ["log"], "ts", "line_no", "dataset").orderBy("line_no").collect()
    assert [(r["dataset"], r["seconds"]) for r in got] == [("a", 90.0), ("b", 90.0)]


def test_upsert_pending_and_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert rows(sinks.upsert_by_key(old, new, ["k"]), "k") == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(sinks.pending(new, old, ["k"])) == [(3, "c")]
    assert rows(sinks.changed_rows(old, new, ["k"], ["v"]), "k") == [(1, "removed"), (2, "changed"), (3, "added")]


def test_staircase_compares_with_the_last_kept_stage(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate([0.5, 0.504, 0.505, 0.5051, 0.6])], "d string, stage int, value double")
    assert [r["kept"] for r in X.staircase(df, ["d"], "stage", "value").orderBy("stage").collect()] == [True, False, False, True, True]


def test_missing_artifact_promotes_the_next(spark):
    df = spark.createDataFrame([("d", f"m{i}", 1.0 - i / 10, i != 0) for i in range(7)], "d string, m string, v double, ok boolean")
    got = X.top_available(df, ["d"], "m", "v", "ok", 5).orderBy("rank").collect()
    assert [(r["m"], r["original_rank"], r["rank"]) for r in got] == [(f"m{i}", i + 1, i) for i in range(1, 6)]


def test_cell_rules_one_by_one(spark):
    from corvane.functions.text import clean_cell

    cases = {
        r" \textbf{X}\textsuperscript{a}$^*$ ": "X", r"\textsuperscript{ab}Y": "Y", r"\emph{a b}": "a b", r"1.5$^{*}$": "1.5", r"$0.42$": "0.42",
        r"50\% \& more": "50% & more", r"model\_name": "model_name", r"{grouped}": "grouped", "plain": "plain",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", clean_cell(F.col("raw")).alias("got")).collect())


def test_shared_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace


    from corvane.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
