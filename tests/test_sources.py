"""Readers of stat lines, selections, paired filters and configurations."""

import contextlib
import io

import pytest

from tidesignal.operators import apply
from tidesignal.sources import files


def test_stat_lines_keep_the_latest_row_and_trailing_numbers(spark, tmp_path):
    for name, lines in {"a": ["2024-01-01, x, rate 0.5, missing 3", "2024-01-03, x, rate: 1, missing: none", "2024-01-02, y, done 0.25, 7"], "b": ["2024-01-05, x, , ", "no date, y, 0.1, 2", ""]}.items():
        (tmp_path / f"source={name}").mkdir()
        (tmp_path / f"source={name}" / "one.stat").write_text("\n".join(lines) + "\n")
    got = {(r.source, r.symbol): (str(r.day), r.complete_rate, r.missing) for r in files.read_stat(spark, str(tmp_path), "source").collect()}
    assert got == {("a", "x"): ("2024-01-03", 1.0, None), ("a", "y"): ("2024-01-02", 0.25, 7.0), ("b", "x"): ("2024-01-05", None, None), ("b", "y"): ("None", 0.1, 2.0)}
    both = {r.source: tuple(r)[1:] for r in files.stat_summary(files.read_stat(spark, str(tmp_path), "source"), ["source"]).collect()}
    assert both == {"a": (1, 0.25, 0.25, 1, 7.0, 7.0), "b": (1, 0.1, 0.1, 1, 2.0, 2.0)}


def test_only_the_asked_stat_folder_is_listed(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"source={name}").mkdir()
        (tmp_path / f"source={name}" / "one.stat").write_text("2024-01-01, x, 1, 0\n")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        files.read_stat(spark, str(tmp_path), "source").where("source = 'a'").explain("formatted")
    assert "PartitionFilters: [isnotnull(source" in text.getvalue()


def test_selections_are_distinct_and_odd_lines_give_none(spark, tmp_path):
    (tmp_path / "chosen.json").write_text('[["r", "p", "f1"], ["r", "p", "f2"], ["r", "p", "f1"]]\nnot a list\n[]\n[["r", "p"]]\n[["r", "q", 3]]\n')
    assert sorted(map(tuple, files.read_selection(spark, str(tmp_path)).collect())) == [("r", "p", "f1"), ("r", "p", "f2"), ("r", "q", "3")]


def test_pairs_of_filters(spark, tmp_path):
    rows = [("pos_a_1", "x", 1, 0.5), ("neg_a_1", "x", 1, 0.25), ("neg_a_1", "x", 2, 0.75), ("pos_b", "x", 1, 9.0), ("neg_c", "x", 1, 9.0), ("other", "x", 1, 9.0)]
    files.write_panel(spark.createDataFrame(rows, "filter string, symbol string, bar_ts int, v double"), str(tmp_path / "f"), ["filter"])
    pairs = files.paired_filters(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, pairs.collect())) == [("a_1", "x", 1, 0.5, 0.25), ("a_1", "x", 2, None, 0.75)]
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        pairs.explain("formatted")
    assert "PartitionFilters: [filter" in text.getvalue().replace("isnotnull(filter), ", "") or "PartitionFilters: [isnotnull(filter" in text.getvalue()
    alphas = spark.createDataFrame([("x", 1, 2.0), ("x", 2, -2.0), ("x", 3, 1.0), ("x", 4, 0.0), ("x", 5, None)], "symbol string, bar_ts int, s double")
    got = {r.bar_ts: r.s for r in apply.paired(alphas, pairs, ["a_1"]).collect()}
    assert got == {1: 1.0, 2: -1.5, 3: None, 4: 0.0, 5: None}


def test_configurations_of_three_formats(spark, tmp_path):
    texts = {".toml": "a = 1\n[b]\nc = [0.5, 2]\n", ".json": '{"a": 1, "b": {"c": [0.5, 2]}}'}
    with contextlib.suppress(ImportError):
        import yaml  # noqa: F401

        texts[".yaml"] = texts[".yml"] = "a: 1\nb:\n  c: [0.5, 2]\n"
    for kind, text in texts.items():
        files.write_text(spark, f"{tmp_path}/run{kind}", text)
        assert files.flatten(files.load_config(spark, f"{tmp_path}/run{kind}")) == {"a": "1", "b.c": "[0.5, 2]"}
        assert files.read_config(f"{tmp_path}/run{kind}") == files.load_config(spark, f"{tmp_path}/run{kind}")
    with pytest.raises(ValueError):
        files.parse_config("{", ".json")
