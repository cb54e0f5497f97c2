"""Small cases whose results are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import bands, bibliography
from terraloom.operators import accuracy, change, composite, focal, learning, markov, quality, regression, reports, spatial, trend
from terraloom.sources import documents
from terraloom.streaming import series


def test_change_rates_with_a_class_without_area(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, 50.0)], "c int, area double")
    b = spark.createDataFrame([(1, 50.0), (2, 10.0)], "c int, area double")
    got = {r["c"]: r for r in change.change_table(a, b, "c", 2.0).collect()}
    assert abs(got[1]["annual_rate_pct"] - math.log(0.5) / 2 * 100) < 1e-9
    assert got[2]["annual_rate_pct"] == got[2]["pct_change"] == 0 and got[3]["area_t2"] == 0


def test_dominant_class_takes_the_smallest_of_ties(spark):
    d = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (1, 2), (2, None)], "u int, c int")
    assert [tuple(r) for r in change.dominant_class(d, ["u"], "c").collect()] == [(1, 2)]


def test_empty_row_of_a_matrix_stays_zero(spark):
    m = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0), (4, 4, 0.0)], "c_from int, c_to int, n double")
    assert {(r["c_from"], r["c_to"]): r["prob"] for r in change.probabilities(m).collect()} == {(1, 1): 0.75, (1, 2): 0.25, (4, 4): 0.0}
    s = markov.scenario(m.withColumnRenamed("n", "prob"), [([1], [2], 3.0)])
    assert {(r[0], r[1]): r["prob"] for r in s.select("c_from", "c_to", "prob").collect()}[1, 2] == 0.5


def test_kappa_of_a_known_matrix(spark):
    m = spark.createDataFrame([(0, 0, 20), (0, 1, 5), (1, 0, 10), (1, 1, 15)], "ref int, pred int, n long")
    r = accuracy.overall(m).first()
    assert abs(r["overall_accuracy"] - 0.7) < 1e-12 and abs(r["kappa"] - 0.4) < 1e-12


def test_kendall_and_sen_with_a_tie(spark):
    v = [1.0, 3.0, 2.0, 3.0, 5.0]
    d = spark.createDataFrame([("a", k, x) for k, x in enumerate(v)], "g string, t int, v double")
    r = trend.kendall(d, ["g"], "t", "v").first()
    assert abs(r["tau"] - 7 / math.sqrt(10 * 9)) < 1e-12
    pairs = sorted((v[j] - v[i]) / (j - i) for i in range(5) for j in range(i + 1, 5))
    assert abs(trend.sen_slope(d, ["g"], "t", "v").first()["sen_slope"] - np.median(pairs)) < 1e-12


def test_kendall_probabilities(spark):
    import itertools

    got = {(r["n"], r["c"]): r["p"] for r in trend.exact_kendall(spark, 7).collect()}
    for n in (3, 5, 7):
        inversions = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        for c in range(n * (n - 1) // 4 + 1):
            assert abs(got[n, c] - min(1, 2 * sum(k <= c for k in inversions) / len(inversions))) < 1e-12
    z = [0.0, 0.5, -1.96, 3.0, 6.0]
    assert all(abs(r[0] / math.erfc(abs(x) / math.sqrt(2)) - 1) < 2e-7 for r, x in zip(spark.createDataFrame([(x,) for x in z], "z double").select(trend.normal_p(F.col("z"))).collect(), z))
    tied = [(t, float(t // 2)) for t in range(10)]
    r = trend.kendall(spark.createDataFrame([("a", t, v) for t, v in tied], "g string, t int, v double"), ["g"], "t", "v").first()
    assert r["s"] == 40 and abs(r["tau"] - 40 / math.sqrt(45 * 40)) < 1e-12
    assert abs(r["p"] / math.erfc(40 / math.sqrt((10 * 9 * 25 - 5 * 2 * 9) / 18) / math.sqrt(2)) - 1) < 2e-7


def test_zero_denominator_is_null(spark):
    d = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "a double, b double")
    assert [r[0] for r in d.select(bands.ratio(F.col("a"), F.col("b"))).collect()] == [None, -0.5]
    assert [r[0] for r in d.select(bands.clamped(F.lit(None).cast("double"), 0, 1)).collect()] == [None, None]


def test_flat_column_has_no_deviation(spark):
    d = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [tuple(r)[1:] for r in composite.standardised(d, "x").collect()] == [(0.0, 0.0), (0.0, 0.0), (None, None)]


def test_snake_is_one_patch(spark):
    cells = []
    for r in range(9):
        cells += [(r, c, 1 if r % 2 == 0 or c == (8 if r % 4 == 1 else 0) else 2) for c in range(9)]
    d = spark.createDataFrame(cells, "row int, col int, k int")
    got = focal.patches(d, "k").groupBy("k").agg(F.count_distinct("patch").alias("n"))
    assert {r["k"]: r["n"] for r in got.collect()} == {1: 1, 2: 4}


def test_regression_finds_its_coefficients(spark):
    rng = np.random.RandomState(1)
    x = rng.rand(200, 2)
    d = spark.createDataFrame([(int(k), float(a), float(b), float(2 + 3 * a - b), float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, x double, y double, v double, p double, q double")
    got = {r["term"]: r["coefficient"] for r in regression.ols(d, "v", ["p", "q"]).collect()}
    assert np.allclose([got["intercept"], got["p"], got["q"]], [2, 3, -1])
    local = regression.gwr(d, "v", ["p", "q"], 20, 1.5).collect()
    assert len(local) == 200 and np.allclose([r["b1"] for r in local], 3, atol=1e-6)


def test_point_in_polygon_with_a_notch(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    z = spark.createDataFrame([(7, 0.0, 0.0, 4.0, 4.0, ring)], "zone_id int, xmin double, ymin double, xmax double, ymax double, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 3.0), (3, 0.2, 3.0), (4, 9.0, 9.0)], "id int, x double, y double")
    assert sorted(r["id"] for r in spatial.zonal(p, z, 1.0).collect()) == [1, 3]
    assert z.select(spatial.ring_area(F.col("ring"))).first()[0] == 10.0


def test_segments_find_a_break():
    t = np.arange(2000.0, 2010.0)
    v = np.where(t < 2005, 800.0, 300.0)
    fit = learning.segmented(t, v)
    assert int((fit[:-1] - fit[1:]).argmax()) == 4 and abs(fit[0] - 800) < 1


def test_records(spark, tmp_path):
    d = spark.createDataFrame([("Pérez-Gómez, J.; Li, W.;", "The forest of & change", " 2020 ", "x")], "a string, t string, y string, c string")
    r = d.select(bibliography.authors(F.col("a")), bibliography.citation_key(F.col("a"), F.col("y"), F.col("t")), bibliography.escaped(F.col("t")), bibliography.cited_by(F.col("c")), bibliography.record_type(F.col("c"))).first()
    assert tuple(r) == ("Pérez-Gómez, J. and Li, W.", "PerezGomez2020Forest", "The forest of \\& change", 0, "article")
    (tmp_path / "b.bib").write_text("@article{Key1,\n DOI = {10.1/ABC},\n}\n@book{k2, title={x}}")
    assert sorted(map(tuple, documents.bibtex_keys(spark, str(tmp_path / "b.bib")).collect())) == [("doi", "10.1/abc"), ("key", "Key1"), ("key", "k2")]
    (tmp_path / "r.csv").write_text("﻿ Title ,YEAR\n\"a\nb\",2020\n", encoding="utf-8")
    assert documents.csv_records(spark, str(tmp_path / "r.csv")).first().asDict() == {"title": "a\nb", "year": "2020"}


def test_blank_keys_stay(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None)], "id int, k string")
    assert sorted(r["id"] for r in quality.first_by_key(d, "k", ["id"]).collect()) == [1, 3, 4]


def test_late_rows_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [[("2024-01-01 00:10:00", 1, 1.0), ("2024-01-03 00:10:00", 1, 2.0)], [("2024-01-05 00:00:00", 1, 8.0)], [("2024-01-01 00:20:00", 1, 4.0)], [("2024-01-09 00:00:00", 1, 16.0)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "ts string, user_id int, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        for f in (tmp_path / f"p{k}").glob("part-*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    s = series.tumbling(series.event_stream(spark, str(tmp_path / "in"), schema), "1 day", "user_id")
    got = {str(r["start"])[:10]: r["total"] for r in series.run_to_end(s, "daily", str(tmp_path)).collect()}
    assert got["2024-01-01"] == 1.0 and got["2024-01-03"] == 2.0


def test_record_functions_as_published(spark):
    b = bibliography
    d = spark.createDataFrame([("Šćepanović  Ő-ngström, Ć.", "Évaluation & <of> Ünder forêts", "5", "5", " Note ")], "a string, t string, s string, e string, k string")
    r = d.select(b.strip_accents(F.col("a")), b.first_author(F.col("a")), b.title_word(F.col("t")), b.pages(F.col("s"), F.col("e"), F.lit("9")), b.record_type(F.col("k")), b.pages(F.lit(""), F.lit(None), F.lit("e12")), b.pages(F.lit("1"), F.lit("9"), F.lit("")), b.first_author(F.lit(None)), b.title_word(F.lit("of the")), b.title_word(F.lit(""))).first()
    assert tuple(r) == ("Scepanovic  O-ngstrom, C.", "ScepanovicONgstrom", "Evaluation", "5", "article", "e12", "1--9", "Unknown", "Of", "Untitled")
    row = {"authors": "A, B.; C", "title": "x & \\& y", "year": "2020", "source title": "J", "document type": "Conference Paper", "page start": "1", "page end": "2", "cited by": "21", "doi": "10.1/X"}
    d = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    want = "@inproceedings{k,\n  author      = {A, B. and C},\n  title       = {{x \\& \\& y}},\n  booktitle   = {J},\n  year        = {2020},\n  pages       = {1--2},\n  doi         = {10.1/X},\n}"
    assert d.select(b.rendered(b.record_fields(d.columns), F.lit("k"))).first()[0] == want
    kinds = [("Review", "20"), ("review ", "21"), ("Conference Paper", "x"), ("Article", "0"), (None, None)]
    assert [r[0] for r in spark.createDataFrame(kinds, "k string, c string").select(b.excluded(F.col("k"), F.col("c"))).collect()] == [True, False, True, False, False]
    assert [r[0] for r in spark.createDataFrame([("Deep GEE",), ("nothing",), (None,)], "t string").select(b.relevant(b.TERMS, F.col("t"))).collect()] == [True, False, False]


def test_keys_become_unique(spark):
    keys = ["k", "k", "ka"] + ["hot"] * 800 + ["x"] * 30 + ["xa"] * 3
    d = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], "id int, k string").repartition(3)
    known = spark.createDataFrame([("x",), ("hotb",)], "k string")
    got = {r["id"]: r["k"] for r in quality.suffixed(d, "k", ["id"], known).collect()}
    assert len(set(got.values())) == len(keys) and not set(got.values()) & {"x", "hotb"}
    assert [got[k] for k in range(6)] == ["k", "kb", "ka", "hot", "hota", "hotc"] and got[803] == "xb"
    assert all(got[n].startswith(k) for n, k in enumerate(keys))
    assert [r[0] for r in spark.createDataFrame([(0,), (25,), (26,), (701,), (702,)], "n long").select(quality.letters(F.col("n"))).collect()] == ["a", "z", "aa", "zz", "aaa"]


def test_rules_with_any_name(spark):
    d = spark.createDataFrame([(1.0,)], "x double")
    got = quality.check(d, [("it's", "ERROR", F.min("x") > 0), ('a "b"', "WARN", F.min("x") > 5), ("null", "WARN", F.min(F.lit(None)) > 5)])
    assert [tuple(r) for r in got.collect()] == [("it's", "ERROR", True, "PASS"), ('a "b"', "WARN", False, "WARN"), ("null", "WARN", False, "WARN")]
    lines = [r[0] for r in documents.report_lines(got, "Checks").collect()]
    assert lines[0] == "# Checks" and "- PASS: 1" in lines and "| it's | ERROR | PASS |" in lines


def test_published_rules(spark):
    ok = spark.createDataFrame([("a", 0.7, 0.6, 5, 4), ("b", 1.0, -1.0, 1, 1)], "period string, overall_accuracy double, kappa double, n_training int, n_validation int")
    assert {r["status"] for r in quality.check(ok, quality.accuracy_rules()).collect()} == {"PASS"}
    model = spark.createDataFrame([(11.0, 0.2, 0.1, 5.0, 6.0)], "vif double, ols_r2 double, gwr_r2 double, ols_aic double, gwr_aic double")
    assert [r["status"] for r in quality.check(model, quality.model_rules()).collect()] == ["WARNING", "PASS", "ERROR", "ERROR"]
    services = spark.createDataFrame([(1, 9.0, 10.0, 0.5), (2, 8.0, 9000.0, 0.4)], "period int, carbon double, water_yield double, quality double")
    assert [r["status"] for r in quality.check(services, quality.service_rules()).collect()] == ["PASS", "ERROR", "PASS", "PASS"]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 30_000])
def test_percentiles_are_numpys(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n).round(3))
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
    shares = [0.0, 0.02, 0.1, 0.5, 0.9, 0.98, 1.0]
    assert np.allclose(composite.percentiles(d, "x", shares), np.quantile(x, shares))
    assert composite.percentiles(d.filter("false"), "x", [0.5]) == [None]


@pytest.mark.parametrize("diagonal", [False, True])
def test_patches_across_tiles(spark, diagonal):
    rng = np.random.default_rng(7)
    grid = rng.integers(0, 2, (23, 31))
    cells = [(r, c, int(grid[r, c])) for r in range(23) for c in range(31) if (r * 31 + c) % 17]
    got = {(r["row"], r["col"]): r["patch"] for r in focal.patches(spark.createDataFrame(cells, "row int, col int, k int"), "k", diagonal, tile=5).collect()}
    value, root = {(r, c): k for r, c, k in cells}, {}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for p in sorted(value):
        if p in root:
            continue
        root[p], stack = p[0] * (1 << 31) + p[1], [p]
        while stack:
            q = stack.pop()
            for dr, dc in steps:
                o = (q[0] + dr, q[1] + dc)
                if value.get(o) == value[q] and o not in root:
                    root[o] = root[p]
                    stack.append(o)
    assert got == root


def test_windows_across_tiles(spark):
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 4, (17, 19))
    cells = {(r - 3, c): int(grid[r, c]) for r in range(17) for c in range(19) if (r * 19 + c) % 11}
    d = spark.createDataFrame([(r, c, k) for (r, c), k in cells.items()], "row int, col int, k int")
    window = lambda p, n: [cells[r, c] for r in range(p[0] - n, p[0] + n + 1) for c in range(p[1] - n, p[1] + n + 1) if (r, c) in cells]
    assert {(r["row"], r["col"]): r["mode"] for r in focal.mode(d, "k", 3, tile=4).collect()} == {p: min(set(w := window(p, 3)), key=lambda k: (-w.count(k), k)) for p in cells}
    got = {(r["row"], r["col"]): r["mean"] for r in focal.mean(d, "k", 2, tile=5).collect()}
    assert got.keys() == cells.keys() and all(abs(got[p] - sum(window(p, 2)) / 25) < 1e-9 for p in cells)


def test_bandwidths_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 60
    xy, u = rng.random((n, 2)), rng.normal(size=(n, 2))
    y = 1 + u @ [2, -1] + xy[:, 0] * u[:, 0] + rng.normal(size=n) * 0.1
    d = spark.createDataFrame([(k, *map(float, (*xy[k], *u[k], y[k]))) for k in range(n)], "id long, x double, y double, p double, q double, v double")
    got = {r["bandwidth"]: r for r in regression.bandwidth_search(d, "v", ["p", "q"], 0.3, 4).collect()}
    far = np.hypot(*(xy[:, None] - xy).transpose(2, 0, 1))
    x = np.column_stack([np.ones(n), u])

    def plain(weights):
        off, trace = 0.0, 0.0
        for i in range(n):
            w = weights(far[i])
            a = np.linalg.inv(x.T @ (x * w[:, None]))
            off += (y[i] - x[i] @ a @ (x.T @ (w * y))) ** 2
            trace += x[i] @ a @ x[i]
        return n * np.log(off / n) + 2 * trace, trace

    want = {k: plain(lambda f, k=k: np.where(f / np.sort(f)[k] <= 1, (1 - (f / np.sort(f)[k]) ** 2) ** 2, 0.0)) for k in sorted({int(b) for b in np.linspace(5, 48, 4)})}
    assert got.keys() == want.keys() and all(abs(got[k]["aic"] - a) < 1e-6 and abs(got[k]["trace"] - t) < 1e-8 for k, (a, t) in want.items())
    assert [k for k, r in got.items() if r["is_best"]] == [min(want, key=lambda k: want[k][0])]
    fixed = regression.gwr_fit(regression.gwr(d, "v", ["p", "q"], 0, 0.4, "fixed")).first()
    assert abs(fixed["aic"] - plain(lambda f: np.exp(-0.5 * (f / 0.4) ** 2))[0]) < 1e-6


def test_touched_squares(spark):
    ring = [(0.2, 0.2), (3.7, 0.4), (0.3, 1.6), (0.2, 0.2)]
    z = spark.createDataFrame([(1, 0.2, 0.2, 3.7, 1.6, ring)], "zone_id int, xmin double, ymin double, xmax double, ymax double, ring array<struct<x:double,y:double>>")
    got = {(r["row"], r["col"]) for r in spatial.touched(z, 1.0).collect()}
    hit = set()
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        for t in np.linspace(0, 1, 20001):
            hit.add((int(ay + t * (by - ay)), int(ax + t * (bx - ax))))
    assert got == hit


def test_samples_by_position_and_shares(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "i int, x string")
    b = spark.createDataFrame([(10, "p"), (20, "q")], "k int, y string")
    assert sorted((r["x"], r["y"]) for r in spatial.paired(a, b, "i", "k").collect()) == [("a", "p"), ("b", "q")]
    assert reports.enough(a, 2) and not reports.enough(a, 3)
    top = learning.importance_table(spark, {"r": [("f", 0.1), ("g", 0.7), ("h", 0.2)]})
    assert [r["feature"] for r in reports.top_features(top, 2).orderBy("rank").collect()] == ["g", "h"]
    assert abs(spark.range(1).select(reports.carbon_ci(F.lit(100.0))).first()[0] - 100 * 0.167 * 1.96) < 1e-12


def test_sliding_windows(spark):
    d = spark.createDataFrame([("2024-01-01 00:10:00", 1, 1.0), ("2024-01-01 00:50:00", 1, 2.0)], "ts string, u int, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {str(r["start"])[11:16]: r["total"] for r in series.sliding(d, "1 hour", "30 minutes", "u").collect()}
    assert got == {"23:30": 1.0, "00:00": 3.0, "00:30": 2.0}


def test_fallbacks_and_dimensions(spark, tmp_path):
    from pyspark.sql import types as T

    from terraloom.functions import dims

    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 0.5)], "k int, v double")
    assert {r["k"]: r["v"] for r in documents.with_fallback(a, b, "k", "v", 9.0).collect()} == {1: 0.5, 2: 9.0}
    assert documents.optional(spark, str(tmp_path / "none"), T.StructType([T.StructField("x", T.IntegerType())])).count() == 0
    c = {r["class_id"]: r for r in dims.classes(spark).collect()}
    assert c[1]["carbon"] == 281.0 and c[8]["carbon"] == 247.0 and abs(c[1]["carbon_se"] - (400 + 100 + 225 + 36) ** 0.5) < 1e-12 and dims.municipalities(spark).count() == 15
    (tmp_path / "d.json").write_text('{"a": {"b": [1, 2]}}')
    assert documents.json_document(spark, str(tmp_path / "d.json")).select("a.b").first()[0] == [1, 2]
    for form in ("json", "csv"):
        documents.write_report(b, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).first()["v"] == 0.5
    (tmp_path / "m.tex").write_text("TODO one \\cite{x} TODO")
    assert {r["pattern"]: r["n"] for r in documents.occurrences(documents.whole_texts(spark, str(tmp_path / "m.tex")), {"todo": "TODO", "cite": r"\\cite"}).collect()} == {"todo": 2, "cite": 1}
    documents.append_text(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "log"))
    documents.append_text(spark.createDataFrame([("y",)], "value string"), str(tmp_path / "log"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["x", "y"]
