"""Dataset builders on small generated files."""

import random

import pytest
from pyspark.sql import functions as F

from gapweave.sources import readers, specs

rng = random.Random(0)


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def cancer(path, before, after, n=30):
    lines = []
    for i in range(n):
        nums = [f"{rng.random():.4f}" for _ in range(30 + len(before) + len(after))]
        if after and i == 3:
            nums[-1] = "?"
        lines.append(",".join([str(1000 + i), "M" if i % 3 == 0 else "B", *nums]))
    return write(path, lines)


def test_wdbc(spark, tmp_path):
    s = specs.load(spark, "wisconsin_bc_diagnosis", cancer(tmp_path / "w.data", [], []))
    assert len(s.features) == 30 and s.features[0] == "mean_radius" and s.features[-1] == "worst_fractaldimension"
    assert {r["diagnosis"]: r["count"] for r in s.df.groupBy("diagnosis").count().collect()} == {0: 20, 1: 10}


def test_wpbc_null_marker(spark, tmp_path):
    s = specs.wpbc(spark, cancer(tmp_path / "p.data", ["time"], ["tumorsize", "lymphstatus"]))
    assert len(s.features) == 33
    assert s.df.filter("lymphstatus is null").count() == 1


def test_panel_variants(spark, tmp_path):
    s = specs.wdbc_panels(spark, cancer(tmp_path / "w.data", [], []))
    assert [p.name for p in s.panels] == specs.HIDDEN_PANELS
    assert all(len(p.features) == 3 for p in s.panels)
    assert len(s.base_features) == 30 - 18
    sizes = {r["diagnosis"]: r["count"] for r in s.df.groupBy("diagnosis").count().collect()}
    assert sizes == {0: 10, 1: 10}
    assert s.df.filter("(mean_area is null) != (worst_area is null)").count() == 0
    p = specs.wpbc_panels(spark, cancer(tmp_path / "p.data", ["time"], ["tumorsize", "lymphstatus"]), ["area", "tumorsize"], [0.4, 0.2])
    assert [x.features for x in p.panels][1] == ["tumorsize"]


def test_heart_with_crlf(spark, tmp_path):
    names = "age,sex,cp,trestbps,chol,fbs,restecg,thalach,exang,oldpeak,slope,ca,thal,condition"
    path = tmp_path / "h.csv"
    path.write_bytes(("\r\n".join([names, *["69,1,0,160,234,1,2,131,0,0.1,1,1,0,%d" % (i % 2) for i in range(6)]]) + "\r\n").encode())
    s = specs.heart(spark, str(path))
    assert s.target == "condition" and s.df.count() == 6
    assert s.df.filter("condition is null or oldpeak != 0.1").count() == 0


@pytest.mark.parametrize("build,n", [(specs.eeg, 15), (specs.retinopathy, 20)])
def test_positional(spark, tmp_path, build, n):
    s = build(spark, write(tmp_path / "e.csv", [",".join(str(i + j) for j in range(n)) for i in range(4)]))
    assert s.target == str(n - 1) and len(s.features) == n - 1


def test_diabetes(spark, tmp_path):
    names = ["encounter_id", "patient_nbr", "race", "age", "weight", "payer_code", "medical_specialty", "admission_type_id", "diag_1", "num_procedures", "readmitted"]
    rows = [
        "1,7,B,[0-10),?,?,?,10,250.1,3,NO",
        "2,8,?,[70-80),?,?,?,2,?,1,<30",
        "3,9,A,[20-30),?,?,x,1,401,2,>30",
    ]
    s = specs.diabetes(spark, write(tmp_path / "d.csv", [",".join(names), *rows]))
    got = {int(r["encounter_id"]): r for r in s.df.collect()}
    assert [got[i]["age"] for i in (1, 2, 3)] == [0, 7, 2]
    assert [got[i]["readmitted"] for i in (1, 2, 3)] == [0, 1, 1]
    assert [got[i]["race"] for i in (1, 2, 3)] == [1, None, 0]
    assert [got[i]["admission_type_id"] for i in (1, 2, 3)] == [2, 1, 0]  # numbers are coded by value
    assert "patient_nbr" not in s.df.columns and got[2]["diag_1"] is None


def test_parkinsons_and_infarction(spark, tmp_path):
    voice = write(tmp_path / "v.txt", [",".join([str(1 + i // 2), *["0.5"] * 26, "23", str(i % 2)]) for i in range(8)])
    s = specs.parkinsons(spark, voice)
    assert "subject" in s.df.columns and "subject" not in s.features and len(s.features) == 26
    assert s.df.count() == 8
    mi = write(tmp_path / "mi.data", [",".join([str(i), "?", *["1"] * 121, str(0 if i < 7 else i % 7 + 1)]) for i in range(10)])
    m = specs.infarction(spark, mi)
    assert len(m.features) == 111
    assert {r["targets"]: r["count"] for r in m.df.groupBy("targets").count().collect()} == {0: 3, 1: 3}
    assert m.df.filter("`1` is not null").count() == 0


def test_cervical(spark, tmp_path):
    names = ["Age", "STDs: Time since first diagnosis", "Dx:Cancer", "Dx", "STDs: Time since last diagnosis", *specs.CERVICAL_TARGETS]
    s = specs.cervical(spark, write(tmp_path / "c.csv", [",".join(names), *[f"{20 + i},?,0,0,?,{int(i < 2)},0,0,0" for i in range(9)]]))
    assert s.features == ["Age"]
    assert {r["Hinselmann"]: r["count"] for r in s.df.groupBy("Hinselmann").count().collect()} == {0: 2, 1: 2}


def test_student(spark, tmp_path):
    names = [*specs.STUDENT_CATEGORIES, "age", "absences", "G1", "G2", "G3"]
    rows = []
    for i in range(5):
        text = [str(i) if c in specs.STUDENT_NUMERIC else f'"{"xyz"[i % 3]}"' for c in specs.STUDENT_CATEGORIES]
        rows.append(";".join([*text, "17", "4", "5", "6", str(10 + i)]))
    s = specs.student(spark, write(tmp_path / "student-mat.csv", [";".join(names), *rows]))
    assert s.name == "Student_mat_G3" and "G1" not in s.df.columns and "G2" not in s.df.columns
    assert sorted(r["school"] for r in s.df.collect()) == [0, 0, 1, 1, 2]
    assert sorted(r["G3"] for r in s.df.collect()) == [10, 11, 12, 13, 14]


def test_pregnancy(spark):
    pa = spark.createDataFrame(
        [(1, 2, 0.5, 9.0, "p", "d", "d", "d", "q"), (2, 1, 0.7, 9.0, "p", "d", "d", "d", "q"), (3, 2, None, 9.0, "p", "d", "d", "d", "r")],
        "StudyID long, Visit int, ADAM12 double, ADAM12c double, PublicID string, VisitDate string, ref_date string, VisitDate_INT string, Site string",
    )
    out = spark.createDataFrame([(1, 7), (2, 3), (3, 7), (4, 1)], "StudyID long, PEgHTN int")
    visit = spark.createDataFrame([(1, 30.0, 1.0), (4, 31.0, 2.0)], "STUDYID long, BMI double, lower double")
    s = specs.pregnancy(pa, out, visit)
    assert "lower" not in s.df.columns and "ADAM12c" not in s.df.columns and "BMI" in s.df.columns
    assert {r["PEgHTN"]: r["count"] for r in s.df.groupBy("PEgHTN").count().collect()} == {0: 2, 1: 2}
    assert len(s.panels) == 9


def test_generic_and_unknown(spark):
    df = spark.createDataFrame([(0, 1, 5.0), (3, 2, 6.0)], "t int, drop int, x double")
    s = specs.generic(df, "any", "t", ["drop"])
    assert sorted(r["t"] for r in s.df.collect()) == [0, 1] and s.features == ["x"]
    with pytest.raises(KeyError):
        specs.load(spark, "nothing", "x")


def test_row_ids_are_unique(spark):
    df = readers.with_row_id(spark.range(1000).repartition(7))
    assert df.select("row_id").distinct().count() == 1000
    assert df.join(df.withColumnRenamed("id", "id2"), "row_id").filter(F.col("id") != F.col("id2")).count() == 0


def test_row_ids_do_not_depend_on_splits(spark, monkeypatch):
    monkeypatch.setattr(readers, "_PIECE", 7)
    df = spark.range(300).selectExpr("id % 40 AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x' END AS `b c`", "CAST(NULL AS double) AS d").union(
        spark.range(100).selectExpr("7L AS a", "'x' AS `b c`", "2.5 AS d"))
    one, two = (readers.with_row_id(df.repartition(n)) for n in (1, 9))
    assert one.exceptAll(two).count() == 0
    assert sorted(r["row_id"] for r in one.collect()) == list(range(400))
    assert one.drop("row_id").exceptAll(df).count() == 0
    assert readers.with_row_id(df.limit(0)).count() == 0


def test_draws_follow_the_content(spark, tmp_path):
    from gapweave.operators.inject import inject

    lines = [f"{i % 5}.5,{i}.25" for i in range(50)]
    ids = {}
    for k, order in enumerate((lines, lines[::-1])):
        df = readers.with_row_id(readers.read_positional(spark, write(tmp_path / f"{k}.csv", order), 2))
        ids[k] = {tuple(r) for r in inject(df, ["0", "1"], "row_id", 0.3).incomplete.collect()}
    assert ids[0] == ids[1]
