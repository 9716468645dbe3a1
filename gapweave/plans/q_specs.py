"""Queries: dataset builders on files that are written from the orders table in each data set's format.

A builder without sampling is profiled column by column; one that draws rows is checked by its class sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.plans.registry import query
from gapweave.plans.working import scratch, table
from gapweave.sources import readers, specs

# A column is (name, text for the file, number that the builder makes of it), in SQL that both engines read.
Column = tuple[str, str, str]


def _number(name: str, j: int, gaps: bool = False) -> Column:
    e = f"CAST((o_orderkey * {2 * j + 3} + {j}) % 97 AS DOUBLE) / 8"
    e = f"CASE WHEN (o_orderkey + {j}) % 11 = 0 THEN NULL ELSE {e} END" if gaps else e
    return name, e, e


def _whole(name: str, j: int, n: int = 90) -> Column:
    e = f"(o_orderkey * {2 * j + 3} + {j}) % {n}"
    return name, e, e


def _label(name: str, j: int, n: int = 3, gaps: bool = False) -> Column:
    k = f"(o_orderkey * {2 * j + 3} + {j}) % {n}"
    k = f"CASE WHEN (o_orderkey + {j}) % 11 = 0 THEN NULL ELSE {k} END" if gaps else k
    return name, f"CASE WHEN ({k}) IS NULL THEN NULL ELSE concat('v', {k}) END", k


def _two(name: str, zero: str, one: str, every: int) -> Column:
    return name, f"CASE WHEN o_orderkey % {every} = 0 THEN '{one}' ELSE '{zero}' END", f"CASE WHEN o_orderkey % {every} = 0 THEN 1 ELSE 0 END"


def _file(spark, sf: str, columns: list[Column], header: bool = False, sep: str = ",", name: str = "spec") -> str:
    path = scratch(spark, name)
    rows = table(spark, sf, "orders").selectExpr(*[f"{e} AS `{n}`" for n, e, _ in columns])
    rows.write.csv(path, header=header, sep=sep, nullValue="?")
    return path


def _profile(spec: specs.TableSpec) -> DataFrame:
    """(feature, n, known, total) of the features and the target."""
    names = [*spec.features, spec.target]
    each = [F.struct(F.lit(x).alias("feature"), F.count(F.lit(1)).alias("n"), F.count(f"`{x}`").alias("known"), F.round(F.sum(F.col(f"`{x}`").cast("double")), 6).alias("total")) for x in names]
    return spec.df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def _profile_sql(columns: list[Column], dropped: tuple[str, ...] = ()) -> str:
    kept = [(n, e) for n, _, e in columns if n not in dropped]
    return " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS n, count({e}) AS known, round(CAST(sum({e}) AS DOUBLE), 6) AS total FROM orders" for n, e in kept)


def _classes(spec: specs.TableSpec) -> DataFrame:
    """(class, n, n_features, n_panels) of a table whose classes were cut to one size."""
    facts = F.lit(len(spec.features)).cast("long").alias("n_features"), F.lit(len(spec.panels)).cast("long").alias("n_panels")
    return spec.df.groupBy(F.col(f"`{spec.target}`").cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n")).select("class", "n", *facts)


def _classes_sql(one: str, n_features: int, n_panels: int = 0, where: str = "true") -> str:
    return f"""SELECT CAST(c AS BIGINT) AS class, least(sum(k) OVER (), (SELECT count(*) FROM orders WHERE {where}) - sum(k) OVER ()) AS n, CAST({n_features} AS BIGINT) AS n_features, CAST({n_panels} AS BIGINT) AS n_panels
        FROM (SELECT c, CASE WHEN c = 1 THEN (SELECT count(*) FROM orders WHERE ({where}) AND {one}) ELSE 0 END AS k FROM (VALUES (0), (1)) t(c))"""


_EEG = [*[_number(str(j), j) for j in range(14)], _whole("14", 0, 2)]
_RETINA = [*[_number(str(j), j) for j in range(19)], _whole("19", 0, 2)]
_HEART_NAMES = ["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope", "ca", "thal", "condition"]
_HEART = [_number(n, j) if n == "oldpeak" else _whole(n, j, 2 if n == "condition" else 90) for j, n in enumerate(_HEART_NAMES)]
_MEASURES = [_number(n, j) for j, n in enumerate(readers.measure_columns())]
_WDBC = [_whole("id", 0), _two("diagnosis", "B", "M", 3), *_MEASURES]
_WPBC = [_whole("id", 0), _two("prognosis", "N", "R", 4), _number("time", 50), *_MEASURES, _number("tumorsize", 51), _number("lymphstatus", 52, True)]
_VOICE = [_whole("subject", 0, 40), *[_number(n, j) for j, n in enumerate(specs.VOICE_COLUMNS)], _number("UPDRS", 40), _whole("targets", 0, 2)]
_DIABETES = [
    *[_whole(n, j) for j, n in enumerate(specs.DIABETES_DROPPED)],
    *[(_whole if n in specs.DIABETES_NUMERIC_CODES else lambda n, j, k: _label(n, j, k, True))(n, j, 3) for j, n in enumerate(specs.DIABETES_CATEGORIES)],
    _number("time_in_hospital", 60), ("age", "concat('[', (o_orderkey % 9) * 10, '-', (o_orderkey % 9) * 10 + 10, ')')", "o_orderkey % 9"), _two("readmitted", "NO", "<30", 5),
]
_STUDENT = [*[(_whole if n in specs.STUDENT_NUMERIC else _label)(n, j, 3) for j, n in enumerate(specs.STUDENT_CATEGORIES)], _whole("age", 30), *[_whole(n, 31 + j, 20) for j, n in enumerate(("G1", "G2", "G3"))]]
_CERVICAL = [_number("Age", 0), *[_number(n, j + 1, True) for j, n in enumerate(specs.CERVICAL_DROPPED)], ("Hinselmann", "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END", ""), *[(n, "0", "") for n in specs.CERVICAL_TARGETS[1:]]]
_INFARCTION = [("patient", "o_orderkey", ""), *[_number(str(j), j, True) for j in range(1, 123)], ("targets", "CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END", "")]
_PROFILED = {
    "spec_eeg": ("eeg_eye_state", _EEG, {}, ()),
    "spec_retinopathy": ("diabetic_retinopathy", _RETINA, {}, ()),
    "spec_heart": ("cleveland_heart_disease", _HEART, {"header": True}, ()),
    "spec_diabetes": ("diabetes_vcu", _DIABETES, {"header": True}, tuple(specs.DIABETES_DROPPED)),
    "spec_wdbc": ("wisconsin_bc_diagnosis", _WDBC, {}, ("id",)),
    "spec_wpbc": ("wisconsin_bc_prognosis", _WPBC, {}, ("id",)),
    "spec_parkinsons": ("parkinsons", _VOICE, {}, ("subject", "UPDRS")),
    "spec_student": ("student", _STUDENT, {"header": True, "sep": ";"}, ("G1", "G2")),
}


def _profiled(name: str) -> None:
    known, columns, options, dropped = _PROFILED[name]

    @query(name, _profile_sql(columns, dropped))
    def _(spark, sf):
        return _profile(specs.load(spark, known, _file(spark, sf, columns, **options)))


for _name in _PROFILED:
    _profiled(_name)


@query("spec_wdbc_panels", _classes_sql("o_orderkey % 3 = 0", 30, 6))
def _(spark, sf):
    return _classes(specs.load(spark, "wisconsin_bc_diagnosis_panels", _file(spark, sf, _WDBC)))


@query("spec_wpbc_panels", _classes_sql("o_orderkey % 4 = 0", 33, 2, "(o_orderkey + 52) % 11 <> 0"))
def _(spark, sf):
    return _classes(specs.load(spark, "wisconsin_bc_prognosis_panels", _file(spark, sf, _WPBC), hidden=["area", "tumorsize"], amounts=[0.4, 0.2]))


@query("spec_cervical", _classes_sql("o_orderkey % 3 = 0", 1))
def _(spark, sf):
    return _classes(specs.load(spark, "cervical_cancer", _file(spark, sf, _CERVICAL, header=True)))


@query("spec_mi", _classes_sql("o_orderkey % 5 = 0", 111))
def _(spark, sf):
    return _classes(specs.load(spark, "myocardial_infarction", _file(spark, sf, _INFARCTION)))


@query("spec_pregnancy", _classes_sql("o_orderkey % 4 <> 0", 10, 9))
def _(spark, sf):
    o = table(spark, sf, "orders")
    own = ["CAST(o_orderkey AS STRING) AS StudyID", "2 AS Visit", "1 AS VisitDate", "1.5D AS PAPPAc"]
    analytes = o.selectExpr(*own, *[f"CAST((o_orderkey + {j}) % 31 AS DOUBLE) AS {a}" for j, a in enumerate(specs.ANALYTES)])
    outcomes = o.selectExpr("CAST(o_orderkey AS STRING) AS StudyID", "CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE 1 END AS PEgHTN")
    visit = o.selectExpr("CAST(o_orderkey AS STRING) AS STUDYID", "o_orderkey % 5 AS BMI", "1 AS lower", "2 AS AGE_AT_V1")
    return _classes(specs.pregnancy(analytes, outcomes, visit))


_LISTED = ["spec_eeg", "spec_heart", "spec_wdbc", "spec_wpbc"]


@query(
    "dataset_registry",
    " UNION ALL ".join(
        f"SELECT '{_PROFILED[n][0]}' AS name, '{t}' AS target, CAST({k} AS BIGINT) AS n_features, count(*) AS n_rows FROM orders"
        for n, t, k in zip(_LISTED, ("14", "condition", "diagnosis", "prognosis"), (14, 13, 30, 33))
    ),
)
def _(spark, sf):
    parts = []
    for n in _LISTED:
        known, columns, options, _ = _PROFILED[n]
        s = specs.load(spark, known, _file(spark, sf, columns, **options))
        parts.append(s.df.agg(F.lit(s.name).alias("name"), F.lit(s.target).alias("target"), F.lit(len(s.features)).cast("long").alias("n_features"), F.count(F.lit(1)).alias("n_rows")))
    return reduce(DataFrame.unionByName, parts)
