"""Dataset builders: read a public table and clean it for the study."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.operators.clean import (
    Panel,
    base_features,
    binarise,
    bracket_digit,
    drop_by_rule,
    label_codes,
    panels_from_names,
    string_columns,
)
from gapweave.operators.sampling import hide_panel_rows, undersample
from gapweave.sources.readers import (
    MEASURES,
    doubles,
    measure_columns,
    read_csv,
    read_headed,
    read_positional,
    with_row_id,
)


@dataclass(frozen=True)
class TableSpec:
    df: DataFrame
    name: str
    target: str
    id_col: str = "row_id"
    panels: list[Panel] = field(default_factory=list)
    group_col: str | None = None  # who a row is of: for grouped splits, never a feature

    @property
    def features(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.target, self.id_col, self.group_col)]

    @property
    def base_features(self) -> list[str]:
        return base_features(self.df, self.panels, self.target, self.id_col)


def _encode(df: DataFrame, cols: list[str]) -> DataFrame:
    codes = label_codes(df, cols)
    order = df.columns
    for c in cols:
        df = codes.encode(df, c)
    return df.select(*[f"`{c}`" for c in order])


def eeg(spark: SparkSession, path: str, n_cols: int = 15) -> TableSpec:
    df = with_row_id(read_positional(spark, path, n_cols))
    return TableSpec(df, "eeg_eye_state", str(n_cols - 1))


def retinopathy(spark: SparkSession, path: str, n_cols: int = 20) -> TableSpec:
    df = with_row_id(read_positional(spark, path, n_cols))
    return TableSpec(df, "diabetic_retinopathy", str(n_cols - 1))


def heart(spark: SparkSession, path: str) -> TableSpec:
    df = read_headed(spark, path, {"oldpeak": "double"}, "int")
    return TableSpec(with_row_id(df), "cleveland_heart_disease", "condition")


# fixed values: columns of the diabetes table that are dropped or encoded
DIABETES_DROPPED = ["patient_nbr", "weight", "payer_code", "medical_specialty"]
DIABETES_NUMERIC_CODES = ["admission_type_id", "discharge_disposition_id", "admission_source_id"]
DIABETES_CATEGORIES = [
    "race", "gender", "admission_type_id", "discharge_disposition_id", "admission_source_id",
    "diag_1", "diag_2", "diag_3", "max_glu_serum", "A1Cresult", "metformin", "repaglinide",
    "nateglinide", "chlorpropamide", "glimepiride", "acetohexamide", "glipizide", "glyburide",
    "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose", "miglitol", "troglitazone",
    "tolazamide", "examide", "citoglipton", "insulin", "glyburide-metformin",
    "glipizide-metformin", "glimepiride-pioglitazone", "metformin-rosiglitazone",
    "metformin-pioglitazone", "change", "diabetesMed",
]


def diabetes(spark: SparkSession, path: str) -> TableSpec:
    text = [c for c in DIABETES_CATEGORIES if c not in DIABETES_NUMERIC_CODES]
    types = {c: "string" for c in [*text, "age", "readmitted", "weight", "payer_code", "medical_specialty"]}
    df = with_row_id(read_headed(spark, path, types, null_marker="?").drop(*DIABETES_DROPPED))
    df = df.withColumns({"age": bracket_digit("age"), "readmitted": binarise("readmitted", "NO")})
    # codes are left-joined by label, so a null stays a null: the mask needs no second pass
    return TableSpec(_encode(df, [c for c in DIABETES_CATEGORIES if c in df.columns]), "diabetes_vcu", "readmitted")


def _cancer(spark: SparkSession, path: str, target: str, extra_before: list[str], extra_after: list[str]) -> DataFrame:
    names = [*extra_before, *measure_columns(), *extra_after]
    ddl = f"id long, {target} string, " + ", ".join(f"`{n}` double" for n in names)
    return read_csv(spark, path, ddl, null_marker="?")


def wpbc(spark: SparkSession, path: str) -> TableSpec:
    df = _cancer(spark, path, "prognosis", ["time"], ["tumorsize", "lymphstatus"]).drop("id")
    return TableSpec(_encode(with_row_id(df), ["prognosis"]), "wisconsin_bc_prognosis", "prognosis")


def wdbc(spark: SparkSession, path: str) -> TableSpec:
    df = _cancer(spark, path, "diagnosis", [], []).drop("id")
    return TableSpec(_encode(with_row_id(df), ["diagnosis"]), "wisconsin_bc_diagnosis", "diagnosis")


# fixed values: panels that lose rows in the panel variants of the cancer tables
HIDDEN_PANELS = ["smoothness", "compactness", "concavity", "symmetry", "fractaldimension", "area"]


def _hidden_panels(
    df: DataFrame, name: str, target: str, panels: dict[str, Panel], hidden: list[str], amounts: list[float], seed: int
) -> TableSpec:
    if len(hidden) != len(amounts):
        raise ValueError("one amount for each hidden panel")
    df = with_row_id(df.na.drop("any"))
    df = _encode(df, [target])
    for i, (panel, amount) in enumerate(zip(hidden, amounts)):
        df = hide_panel_rows(df, panels[panel].features, "row_id", fraction=amount, seed=seed + i)
    return TableSpec(undersample(df, target, "row_id", seed), name, target, panels=[panels[h] for h in hidden])


def _measure_panels(columns: list[str]) -> dict[str, Panel]:
    return {p.name: p for p in panels_from_names(columns) if p.name in MEASURES}


def wdbc_panels(
    spark: SparkSession, path: str, hidden: list[str] | None = None, amounts: list[float] | None = None, seed: int = 42
) -> TableSpec:
    hidden = hidden or HIDDEN_PANELS
    df = _cancer(spark, path, "diagnosis", [], []).drop("id")
    return _hidden_panels(
        df, "wisconsin_bc_diagnosis", "diagnosis", _measure_panels(df.columns), hidden, amounts or [0.4] * len(hidden), seed
    )


def wpbc_panels(
    spark: SparkSession, path: str, hidden: list[str] | None = None, amounts: list[float] | None = None, seed: int = 42
) -> TableSpec:
    hidden = hidden or HIDDEN_PANELS
    df = _cancer(spark, path, "prognosis", ["time"], ["tumorsize", "lymphstatus"]).drop("id")
    panels = _measure_panels(df.columns) | {x: Panel(x, [x]) for x in ("time", "tumorsize", "lymphstatus")}
    return _hidden_panels(
        df, "wisconsin_bc_prognosis", "prognosis", panels, hidden, amounts or [0.4] * len(hidden), seed
    )


# fixed values: names of the voice measures, in file order
VOICE_COLUMNS = [
    "Jitter (local)", "Jitter (local, absolute)", "Jitter (rap)", "Jitter (ppq5)", "Jitter (ddp)",
    "Shimmer (local)", "Shimmer (local, dB)", "Shimmer (apq3)", "Shimmer (apq5)", "Shimmer (apq11)",
    "Shimmer (dda)", "AC", "NTH", "HTN", "Median pitch", "Mean pitch", "Standard deviation",
    "Minimum pitch", "Maximum pitch", "Number of pulses", "Number of periods", "Mean period",
    "Standard deviation of period", "Fraction of locally unvoiced frames", "Number of voice breaks",
    "Degree of voice breaks",
]


def parkinsons(spark: SparkSession, path: str, train: bool = True) -> TableSpec:
    """Several rows per subject; the subject is kept for grouped splits and is no feature."""
    tail = ["UPDRS double"] if train else []
    ddl = ", ".join(["subject int", *[f"`{c}` double" for c in VOICE_COLUMNS], *tail, "targets int"])
    df = with_row_id(read_csv(spark, path, ddl).drop("UPDRS"))
    return TableSpec(_encode(df, ["targets"]), "parkinsons", "targets", group_col="subject")


# fixed values: columns of the cervical table
CERVICAL_DROPPED = ["STDs: Time since first diagnosis", "STDs: Time since last diagnosis", "Dx:Cancer", "Dx"]
CERVICAL_TARGETS = ["Hinselmann", "Schiller", "Citology", "Biopsy"]


def cervical(spark: SparkSession, path: str, target: str = "Hinselmann") -> TableSpec:
    df = read_headed(spark, path, null_marker="?")
    df = drop_by_rule_exact(df, {*CERVICAL_DROPPED, *(t for t in CERVICAL_TARGETS if t != target)})
    df = _encode(with_row_id(df), [target])
    return TableSpec(undersample(df, target, "row_id", 0), "cervical_cancer_" + target, target)


def drop_by_rule_exact(df: DataFrame, names: set[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


def infarction(spark: SparkSession, path: str) -> TableSpec:
    """Columns 112 to 122 are other outcomes and are dropped."""
    ddl = "patient long, " + ", ".join(f"`{i}` double" for i in range(1, 123)) + ", targets int"
    df = read_csv(spark, path, ddl, null_marker="?")
    df = df.select("patient", *[f"`{i}`" for i in range(1, 112)], binarise("targets", 0).alias("targets"))
    return TableSpec(undersample(df, "targets", "patient", 0), "myocardial_infarction", "targets", "patient")


# fixed values: encoded columns of the student table
STUDENT_CATEGORIES = [
    "school", "sex", "famsize", "address", "Pstatus", "Medu", "Fedu", "Mjob", "Fjob", "reason",
    "guardian", "schoolsup", "famsup", "paid", "activities", "nursery", "higher", "internet", "romantic",
]
STUDENT_NUMERIC = ["Medu", "Fedu"]
STUDENT_MERGE_KEYS = [
    "school", "sex", "age", "address", "famsize", "Pstatus", "Medu", "Fedu",
    "Mjob", "Fjob", "reason", "nursery", "internet",
]


def student(spark: SparkSession, path: str, target: str = "G3") -> TableSpec:
    subject = "mat" if "mat" in path.rsplit("/", 1)[-1] else "por"
    types = {c: "string" for c in STUDENT_CATEGORIES if c not in STUDENT_NUMERIC}
    df = read_headed(spark, path, types, "int", sep=";")
    df = df.drop(*[g for g in ("G1", "G2", "G3") if g != target])
    return TableSpec(_encode(with_row_id(df), STUDENT_CATEGORIES), f"Student_{subject}_{target}", target)


# fixed values: analytes, each a panel of its own, and unused columns of the visit table
ANALYTES = ["ADAM12", "ENDOGLIN", "SFLT1", "VEGF", "AFP", "fbHCG", "INHIBINA", "PAPPA", "PLGF"]
VISIT_DROPPED = ["AGE_AT_V1", "GAWKSEND", "BIRTH_TYPE", "Unnamed: 0", "PEGHTN", "CHRONHTN"]
PREGNANCY_EXCLUDED = [
    "Unnamed: 0", "Unnamed: 0.1", "STUDYID", "StudyID", "GAWKSEND", "BIRTH_TYPE",
    "AGE_AT_V1", "PEGHTN", "CHRONHTN", "OUTCOME",
]
ANALYTE_DATES = ["PublicID", "VisitDate", "ref_date", "VisitDate_INT"]


def analyte_panels() -> list[Panel]:
    return [Panel(a, [a], "placental_analytes") for a in ANALYTES]


def pregnancy(
    analytes: DataFrame, outcomes: DataFrame, visit: DataFrame, target: str = "PEgHTN", seed: int = 42
) -> TableSpec:
    """Three tables joined on the study id by full outer joins (read them with any reader)."""

    def encoded(df: DataFrame) -> DataFrame:
        text = [c for c in string_columns(df) if c != "StudyID"]
        return _encode(df, text) if text else df

    pa = drop_by_rule(analytes, lambda c: c.endswith("c")).filter(F.col("Visit") == 2)
    out = outcomes.select("StudyID", target)
    extra = visit.withColumnsRenamed({"STUDYID": "StudyID"})
    extra = drop_by_rule_exact(extra, {*VISIT_DROPPED, *(c for c in extra.columns if c == c.lower())})
    df = encoded(pa).join(encoded(out), "StudyID", "full").join(encoded(extra), "StudyID", "full")
    df = with_row_id(df.drop(*ANALYTE_DATES, "Visit", "StudyID"))
    if target == "PEgHTN":
        df = df.withColumn(target, binarise(target, 7))
    keep = [c for c in df.columns if c == "row_id" or (c not in PREGNANCY_EXCLUDED and c != c.lower())]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    return TableSpec(undersample(df, target, "row_id", seed), "pregnancy", target, panels=analyte_panels())


def generic(df: DataFrame, name: str, target: str, drop: list[str] | None = None, id_col: str | None = None) -> TableSpec:
    """Any table: drop columns, target 0 stays 0 and the rest becomes 1."""
    df = df.drop(*(drop or [])).withColumn(target, binarise(target, 0))
    return TableSpec(df if id_col else with_row_id(df), name, target, id_col or "row_id")


REGISTRY: dict[str, Callable[..., TableSpec]] = {
    "eeg_eye_state": eeg,
    "cleveland_heart_disease": heart,
    "diabetic_retinopathy": retinopathy,
    "diabetes_vcu": diabetes,
    "wisconsin_bc_prognosis": wpbc,
    "wisconsin_bc_diagnosis": wdbc,
    "wisconsin_bc_prognosis_panels": wpbc_panels,
    "wisconsin_bc_diagnosis_panels": wdbc_panels,
    "parkinsons": parkinsons,
    "cervical_cancer": cervical,
    "myocardial_infarction": infarction,
    "student": student,
}


def load(spark: SparkSession, name: str, path: str, **options) -> TableSpec:
    if name not in REGISTRY:
        raise KeyError(f"unknown dataset {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](spark, path, **options)


__all__ = ["TableSpec", "REGISTRY", "load", "generic", "pregnancy", "doubles"]
