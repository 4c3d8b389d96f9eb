"""Preparation of the registered data sets from their publishers' files, which lie in a folder (nothing is downloaded).

What differs between the sets is said in ``LAYOUTS``: the files, how their lines are read, where the label is and what its values mean.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import datasets

HEART = ("age", "sex", "chest_pain_type", "resting_blood_pressure", "serum_cholesterol", "fasting_blood_sugar", "resting_ecg", "max_heart_rate", "exercise_induced_angina", "oldpeak", "slope", "major_vessels", "thal")


def numbered(stem: str, n: int) -> tuple[str, ...]:
    return tuple(f"{stem}_{i}" for i in range(1, n + 1))


@dataclass(frozen=True)
class Layout:
    """files: names in the raw folder. kind: csv, whitespace, arff, zip or header (a CSV with names). first: the column of the first
    feature. label: the label's column, by number or name. known: label values with a name of their own; other: the name of the rest, or a
    format for it. drop: columns of a header that are no features. recode: features that aren't numbers."""

    files: tuple[str, ...]
    kind: str
    features: tuple[str, ...] = ()
    first: int = 0
    label: int | str = -1
    known: dict[str, str] = field(default_factory=dict)
    other: str = "{}"
    drop: tuple[str, ...] = ()
    member: str = ""
    recode: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def _male(c: Column) -> Column:
    return F.lower(F.trim(c)).startswith("male").cast("double")


#: Column names, label columns and label names of the publishers' files.
LAYOUTS = {
    "breast_cancer_diagnostic": Layout(("breast_cancer_diagnostic.csv",), "header", label="target"),
    "breast_cancer_original": Layout(
        ("breast-cancer-wisconsin.data",), "csv", first=1, label=10, known={"2": "benign"}, other="malignant",
        features=("clump_thickness", "uniformity_cell_size", "uniformity_cell_shape", "marginal_adhesion", "single_epithelial_cell_size", "bare_nuclei", "bland_chromatin", "normal_nucleoli", "mitoses"),
    ),
    "mammographic_mass": Layout(("mammographic_masses.data",), "csv", ("birads", "age", "shape", "margin", "density"), label=5, known={"0": "benign"}, other="malignant"),
    "breast_tissue": Layout(("BreastTissue.csv",), "header", label="Class", drop=("Case #",)),
    "heart_cleveland": Layout(("processed.cleveland.data",), "csv", HEART, label=13, known={"0": "no_disease"}, other="disease"),
    "statlog_heart": Layout(("heart.dat",), "whitespace", HEART, label=13, known={"1": "absent"}, other="present"),
    "spect_heart": Layout(("SPECT.train", "SPECT.test"), "csv", numbered("spect_region", 22), first=1, label=0, known={"1": "normal"}, other="abnormal"),
    "spectf_heart": Layout(("SPECTF.train", "SPECTF.test"), "csv", numbered("spectf_feature", 44), first=1, label=0, known={"1": "normal"}, other="abnormal"),
    "pima_diabetes": Layout(
        ("pima-indians-diabetes.data",), "csv", label=8, known={"0": "negative"}, other="positive",
        features=("pregnancies", "glucose", "blood_pressure", "skin_thickness", "insulin", "bmi", "diabetes_pedigree", "age"),
    ),
    "diabetic_retinopathy_debrecen": Layout(("messidor_features.arff",), "arff", numbered("feature", 19), label=19, known={"0": "no_retinopathy", "1": "retinopathy"}),
    "parkinsons": Layout(("parkinsons.data",), "header", label="status", known={"0": "healthy", "1": "parkinsons"}, drop=("name",)),
    "parkinsons_disease_classification": Layout(("pd_speech_features.csv",), "header", label="class", known={"0": "healthy", "1": "parkinsons"}, drop=("id",)),
    "ilpd": Layout(
        ("Indian Liver Patient Dataset (ILPD).csv",), "csv", label=10, known={"1": "liver_patient"}, other="non_liver_patient", recode={"gender_male": _male},
        features=("age", "gender_male", "total_bilirubin", "direct_bilirubin", "alkaline_phosphotase", "alamine_aminotransferase", "aspartate_aminotransferase", "total_proteins", "albumin", "albumin_globulin_ratio"),
    ),
    "dermatology": Layout(("dermatology.data",), "csv", numbered("dermatology_feature", 34), label=34, other="class_{}"),
    "haberman_survival": Layout(("haberman.data",), "csv", ("age", "operation_year", "positive_axillary_nodes"), label=3, known={"1": "survived_5_years"}, other="died_within_5_years"),
    "vertebral_column_2c": Layout(
        ("vertebral_column_data.zip",), "zip", label=6, known={"NO": "normal"}, other="abnormal", member="column_2C.dat",
        features=("pelvic_incidence", "pelvic_tilt", "lumbar_lordosis_angle", "sacral_slope", "pelvic_radius", "degree_spondylolisthesis"),
    ),
    "arrhythmia_binary": Layout(("arrhythmia.data",), "csv", numbered("arrhythmia_feature", 279), label=279, known={"1": "normal"}, other="arrhythmia"),
    "iris": Layout(("iris.csv",), "header", label="target"),
    "wine": Layout(("wine.csv",), "header", label="target"),
    "digits": Layout(("digits.csv",), "header", label="target"),
}


def _raw(spark: SparkSession, layout: Layout, paths: list[str]) -> tuple[DataFrame, list[str], str]:
    """Text columns, the names of the features, and the label's column."""
    if layout.kind == "header":
        df = datasets.read_csv(spark, paths, header=True)
        return df, [c for c in df.columns if c != layout.label and c not in layout.drop], str(layout.label)
    width = max(layout.first + len(layout.features), layout.label + 1)
    names = [f"_c{i}" for i in range(width)]
    names[layout.first : layout.first + len(layout.features)] = layout.features
    names[layout.label] = "_label"
    if layout.kind == "csv":
        df = datasets.read_csv(spark, paths)
        df = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=False)])
    elif layout.kind == "whitespace":
        df = datasets.read_whitespace(spark, paths[0], names)
    elif layout.kind == "arff":
        df = datasets.read_arff(spark, paths[0], names)
    else:
        df = datasets.read_zip(spark, paths[0], layout.member, names)
    return df, list(layout.features), "_label"


def read_raw(spark: SparkSession, slug: str, raw: str) -> tuple[DataFrame, list[str]]:
    """The set's features as doubles (NaN for what isn't a number) and its label ``target``, and the names of the features. Rows without a label go."""
    layout = LAYOUTS[datasets.spec_of(slug).slug]
    df, names, label = _raw(spark, layout, [f"{raw}/{f}" for f in layout.files])
    value = F.regexp_replace(F.trim(F.col(f"`{label}`")), r"^(\d+)\.0*$", "$1")
    target = F.format_string(layout.other.replace("{}", "%s"), value)
    for k, name in layout.known.items():
        target = F.when(value == k, name).otherwise(target)
    columns = [layout.recode[n](F.col(f"`{n}`")).alias(n) if n in layout.recode else datasets.numeric(F.col(f"`{n}`")).alias(n) for n in names]
    return df.select(*columns, F.when(value.isNotNull() & (value != ""), target).alias("target")).filter(F.col("target").isNotNull()), names


def prepare_dataset(spark: SparkSession, slug: str, raw: str, directory: str, force: bool = False) -> str:
    """Writes one prepared set from the files in ``raw``; an existing one is left as it is unless forced. Returns its path."""
    spec = datasets.spec_of(slug)
    if not force and datasets.exists(spark, f"{directory}/{slug}.json"):
        return f"{directory}/{slug}.parquet"
    df, names = read_raw(spark, slug, raw)
    safe = [n.replace(".", "_").replace("`", "_") for n in names]
    return datasets.save_prepared(df.toDF(*safe, "target"), directory, spec, "target", safe, force)


def prepare_datasets(spark: SparkSession, raw: str, directory: str, slugs: Sequence[str] | None = None, force: bool = False) -> list[str]:
    return [prepare_dataset(spark, slug, raw, directory, force) for slug in (slugs if slugs is not None else [s.slug for s in datasets.DATASETS])]


def main(args: Sequence[str] | None = None) -> None:
    """python -m tessera.sources.prepare [SLUG...] --raw DIR --out DIR --manifest FILE: writes the manifest and prepares sets (all without slugs)."""
    import argparse

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("slugs", nargs="*")
    p.add_argument("--raw")
    p.add_argument("--out", default="datasets/prepared")
    p.add_argument("--force", action="store_true")
    p.add_argument("--manifest", default="datasets/manifest.json")
    a = p.parse_args(args)
    datasets.write_manifest(a.manifest)
    if a.raw:
        for path in prepare_datasets(SparkSession.builder.getOrCreate(), a.raw, a.out, a.slugs or None, a.force):
            print(path)


if __name__ == "__main__":
    main()
