"""Tables from files: delimited text in its varieties, zip members, sparse rows, sheets, Parquet; and a register of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, *, sep: str = ",", header: bool = True, names: Sequence[str] | None = None, missing: str | None = None, skip: str | None = None, decimal_comma: Sequence[str] = (), replace: dict[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Delimited text, also gzipped. names: for files without a header. missing: text that means null. skip: lines that begin
    so are left out. decimal_comma: columns of numbers written with a comma. replace: values replaced in text columns."""
    reader = spark.read.option("sep", sep).option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if missing is not None:
        reader = reader.option("nullValue", missing)
    if skip:
        reader = reader.option("comment", skip)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    if names:
        df = df.toDF(*names)
    for c in decimal_comma:
        df = df.withColumn(c, F.regexp_replace(F.col(c).cast("string"), ",", ".").cast("double"))
    if replace:
        df = df.na.replace(replace)
    return df.drop(*drop)


def read_zip_member(spark: SparkSession, path: str, member: str, **options: object) -> DataFrame:
    """A delimited file inside a zip archive, which Spark reads as a whole on one executor: for archives of moderate size."""

    def lines(content: bytes) -> list[str]:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
            return f.read().decode("utf-8", "replace").splitlines()

    unzip = F.udf(lines, "array<string>")
    text = spark.read.format("binaryFile").load(path).select(F.explode(unzip("content")).alias("value"))
    sep, header = str(options.get("sep", ",")), bool(options.get("header", True))
    return spark.read.option("sep", sep).option("header", header).option("inferSchema", True).csv(text.rdd.map(lambda r: r.value))


def read_svmlight(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """(label, features) from sparse rows, also compressed."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", n_features) if n_features else reader).load(path)


def read_sheet(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A spreadsheet, where the library that reads it is installed."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, **options))


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.option("header", True).option("compression", compression).csv(path)


def rows_of_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of two tables with the same columns, as of training and test files."""
    return a.unionByName(b)


@dataclass
class Source:
    """A named table: how to read it below a folder, its label and columns that aren't features."""

    read: Callable[[SparkSession, str], DataFrame]
    label: str
    drop: Sequence[str] = field(default_factory=tuple)


class Registry:
    def __init__(self) -> None:
        self.sources: dict[str, Source] = {}

    def add(self, name: str, source: Source) -> None:
        self.sources[name] = source

    def load(self, spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, str]:
        """The table without its dropped columns, and its label."""
        if name not in self.sources:
            raise ValueError(f"There is no source {name!r}; there are {sorted(self.sources)}")
        s = self.sources[name]
        return s.read(spark, folder).drop(*s.drop), s.label

    def names(self) -> list[str]:
        return sorted(self.sources)


def _parquet(table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: spark.read.parquet(f"{folder}/{table}.parquet")


def _csv(file: str, **options: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: read_csv(spark, [f"{folder}/{f}" for f in file.split()], **options)


#: Tables of the test data, and layouts of public datasets, for whoever has their files.
REGISTRY = Registry()
for _name, _source in {
    "lineitem": Source(_parquet("lineitem"), "l_returnflag", ("l_shipdate",)),
    "orders": Source(_parquet("orders"), "o_orderpriority", ("o_orderdate",)),
    "customer": Source(_parquet("customer"), "c_mktsegment", ("c_name",)),
    "part": Source(_parquet("part"), "p_type", ("p_name",)),
    "events": Source(_parquet("events"), "event_type", ("ts", "props")),
    "adult": Source(_csv("adult.data adult.test", header=False, names=["age", "workclass", "fnlwgt", "education", "education_num", "marital_status", "occupation", "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week", "native_country", "label"], skip="|", missing="?", replace={"<=50K.": "<=50K", ">50K.": ">50K"}), "label"),
    "bank": Source(lambda spark, folder: read_zip_member(spark, f"{folder}/bank.zip", "bank-full.csv", sep=";"), "y"),
    "car": Source(_csv("car.data", header=False, names=["buying", "maint", "doors", "persons", "lug_boot", "safety", "label"]), "label"),
    "amazon": Source(_csv("amazon.csv.gz"), "ACTION"),
    "kick": Source(_csv("kick.csv.gz", missing="?"), "IsBadBuy"),
    "internet": Source(_csv("internet.csv.gz", missing="?"), "Who_Pays_for_Access_Work"),
    "churn": Source(_csv("churn.csv.gz"), "class"),
    "cardio": Source(_csv("cardiotocography.csv.gz", sep=";", decimal_comma=["MSTV", "MLTV"]), "CLASS", ("FileName", "Date", "SegFile", "NSP")),
    "boston": Source(_csv("boston.csv.gz"), "medv"),
    "letter": Source(_csv("letter.csv.gz"), "y"),
    "satimage": Source(_csv("satimage.csv.gz"), "class"),
    "sensorless": Source(_csv("sensorless.csv.gz"), "y"),
    "spambase": Source(_csv("spambase.csv.gz"), "y"),
    "covtype": Source(_csv("covtype.csv.gz"), "label"),
    "higgs": Source(_csv("higgs.csv.gz", header=False), "_c0"),
    "default_cb": Source(lambda spark, folder: read_sheet(spark, f"{folder}/default_cb.xls", header=1), "default payment next month"),
    "breastcancer": Source(_csv("breastcancer.csv.gz"), "target"),
    "californiahousing": Source(_csv("californiahousing.csv.gz"), "MedHouseVal"),
    "diabetes": Source(_csv("diabetes.csv.gz"), "target"),
    "letor": Source(_csv("letor.csv.gz"), "0"),
    "kddcup99": Source(_csv("kddcup99.csv.gz"), "labels"),
    "diabetes_cl": Source(_csv("diabetes.csv"), "Outcome"),
    "ionosphere": Source(_csv("ionosphere_data.xls"), "column_ai", ("column_b",)),  # delimited text in spite of its name
    "phoneme": Source(_csv("phoneme.csv.gz"), "Class"),
    "wilt2": Source(_csv("wilt2.csv.gz"), "class"),
    "banknote": Source(_csv("banknote.csv.gz"), "Class"),
    "heart": Source(_csv("heart.xls"), "target"),  # likewise
    "heart2": Source(_csv("heart2.csv.gz"), "class"),
    "gamma_particle": Source(_csv("gamma_particle.csv"), "class", ("ID",)),
    "cc_default": Source(_csv("credit_card_defaulter.xls"), "default", ("_c0",)),  # likewise; the first column has no name
    "hcv": Source(_csv("hepatitis.csv.gz"), "Category", ("_c0",)),
    "smoke": Source(_csv("smoke_detection_iot.csv"), "Fire Alarm", ("_c0", "UTC")),
    "epsilon": Source(lambda spark, folder: read_svmlight(spark, f"{folder}/epsilon_normalized*"), "label"),
}.items():
    REGISTRY.add(_name, _source)
