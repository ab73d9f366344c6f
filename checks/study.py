"""The given tables seen as person, visit and diagnosis records.

customer is the person table, an order is a visit, an order line is a recorded
diagnosis of the customer who ordered it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.plans.cohort import Study
from cohortry.session import spread
from cohortry.sources.codelists import CodeList

# Fixed values of the study, used by the queries and by the SQL.
RACES = {"BUILDING": "AA", "FURNITURE": "AA", "MACHINERY": "NHPI", "AUTOMOBILE": "MR", "HOUSEHOLD": None}
SEXES = {"0": "F", "1": "F", "2": "M", "3": "M", "4": "Others"}
SETTINGS = {
    "1-URGENT": "Inpatient",
    "2-HIGH": "Inpatient",
    "3-MEDIUM": "Outpatient",
    "4-NOT SPECIFIED": "Mental health center",
    "5-LOW": None,
}
STEMS = {
    "dx": {
        "Psychotic": (295, 297),
        "Mood": (296,),
        "Bipolar (I/II)": (298,),
        "Anxiety": (300,),
        "Personality": (301,),
        "Conduct": (312,),
        "ADHD": (314,),
        "Substance Use": (303, 304, 305),
    },
    "sud": {"Alcohol": (303,), "Opioid": (304,), "Cannabis": (305,)},
}
CODES = {
    kind: {name: [f"{stem}.{tail}" for stem in stems for tail in ("00", "10")] for name, stems in named.items()}
    for kind, named in STEMS.items()
}


@lru_cache(maxsize=None)
def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table; its footer is read once per session."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def background(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("patientid"),
        F.col("c_mktsegment").alias("race"),
        (F.col("c_nationkey") % 5).alias("sex"),
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    age = (F.col("o_custkey") * 37) % 80 + F.year("o_orderdate") - 1995
    return read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("patientid"),
        F.when(F.col("o_orderkey") % 97 != 0, age).cast("string").alias("age"),
        F.col("o_orderpriority").alias("visit_type"),
        F.col("o_orderkey").alias("visit_id"),
    )


def diagnosed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line: the customer, the visit and a code."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    stem, tail = (290 + F.col("l_partkey") % 200).cast("string"), (F.col("l_suppkey") % 2).cast("string")
    code = F.concat(stem, F.lit("."), tail, F.lit("0"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("patientid"),
        F.col("l_orderkey").alias("visit_id"),
        code.alias("dsmno"),
    )


@lru_cache(maxsize=None)
def study(spark: SparkSession, folder: str) -> Study:
    return Study(
        persons=background(spark, folder),
        visits=visits(spark, folder),
        diagnoses=diagnosed(spark, folder).select("patientid", "dsmno"),
        races=RACES,
        sexes=SEXES,
        settings=SETTINGS,
        codes=CodeList.of(spark, CODES),
    )


@lru_cache(maxsize=None)
def sited_study(spark: SparkSession, folder: str) -> Study:
    """The same records with a two-part key: a customer number stands for two persons, one at each of two sites.

    They differ in sex; orders of odd number belong to the second one. Visits and diagnoses name
    the person ``backgroundid``, persons name it ``id``.
    """
    customers = read(spark, folder, "customer")
    homes = customers.select(F.col("c_custkey").cast("string").alias("home"), F.col("c_nationkey").alias("nation"))

    def site(second) -> Column:
        return ((F.col("nation") + second) % 7).cast("string").alias("siteid")

    def placed(table: DataFrame) -> DataFrame:
        met = table.join(homes, table["patientid"] == homes["home"]).withColumn("siteid", site(F.col("visit_id") % 2))
        return met.drop("home", "nation").withColumnRenamed("patientid", "backgroundid")

    persons = customers.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("race"), F.col("c_nationkey").alias("nation"), F.explode(F.array(F.lit(0), F.lit(1))).alias("second")
    )
    return Study(
        persons=persons.select("id", site(F.col("second")), "race", ((F.col("nation") + F.col("second")) % 5).alias("sex")),
        visits=placed(visits(spark, folder)),
        diagnoses=placed(diagnosed(spark, folder)).drop("visit_id"),
        races=RACES,
        sexes=SEXES,
        settings=SETTINGS,
        codes=CodeList.of(spark, CODES),
        keys=("id", "siteid"),
        visit_keys=("backgroundid", "siteid"),
        diagnosis_keys=("backgroundid", "siteid"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A log line per event: errors as error lines, the rest as timing lines of a function."""
    event, value = F.col("event_type"), F.col("value")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    error = F.format_string("%s - runner.%s - ERROR - Unable to handle event %d", stamp, event, "event_id")
    timing = F.format_string(
        "%s - runner.%s - INFO - Finished the function [%s] in %.6e seconds", stamp, event, event, value
    )
    return read(spark, folder, "events").select(F.when(event == "error", error).otherwise(timing).alias("value"))


def module_configs(spark: SparkSession, folder: str) -> DataFrame:
    """``module, config`` rows whose graph covers part, lineitem and orders.

    A part is made from two parts of lower number, an order line delivers a part into
    an order, an order is shipped to a customer.
    """

    def name(prefix: str, number):
        return F.concat(F.lit(prefix), number.cast("string"))

    def entry(kind: str, place: str, number, note: str):
        texts = (F.lit(kind).alias("type"), name(place, number).alias("location"), F.lit(note).alias("description"))
        return F.struct(*texts)

    def config(inputs, outputs):
        none = F.create_map().cast("map<string,string>")
        return F.to_json(F.struct(inputs.alias("inputs"), outputs.alias("outputs"), none.alias("params"))).alias("config")

    part, order, customer = F.col("p_partkey"), F.col("l_orderkey"), F.col("o_custkey")
    lower = [F.floor(part / divisor) for divisor in (3, 2)]
    uses = [
        F.struct(name("part_", x).alias("k"), entry("file-csv", "parts/", x, "ingredient").alias("v")) for x in lower
    ]
    others = F.filter(F.array_distinct(F.array(*uses)), lambda use: use["k"] != name("part_", part))
    parts = spread(read(spark, folder, "part").select("p_partkey")).select(
        name("make_", part).alias("module"),
        config(
            F.map_from_entries(others),
            F.create_map(name("part_", part), entry("DB-dbTable", "stock.parts.", part, "product")),
        ),
    )
    ordered = F.col("l_partkey")
    lines = spread(read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")).select(
        F.concat_ws("_", F.lit("line"), "l_orderkey", "l_linenumber").alias("module"),
        config(
            F.create_map(name("part_", ordered), entry("file-csv", "parts/", ordered, "ordered part")),
            F.create_map(name("order_", order), entry("file-csv", "orders/", order, "order")),
        ),
    )
    order = F.col("o_orderkey")
    shipped = spread(read(spark, folder, "orders").select("o_orderkey", "o_custkey")).select(
        name("ship_", order).alias("module"),
        config(
            F.create_map(name("order_", order), entry("DB-dbTable", "sales.orders.", order, "order")),
            F.create_map(name("customer_", customer), entry("file-meta", "customers/", customer, "customer")),
        ),
    )
    return parts.unionByName(lines).unionByName(shipped)


def lineage_key(spark: SparkSession, folder: str) -> str:
    """The customer with the highest number that has an order."""
    return f"customer_{read(spark, folder, 'orders').agg(F.max('o_custkey')).first()[0]}"
