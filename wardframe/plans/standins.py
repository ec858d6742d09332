"""Clinical-shaped tables derived from the star-schema test tables.

The clinical data sets are not public, so the registered queries run the same
operators over these stand-ins.  Each is a projection or a per-key aggregate
of a whole driver table.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.functions import codes
from wardframe.session import pin


SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the declared schema saves a job that would infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# --- stays, admissions and labs from the event table -----------------------

EVENT_LABS = {
    10: ("click", 150.0), 11: ("click", 120.0),
    20: ("view", 150.0), 21: ("view", 120.0),
    30: ("error", 150.0), 31: ("error", 120.0),
    40: ("purchase", 150.0), 41: ("purchase", 120.0),
}


def _week_admission() -> Column:
    week = F.floor(F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) / 7)
    return (F.col("user_id") * 100 + week).cast("long")


def event_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stay per signup, as long in hours as its value; admissions are weeks."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return events.select(
        F.col("user_id").alias("subject_id"),
        _week_admission().alias("hadm_id"),
        F.col("event_id").alias("icustay_id"),
        F.col("ts").alias("intime"),
        F.timestamp_add("HOUR", F.floor("value").cast("int"), F.col("ts")).alias("outtime"),
    )


def event_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's week; the first purchase over 100 stands for death."""
    late = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("subject_id"), _week_admission().alias("hadm_id"))
        .agg(
            F.min("ts").alias("admittime"),
            F.max("ts").alias("dischtime"),
            F.min(F.when(late, F.col("ts"))).alias("deathtime"),
        )
    )


def event_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    base = F.when(kind == "click", 10).when(kind == "view", 20).when(kind == "error", 30).when(kind == "purchase", 40)
    return (
        table(spark, sf_dir, "events")
        .where(kind != "signup")
        .select(
            F.col("user_id").alias("subject_id"),
            _week_admission().alias("hadm_id"),
            (base + F.col("event_id") % 2).cast("int").alias("itemid"),
            F.col("ts").alias("charttime"),
            F.col("value").alias("valuenum"),
        )
    )


def event_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "icustays": event_stays(spark, sf_dir),
        "admissions": event_admissions(spark, sf_dir),
        "labevents": event_labs(spark, sf_dir),
    }


EVENT_SQL = """
ev AS (
  SELECT *, user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS hadm FROM events
),
icustays AS (
  SELECT user_id AS subject_id, hadm AS hadm_id, event_id AS icustay_id, ts AS intime,
         ts + to_hours(CAST(floor(value) AS BIGINT)) AS outtime
  FROM ev WHERE event_type = 'signup'
),
admissions AS (
  SELECT user_id AS subject_id, hadm AS hadm_id, min(ts) AS admittime, max(ts) AS dischtime,
         min(CASE WHEN event_type = 'purchase' AND value > 100 THEN ts END) AS deathtime
  FROM ev GROUP BY user_id, hadm
),
labevents AS (
  SELECT user_id AS subject_id, hadm AS hadm_id, ts AS charttime, value AS valuenum,
         CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 WHEN 'error' THEN 30 ELSE 40 END
           + event_id % 2 AS itemid
  FROM ev WHERE event_type <> 'signup'
)
"""

# --- stays, charts, intakes and diagnoses from orders and line items -------


def order_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stay per order; a customer's orders of one year share an admission."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    year = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        (F.col("o_custkey") * 10 + (year - 1995)).cast("long").alias("hadm_id"),
        F.col("o_orderkey").alias("icustay_id"),
        F.when(urgent, "MICU").otherwise("SICU").alias("first_careunit"),
        F.when(F.col("o_orderstatus") == "F", "carevue").otherwise("metavision").alias("dbsource"),
        F.col("o_orderdate").alias("intime"),
        F.timestamp_add("HOUR", F.floor(F.col("o_totalprice") / 10000).cast("int"), F.col("o_orderdate")).alias(
            "outtime"
        ),
    )


def order_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; the balance sets the age."""
    male = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY")
    born = F.lit("1990-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.when(male, "M").otherwise("F").alias("gender"),
        F.timestamp_add("DAY", -F.floor("c_acctbal").cast("int"), born).alias("dob"),
    )


def order_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers around the order date for open and finished orders."""
    key = F.col("o_orderkey")
    service = F.element_at(F.array(*[F.lit(s) for s in ("CSURG", "ORTHO", "MED", "NMED")]), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(
        (F.col("o_custkey") * 10 + (F.year("o_orderdate") - 1995)).cast("long").alias("hadm_id"),
        service.alias("curr_service"),
        F.timestamp_add("HOUR", (key % 41 - 20).cast("int"), F.col("o_orderdate")).alias("transfertime"),
    )


def order_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers folded into the code range 1500 to 2499, as text."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_linenumber").alias("seq_num"),
        (F.col("l_partkey") % 1000 + 1500).cast("string").alias("icd9_code"),
    )


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the smaller parts only, so some diagnoses are unknown."""
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_size") <= 20)
        .groupBy((F.col("p_partkey") % 1000 + 1500).cast("string").alias("icd9_code"))
        .agg(F.min("p_name").alias("short_title"), F.max("p_type").alias("long_title"))
    )


ORDER_TYPES = {
    "lymphoma": (("200", "201", "202"), ()),
    "myeloma": (("203",), ()),
    "leukemia": (("204", "205", "206", "207", "208"), ()),
    "myelodysplastic_syndrome": ((), ("2387", "2388")),
}


def line_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chart rows of their order; the line number is the item."""
    discount = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("icustay_id"),
        F.col("l_linenumber").alias("itemid"),
        F.col("l_shipdate").alias("charttime"),
        F.col("l_returnflag").alias("value"),
        F.col("l_quantity").alias("valuenum"),
        F.when(discount >= 0.08, 1).when(discount >= 0.03, 0).alias("error"),
    )


def line_intake(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """The line items of one status: one of two intake systems."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status).select(
        F.col("l_orderkey").alias("icustay_id"),
        F.col("l_linenumber").alias("itemid"),
        (F.col("l_quantity") - 25).alias("amount"),
    )


def line_cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.when(F.col("l_returnflag") == "R", "BLOOD CULTURE").otherwise("URINE").alias("spec_type_desc"),
        F.when(F.col("l_quantity") > 20, F.col("l_partkey")).alias("org_itemid"),
        F.when(F.col("l_discount") > 0.04, F.col("l_suppkey")).alias("ab_itemid"),
    )


def line_durations(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(
        F.col("l_orderkey").alias("icustay_id"), (F.col("l_tax") * 100 - 4).alias("duration_hours")
    )


def line_gases(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "O").select(
        F.col("l_orderkey").alias("icustay_id"),
        F.col("l_tax").alias("ph"),
        quantity.alias("pco2"),
        price.alias("po2"),
        F.col("l_discount").alias("bicarbonate"),
        (quantity - 25).alias("baseexcess"),
        F.when(quantity > 10, quantity).alias("spo2"),
        F.when(F.col("l_tax") > 0.02, price).alias("lactate"),
    )


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "O").select(
        F.col("o_orderkey").alias("icustay_id"), F.floor(F.col("o_totalprice") / 50000).cast("int").alias("sofa")
    )


ORDER_SQL = """
icustays AS (
  SELECT o_custkey AS subject_id, o_custkey * 10 + (year(o_orderdate) - 1995) AS hadm_id,
         o_orderkey AS icustay_id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'MICU' ELSE 'SICU' END AS first_careunit,
         CASE WHEN o_orderstatus = 'F' THEN 'carevue' ELSE 'metavision' END AS dbsource,
         o_orderdate AS intime,
         o_orderdate + to_hours(CAST(floor(o_totalprice / 10000) AS BIGINT)) AS outtime
  FROM orders
),
patients AS (
  SELECT c_custkey AS subject_id,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN 'M' ELSE 'F' END AS gender,
         TIMESTAMP '1990-01-01' - to_days(CAST(floor(c_acctbal) AS INTEGER)) AS dob
  FROM customer
),
services AS (
  SELECT o_custkey * 10 + (year(o_orderdate) - 1995) AS hadm_id,
         CASE o_orderkey % 4 WHEN 0 THEN 'CSURG' WHEN 1 THEN 'ORTHO' WHEN 2 THEN 'MED' ELSE 'NMED' END
           AS curr_service,
         o_orderdate + to_hours(o_orderkey % 41 - 20) AS transfertime
  FROM orders WHERE o_orderstatus <> 'P'
),
diagnoses AS (
  SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num,
         CAST(l_partkey % 1000 + 1500 AS VARCHAR) AS icd9_code
  FROM lineitem
),
dictionary AS (
  SELECT CAST(p_partkey % 1000 + 1500 AS VARCHAR) AS icd9_code, min(p_name) AS short_title,
         max(p_type) AS long_title
  FROM part WHERE p_size <= 20 GROUP BY 1
),
charts AS (
  SELECT l_orderkey AS icustay_id, l_linenumber AS itemid, l_shipdate AS charttime, l_returnflag AS value,
         l_quantity AS valuenum,
         CASE WHEN l_discount >= 0.08 THEN 1 WHEN l_discount >= 0.03 THEN 0 END AS error
  FROM lineitem
),
intake AS (
  SELECT l_orderkey AS icustay_id, l_linenumber AS itemid, l_quantity - 25 AS amount, l_linestatus
  FROM lineitem
),
cultures AS (
  SELECT l_orderkey AS hadm_id,
         CASE WHEN l_returnflag = 'R' THEN 'BLOOD CULTURE' ELSE 'URINE' END AS spec_type_desc,
         CASE WHEN l_quantity > 20 THEN l_partkey END AS org_itemid,
         CASE WHEN l_discount > 0.04 THEN l_suppkey END AS ab_itemid
  FROM lineitem
),
gases AS (
  SELECT l_orderkey AS icustay_id, l_tax AS ph, l_quantity AS pco2, l_extendedprice AS po2,
         l_discount AS bicarbonate, l_quantity - 25 AS baseexcess,
         CASE WHEN l_quantity > 10 THEN l_quantity END AS spo2,
         CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS lactate
  FROM lineitem WHERE l_linestatus = 'O'
),
scores AS (
  SELECT o_orderkey AS icustay_id, CAST(floor(o_totalprice / 50000) AS INTEGER) AS sofa
  FROM orders WHERE o_orderstatus <> 'O'
)
"""

# --- every clinical table, with the real item codes ------------------------

LAB_ITEMS = tuple(codes.LAB_CODES)
CHART_ITEMS = (
    *chain.from_iterable(codes.VITAL_CODES.values()), *chain.from_iterable(codes.LIVER_CODES.values()),
    152, 229, 7949, 226499,
)
COMORBIDITY_DIVISORS = dict(zip(codes.COMORBIDITIES, (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)))


def _picked(items: tuple[int, ...], by: str) -> str:
    return f"element_at(array({', '.join(map(str, items))}), CAST({by} % {len(items)} AS INT) + 1)"


def clinical_tables(spark: SparkSession, sf_dir: str, admissions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stays are orders, events their line items; items are drawn from the
    real code lists by part or line number.  With ids of ``admissions`` the
    stays and the tables joined with them hold these admissions alone."""
    stays = order_stays(spark, sf_dir)
    if admissions is not None:
        # written, so that the optimiser knows how few they are
        stays = pin(stays.join(admissions, "hadm_id", "left_semi").select(*stays.columns))
    keys = ["subject_id", "hadm_id", "icustay_id"]
    lines = (
        table(spark, sf_dir, "lineitem")
        .withColumnRenamed("l_orderkey", "icustay_id")
        .join(stays.select(*keys, "intime"), "icustay_id")
    )
    orders = table(spark, sf_dir, "orders")
    hadm = (F.col("o_custkey") * 10 + (F.year("o_orderdate") - 1995)).cast("long").alias("hadm_id")
    low = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")
    flagged, returned = lines.where("l_linestatus = 'F'"), lines.where("l_returnflag = 'R'")
    return {
        "icustays": stays,
        "patients": order_patients(spark, sf_dir),
        "services": order_services(spark, sf_dir),
        "diagnoses_icd": order_diagnoses(spark, sf_dir).withColumn(
            "icd9_code",
            F.expr("CASE WHEN icd9_code = '2387' THEN concat(icd9_code, seq_num) ELSE icd9_code END"),
        ),
        "d_icd_diagnoses": part_dictionary(spark, sf_dir),
        "admissions": orders.groupBy(F.col("o_custkey").alias("subject_id"), hadm).agg(
            F.min("o_orderdate").alias("admittime"),
            F.expr("max(o_orderdate) + interval '200' hour").alias("dischtime"),
            F.min(F.when(low, F.expr("o_orderdate + interval '30' hour"))).alias("deathtime"),
        ),
        "labevents": lines.selectExpr(
            "subject_id", "hadm_id", f"{_picked(LAB_ITEMS, 'l_partkey')} AS itemid",
            "timestampadd(HOUR, CAST((l_suppkey * 7 + l_linenumber * 5) % 73 - 36 AS INT), intime) AS charttime",
            "l_extendedprice / 500 AS valuenum",
        ),
        "chartevents": lines.selectExpr(
            *keys, f"{_picked(CHART_ITEMS, 'l_partkey')} AS itemid",
            "timestampadd(HOUR, CAST(l_suppkey % 97 - 48 AS INT), intime) AS charttime",
            "CASE l_returnflag WHEN 'R' THEN 'Dialysis Line' WHEN 'A' THEN 'Other' END AS value",
            "l_quantity - 5 AS valuenum",
            "CASE WHEN l_discount >= 0.08 THEN 1 WHEN l_discount >= 0.03 THEN 0 END AS error",
        ),
        "inputevents_mv": lines.where("l_linestatus = 'O'").selectExpr(
            *keys, f"{_picked((225168, 226368, 225170, 226369, 227536), 'l_linenumber')} AS itemid",
            "l_quantity - 25 AS amount",
        ),
        "inputevents_cv": flagged.selectExpr(
            *keys, f"{_picked((30001, 30104, 30006, 40788, 40907), 'l_linenumber')} AS itemid",
            "l_quantity - 45 AS amount",
        ),
        "outputevents": returned.selectExpr(
            "icustay_id", f"{_picked((40386, 40425, 1), 'l_partkey')} AS itemid", "l_quantity - 48 AS value"
        ),
        "datetimeevents": returned.where("l_tax >= 0.08").selectExpr(
            "icustay_id", f"{_picked((225318, 225128, 1, 2), 'l_partkey')} AS itemid"
        ),
        "procedureevents_mv": flagged.where("l_discount >= 0.1").selectExpr(
            "icustay_id", f"{_picked((225441, 1, 2), 'l_partkey')} AS itemid"
        ),
        "microbiologyevents": lines.selectExpr(
            "subject_id", "hadm_id",
            "CASE WHEN l_returnflag = 'R' THEN 'BLOOD CULTURE' ELSE 'URINE' END AS spec_type_desc",
            "CASE WHEN l_quantity > 20 THEN l_partkey END AS org_itemid",
            "CASE WHEN l_discount > 0.04 THEN l_suppkey END AS ab_itemid",
        ),
        "sofa": stays.join(order_scores(spark, sf_dir), "icustay_id").select(*keys, "sofa"),
        "vasopressordurations": line_durations(spark, sf_dir, "A"),
        "ventdurations": line_durations(spark, sf_dir, "N"),
        "bloodgasfirstdayarterial": line_gases(spark, sf_dir),
        "elixhauser_quan": orders.groupBy(hadm).agg(
            *[
                F.max(F.when(F.col("o_orderkey") % d == 0, 1).otherwise(0)).alias(name)
                for name, d in COMORBIDITY_DIVISORS.items()
            ]
        ),
    }


# --- the model table from documents and labels -----------------------------

DOC_FEATURES = ("n_chars", "n_words", "n_lines", "digit_share", "upper_share", "punct_share", "mean_word")


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over each whole text; shares of texts without the feature are
    NULL.  The language stands for the site, the source for the category."""
    text = F.col("text")
    size = F.length(text)

    def without(characters: str) -> Column:
        left = text
        for c in characters:
            left = F.replace(left, F.lit(c), F.lit(""))
        return size - F.length(left)

    counted = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        size.alias("size"),
        F.regexp_count(text, F.lit("[0-9]")).alias("d"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("u"),
        F.regexp_count(text, F.lit("[.,;:!?]")).alias("p"),
        without(" \n").alias("b"),
        without("\n").alias("l"),
    )

    def share(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name).cast("double") / F.col("size"))

    words = (F.col("b") + 1).cast("double")
    return counted.select(
        "doc_id", "lang", "source",
        "n_chars",
        words.alias("n_words"),
        (F.col("l") + 1).cast("double").alias("n_lines"),
        share("d").alias("digit_share"),
        share("u").alias("upper_share"),
        share("p").alias("punct_share"),
        (F.col("size").cast("double") / words).alias("mean_word"),
    )


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: features, category flags, site and outcome."""
    labels = table(spark, sf_dir, "labels")
    return doc_features(spark, sf_dir).join(labels, "doc_id").select(
        "doc_id", "source", "lang",
        F.when(F.col("lang") == "en", "A").otherwise("B").alias("site"),
        *DOC_FEATURES,
        F.col("toxic").cast("int").alias("toxic"),
        F.col("quality").cast("int").alias("label"),
    )


DOC_SQL = r"""
counted AS (
  SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars, length(text) AS size,
         length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS d,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS u,
         length(text) - length(regexp_replace(text, '[.,;:!?]', '', 'g')) AS p,
         length(text) - length(regexp_replace(text, '[ \n]', '', 'g')) AS b,
         length(text) - length(regexp_replace(text, '\n', '', 'g')) AS l
  FROM documents
),
docs AS (
  SELECT doc_id, lang, source, n_chars, CAST(b + 1 AS DOUBLE) AS n_words, CAST(l + 1 AS DOUBLE) AS n_lines,
         CASE WHEN d > 0 THEN CAST(d AS DOUBLE) / size END AS digit_share,
         CASE WHEN u > 0 THEN CAST(u AS DOUBLE) / size END AS upper_share,
         CASE WHEN p > 0 THEN CAST(p AS DOUBLE) / size END AS punct_share,
         CAST(size AS DOUBLE) / (b + 1) AS mean_word
  FROM counted
),
model AS (
  SELECT docs.doc_id, source, lang, CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS site,
         n_chars, n_words, n_lines, digit_share, upper_share, punct_share, mean_word,
         toxic, quality AS label
  FROM docs JOIN labels ON docs.doc_id = labels.doc_id
)
"""


# --- one stay and one event per line, so that every renal code counts alone ---

RRT_OLD_ITEMS = tuple(i for items, _ in codes.RRT_TEXT_RULES for i in items)
RRT_TEXTS = tuple(text for _, texts in codes.RRT_TEXT_RULES for text in texts or ()) + ("Other",)
RENAL_EVENTS = {
    "chartevents": (*RRT_OLD_ITEMS, *codes.RRT_CHART_NEW, 1),
    "inputevents_cv": (*codes.RRT_INTAKE_OLD, 1),
    "outputevents": (*codes.RRT_OUTPUT_OLD, 1),
    "inputevents_mv": (*codes.RRT_INTAKE_NEW, 1),
    "datetimeevents": (*codes.RRT_DATES_NEW, 1),
    "procedureevents_mv": (*codes.RRT_PROCEDURES_NEW, 1),
}


def renal_lines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Events over the whole renal code lists, each of a stay of its own; half
    of them are charts."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS subject_id", "CAST(l_linenumber AS LONG) AS hadm_id",
        "l_orderkey * 10 + l_linenumber AS icustay_id", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        "l_linenumber", "(l_suppkey + l_linenumber) % 10 AS place",
        "CASE WHEN l_linenumber % 4 = 3 THEN 'metavision' ELSE 'carevue' END AS dbsource",
    )
    tables = {"icustays": lines.select("subject_id", "hadm_id", "icustay_id", "dbsource")}
    for i, (name, items) in enumerate(RENAL_EVENTS.items()):
        texts = ", ".join(f"'{t}'" for t in RRT_TEXTS)
        value = f"element_at(array({texts}), CAST(mix % {len(RRT_TEXTS)} AS INT) + 1)"
        own = lines.where(f"place = {i}" if i else "place = 0 OR place > 5").selectExpr(
            "*", "subject_id DIV 4 + l_linenumber AS mix"
        )
        tables[name] = own.selectExpr(
            "icustay_id", f"{_picked(items, 'l_partkey')} AS itemid",
            "l_quantity - 5 AS valuenum", "l_quantity - 5 AS amount",
            f"CASE WHEN l_linenumber < 7 THEN {value} END AS value" if name == "chartevents" else "l_quantity - 5 AS value",
            "CASE WHEN l_discount >= 0.08 THEN 1 WHEN l_discount >= 0.03 THEN 0 END AS error",
        )
    return tables
