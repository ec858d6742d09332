"""Equivalent SQL of the registered queries, written the way the question is
asked (ranks over pairs, one join per source) rather than the way it is run."""

from __future__ import annotations

from wardframe.functions import codes
from wardframe.plans.standins import (
    CHART_ITEMS, COMORBIDITY_DIVISORS, DOC_FEATURES, DOC_SQL, EVENT_SQL, LAB_ITEMS, ORDER_SQL, RENAL_EVENTS, RRT_TEXTS,
)

ORACLE: dict[str, str] = {}

# Fixed values, stated here again so that a wrong code in the library shows:
# vital signs, liver enzymes and diagnosis types.
VITALS = {
    "temperature": (223761, 678), "respiration": (220210, 618, 3603), "heart_rate": (220045, 211),
    "arterial_bp_systolic": (220179, 220050, 51, 3313), "arterial_bp_diastolic": (220180, 220051, 8502, 8368),
    "arterial_bp_mean": (220181, 220052, 52, 3312),
}
ENZYMES = {"ast": (769, 220587), "alt": (770, 220644)}
MALIGNANCIES = {
    "lymphoma": (("200", "201", "202"), ()), "myeloma": (("203",), ()),
    "leukemia": (("204", "205", "206", "207", "208"), ()),
    "myelodysplastic_syndrome": ((), ("23872", "23873", "23874", "23875")),
}


def _put(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = ("WITH " + ",".join(ctes) + "\n" if ctes else "") + body


EVENT_LABELS = """
lab_pairs AS (
  SELECT i.subject_id, i.hadm_id, i.icustay_id, i.intime, a.admittime,
         CAST(CASE WHEN a.deathtime BETWEEN i.intime AND i.outtime THEN 1 ELSE 0 END AS INTEGER) AS mort_icu,
         CAST(CASE WHEN a.deathtime BETWEEN a.admittime AND a.dischtime THEN 1 ELSE 0 END AS INTEGER) AS mort_hosp,
         CAST(CASE WHEN a.deathtime BETWEEN i.intime AND i.intime + INTERVAL 30 DAY THEN 1 ELSE 0 END AS INTEGER)
           AS mort_30,
         CAST(CASE WHEN a.deathtime BETWEEN a.admittime AND a.admittime + INTERVAL 30 DAY THEN 1 ELSE 0 END
           AS INTEGER) AS mort_30_admission,
         l.charttime,
         CASE WHEN l.itemid IN (10, 11) THEN 'click' WHEN l.itemid IN (20, 21) THEN 'view'
              WHEN l.itemid IN (30, 31) THEN 'error' WHEN l.itemid IN (40, 41) THEN 'purchase' END AS label,
         CASE WHEN l.itemid % 2 = 0 AND l.valuenum > 150 THEN NULL
              WHEN l.itemid % 2 = 1 AND l.valuenum > 120 THEN NULL ELSE l.valuenum END AS v
  FROM icustays i
  LEFT JOIN labevents l ON l.subject_id = i.subject_id AND l.hadm_id = i.hadm_id AND l.valuenum > 0
    AND l.charttime BETWEEN i.intime - INTERVAL 24 HOUR AND i.intime + INTERVAL 24 HOUR
  LEFT JOIN admissions a ON a.subject_id = i.subject_id AND a.hadm_id = i.hadm_id
)
"""

LAB_PIVOT = """max(CASE WHEN label = 'click' THEN v END) AS click, max(CASE WHEN label = 'view' THEN v END) AS view,
  max(CASE WHEN label = 'error' THEN v END) AS error, max(CASE WHEN label = 'purchase' THEN v END) AS purchase"""

LINE_RULE = """(itemid IN (1, 2) AND value IS NOT NULL OR itemid = 3 AND value = 'R'
  OR itemid = 4 AND value IN ('A', 'N'))"""

COHORT_SQL = """
co AS (
  SELECT i.*, p.gender,
         date_diff('microsecond', i.intime, i.outtime) / 1e6 / 60 / 60 / 24 AS icu_length_of_stay,
         date_diff('microsecond', p.dob, i.intime) / 1e6 / 60 / 60 / 24 / 365.242 AS age,
         rank() OVER (PARTITION BY i.subject_id ORDER BY i.intime ASC NULLS LAST) AS icustay_id_order
  FROM icustays i JOIN patients p ON i.subject_id = p.subject_id
),
serv AS (
  SELECT i.hadm_id, i.icustay_id, s.curr_service, s.transfertime,
         CASE WHEN s.curr_service LIKE '%SURG' OR s.curr_service = 'ORTHO' THEN 1 ELSE 0 END AS surgical,
         rank() OVER (PARTITION BY i.hadm_id ORDER BY s.transfertime DESC NULLS FIRST) AS r
  FROM icustays i JOIN services s ON i.hadm_id = s.hadm_id AND s.transfertime < i.intime + INTERVAL 12 HOUR
),
serv_left AS (
  SELECT i.hadm_id, i.icustay_id, s.curr_service, s.transfertime,
         CASE WHEN s.curr_service LIKE '%SURG' OR s.curr_service = 'ORTHO' THEN 1 ELSE 0 END AS surgical,
         rank() OVER (PARTITION BY i.hadm_id ORDER BY s.transfertime DESC NULLS FIRST) AS r
  FROM icustays i LEFT JOIN services s ON i.hadm_id = s.hadm_id AND s.transfertime < i.intime + INTERVAL 12 HOUR
),
typed AS (
  SELECT hadm_id, CASE WHEN seq_num = 1 THEN 1 ELSE 2 END AS hm_indicator,
         CASE WHEN substring(icd9_code, 1, 3) IN ('200', '201', '202') THEN 'lymphoma'
              WHEN substring(icd9_code, 1, 3) = '203' THEN 'myeloma'
              WHEN substring(icd9_code, 1, 3) IN ('204', '205', '206', '207', '208') THEN 'leukemia'
              WHEN icd9_code IN ('2387', '2388') THEN 'myelodysplastic_syndrome' END AS d_type
  FROM diagnoses
),
kinds AS (
  SELECT t.hadm_id, t.hm_indicator, max(t.d_type) AS d_type
  FROM typed t JOIN (SELECT hadm_id, min(hm_indicator) AS m FROM typed WHERE d_type IS NOT NULL GROUP BY hadm_id) k
    ON t.hadm_id = k.hadm_id AND t.hm_indicator = k.m
  WHERE t.d_type IS NOT NULL GROUP BY t.hadm_id, t.hm_indicator
),
flagged AS (
  SELECT co.subject_id, co.hadm_id, co.icustay_id, co.gender, co.icu_length_of_stay, co.age,
         co.icustay_id_order, serv.surgical, kinds.hm_indicator, kinds.d_type,
         CASE WHEN first_careunit = 'MICU' THEN 0 ELSE 1 END AS exclusion_1st_care_unit,
         CASE WHEN icu_length_of_stay < 1 THEN 1 ELSE 0 END AS exclusion_los,
         CASE WHEN age < 16 THEN 1 ELSE 0 END AS exclusion_age,
         CASE WHEN icustay_id_order <> 1 THEN 1 ELSE 0 END AS exclusion_first_stay,
         CASE WHEN surgical = 1 THEN 1 ELSE 0 END AS exclusion_surgical
  FROM co JOIN serv ON co.icustay_id = serv.icustay_id AND serv.r = 1 JOIN kinds ON co.hadm_id = kinds.hadm_id
)
"""

FLAG_SQL = f"""
src1 AS (
  SELECT DISTINCT c.icustay_id FROM charts c JOIN icustays i ON c.icustay_id = i.icustay_id
  WHERE i.dbsource = 'carevue' AND {LINE_RULE} AND error IS DISTINCT FROM 1 AND valuenum > 48
),
src2 AS (SELECT DISTINCT icustay_id FROM intake WHERE l_linestatus = 'F' AND itemid IN (5, 6) AND amount > 20),
src3 AS (SELECT DISTINCT icustay_id FROM intake WHERE l_linestatus = 'O' AND itemid = 7 AND amount > 22),
src4 AS (
  SELECT DISTINCT icustay_id FROM charts WHERE itemid IN (6, 7) AND valuenum > 47 AND error IS DISTINCT FROM 1
),
src5 AS (
  SELECT DISTINCT l_orderkey AS icustay_id FROM lineitem WHERE l_returnflag = 'R' AND l_tax * 100 - 4 > 3.5
),
rrt AS (
  SELECT i.subject_id, i.hadm_id, i.icustay_id,
         CASE WHEN src1.icustay_id IS NOT NULL OR src2.icustay_id IS NOT NULL OR src3.icustay_id IS NOT NULL
                OR src4.icustay_id IS NOT NULL OR src5.icustay_id IS NOT NULL THEN 1 ELSE 0 END AS rrt
  FROM icustays i
  LEFT JOIN src1 ON i.icustay_id = src1.icustay_id LEFT JOIN src2 ON i.icustay_id = src2.icustay_id
  LEFT JOIN src3 ON i.icustay_id = src3.icustay_id LEFT JOIN src4 ON i.icustay_id = src4.icustay_id
  LEFT JOIN src5 ON i.icustay_id = src5.icustay_id
)
"""

CHART_SQL = """
chart_ranked AS (
  SELECT c.icustay_id, c.itemid, c.valuenum,
         dense_rank() OVER (PARTITION BY c.icustay_id, c.itemid
           ORDER BY abs(date_diff('microsecond', i.intime, c.charttime)) ASC NULLS LAST) AS r
  FROM charts c JOIN icustays i ON c.icustay_id = i.icustay_id
),
liver AS (
  SELECT icustay_id, itemid, max(CASE WHEN itemid IN (4, 5) THEN valuenum END) AS ast,
         max(CASE WHEN itemid IN (6, 7) THEN valuenum END) AS alt
  FROM chart_ranked WHERE r = 1 AND itemid IN (4, 5, 6, 7) GROUP BY icustay_id, itemid
),
vitals AS (
  SELECT icustay_id, max(CASE WHEN itemid IN (1, 2) THEN valuenum END) AS temperature,
         max(CASE WHEN itemid IN (3, 4, 5) THEN valuenum END) AS respiration,
         max(CASE WHEN itemid IN (6, 7) THEN valuenum END) AS heart_rate
  FROM chart_ranked WHERE r = 1 GROUP BY icustay_id
)
"""

RESULT_SQL = """
culture AS (
  SELECT hadm_id, max(CASE WHEN org_itemid IS NULL AND ab_itemid IS NULL THEN 1 ELSE 0 END) AS p_blood_culture_1
  FROM cultures WHERE spec_type_desc = 'BLOOD CULTURE' GROUP BY hadm_id
),
rbc AS (
  SELECT icustay_id, max(CASE WHEN itemid > 0 THEN 1 ELSE 0 END) AS rbc_1
  FROM (SELECT icustay_id, itemid FROM intake WHERE l_linestatus = 'O' AND itemid IN (1, 2) AND amount > 0
        UNION ALL
        SELECT icustay_id, itemid FROM intake WHERE l_linestatus = 'F' AND itemid = 3 AND amount > 0)
  GROUP BY icustay_id
),
pressor AS (
  SELECT l_orderkey AS icustay_id, max(CASE WHEN l_tax * 100 - 4 > 0 THEN 1 ELSE 0 END) AS vasopressor_1
  FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey
),
gas AS (
  SELECT icustay_id, max(ph) AS abg_ph, max(pco2) AS abg_pco2, max(po2) AS abg_po2,
         max(bicarbonate) AS abg_bicarbonate, max(baseexcess) AS abg_baseexcess, max(spo2) AS abg_spo2,
         max(lactate) AS abg_lactate
  FROM gases GROUP BY icustay_id
)
"""

_put("code_filter", """SELECT l_linenumber AS itemid, count(*) AS n, max(l_quantity) AS max_value,
  min(l_quantity) AS min_value FROM lineitem WHERE l_linenumber IN (1, 3, 5) AND l_quantity > 25 GROUP BY 1""")
_put("label_map_cap", """SELECT event_type AS label, count(*) AS n,
  count(CASE WHEN value <= CASE WHEN event_id % 2 = 0 THEN 150 ELSE 120 END THEN 1 END) AS n_kept,
  max(CASE WHEN value <= CASE WHEN event_id % 2 = 0 THEN 150 ELSE 120 END THEN value END) AS max_v
  FROM events WHERE event_type <> 'signup' GROUP BY 1""")
_put("suffix_like", """SELECT curr_service,
  CASE WHEN curr_service LIKE '%SURG' OR curr_service = 'ORTHO' THEN 1 ELSE 0 END AS surgical, count(*) AS n
  FROM services GROUP BY 1, 2""", ORDER_SQL)
_put("prefix_phenotype", """SELECT icd9_code,
  CASE WHEN icd9_code <> 'None' AND (substring(icd9_code, 1, 3) IN ('200', '201', '202') OR icd9_code IN ('2387'))
    THEN 1 ELSE 0 END AS hm, count(*) AS n FROM diagnoses GROUP BY 1, 2""", ORDER_SQL)
_put("null_safe_neq", "SELECT error, count(*) AS n FROM charts WHERE error IS DISTINCT FROM 1 GROUP BY 1", ORDER_SQL)
_put("reindexed_columns", "SELECT c_custkey, c_acctbal, CAST(NULL AS DOUBLE) AS absent FROM customer")
_put("time_between", """SELECT icustay_id, abs(date_diff('microsecond', outtime, intime)) / 1e6 AS seconds,
  round(date_diff('day', CAST(dob AS DATE), CAST(intime AS DATE)) / 365.242, 2) AS years,
  intime + INTERVAL 12 HOUR AS shifted FROM icustays i JOIN patients p ON i.subject_id = p.subject_id""", ORDER_SQL)

_put("interval_left_join", """SELECT i.subject_id, i.hadm_id, i.icustay_id, l.charttime,
  CAST(l.itemid AS INTEGER) AS itemid, l.valuenum
  FROM icustays i LEFT JOIN labevents l ON l.subject_id = i.subject_id AND l.hadm_id = i.hadm_id
    AND l.valuenum > 0 AND l.charttime BETWEEN i.intime - INTERVAL 24 HOUR AND i.intime + INTERVAL 24 HOUR""",
     EVENT_SQL)
_put("interval_repeated_anchors", """SELECT i.subject_id, i.hadm_id, i.icustay_id, l.charttime,
  CAST(l.itemid AS INTEGER) AS itemid, l.valuenum
  FROM (SELECT *, unnest(range(1 + icustay_id % 3)) AS copy FROM icustays) i
  LEFT JOIN labevents l ON l.subject_id = i.subject_id AND l.hadm_id = i.hadm_id AND l.valuenum > 0
    AND l.subject_id % 5 > 1 AND l.charttime BETWEEN i.intime - INTERVAL 24 HOUR AND i.intime + INTERVAL 24 HOUR""",
     EVENT_SQL)
_put("nearest_liver", "SELECT * FROM liver", ORDER_SQL, CHART_SQL)
_put("liver_per_stay", "SELECT icustay_id, max(ast) AS ast FROM liver WHERE ast IS NOT NULL GROUP BY 1",
     ORDER_SQL, CHART_SQL)
_put("nearest_vitals", "SELECT * FROM vitals", ORDER_SQL, CHART_SQL)
_put("labs_24h_pivot", f"""SELECT subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30, {LAB_PIVOT}
  FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id, hadm_id, icustay_id, label
          ORDER BY abs(date_diff('microsecond', intime, charttime)) ASC NULLS LAST) AS r FROM lab_pairs)
  WHERE r = 1 GROUP BY subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30""", EVENT_SQL, EVENT_LABELS)
_put("labs_long_ranked", f"""SELECT r AS lab_test_rank, subject_id, hadm_id, icustay_id, mort_icu, mort_hosp,
  mort_30_admission AS mort_30, charttime, {LAB_PIVOT}
  FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id, hadm_id, icustay_id, label
          ORDER BY abs(date_diff('microsecond', admittime, charttime)) ASC NULLS LAST) AS r FROM lab_pairs)
  WHERE r = 1
  GROUP BY r, subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30_admission, charttime""",
     EVENT_SQL, EVENT_LABELS)
_put("stay_order_rank", """SELECT subject_id, icustay_id, intime,
  rank() OVER (PARTITION BY subject_id ORDER BY intime ASC NULLS LAST) AS icustay_id_order FROM icustays""", ORDER_SQL)
_put("dense_rank_by_day", """SELECT icustay_id, charttime, valuenum,
  dense_rank() OVER (PARTITION BY icustay_id ORDER BY charttime DESC NULLS FIRST) AS d_rank FROM charts""", ORDER_SQL)
_put("latest_service", "SELECT hadm_id, icustay_id, curr_service, transfertime, surgical FROM serv WHERE r = 1",
     ORDER_SQL, COHORT_SQL)
_put("latest_service_left",
     "SELECT hadm_id, icustay_id, curr_service, transfertime, surgical FROM serv_left WHERE r = 1",
     ORDER_SQL, COHORT_SQL)
_put("latest_service_per_stay", """SELECT hadm_id, icustay_id, curr_service, transfertime, surgical
  FROM (SELECT * EXCLUDE (r), rank() OVER (PARTITION BY icustay_id ORDER BY transfertime DESC NULLS FIRST) AS r FROM serv_left)
  WHERE r = 1""", ORDER_SQL, COHORT_SQL)
_put("labs_skip_null", f"""SELECT subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30, click, view, error, purchase
  FROM (SELECT DISTINCT subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30 FROM lab_pairs) LEFT JOIN (
    SELECT icustay_id, {LAB_PIVOT}
    FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id, hadm_id, icustay_id, label
            ORDER BY abs(date_diff('microsecond', intime, charttime)) ASC NULLS LAST) AS r FROM lab_pairs WHERE v IS NOT NULL)
    WHERE r = 1 GROUP BY icustay_id) USING (icustay_id)""", EVENT_SQL, EVENT_LABELS)
_put("first_row_number", """SELECT subject_id, icustay_id, intime FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY intime, icustay_id) AS rn FROM icustays)
  WHERE rn = 1""", EVENT_SQL)
_put("arg_min_rows", """SELECT icustay_id, itemid, charttime FROM (
  SELECT *, min(itemid) OVER (PARTITION BY icustay_id) AS m FROM charts) WHERE itemid = m""", ORDER_SQL)

for _name, _flag in (("mortality_flags", "mort_30"), ("mortality_flags_admission", "mort_30_admission")):
    _put(_name, f"SELECT DISTINCT icustay_id, mort_icu, mort_hosp, {_flag} AS mort_30 FROM lab_pairs",
         EVENT_SQL, EVENT_LABELS)
_put("multi_source_flag", "SELECT * FROM rrt", ORDER_SQL, FLAG_SQL)
_put("rate_query", """SELECT count(*) AS numobs, CAST(sum(rrt) AS BIGINT) AS num_hits,
  round(sum(CASE WHEN rrt = 1 THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*), 6) AS percent_hits FROM rrt""",
     ORDER_SQL, FLAG_SQL)
_put("text_value_rules", f"""SELECT itemid, value, CASE WHEN {LINE_RULE} THEN 1 ELSE 0 END AS hit, count(*) AS n
  FROM charts GROUP BY 1, 2, 3""", ORDER_SQL)
_put("distinct_hit_ids", """SELECT icustay_id, 1 AS rrt FROM intake WHERE l_linestatus = 'F' AND amount > 20
  GROUP BY icustay_id""", ORDER_SQL)
_put("union_intake_flag", "SELECT * FROM rbc", ORDER_SQL, RESULT_SQL)
_put("culture_flags", "SELECT * FROM culture", ORDER_SQL, RESULT_SQL)
_put("duration_flags", "SELECT * FROM pressor", ORDER_SQL, RESULT_SQL)
_put("first_day_max", "SELECT * FROM gas", ORDER_SQL, RESULT_SQL)

_put("phenotype_primary_secondary", "SELECT hadm_id, hm_indicator, d_type FROM kinds", ORDER_SQL, COHORT_SQL)
_put("dictionary_join_fanout", """SELECT i.hadm_id, i.icustay_id, d.icd9_code, x.short_title, 1 AS hm
  FROM icustays i JOIN diagnoses d ON i.hadm_id = d.hadm_id JOIN dictionary x ON d.icd9_code = x.icd9_code
  WHERE d.icd9_code <> 'None'
    AND substring(d.icd9_code, 1, 3) IN ('200', '201', '202', '203', '204', '205', '206', '207', '208')""", ORDER_SQL)
_put("cohort_exclusions", """SELECT * REPLACE (round(icu_length_of_stay, 6) AS icu_length_of_stay,
  round(age, 6) AS age) FROM flagged""", ORDER_SQL, COHORT_SQL)
_put("cohort_attrition", """SELECT CAST(0 AS BIGINT) AS step, 'all' AS rule, count(*) AS rows_left FROM flagged
  UNION ALL SELECT 1, 'exclusion_1st_care_unit', count(*) FROM flagged WHERE exclusion_1st_care_unit = 0
  UNION ALL SELECT 2, 'exclusion_age', count(*) FROM flagged WHERE exclusion_1st_care_unit = 0 AND exclusion_age = 0
  UNION ALL SELECT 3, 'exclusion_first_stay', count(*) FROM flagged
    WHERE exclusion_1st_care_unit = 0 AND exclusion_age = 0 AND exclusion_first_stay = 0""", ORDER_SQL, COHORT_SQL)
_put("star_features", """SELECT f.subject_id, f.hadm_id, f.icustay_id, hm_indicator, d_type, ast, alt, rrt, sofa,
  p_blood_culture_1, rbc_1, vasopressor_1, temperature, respiration, heart_rate, abg_ph, abg_lactate,
  round(age, 6) AS age, gender, round(icu_length_of_stay, 6) AS icu_length_of_stay
  FROM flagged f
  LEFT JOIN (SELECT icustay_id, max(ast) AS ast FROM liver WHERE ast IS NOT NULL GROUP BY 1) x
    ON f.icustay_id = x.icustay_id
  LEFT JOIN (SELECT icustay_id, max(alt) AS alt FROM liver WHERE alt IS NOT NULL GROUP BY 1) y
    ON f.icustay_id = y.icustay_id
  LEFT JOIN rrt ON f.icustay_id = rrt.icustay_id
  LEFT JOIN scores ON f.icustay_id = scores.icustay_id
  LEFT JOIN culture ON f.hadm_id = culture.hadm_id
  LEFT JOIN rbc ON f.icustay_id = rbc.icustay_id
  LEFT JOIN pressor ON f.icustay_id = pressor.icustay_id
  LEFT JOIN vitals ON f.icustay_id = vitals.icustay_id
  LEFT JOIN gas ON f.icustay_id = gas.icustay_id
  WHERE exclusion_1st_care_unit = 0 AND exclusion_age = 0 AND exclusion_first_stay = 0""",
     ORDER_SQL, COHORT_SQL, FLAG_SQL, CHART_SQL, RESULT_SQL)

_put("profile_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS non_null FROM docs" for c in DOC_FEATURES), DOC_SQL)
_put("distinct_ids", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT count(*) FROM (SELECT DISTINCT {c} FROM charts)) AS n_distinct"
    for c in ("icustay_id", "itemid", "error")), ORDER_SQL)
_put("frame_shape", "SELECT count(*) AS n_rows, CAST(max(len(json_keys(to_json(docs)))) AS BIGINT) AS n_columns FROM docs",
     DOC_SQL)
_put("group_sizes", "SELECT hm_indicator, count(*) AS n_rows FROM kinds GROUP BY 1", ORDER_SQL, COHORT_SQL)
_put("missing_pct", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) - count({c}) AS missing,
  round((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), 6) AS missing_pct FROM docs"""
    for c in DOC_FEATURES) + ") WHERE missing > 0", DOC_SQL)
_put("unit_convert", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS site,
  round(CASE WHEN lang = 'en' THEN n_chars * 0.001 ELSE n_chars END, 6) AS n_chars,
  round((mean_word - 32) / 1.8, 6) AS mean_word FROM docs""", DOC_SQL)
_put("recode_text", "SELECT subject_id, CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS gender FROM patients", ORDER_SQL)
_put("onehot_fill", """SELECT icustay_id, coalesce(hm_indicator, 0) AS hm_indicator,
  CASE WHEN d_type = 'leukemia' THEN 1 ELSE 0 END AS leukemia,
  CASE WHEN d_type = 'lymphoma' THEN 1 ELSE 0 END AS lymphoma,
  CASE WHEN d_type = 'myeloma' THEN 1 ELSE 0 END AS myeloma
  FROM icustays i LEFT JOIN kinds k ON i.hadm_id = k.hadm_id""", ORDER_SQL, COHORT_SQL)
_put("median_impute", "SELECT doc_id, " + ", ".join(
    f"round(coalesce({c}, (SELECT median({c}) FROM docs)), 6) AS {c}"
    for c in ("digit_share", "upper_share", "punct_share")) + " FROM docs", DOC_SQL)
_put("dropna_any", """SELECT doc_id, site, label FROM model
  WHERE digit_share IS NOT NULL AND upper_share IS NOT NULL AND punct_share IS NOT NULL""", DOC_SQL)
_put("pooled_sites", """SELECT doc_id, label, n_chars, CASE WHEN lang = 'en' THEN n_words END AS n_words, site
  FROM model""", DOC_SQL)
_put("column_quantiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, round(quantile_cont({c}, 0.25), 6) AS q0,
  round(quantile_cont({c}, 0.5), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q2 FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_tax")))
_put("head_rows", "SELECT doc_id, site, label FROM model ORDER BY doc_id LIMIT 5", DOC_SQL)

FOLD = """CASE WHEN i < (n % {k}) * (n // {k} + 1) THEN i // (n // {k} + 1)
  ELSE n % {k} + (i - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"""
DIGEST = "md5(concat(CAST(doc_id AS VARCHAR), ':{seed}'))"
_put("kfold_contiguous", f"""SELECT o_custkey, o_orderkey, {FOLD.format(k=10)} AS fold FROM (
  SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)""")
_put("kfold_hashed", f"""SELECT doc_id, {FOLD.format(k=10)} AS fold FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {DIGEST.format(seed=422)}, doc_id) - 1 AS i, count(*) OVER () AS n
  FROM documents)""")
_put("holdout_exact", f"""SELECT doc_id, CASE WHEN i < ceil(0.3 * n) THEN 1 ELSE 0 END AS is_test FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {DIGEST.format(seed=59)}, doc_id) - 1 AS i, count(*) OVER () AS n
  FROM documents)""")
_put("shuffle_rows", f"""SELECT doc_id, row_number() OVER (ORDER BY {DIGEST.format(seed=7)}, doc_id) - 1 AS row_idx
  FROM documents""")

SCORES = """
scored AS (
  SELECT l_linenumber AS fold, l_quantity AS score, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS prediction,
         CASE WHEN l_returnflag = 'R' OR l_quantity + l_discount * 300 > 45 THEN 1 ELSE 0 END AS label
  FROM lineitem
),
aucs AS (
  SELECT fold, (sum(CASE WHEN label = 1 THEN midrank ELSE 0 END) - p * (p + 1) / 2.0) / (p * (m - p)) AS auc
  FROM (SELECT fold, label, sum(label) OVER (PARTITION BY fold) AS p, count(*) OVER (PARTITION BY fold) AS m,
               rank() OVER (PARTITION BY fold ORDER BY score)
                 + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS midrank FROM scored)
  GROUP BY fold, p, m
)
"""
_put("roc_curve", """SELECT score AS threshold,
  round(CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) / sum(neg) OVER (), 6) AS fpr,
  round(CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) / sum(pos) OVER (), 6) AS tpr
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score)
  UNION ALL SELECT NULL, 0, 0""", SCORES)
_put("auc_scores", "SELECT fold, round(auc, 6) AS auc FROM aucs", SCORES)
_put("auc_hard_labels", """SELECT fold, round((avg(CASE WHEN label = 1 THEN CAST(prediction AS DOUBLE) END)
  + avg(CASE WHEN label = 0 THEN CAST(1 - prediction AS DOUBLE) END)) / 2, 6) AS auc FROM scored GROUP BY fold""",
     SCORES)
_put("accuracy_by_fold", """SELECT fold, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6)
  AS accuracy FROM scored GROUP BY fold""", SCORES)
_put("cross_validated_auc", """SELECT count(*) AS n, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std,
  round(avg(auc) - stddev_pop(auc), 6) AS low, round(avg(auc) + stddev_pop(auc), 6) AS high,
  round(max(auc), 6) AS best FROM aucs""", SCORES)

LINES = """
lines AS (
  SELECT l_quantity, l_extendedprice, CASE WHEN l_discount > 0.01 THEN l_tax END AS tax, l_returnflag, l_linenumber,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS outcome
  FROM lineitem
),
long AS (
  SELECT outcome, 'l_quantity' AS variable, l_quantity AS value FROM lines
  UNION ALL SELECT outcome, 'l_extendedprice', l_extendedprice FROM lines
  UNION ALL SELECT outcome, 'tax', tax FROM lines WHERE tax IS NOT NULL
),
cats AS (
  SELECT outcome, 'l_returnflag' AS variable, l_returnflag AS level FROM lines
  UNION ALL SELECT outcome, 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lines
  UNION ALL SELECT outcome, 'returned', CAST(returned AS VARCHAR) FROM lines
),
cells AS (SELECT variable, level, outcome, count(*) AS n FROM cats GROUP BY ALL)
"""
_put("tableone_continuous", """SELECT variable, outcome, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3
  FROM long GROUP BY variable, outcome""", LINES)
_put("tableone_categorical", """SELECT variable, level, outcome, n,
  round(n * CAST(100 AS DOUBLE) / sum(n) OVER (PARTITION BY variable, outcome), 6) AS pct
  FROM cells WHERE variable <> 'returned'""", LINES)
_put("kruskal_h", """SELECT variable,
  round((12.0 / (N * (N + 1)) * sum(R * R / m) - 3 * (N + 1)) / (1 - max(T) / (CAST(N AS DOUBLE) * N * N - N)), 4)
    AS h, CAST(count(*) - 1 AS INTEGER) AS df
  FROM (
    SELECT variable, outcome, CAST(max(tot) AS DOUBLE) AS N, sum(midrank) AS R, count(*) AS m
    FROM (SELECT variable, outcome, count(*) OVER (PARTITION BY variable) AS tot,
                 rank() OVER (PARTITION BY variable ORDER BY value)
                   + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS midrank FROM long)
    GROUP BY variable, outcome
  ) JOIN (
    SELECT variable, sum(CAST(t AS DOUBLE) * t * t - t) AS T
    FROM (SELECT variable, value, count(*) AS t FROM long GROUP BY variable, value) GROUP BY variable
  ) USING (variable)
  GROUP BY variable, N""", LINES)
_put("chi2_stat", """SELECT variable,
  round(sum(CASE WHEN k = 2 THEN (abs(n - e) - least(0.5, abs(n - e))) ^ 2 / e ELSE (n - e) ^ 2 / e END), 4) AS chi2,
  CAST(max(k) - 1 AS INTEGER) AS df, round(min(e), 4) AS min_expected
  FROM (
    SELECT variable, CAST(n AS DOUBLE) AS n, k,
           CAST(sum(n) OVER (PARTITION BY variable, level) AS DOUBLE)
             * sum(n) OVER (PARTITION BY variable, outcome) / sum(n) OVER (PARTITION BY variable) AS e
    FROM cells JOIN (SELECT variable, count(DISTINCT level) AS k FROM cells GROUP BY variable) USING (variable)
  ) GROUP BY variable""", LINES)

def _tail(x: str) -> str:
    """Probability of a chi-squared value above x, one degree of freedom: the
    series of the error function, which has eight digits where p is above 1e-8."""
    term = f"power(-1, n) * power(sqrt({x} / 2), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))"
    return f"CASE WHEN {x} > 32 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(90), lambda n: {term})) END"


_put("tableone_pvalues", f"""SELECT variable || ' (median [IQR])' AS features, round({_tail("h")}, 6) AS pval, 'Kruskal-Wallis' AS test
  FROM ({ORACLE["kruskal_h"].split(LINES)[1].replace(", 4)", ", 12)")})
  UNION ALL SELECT variable || ' (n (%))', round({_tail("chi2")}, 6), 'Chi-squared'
  FROM ({ORACLE["chi2_stat"].split(LINES)[1].replace(", 4)", ", 12)")}) WHERE variable = 'returned'""", LINES)

# --- the whole clinical pipeline over the stand-ins -----------------------------


def _item(items, by: str) -> str:
    return f"list_extract([{', '.join(map(str, items))}], CAST({by} % {len(items)} AS INTEGER) + 1)"


def _in(items) -> str:
    return "(" + ", ".join(f"'{i}'" if isinstance(i, str) else str(i) for i in items) + ")"


WARD_SQL = f"""
lines AS (
  SELECT i.subject_id, i.hadm_id, i.icustay_id, i.intime, l.* FROM lineitem l JOIN icustays i
    ON l.l_orderkey = i.icustay_id
),
diagnoses_icd AS (
  SELECT hadm_id, seq_num, CASE WHEN icd9_code = '2387' THEN icd9_code || seq_num ELSE icd9_code END AS icd9_code
  FROM diagnoses
),
admissions AS (
  SELECT o_custkey AS subject_id, o_custkey * 10 + (year(o_orderdate) - 1995) AS hadm_id,
         min(o_orderdate) AS admittime, max(o_orderdate) + INTERVAL 200 HOUR AS dischtime,
         min(CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 HOUR END)
           AS deathtime
  FROM orders GROUP BY 1, 2
),
labevents AS (
  SELECT subject_id, hadm_id, {_item(LAB_ITEMS, "l_partkey")} AS itemid,
         intime + to_hours(CAST((l_suppkey * 7 + l_linenumber * 5) % 73 - 36 AS BIGINT)) AS charttime,
         l_extendedprice / 500 AS valuenum
  FROM lines
),
chartevents AS (
  SELECT subject_id, hadm_id, icustay_id, {_item(CHART_ITEMS, "l_partkey")} AS itemid,
         intime + to_hours(CAST(l_suppkey % 97 - 48 AS BIGINT)) AS charttime,
         CASE l_returnflag WHEN 'R' THEN 'Dialysis Line' WHEN 'A' THEN 'Other' END AS value,
         l_quantity - 5 AS valuenum,
         CASE WHEN l_discount >= 0.08 THEN 1 WHEN l_discount >= 0.03 THEN 0 END AS error
  FROM lines
),
inputevents_mv AS (
  SELECT icustay_id, {_item((225168, 226368, 225170, 226369, 227536), "l_linenumber")} AS itemid,
         l_quantity - 25 AS amount FROM lines WHERE l_linestatus = 'O'
),
inputevents_cv AS (
  SELECT icustay_id, {_item((30001, 30104, 30006, 40788, 40907), "l_linenumber")} AS itemid,
         l_quantity - 45 AS amount FROM lines WHERE l_linestatus = 'F'
),
outputevents AS (
  SELECT icustay_id, {_item((40386, 40425, 1), "l_partkey")} AS itemid, l_quantity - 48 AS value
  FROM lines WHERE l_returnflag = 'R'
),
datetimeevents AS (
  SELECT icustay_id, {_item((225318, 225128, 1, 2), "l_partkey")} AS itemid
  FROM lines WHERE l_returnflag = 'R' AND l_tax >= 0.08
),
procedureevents_mv AS (
  SELECT icustay_id, {_item((225441, 1, 2), "l_partkey")} AS itemid
  FROM lines WHERE l_linestatus = 'F' AND l_discount >= 0.1
),
microbiologyevents AS (
  SELECT hadm_id, CASE WHEN l_returnflag = 'R' THEN 'BLOOD CULTURE' ELSE 'URINE' END AS spec_type_desc,
         CASE WHEN l_quantity > 20 THEN l_partkey END AS org_itemid,
         CASE WHEN l_discount > 0.04 THEN l_suppkey END AS ab_itemid FROM lines
),
vent AS (
  SELECT l_orderkey AS icustay_id, max(CASE WHEN l_tax * 100 - 4 > 0 THEN 1 ELSE 0 END) AS ventilation_1
  FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1
),
elixhauser AS (
  SELECT o_custkey * 10 + (year(o_orderdate) - 1995) AS hadm_id,
         {", ".join(f"max(CASE WHEN o_orderkey % {d} = 0 THEN 1 ELSE 0 END) AS {n}"
                    for n, d in COMORBIDITY_DIVISORS.items())}
  FROM orders GROUP BY 1
)
"""

RULES_SQL = " OR ".join(
    f"itemid IN {_in(items)} AND " + ("value IS NOT NULL" if texts is None else f"value IN {_in(texts)}")
    for items, texts in codes.RRT_TEXT_RULES
)
RENAL_SQL = f"""
renal_hits AS (
  SELECT c.icustay_id FROM chartevents c JOIN icustays i ON c.icustay_id = i.icustay_id
  WHERE i.dbsource = 'carevue' AND error IS DISTINCT FROM 1 AND ({RULES_SQL})
  UNION ALL SELECT icustay_id FROM inputevents_cv WHERE itemid IN {_in(codes.RRT_INTAKE_OLD)} AND amount > 0
  UNION ALL SELECT icustay_id FROM outputevents WHERE itemid IN {_in(codes.RRT_OUTPUT_OLD)} AND value > 0
  UNION ALL SELECT icustay_id FROM chartevents
    WHERE itemid IN {_in(codes.RRT_CHART_NEW)} AND valuenum > 0 AND error IS DISTINCT FROM 1
  UNION ALL SELECT icustay_id FROM inputevents_mv WHERE itemid IN {_in(codes.RRT_INTAKE_NEW)} AND amount > 0
  UNION ALL SELECT icustay_id FROM datetimeevents WHERE itemid IN {_in(codes.RRT_DATES_NEW)}
  UNION ALL SELECT icustay_id FROM procedureevents_mv WHERE itemid IN {_in(codes.RRT_PROCEDURES_NEW)}
),
renal AS (
  SELECT subject_id, hadm_id, icustay_id,
         CASE WHEN icustay_id IN (SELECT icustay_id FROM renal_hits) THEN 1 ELSE 0 END AS rrt
  FROM icustays
)
"""


def _lab_pivot() -> str:
    names = dict.fromkeys(label for label, _ in codes.LAB_CODES.values())
    return ", ".join(f"max(CASE WHEN label = '{n}' THEN v END) AS {n}" for n in names)


def _chart_pivot(groups) -> str:
    return ", ".join(f"max(CASE WHEN itemid IN {_in(i)} THEN valuenum END) AS {n}" for n, i in groups.items())


LABEL_CASE = " ".join(f"WHEN {c} THEN '{label}'" for c, (label, _) in codes.LAB_CODES.items())
CAP_CASE = " ".join(f"WHEN {c} THEN {cap}" for c, (_, cap) in codes.LAB_CODES.items())
WARD_LABS = f"""
ward_pairs AS (
  SELECT i.subject_id, i.hadm_id, i.icustay_id, i.intime, a.admittime, l.charttime,
         CASE WHEN a.deathtime BETWEEN i.intime AND i.outtime THEN 1 ELSE 0 END AS mort_icu,
         CASE WHEN a.deathtime BETWEEN a.admittime AND a.dischtime THEN 1 ELSE 0 END AS mort_hosp,
         CASE WHEN a.deathtime BETWEEN i.intime AND i.intime + INTERVAL 30 DAY THEN 1 ELSE 0 END AS mort_30,
         CASE WHEN a.deathtime BETWEEN a.admittime AND a.admittime + INTERVAL 30 DAY THEN 1 ELSE 0 END
           AS mort_30_admission,
         CASE l.itemid {LABEL_CASE} END AS label,
         CASE WHEN l.valuenum <= CASE l.itemid {CAP_CASE} END THEN l.valuenum END AS v
  FROM icustays i
  LEFT JOIN labevents l ON l.subject_id = i.subject_id AND l.hadm_id = i.hadm_id AND l.valuenum > 0
    AND l.charttime BETWEEN i.intime - INTERVAL 24 HOUR AND i.intime + INTERVAL 24 HOUR
  LEFT JOIN admissions a ON a.subject_id = i.subject_id AND a.hadm_id = i.hadm_id
),
ward_labs AS (
  SELECT subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30, {_lab_pivot()}
  FROM (SELECT *, dense_rank() OVER (PARTITION BY icustay_id, label
          ORDER BY abs(date_diff('microsecond', intime, charttime)) ASC NULLS LAST) AS r FROM ward_pairs)
  WHERE r = 1 GROUP BY subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30
),
ward_labs_long AS (
  SELECT r AS lab_test_rank, subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30_admission AS mort_30,
         charttime, {_lab_pivot()}
  FROM (SELECT *, dense_rank() OVER (PARTITION BY icustay_id, label
          ORDER BY abs(date_diff('microsecond', admittime, charttime)) ASC NULLS LAST) AS r FROM ward_pairs)
  WHERE r = 1 GROUP BY r, subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30_admission, charttime
),
ward_charts AS (
  SELECT icustay_id, {_chart_pivot(VITALS)}, {_chart_pivot(ENZYMES)}
  FROM (SELECT c.*, dense_rank() OVER (PARTITION BY c.icustay_id, c.itemid
          ORDER BY abs(date_diff('microsecond', i.intime, c.charttime)) ASC NULLS LAST) AS r
        FROM chartevents c JOIN icustays i ON c.icustay_id = i.icustay_id)
  WHERE r = 1 GROUP BY icustay_id
)
"""

WARD_COHORT = f"""
ward_typed AS (
  SELECT hadm_id, CASE WHEN seq_num = 1 THEN 1 ELSE 2 END AS i,
         CASE {" ".join(
             "WHEN " + " OR ".join(
                 ([f"substring(icd9_code, 1, 3) IN {_in(p)}"] if p else [])
                 + ([f"icd9_code IN {_in(w)}"] if w else [])) + f" THEN '{n}'"
             for n, (p, w) in MALIGNANCIES.items())} END AS t
  FROM diagnoses_icd
),
ward_kinds AS (
  SELECT hadm_id, i AS hm_indicator, max(t) AS d_type FROM ward_typed x
  WHERE t IS NOT NULL AND i = (SELECT min(i) FROM ward_typed y WHERE y.hadm_id = x.hadm_id AND y.t IS NOT NULL)
  GROUP BY hadm_id, i
),
ward_coded AS (
  SELECT d.hadm_id, d.icd9_code, x.short_title, x.long_title
  FROM diagnoses_icd d JOIN dictionary x ON d.icd9_code = x.icd9_code
  WHERE d.icd9_code <> 'None'
    AND substring(d.icd9_code, 1, 3) IN ('200', '201', '202', '203', '204', '205', '206', '207', '208')
),
treatments AS (
  SELECT i.icustay_id, sofa, p_blood_culture_1, rbc_1, platelet_1, vasopressor_1, ventilation_1
  FROM icustays i
  LEFT JOIN scores ON i.icustay_id = scores.icustay_id
  LEFT JOIN (
    SELECT hadm_id, max(CASE WHEN org_itemid IS NULL AND ab_itemid IS NULL THEN 1 ELSE 0 END) AS p_blood_culture_1
    FROM microbiologyevents WHERE spec_type_desc = 'BLOOD CULTURE' GROUP BY 1) b ON i.hadm_id = b.hadm_id
  LEFT JOIN (
    SELECT icustay_id, 1 AS rbc_1 FROM (
      SELECT icustay_id FROM inputevents_mv WHERE itemid IN (225168, 226368) AND amount > 0
      UNION SELECT icustay_id FROM inputevents_cv WHERE itemid IN (30001, 30104) AND amount > 0)) r
    ON i.icustay_id = r.icustay_id
  LEFT JOIN (
    SELECT icustay_id, 1 AS platelet_1 FROM (
      SELECT icustay_id FROM inputevents_mv WHERE itemid IN (225170, 226369) AND amount > 0
      UNION SELECT icustay_id FROM inputevents_cv WHERE itemid IN (30006) AND amount > 0)) p
    ON i.icustay_id = p.icustay_id
  LEFT JOIN pressor ON i.icustay_id = pressor.icustay_id
  LEFT JOIN vent ON i.icustay_id = vent.icustay_id
)
"""
WARD = (ORDER_SQL, WARD_SQL, RENAL_SQL, WARD_LABS, COHORT_SQL, RESULT_SQL, WARD_COHORT)
_labels = ", ".join(f"l.{n}" for n in dict.fromkeys(label for label, _ in codes.LAB_CODES.values()))

_put("renal_replacement", "SELECT * FROM renal", ORDER_SQL, WARD_SQL, RENAL_SQL)
_put("renal_replacement_rate", """SELECT count(*) AS numobs, CAST(sum(rrt) AS BIGINT) AS num_hits,
  round(sum(rrt) * CAST(100 AS DOUBLE) / count(*), 6) AS percent_hits FROM (
    SELECT r.rrt, row_number() OVER (PARTITION BY i.subject_id ORDER BY i.intime, i.icustay_id) AS rn
    FROM renal r JOIN icustays i ON r.icustay_id = i.icustay_id
    JOIN patients p ON i.subject_id = p.subject_id AND p.dob < i.intime - INTERVAL 1 YEAR
    JOIN admissions a ON r.hadm_id = a.hadm_id) WHERE rn = 1""", ORDER_SQL, WARD_SQL, RENAL_SQL)
_put("final_cohort", f"""SELECT c.subject_id, c.hadm_id, c.icustay_id, l.mort_icu, l.mort_hosp, l.mort_30, {_labels},
  ast, alt, rrt, sofa, p_blood_culture_1, rbc_1, platelet_1, vasopressor_1, ventilation_1,
  heart_rate, respiration, arterial_bp_mean, arterial_bp_systolic, arterial_bp_diastolic, temperature,
  abg_ph, abg_pco2, abg_po2, abg_bicarbonate, abg_baseexcess, abg_spo2, abg_lactate,
  {", ".join(codes.COMORBIDITIES)},
  round(age, 6) AS age, gender, round(icu_length_of_stay, 6) AS icu_length_of_stay, hm_indicator, d_type
  FROM co c JOIN serv s ON c.icustay_id = s.icustay_id AND s.r = 1 JOIN ward_kinds k ON c.hadm_id = k.hadm_id
  LEFT JOIN ward_labs l ON c.icustay_id = l.icustay_id
  LEFT JOIN ward_charts w ON c.icustay_id = w.icustay_id
  LEFT JOIN renal ON c.icustay_id = renal.icustay_id
  LEFT JOIN treatments t ON c.icustay_id = t.icustay_id
  LEFT JOIN gas ON c.icustay_id = gas.icustay_id
  LEFT JOIN elixhauser e ON c.hadm_id = e.hadm_id
  WHERE first_careunit = 'MICU' AND NOT age < 16 AND icustay_id_order = 1""", *WARD)
_put("view_cohort", """SELECT c.subject_id, c.hadm_id, c.icustay_id, ast, alt, rrt, sofa, p_blood_culture_1,
  rbc_1 AS rcb_1, platelet_1, vasopressor_1, ventilation_1, round(age, 6) AS age, gender,
  round(icu_length_of_stay, 6) AS icu_length_of_stay, d.icd9_code
  FROM co c JOIN serv_left s ON c.icustay_id = s.icustay_id AND s.r = 1 JOIN ward_coded d ON c.hadm_id = d.hadm_id
  LEFT JOIN ward_charts w ON c.icustay_id = w.icustay_id
  LEFT JOIN renal ON c.icustay_id = renal.icustay_id
  LEFT JOIN treatments t ON c.icustay_id = t.icustay_id
  WHERE first_careunit = 'MICU' AND NOT icu_length_of_stay < 1 AND NOT age < 1 AND s.surgical = 0""", *WARD)
_put("long_cohort", f"""SELECT lab_test_rank, l.subject_id, l.hadm_id, l.icustay_id, l.mort_icu, l.mort_hosp,
  l.mort_30, l.charttime, {_labels}, round(age, 6) AS age, gender, icustay_id_order,
  round(icu_length_of_stay, 6) AS icu_length_of_stay, d.icd9_code, d.short_title AS icd9_name,
  d.long_title AS icd9_descr,
  CASE WHEN first_careunit = 'MICU' THEN 0 ELSE 1 END AS exclusion_1st_care_unit,
  CASE WHEN icu_length_of_stay < 2 THEN 1 ELSE 0 END AS exclusion_los,
  CASE WHEN age < 16 THEN 1 ELSE 0 END AS exclusion_age,
  CASE WHEN icustay_id_order <> 1 THEN 1 ELSE 0 END AS exclusion_first_stay,
  CASE WHEN s.surgical = 1 THEN 1 ELSE 0 END AS exclusion_surgical
  FROM co c JOIN serv_left s ON c.icustay_id = s.icustay_id AND s.r = 1 JOIN ward_coded d ON c.hadm_id = d.hadm_id
  JOIN ward_labs_long l ON c.icustay_id = l.icustay_id""", *WARD)

# --- models on one 0/1 column: the optimum in closed form ---------------------------

LOUD_SQL = DOC_SQL + """,
flagged AS (
  SELECT doc_id, site, label, CASE WHEN upper_share > 0.1 THEN 1 ELSE 0 END AS loud FROM model
)
"""


def _rates(source: str, by: str = "") -> str:
    """CTEs ``rates``: the fitted rate of either flag value.  With one penalised
    0/1 column the optimum moves one case across, or drops the column."""
    group, keep = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""
counts AS (
  SELECT {keep}CAST(count(*) FILTER (loud = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (loud = 0) AS DOUBLE) AS n0,
         CAST(count(*) FILTER (loud = 1 AND label = 1) AS DOUBLE) AS p1,
         CAST(count(*) FILTER (loud = 0 AND label = 1) AS DOUBLE) AS p0
  FROM {source} {group}
),
moved AS (
  SELECT *, sign(p1 / n1 - p0 / n0) AS s FROM counts
),
rates AS (
  SELECT {keep}CASE WHEN s * ((p1 - s) / n1 - (p0 + s) / n0) > 0 THEN (p1 - s) / n1 ELSE (p1 + p0) / (n1 + n0) END AS r1,
         CASE WHEN s * ((p1 - s) / n1 - (p0 + s) / n0) > 0 THEN (p0 + s) / n0 ELSE (p1 + p0) / (n1 + n0) END AS r0
  FROM moved
)
"""


_put("l1_flag_odds", """SELECT 'loud' AS feature, round(ln(r0 / (1 - r0)), 3) AS intercept,
  round(ln(r1 / (1 - r1)) - ln(r0 / (1 - r0)), 3) AS coefficient,
  round(r1 / (1 - r1) * (1 - r0) / r0, 3) AS odds_ratio FROM rates""", LOUD_SQL, _rates("flagged"))

FOLDED_SQL = f"""
folded AS (
  SELECT *, {FOLD.format(k=10)} AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM flagged)
),
train AS (
  SELECT f.fold AS held, folded.label, folded.loud
  FROM folded JOIN (SELECT DISTINCT fold FROM folded) f ON folded.fold <> f.fold
)
"""
_put("l1_flag_cv_accuracy", """SELECT round(avg(a), 6) AS mean, round(2 * stddev_pop(a), 6) AS two_std FROM (
  SELECT avg(CASE WHEN label = CASE WHEN CASE loud WHEN 1 THEN r1 ELSE r0 END > 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) AS a
  FROM folded JOIN rates ON fold = held GROUP BY fold)""", LOUD_SQL, FOLDED_SQL, _rates("train", "held"))

AUC_OF_FLAG = """0.5 + sign({score}) * (
    count(*) FILTER (label = 1 AND loud = 1) / nullif(CAST(count(*) FILTER (label = 1) AS DOUBLE), 0)
  - count(*) FILTER (label = 0 AND loud = 1) / nullif(CAST(count(*) FILTER (label = 0) AS DOUBLE), 0)) / 2"""
_SITE_A = _rates("(SELECT * FROM flagged WHERE site = 'A')")
_put("l1_flag_external", f"""SELECT round({AUC_OF_FLAG.format(score="any_value(r1 - r0)")}, 6) AS auc
  FROM flagged, rates WHERE site = 'B'""", LOUD_SQL, _SITE_A)
_put("l1_flag_repeated_external", f"""SELECT count(auc) AS n, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std,
  round(avg(auc) - stddev_pop(auc), 6) AS low, round(avg(auc) + stddev_pop(auc), 6) AS high, round(max(auc), 6) AS best
  FROM (SELECT seed, {AUC_OF_FLAG.format(score="any_value(r1 - r0)")} AS auc FROM (
    SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':', seed)), doc_id) AS i,
           count(*) OVER (PARTITION BY seed) AS n
    FROM (SELECT *, unnest(range(1, 100)) AS seed FROM flagged WHERE site = 'B')), rates
  WHERE i <= ceil(0.2 * n) GROUP BY seed)""", LOUD_SQL, _SITE_A)
_put("holdout_sizes", """SELECT seed, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive FROM (
    SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':', seed)), doc_id) AS i,
           count(*) OVER (PARTITION BY seed) AS n
    FROM (SELECT *, unnest(range(1, 100)) AS seed FROM flagged))
  WHERE i <= ceil(0.3 * n) GROUP BY seed""", LOUD_SQL)
_put("fold_sizes", f"""SELECT seed, fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive FROM (
  SELECT *, {FOLD.format(k=10)} AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':', seed)), doc_id) - 1 AS i,
           count(*) OVER (PARTITION BY seed) AS n
    FROM (SELECT *, unnest(range(300, 303)) AS seed FROM flagged))) GROUP BY seed, fold""", LOUD_SQL)


def _boosted(where: str) -> str:
    """CTE ``boosted``: 20 one-split trees.  The first tree predicts the mean of
    the labels as +1 and -1, every later one a tenth of the mean gradient."""
    step = "{f} + 0.1 * (p{x} / n{x} * 4 / (1 + exp(2 * {f})) - (1 - p{x} / n{x}) * 4 / (1 + exp(-2 * {f})))"
    f = {x: (f"2 * p{x} / n{x} - 1") for x in (0, 1)}
    parts = [f"""
tree1 AS (
  SELECT n0, p0, n1, p1, {f[0]} AS f0, {f[1]} AS f1 FROM (
    SELECT CAST(count(*) FILTER (loud = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (loud = 0) AS DOUBLE) AS n0,
           CAST(count(*) FILTER (loud = 1 AND label = 1) AS DOUBLE) AS p1,
           CAST(count(*) FILTER (loud = 0 AND label = 1) AS DOUBLE) AS p0
    FROM flagged WHERE {where})
)"""]
    for i in range(2, 21):
        now = ", ".join(f"{step.format(f=f'f{x}', x=x)} AS f{x}" for x in (0, 1))
        parts.append(f"tree{i} AS (SELECT n0, p0, n1, p1, {now} FROM tree{i - 1})")
    return ",\n".join(parts)


_put("gbt_flag_scores", """SELECT 0 AS loud, round(f0, 5) AS score FROM tree20
  UNION ALL SELECT 1 AS loud, round(f1, 5) AS score FROM tree20""", LOUD_SQL, _boosted("true"))
_put("gbt_flag_splits", """SELECT 'loud' AS feature, CAST(20 AS BIGINT) AS n_splits, 1.0::DOUBLE AS gain
  FROM tree20 WHERE f0 <> f1""", LOUD_SQL, _boosted("true"))
_put("gbt_flag_external", f"""SELECT round({AUC_OF_FLAG.format(score="any_value(f1 - f0)")}, 6) AS auc
  FROM flagged, tree20 WHERE site = 'B'""", LOUD_SQL, _boosted("site = 'A'"))

# --- second-order trees on flags, step by step -------------------------------------------


def _shrunk(g: str, alpha: float) -> str:
    return f"(sign({g}) * greatest(abs({g}) - {alpha}, 0))"


def _newton_steps(trees: int, rate: float, alpha: float, weight: float, least: float, reg: float = 1.0) -> str:
    """CTE ``grown``: (…, f0, f1) after ``trees`` one-split trees over ``train``
    (…, n0, p0, n1, p1), the counts of rows and positives per flag value."""
    parts = ["s0 AS (SELECT *, 0.0::DOUBLE AS f0, 0.0::DOUBLE AS f1 FROM train)"]
    for i in range(1, trees + 1):
        sums = ", ".join(
            f"(n{x} - p{x}) / (1 + exp(-f{x})) - {weight} * p{x} / (1 + exp(f{x})) AS g{x}, "
            f"(n{x} - p{x} + {weight} * p{x}) / (1 + exp(-f{x})) / (1 + exp(f{x})) AS h{x}" for x in (0, 1))
        score = [f"power({_shrunk(g, alpha)}, 2) / ({h} + {reg})" for g, h in (("g0", "h0"), ("g1", "h1"), ("(g0 + g1)", "h0 + h1"))]
        step = ", ".join(
            f"f{x} - {rate} * CASE WHEN splits THEN {_shrunk(f'g{x}', alpha)} / (h{x} + {reg}) "
            f"ELSE {_shrunk('(g0 + g1)', alpha)} / (h0 + h1 + {reg}) END AS f{x}" for x in (0, 1))
        parts.append(f"""s{i} AS (SELECT * EXCLUDE (g0, h0, g1, h1, splits, f0, f1), {step} FROM (
  SELECT *, {score[0]} + {score[1]} - {score[2]} > 1e-6 AND h0 >= {least} AND h1 >= {least} AS splits
  FROM (SELECT *, {sums} FROM s{i - 1})))""")
    return ",\n".join([*parts, f"grown AS (SELECT * FROM s{trees})"])


def _seeded(seeds: str, fold: str) -> str:
    """CTEs ``seeded`` (seed, fold, loud, label) and ``train``, the counts of the
    rows outside each fold."""
    return f"""
seeded AS (
  SELECT seed, {fold} AS fold, loud, label FROM (
    SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':', seed)), doc_id) - 1 AS i,
           count(*) OVER (PARTITION BY seed) AS n
    FROM (SELECT *, unnest({seeds}) AS seed FROM flagged))
),
train AS (
  SELECT seed, fold, CAST(sum(a1) OVER w - a1 AS DOUBLE) AS n1, CAST(sum(a0) OVER w - a0 AS DOUBLE) AS n0,
         CAST(sum(b1) OVER w - b1 AS DOUBLE) AS p1, CAST(sum(b0) OVER w - b0 AS DOUBLE) AS p0
  FROM (SELECT seed, fold, count(*) FILTER (loud = 1) AS a1, count(*) FILTER (loud = 0) AS a0,
               count(*) FILTER (loud = 1 AND label = 1) AS b1, count(*) FILTER (loud = 0 AND label = 1) AS b0
        FROM seeded GROUP BY seed, fold)
  WINDOW w AS (PARTITION BY seed)
)"""


_FLAG_STEPS = _newton_steps(20, 0.1, 0.01, 1.0, 4.0)
_FOLD_AUC = f"""SELECT seed, fold, {AUC_OF_FLAG.format(score="any_value(f1 - f0)")} AS auc
  FROM seeded JOIN grown USING (seed, fold) GROUP BY seed, fold"""
_SUMMARY = """SELECT count(auc) AS n, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std,
  round(avg(auc) - stddev_pop(auc), 6) AS low, round(avg(auc) + stddev_pop(auc), 6) AS high, round(max(auc), 6) AS best"""
_put("boost_flag_holdout", f"""{_SUMMARY} FROM (
  SELECT seed, (avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (label = 1) + avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (label = 0)) / 2 AS auc
  FROM (SELECT seed, label, (CASE loud WHEN 1 THEN f1 ELSE f0 END > 0) = (label = 1) AS hit FROM seeded JOIN grown USING (seed, fold)
        WHERE fold = 0) GROUP BY seed)""",
     LOUD_SQL, _seeded("range(1, 100)", "CASE WHEN i < ceil(0.3 * n) THEN 0 ELSE 1 END"), _FLAG_STEPS)
_put("boost_flag_repeated_cv", f"{_SUMMARY} FROM (SELECT seed, avg(auc) AS auc FROM ({_FOLD_AUC}) GROUP BY seed)",
     LOUD_SQL, _seeded("range(100, 200)", FOLD.format(k=10)), _FLAG_STEPS)
_put("boost_flag_sweep", f"""SELECT seed, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std,
  round(avg(auc) - stddev_pop(auc), 6) AS lower FROM ({_FOLD_AUC}) GROUP BY seed""",
     LOUD_SQL, _seeded("range(300, 500)", FOLD.format(k=10)), _FLAG_STEPS)
_ONE_SEED = f"""
seeded AS (SELECT 0 AS seed, fold, loud, label FROM (
  SELECT *, {FOLD.format(k=10)} AS fold FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM flagged))),
train AS""" + _seeded("[0]", "0").split("train AS")[1]
_put("pooled_flag_cv", f"""SELECT fold, round({AUC_OF_FLAG.format(score="any_value(f1 - f0)")}, 6) AS auc,
  round(avg(CASE loud WHEN 1 THEN f1 ELSE f0 END), 6) AS score
  FROM seeded JOIN grown USING (seed, fold) GROUP BY fold""",
     LOUD_SQL, _ONE_SEED, _newton_steps(20, 0.1, 0.0, 3.0, 1.0))


def _two_levels(rate: float, gamma: float, alpha: float, reg: float) -> str:
    """CTE ``tree``: the nodes of one tree of depth two on three flags.  A split
    sends 0 left and 1 right, and missing values to either side, or the missing
    values alone to the right."""

    def score(g: str, h: str) -> str:
        return f"power({_shrunk(g, alpha)}, 2) / ({h} + {reg})"

    def level(k: int) -> str:
        side = "CASE WHEN kind = 2 THEN v IS NULL WHEN v IS NULL THEN kind = 1 ELSE v = 1 END"
        return f"""
long{k} AS (SELECT node, f, [filled, taxed, many][f + 1] AS v, g, h FROM r{k}, (SELECT unnest(range(3)) AS f)),
cell{k} AS (
  SELECT node, f, {", ".join(f"coalesce(sum({x}) FILTER (v = 0), 0) AS {x}0, coalesce(sum({x}) FILTER (v = 1), 0) AS {x}1, "
                             f"coalesce(sum({x}) FILTER (v IS NULL), 0) AS {x}m" for x in "gh")}
  FROM long{k} GROUP BY node, f
),
cand{k} AS (
  SELECT node, f, 0 AS kind, g0 + gm AS gl, h0 + hm AS hl, g1 AS gr, h1 AS hr FROM cell{k}
  UNION ALL SELECT node, f, 1, g0, h0, g1 + gm, h1 + hm FROM cell{k}
  UNION ALL SELECT node, f, 2, g0 + g1, h0 + h1, gm, hm FROM cell{k}
),
best{k} AS (
  SELECT *, {score("gl", "hl")} + {score("gr", "hr")} - {score("(gl + gr)", "hl + hr")} AS gain FROM cand{k}
  WHERE hl >= 1 AND hr >= 1 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, kind) = 1 AND gain > 1e-6
),
r{k + 1} AS (
  SELECT r.* EXCLUDE (node), r.node AS parent, CASE WHEN b.node IS NULL THEN NULL
           ELSE 2 * r.node + 1 + CAST(CASE f WHEN 0 THEN {side.replace(" v", " filled")} WHEN 1 THEN {side.replace(" v", " taxed")}
           ELSE {side.replace(" v", " many")} END AS INTEGER) END AS node
  FROM (SELECT * FROM r{k} WHERE node IS NOT NULL) r LEFT JOIN best{k} b USING (node)
)"""

    first = level(0).replace("r.* EXCLUDE (node), r.node AS parent", "r.* EXCLUDE (node)")
    second = level(1).replace("r.* EXCLUDE (node), r.node AS parent", "r.* EXCLUDE (node)")
    return f"""
three AS (
  SELECT l_orderkey * 8 + l_linenumber AS line_id, CAST(l_returnflag = 'R' AS INTEGER) AS label,
         CAST(l_linestatus = 'F' AS INTEGER) AS filled, CASE WHEN l_discount > 0 THEN CAST(l_tax > 0.04 AS INTEGER) END AS taxed,
         CAST(l_quantity > 25 AS INTEGER) AS many FROM lineitem
),
r0 AS (SELECT *, 0 AS node, 0.5 - label AS g, 0.25 AS h FROM three),{first},{second},
places AS (SELECT node, g, h FROM r0 UNION ALL SELECT node, g, h FROM r1 UNION ALL SELECT node, g, h FROM r2),
sums AS (SELECT node, sum(g) AS g, sum(h) AS h FROM places WHERE node IS NOT NULL GROUP BY node),
splits AS (SELECT node, f, kind, gain FROM best0 UNION ALL SELECT node, f, kind, gain FROM best1),
low AS (SELECT * FROM splits WHERE node = 0 OR gain >= {gamma}),
held AS (SELECT * FROM low WHERE node > 0 OR gain >= {gamma} OR (SELECT count(*) FROM low WHERE node > 0) > 0),
tree AS (
  SELECT s.node, CASE h.f WHEN 0 THEN 'filled' WHEN 1 THEN 'taxed' WHEN 2 THEN 'many' END AS feature, h.kind, h.gain, s.h AS cover,
         CASE WHEN h.node IS NULL THEN -{rate} * {_shrunk("s.g", alpha)} / (s.h + {reg}) ELSE 0 END AS value
  FROM sums s LEFT JOIN held h USING (node)
  WHERE s.node = 0 OR (s.node - 1) // 2 IN (SELECT node FROM held)
)"""


_NODES = """SELECT node, feature, coalesce(kind = 0, false) AS missing_left, round(coalesce(gain, 0), 6) AS gain, round(cover, 6) AS cover,
  round(value, 6) AS value FROM tree"""
_put("boost_two_level_nodes", _NODES, _two_levels(0.3, 0.0, 0.0, 1.0))
_put("boost_pruned_nodes", _NODES, _two_levels(0.3, 1.0, 0.01, 1.0))
_put("boost_two_level_importance", """SELECT name AS feature, n_splits, round(g / sum(g) OVER (), 6) AS gain,
  CAST(row_number() OVER (ORDER BY n_splits, name) AS INTEGER) AS place
  FROM (SELECT name, count(feature) AS n_splits, coalesce(sum(gain), 0) AS g
        FROM (SELECT unnest(['filled', 'taxed', 'many']) AS name) LEFT JOIN tree ON feature = name GROUP BY name)""",
     _two_levels(0.3, 0.0, 0.0, 1.0))
_put("boost_two_level_scores", """SELECT DISTINCT filled, taxed, many, round(value, 6) AS score FROM (
    SELECT filled, taxed, many, node FROM r0 UNION ALL SELECT filled, taxed, many, node FROM r1
    UNION ALL SELECT filled, taxed, many, node FROM r2)
  JOIN tree USING (node) WHERE feature IS NULL""", _two_levels(0.3, 0.0, 0.0, 1.0))


def _bias_rates(source: str, by: str = "") -> str:
    """CTE ``fitted`` (…, b, w): intercept and coefficient on one flag, both
    penalised.  Where a coefficient is not zero its gradient is its sign, so
    each pair of signs gives rates; the one pair that they agree with is it."""
    keep = f"{by}, " if by else ""
    counts = _rates(source, by).split("moved AS")[0].rstrip().rstrip(",")
    return counts + f""",
pairs AS (SELECT *, unnest([-1, 0, 1]) AS sb FROM counts),
signs AS (SELECT *, unnest([-1, 0, 1]) AS sw FROM pairs),
tried AS (
  SELECT *, CASE WHEN sb = 0 THEN 0.5 WHEN sw = 0 THEN (p0 + p1 - sb) / (n0 + n1) ELSE (p0 - sb + sw) / n0 END AS r0,
         CASE WHEN sw <> 0 THEN (p1 - sw) / n1 WHEN sb = 0 THEN 0.5 ELSE (p0 + p1 - sb) / (n0 + n1) END AS r1
  FROM signs
),
fitted AS (
  SELECT {keep}ln(r0 / (1 - r0)) AS b, ln(r1 / (1 - r1)) - ln(r0 / (1 - r0)) AS w
  FROM (SELECT * FROM tried WHERE r0 > 0 AND r0 < 1 AND r1 > 0 AND r1 < 1)
  WHERE sign(round(ln(r0 / (1 - r0)), 12)) = sb AND sign(round(ln(r1 / (1 - r1)) - ln(r0 / (1 - r0)), 12)) = sw
    AND abs(n0 * r0 + n1 * r1 - p0 - p1) <= 1 + 1e-9 AND abs(n1 * r1 - p1) <= 1 + 1e-9
)"""


_put("l1_bias_flag_odds", """SELECT 'loud' AS feature, round(b, 6) AS intercept, round(w, 6) AS coefficient,
  round(exp(w), 6) AS odds_ratio FROM fitted""", LOUD_SQL, _bias_rates("flagged"))
_put("l1_bias_flag_folds", """SELECT fold, round(any_value(b), 6) AS intercept, round(any_value(w), 6) AS coefficient,
  round(avg(CASE WHEN (b + w * loud > 0) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
  FROM folded JOIN fitted ON fold = held GROUP BY fold""", LOUD_SQL, FOLDED_SQL, _bias_rates("train", "held"))

_SITE_TABLE = """
sites AS (
  SELECT site, count(*) FILTER (loud = 0 AND label = 0) AS a, count(*) FILTER (loud = 0 AND label = 1) AS b,
         count(*) FILTER (loud = 1 AND label = 0) AS c, count(*) FILTER (loud = 1 AND label = 1) AS d, count(*) AS n
  FROM flagged GROUP BY site
),
tests AS (
  SELECT *, least(a + b, c + d) * least(a + c, b + d) / CAST(n AS DOUBLE) AS small,
         n * power(greatest(abs(a * d - b * c) - n / 2, 0), 2) / nullif(CAST((a + b) * (c + d) AS DOUBLE) * (a + c) * (b + d), 0) AS chi2
  FROM sites
),
choices AS (
  SELECT site, small, chi2, x = a AS own,
         lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(n + 1)
           - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp
  FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM tests)
),
"""
_put("odds_pvalue_flag", f"""SELECT 'loud' AS feature, round(exp(w), 6) AS odds_ratio, round(a.p, 6) AS pval_a, round(b.p, 6) AS pval_b
  FROM fitted LEFT JOIN exact a ON a.site = 'A' LEFT JOIN exact b ON b.site = 'B'""", LOUD_SQL, _bias_rates("flagged"),
     _SITE_TABLE + f"""exact AS (
  SELECT site, CASE WHEN any_value(small) = 0 THEN NULL WHEN any_value(small) < 5 THEN least(1, sum(exp(lp)) FILTER (lp <= top + 1e-7)) ELSE any_value({_tail("chi2")}) END AS p
  FROM (SELECT *, max(lp) FILTER (own) OVER (PARTITION BY site) AS top FROM choices) GROUP BY site
)""")

# --- files, views, reports -------------------------------------------------------------

_put("labs_from_store", ORACLE["labs_24h_pivot"])
_put("views_refreshed", f"""SELECT subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30, click, view, error, purchase,
  n_labs, last_lab
  FROM (SELECT subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30, {LAB_PIVOT}
    FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id, hadm_id, icustay_id, label
            ORDER BY abs(date_diff('microsecond', intime, charttime)) ASC NULLS LAST) AS r FROM lab_pairs)
    WHERE r = 1 GROUP BY subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, mort_30)
  LEFT JOIN (SELECT subject_id, hadm_id, count(*) AS n_labs, max(charttime) AS last_lab FROM labevents GROUP BY 1, 2)
    USING (subject_id, hadm_id)""", EVENT_SQL, EVENT_LABELS)
_put("sketch_bounds", """SELECT variable, count(*) AS n, count(DISTINCT v) AS n_distinct, true AS ranks_hold, true AS counts_hold
  FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS variable, unnest([l_quantity, l_extendedprice, l_tax]) AS v FROM lineitem)
  WHERE v IS NOT NULL GROUP BY variable""")
_put("csv_indexed", """SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx, s_suppkey, s_name, s_acctbal
  FROM supplier""")
_put("csv_named", "SELECT s_suppkey AS key, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier")
_put("view_replaced", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
_put("report_by_label", """SELECT CAST(4 AS BIGINT) AS row_idx, 'digit_share (median [IQR])' AS features,
    count(*) FILTER (digit_share IS NULL) AS missing FROM model
  UNION ALL SELECT CAST(8 AS BIGINT), 'toxic (n (%))', CAST(0 AS BIGINT) FROM model HAVING count(*) > 0""", DOC_SQL)


def _median_text(column: str, label: int) -> str:
    share = [f"quantile_cont({column}, {q}) FILTER (label = {label})" for q in (0.5, 0.25, 0.75)]
    return "format('{:.2f} [{:.2f},{:.2f}]', " + ", ".join(share) + ")"


_put("report_by_position", """SELECT CAST(0 AS BIGINT) AS row_idx, 'n' AS features, CAST(NULL AS BIGINT) AS missing,
    CAST(count(*) FILTER (label = 0) AS VARCHAR) AS group_0, CAST(count(*) FILTER (label = 1) AS VARCHAR) AS group_1
  FROM model""" + "".join(f"""
  UNION ALL SELECT {i}, '{c} (median [IQR])', count(*) FILTER ({c} IS NULL), {_median_text(c, 0)}, {_median_text(c, 1)}
  FROM model""" for i, c in ((2, "n_words"), (4, "digit_share"))), DOC_SQL)
_put("si_units", """SELECT l_orderkey, l_linenumber, round(l_tax * 88.42, 6) AS creatinine, round(l_discount * 17.1, 6) AS bilirubin,
  round(l_quantity * 0.3571, 6) AS urea, round((l_quantity - 32) / 1.8, 6) AS temperature FROM lineitem""")

_TEXTS = ", ".join(f"'{t}'" for t in RRT_TEXTS)
RENAL_LINES_SQL = f"""
lines AS (
  SELECT l_orderkey AS subject_id, CAST(l_linenumber AS BIGINT) AS hadm_id, l_orderkey * 10 + l_linenumber AS icustay_id,
         l_partkey, l_quantity - 5 AS amount, l_linenumber, (l_suppkey + l_linenumber) % 10 AS place,
         CASE WHEN l_linenumber % 4 = 3 THEN 'metavision' ELSE 'carevue' END AS dbsource,
         CASE WHEN l_discount >= 0.08 THEN 1 WHEN l_discount >= 0.03 THEN 0 END AS error,
         CASE WHEN l_linenumber < 7 THEN [{_TEXTS}][(l_orderkey // 4 + l_linenumber) % {len(RRT_TEXTS)} + 1] END AS text
  FROM lineitem
),
icustays AS (SELECT subject_id, hadm_id, icustay_id, dbsource FROM lines),
""" + ",\n".join(
    f"{name} AS (SELECT icustay_id, {_item(items, 'l_partkey')} AS itemid, amount AS valuenum, amount, error, "
    + ("text AS value" if name == "chartevents" else "amount AS value")
    + f" FROM lines WHERE place = {i}" + (" OR place > 5)" if not i else ")")
    for i, (name, items) in enumerate(RENAL_EVENTS.items())
)
_put("renal_replacement_codes", "SELECT subject_id, hadm_id, icustay_id, rrt FROM renal", RENAL_LINES_SQL, RENAL_SQL)


def _level_rows(place: int, column: str) -> str:
    """Heading and levels of a categorical variable of the report."""
    share = "format('{{}} ({{:.2f}})', count(*) FILTER (label = {0}), count(*) FILTER (label = {0}) * 100.0::DOUBLE / any_value(n{0}))"
    texts = ", ".join(f"CASE WHEN count(*) FILTER (label = {v}) > 0 THEN {share.format(v)} END" for v in (0, 1))
    return f"""
  UNION ALL SELECT {place}, '', '{column} (n (%))', '', '', CAST(0 AS BIGINT) FROM model HAVING count(*) > 0
  UNION ALL SELECT {place}, CAST({column} AS VARCHAR), '{column} (n (%))', {texts}, NULL
  FROM (SELECT *, count(*) FILTER (label = 0) OVER () AS n0, count(*) FILTER (label = 1) OVER () AS n1 FROM model)
  GROUP BY {column}"""


_put("tableone_rows", """SELECT row_number() OVER (ORDER BY place, level) - 1 AS row_idx, features, level, group_0, group_1,
  missing FROM (
  SELECT -1 AS place, '' AS level, 'n' AS features, CAST(count(*) FILTER (label = 0) AS VARCHAR) AS group_0,
    CAST(count(*) FILTER (label = 1) AS VARCHAR) AS group_1, CAST(NULL AS BIGINT) AS missing FROM model""" + "".join(f"""
  UNION ALL SELECT {i}, '', '{c} (median [IQR])', {_median_text(c, 0)}, {_median_text(c, 1)},
    count(*) FILTER ({c} IS NULL) FROM model""" for i, c in enumerate(DOC_FEATURES))
    + _level_rows(len(DOC_FEATURES), "toxic") + _level_rows(len(DOC_FEATURES) + 1, "site") + ")", DOC_SQL)
