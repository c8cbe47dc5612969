"""The same queries as SQL for an independent engine, on the raw tables."""

from __future__ import annotations

import math
import re

from ..functions.columns import NORMAL_DEN, NORMAL_NUM, NORMAL_SPLIT
from ..operators.durationfit import CONTRAST_PRIORS, DEFAULT_PRIORS, STATED_PRIORS, TINY, DurationPriors, Grid
from ..schema import (
    AGE_GROUPS,
    AGE_GROUPS_WITH_ALL,
    BANDS,
    BANDS_90,
    FIGURE_ORDER,
    ILI_SYMPTOMS,
    MODELLED_SYMPTOMS,
    REGIONS,
    SEARCH_TERMS,
    SYMPTOM_LABELS,
)
from .inputs import _FLAG_RULES, EVENT_TERMS, GROUPS, N_DRAWS
from .registry import DURATION_DRAWS, FIT_DRAWS, places

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def values(names: list[str]) -> str:
    return ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))


def text_list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def bands(value: str, prefix: str = "pi_", probs: dict[str, float] = BANDS) -> str:
    return ", ".join(f"quantile_cont({value}, {p}) AS {prefix}{k}" for k, p in probs.items())


def names(prefix: str = "pi_", probs: dict[str, float] = BANDS) -> list[str]:
    return [f"{prefix}{k}" for k in probs]


def strict_sum(c: str) -> str:
    return f"CASE WHEN COUNT({c}) = COUNT(*) THEN SUM({c}) END"


def rank_of(column: str, levels: list[str]) -> str:
    cases = " ".join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(levels))
    return f"CAST(CASE {column} {cases} END AS INT)"


def sentence(c: str) -> str:
    return f"upper(substr({c}, 1, 1)) || lower(substr({c}, 2))"


def first_gap(c: str) -> str:
    return f"regexp_replace({c}, '_', ' ')"


def significant(x: str, digits: int, pad: bool = True) -> str:
    e = f"(CAST(floor(log10(abs({x}))) AS INT) - {digits - 1})"
    v = (
        f"(CASE WHEN {x} = 0 THEN 0.0E0 WHEN {e} < 0 THEN round({x} * pow(10.0E0, -{e})) / pow(10.0E0, -{e}) "
        f"ELSE round({x} / pow(10.0E0, {e})) * pow(10.0E0, {e}) END)"
    )
    places = f"(CASE WHEN {v} = 0 THEN {digits - 1} ELSE greatest({digits - 1} - CAST(floor(log10(abs({v}))) AS INT), 0) END)"
    text = f"printf('%.' || {places} || 'f', {v})"
    if not pad:
        text = f"(CASE WHEN {text} LIKE '%.%' THEN rtrim(rtrim({text}, '0'), '.') ELSE {text} END)"
    return text


def interval(mid: str, low: str, high: str, digits: int, pad: bool = True) -> str:
    m, a, b = (significant(x, digits, pad) for x in (mid, low, high))
    return f"{m} || ' [' || {a} || ', ' || {b} || ']'"


def pivot(source: str, value: str, levels: list[str]) -> str:
    cols = ", ".join(f"MAX({value}) FILTER (WHERE age_group = '{a}') AS \"{a}\"" for a in levels)
    return f"SELECT symptom, {cols} FROM {source} GROUP BY symptom"


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _kept(name: str) -> str:
    """Views that are costly and read more than once are evaluated once."""
    return "MATERIALIZED " if re.search(r"_(terms|node.|lp.|mode.)$", name) else ""


def oracle(name: str, sql: str, doubles: list[str] | None = None) -> None:
    """Register a query: prefix the views it needs, round its doubles."""
    needed: list[str] = []
    open_: set[str] = set()  # a recursive view names itself

    def visit(text: str) -> None:
        for other, body in CTES.items():
            if other not in needed and other not in open_ and re.search(rf"\b{other}\b", text):
                open_.add(other)
                visit(body)
                if other not in needed:
                    needed.append(other)

    visit(sql)
    recursive = any(re.search(rf"\b{n}\b", CTES[n]) for n in needed)
    with_clause = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS {_kept(n)}({CTES[n]})" for n in needed) + "\n" if needed else ""
    if doubles:
        rounded = ", ".join(f"round({c}, {places(name, c)}) + 0.0E0 AS {c}" for c in doubles)
        sql = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
    ORACLES[name] = with_clause + sql


# --- inputs ------------------------------------------------------------------

_new = ", ".join(f"(o.o_orderkey * {a} + o.o_custkey) % {m} = 0 AS symptoms_new_{s}" for s, (a, m) in _FLAG_RULES.items())
_ongoing = ", ".join(f"(o.o_orderkey * {a} + o.o_custkey) % {m} < 2 AS symptoms_{s}" for s, (a, m) in _FLAG_RULES.items())
_day = "(o.o_orderkey * 7 + o.o_custkey) % 140"

cte("region_dim", f"SELECT * FROM (VALUES {values([*REGIONS, 'Scotland'])}) t(region_idx, region_name)")
cte("age_dim", f"SELECT * FROM (VALUES {values(AGE_GROUPS)}) t(age_idx, age_group)")
cte("symptom_dim", f"SELECT * FROM (VALUES {values(MODELLED_SYMPTOMS)}) t(symptom_idx, symptom)")
cte("draw_dim", f"SELECT CAST(unnest(range(1, {N_DRAWS + 1})) AS INT) AS draw")
cte(
    "submissions_raw",
    f"""SELECT o.o_orderkey AS submission_id, o.o_custkey AS participant_id,
  DATE '2023-11-01' + CAST({_day} AS INT) AS submitted_at,
  DATE '2023-11-01' + CAST({_day} - o.o_orderkey % 7 AS INT) AS window_start_date,
  DATE '2023-11-01' + CAST({_day} - (o.o_orderkey * 13) % 15 - CASE WHEN o.o_orderkey % 20 = 0 THEN 50 ELSE 0 END AS INT) AS symptoms_onset,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex, CAST(3 + o.o_custkey % 90 AS INT) AS age,
  r.region_name AS rgn21nm, CAST(1 + o.o_custkey % 10 AS INT) AS imd_dec, {_new}, {_ongoing}
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN region_dim r ON c.c_nationkey % 10 = r.region_idx""",
)
AGE_CASE = (
    "CASE WHEN age < 18 THEN '3 to 17 years' WHEN age <= 34 THEN '18 to 34 years' WHEN age <= 44 THEN '35 to 44 years' "
    "WHEN age <= 54 THEN '45 to 54 years' WHEN age <= 64 THEN '55 to 64 years' WHEN age <= 74 THEN '65 to 74 years' "
    "ELSE '75 years and over' END"
)
ILI_COUNT = " + ".join(f"CAST(symptoms_new_{s} AS INT)" for s in ILI_SYMPTOMS)
IN_STUDY = "rgn21nm <> 'Scotland' AND submitted_at >= DATE '2023-11-14' AND submitted_at < DATE '2024-03-07'"
cte(
    "submissions",
    f"""SELECT *, CAST(date_diff('day', window_start_date, submitted_at) AS INT) AS window_submission,
  CAST(date_diff('day', symptoms_onset, submitted_at) AS INT) AS symptoms_submission, {ILI_COUNT} AS symptoms_count_new_ili,
  {AGE_CASE} AS age_group, rgn21nm AS region_name FROM submissions_raw WHERE {IN_STUDY}""",
)
cte(
    "pop_table",
    """SELECT DISTINCT CAST(3 + c.c_custkey % 90 AS INT) AS age, r.region_name,
  CAST(5000 + ((3 + c.c_custkey % 90) * 131 + r.region_idx * 977) % 4000 AS BIGINT) AS population
FROM customer c CROSS JOIN region_dim r WHERE r.region_name <> 'Scotland'""",
)
cte(
    "strata_population",
    f"SELECT {AGE_CASE} AS age_group, region_name, CAST(SUM(population) AS BIGINT) AS population FROM pop_table GROUP BY 1, 2",
)
_terms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TERMS.items())
cte(
    "search_volume",
    f"""SELECT d.dt AS date, d.symptom, 100.0E0 * d.n / MAX(d.n) OVER (PARTITION BY d.symptom) AS value
FROM (SELECT CAST(ts AS DATE) AS dt, CASE event_type {_terms} END AS symptom, COUNT(*) AS n FROM events GROUP BY 1, 2) d""",
)
cte(
    "boot_weight",
    f"""SELECT g, draw, CASE WHEN h < 368 THEN 0 WHEN h < 736 THEN 1 WHEN h < 920 THEN 2 WHEN h < 981 THEN 3 ELSE 4 END AS w
FROM (SELECT g, draw, (g * 7919 + draw * 104729 + g * draw * 31) % 1000 AS h
  FROM (SELECT unnest(range(0, {GROUPS})) AS g) CROSS JOIN draw_dim)""",
)
_sums = ", ".join(f"SUM(CAST(symptoms_new_{s} AS INT)) AS {s}" for s in MODELLED_SYMPTOMS)
cte(
    "boot_group",
    f"""SELECT submitted_at, region_name, age_group, participant_id % {GROUPS} AS g, COUNT(*) AS n, {_sums}
FROM submissions GROUP BY 1, 2, 3, 4""",
)
_wsums = ", ".join(f"SUM({s} * w) AS {s}" for s in MODELLED_SYMPTOMS)
cte(
    "boot_count",
    f"SELECT submitted_at, region_name, age_group, draw, SUM(n * w) AS n, {_wsums} FROM boot_group JOIN boot_weight USING (g) GROUP BY 1, 2, 3, 4",
)
_pick = " ".join(f"WHEN '{s}' THEN {s}" for s in MODELLED_SYMPTOMS)
cte(
    "prev_draws",
    f"""SELECT symptom, submitted_at, draw, region_name, age_group, p, population, p * population AS p_n FROM (
  SELECT s.symptom, d.submitted_at, dr.draw, r.region_name, a.age_group,
    (0.5E0 + EXTRACT(DAY FROM d.submitted_at) / 100.0E0 + COALESCE(CASE s.symptom {_pick} END, 0)) / (10 + COALESCE(b.n, 0)) AS p
  FROM (SELECT DISTINCT submitted_at FROM submissions) d CROSS JOIN draw_dim dr
  CROSS JOIN (SELECT DISTINCT region_name FROM submissions) r CROSS JOIN (SELECT DISTINCT age_group FROM submissions) a
  CROSS JOIN symptom_dim s LEFT JOIN boot_count b ON b.submitted_at = d.submitted_at AND b.draw = dr.draw
    AND b.region_name = r.region_name AND b.age_group = a.age_group)
LEFT JOIN strata_population USING (age_group, region_name)""",
)
cte(
    "long_flags",
    " UNION ALL ".join(
        f"SELECT submitted_at, participant_id, symptoms_onset AS onset, age_group, '{s}' AS symptom, symptoms_new_{s} AS new, symptoms_{s} AS ongoing FROM submissions"
        for s in ILI_SYMPTOMS
    ),
)
cte(
    "new_delays",
    f"""SELECT * FROM long_flags WHERE regexp_matches(symptom, '{"|".join(MODELLED_SYMPTOMS)}') AND new
  AND date_diff('day', onset, submitted_at) + 1 < 60""",
)
cte(
    "dur_count",
    f"""SELECT symptom, age_group, draw, SUM(n * w) AS n, SUM(s1 * w) AS s1, SUM(s2 * w) AS s2 FROM (
  SELECT symptom, age_group, participant_id % {GROUPS} AS g, COUNT(*) AS n, SUM(x) AS s1, SUM(x * x) AS s2
  FROM (SELECT *, ln(CAST(date_diff('day', onset, submitted_at) + 1 AS DOUBLE)) AS x FROM new_delays) GROUP BY 1, 2, 3)
JOIN boot_weight USING (g) GROUP BY 1, 2, 3""",
)
cte(
    "dur_draws",
    """SELECT symptom, age_group, draw, mu, sqrt(m2 - mu * mu) AS sigma FROM (
  SELECT symptom, age_group, draw, (5 * ln(4.0E0) + COALESCE(s1, 0)) / (5 + COALESCE(n, 0)) AS mu,
    (5 * (ln(4.0E0) * ln(4.0E0) + 0.49E0) + COALESCE(s2, 0)) / (5 + COALESCE(n, 0)) AS m2
  FROM symptom_dim CROSS JOIN age_dim CROSS JOIN draw_dim LEFT JOIN dur_count USING (symptom, age_group, draw))
""",
)
cte("dur_exp", "SELECT *, exp(mu + sigma * sigma / 2) AS exp_dur FROM dur_draws")
cte(
    "search_draws",
    """SELECT t.date, t.symptom, d.draw, t.value, t.value * (1.0E0 + 0.01E0 * ((d.draw * 7 + EXTRACT(DAY FROM t.date)) % 11 - 5)) AS fitted
FROM search_volume t CROSS JOIN draw_dim d""",
)

# --- A -----------------------------------------------------------------------

oracle("read_latest_snapshot", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer", ["c_acctbal"])
oracle("read_submissions", "SELECT * FROM submissions_raw")
oracle("read_population", "SELECT * FROM pop_table")
oracle(
    "read_search_trends",
    "SELECT * FROM search_volume WHERE date >= DATE '2023-11-14' AND date < DATE '2024-03-07'",
    ["value"],
)
oracle(
    "read_samples",
    """SELECT 'stated' AS method, symptom, age_group, draw, mu, sigma FROM dur_draws
UNION ALL SELECT 'wide', symptom, age_group, draw, mu, sigma * 2 FROM dur_draws""",
    ["mu", "sigma"],
)
oracle("write_samples", "SELECT symptom, date, draw, value, fitted FROM search_draws", ["value", "fitted"])
DUR_SUMMARY = f"SELECT symptom, age_group, AVG(exp_dur) AS mean, {bands('exp_dur', 'q')} FROM dur_exp GROUP BY 1, 2"
oracle("write_table", DUR_SUMMARY, ["mean", *names("q")])

# --- B -----------------------------------------------------------------------

oracle("select_survey_columns", "SELECT * FROM submissions_raw")
oracle(
    "add_relative_days",
    """SELECT submission_id, CAST(date_diff('day', window_start_date, submitted_at) AS INT) AS window_submission,
CAST(date_diff('day', symptoms_onset, submitted_at) AS INT) AS symptoms_submission FROM submissions_raw""",
)
oracle(
    "add_weekday",
    "SELECT submission_id, strftime(submitted_at, '%a') AS wday, CAST(dayofweek(submitted_at) + 1 AS INT) AS wday_rank FROM submissions_raw",
)
for _name, _prefix in (("new", "symptoms_new"), ("ongoing", "symptoms")):
    oracle(
        f"add_any_flag_{_name}",
        f"SELECT submission_id, {' OR '.join(f'{_prefix}_{s}' for s in ILI_SYMPTOMS)} AS {_prefix}_any FROM submissions_raw",
    )
oracle("add_ili_count", f"SELECT submission_id, {ILI_COUNT} AS symptoms_count_new_ili FROM submissions_raw")
oracle("add_row_id", "SELECT submission_id, row_number() OVER (ORDER BY submission_id) AS row_id FROM submissions_raw")
oracle(
    "add_row_id_by_symptom",
    "SELECT *, row_number() OVER (PARTITION BY symptom ORDER BY date) AS row_id FROM search_volume",
    ["value"],
)
oracle("with_age_group", f"SELECT submission_id, age, {AGE_CASE} AS age_group FROM submissions_raw")
oracle("filter_study", f"SELECT submission_id, submitted_at, rgn21nm FROM submissions_raw WHERE {IN_STUDY}")
oracle(
    "with_category_rank",
    f"""SELECT submission_id, CASE WHEN rgn21nm IN ({text_list(REGIONS)}) THEN rgn21nm END AS region_name,
{rank_of('rgn21nm', REGIONS)} AS region_name_rank FROM submissions_raw""",
)
_flag_totals = " UNION ALL ".join(
    f"SELECT 'symptoms_new_{s}' AS variable, CAST(SUM(CAST(symptoms_new_{s} AS INT)) AS BIGINT) AS n FROM submissions"
    for s in ILI_SYMPTOMS
)
_short = "regexp_replace(variable, '^symptoms_new_', '')"
oracle(
    "clean_labels",
    f"SELECT variable, n, {sentence(first_gap(_short))} AS label, replace(variable, '_', ' ') AS spaced FROM ({_flag_totals})",
)
LABEL_CASE = "CASE symptom " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYMPTOM_LABELS.items()) + " END"
oracle("label_symptoms", f"SELECT symptom, age_group, draw, {LABEL_CASE} AS symptom_label FROM dur_draws")
HARMONISED = "CASE symptom WHEN 'shortness_of_breath' THEN 'short_breath' WHEN 'anosmia' THEN 'loss_smell' ELSE symptom END"
oracle("harmonise_symptoms", f"SELECT date, {HARMONISED} AS symptom, value FROM search_volume", ["value"])
oracle(
    "filter_symptoms_regex",
    f"SELECT * FROM search_volume WHERE regexp_matches(symptom, '{'|'.join(MODELLED_SYMPTOMS)}')",
    ["value"],
)
oracle("filter_symptoms_in", "SELECT * FROM search_volume WHERE symptom IN ('cough', 'anosmia')", ["value"])
oracle(
    "rename_by_rule",
    "SELECT submission_id, symptoms_onset AS onset, "
    + ", ".join(f"symptoms_new_{s} AS new_{s}, symptoms_{s} AS ongoing_{s}" for s in MODELLED_SYMPTOMS)
    + " FROM submissions_raw",
)
oracle(
    "clean_survey",
    f"""SELECT submission_id, window_submission, symptoms_submission, symptoms_count_new_ili, age_group, region_name,
{rank_of('region_name', REGIONS)} AS region_rank, {rank_of('age_group', AGE_GROUPS)} AS age_rank FROM submissions""",
)

# --- C -----------------------------------------------------------------------

oracle("with_imd_quintile", "SELECT submission_id, CAST(ceil(imd_dec / 2.0E0) AS INT) AS imd_quint FROM submissions")


def shares(levels: str, extra: str = "") -> str:
    return f"""SELECT variable, level, n, n * 100.0E0 / SUM(n) OVER (PARTITION BY variable) AS percent{extra} FROM (
SELECT variable, level, COUNT(*) AS n FROM ({levels}) GROUP BY 1, 2)"""


oracle(
    "demographics_table",
    shares(
        """SELECT 'submitted_at' AS variable, CAST(submitted_at AS VARCHAR) AS level FROM submissions
UNION ALL SELECT 'Sex', sex FROM submissions
UNION ALL SELECT 'Age group', regexp_replace(age_group, ' years', '') FROM submissions
UNION ALL SELECT 'Region', rgn21nm FROM submissions
UNION ALL SELECT 'IMD quintile', CAST(CAST(ceil(imd_dec / 2.0E0) AS INT) AS VARCHAR) FROM submissions"""
    ),
    ["percent"],
)
_flag_levels = " UNION ALL ".join(
    f"SELECT '{s}' AS variable, CAST(symptoms_new_{s} AS VARCHAR) AS level FROM submissions" for s in MODELLED_SYMPTOMS
)
oracle(
    "symptom_table",
    f"SELECT {sentence(first_gap('variable'))} AS symptom, level, n, percent FROM ({shares(_flag_levels)})",
    ["percent"],
)
oracle(
    "waves_table",
    """SELECT waves, n, n * 100.0E0 / SUM(n) OVER () AS percent FROM (
SELECT CAST(CASE WHEN k BETWEEN 1 AND 4 THEN k END AS INT) AS waves, COUNT(*) AS n FROM (
SELECT participant_id, COUNT(*) AS k FROM submissions GROUP BY 1) GROUP BY 1)""",
    ["percent"],
)
oracle("count_participants", "SELECT COUNT(DISTINCT participant_id) AS n_participants FROM submissions")
oracle("count_submissions", "SELECT COUNT(*) AS n_submissions FROM submissions")

# --- D -----------------------------------------------------------------------

cte(
    "cells",
    "SELECT *, CAST(date_diff('day', (SELECT MIN(submitted_at) FROM submissions), submitted_at) + 1 AS INT) AS t FROM ("
    + " UNION ALL ".join(
        f"""SELECT age_group, region_name, window_submission, submitted_at, COUNT(*) AS n_trials, '{s}' AS symptom,
CAST(SUM(CAST(symptoms_new_{s} AS INT)) AS BIGINT) AS n_outcome FROM submissions GROUP BY 1, 2, 3, 4"""
        for s in MODELLED_SYMPTOMS
    )
    + ")",
)
oracle("prevalence_cells", "SELECT * FROM cells")
oracle(
    "with_time_index",
    "SELECT *, CAST(date_diff('day', MIN(date) OVER (PARTITION BY symptom), date) + 1 AS INT) AS t FROM search_volume",
    ["value"],
)


def weights(size: str) -> str:
    return f"""SELECT symptom, window_submission, CAST(k AS DOUBLE) / SUM(k) OVER (PARTITION BY symptom) AS window_weight FROM (
SELECT symptom, window_submission, {size} AS k FROM cells GROUP BY 1, 2)"""


cte("win_weights", weights("COUNT(*)"))
oracle("window_weights", "SELECT * FROM win_weights", ["window_weight"])
oracle("window_weights_by_submissions", weights("SUM(n_trials)"), ["window_weight"])
cte(
    "grid",
    f"""SELECT row_number() OVER (ORDER BY submitted_at, {rank_of('age_group', AGE_GROUPS)}, window_submission,
    {rank_of('region_name', REGIONS)}) AS row_id, submitted_at, age_group, window_submission, region_name,
  CAST(date_diff('day', (SELECT MIN(submitted_at) FROM submissions), submitted_at) + 1 AS INT) AS t, 0 AS n_trials
FROM (SELECT DISTINCT submitted_at FROM submissions) CROSS JOIN (SELECT DISTINCT age_group FROM submissions)
CROSS JOIN (SELECT DISTINCT window_submission FROM submissions) CROSS JOIN (SELECT DISTINCT region_name FROM submissions)""",
)
oracle("prediction_grid", "SELECT * FROM grid")
oracle("poststrat_population", "SELECT * FROM strata_population")
oracle(
    "fit_mrp_saturated",
    "SELECT symptom, age_group, CAST(SUM(n_outcome) AS DOUBLE) / SUM(n_trials) AS p FROM cells GROUP BY 1, 2",
    ["p"],
)


def cell_draws(n: int) -> str:
    return f"""SELECT c.symptom, g.row_id, d.draw, 1 / (1 + exp(-(ln((c.n_outcome + 0.5E0) / (c.n_trials + 10)) + 0.01E0 * d.draw))) AS p
FROM cells c JOIN grid g USING (submitted_at, age_group, window_submission, region_name)
CROSS JOIN (SELECT CAST(unnest(range(1, {n + 1})) AS INT) AS draw) d"""


cte("cell_p", cell_draws(4))
cte("cell_p_one", cell_draws(1))
oracle("inverse_logit", "SELECT * FROM cell_p", ["p"])
oracle(
    "attach_covariates",
    f"""SELECT g.row_id, s.symptom, s.draw, s.p, g.submitted_at, g.age_group, g.window_submission, g.region_name, g.t,
{rank_of('g.age_group', AGE_GROUPS)} AS age_rank FROM cell_p_one s RIGHT JOIN grid g ON s.row_id = g.row_id""",
    ["p"],
)
cte(
    "reweighted",
    f"""SELECT s.symptom, g.submitted_at, s.draw, g.region_name, g.age_group, {strict_sum('s.p * w.window_weight')} AS p
FROM cell_p s JOIN grid g USING (row_id)
LEFT JOIN win_weights w ON w.symptom = s.symptom AND w.window_submission IS NOT DISTINCT FROM g.window_submission
GROUP BY 1, 2, 3, 4, 5""",
)
oracle("reweight_window", "SELECT * FROM reweighted", ["p"])
oracle(
    "poststratify",
    "SELECT r.*, s.population, r.p * s.population AS p_n FROM reweighted r LEFT JOIN strata_population s USING (age_group, region_name)",
    ["p", "p_n"],
)
_rate = f"({strict_sum('p_n')}) / ({strict_sum('population')}) AS p"


def breakdown(columns: list[str], tag: str, extra: str = "") -> str:
    keys = ", ".join(["symptom", "submitted_at", *columns])
    shown = "".join(f", {c if c in columns else 'NULL'} AS {c}" for c in (["age_group", "region_name"] if extra else columns))
    symptom = "" if extra else "symptom, "
    return f"""SELECT {symptom}submitted_at{shown}, {bands('p')}, 'symptoms_new_' || symptom AS outcome, '{tag}' AS breakdown
FROM (SELECT {keys}, draw, {_rate} FROM prev_draws GROUP BY {keys}, draw) GROUP BY {keys}"""


oracle("prevalence_by_age", breakdown(["age_group"], "age"), names())
oracle("prevalence_by_region", breakdown(["region_name"], "region"), names())
oracle("prevalence_national", breakdown([], "nation"), names())
cte(
    "prev_summary",
    breakdown(["age_group"], "age", "x")
    + " UNION ALL "
    + breakdown(["region_name"], "region", "x")
    + " UNION ALL "
    + breakdown([], "nation", "x"),
)
oracle("prevalence_summary", "SELECT * FROM prev_summary", names())
_pct = ", ".join(f"100.0E0 * {c} AS {c}" for c in names())
_figure = f"outcome, breakdown, {_pct}, regexp_replace(outcome, '^symptoms_new_', '') AS symptom FROM prev_summary"
_age_all = "CASE WHEN breakdown = 'nation' THEN 'All' ELSE age_group END"
oracle(
    "prevalence_age_figure_data",
    f"""SELECT submitted_at, {_age_all} AS age_group, {rank_of(_age_all, AGE_GROUPS_WITH_ALL).replace(f'CASE {_age_all}', f'CASE ({_age_all})')} AS age_rank,
region_name, {_figure} WHERE breakdown IN ('age', 'nation')""",
    names(),
)
for _tag in ("region", "nation"):
    oracle(
        f"prevalence_{_tag}_figure_data",
        f"SELECT submitted_at, age_group, region_name, {_figure} WHERE breakdown = '{_tag}'",
        names(),
    )

# --- E -----------------------------------------------------------------------

oracle(
    "unpivot_symptoms",
    "SELECT symptom, age_group, new, ongoing, COUNT(*) AS n, MIN(onset) AS first_onset FROM long_flags GROUP BY 1, 2, 3, 4",
)
oracle("filter_new_short", "SELECT * FROM new_delays")
oracle(
    "empirical_duration",
    """SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY symptom, age_group) AS p FROM (
SELECT symptom, age_group, CAST(date_diff('day', onset, submitted_at) + 1 AS INT) AS duration, COUNT(*) AS n
FROM new_delays GROUP BY 1, 2, 3)""",
    ["p"],
)


def interval_cells(ext: str, keys: str = "", source: str = "new_delays") -> str:
    return f"""SELECT {keys}symptom, age_group, onset AS pdate_lwr, onset + 1 AS pdate_upr, submitted_at + 1 AS sdate_lwr,
submitted_at + CAST(2 + {ext} AS INT) AS sdate_upr, COUNT(*) AS n FROM {source} GROUP BY ALL"""


def delay_counts(source: str, by: list[str]) -> str:
    keys = ", ".join([*[k for k in by if k != "symptom"], "symptom", "age_group"])
    return f"""SELECT {keys}, CAST(sdate_lwr - pdate_lwr AS INT) AS delay_lwr, CAST(sdate_upr - pdate_lwr AS INT) AS delay_upr,
CAST(pdate_upr - pdate_lwr AS INT) AS pwindow, CAST(sdate_upr - sdate_lwr AS INT) AS swindow,
CAST(obs_end - pdate_lwr AS INT) AS relative_obs_time, CAST(SUM(n) AS BIGINT) AS n FROM (
SELECT *, MAX(sdate_upr) OVER (PARTITION BY {", ".join(by)}) AS obs_end FROM ({source})) GROUP BY ALL"""


cte("dur_cells", interval_cells("3"))
cte("delay_table", delay_counts("SELECT * FROM dur_cells", ["symptom"]))
oracle("duration_cells", "SELECT * FROM dur_cells")
oracle("delay_cells", "SELECT * FROM delay_table")
oracle(
    "impossible_delays",
    """SELECT symptom, age_group, CAST(SUM(CASE WHEN delay_upr > 0 THEN 0 ELSE n END) AS BIGINT) AS n_dropped,
  CAST(SUM(n) AS BIGINT) AS n_all FROM delay_table GROUP BY 1, 2""",
)
cte(
    "ext_cells",
    interval_cells(
        "window_extension",
        "window_extension, ",
        "(SELECT * FROM new_delays CROSS JOIN (VALUES (0), (3), (7), (10)) v(window_extension))",
    ),
)
cte("ext_delays", delay_counts("SELECT * FROM ext_cells", ["window_extension", "symptom"]))
oracle("duration_window_cells", "SELECT * FROM ext_delays")
oracle("with_expected_duration", "SELECT * FROM dur_exp", ["mu", "sigma", "exp_dur"])
oracle("mean_duration_by_age", "SELECT symptom, age_group, AVG(exp_dur) AS mean_dur FROM dur_exp GROUP BY 1, 2", ["mean_dur"])


def density(x: str, mu: str = "mu", sigma: str = "sigma") -> str:
    return (
        f"CASE WHEN {x} <= 0 THEN 0.0E0 ELSE exp(-0.5E0 * pow((ln({x}) - {mu}) / {sigma}, 2)) "
        f"/ ({x} * {sigma} * sqrt(2 * pi())) END"
    )


cte(
    "dens",
    f"""SELECT *, {density('duration')} AS density FROM (SELECT symptom, age_group, draw, mu, sigma, 0.5E0 * k AS duration
FROM dur_draws CROSS JOIN (SELECT unnest(range(0, 201)) AS k))""",
)
oracle("density_grid", "SELECT * FROM dens", ["mu", "sigma", "duration", "density"])
oracle(
    "density_bands",
    f"SELECT symptom, age_group, duration, {bands('density')} FROM dens GROUP BY 1, 2, 3",
    ["duration", *names()],
)
oracle("duration_summary", DUR_SUMMARY, ["mean", *names("q")])
for _name, _digits, _pad in (("mean_duration_table", 3, True), ("mean_duration_table_unpadded", 4, False)):
    oracle(
        _name,
        pivot(
            f"(SELECT {LABEL_CASE} AS symptom, age_group, {interval('mean', 'q5', 'q95', _digits, _pad)} AS v FROM ({DUR_SUMMARY}))",
            "v",
            AGE_GROUPS,
        ),
    )

# Newton's method for intercept and window slope, on counts per window day
cte(
    "window_cells",
    "SELECT symptom, window_submission * 1.0E0 AS x, SUM(n_trials) * 1.0E0 AS m, SUM(n_outcome) * 1.0E0 AS y FROM cells GROUP BY 1, 2",
)
cte(
    "newton",
    """SELECT symptom, 0 AS step, ln(SUM(y) / (SUM(m) - SUM(y))) AS b0, 0.0E0 AS b1 FROM window_cells GROUP BY symptom UNION ALL
SELECT symptom, step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
SELECT symptom, step, b0, b1, SUM(y - m * p) AS g0, SUM((y - m * p) * x) AS g1,
  SUM(m * p * (1 - p)) AS h00, SUM(m * p * (1 - p) * x) AS h01, SUM(m * p * (1 - p) * x * x) AS h11 FROM (
SELECT n.*, c.x, c.m, c.y, 1 / (1 + exp(-(b0 + b1 * c.x))) AS p FROM newton n JOIN window_cells c USING (symptom) WHERE step < 12)
GROUP BY symptom, step, b0, b1)""",
)
oracle(
    "fit_mrp_window",
    "SELECT symptom, b0 AS intercept, b1 AS slope, TRUE AS converged FROM newton WHERE step = 12",
    ["intercept", "slope"],
)

# --- F -----------------------------------------------------------------------

cte(
    "prev_age",
    f"""SELECT symptom, submitted_at AS date, draw, age_group, ({strict_sum('p_n')}) / ({strict_sum('population')}) AS prevalence,
CAST({strict_sum('population')} AS BIGINT) AS population FROM prev_draws GROUP BY 1, 2, 3, 4""",
)
oracle("prevalence_age_draws", "SELECT * FROM prev_age", ["prevalence"])
cte(
    "shifted",
    """SELECT symptom, age_group, draw, date - CAST(round_even(exp_dur / 2, 0) AS INT) AS date, prevalence, population, mu, sigma,
exp_dur, prevalence * population / exp_dur AS incidence, date AS report_date
FROM prev_age LEFT JOIN dur_exp USING (symptom, age_group, draw)""",
)
_F = ["prevalence", "mu", "sigma", "exp_dur", "incidence"]
oracle("backshift_incidence", "SELECT * FROM shifted", _F)
cte(
    "inc",
    """SELECT s.* EXCLUDE (report_date), b.min_date, b.max_date FROM shifted s JOIN (
SELECT symptom, MIN(report_date) - CAST(round_even(MIN(exp_dur) / 2, 0) AS INT) AS min_date,
  MAX(report_date) - CAST(round_even(MAX(exp_dur) / 2, 0) AS INT) AS max_date FROM shifted GROUP BY 1) b USING (symptom)
WHERE s.date BETWEEN b.min_date AND b.max_date""",
)
oracle("trim_common_support", "SELECT * FROM inc", _F)
cte(
    "inc_nation",
    "SELECT symptom, date, draw, SUM(incidence) AS incidence, CAST(SUM(population) AS BIGINT) AS population FROM inc GROUP BY 1, 2, 3",
)
oracle("incidence_national", "SELECT * FROM inc_nation", ["incidence"])
_q = names("incidence_q")
oracle(
    "incidence_age_bands",
    f"SELECT {first_gap('symptom')} AS symptom, date, age_group, {bands('incidence', 'incidence_q')} FROM inc GROUP BY inc.symptom, date, age_group",
    _q,
)
oracle(
    "incidence_national_bands",
    f"SELECT {first_gap('symptom')} AS symptom, date, {bands('incidence', 'incidence_q')} FROM inc_nation GROUP BY inc_nation.symptom, date",
    _q,
)

# --- G -----------------------------------------------------------------------

cte(
    "pmf",
    f"""SELECT symptom, age_group, draw, exp_dur, CAST(k AS INT) AS day, {density('CAST(k AS DOUBLE)')} AS mass
FROM dur_exp CROSS JOIN (SELECT unnest(range(0, 61)) AS k)""",
)
oracle("delay_pmf", "SELECT * FROM pmf", ["exp_dur", "mass"])


def normal_cdf(x: str) -> str:
    a = f"abs({x})"

    def poly(coefs: list[float]) -> str:
        out = f"{coefs[0]!r}"
        for c in coefs[1:]:
            out = f"({out}*{a}+{c!r})"
        return out.replace("e-", "E-")

    num, den = (poly([float(c) for c in cs]) for cs in (NORMAL_NUM, NORMAL_DEN))
    num, den = (re.sub(r"(?<![\w.E-])(\d+\.\d+)(?!\d*E)", r"\1E0", t) for t in (num, den))
    e = f"exp(-0.5E0*{a}*{a})"
    far = f"{e}/({a}+1.0E0/({a}+2.0E0/({a}+3.0E0/({a}+4.0E0/({a}+0.65E0)))))/2.506628274631E0"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0E0 WHEN {a} < {NORMAL_SPLIT}E0 THEN {e}*{num}/{den} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0E0 - {tail} ELSE {tail} END)"


oracle(
    "delay_pmf_interval",
    f"""SELECT symptom, age_group, draw, day, {normal_cdf('z1')} - CASE WHEN day > 0 THEN {normal_cdf('z0')} ELSE 0 END AS mass
FROM (SELECT p.symptom, p.age_group, p.draw, p.day, (ln(p.day + 1.0E0) - d.mu) / d.sigma AS z1,
  (ln(greatest(p.day, 1) * 1.0E0) - d.mu) / d.sigma AS z0 FROM pmf p JOIN dur_draws d USING (symptom, age_group, draw))""",
    ["mass"],
)
# two unrolled deconvolution steps; state k = 1..60 lies before the first day
cte("obs", "SELECT *, row_number() OVER (PARTITION BY symptom, age_group, draw ORDER BY date) AS i FROM prev_age")
cte("obs_n", "SELECT symptom, age_group, draw, CAST(MAX(i) AS INT) AS n FROM obs GROUP BY 1, 2, 3")
cte("pmf_mode", "SELECT symptom, age_group, draw, CAST(arg_max(day, struct_pack(m := mass, d := -day)) AS INT) AS mode FROM pmf GROUP BY 1, 2, 3")
cte(
    "state0",
    """SELECT s.symptom, s.age_group, s.draw, s.k, greatest(o.prevalence, 1E-12) AS v FROM (
SELECT symptom, age_group, draw, CAST(unnest(range(1, 60 + n + 1)) AS INT) AS k, n, mode FROM obs_n JOIN pmf_mode USING (symptom, age_group, draw)) s
JOIN obs o ON o.symptom = s.symptom AND o.age_group = s.age_group AND o.draw = s.draw
  AND o.i = greatest(1, least(s.n, s.k - 60 + s.mode))""",
)
cte(
    "reach",
    """SELECT s.symptom, s.age_group, s.draw, s.k, SUM(p.mass) AS q FROM state0 s JOIN obs_n n USING (symptom, age_group, draw)
JOIN pmf p ON p.symptom = s.symptom AND p.age_group = s.age_group AND p.draw = s.draw AND s.k - 60 + p.day BETWEEN 1 AND n.n
GROUP BY 1, 2, 3, 4""",
)
for _step in (1, 2):
    cte(
        f"fit{_step}",
        f"""SELECT o.symptom, o.age_group, o.draw, o.i, o.prevalence / SUM(p.mass * s.v) AS ratio FROM state{_step - 1} s
JOIN pmf p USING (symptom, age_group, draw)
JOIN obs o ON o.symptom = s.symptom AND o.age_group = s.age_group AND o.draw = s.draw AND o.i = s.k - 60 + p.day
GROUP BY 1, 2, 3, 4, o.prevalence""",
    )
    cte(
        f"state{_step}",
        f"""SELECT s.symptom, s.age_group, s.draw, s.k, CASE WHEN r.q > 0 THEN s.v * b.back / r.q END AS v FROM state{_step - 1} s
JOIN reach r USING (symptom, age_group, draw, k)
JOIN (SELECT f.symptom, f.age_group, f.draw, f.i + 60 - p.day AS k, SUM(p.mass * f.ratio) AS back FROM fit{_step} f
  JOIN pmf p USING (symptom, age_group, draw) GROUP BY 1, 2, 3, 4) b USING (symptom, age_group, draw, k)""",
    )
oracle(
    "deconvolve_two_steps",
    """SELECT s.symptom, s.age_group, s.draw, o.population, s.v / d.exp_dur AS incidence,
CAST((SELECT MIN(date) FROM obs) + CAST(s.k - 60 AS INT) AS DATE) AS date
FROM state2 s JOIN obs o ON o.symptom = s.symptom AND o.age_group = s.age_group AND o.draw = s.draw AND o.i = s.k - 60
JOIN dur_exp d ON d.symptom = s.symptom AND d.age_group = s.age_group AND d.draw = s.draw""",
    ["incidence"],
)
# the whole iteration, one row per series and step: lists of the observed days,
# the delay weights, the share q of each state day that is seen, and the state
_SERIES = "symptom, age_group, draw"
_DAYS = 60
cte(
    "rl_start",
    f"""SELECT {_SERIES}, y, p, s, list_transform(range(1, len(s) + 1), lambda k:
  list_dot_product(list_slice(list_concat(list_resize([0.0E0], {_DAYS}, 0.0E0), list_transform(y, lambda v: 1.0E0), list_resize([0.0E0], {_DAYS}, 0.0E0)), k, k + {_DAYS}), p)) AS q
FROM (SELECT {_SERIES}, list(prevalence ORDER BY date) AS y FROM prev_age GROUP BY ALL)
JOIN (SELECT {_SERIES}, list(mass ORDER BY day) AS p FROM pmf GROUP BY ALL) USING ({_SERIES})
JOIN (SELECT {_SERIES}, list(v ORDER BY k) AS s FROM state0 GROUP BY ALL) USING ({_SERIES})""",
)


def _judged(source: str) -> str:
    """The rows with the expected days e and the mean squared misfit c."""
    return f"""SELECT *, list_avg(list_transform(range(1, len(y) + 1), lambda i: CASE WHEN e[i] > 0 THEN pow(e[i] - y[i], 2) / e[i] ELSE 0.0E0 END)) AS c
FROM (SELECT *, list_transform(range(1, len(y) + 1), lambda i: list_dot_product(list_slice(s, i, i + {_DAYS}), list_reverse(p))) AS e FROM ({source}))"""


cte(
    "rl",
    f"""SELECT {_SERIES}, 0 AS step, y, p, q, s, e, c FROM ({_judged("SELECT * FROM rl_start")}) UNION ALL
SELECT {_SERIES}, step, y, p, q, s, e, c FROM ({_judged(f"""SELECT {_SERIES}, step, y, p, q,
  list_transform(range(1, len(s) + 1), lambda k: CASE WHEN q[k] > 0 THEN s[k] * list_dot_product(list_slice(r, k, k + {_DAYS}), p) / q[k] ELSE s[k] END) AS s
  FROM (SELECT {_SERIES}, step + 1 AS step, y, p, q, s, list_concat(list_resize([0.0E0], {_DAYS}, 0.0E0),
    list_transform(range(1, len(y) + 1), lambda i: CASE WHEN e[i] > 0 THEN y[i] / e[i] ELSE 0.0E0 END), list_resize([0.0E0], {_DAYS}, 0.0E0)) AS r
    FROM rl WHERE step < 32 AND c >= 1E-4)""")})""",
)
cte(
    "rl_last",
    f"""SELECT {_SERIES}, MAX(step) AS updates, arg_max(s, step) AS s, any_value(q) AS q,
  CASE WHEN MAX(step) = 32 THEN MAX(c) FILTER (WHERE step = 31) ELSE arg_max(c, step) END AS fit FROM rl GROUP BY ALL""",
)
cte(
    "deconvolved",
    f"""SELECT o.symptom, o.age_group, o.draw, o.population,
  CASE WHEN l.q[o.i + {_DAYS}] > 0 THEN l.s[o.i + {_DAYS}] / d.exp_dur END AS incidence,
  CAST((SELECT MIN(date) FROM obs) + CAST(o.i AS INT) AS DATE) AS date
FROM obs o JOIN rl_last l USING ({_SERIES}) JOIN dur_exp d USING ({_SERIES})""",
)
oracle("deconvolve", "SELECT * FROM deconvolved", ["incidence"])
oracle(
    "deconvolution_status",
    """SELECT symptom, age_group, COUNT(*) AS n_series, COUNT(*) FILTER (WHERE fit < 1E-4) AS n_converged,
COUNT(*) FILTER (WHERE fit IS NULL) AS n_unknown, CAST(MAX(updates) AS INT) AS most_updates, MAX(fit) AS worst_fit FROM rl_last GROUP BY 1, 2""",
    ["worst_fit"],
)
oracle(
    "deconvolved_incidence_bands",
    f"""SELECT symptom, age_group, date, {bands('v')}, 'Deconvolution' AS data FROM (
SELECT symptom, age_group, date, incidence * 1000 AS v FROM deconvolved UNION ALL
SELECT symptom, 'All', date, {strict_sum('incidence * population')} / SUM(population) * 1000 FROM deconvolved GROUP BY symptom, date, draw) GROUP BY 1, 2, 3""",
    names(),
)
oracle(
    "assign_dates",
    """SELECT symptom, draw, fitted, (SELECT MIN(date) FROM search_volume) AS start,
(SELECT MIN(date) FROM search_volume) + CAST(EXTRACT(DAY FROM date) AS INT) AS date FROM search_draws""",
    ["fitted"],
)
cte(
    "weighted_nation",
    "SELECT date, symptom, draw, SUM(incidence * population) / SUM(population) AS incidence, 'All' AS age_group FROM inc GROUP BY 1, 2, 3",
)
oracle("national_weighted", "SELECT * FROM weighted_nation", ["incidence"])
oracle(
    "stack_national",
    """SELECT date, symptom, draw, age_group, incidence, population FROM inc
UNION ALL SELECT date, symptom, draw, age_group, incidence, NULL FROM weighted_nation""",
    ["incidence"],
)
oracle(
    "deconvolution_bands",
    f"""SELECT symptom, age_group, date, {bands('v')}, 'Deconvolution' AS data FROM (
SELECT *, CASE WHEN EXTRACT(DAY FROM date) + draw % 3 <> 31 THEN incidence / population * 1000 END AS v FROM inc) GROUP BY 1, 2, 3""",
    names(),
)

# --- I (used by G as well) ---------------------------------------------------

cte(
    "inc_agg",
    "SELECT symptom, date, age_group, draw, SUM(incidence) AS incidence, CAST(SUM(population) AS BIGINT) AS population FROM inc GROUP BY 1, 2, 3, 4",
)
oracle("aggregate_draws", "SELECT * FROM inc_agg", ["incidence"])
cte(
    "survey_all",
    """SELECT symptom, date, draw, age_group, incidence, population FROM inc_agg UNION ALL
SELECT symptom, date, draw, 'All', SUM(incidence), CAST(SUM(population) AS BIGINT) FROM inc_agg GROUP BY 1, 2, 3""",
)
oracle("with_all_ages", "SELECT * FROM survey_all", ["incidence"])
cte(
    "rate_bands",
    f"SELECT symptom, age_group, date, {bands('1000 * incidence / population')}, age_group AS data FROM survey_all GROUP BY 1, 2, 3",
)
oracle("per_capita_bands", "SELECT * FROM rate_bands", names())
cte("fixed_bands", "SELECT * REPLACE ('Fixed back-shift' AS data) FROM rate_bands")
cte(
    "scaled_bands",
    f"""SELECT symptom, age_group, date, {bands('1000 * incidence * (1.1E0 + EXTRACT(DAY FROM date) / 100.0E0) / population')},
'Deconvolution' AS data FROM survey_all WHERE date >= DATE '2023-11-20' AND date < DATE '2024-02-20' GROUP BY 1, 2, 3""",
)
cte(
    "aligned",
    """SELECT b.* FROM (SELECT * FROM fixed_bands UNION ALL SELECT * FROM scaled_bands) b JOIN (
SELECT symptom, age_group, MIN(m) AS last FROM (SELECT symptom, age_group, data, MAX(date) AS m FROM (
SELECT * FROM fixed_bands UNION ALL SELECT * FROM scaled_bands) GROUP BY 1, 2, 3) GROUP BY 1, 2) e USING (symptom, age_group)
WHERE b.date <= e.last""",
)
oracle("align_end_dates", "SELECT * FROM aligned", names())
_wide = ", ".join(
    f"MAX({c}) FILTER (WHERE data {op} 'Deconvolution') AS {c}_{m}" for c in names() for m, op in (("f", "<>"), ("d", "="))
)
_diffs = ", ".join(f"(pi_{k}_f - pi_{k}_d) / pi_{k}_d AS diff_{k}" for k in ("50", "5", "95"))
oracle(
    "relative_difference",
    f"SELECT *, {_diffs} FROM (SELECT symptom, age_group, date, {_wide} FROM aligned GROUP BY 1, 2, 3)",
    [*[f"{c}_{m}" for c in names() for m in "fd"], *[f"diff_{k}" for k in ("50", "5", "95")]],
)

# --- H -----------------------------------------------------------------------

oracle(
    "trend_features",
    f"""SELECT *, CAST(dayofweek(date) + 1 AS INT) AS dotw,
CASE WHEN date IN (DATE '2023-12-25', DATE '2023-12-26') THEN 1 ELSE 0 END AS is_bank_holiday,
CAST(date_diff('day', MIN(date) OVER (PARTITION BY symptom), date) + 1 AS INT) AS t,
row_number() OVER (PARTITION BY symptom ORDER BY date) AS row_id FROM search_volume WHERE symptom IN ({text_list(SEARCH_TERMS)})""",
    ["value"],
)


def value_bands(source: str, keys: str) -> str:
    return f"""SELECT {keys}, {", ".join(names())}, unnest(vs) AS value FROM (
SELECT {keys}, {bands('fitted')}, list_distinct(list(value)) AS vs FROM {source} GROUP BY {keys})"""


oracle("trend_bands", value_bands("search_draws", "date, symptom"), [*names(), "value"])
oracle(
    "derivative_bands",
    f"SELECT date, symptom, {bands('fitted - value')} FROM search_draws GROUP BY 1, 2",
    names(),
)


def growth(source: str, value: str, keys: str, out: str) -> str:
    return f"""SELECT * EXCLUDE (pd, pv), CAST(date - pd AS DOUBLE) AS diff_time, {value} - pv AS diff_incidence,
({value} - pv) / CAST(date - pd AS DOUBLE) / {value} * 100 AS {out} FROM (SELECT *, lag(date) OVER w AS pd, lag({value}) OVER w AS pv
FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY date)) WHERE pd IS NOT NULL"""


cte("growth_survey", growth("survey_all", "incidence", "symptom, age_group, draw", "survey_gr"))
oracle("survey_growth_rates", "SELECT * FROM growth_survey", ["incidence", "diff_time", "diff_incidence", "survey_gr"])
cte(
    "survey_gr_bands",
    f"SELECT symptom, age_group, date, {bands('survey_gr')}, age_group AS data FROM growth_survey GROUP BY 1, 2, 3",
)
oracle("survey_growth_bands", "SELECT * FROM survey_gr_bands", names())
cte(
    "trend_sel",
    f"""SELECT * FROM (SELECT date, {HARMONISED} AS symptom, draw, value, fitted, 'Google trends' AS data FROM search_draws)
WHERE regexp_matches(symptom, '{"|".join(MODELLED_SYMPTOMS)}')""",
)
oracle("trend_draws", "SELECT * FROM trend_sel", ["value", "fitted"])
cte("trend_cmp", f"SELECT *, 'Google trends' AS data FROM ({value_bands('trend_sel', 'date, symptom')})")
oracle("trend_compare_bands", "SELECT * FROM trend_cmp", [*names(), "value"])
cte("growth_search", growth("trend_sel", "fitted", "symptom, draw", "search_gr"))
oracle("trend_growth_rates", "SELECT * FROM growth_search", ["value", "fitted", "diff_time", "diff_incidence", "search_gr"])
cte("trend_gr_bands", f"SELECT date, symptom, {bands('search_gr')}, 'Google trends' AS data FROM growth_search GROUP BY 1, 2")
oracle("trend_growth_bands", "SELECT * FROM trend_gr_bands", names())
_rank = rank_of("data", FIGURE_ORDER)
oracle(
    "incidence_figure_data",
    f"SELECT *, {_rank} AS data_rank FROM (SELECT * FROM rate_bands UNION ALL BY NAME SELECT * FROM trend_cmp)",
    [*names(), "value"],
)
oracle(
    "growth_figure_data",
    f"SELECT *, {_rank} AS data_rank FROM (SELECT * FROM survey_gr_bands UNION ALL BY NAME SELECT * FROM trend_gr_bands)",
    names(),
)
cte(
    "joined",
    """SELECT s.*, t.value, t.fitted, t.data FROM survey_all s JOIN trend_sel t USING (symptom, date, draw)""",
)
oracle("join_draws", "SELECT * FROM joined", ["incidence", "value", "fitted"])
cte(
    "joined_gr",
    "SELECT s.symptom, s.age_group, s.draw, s.date, s.survey_gr, t.search_gr FROM growth_survey s JOIN growth_search t USING (symptom, date, draw)",
)


def ccf(source: str, x: str, y: str) -> str:
    return f"""SELECT a.symptom, a.age_group, a.draw, CAST(a.pos - b.pos AS INT) AS lag, CASE WHEN any_value(a.flat) THEN 'NaN'::DOUBLE
ELSE SUM(a.dx * b.dy) / sqrt(any_value(a.xx) * any_value(a.yy)) END AS ccf
FROM {source}_c a JOIN {source}_c b ON a.symptom = b.symptom AND a.age_group = b.age_group AND a.draw = b.draw
  AND abs(a.pos - b.pos) <= a.l GROUP BY 1, 2, 3, 4"""


for _source, _x, _y in (("joined", "incidence", "fitted"), ("joined_gr", "survey_gr", "search_gr")):
    cte(
        f"{_source}_c",
        f"""SELECT *, sqrt(xx) <= abs(mx) * 1E-9 * sqrt(n) OR sqrt(yy) <= abs(my) * 1E-9 * sqrt(n) AS flat FROM (
SELECT *, SUM(dx * dx) OVER (PARTITION BY symptom, age_group, draw) AS xx, SUM(dy * dy) OVER (PARTITION BY symptom, age_group, draw) AS yy,
least(CAST(floor(10 * (log10(n) - log10(2))) AS INT), n - 1) AS l FROM (
SELECT symptom, age_group, draw, row_number() OVER (PARTITION BY symptom, age_group, draw ORDER BY date) AS pos,
  COUNT(*) OVER (PARTITION BY symptom, age_group, draw) AS n,
  AVG({_x}) OVER (PARTITION BY symptom, age_group, draw) AS mx, AVG({_y}) OVER (PARTITION BY symptom, age_group, draw) AS my,
  {_x} - AVG({_x}) OVER (PARTITION BY symptom, age_group, draw) AS dx,
  {_y} - AVG({_y}) OVER (PARTITION BY symptom, age_group, draw) AS dy FROM {_source}))""",
    )
cte("ccf_inc", ccf("joined", "incidence", "fitted"))
cte("ccf_gr", ccf("joined_gr", "survey_gr", "search_gr"))
oracle("cross_correlation", "SELECT * FROM ccf_inc", ["ccf"])
oracle("cross_correlation_growth", "SELECT * FROM ccf_gr", ["ccf"])
oracle("ccf_bands", f"SELECT symptom, age_group, lag, {bands('ccf')} FROM ccf_inc WHERE NOT isnan(ccf) GROUP BY 1, 2, 3", names())
for _k in ("inc", "gr"):
    cte(
        f"top_{_k}",
        f"""SELECT symptom, age_group, draw, arg_max(lag, struct_pack(c := round(ccf, 9), l := -lag)) AS lag, MAX(ccf) AS ccf
FROM ccf_{_k} WHERE NOT isnan(ccf) GROUP BY 1, 2, 3""",
    )
    for _v in ("lag", "ccf"):
        cte(
            f"{_v}_{_k}_bands",
            f"SELECT symptom, age_group, {bands(_v, f'{_v}_pi_', BANDS_90)} FROM top_{_k} GROUP BY 1, 2",
        )
oracle("max_lag", "SELECT * FROM lag_inc_bands", names("lag_pi_", BANDS_90))
oracle("max_corr", "SELECT * FROM ccf_inc_bands", names("ccf_pi_", BANDS_90))
for _name, _v, _k in (
    ("max_lag_table", "lag", "inc"),
    ("max_corr_table", "ccf", "inc"),
    ("max_lag_table_growth", "lag", "gr"),
    ("max_corr_table_growth", "ccf", "gr"),
):
    _text = interval(f"{_v}_pi_50", f"{_v}_pi_5", f"{_v}_pi_95", 2)
    oracle(_name, pivot(f"(SELECT symptom, age_group, {_text} AS v FROM {_v}_{_k}_bands)", "v", AGE_GROUPS_WITH_ALL))
oracle(
    "max_ccf_2d",
    f"""SELECT {LABEL_CASE} AS symptom, c.* EXCLUDE (symptom), l.* EXCLUDE (symptom, age_group),
{rank_of('c.age_group', AGE_GROUPS_WITH_ALL)} AS age_rank, CASE WHEN c.age_group = 'All' THEN 'A' ELSE 'B' END AS is_national
FROM ccf_gr_bands c JOIN lag_gr_bands l USING (symptom, age_group)""".replace("CASE symptom", "CASE c.symptom", 1),
    [*names("ccf_pi_", BANDS_90), *names("lag_pi_", BANDS_90)],
)

# --- duration posterior ------------------------------------------------------


def posterior(prefix: str, source: str, keys: list[str], priors: DurationPriors, shared: bool, grid: Grid = Grid()) -> None:
    """Views of the grid posterior; the last one is ``<prefix>_post``. Priors
    with contrasts are widened for all age groups but the reference."""
    def sd(own: float) -> str:
        if not priors.contrast_sd:
            return f"{own!r}E0"
        return f"(CASE WHEN age_group = '{REFERENCE}' THEN {own!r}E0 ELSE {math.hypot(own, priors.contrast_sd)!r}E0 END)"

    mu_sd, ls_sd = sd(priors.mu_sd), sd(priors.log_sigma_sd)
    k = ", ".join(keys)
    sk = ", ".join(x for x in keys if x != "age_group") if shared else k
    k_eq = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    cte(
        f"{prefix}_terms",
        f"""SELECT {k}, hi, lo, pw, SUM(n) AS n FROM (
SELECT {k}, delay_upr AS hi, delay_lwr AS lo, pwindow AS pw, n, 1 AS sign FROM {source} WHERE delay_upr > 0
UNION ALL SELECT {k}, relative_obs_time, 0, pwindow, -n, -1 FROM {source} WHERE delay_upr > 0)
GROUP BY {k}, hi, lo, pw, sign""",
    )
    def evaluate(step: str, centre: str, half: tuple) -> None:
        (i0, i1), (j0, j1) = half
        cte(
            f"{prefix}_node{step}",
            f"""SELECT {k}, i, j, mu0 + i * dmu AS mu, ls0 + j * dls AS ls, dmu, dls FROM ({centre})
CROSS JOIN (SELECT unnest(range({i0}, {i1 + 1})) AS i) CROSS JOIN (SELECT unnest(range({j0}, {j1 + 1})) AS j)""",
        )
        points = {"h1": "hi", "h0": "hi - pw", "l1": "lo", "l0": "lo - pw"}
        scores = ", ".join(f"(ln(greatest({d}, 1) * 1.0E0) - mu) / sg AS {p}" for p, d in points.items())
        shifts = ", ".join(f"{p} - sg AS {p}s" for p in points)
        cdfs = ", ".join(f"{normal_cdf(p + e)} AS {p}{e}_c" for p in points for e in ("", "s"))
        g = {p: f"(CASE WHEN {d} <= 0 THEN 0.0E0 ELSE ({d}) * {p}_c - m * {p}s_c END)" for p, d in points.items()}
        cte(
            f"{prefix}_lp{step}",
            f"""SELECT n.*, l.ll - 0.5E0 * pow((n.mu - {priors.mu_mean!r}E0) / {mu_sd}, 2) AS lp FROM {prefix}_node{step} n JOIN (
SELECT {k}, i, j, SUM(n * ln(greatest((({g["h1"]} - {g["h0"]}) - ({g["l1"]} - {g["l0"]})) / pw, {TINY}))) AS ll FROM (
SELECT *, {cdfs} FROM (SELECT *, {shifts} FROM (SELECT *, {scores} FROM (
SELECT *, exp(ls) AS sg, exp(mu + exp(2 * ls) / 2) AS m FROM {prefix}_terms JOIN {prefix}_node{step} USING ({k}))))) GROUP BY {k}, i, j) l USING ({k}, i, j)""",
        )
        cte(
            f"{prefix}_line{step}",
            f"""SELECT *, SUM(top) OVER (PARTITION BY {sk}, j) + {ls_prior} AS total FROM (
SELECT {k}, j, ls, dmu, dls, MAX(lp) AS top, arg_max(i, lp) AS i, arg_max(mu, lp) AS mu0 FROM {prefix}_lp{step} GROUP BY ALL)""",
        )
        cte(
            f"{prefix}_mode{step}",
            f"""SELECT {k}, i, j, mu0, ls AS ls0, dmu, dls FROM {prefix}_line{step}
QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY total DESC, j) = 1""",
        )

    ls_prior = f"(-0.5E0 * pow((ls - ({priors.log_sigma_mean!r}E0)) / {ls_sd}, 2))"
    (m0, m1, nm), (s0, s1, ns) = grid.mu, grid.log_sigma
    evaluate(
        "0",
        f"""SELECT DISTINCT {k}, {m0}E0 AS mu0, {s0}E0 AS ls0, {(m1 - m0) / (nm - 1)!r}E0 AS dmu, {(s1 - s0) / (ns - 1)!r}E0 AS dls
FROM {prefix}_terms""",
        ((0, nm - 1), (0, ns - 1)),
    )
    z = grid.zoom_half
    for step in range(1, grid.zooms + 1):
        evaluate(
            str(step),
            f"SELECT {k}, mu0, ls0, dmu / {grid.zoom_factor} AS dmu, dls / {grid.zoom_factor} AS dls FROM {prefix}_mode{step - 1}",
            ((-z, z), (-z, z)),
        )
    last = str(grid.zooms)
    at = lambda a, b: f"MAX(lp) FILTER (WHERE l.i = m.i + {a} AND l.j = m.j + {b})"
    cte(
        f"{prefix}_curve",
        f"""SELECT {k}, mu0, ls0, CASE WHEN h11 > 0 THEN h11 ELSE 1.0E0 / 9 END / (dmu * dmu) AS a,
CASE WHEN h22 > 0 THEN h22 ELSE 1.0E0 / 9 END / (dls * dls) AS b, COALESCE(h12, 0) / (dmu * dls) AS c FROM (
SELECT {", ".join(f"m.{x}" for x in keys)}, m.mu0, m.ls0, m.dmu, m.dls, 2 * {at(0, 0)} - {at(1, 0)} - {at(-1, 0)} AS h11,
  2 * {at(0, 0)} - {at(0, 1)} - {at(0, -1)} AS h22, ({at(-1, 1)} + {at(1, -1)} - {at(1, 1)} - {at(-1, -1)}) / 4 AS h12
FROM {prefix}_mode{last} m JOIN {prefix}_lp{last} l ON {k_eq('m', 'l')} GROUP BY ALL)""",
    )
    cte(
        f"{prefix}_steps",
        f"""SELECT {k}, mu0, ls0, sqrt(1 / a + (c / a) * (c / a) * vs) / {grid.steps_per_sd} AS dmu, sqrt(vs) / {grid.steps_per_sd} AS dls FROM (
SELECT *, 1 / (SUM(greatest(b - c * c / a, b * 0.01E0)) OVER (PARTITION BY {sk}) + 1 / ({ls_sd} * {ls_sd})) AS vs FROM {prefix}_curve)""",
    )
    f = grid.final_half
    evaluate("f", f"SELECT * FROM {prefix}_steps", ((-f, f), (-f, f)))
    cte(
        f"{prefix}_sig",
        f"""SELECT {k}, j, lse, t / SUM(t) OVER (PARTITION BY {k}) AS pj FROM (
SELECT *, exp(s - MAX(s) OVER (PARTITION BY {k})) AS t FROM (SELECT *, SUM(lse) OVER (PARTITION BY {sk}, j) + {ls_prior} AS s FROM (
SELECT {k}, j, ls, any_value(top) + ln(SUM(exp(lp - top))) AS lse FROM (
SELECT *, MAX(lp) OVER (PARTITION BY {k}, j) AS top FROM {prefix}_lpf) GROUP BY {k}, j, ls)))""",
    )
    cte(
        f"{prefix}_post",
        f"SELECT {k}, i, j, mu, exp(ls) AS sigma, pj * exp(lp - lse) AS prob FROM {prefix}_lpf JOIN {prefix}_sig USING ({k}, j)",
    )


REFERENCE = min(AGE_GROUPS)
STRATUM = ["symptom", "age_group"]
POST_SUMMARY = """SELECT symptom, age_group, SUM(mu * prob) AS mu_mean, sqrt(greatest(SUM(mu * mu * prob) - SUM(mu * prob) * SUM(mu * prob), 0)) AS mu_sd,
SUM(sigma * prob) AS sigma_mean, sqrt(greatest(SUM(sigma * sigma * prob) - SUM(sigma * prob) * SUM(sigma * prob), 0)) AS sigma_sd,
SUM(prob) AS mass FROM {}_post GROUP BY 1, 2"""
POST_NAMES = ["mu_mean", "mu_sd", "sigma_mean", "sigma_sd", "mass"]
posterior("stated", "delay_table", STRATUM, STATED_PRIORS, False)
oracle("fit_lognormal", POST_SUMMARY.format("stated"), POST_NAMES)
posterior("common", "delay_table", STRATUM, STATED_PRIORS, True)
oracle("duration_shared_sigma", POST_SUMMARY.format("common"), POST_NAMES)




def contrasts(prefix: str, source: str, priors: DurationPriors) -> None:
    """Age groups coupled through the reference: ``<prefix>_post`` holds the
    marginal posterior of each stratum's nodes. Sums over mu come before those
    over log sigma, in either direction."""
    posterior(f"{prefix}_own", source, STRATUM, priors, False)
    c = priors.contrast_sd
    cte(
        f"{prefix}_like",
        f"""SELECT symptom, age_group, i, j, mu, ls, ll, MAX(ll) OVER (PARTITION BY symptom, age_group) AS top, age_group = '{REFERENCE}' AS is_ref FROM (
SELECT *, lp + 0.5E0 * pow((mu - {priors.mu_mean!r}E0) / CASE WHEN age_group = '{REFERENCE}' THEN {priors.mu_sd!r}E0 ELSE {math.hypot(priors.mu_sd, c)!r}E0 END, 2) AS ll
FROM {prefix}_own_lpf)""",
    )
    cte(f"{prefix}_mus", f"SELECT DISTINCT symptom, i, mu FROM {prefix}_like WHERE is_ref")
    cte(f"{prefix}_lss", f"SELECT DISTINCT symptom, j, ls FROM {prefix}_like WHERE is_ref")
    cte(
        f"{prefix}_along",
        f"""SELECT o.symptom, o.age_group, o.j, o.ls, m.i AS ri, SUM(exp(o.ll - o.top - 0.5E0 * pow((o.mu - m.mu) / {c}, 2))) AS a
FROM {prefix}_like o JOIN {prefix}_mus m USING (symptom) WHERE NOT o.is_ref GROUP BY ALL""",
    )
    cte(
        f"{prefix}_z",
        f"""SELECT o.symptom, o.age_group, o.ri, l.j AS rj, SUM(o.a * exp(-0.5E0 * pow((o.ls - l.ls) / {c}, 2))) AS z
FROM {prefix}_along o JOIN {prefix}_lss l USING (symptom) GROUP BY ALL""",
    )
    cte(
        f"{prefix}_ref",
        f"""SELECT symptom, i AS ri, j AS rj, mu, ls, lp FROM (
SELECT r.symptom, r.i, r.j, r.mu, r.ls, r.ll - r.top + COALESCE(s.lz, 0) - 0.5E0 * pow((r.mu - {priors.mu_mean!r}E0) / {priors.mu_sd}, 2)
  - 0.5E0 * pow((r.ls - ({priors.log_sigma_mean!r}E0)) / {priors.log_sigma_sd}, 2) AS lp
FROM {prefix}_like r LEFT JOIN (SELECT symptom, ri, rj, SUM(ln(z)) AS lz FROM {prefix}_z GROUP BY ALL) s
  ON r.symptom = s.symptom AND r.i = s.ri AND r.j = s.rj WHERE r.is_ref)""",
    )
    cte(
        f"{prefix}_p",
        f"SELECT symptom, ri, rj, mu, ls, e / SUM(e) OVER (PARTITION BY symptom) AS p FROM (SELECT *, exp(lp - MAX(lp) OVER (PARTITION BY symptom)) AS e FROM {prefix}_ref)",
    )
    cte(
        f"{prefix}_back",
        f"""SELECT z.symptom, z.age_group, z.ri, o.j, SUM(p.p / z.z * exp(-0.5E0 * pow((o.ls - p.ls) / {c}, 2))) AS b
FROM {prefix}_z z JOIN {prefix}_p p USING (symptom, ri, rj)
JOIN (SELECT DISTINCT symptom, age_group, j, ls FROM {prefix}_along) o ON o.symptom = z.symptom AND o.age_group = z.age_group GROUP BY ALL""",
    )
    cte(
        f"{prefix}_post",
        f"""SELECT symptom, '{REFERENCE}' AS age_group, ri AS i, rj AS j, mu, exp(ls) AS sigma, p AS prob FROM {prefix}_p
UNION ALL SELECT symptom, age_group, i, j, mu, exp(ls), q / SUM(q) OVER (PARTITION BY symptom, age_group) FROM (
SELECT o.symptom, o.age_group, o.i, o.j, o.mu, o.ls, exp(any_value(o.ll - o.top)) * SUM(b.b * exp(-0.5E0 * pow((o.mu - m.mu) / {c}, 2))) AS q
FROM {prefix}_like o JOIN {prefix}_back b ON b.symptom = o.symptom AND b.age_group = o.age_group AND b.j = o.j
JOIN {prefix}_mus m ON m.symptom = b.symptom AND m.i = b.ri GROUP BY 1, 2, 3, 4, 5, 6)""",
    )


contrasts("linked", "delay_table", CONTRAST_PRIORS)
oracle("fit_lognormal_contrasts", POST_SUMMARY.format("linked"), POST_NAMES)


def ordered_draws(source: str, n: int, keys: list[str] = STRATUM) -> str:
    k = ", ".join(keys)
    return f"""SELECT {k}, CAST(unnest(range(first, last + 1)) AS INT) AS draw, mu, sigma FROM (
SELECT *, COALESCE(lag(last) OVER w, 0) + 1 AS first FROM (
SELECT *, CAST(floor(SUM(prob) OVER w / SUM(prob) OVER (PARTITION BY {k}) * {n} + 0.5E0) AS INT) AS last
FROM {source} WINDOW w AS (PARTITION BY {k} ORDER BY j, i ROWS UNBOUNDED PRECEDING))
WINDOW w AS (PARTITION BY {k} ORDER BY j, i)) WHERE last >= first"""


oracle(
    "draw_duration_ordered",
    f"SELECT * REPLACE (round(mu, 4) AS mu, round(sigma, 4) AS sigma) FROM ({ordered_draws('stated_post', FIT_DRAWS)})",
)

# the sensitivity analyses: three posteriors serve their variants
posterior("spread", "ext_delays", ["window_extension", *STRATUM], DEFAULT_PRIORS, False)
posterior("pooled", "delay_table", STRATUM, DEFAULT_PRIORS, True)
for _n in (FIT_DRAWS, DURATION_DRAWS):
    cte(f"spread_draws{_n}", ordered_draws("spread_post", _n, ["window_extension", *STRATUM]))
    cte(f"pooled_draws{_n}", ordered_draws("pooled_post", _n))
    cte(f"stated_draws{_n}", ordered_draws("stated_post", _n))
    cte(
        f"variant_draws{_n}",
        f"""SELECT 'window' AS analysis, CAST(window_extension AS VARCHAR) AS variant, symptom, age_group, draw, mu, sigma FROM spread_draws{_n}
UNION ALL SELECT 'sigma', 'mu', symptom, age_group, draw, mu, sigma FROM pooled_draws{_n}
UNION ALL SELECT 'sigma', 'mu_sigma', symptom, age_group, draw, mu, sigma FROM spread_draws{_n} WHERE window_extension = 3
UNION ALL SELECT 'priors', 'stated', symptom, age_group, draw, mu, sigma FROM stated_draws{_n}
UNION ALL SELECT 'priors', 'default', symptom, age_group, draw, mu, sigma FROM spread_draws{_n} WHERE window_extension = 3""",
    )
_VARIANT = "analysis, variant, symptom, age_group"
cte(
    "variant_summary",
    f"SELECT {_VARIANT}, AVG(e) AS mean, {bands('e', 'q')} FROM (SELECT *, exp(mu + sigma * sigma / 2) AS e FROM variant_draws{DURATION_DRAWS}) GROUP BY ALL",
)


def rounded(names: list[str], digits: int) -> str:
    return "* REPLACE (" + ", ".join(f"round({c}, {digits}) AS {c}" for c in names) + ")"


_SUMMARY = ["mean", *names("q")]
oracle("duration_sensitivity_draws", f"SELECT {rounded(['mu', 'sigma'], 3)} FROM variant_draws{FIT_DRAWS}")
oracle("duration_sensitivity_summary", f"SELECT {rounded(_SUMMARY, 4)} FROM variant_summary")
oracle(
    "duration_sensitivity_density",
    f"""SELECT {rounded(names(), 3)} FROM (SELECT {_VARIANT}, duration, {bands('density')} FROM (
SELECT {_VARIANT}, x AS duration, {density('x', 'mu', 'sigma')} AS density FROM (
SELECT *, unnest(range(0, 201)) * 0.5E0 AS x FROM variant_draws{FIT_DRAWS})) GROUP BY ALL)""",
)
for _name, _column, _type in (("window", "window_extension", "INT"), ("sigma", "formula_name", "VARCHAR"), ("priors", "priors", "VARCHAR")):
    _only = " AND variant <> '10'" if _name == "window" else ""
    oracle(
        f"duration_{'prior' if _name == 'priors' else _name}_sensitivity",
        f"""SELECT CAST(variant AS {_type}) AS {_column}, symptom, age_group, {", ".join(f"round({c}, 4) AS {c}" for c in _SUMMARY)}
FROM variant_summary WHERE analysis = '{_name}'{_only}""",
    )

# --- U -----------------------------------------------------------------------

oracle("quantile_bands", f"SELECT symptom, age_group, {bands('mu')} FROM dur_draws GROUP BY 1, 2", names())
oracle(
    "ranked_quantiles_ties",
    f"SELECT l_returnflag, {bands('l_quantity')} FROM lineitem GROUP BY 1",
    names(),
)
oracle(
    "ranked_quantiles",
    f"SELECT o_orderpriority, o_orderstatus, {bands('o_totalprice')} FROM orders GROUP BY 1, 2",
    names(),
)
oracle(
    "lognormal_density",
    f"""SELECT *, {density('x', '1.5E0', '0.7E0')} AS density FROM (SELECT l_orderkey, l_linenumber, l_quantity - 1 AS x FROM lineitem)""",
    ["x", "density"],
)
oracle(
    "format_interval",
    f"""SELECT c_nationkey, {interval('pi_50', 'pi_5', 'pi_95', 3)} AS large,
{interval('(pi_50 / 1000)', '(pi_5 / 1000)', '(pi_95 / 1000)', 2)} AS small
FROM (SELECT c_nationkey, {bands('c_acctbal')} FROM customer GROUP BY 1)""",
)
oracle(
    "strict_sum",
    f"""SELECT o_custkey, {strict_sum('price')} AS total, SUM(price) AS known FROM (
SELECT o_custkey, CASE WHEN o_orderkey % 1000 <> 7 THEN o_totalprice END AS price FROM orders) GROUP BY 1""",
    ["total", "known"],
)
oracle("assert_complete", "SELECT submission_id, age_group, region_name FROM submissions")
oracle("with_draws", "SELECT c_custkey, c_nationkey, draw FROM customer CROSS JOIN draw_dim")
oracle(
    "scalar_functions",
    """SELECT c_custkey, exp(c_acctbal / 10000) AS exp_x, ln(abs(c_acctbal) + 1) AS ln_x, CAST(ceil(c_acctbal / 100) AS BIGINT) AS ceil_x,
round_even(c_custkey / 2.0E0, 0) AS half_even, greatest(c_acctbal, 0.0E0) AS floor_zero, least(c_acctbal, 5000.0E0) AS cap,
CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, regexp_matches(c_name, '[05]$') AS round_name,
regexp_replace(c_name, 'Customer#0*', '') AS short_name, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS tag FROM customer""",
    ["exp_x", "ln_x", "half_even", "floor_zero", "cap"],
)
