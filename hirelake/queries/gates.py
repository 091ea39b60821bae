"""Queries on gates and contracts. Gates are asked about layers holding the whole bound tables."""

from __future__ import annotations

from hirelake.fixed_values import CLEANED_TABLES
from hirelake.queries.bindings import Views
from hirelake.queries.registry import query
from hirelake.queries.stored import fresh_layer
from hirelake.sources import layers

_RAW_ROWS = """(SELECT count(*) FROM v_jobs) + (SELECT count(*) FROM v_companies) + (SELECT count(*) FROM v_salaries)
 + (SELECT count(*) FROM v_benefits) + (SELECT count(*) FROM v_employee_counts) + (SELECT count(*) FROM v_industries)"""
_SKILL_ROWS = "(SELECT count(*) FROM v_skills_industries)"


_kept: dict[tuple[str, str], tuple[str, dict[str, int]]] = {}


def _store(v: Views, layer: str, names) -> int:
    """Put whole bound tables into a layer and return their rows; each is written once a session and folder."""
    key = (v.spark.sparkContext.applicationId, v.folder)
    if key not in _kept:
        _kept[key] = (fresh_layer(v, "kept"), {})
    kept, counts = _kept[key]
    counts |= layers.load_raw_replace({n: getattr(v, n) for n in names if n not in counts}, kept)
    for name in names:
        v.spark.sql(f"CREATE OR REPLACE VIEW {layer}.{name} AS SELECT * FROM {kept}.{name}")
    return sum(counts[n] for n in names)


def _frame(v: Views, rows: list, schema: str):
    return v.spark.createDataFrame(rows, schema)


@query(f"""SELECT 'raw' AS layer, true AS present, {_RAW_ROWS} + {_SKILL_ROWS} AS row_count
UNION ALL SELECT 'cleaned', true, 0""")
def create_namespaces(v):
    raw, cleaned = fresh_layer(v, "raw"), fresh_layer(v, "cleaned")
    layers.create_namespaces(v.spark, [raw, cleaned])
    counts = {raw: _store(v, raw, v.raw()), cleaned: 0}
    present = [(n.split("_")[0], layers.namespace_exists(v.spark, n), rows) for n, rows in counts.items()]
    return _frame(v, present, "layer string, present boolean, row_count bigint")


@query("""SELECT 'stored' AS layer, true AS present, count(*) AS row_count FROM v_companies
UNION ALL SELECT 'absent', false, 0""")
def namespace_exists(v):
    layer = fresh_layer(v)
    counts = {"stored": (layer, _store(v, layer, ["companies"])), "absent": (f"{layer}_absent", 0)}
    rows = [(label, layers.namespace_exists(v.spark, n), c) for label, (n, c) in counts.items()]
    return _frame(v, rows, "layer string, present boolean, row_count bigint")


@query("""SELECT 'salaries' AS table_name, true AS present, count(*) AS row_count FROM v_salaries
UNION ALL SELECT 'benefits', false, 0""")
def table_exists(v):
    layer = fresh_layer(v)
    counts = {"salaries": _store(v, layer, ["salaries"]), "benefits": 0}
    rows = [(t, layers.table_exists(v.spark, layer, t), c) for t, c in counts.items()]
    return _frame(v, rows, "table_name string, present boolean, row_count bigint")


@query("""SELECT 'industries' AS table_name, count(*) > 0 AS nonempty, count(*) AS row_count FROM v_industries
UNION ALL SELECT 'benefits', false, 0""")
def table_nonempty(v):
    layer = fresh_layer(v)
    layers.replace_table(v.benefits.filter("job_id IS NULL"), layer, "benefits", skip_empty=False)
    counts = {"industries": _store(v, layer, ["industries"]), "benefits": 0}
    rows = [(t, layers.table_nonempty(v.spark, layer, t), c) for t, c in counts.items()]
    return _frame(v, rows, "table_name string, nonempty boolean, row_count bigint")


def _gate_states(v: Views, label: str, names, gate):
    """The gate's answer as a layer goes from absent to complete, with the rows it then holds."""
    names = list(names)
    layer = fresh_layer(v, label)
    states = [("no layer", gate(v.spark, f"{layer}_absent"), 0), ("no tables", gate(v.spark, layer), 0)]
    rows = _store(v, layer, names[:-1])
    layers.replace_table(getattr(v, names[-1]).filter("false"), layer, names[-1], skip_empty=False)
    states.append(("empty table", gate(v.spark, layer), 0))
    rows += _store(v, layer, names[-1:])
    states.append(("complete", gate(v.spark, layer), rows))
    return _frame(v, states, "state string, needed boolean, row_count bigint")


def _gate_sql(rows: str) -> str:
    return f"""SELECT 'no layer' AS state, true AS needed, 0 AS row_count UNION ALL SELECT 'no tables', true, 0
UNION ALL SELECT 'empty table', true, 0 UNION ALL SELECT 'complete', false, {rows}"""


@query(_gate_sql(f"{_RAW_ROWS} + {_SKILL_ROWS}"))
def needs_extraction(v):
    return _gate_states(v, "raw", v.raw(), layers.needs_extraction)


@query(_gate_sql(_RAW_ROWS))
def needs_cleaning(v):
    return _gate_states(v, "cleaned", CLEANED_TABLES, layers.needs_cleaning)


@query("SELECT * FROM v_industries")
def run_if_needed(v):
    layer = fresh_layer(v)

    def job():
        return layers.replace_table(v.industries, layer, "industries")

    for _ in range(2):
        layers.run_if_needed(layers.needs_refresh(v.spark, layer, ["industries"]), job)
    return layers.scan_table(v.spark, layer, "industries")


@query("SELECT job_id, company_id, title FROM v_jobs")
def require_columns(v):
    essential = ("job_id", "company_id", "title")
    return layers.require_columns(v.jobs, essential).select(*essential)


@query("SELECT company_id, name FROM v_companies")
def require_nonempty(v):
    return layers.require_nonempty(v.companies, "companies").select("company_id", "name")


@query("SELECT company_id, industry FROM v_industries")
def default_empty_table(v):
    schema = "company_id bigint, industry string"
    given = layers.default_empty_table(v.industries.select("company_id", "industry"), schema)
    return given.unionByName(layers.default_empty_table(None, schema, v.spark))
