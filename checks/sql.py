"""SQL that computes the registered queries over the same tables on its own."""

from __future__ import annotations

from checks.study import CODES, RACES, SETTINGS, SEXES, STEMS

NAMES = {
    "Psychotic": "psychotic",
    "Mood": "mood",
    "Bipolar (I/II)": "bipolar_",
    "Anxiety": "anxiety",
    "Personality": "personality",
    "Conduct": "conduct",
    "ADHD": "adhd",
    "Substance Use": "substance_use",
    "Alcohol": "alcohol",
    "Opioid": "opioid",
    "Cannabis": "cannabis",
}
DX = [NAMES[name] for name in STEMS["dx"]]
SUD = [NAMES[name] for name in STEMS["sud"]]
FLAGS = DX + SUD
BANDS = ["1-11", "12-17", "18-34", "35-49", "50+"]
Z = 1.959963984540054


def values(pairs: dict[str, str | None]) -> str:
    return ", ".join(f"('{v}', {'null' if c is None else repr(c)})" for v, c in pairs.items())


def code_list(name: str) -> str:
    for named in CODES.values():
        for raw, codes in named.items():
            if NAMES[raw] == name:
                return ", ".join(f"'{code}'" for code in codes)
    raise KeyError(name)


def band_case(age: str) -> str:
    return (
        f"case when {age} = 0 then '0' when {age} between 1 and 11 then '1-11' when {age} between 12 and 17 then '12-17' "
        f"when {age} between 18 and 34 then '18-34' when {age} between 35 and 49 then '35-49' when {age} >= 50 then '50+' end"
    )


VIEWS = f"""
race_map(value, category) as (values {values(RACES)}),
sex_map(value, category) as (values {values(SEXES)}),
setting_map(value, category) as (values {values(SETTINGS)}),
background as (
  select cast(c_custkey as varchar) as patientid, c_mktsegment as race, c_nationkey % 5 as sex,
         cast(c_nationkey % 7 as varchar) as siteid from customer),
typepatient as (
  select cast(o_custkey as varchar) as patientid,
         cast(case when o_orderkey % 97 <> 0 then (o_custkey * 37) % 80 + year(o_orderdate) - 1995 end as varchar) as age,
         o_orderpriority as visit_type, o_orderkey as visit_id from orders),
pdiagnose as (
  select cast(o_custkey as varchar) as patientid, l_orderkey as visit_id,
         cast(290 + l_partkey % 200 as varchar) || '.' || cast(l_suppkey % 2 as varchar) || '0' as dsmno
  from lineitem join orders on l_orderkey = o_orderkey)
"""

FIRST = """
first_visit as (
  select patientid, siteid, race, sex, age, visit_type from (
    select b.patientid, b.siteid, b.race, cast(b.sex as varchar) as sex, cast(v.age as integer) as age, v.visit_type,
           row_number() over (partition by b.patientid order by cast(v.age as integer), v.visit_id) as rn
    from background b join typepatient v on v.patientid = b.patientid
    where b.race in (select value from race_map where category is not null)
      and cast(b.sex as varchar) in (select value from sex_map where category is not null)
      and v.visit_type in (select value from setting_map where category is not null)
      and v.age is not null) x
  where rn = 1)
"""

COUNTS = (
    "wide as (select patientid, "
    + ", ".join(f"count(case when dsmno in ({code_list(name)}) then 1 end) as {name}" for name in FLAGS)
    + " from (select distinct patientid, dsmno from pdiagnose) d group by patientid)"
)

COHORT = f"""
cohort as (
  select f.patientid, r.category as race, s.category as sex, t.category as visit_type, f.age,
         {band_case("f.age")} as age_categorical,
         {", ".join(f"cast(w.{name} > 0 as integer) as {name}" for name in FLAGS)},
         {" + ".join(f"cast(w.{name} > 0 as integer)" for name in SUD)} as sud_count,
         {" + ".join(f"cast(w.{name} > 0 as integer)" for name in DX)} as dx_count
  from first_visit f join wide w on w.patientid = f.patientid
  join race_map r on r.value = f.race join sex_map s on s.value = f.sex join setting_map t on t.value = f.visit_type
  where f.age > 0),
flagged as (
  select *, cast(sud_count >= 1 as integer) as any_sud, cast(sud_count >= 2 as integer) as ge2_sud from cohort),
scope as (select * from flagged where dx_count > 0 and sex <> 'Others')
"""


def over(select: str, *parts: str) -> str:
    return "with " + ",".join((VIEWS, *parts)) + select


def scoped(select: str, *parts: str) -> str:
    return over(select, FIRST, COUNTS, COHORT, *parts)


# Every subject counts in its own stratum and in ALL.
STRATA = "strata as (select 'ALL' as stratum, * from scope union all select race as stratum, * from scope)"
LEVELS = """
levels as (
  select distinct 'age_categorical' as dimension, age_categorical as level from flagged
  union select distinct 'sex', sex from flagged),
stratum_names as (select distinct race as stratum from flagged union select 'ALL'),
counted as (
  select g.stratum, l.dimension, l.level,
         (select count(*) from strata s where s.stratum = g.stratum
            and case when l.dimension = 'sex' then s.sex else s.age_categorical end = l.level) as n,
         (select count(*) from strata s where s.stratum = g.stratum) as total
  from stratum_names g cross join levels l)
"""


def stacked(columns: list[str], source: str, stratum: str = "stratum") -> str:
    """Counts of flags, long."""
    return " union all ".join(
        f"select {stratum} as stratum, '{c}' as level, cast(sum({c}) as bigint) as n from {source} group by {stratum}"
        for c in columns
    )


def table1(columns: str, where: str) -> str:
    p = "cast(n as double) / nullif(cast(total as double), 0)"
    return scoped(
        f" select {columns} from (select *, {p} as p, {Z} * sqrt(p * (1.0 - p) / total) as half from counted) c where {where}",
        STRATA,
        LEVELS,
    )


def table2() -> str:
    flags = ["any_sud", "ge2_sud", *SUD]
    rows = """groups as (
      select race, 'Total' as age, s.* exclude (race) from scope s
      union all select race, age_categorical as age, s.* exclude (race) from scope s where age_categorical <> '1-11'),
    shape as (select race, age from (select distinct race from flagged) cross join
              (select distinct age_categorical as age from flagged where age_categorical <> '1-11' union select 'Total')
              where age = 'Total' or (race, age) in (select race, age_categorical from flagged))"""
    parts = ["select race, age, 'sample_size' as measure, cast(count(patientid) as double) as value, count(patientid) as n from (select sh.race, sh.age, g.patientid from shape sh left join groups g on g.race = sh.race and g.age = sh.age) group by race, age"]
    parts += [
        f"select race, age, '{f}' as measure, cast(sum({f}) as double) / nullif(cast(count({f}) as double), 0) * 100 as value, count({f}) as n "
        f"from (select sh.race, sh.age, g.{f} from shape sh left join groups g on g.race = sh.race and g.age = sh.age) group by race, age"
        for f in flags
    ]
    return scoped(" select race, age, measure, value, n from (" + " union all ".join(parts) + ")", rows)


def table2_wide() -> str:
    order = ["sample_size", "any_sud", "ge2_sud", *SUD]
    bands = ["Total", *BANDS[1:]]
    position = "case measure " + " ".join(f"when '{m}' then {i}" for i, m in enumerate(order, 1)) + " end"
    picked = ", ".join(f"max(case when age = '{b}' then value end) as \"{b}\"" for b in bands)
    return f"select race, {position} as ord, measure, {picked} from ({table2()}) t2 group by race, measure"


def dummies(reference: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(term, variable, level) of the design, reference levels left out."""
    found = [("race", x) for x in ("AA", "MR", "NHPI")]
    found += [("age_categorical", x) for x in BANDS[1:]]
    found += [("sex", x) for x in ("F", "M")]
    found += [("visit_type", x) for x in ("Inpatient", "Mental health center", "Outpatient")]
    return [(f"{v}_{x}", v, x) for v, x in found if f"{v}_{x}" not in reference]


REFERENCE = ("race_AA", "sex_F", "age_categorical_50+", "visit_type_Mental health center")
T3 = "t3 as (select * from scope where sex <> 'Others' and age_categorical <> '1-11')"


def totals(source: str, stratum: str, target: str, term: str, condition: str) -> str:
    """Events with a term, once as seen and once as a maximum-likelihood fit has to predict them."""
    return (
        f"select {stratum} as stratum, '{target}' as target, '{term}' as term, cast(sum({target}) as bigint) as observed, "
        f"cast(sum({target}) as double) as fitted from {source} where {condition} group by {stratum}"
    )


def table3_fit() -> str:
    parts = []
    for target in ("any_sud", "ge2_sud"):
        for stratum in ("'ALL'", "race"):
            parts.append(totals("t3", stratum, target, "intercept", "true"))
            for term, variable, level in dummies(REFERENCE):
                if variable != "race" or stratum == "'ALL'":
                    parts.append(totals("t3", stratum, target, term, f"{variable} = '{level}'"))
    return scoped(" " + " union all ".join(parts), T3)


def table4_fit(more_than: int = 30) -> str:
    parts = [totals("scope", "race", "any_sud", "intercept", "true")]
    parts += [
        totals("scope", "race", "any_sud", name, f"{name} = 1") + f" having count(*) > {more_than}"
        for name in DX
        if name != "substance_use"
    ]
    return scoped(" " + " union all ".join(parts))


NEWTON_STEPS = 10


def newton(cases: str, terms: list[str], *parts: str) -> str:
    """Maximum-likelihood logistic fits, written out as SQL.

    ``cases`` names a table ``stratum, target, pid, n, y`` of covariate patterns and
    ``ones`` a table ``stratum, target, pid, term`` of the terms a pattern has.
    Directions of -1, 0 and 1 that no pattern without or full of events speaks against are found by trying all of them:
    patterns that one of them moves are decided and left out, terms that they move have no finite estimate. Each Newton step
    on the rest sums the information matrix and solves it by Gauss-Jordan
    elimination, one pivot term after the other, leaving out terms that the pivots before them make up.
    """
    key = "stratum, target"
    k = range(len(terms))
    dot = " + ".join(f"x{i} * d{i}" for i in k)
    flags = ", ".join(f"max(cast(term = '{term}' as integer)) as x{i}" for i, term in enumerate(terms))
    xs, ds = ", ".join(f"x{i}" for i in k), ", ".join(f"d{i}" for i in k)
    free_dims = " and ".join(f"(h{i} = 1 or d{i} = 0)" for i in k)
    ctes = list(parts)
    ctes.append(f"vectors as materialized (select {key}, pid, n, y, {flags} from ones join {cases} using ({key}, pid) group by {key}, pid, n, y)")
    ctes.append(f"merged as materialized (select {key}, {xs}, sum(n) as n, sum(y) as y from vectors group by {key}, {xs})")
    ctes.append(f"has as (select {key}, {', '.join(f'max(x{i}) as h{i}' for i in k)} from merged group by {key})")
    ctes.append("dirs as materialized (select * from " + ", ".join(f"(values (-1), (0), (1)) t{i}(d{i})" for i in k) + ")")
    ctes.append(
        f"""growing as materialized (select {key}, {ds} from merged join has using ({key}), dirs where {free_dims} group by {key}, {ds}
        having bool_and(case when y = 0 then {dot} <= 0 when y = n then {dot} >= 0 else {dot} = 0 end))"""
    )
    ctes.append(f"decided as materialized (select distinct {key}, {xs} from merged join growing using ({key}) where {dot} <> 0)")
    ctes.append(
        "moved as materialized ("
        + " union all ".join(f"select {key}, '{term}' as term, bool_or(d{i} > 0) as up, bool_or(d{i} < 0) as down from growing group by {key}" for i, term in enumerate(terms))
        + ")"
    )
    ctes.append(f"live as materialized (select v.* from vectors v where not exists (select 1 from decided d where d.stratum = v.stratum and d.target = v.target and {' and '.join(f'd.x{i} = v.x{i}' for i in k)}))")
    ctes.append(f"used as materialized (select distinct {key}, o.pid, o.term from ones o join live using ({key}, pid))")
    ctes.append(f"free as materialized (select distinct {key}, term from used)")
    ctes.append(f"b0 as materialized (select {key}, term, cast(0 as double) as b from free)")
    for step in range(NEWTON_STEPS):
        last = step == NEWTON_STEPS - 1
        ctes.append(
            f"""w{step} as materialized (select {key}, pid, n, y, 1.0::double / (1.0::double + exp(-sum(b))) as p
            from used join b{step} using ({key}, term) join live using ({key}, pid) group by {key}, pid, n, y)"""
        )
        ctes.append(
            f"""h{step} as (select {key}, a.term as i, b.term as j, sum(n * p * (1 - p)) as v
            from used a join used b using ({key}, pid) join w{step} using ({key}, pid) group by {key}, a.term, b.term)"""
        )
        ctes.append(
            f"""r{step} as (select {key}, term as i, '=' as j, sum(y - n * p) as v
            from used join w{step} using ({key}, pid) group by {key}, term)"""
        )
        unit = f"union all select {key}, a.term, '+' || b.term, cast(a.term = b.term as double) from free a join free b using ({key})"
        ctes.append(
            f"""m{step}_0 as (select {key}, i, j, coalesce(v, 0) as v
            from (select {key}, a.term as i, b.term as j from free a join free b using ({key})) left join h{step} using ({key}, i, j)
            union all select * from r{step} {unit if last else ""})"""
        )
        for k, term in enumerate(terms):
            ctes.append(
                f"""m{step}_{k + 1} as (select {key}, i, j,
                case when centre is null or abs(centre) < 1e-9 then v when i = '{term}' then v / centre else v - across * down / centre end as v
                from (select *, max(case when i = '{term}' and j = '{term}' then v end) over (partition by {key}) as centre,
                      max(case when j = '{term}' then v end) over (partition by {key}, i) as across,
                      max(case when i = '{term}' then v end) over (partition by {key}, j) as down from m{step}_{k}))"""
            )
        ctes.append(f"s{step} as materialized (select * from m{step}_{len(terms)})")
        ctes.append(
            f"""b{step + 1} as materialized (select {key}, term, b + case when p.v > 0.5 then s.v else 0 end as b from b{step}
            join s{step} s using ({key}) join s{step} p using ({key}) where s.i = term and s.j = '=' and p.i = term and p.j = term)"""
        )
    final = NEWTON_STEPS
    ctes.append(f"made_up as (select {key}, i as term from s{final - 1} where i = j and v < 0.5)")
    ctes.append(
        f"""loose as (select distinct {key}, s.i as term from s{final - 1} s join made_up m using ({key}) where s.j = m.term and (s.i = m.term or abs(s.v) > 1e-9))"""
    )
    ctes.append(
        f"""fitted as (select o.stratum, o.target, o.term,
        case when d.stratum is null and l.stratum is not null then null
             when coalesce(up, false) and coalesce(down, false) then null when up then 'infinity'::double when down then '-infinity'::double
             when own.term is null then null else b end as beta,
        case when up or down then 'infinity'::double else sqrt(v) end as se,
        case when d.stratum is not null then 'separated' when l.stratum is not null then 'singular' else 'ok' end as status
        from (select distinct {key}, term from ones) o left join b{final} b using ({key}, term)
        left join (select {key}, i as term, v from s{final - 1} where j = '+' || i) using ({key}, term)
        left join moved using ({key}, term)
        left join (select distinct {key}, term from free except select {key}, term from loose) own using ({key}, term)
        left join (select distinct {key} from decided) d using ({key}) left join (select distinct {key} from made_up) l using ({key}))"""
    )
    ctes.append(f"sizes as (select {key}, cast(sum(n) as bigint) as n from {cases} group by {key})")
    return scoped(
        f""" select {key}, term, round(beta, 6) as beta, case when beta is not null then round(se, 6) end as se,
        case when isinf(beta) then case when beta > 0 then beta else 0 end else round(exp(beta), 6) end as or_,
        case when isinf(beta) then 0 else round(exp(beta - {Z} * se), 6) end as lo,
        case when isinf(beta) then 'infinity'::double else round(exp(beta + {Z} * se), 6) end as hi, n, status
        from fitted f join sizes using ({key})""",
        *ctes,
    )


def table3_odds() -> str:
    design = dummies(REFERENCE)
    ones = " union all ".join(
        f"select stratum, target, pid, '{term}' as term from cases where {variable} = '{level}'"
        + (" and stratum = 'ALL'" if variable == "race" else "")
        for term, variable, level in design
    )
    return newton(
        "cases",
        [*(term for term, _, _ in design), "intercept"],
        T3,
        """grouped as (select stratum, race, age_categorical, sex, visit_type, count(*) as n, sum(any_sud) as any_sud, sum(ge2_sud) as ge2_sud
        from (select 'ALL' as stratum, * from t3 union all select race as stratum, * from t3)
        group by stratum, race, age_categorical, sex, visit_type)""",
        """cases as materialized (select stratum, target, concat_ws('|', race, age_categorical, sex, visit_type) as pid,
        race, age_categorical, sex, visit_type, n, y from grouped unpivot (y for target in (any_sud, ge2_sud)))""",
        f"ones as materialized ({ones} union all select stratum, target, pid, 'intercept' from cases)",
    )


def table4_odds(more_than: int = 30) -> str:
    dx = [d for d in DX if d != "substance_use"]
    flags = ", ".join(dx)
    ones = " union all ".join(
        f"select stratum, target, pid, '{d}' as term from cases where {d} = 1 "
        f"and stratum in (select race from scope group by race having sum({d}) > {more_than})"
        for d in dx
    )
    return newton(
        "cases",
        [*dx, "intercept"],
        f"""cases as materialized (select race as stratum, 'any_sud' as target, concat_ws('|', {flags}) as pid, {flags},
        count(*) as n, sum(any_sud) as y from scope group by race, {flags})""",
        f"ones as materialized ({ones} union all select stratum, target, pid, 'intercept' from cases)",
    )


def crude() -> str:
    cells = " union all ".join(
        f"select race as stratum, '{d}' as term, count(*) as n, count_if({d} = 1 and any_sud = 1) as a, "
        f"count_if({d} = 1 and any_sud = 0) as b, count_if({d} = 0 and any_sud = 1) as c, "
        f"count_if({d} = 0 and any_sud = 0) as d from scope group by race"
        for d in DX
        if d != "substance_use"
    )
    lo = "ln(cast(a as double) * d / (cast(b as double) * c))"
    se = "sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)"
    ok = "a > 0 and b > 0 and c > 0 and d > 0"
    return scoped(
        f""" select stratum, term, n, cast(a as bigint) as a, cast(b as bigint) as b, cast(c as bigint) as c, cast(d as bigint) as d,
        round(case when {ok} then exp({lo}) end, 6) as or_,
        round(case when {ok} then exp({lo} - {Z} * {se}) end, 6) as lo,
        round(case when {ok} then exp({lo} + {Z} * {se}) end, 6) as hi from ({cells}) q"""
    )


CODE_VALUES = ", ".join(
    f"('{kind}', '{NAMES[raw]}', '{code}')" for kind, named in CODES.items() for raw, codes in named.items() for code in codes
)

LOGS = """
log as (
  select case when event_type = 'error'
    then strftime(ts, '%Y-%m-%d %H:%M:%S,') || lpad(cast(millisecond(ts) % 1000 as varchar), 3, '0')
         || ' - runner.' || event_type || ' - ERROR - Unable to handle event ' || event_id
    else strftime(ts, '%Y-%m-%d %H:%M:%S,') || lpad(cast(millisecond(ts) % 1000 as varchar), 3, '0')
         || ' - runner.' || event_type || ' - INFO - Finished the function [' || event_type || '] in '
         || printf('%.6e', value) || ' seconds' end as value
  from events),
timed as (
  select '[' || event_type || ']' as fn, count(*) as n,
         cast(sum(cast(value as decimal(28, 12))) as double) as total
  from events where event_type <> 'error' group by event_type),
times as (select fn, n, total, total / n as average from timed)
"""

GRAPH = """
mention(module, side, name, node_type, location, description) as (
  select distinct 'make_' || p_partkey, 0, 'part_' || lower_part, 'file-csv', 'parts/' || lower_part, 'ingredient'
  from (select p_partkey, unnest([p_partkey // 3, p_partkey // 2]) as lower_part from part) where lower_part <> p_partkey
  union all select 'make_' || p_partkey, 1, 'part_' || p_partkey, 'DB-dbTable', 'stock.parts.' || p_partkey, 'product' from part
  union all select 'line_' || l_orderkey || '_' || l_linenumber, 0, 'part_' || l_partkey, 'file-csv', 'parts/' || l_partkey, 'ordered part' from lineitem
  union all select 'line_' || l_orderkey || '_' || l_linenumber, 1, 'order_' || l_orderkey, 'file-csv', 'orders/' || l_orderkey, 'order' from lineitem
  union all select 'ship_' || o_orderkey, 0, 'order_' || o_orderkey, 'DB-dbTable', 'sales.orders.' || o_orderkey, 'order' from orders
  union all select 'ship_' || o_orderkey, 1, 'customer_' || o_custkey, 'file-meta', 'customers/' || o_custkey, 'customer' from orders),
nodes as (
  select node_name, node_type, summary from (
    select *, row_number() over (partition by node_name order by module, side, node_type, summary) as rn from (
      select name as node_name, node_type,
             '{"description":"' || description || '","location":"' || location || '","type":"' || node_type || '"}' as summary,
             module, side from mention)) where rn = 1
  union all select distinct module, 'module', '' from mention),
edges as (
  select distinct case when side = 0 then name else module end as node_from,
         case when side = 0 then module else name end as node_to from mention),
"""
ANCESTORS = """
key as (select 'customer_' || max(o_custkey) as node_name from orders),
above(node_name) as (
  select node_name from key
  union select e.node_from from edges e join above a on e.node_to = a.node_name)
"""


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["category_membership"] = over(
        """ select patientid, age, visit_type, visit_id from typepatient
        where visit_type in (select value from setting_map where category is not null) and age is not null"""
    )
    sql["persons_eligible"] = over(
        """ select patientid, race, cast(sex as varchar) as sex from background
        where race in (select value from race_map where category is not null)
        and cast(sex as varchar) in (select value from sex_map where category is not null)"""
    )
    sql["exclusion_list"] = over(
        """ select patientid, race, sex from background where race <> 'BUILDING' and race <> 'HOUSEHOLD' and sex <> 4"""
    )
    sql["sanitise_names"] = """select p_partkey,
        lower(regexp_replace(replace(replace(replace(replace(raw, '/', '_'), ' ', '_'), '-', '_'), ',', '_'),
              '\\([^)]*\\)', '', 'g')) as name
        from (select p_partkey, p_name || ', ' || p_type || ' (' || p_brand || '/X) Size-' || p_size as raw from part)"""
    sql["code_list_long"] = """
        select distinct 'part' as kind, category, code from (
          select 'brand_' as category, p_brand as code from part
          union all select 'type_or_class', p_type from part where p_size % 2 = 0
          union all select 'size_class', cast(p_size as varchar) || '.00' from part) where code is not null"""
    sql["code_list_files"] = """
        select distinct kind, category, code from (
          select 'part' as kind, 'brand_' as category, p_brand as code from part
          union all select 'part', 'type_or_class', p_type from part where p_size % 2 = 0
          union all select 'size', 'size_class', cast(p_size as varchar) || '.00' from part) where code is not null"""
    sql["appended_parts"] = "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus in ('F', 'O', 'P')"
    sql["category_name_list"] = """
        select distinct kind, raw_name, lower(replace(replace(raw_name, ' ', '_'), '-', '_')) as name
        from (select 'part' as kind, p_name || ' ' || p_type as raw_name from part
              union all select 'supplier', s_name || '-' || s_nationkey from supplier)"""
    sql["code_categories"] = over(
        f""" , codes(kind, category, code) as (values {CODE_VALUES})
        select kind, category, count(*) as n, count(distinct patientid) as patients
        from pdiagnose join codes on code = dsmno group by kind, category"""
    )
    sql["relabel_map"] = over(
        """ select visit_id, patientid, coalesce(category, visit_type) as visit_type
        from typepatient left join setting_map on value = visit_type"""
    )
    chosen = "select cast(o_orderkey as varchar) as k, o_orderstatus as c from orders where o_totalprice > 150000"
    sql["category_membership_large"] = f"""select l_orderkey, l_linenumber as value, l_partkey as category from lineitem
        where cast(l_orderkey as varchar) in (select k from ({chosen}))"""
    sql["relabel_large"] = f"""select coalesce(c, cast(l_orderkey as varchar)) as l_orderkey, l_linenumber as value, l_partkey as category
        from lineitem left join ({chosen}) m on m.k = cast(l_orderkey as varchar)"""
    sql["relabel_file"] = sql["relabel_large"]
    age = "try_cast(age as integer)"
    sql["age_bands"] = over(
        f""" select {band_case(age)} as age_categorical, count(*) as n, min({age}) as youngest, max({age}) as oldest
        from typepatient where {age} > 0 group by 1"""
    )
    sql["first_visit"] = over(" select patientid, race, sex, age, visit_type from first_visit", FIRST)
    # a customer number stands for a person at each of two sites
    sites = """two as (select b.patientid, cast((c_nationkey + s) % 7 as varchar) as siteid, b.race, (c_nationkey + s) % 5 as sex
        from background b join customer on cast(c_custkey as varchar) = b.patientid, (values (0), (1)) t(s)),
      sited as (select v.*, cast((c_nationkey + visit_id % 2) % 7 as varchar) as siteid from typepatient v join customer on cast(c_custkey as varchar) = v.patientid)"""
    first = FIRST.replace("from background b join typepatient v on v.patientid = b.patientid", "from two b join sited v on v.patientid = b.patientid and v.siteid = b.siteid")
    sql["first_visit_composite"] = over(
        """ select patientid as id, siteid, race, sex, age, visit_type from first_visit""", sites, first.replace("partition by b.patientid", "partition by b.patientid, b.siteid")
    )
    for keep, order in (("lowest", "asc"), ("highest", "desc")):
        sql[f"dedupe_{keep}"] = f"""select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority
            from (select *, row_number() over (partition by o_custkey order by o_totalprice {order}, o_orderkey {order}) as rn from orders)
            where rn = 1"""
    sql["dedupe_any"] = "select distinct o_custkey, o_orderpriority from orders"
    sql["filtered_join"] = """select c_custkey, c_name, o_orderkey, o_totalprice from customer join orders on c_custkey = o_custkey
        where c_mktsegment = 'BUILDING' and o_totalprice > 250000"""
    sql["key_range"] = """select o_custkey >= 100 and o_custkey < 1100 as inside, count(*) as n, min(o_custkey) as lowest,
        max(o_custkey) as highest from orders group by 1"""
    sql["max_id"] = "select max(c_custkey) as max_id from customer"
    sql["distinct_codes"] = over(
        """ select f.patientid, f.race, f.sex, f.age, f.visit_type, d.dsmno from first_visit f
        join (select distinct patientid, dsmno from pdiagnose) d on d.patientid = f.patientid""",
        FIRST,
    )
    flags = ", ".join(FLAGS)
    sql["flag_counts_wide"] = over(f" select patientid, {flags} from wide", COUNTS)
    placed = "(select distinct patientid, dsmno, cast((c_nationkey + visit_id % 2) % 7 as varchar) as siteid from pdiagnose join customer on cast(c_custkey as varchar) = patientid) d"
    wide = COUNTS.replace("(select distinct patientid, dsmno from pdiagnose) d group by patientid", f"{placed} group by patientid, siteid")
    sql["flag_counts_composite"] = over(f" select patientid as id, siteid, {flags} from wide", wide.replace("(select patientid, ", "(select patientid, siteid, ", 1))
    sql["flag_counts_distinct"] = sql["flag_counts_wide"]
    sql["master_table"] = over(
        f""" select f.patientid, r.category as race, s.category as sex, t.category as visit_type, f.age,
        {band_case("f.age")} as age_categorical, {flags}
        from first_visit f join wide w on w.patientid = f.patientid join race_map r on r.value = f.race
        join sex_map s on s.value = f.sex join setting_map t on t.value = f.visit_type where f.age > 0""",
        FIRST,
        COUNTS,
    )
    sql["patient_flags"] = scoped(
        f" select patientid, race, sex, visit_type, age, age_categorical, {flags}, sud_count, dx_count, any_sud, ge2_sud from scope"
    )
    sql["cohort_summary"] = scoped(
        """ select stratum, count(*) as n, cast(sum(any_sud) as bigint) as any_sud, cast(sum(ge2_sud) as bigint) as ge2_sud
        from strata group by stratum""",
        STRATA,
    )
    sql["level_lists"] = scoped(
        """ select distinct 'race' as dimension, race as level from flagged
        union select distinct 'age_categorical', age_categorical from flagged union select distinct 'sex', sex from flagged"""
    )
    for key, column in (("counts_age", "age_categorical"), ("counts_sex", "sex")):
        sql[key] = scoped(
            f""" select g.stratum, l.level, count(s.patientid) as n from (select distinct race as stratum from flagged union all select 'ALL') g
            cross join (select distinct {column} as level from flagged) l
            left join strata s on s.stratum = g.stratum and s.{column} = l.level group by g.stratum, l.level""",
            STRATA,
        )
    sql["counts_sud"] = scoped(" " + stacked(SUD, "strata"), STRATA)
    sql["counts_dx"] = scoped(" " + stacked(DX, "strata"), STRATA)
    everyone = "select stratum, 'everyone' as dimension, '' as level, count(*) as n from strata group by stratum"
    by_level = "select stratum, dimension, level, n from counted"
    by_flag = " union all ".join(
        f"select stratum, '{label}' as dimension, level, n from ({stacked(names, 'strata')})"
        for label, names in (("substances", ["any_sud", "ge2_sud", *SUD]), ("disorders", DX))
    )
    sql["metrics"] = scoped(
        f" select * from ({everyone} union all {by_level} union all {by_flag})", STRATA, LEVELS
    )
    sql["table1_total"] = table1("dimension, level, n, total, round(p * 100, 6) as pct", "stratum = 'ALL'")
    sql["table1_strata"] = table1(
        "stratum, dimension, level, total, round(p * 100, 6) as pct, round((p - half) * 100, 6) as lo, round((p + half) * 100, 6) as hi",
        "stratum <> 'ALL'",
    )
    whole = "printf('%-9s: %-8s (%.1f)', level, cast(n as varchar), p * 100)"
    stratum = "printf('%-9s: %-8s (%.1f-%.1f)', level, printf('%.1f', p * 100), (p - half) * 100, (p + half) * 100)"
    sql["table1_text"] = table1(
        f"stratum, dimension, level, case when stratum = 'ALL' then {whole} else {stratum} end as line", "true"
    )
    sql["table2_long"] = f"select race, age, measure, n, round(value, 6) as value from ({table2()})"
    sql["table2_wide"] = (
        "select race, ord, measure, "
        + ", ".join(f'round("{b}", 6) as "{b}"' for b in ("Total", *BANDS[1:]))
        + f" from ({table2_wide()})"
    )
    cells = ", ".join(
        f"""case when measure = 'sample_size' then cast(cast("{b}" as bigint) as varchar) else printf('%.1f', "{b}") end as "{b}\""""
        for b in ("Total", *BANDS[1:])
    )
    sql["table2_text"] = f"select race, ord, measure, {cells} from ({table2_wide()})"
    sql["figure1_bars"] = scoped(
        f""" , sized as (select race, count(*) as size from scope group by race),
        bars as (select b.stratum as race, b.level as diagnosis, cast(b.n as double) / cast(size as double) * 100 as pct
                 from ({stacked(DX, "scope", "race")}) b join sized s on s.race = b.stratum)
        select race, diagnosis, round(pct, 6) as pct, case race when 'AA' then 1 when 'NHPI' then 2 when 'MR' then 3 else 0 end as ord,
               printf('%.1f', pct) as label
        from bars where diagnosis in (select diagnosis from bars group by diagnosis having max(pct) >= 3)"""
    )
    sql["covariate_patterns"] = scoped(
        """ select race, age_categorical, sex, visit_type, count(*) as n, cast(sum(any_sud) as bigint) as any_sud,
        cast(sum(ge2_sud) as bigint) as ge2_sud from t3 group by race, age_categorical, sex, visit_type""",
        T3,
    )
    columns = ", ".join(f"cast({v} = '{x}' as integer) as \"{t}\"" for t, v, x in dummies(REFERENCE))
    sql["dummy_design"] = scoped(
        f""" , copies as (select 'ALL' as stratum, * from t3 union all select race as stratum, * from t3)
        select stratum, {columns}, 1 as intercept, count(*) as n, cast(sum(any_sud) as bigint) as any_sud,
        cast(sum(ge2_sud) as bigint) as ge2_sud from copies group by stratum, race, age_categorical, sex, visit_type""",
        T3,
    )
    sql["support_filter"] = scoped(
        f""" select stratum, level as term, n as support from ({stacked(DX, "scope", "race")})
        where n > 30 and level <> 'substance_use'"""
    )
    sql["crude_odds_ratio"] = crude()
    sql["table3_odds"] = table3_odds()
    sql["table4_odds"] = table4_odds()
    sql["table3_fit_totals"] = table3_fit()
    sql["table4_fit_totals"] = table4_fit()
    lo, se = "ln(cast(a as double) * d / (cast(b as double) * c))", "sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)"
    sql["table3_one_factor"] = scoped(
        f""" , c as (select g.stratum, g.target, count_if(sex = 'M' and y = 1) as a, count_if(sex = 'M' and y = 0) as b,
          count_if(sex = 'F' and y = 1) as c, count_if(sex = 'F' and y = 0) as d, count(*) as n from (
            select stratum, sex, 'any_sud' as target, any_sud as y from copies
            union all select stratum, sex, 'ge2_sud', ge2_sud from copies) g group by stratum, target)
        , told as (select *, a + b > 0 as m, c + d > 0 as f, case when a + b = 0 then null when b = 0 then 1 when a = 0 then -1 else 0 end as sm,
            case when c + d = 0 then null when d = 0 then 1 when c = 0 then -1 else 0 end as sf from c),
        judged as (select *, case when sm = 0 and sf = 0 then 'ok' when coalesce(sm, 0) = 0 and coalesce(sf, 0) = 0 then 'singular' else 'separated' end as status,
            case when sm <> 0 and sf = 0 or sm <> 0 and sf = -sm then sm when sm = 0 and sf <> 0 then -sf end as sign from told)
        select stratum, target, n, status,
          case when status = 'ok' then round({lo}, 6) else sign * 'infinity'::double end as beta, case when status = 'ok' then round({se}, 6) when sign <> 0 then 'infinity'::double end as se,
          case when status = 'ok' then round(exp({lo}), 6) when sign > 0 then 'infinity'::double when sign < 0 then 0 end as or_,
          case when status = 'ok' then round(exp({lo} - {Z} * {se}), 6) when sign <> 0 then 0 end as lo,
          case when status = 'ok' then round(exp({lo} + {Z} * {se}), 6) when sign <> 0 then 'infinity'::double end as hi
        from judged""",
        T3,
        "copies as (select 'ALL' as stratum, * from t3 union all select race as stratum, * from t3)",
    )
    sql["lineage_nodes"] = "with " + GRAPH.rstrip().rstrip(",") + " select * from nodes"
    sql["lineage_edges"] = "with " + GRAPH.rstrip().rstrip(",") + " select * from edges"
    recursive = "with recursive " + GRAPH + ANCESTORS
    sql["lineage_ancestors"] = recursive + " select node_name from above where node_name not in (select node_name from key)"
    sql["lineage_subgraph"] = recursive + """
        , kept as (select node_from, node_to from edges where node_from in (select node_name from above) and node_to in (select node_name from above))
        select k.node_from, f.node_type as type_from, k.node_to, t.node_type as type_to
        from kept k join nodes f on f.node_name = k.node_from join nodes t on t.node_name = k.node_to"""
    halves = ", ".join(f"cast(sum(('0x' || substr(md5(row), {at}, 8))::bigint) as bigint) as {name}_sum" for at, name in ((1, "first"), (9, "second")))
    sql["lineage_roundtrip"] = (
        "with " + GRAPH.rstrip().rstrip(",") + f""" select is_module, node_type, count(*) as n, {halves} from (
          select node_type = 'module' as is_module, node_type, node_name || '|' || node_type || '|' || summary as row from nodes
          union all select false, 'edge', node_from || '|' || node_to from edges) group by is_module, node_type"""
    )
    makers = GRAPH.replace("mention(module", "every_mention(module", 1).replace("),\nnodes as", "),\nmention as (select * from every_mention where starts_with(module, 'make_')),\nnodes as", 1)
    sql["graph_appended"] = "with " + makers.rstrip().rstrip(",") + f""" select place || part as part, count(*) as n, {halves} from (
        select ' nodes' as part, node_name || '|' || node_type || '|' || summary as row from nodes
        union all select ' edges', node_from || '|' || node_to from edges), (values ('stored'), ('loaded')) t(place) group by 1"""
    sql["managed_table"] = """select o_orderstatus, count(*) as n, 'o_orderkey, o_orderstatus, priced' as columns, 1 as versions
        from orders where o_totalprice > 1000 group by o_orderstatus"""
    sql["key_ranges_balanced"] = """select 16 as ranges, count(*) as rows, true as balanced from orders"""
    sql["figure1_headers"] = "select *, case diagnosis " + " ".join(f"when '{name}' then '{raw}'" for raw, name in NAMES.items()) + f" end as header from ({sql['figure1_bars']})"
    sql["log_errors"] = "with " + LOGS + " select value from log where contains(value, 'ERROR')"
    sql["log_fields"] = "with " + LOGS + """ select split_part(value, ' - ', 2) as logger, split_part(value, ' - ', 3) as level,
        count(*) as n, min(split_part(value, ' - ', 1)) as earliest, max(split_part(value, ' - ', 1)) as latest
        from log group by 1, 2"""
    sql["log_timing"] = "with " + LOGS + " select fn, n, total, average from times"
    sql["log_timing_bars"] = "with " + LOGS + """ select fn, n, round(average, 6) as average,
        cast(floor(30 * average / (select max(average) from times)) as integer) as steps,
        rpad(repeat('▥', cast(floor(30 * average / (select max(average) from times)) as integer)), 30, ' ') as bar from times"""
    sql["log_latest"] = (
        "with last_day as (select * from events where cast(ts as date) = (select max(cast(ts as date)) from events)),"
        + LOGS.replace("from events", "from last_day")
        + " select fn, n, total, average from times"
    )
    sql["log_report"] = "with " + LOGS + """ select printf('%40s %10d %7.2f %10.2e [%s]', fn, n, total, average,
        rpad(repeat('▥', cast(floor(30 * average / (select max(average) from times)) as integer)), 30, ' ')) as line from times"""
    ratios = ", ".join(
        f"case when {c} = 'infinity'::double then 'inf' when {c} is not null then printf('%.2f', {c}) end as {n}"
        for c, n in (("or_", "odds"), ("lo", "lo"), ("hi", "hi"))
    )
    for name in ("table3", "table4"):
        sql[f"{name}_text"] = f"""select replace(stratum, 'ALL', 'Total') || ' (' || n || ')' as heading, target, term, {ratios}
            from ({sql[f"{name}_odds"]})"""
    return sql
