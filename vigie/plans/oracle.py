"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each query is written independently in SQL over the driver's tables: the
stand-in feed as CTEs, then the pipeline; nothing is imported from the package. Helpers below spell out the same
rules as ``vigie.functions`` (half-even rounding of the stored value, classes with
NULL/NaN guards, non-truncating pads, French month names).
"""

from __future__ import annotations

# Fixed values, written out here and not imported, so that a wrong one in the package shows.
TRAFFIC_LIGHT = ("vert", "orange", "rouge")
MONTHS_FR = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
MONTHS_FR_SHORT = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")
OVERSEAS_CODES = {20: "971", 21: "972", 22: "973", 23: "974", 24: "976"}
OLD_OVERSEAS_CODES = {"971": "9A", "972": "9B", "973": "9C", "974": "9D", "976": "9F"}
CAPACITY_RECODE = {"9A": "971", "9B": "972", "9C": "973", "9D": "974", "9F": "976"}
DEPARTMENT_MAP_COLOURS = {"vert": "seagreen1", "orange": "orange", "rouge": "red3"}
HOSPITAL_MEASURES = ("hosp", "rea", "rad", "dc", "hosp_sans_rea")
R_CUTS = (1.0, 1.5)
R_CLASS_LABELS = ("R au-dessous de 1", "R entre 1 et 1.5", "R au-dessus de 1.5")
R_SENTENCE = ("Facteur de reproduction R de <b>", "</b> au <b>", "</b>, ce qui correspond au classement ")
R_NO_ESTIMATE = "Pas d'estimation disponible pour cette date"

# Parameters of the stand-in feeds and queries.
N_AREAS = 25
MIN_ORDERS = {"tx_incid": 3, "taux_occupation_sae": 4, "tx_pos": 5}
SUPPLIED_CUTS = {"tx_incid": (10.0, 50.0), "taux_occupation_sae": (40.0, 60.0)}
NATION_WITHOUT_CODE = 19
DEATH_YEARS = (2001, 2000, 1999, 1998, 1997, 1996, 1995)
AGE_BAND, AGE_BANDS = 5, 10
AGE_GROUPS = ("1-5", "6-10", "11-15", "16-20", "21-25", "26-30", "31-35", "36-40", "41-45", "46-50")
REGION = "03"
REGION_AREAS = {"03": "NATION_3", "08": "NATION_8", "13": "NATION_13", "18": "NATION_18", "973": "NATION_23"}
REGION_TOTAL_OF = ("03", "08", "13", "18")
REGION_TOTAL_LABEL = "EUROPE administrative"
REGION_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
POSITIVITY_CUTS, ER_CUTS, ICU_CUTS = (30.0, 36.0), (15.0, 25.0), (30.0, 50.0)
POSITIVITY_LEGEND = (("vert", "moins de 30 %"), ("orange", "entre 30 et 36 %"), ("rouge", "plus de 36 %"), (None, "pas de donnée"))
DEATH_SHEET = "03"
AS_OF = "2024-02-01 09:30:00"
NEW, OLD = "total2001", "total2000"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def present(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}))"


def rnd(x: str, digits: int = 0) -> str:
    """Half to even on the stored value, from its whole decimal expansion; from 2**53 units on a double has no such fraction.

    100 decimals hold every double that does not round to 0 to at most 8 digits.
    """
    text = "printf('%.100f', abs(v))"
    kept = f"CAST(replace(left({text}, length({text}) - {100 - digits}), '.', '') AS HUGEINT)"
    rest, half = f"right({text}, {100 - digits})", f"'5{'0' * (99 - digits)}'"
    up = f"(CASE WHEN {rest} > {half} OR ({rest} = {half} AND {kept} % 2 = 1) THEN 1 ELSE 0 END)"
    return (f"list_transform([CAST({x} AS DOUBLE)], lambda v: CASE WHEN v IS NULL OR isnan(v) OR abs(v) >= {2**53} / {float(10**digits)} THEN v "
            f"ELSE sign(v) * CAST(CAST({kept} + {up} AS VARCHAR) || 'e-{digits}' AS DOUBLE) + 0.0 END)[1]")


def pad(x: str, width: int = 2) -> str:
    return f"(CASE WHEN length({x}) < {width} THEN lpad({x}, {width}, '0') ELSE {x} END)"


def classify(x: str, cuts, labels=TRAFFIC_LIGHT, closed: str = "left") -> str:
    op = "<" if closed == "left" else "<="
    whens = " ".join(f"WHEN {x} {op} {float(c)!r} THEN {_q(l)}" for c, l in zip(cuts, labels))
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL {whens} ELSE {_q(labels[-1])} END)"


def strict_sum(x: str) -> str:
    return f"(CASE WHEN count({x}) = count(*) THEN sum({x}) END)"


def r_divide(a: str, b: str) -> str:
    return (f"(CASE WHEN {b} = 0 THEN (CASE WHEN isnan({a}) THEN 'nan' WHEN {a} > 0 THEN 'inf' "
            f"WHEN {a} < 0 THEN '-inf' WHEN {a} IS NOT NULL THEN 'nan' END)::DOUBLE ELSE CAST({a} AS DOUBLE) / {b} END)")


def safe_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 AND {a} = 0 THEN 0.0::DOUBLE ELSE {r_divide(a, b)} END)"


def month_label(d: str, short: bool = False) -> str:
    names = ", ".join(_q(m) for m in (MONTHS_FR_SHORT if short else MONTHS_FR))
    return f"(strftime({d}, '%d') || ' ' || list_extract([{names}], month({d})))"


def number_text(x: str) -> str:
    s_ = f"printf('%.14e', abs({x}))"
    e = f"CAST(split_part({s_}, 'e', 2) AS INTEGER)"
    d = f"regexp_replace(replace(split_part({s_}, 'e', 1), '.', ''), '0+$', '')"
    n = f"length({d})"
    fixed = (f"(CASE WHEN {e} >= {n} - 1 THEN {d} || repeat('0', {e} - {n} + 1) "
             f"WHEN {e} >= 0 THEN substring({d}, 1, {e} + 1) || '.' || substring({d}, {e} + 2, {n}) "
             f"ELSE '0.' || repeat('0', -{e} - 1) || {d} END)")
    sci = (f"(substring({d}, 1, 1) || (CASE WHEN {n} > 1 THEN '.' || substring({d}, 2, {n} - 1) ELSE '' END) "
           f"|| 'e' || (CASE WHEN {e} < 0 THEN '-' ELSE '+' END) || {pad(f'CAST(abs({e}) AS VARCHAR)', 2)})")
    shortest = f"(CASE WHEN length({fixed}) <= length({sci}) THEN {fixed} ELSE {sci} END)"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'NaN' WHEN {x} = 'inf'::DOUBLE THEN 'Inf' "
            f"WHEN {x} = '-inf'::DOUBLE THEN '-Inf' WHEN {x} = 0 THEN '0' "
            f"ELSE (CASE WHEN {x} < 0 THEN '-' ELSE '' END) || {shortest} END)")


def dep_code(nk: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in OVERSEAS_CODES.items())
    return f"(CASE {nk} {whens} ELSE {pad(f'CAST({nk} AS VARCHAR)')} END)"


def recode(x: str, mapping, keep: bool) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {x if keep else 'NULL'} END)"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(_q(v) for v in values)})"


# ------------------------------------------------------------------ stand-in feeds as CTEs

def _rate(k: str, n: str, min_n: int) -> str:
    return f"(CASE WHEN {n} >= {min_n} THEN 100.0::DOUBLE * {k} / {n} END)"


def _measures() -> str:
    m = MIN_ORDERS
    return (f"{_rate('n_u', 'n', m['tx_incid'])} AS tx_incid, {_rate('n_f', 'n', m['tx_pos'])} AS tx_pos, "
            f"{_rate('n_o', 'n', m['taux_occupation_sae'])} AS taux_occupation_sae")


IND_CELLS = """ind_cells AS (
  SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS extract_date, c.c_nationkey AS nk,
         count(*) AS n,
         count(*) FILTER (WHERE o.o_orderstatus = 'F') AS n_f,
         count(*) FILTER (WHERE o.o_orderstatus = 'O') AS n_o,
         count(*) FILTER (WHERE o.o_orderpriority = '1-URGENT') AS n_u
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2)"""

NAT = IND_CELLS + f""",
nat AS (
  SELECT extract_date, {_measures()}
  FROM (SELECT extract_date, sum(n) AS n, sum(n_f) AS n_f, sum(n_o) AS n_o, sum(n_u) AS n_u
        FROM ind_cells GROUP BY 1))"""

DEP = NAT + f""",
geo_cells AS (
  SELECT i.*, nn.n_name, nn.n_regionkey AS rk, r.r_name
  FROM ind_cells i JOIN nation nn ON i.nk = nn.n_nationkey JOIN region r ON nn.n_regionkey = r.r_regionkey),
reg_month AS (SELECT rk, extract_date, sum(n) AS n_reg FROM geo_cells GROUP BY 1, 2),
rr AS (
  SELECT a.rk, a.extract_date, {rnd('CAST(a.n_reg AS DOUBLE) / b.n_reg', 2)} AS R
  FROM reg_month a JOIN reg_month b
    ON a.rk = b.rk AND a.extract_date = CAST(b.extract_date + INTERVAL 1 MONTH AS DATE)),
dep_m AS (
  SELECT g.extract_date, {dep_code('g.nk')} AS departement, g.n_name AS libelle_dep,
         {pad('CAST(g.rk AS VARCHAR)')} AS region, g.r_name AS libelle_reg, {_measures()}, rr.R, g.n AS n_orders
  FROM geo_cells g LEFT JOIN rr ON g.rk = rr.rk AND g.extract_date = rr.extract_date),
dep AS (
  SELECT extract_date, departement, libelle_dep, region, libelle_reg,
         tx_incid, {classify('tx_incid', SUPPLIED_CUTS['tx_incid'])} AS tx_incid_couleur,
         tx_pos, R, taux_occupation_sae,
         {classify('taux_occupation_sae', SUPPLIED_CUTS['taux_occupation_sae'])} AS taux_occupation_sae_couleur,
         n_orders
  FROM dep_m)"""

DEP_GEO = f"""dep_geo AS (
  SELECT {dep_code('n_nationkey')} AS insee_dep, {pad('CAST(n_regionkey AS VARCHAR)')} AS insee_reg,
         n_name AS nom_dep, lower(n_name) AS nom_minuscules,
         '{{"type":"Point","coordinates":[' || CAST(n_nationkey AS VARCHAR) || ',0]}}' AS geometry
  FROM nation
  UNION ALL
  SELECT NULL, NULL, 'separation', 'separation', '{{"type":"LineString","coordinates":[[0,0],[1,1]]}}')"""

REGION_GEO = f"""region_geo AS (
  SELECT {pad('CAST(r_regionkey AS VARCHAR)')} AS code, r_name AS nom,
         '{{"type":"Point","coordinates":[0,' || CAST(r_regionkey AS VARCHAR) || ']}}' AS geometry
  FROM region)"""

EV = f"""ev AS (
  SELECT {dep_code(f'(user_id % {N_AREAS})')} AS dep, CAST(ts AS DATE) AS day, event_type, value FROM events)"""

ER_VISITS = EV + """,
er_fine AS (
  SELECT dep, day AS date_de_passage,
         CASE WHEN value < 10 THEN '1' WHEN value < 50 THEN '2' ELSE '3' END AS age,
         count(*) FILTER (WHERE event_type = 'error') AS c, count(*) AS t,
         count(*) FILTER (WHERE event_type = 'purchase') AS h
  FROM ev GROUP BY 1, 2, 3),
er_all AS (
  SELECT dep, date_de_passage, age, c, t, h FROM er_fine
  UNION ALL
  SELECT dep, date_de_passage, '0', CAST(sum(c) AS BIGINT), CAST(sum(t) AS BIGINT), CAST(sum(h) AS BIGINT)
  FROM er_fine GROUP BY 1, 2),
er_visits AS (
  SELECT dep, date_de_passage, age AS sursaud_cl_age_corona, CASE WHEN c <> 0 THEN c END AS nbre_pass_corona,
         t AS nbre_pass_tot, h AS nbre_hospit_corona
  FROM er_all)"""

HOSPITAL = EV + """,
h_fine AS (
  SELECT dep, event_type AS sexe, day AS jour, count(*) AS hosp,
         count(*) FILTER (WHERE value >= 50) AS rea, count(*) FILTER (WHERE value < 10) AS rad,
         count(*) FILTER (WHERE value >= 150) AS dc
  FROM ev GROUP BY 1, 2, 3),
hospital AS (
  SELECT dep, sexe, jour, hosp, rea, rad, dc FROM h_fine
  UNION ALL
  SELECT dep, '0', jour, CAST(sum(hosp) AS BIGINT), CAST(sum(rea) AS BIGINT), CAST(sum(rad) AS BIGINT),
         CAST(sum(dc) AS BIGINT)
  FROM h_fine GROUP BY dep, jour)"""

_OLD = {k: OLD_OVERSEAS_CODES[v] for k, v in OVERSEAS_CODES.items()}
CAPACITY = f"""capacity AS (
  SELECT CAST(nn.n_regionkey AS VARCHAR) AS reg,
         (CASE nn.n_nationkey WHEN {NATION_WITHOUT_CODE} THEN NULL
          {' '.join(f'WHEN {k} THEN {_q(v)}' for k, v in _OLD.items())}
          ELSE CAST(nn.n_nationkey AS VARCHAR) END) AS dep,
         CASE WHEN s.s_acctbal >= 0 THEN CAST(floor(s.s_acctbal / 1000) AS BIGINT) END AS lits
  FROM supplier s JOIN nation nn ON s.s_nationkey = nn.n_nationkey)"""

CAPACITY_CLEAN = CAPACITY + f""",
capacity_clean AS (
  SELECT reg, dep, CAST(coalesce(sum(lits), 0) AS BIGINT) AS lits
  FROM (SELECT reg, {recode(pad('dep'), CAPACITY_RECODE, keep=True)} AS dep, lits FROM capacity)
  GROUP BY reg, dep)"""

Y = DEATH_YEARS
_MEASURES = [f"{k}{y}" for y in Y for k in ("dematerialise", "total")]


def _cum_cols(part: str) -> str:
    cols = []
    for i, y in enumerate(Y):
        for name, src in ((f"dematerialise{y}", f"m{y}"), (f"total{y}", f"t{y}")):
            run = f"CAST(sum({src}) OVER w AS DOUBLE)"
            cols.append(f"CASE WHEN date <= (SELECT v FROM last_new) THEN {run} END AS {name}" if i == 0
                        else f"{run} AS {name}")
    return ", ".join(cols)


_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE y = {y} AND is_f) AS m{y}, count(*) FILTER (WHERE y = {y}) AS t{y}" for y in Y)
_FILLED = ", ".join(f"coalesce(dd.m{y}, 0) AS m{y}, coalesce(dd.t{y}, 0) AS t{y}" for y in Y)

DEATHS = f"""od AS (
  SELECT c.c_nationkey AS nk, year(o.o_orderdate) AS y, CAST(o.o_orderdate AS DATE) AS d,
         CAST(make_date({Y[0]}, month(o.o_orderdate), 1) + CAST(day(o.o_orderdate) - 1 AS INTEGER) AS DATE) AS date,
         o.o_orderstatus = 'F' AS is_f
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE year(o.o_orderdate) IN ({', '.join(str(y) for y in Y)})),
last_new AS (SELECT max(d) AS v FROM od WHERE y = {Y[0]}),
axis AS (
  SELECT n_nationkey AS nk,
         CAST(unnest(generate_series(TIMESTAMP '{Y[0]}-01-01', TIMESTAMP '{Y[0]}-12-31', INTERVAL 1 DAY)) AS DATE) AS date
  FROM nation),
dd AS (SELECT nk, date, {_COUNTS} FROM od GROUP BY 1, 2),
dfull AS (SELECT a.nk, a.date, {_FILLED} FROM axis a LEFT JOIN dd ON a.nk = dd.nk AND a.date = dd.date),
deaths AS (
  SELECT {dep_code('nk')} AS dep, date, {_cum_cols('nk')}
  FROM dfull
  WINDOW w AS (PARTITION BY nk ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

AGE = f"""li AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m,
         CAST(least(greatest(ceil(l_quantity / {AGE_BAND}), 1), {AGE_BANDS}) AS INTEGER) AS b
  FROM lineitem),
mb AS (SELECT m, b, count(*) AS c FROM li GROUP BY 1, 2),
pm AS (SELECT m, sum(c) AS n FROM mb GROUP BY 1),
months AS (SELECT m, n, CAST(datediff('month', m, (SELECT max(m) FROM pm)) AS INTEGER) AS k FROM pm),
shares AS (
  SELECT mb.m, months.k, mb.b,
         CAST(CAST(b * {AGE_BAND} - {AGE_BAND - 1} AS VARCHAR) || '-' || CAST(b * {AGE_BAND} AS VARCHAR) AS VARCHAR) AS groupe_age,
         {rnd('CAST(CAST(100.0::DOUBLE * mb.c / months.n AS DECIMAL(9,4)) AS DOUBLE)', 1)} AS part
  FROM mb JOIN months ON mb.m = months.m)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ queries

def _national(measure: str, digits, out: str) -> str:
    v = rnd(measure, digits) if digits is not None else measure
    return f"SELECT extract_date, {v} AS {out} FROM nat WHERE {present(measure)}"


def _regional(measure: str, out_dep: str, out_nat: str, dd, dn) -> str:
    vd = rnd(f"d.{measure}", dd) if dd is not None else f"d.{measure}"
    return f"""SELECT d.extract_date, d.libelle_dep AS "Departement", {vd} AS {out_dep}, n.{out_nat}
FROM dep d LEFT JOIN ({_national(measure, dn, out_nat)}) n ON d.extract_date IS NOT DISTINCT FROM n.extract_date
WHERE d.region = {_q(REGION)} AND {present(f'd.{measure}')}"""


def _snapshot_geo(measure: str, class_sql: str) -> str:
    return f"""snap AS (
  SELECT extract_date, departement AS code_dep, libelle_dep AS "Departement", {measure}, {class_sql} AS couleur
  FROM dep WHERE {present(measure)}),
snap2 AS (SELECT * FROM snap WHERE extract_date = (SELECT max(extract_date) FROM snap)),
layer AS (
  SELECT s.extract_date, g.insee_dep AS code_dep, s."Departement", s.{measure}, s.couleur, g.geometry, g.nom_minuscules
  FROM snap2 s RIGHT JOIN dep_geo g ON s.code_dep IS NOT DISTINCT FROM g.insee_dep)"""


def _drawn(stats: str, key: str) -> str:
    return (f"FROM dep_geo g LEFT JOIN {stats} s ON g.insee_dep IS NOT DISTINCT FROM s.{key} "
            f"WHERE g.nom_dep <> 'separation'")


R_WIDE = "SELECT extract_date, " + ", ".join(
    f"max(CASE WHEN libelle_reg = {_q(r)} THEN R END) AS \"{r}\"" for r in REGION_NAMES) + (
    f" FROM (SELECT DISTINCT extract_date, libelle_reg, R FROM dep WHERE {present('R')}) GROUP BY extract_date")
_STAMP_TS = f"TIMESTAMP '{AS_OF}'"
_COMMENT = (f"{_q(R_SENTENCE[0])} || {number_text('R')} || {_q(R_SENTENCE[1])} || "
            f"{month_label('extract_date')} || {_q(R_SENTENCE[2])} || {classify('R', R_CUTS)}")

ORACLE_SQL: dict[str, str] = {
    "national_series": _with(NAT) + _national("tx_pos", 2, "tx_pos_national"),
    "national_occupancy": _with(NAT) + _national("taux_occupation_sae", None, "taux_occupation_national"),
    "regional_with_national": _with(DEP) + _regional("tx_pos", "tx_pos_departemental", "tx_pos_national", 2, 2),
    "combined_indicators": _with(DEP) + f"""
SELECT a.extract_date, a."Departement", a.tx_incid_departemental, a.tx_incid_national,
       b.tx_pos_departemental, b.tx_pos_national, c.taux_occupation_regional, c.taux_occupation_national
FROM ({_regional('tx_incid', 'tx_incid_departemental', 'tx_incid_national', None, 1)}) a
LEFT JOIN ({_regional('tx_pos', 'tx_pos_departemental', 'tx_pos_national', 2, 2)}) b
  ON a.extract_date IS NOT DISTINCT FROM b.extract_date AND a."Departement" IS NOT DISTINCT FROM b."Departement"
LEFT JOIN ({_regional('taux_occupation_sae', 'taux_occupation_regional', 'taux_occupation_national', None, None)}) c
  ON a.extract_date IS NOT DISTINCT FROM c.extract_date AND a."Departement" IS NOT DISTINCT FROM c."Departement\"""",
    "latest_snapshot_geo": _with(DEP, DEP_GEO, _snapshot_geo("tx_incid", "tx_incid_couleur")) + "SELECT * FROM layer",
    "latest_occupancy_geo": _with(DEP, DEP_GEO, _snapshot_geo("taux_occupation_sae", "taux_occupation_sae_couleur"))
    + "SELECT * FROM layer",
    "latest_class_geo": _with(DEP, DEP_GEO, _snapshot_geo("tx_pos", classify("tx_pos", POSITIVITY_CUTS)))
    + "SELECT * FROM layer",
    "r_latest_commentary": _with(DEP, REGION_GEO, f"""r AS (SELECT DISTINCT extract_date, region, libelle_reg, R FROM dep WHERE {present('R')}),
r2 AS (SELECT * FROM r WHERE extract_date = (SELECT max(extract_date) FROM r)),
j AS (SELECT r2.extract_date, g.code AS region, r2.libelle_reg, r2.R, g.nom, g.geometry
      FROM r2 RIGHT JOIN region_geo g ON r2.region IS NOT DISTINCT FROM g.code)""") + f"""
SELECT geometry, {month_label('extract_date')} AS extract_date, libelle_reg, R,
       {classify('R', R_CUTS)} AS "couleur_R", {classify('R', R_CUTS, R_CLASS_LABELS)} AS "classement_R", nom,
       CASE WHEN {present('R')} THEN {_COMMENT} ELSE {_q(R_NO_ESTIMATE)} END AS commentaire,
       {month_label(_STAMP_TS)} || ', ' || strftime({_STAMP_TS}, '%H') || 'h' AS date_maj
FROM j""",
    "r_history_wide": _with(DEP) + R_WIDE,
    "er_rate_7d": _with(ER_VISITS, DEP_GEO, """v AS (
  SELECT dep, date_de_passage, coalesce(nbre_pass_corona, 0) AS c, coalesce(nbre_pass_tot, 0) AS t
  FROM er_visits WHERE sursaud_cl_age_corona = '0'),
v7 AS (SELECT * FROM v WHERE date_de_passage > (SELECT max(date_de_passage) FROM v) - 7),
s1 AS (SELECT dep, CAST(sum(c) AS BIGINT) AS nbre_pass_corona, CAST(sum(t) AS BIGINT) AS nbre_pass_tot
       FROM v7 GROUP BY dep)""" + f""",
s2 AS (SELECT *, {rnd(safe_ratio('nbre_pass_corona', 'nbre_pass_tot') + ' * 100.0::DOUBLE', 0)} AS taux_pass FROM s1)""")
    + f"""SELECT g.insee_dep, g.insee_reg, g.nom_dep, g.geometry, s.nbre_pass_corona, s.nbre_pass_tot, s.taux_pass,
       {classify('s.taux_pass', ER_CUTS, closed='right')} AS statut_passages
""" + _drawn("s2", "dep"),
    "capacity_clean": _with(CAPACITY_CLEAN) + "SELECT reg, dep, lits FROM capacity_clean",
    "icu_saturation_region": _with(HOSPITAL, CAPACITY_CLEAN, DEP_GEO, f"""h AS (
  SELECT dep, rea FROM hospital WHERE sexe = '0' AND jour > (SELECT max(jour) FROM hospital) - 7),
s1 AS (SELECT dep, {rnd(strict_sum('rea') + ' / 7.0::DOUBLE', 0)} AS rea_7jrs FROM h GROUP BY dep),
sj AS (SELECT s1.dep, s1.rea_7jrs, c.reg, c.lits FROM s1 LEFT JOIN capacity_clean c ON s1.dep IS NOT DISTINCT FROM c.dep),
tot AS (SELECT reg, {strict_sum('rea_7jrs')} AS rea_7jrs, CAST({strict_sum('lits')} AS BIGINT) AS lits
        FROM sj GROUP BY reg),
sj2 AS (SELECT sj.dep, sj.reg, tot.rea_7jrs, tot.lits FROM sj LEFT JOIN tot ON sj.reg IS NOT DISTINCT FROM tot.reg),
sj3 AS (SELECT *, {rnd(r_divide('rea_7jrs', 'lits') + ' * 100.0::DOUBLE', 0)} AS taux_occup_reg FROM sj2)""")
    + f"""SELECT g.insee_dep, g.insee_reg, g.nom_dep, g.geometry, s.reg, s.rea_7jrs, s.lits, s.taux_occup_reg,
       {classify('s.taux_occup_reg', ICU_CUTS, closed='right')} AS statut_rea
""" + _drawn("sj3", "dep"),
    "deaths_variation": _with(DEATHS, DEP_GEO, f"""d AS (SELECT * FROM deaths WHERE {present(NEW)}),
d2 AS (SELECT dep, date, {NEW}, {OLD},
              {rnd(r_divide(f'({NEW} - {OLD})', OLD) + ' * 100.0::DOUBLE', 1)} AS taux_variation
       FROM d WHERE date = (SELECT max(date) FROM d))""")
    + f"""SELECT g.insee_dep AS dep, d2.date, d2.{NEW}, d2.{OLD}, d2.taux_variation, g.insee_reg, g.nom_dep, g.geometry
FROM d2 RIGHT JOIN dep_geo g ON d2.dep IS NOT DISTINCT FROM g.insee_dep""",
    "deaths_daily_region": _with(DEATHS, "s AS (SELECT date, " + ", ".join(
        f"{strict_sum(m)} AS {m}" for m in _MEASURES)
        + f" FROM deaths WHERE {in_list('dep', REGION_TOTAL_OF)} GROUP BY date)")
    + "SELECT *, " + ", ".join(
        f"total{y} - lag(total{y}) OVER (ORDER BY date) AS deces_journaliers_{y}" for y in Y) + " FROM s",
    "hospital_with_total": _with(HOSPITAL, f"""hd AS (SELECT *, hosp - rea AS hosp_sans_rea FROM hospital WHERE sexe = '0'),
detail AS (
  SELECT jour, {recode('dep', REGION_AREAS, keep=False)} AS dep, hosp, rea, rad, dc, hosp_sans_rea
  FROM hd WHERE {in_list('dep', REGION_AREAS)}),
total AS (
  SELECT jour, {_q(REGION_TOTAL_LABEL)} AS dep, """ + ", ".join(
        f"CAST({strict_sum(m)} AS BIGINT) AS {m}" for m in HOSPITAL_MEASURES)
        + f" FROM hd WHERE {in_list('dep', REGION_TOTAL_OF)} GROUP BY jour)")
    + """SELECT strftime(jour, '%d/%m/%Y') AS jour, dep, hosp AS hospitalisations, rea AS reanimations,
       rad AS retours_domicile, dc AS deces, hosp_sans_rea
FROM (SELECT * FROM detail UNION ALL SELECT * FROM total)""",
    "age_share_by_day": _with(AGE) + "SELECT 'age' AS workbook, strftime(m, '%d/%m') AS date, " + ", ".join(
        f"max(CASE WHEN groupe_age = {_q(g)} THEN part END) AS \"{g}\"" for g in AGE_GROUPS)
    + " FROM shares GROUP BY m",
    "age_share_latest": _with(AGE) + """SELECT 'age' AS workbook, groupe_age, strftime(m, '%d/%m') AS date, part
FROM shares WHERE k = 0""",
    "sheets_union": _with(DEATHS) + "SELECT 'deaths' AS workbook, dep, date, " + ", ".join(_MEASURES)
    + " FROM deaths",
    "deaths_sheet_range": _with(DEATHS) + "SELECT dep AS sheet, date, " + ", ".join(_MEASURES)
    + f" FROM deaths WHERE dep = {_q(DEATH_SHEET)}",
    "peak_of_series": _with(NAT, f"s AS ({_national('tx_incid', 1, 'v')})") + f"""
SELECT max(v) AS peak_value, (SELECT min(extract_date) FROM s WHERE v = (SELECT max(v) FROM s)) AS peak_date,
       max(extract_date) AS last_date, {month_label('max(extract_date)', short=True)} AS last_label
FROM s""",
    "strict_vs_lenient_sum": _with(CAPACITY) + f"""SELECT reg, dep, CAST({strict_sum('lits')} AS BIGINT) AS lits_strict,
       CAST(coalesce(sum(lits), 0) AS BIGINT) AS lits_lenient, count(*) AS n_rows
FROM capacity GROUP BY reg, dep""",
    "null_safe_join": _with(DEP, DEP_GEO, _snapshot_geo("tx_pos", classify("tx_pos", POSITIVITY_CUTS)),
                            "legend(couleur, legende) AS (VALUES " + ", ".join(
                                f"({_q(c) if c is not None else 'NULL'}, {_q(l)})" for c, l in POSITIVITY_LEGEND)
                            + ")")
    + """SELECT layer.*, legend.legende FROM layer LEFT JOIN legend ON layer.couleur IS NOT DISTINCT FROM legend.couleur""",
    "typed_mutate": _with(DEP) + f"""SELECT CAST(extract_date AS VARCHAR) AS extract_date, departement, libelle_dep, region, libelle_reg,
       {rnd('tx_incid', 1)} AS tx_incid, tx_incid_couleur, {rnd('tx_pos', 1)} AS tx_pos, {rnd('R', 1)} AS R,
       {rnd('taux_occupation_sae', 1)} AS taux_occupation_sae, taux_occupation_sae_couleur, n_orders
FROM dep""",
}


# Queries defined on top of other twins.

def _icu_map_layer() -> str:
    fill = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in DEPARTMENT_MAP_COLOURS.items())
    return ("SELECT insee_dep, nom_dep, taux_occup_reg, statut_rea, geometry, "
            f"(CASE statut_rea {fill} END) AS fill FROM ({ORACLE_SQL['icu_saturation_region']})")


def _geojson_features() -> str:
    """The variation layer after a GeoJSON text round trip: geometry keys come back sorted."""
    geom = ("json_object('coordinates', json_extract(geometry, '$.coordinates'), "
            "'type', json_extract_string(geometry, '$.type'))")
    return (f"SELECT dep, date, {NEW}, {OLD}, taux_variation, insee_reg, nom_dep, CAST({geom} AS VARCHAR) AS geometry "
            f"FROM ({ORACLE_SQL['deaths_variation']})")


def _r_history_long() -> str:
    """UNION ALL per region, so empty cells stay as NULL rows as in Spark's unpivot."""
    parts = [f"SELECT extract_date, {_q(r)} AS libelle_reg, \"{r}\" AS R FROM w" for r in REGION_NAMES]
    return _with(DEP, f"w AS ({R_WIDE})") + "\nUNION ALL\n".join(parts)


def _deaths_daily_department() -> str:
    lags = ", ".join(f"total{y} - lag(total{y}) OVER (PARTITION BY dep ORDER BY date) AS deces_journaliers_{y}"
                     for y in Y)
    return _with(DEATHS) + f"SELECT *, {lags} FROM deaths"


def _age_share_transposed() -> str:
    cols = ", ".join(f"max(CASE WHEN groupe_age = {_q(g)} THEN part END) AS \"{g}\"" for g in AGE_GROUPS)
    return _with(AGE) + f"SELECT CAST(m AS VARCHAR) AS date, {cols} FROM shares GROUP BY m"


def _visits_as_text() -> str:
    cols = ["dep", "date_de_passage", "sursaud_cl_age_corona", "nbre_pass_corona", "nbre_pass_tot"]
    return _with(ER_VISITS) + "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols) + " FROM er_visits"


ORACLE_SQL.update({
    "visits_as_text": _visits_as_text(),
    "age_share_transposed": _age_share_transposed(),
    "icu_map_layer": _icu_map_layer(),
    "geojson_features": _geojson_features(),
    "r_history_long": _r_history_long(),
    "deaths_daily_department": _deaths_daily_department(),
})


def _older(dep: str) -> str:
    """The older workbook's sheet of a department: January, eight columns."""
    a, b, c = Y[:3]
    return _with(DEATHS) + (
        f"SELECT dep AS sheet, date, dematerialise{a}, total{a}, "
        f"CASE WHEN total{a} > 0 THEN dematerialise{a} / total{a} * 100.0::DOUBLE END AS taux_dematerialisation{a}, "
        f"dematerialise{b}, total{b}, dematerialise{c}, total{c} "
        f"FROM deaths WHERE dep = {_q(dep)} AND dayofyear(date) <= 31")


_DROP_OF = "(dense_rank() OVER (ORDER BY sexe) - 1)"

ORACLE_SQL.update({
    "file_capacity": _with(CAPACITY) + "SELECT reg, dep, lits FROM capacity",
    "file_regional_unquoted": ORACLE_SQL["regional_with_national"],
    "file_history_quoted": ORACLE_SQL["r_history_wide"],
    "file_series_bom": ORACLE_SQL["national_series"],
    "file_commentary_latin1": ORACLE_SQL["r_latest_commentary"],
    "file_commentary_repaired": ORACLE_SQL["r_latest_commentary"],
    "file_features": ORACLE_SQL["geojson_features"],
    "file_feature_lines": ORACLE_SQL["geojson_features"],
    "file_drops_by_name": _with(HOSPITAL) + f"SELECT *, {_DROP_OF} AS drop FROM hospital",
    "file_listing": _with(HOSPITAL) + f"SELECT DISTINCT {_DROP_OF} AS drop FROM hospital",
    "file_texts_multiline": "SELECT doc_id, lang, text, source FROM documents",
    "orders_numbered": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice,
        row_number() OVER (ORDER BY o_orderdate::DATE, o_totalprice DESC, o_orderkey) AS place FROM orders""",
    "event_changes": "SELECT event_id, value, value - lag(value) OVER (ORDER BY ts, event_id) AS change FROM events",
    "prices_rounded": "WITH r AS (SELECT " + ", ".join(f"{rnd('l_quantity * (1 + l_tax) / 2', n)} AS x{n}" for n in (0, 1, 2))
        + " FROM lineitem) SELECT x0, x1, x2, count(*) AS rows FROM r GROUP BY ALL",
    "hospital_table_numbered": f"""SELECT *, row_number() OVER (ORDER BY strptime(jour, '%d/%m/%Y'), dep <> {_q(REGION_TOTAL_LABEL)}, dep) AS place
        FROM ({ORACLE_SQL['hospital_with_total']})""",
    "unnested_days": _with(HOSPITAL) + "SELECT dep, jour, hosp, rea FROM hospital WHERE sexe = '0'",
    "shares_with_date": _with(AGE) + "SELECT groupe_age, make_date(2020, month(m), day(m)) AS date, part FROM shares WHERE k = 0",
    "older_sheet_by_index": _older("00"),
    "older_sheet_by_name": _older("03"),
})
ORACLE_SQL["file_hospital_single"] = ORACLE_SQL["hospital_table_numbered"]
ORACLE_SQL.update({
    "file_texts_repaired": "SELECT doc_id, text FROM documents",
    "areas_wide": _with(DEP) + f"""SELECT extract_date, count(*) AS areas, string_agg(libelle_dep || '=' || {number_text('tx_pos')}, ';' ORDER BY libelle_dep) AS cells
        FROM dep WHERE tx_pos IS NOT NULL GROUP BY extract_date""",
    "areas_long": _with(DEP) + "SELECT extract_date, libelle_dep, tx_pos FROM dep WHERE tx_pos IS NOT NULL",
})
ORACLE_SQL["file_features_split"] = ORACLE_SQL["geojson_features"]
