"""Common table expressions of the reference SQL (DuckDB dialect)."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..sources import views as v


def lst(values) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in values) + "]"


def rows(pairs) -> str:
    def lit(x):
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "VALUES " + ", ".join("(" + ", ".join(lit(x) for x in p) + ")" for p in pairs)


def R(expr: str, digits: int = 4) -> str:
    """Rounded value without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


WIDE = """wide AS (
  SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey,
         CAST(l_shipdate AS DATE) AS date, r_name AS state, n_name AS district, p_type AS crop,
         l_extendedprice AS price,
         round(l_extendedprice * (1 - l_discount), 4) AS min_price,
         round(l_extendedprice * (1 + l_tax), 4) AS max_price,
         ['enam', 'agmarknet', 'datagov'][l_linenumber % 3 + 1] AS data_source,
         r_regionkey AS regionkey, n_nationkey AS nationkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

OBS = WIDE + """, obs AS (SELECT * EXCLUDE (regionkey, nationkey) FROM wide)"""

NAMES = f"""named_wide AS (
  SELECT * REPLACE ({lst(v.STATES)}[regionkey + 1] AS state, {lst(v.DISTRICTS)}[nationkey + 1] AS district,
                    {lst(v.CROPS)}[list_position({lst(v.TYPES)}, crop)] AS crop),
         list_position({lst(v.TYPES)}, crop) AS ci
  FROM wide)"""

NAMED = WIDE + ", " + NAMES + ", named AS (SELECT * EXCLUDE (regionkey, nationkey, ci) FROM named_wide)"

RAW = NAMED + f""", raw_obs AS (
  SELECT * EXCLUDE (ci),
    CASE WHEN orderkey % 8 = 1 THEN upper(state)
         WHEN orderkey % 8 = 2 THEN {lst(v.STATE_CODES)}[regionkey + 1]
         WHEN orderkey % 8 = 3 THEN replace(state, ' ', '')
         WHEN orderkey % 8 = 4 THEN state || ' State'
         WHEN orderkey % 8 = 5 THEN '  ' || lower(state) || ' '
         WHEN orderkey % 8 = 6 AND linenumber = 7 THEN 'Unknown'
         WHEN orderkey % 8 = 7 AND linenumber = 6 THEN NULL
         ELSE state END AS state_raw,
    CASE WHEN partkey % 6 = 1 THEN lower(district)
         WHEN partkey % 6 = 2 THEN {lst(v.OLD_DISTRICTS)}[nationkey + 1]
         WHEN partkey % 6 = 3 THEN district || ' District'
         WHEN partkey % 6 = 4 THEN ' ' || upper(district) || ' '
         WHEN partkey % 6 = 5 AND linenumber = 5 THEN 'nan'
         WHEN partkey % 6 = 5 THEN replace(district, ' ', '-')
         ELSE district END AS district_raw,
    CASE WHEN suppkey % 5 = 1 THEN {lst(v.OTHER_CROPS)}[ci]
         WHEN suppkey % 5 = 4 THEN ' ' || crop ELSE crop END AS crop_raw,
    CASE WHEN linenumber = 2 THEN 'Rs ' || format('{{:,.2f}}', price)
         WHEN linenumber = 3 THEN '₹' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR)
         WHEN linenumber = 4 AND orderkey % 10 = 0 THEN 'N/A'
         WHEN linenumber = 5 AND orderkey % 9 = 0 THEN ''
         WHEN linenumber = 6 THEN CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) || '/kg'
         WHEN linenumber = 7 AND orderkey % 11 = 0 THEN '0'
         ELSE CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) END AS price_raw,
    CASE orderkey % 7 WHEN 0 THEN strftime(date, '%d/%m/%Y') WHEN 1 THEN strftime(date, '%d-%m-%Y')
         WHEN 2 THEN strftime(date, '%Y-%m-%d') WHEN 3 THEN strftime(date, '%d %b %Y')
         WHEN 4 THEN strftime(date, '%d %B %Y') WHEN 5 THEN strftime(date, '%Y-%m')
         ELSE '13/45/2020' END AS date_raw
  FROM named_wide)"""

TIE = ", ".join(v.TIE)
ORDER = ", ".join(v.ORDER)
SERIES = ", ".join(v.SERIES)


def with_obs(body: str) -> str:
    return f"WITH {OBS} {body}"


def with_named(body: str) -> str:
    return f"WITH {NAMED} {body}"


def with_raw(body: str) -> str:
    return f"WITH {RAW} {body}"


NUM = "TRY_CAST(replace(regexp_replace({0}, '[^0-9.,]', '', 'g'), ',', '') AS DOUBLE)"


def num(c: str) -> str:
    return NUM.format(c)


def any_date(c: str, as_of: str | None = None) -> str:
    tries = ", ".join(
        f"CAST(TRY_STRPTIME(trim({c}), '{f}') AS DATE)"
        for f in ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d %b %Y", "%d %B %Y")
    )
    tail = f", DATE '{as_of}'" if as_of else ""
    return f"coalesce({tries}{tail})"


SPELLINGS = (
    f"state_spell(v, s) AS ({rows(fv.STATE_SPELLINGS.items())}), "
    f"district_spell(v, s) AS ({rows(fv.DISTRICT_SPELLINGS.items())}), "
    f"crop_spell(v, s) AS ({rows(fv.CROP_SPELLINGS.items())})"
)
