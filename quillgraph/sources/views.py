"""Bridging views: the message, claim and person shapes of the engine, made from the driver's tables by SQL that Spark and other
engines read alike. Table names stand in braces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mails: a vote, three replies (support with a quote, oppose, resolved), a bug report, a status note; all signed.
MAIL = """
select o_orderkey as ord, concat('<', cast(o_orderkey as varchar(20)), '@mail.example>') as message_id,
  case when o_orderkey % 6 between 1 and 3 then concat('<', cast(o_orderkey - 1 as varchar(20)), '@mail.example>') end as in_reply_to,
  concat('u.', cast(o_orderkey % 200 as varchar(20)), '@d0.example') as from_addr,
  case when o_orderkey % 13 = 0 then '' else concat('Name ', cast(o_orderkey % 200 as varchar(20))) end as from_name,
  case when o_orderkey % 6 = 0 then concat('[VOTE] Adopt plan ', cast(o_orderkey % 40 as varchar(20)))
       when o_orderkey % 6 < 4 then concat('Re: [VOTE] Adopt plan ', cast((o_orderkey - o_orderkey % 6) % 40 as varchar(20)))
       when o_orderkey % 6 = 4 then concat('[BUG] BZ-', cast(o_orderkey % 300 as varchar(20)), ' report')
       else concat('Status of mod_rewrite, week ', cast(o_orderkey % 52 as varchar(20))) end as subject,
  concat(case when o_orderkey % 6 = 0 then concat('I propose plan ', cast(o_orderkey % 40 as varchar(20)), ' for mod_ssl.', chr(10), 'My vote: +1')
       when o_orderkey % 6 = 1 then concat('In <', cast(o_orderkey - 1 as varchar(20)), '@mail.example> we read', chr(10), '> I propose a plan', chr(10), '> for <nobody@nowhere>', chr(10), '+1 from me', chr(10))
       when o_orderkey % 6 = 2 then concat('-1 for now. The worker MPM', chr(10), 'would break, see <', cast(o_orderkey - 2 as varchar(20)), '@mail.example>.')
       when o_orderkey % 6 = 3 then 'Resolved: adopted. Thanks to all.'
       when o_orderkey % 6 = 4 then concat('Bug BZ-', cast(o_orderkey % 300 as varchar(20)), ' was assigned today.', chr(10), 'See BZ-', cast((o_orderkey * 7) % 300 as varchar(20)), ' in Httpd-Worker too.')
       else concat('  Nothing new in week ', cast(o_orderkey % 52 as varchar(20)), '. ') end,
    chr(10), '-- ', chr(10), 'Name ', cast(o_orderkey % 200 as varchar(20)), chr(10), 'sent on time') as body_raw,
  o_orderdate as ts
from {orders}
"""

#: Claims: one for each (order, line number), exclusive and other types, some with a reversal in the text.
CLAIMS = """
select l.k * 10 + l.n as ord,
  case l.k % 5 when 0 then 'ASSIGNED' when 1 then 'DECIDED' when 2 then 'SUPPORTS' when 3 then 'OPPOSES' else 'MENTIONS' end as type,
  concat('cust:', cast(o.o_custkey % 200 as varchar(20))) as subject_id, concat('part:', cast(l.partkey % 7 as varchar(20))) as object_id,
  concat(case when l.flag = 'R' then 'Decision changed: ' else 'Noted: ' end, 'customer ', cast(o.o_custkey % 200 as varchar(20)), ' takes part ', cast(l.partkey % 7 as varchar(20)), ' at ', lower(o.o_orderpriority)) as text,
  round(l.discount * 10, 2) as confidence, o.o_orderdate as valid_from,
  concat('order:', cast(l.k as varchar(20))) as source_id, concat('<', cast(l.k as varchar(20)), '@orders.example>') as message_id,
  concat('line ', cast(l.n as varchar(20)), ' of order ', cast(l.k as varchar(20)), ' ', lower(o.o_orderpriority)) as excerpt, cast(l.n % 3 as int) as char_start
from (select l_orderkey as k, l_linenumber as n, min(l_partkey) as partkey, min(l_discount) as discount, min(l_returnflag) as flag from {lineitem} group by l_orderkey, l_linenumber) l
join {orders} o on o.o_orderkey = l.k
"""

#: Persons: names and mail addresses that partly agree.
PERSONS = """
select c.c_custkey as ord, concat('N', cast(c.c_custkey % p.m as varchar(20)), ' ', lower(c.c_mktsegment)) as name,
  concat('U.', cast(c.c_custkey % p.m as varchar(20)), '@d', cast(cast(floor(c.c_custkey / p.m) as bigint) % 2 as varchar(20)), '.example') as email
from {customer} c cross join (select cast(floor((max(c_custkey) + 1) / 3) as bigint) as m from {customer}) p
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(sql: str, *names: str):
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    return read


mail, claims, persons = _view(MAIL, "orders"), _view(CLAIMS, "orders", "lineitem"), _view(PERSONS, "customer")


def claims_part(spark: SparkSession, sf_dir: str, i: int, n: int) -> DataFrame:
    """The i-th of n parts of claims() by order; the n parts are the whole. The tables are cut before anything is shuffled."""
    own = lambda name, key: table(spark, sf_dir, name).where(F.pmod(F.xxhash64(key), F.lit(n)) == i)
    return spark.sql(CLAIMS, orders=own("orders", "o_orderkey"), lineitem=own("lineitem", "l_orderkey"))


def claims_ranges(spark: SparkSession, sf_dir: str, n: int) -> list[DataFrame]:
    """claims() in n parts by ranges of orders; the n parts are the whole. The bounds are about quantiles: where they lie decides the parts' sizes only."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    bounds = [int(x) for x in o.approxQuantile("o_orderkey", [i / n for i in range(1, n)], 0.1 / n)] if n > 1 else []
    ends = [None, *(bounds or [0] * (n - 1)), None]  # without orders there are no claims

    def own(rows: DataFrame, key: str, low: int | None, high: int | None) -> DataFrame:
        rows = rows if low is None else rows.where(F.col(key) >= low)
        return rows if high is None else rows.where(F.col(key) < high)

    return [spark.sql(CLAIMS, orders=own(o, "o_orderkey", a, b), lineitem=own(l, "l_orderkey", a, b)) for a, b in zip(ends, ends[1:], strict=False)]


def plain(sql: str) -> str:
    """The SQL with the braces gone, for engines where the tables have these names."""
    return sql.replace("{", "").replace("}", "")
