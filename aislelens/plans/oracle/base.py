"""The retail tables as SQL, and text helpers for rounding and labels."""

from __future__ import annotations

from aislelens.functions.labels import Band

PRELUDE = """
r_orders as (
  select *,
    date_diff('second', order_date, actual_delivery_time) / 60.0::double as delivery_gap_in_minutes,
    date_diff('second', actual_delivery_time, promised_delivery_time) / 60.0::double as gap_between_promised_actual_time,
    cast(date_trunc('month', order_date) as date) as order_month_start
  from (
    select o_orderkey as order_id, o_custkey as customer_id,
      o_orderdate + to_minutes(cast((o_orderkey * 37) % 1440 as int)) as order_date,
      o_orderdate + to_minutes(cast((o_orderkey * 37) % 1440 + 30 + o_orderkey % 11 as int)) as promised_delivery_time,
      o_orderdate + to_minutes(cast((o_orderkey * 37) % 1440 + 30 + o_orderkey % 11
                                    + (o_orderkey * 13) % 56 - 25 as int)) as actual_delivery_time,
      cast(round(o_totalprice / 1000 + 1e-9, 2) as decimal(18,2)) as order_total,
      o_orderpriority as payment_method,
      cast(o_orderkey % 40 as int) as delivery_partner_id
    from orders)
),
r_items as (
  select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as int) as quantity,
    cast(round(l_extendedprice / l_quantity / 100 + 1e-9, 2) as decimal(18,2)) as unit_price
  from (
    select *, row_number() over (
      partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as line
    from lineitem)
  where line = 1
),
r_products as (
  select product_id, product_name, category, brand, margin_percentage, mrp, min_stock_level,
    cast(round(mrp * (100 - margin_percentage) * cast(0.01 as decimal(3,2)), 2) as decimal(18,2)) as price
  from (
    select p_partkey as product_id, lower(p_name) as product_name, lower(p_type) as category, p_brand as brand,
      case p_type when 'ECONOMY' then 15 when 'STANDARD' then 20 when 'SMALL' then 25
                  when 'MEDIUM' then 30 when 'LARGE' then 35 else 40 end as margin_percentage,
      cast(p_retailprice as decimal(18,2)) as mrp,
      cast(10 + p_size % 21 as int) as min_stock_level
    from part)
),
r_customers as (
  select c_custkey as customer_id, c_name as customer_name, n_name as area,
    lower(c_mktsegment) as customer_segment,
    cast(date '1995-01-01' + cast(c_custkey * 13 % 2000 as int) as date) as registration_date
  from customer join nation on n_nationkey = c_nationkey
),
r_feedback as (
  select o_orderkey as feedback_id, o_orderkey as order_id, o_custkey as customer_id, rating,
    props as feedback_text,
    case event_type when 'purchase' then 'product quality' when 'error' then 'delivery'
                    when 'click' then 'app experience' else 'customer service' end as feedback_category,
    case when rating < 3 then 'negative' when rating > 3 then 'positive' else 'neutral' end as sentiment,
    ts as feedback_date
  from (select *, cast(1 + floor(value) % 5 as int) as rating from events) e
  join orders on o_orderkey = event_id
),
r_delivery as (
  select order_id, delivery_partner_id, promised_delivery_time as promised_time,
    actual_delivery_time as actual_time, cast(late as double) as delivery_time_minutes,
    cast(cast((5 + order_id % 48) / 10.0 as decimal(4,1)) as double) as distance_km,
    case when late <= 0 then 'on time' when late <= 15 then 'slightly delayed'
         else 'significantly delayed' end as delivery_status,
    case when late > 0 then 'Traffic' end as reason_as_given,
    case when late > 0 then 'traffic' else 'not given' end as reasons_if_delayed
  from (select *, (order_id * 13) % 56 - 25 as late from r_orders)
),
r_lines as (
  select o.order_id, o.customer_id, o.order_date, o.order_month_start, o.order_total, i.product_id,
    i.quantity, i.unit_price, p.product_name, p.category, p.price, p.mrp, p.margin_percentage
  from r_orders o join r_items i using (order_id) join r_products p using (product_id)
),
r_known_lines as (
  select l.*, c.customer_name, c.area from r_lines l join r_customers c using (customer_id)
),
r_reviewed as (
  select o.*, f.feedback_id, f.rating, f.sentiment, f.feedback_category, f.feedback_date
  from r_orders o join r_feedback f using (order_id)
)
"""


def query(select: str, **ctes: str) -> str:
    """A statement over the retail tables, with further named subqueries."""
    extra = "".join(f",\n{name} as ({body})" for name, body in ctes.items())
    return f"with {PRELUDE.strip()}{extra}\n{select}"


def hu(value: str, digits: int = 2) -> str:
    """Round half away from zero, as DOUBLE."""
    v = f"cast({value} as double)"
    return f"round({v} + sign({v}) * 1e-9, {digits})"


def ratio(top: str, bottom: str) -> str:
    return f"cast({top} as double) / nullif(cast({bottom} as double), 0)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return hu(f"(cast({part} as double) * 100 / nullif(cast({whole} as double), 0))", digits)


def grow(now: str, before: str) -> str:
    return hu(f"((cast({now} as double) - {before}) * 100 / nullif(cast({before} as double), 0))")


def mean(value: str) -> str:
    return f"({ratio(f'sum({value})', f'count({value})')})"


def avg(value: str, digits: int = 2) -> str:
    return hu(mean(value), digits)


def total(value: str) -> str:
    return f"cast(sum({value}) as decimal(38,2))"


def big(value: str) -> str:
    return f"cast({value} as bigint)"


def _sql(value: object) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def label(value: str, bands: list[Band], other: object) -> str:
    arms = []
    for b in bands:
        tests = []
        if b.low is not None:
            tests.append(f"{value} {'>=' if b.closed in ('both', 'left') else '>'} {b.low}")
        if b.high is not None:
            tests.append(f"{value} {'<=' if b.closed in ('both', 'right') else '<'} {b.high}")
        arms.append(f"when {' and '.join(tests)} then {_sql(b.label)}")
    return f"case {' '.join(arms)} else {_sql(other)} end"


MONTH_TITLE = "rpad(lower(strftime({0}, '%B')), 9, ' ')"
