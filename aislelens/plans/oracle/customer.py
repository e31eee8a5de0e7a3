"""Cohorts and customer value."""

from aislelens.functions import labels as L
from aislelens.plans.oracle.base import avg, grow, hu, label, pct, query, total

# Cohorts by a self-join and a distinct count.
_COHORT = {
    "born": "select customer_id, min(order_month_start) as birth_month from r_orders where customer_id is not null group by customer_id",
    "cells": """
      select birth_month, cast(datediff('month', birth_month, order_month_start) as int) as month_number,
        count(distinct customer_id) as customer_cnt
      from r_orders join born using (customer_id) group by all""",
    "rates": f"""
      select c.*, z.customer_cnt as first_month_customer_cnt_locked,
        {pct('c.customer_cnt', 'z.customer_cnt')} as retention_rate
      from cells c join cells z on z.birth_month = c.birth_month and z.month_number = 0""",
}


def _avg_retention(digits: int) -> str:
    return query(
        f"select month_number, {hu('avg(retention_rate)', digits)} as avg_retention_rate from rates group by all",
        **_COHORT,
    )


_RFM = {
    "spending": """
      select customer_id, customer_name, count(*) as frequency, sum(order_total) as monetary,
        datediff('day', cast(max(order_date) as date),
                 (select cast(max(order_date) as date) from r_orders)) as recency
      from r_orders join r_customers using (customer_id) group by all""",
    "scored": f"""
      select *, {label('recency', L.RECENCY_BANDS, L.SCORE_OTHER)} as r_score,
        {label('frequency', L.FREQUENCY_BANDS, L.SCORE_OTHER)} as f_score,
        {label('monetary', L.MONETARY_BANDS, L.SCORE_OTHER)} as m_score
      from spending""",
    "bins": f"""
      select r_score, f_score, m_score, cast(r_score * 100 + f_score * 10 + m_score as int) as rfm_bins,
        {avg('recency')} as avg_recency, {avg('frequency')} as avg_frequency, {avg('monetary')} as avg_monetary,
        count(distinct customer_id) as cust_cnt,
        {pct('count(distinct customer_id)', '(select count(distinct customer_id) from r_orders)')} as cust_size_pct
      from scored group by all""",
}

_SEGMENT = "case " + " ".join(
    f"when recency_score >= {r} and frequency_score >= {f} and monetary_score >= {m} then '{name}'"
    for r, f, m, name in L.RFM_SEGMENTS
) + f" else '{L.RFM_SEGMENT_OTHER}' end"


def _lifetime(join_on: str) -> str:
    return query(f"""
      select customer_id, customer_name, count(o.order_id) as order_cnt,
        {total('order_total')} as total_value_spent, {avg('order_total')} as aov,
        {avg('delivery_gap_in_minutes')} as avg_delivery_delay,
        {avg('gap_between_promised_actual_time')} as avg_promised_actual_time,
        {pct("count(*) filter (sentiment <> 'negative')", 'count(*)')} as good_review_pct,
        {pct("count(*) filter (sentiment = 'negative' and feedback_category = 'delivery')", 'count(*)')}
          as delivery_wise_bad_category_pct
      from r_orders o
      join r_customers using (customer_id)
      join (select {join_on}, sentiment, feedback_category from r_feedback) using ({join_on})
      group by customer_id, customer_name""")


_BAD_SHARE = """
  select customer_id, count(*) as order_frequency,
    count(*) filter (sentiment = 'negative') as bad_review_orders,
    cast(count(*) filter (sentiment = 'negative') * 100 // count(*) as double) as bad_review_orders_pct
  from r_reviewed group by customer_id having count(*) > 1"""

SQL = {
    "cohort_retention": query("select * from rates", **_COHORT),
    "cohort_avg_retention": _avg_retention(3),
    "cohort_avg_retention_two_digits": _avg_retention(2),
    "cohort_avg_retention_excl_100": query(
        f"select {hu('avg(retention_rate)', 6)} as avg_retention_rate from rates where retention_rate <> 100",
        **_COHORT,
    ),
    "cohort_month_change": query(
        f"""select cohort_month, month_number, active_customers, before as prev_active_customer_count,
              coalesce({grow('active_customers', 'before')}, 0) as monthly_change_pct,
              case when active_customers > before then '{L.RETENTION_UP}' end as retention_improve_cycle
            from (select birth_month as cohort_month, month_number, customer_cnt as active_customers,
                    lag(customer_cnt) over (partition by birth_month order by month_number) as before from cells)""",
        **_COHORT,
    ),
    "rfm_fixed_bins": query("select * from bins", **_RFM),
    "rfm_lapsed_vs_active": query(
        f"""select 'lapsed' as segment, {hu('avg(avg_monetary)')} as avg_monetary from bins where r_score = 5
            union all
            select 'active', {hu('avg(avg_monetary)')} from bins where r_score <> 5""",
        **_RFM,
    ),
    "rfm_ntile_segments": query(
        f"""select {_SEGMENT} as rfm_segment, count(*) as customer_count, {avg('frequency')} as avg_buying_frequency,
              {avg('monetary')} as avg_money_spend,
              {pct('count(*)', '(select count(*) from r_customers)')} as cust_contribution_pct
            from tiled group by all""",
        spending=_RFM["spending"],
        tiled=f"""
          select *, {label('recency', L.RECENCY_QUINTILE_BANDS, L.RECENCY_QUINTILE_OTHER)} as recency_score,
            ntile(5) over (order by frequency desc, customer_id) as frequency_score,
            ntile(5) over (order by monetary desc, customer_id) as monetary_score
          from spending""",
    ),
    "customer_lifetime_value": _lifetime("customer_id"),
    "customer_lifetime_value_own_feedback": _lifetime("order_id"),
    "customer_category_basket": query(
        f"""select customer_id, customer_name, category, count(*) as order_size, {total('order_total')} as order_value
            from r_known_lines group by all having count(*) > 1"""
    ),
    "repeat_customer_pct": query(
        """select cast(count(*) filter (n > 1) * 100 // count(*) as double) as repeated_customer_pct
           from (select customer_id, count(*) as n from r_orders where customer_id is not null group by all)"""
    ),
    "customer_negative_review_pct": query(_BAD_SHARE),
    "avg_negative_review_pct": query(
        f"select {hu('avg(bad_review_orders_pct)')} as avg_pct_of_bad_reviews from ({_BAD_SHARE})"
    ),
    "repeat_product_customers": query(
        """select customer_id, customer_name, product_id, product_name, count(*) as size_count
           from r_known_lines group by all having count(*) > 1"""
    ),
}
