from aislelens.functions import labels as L
from aislelens.plans.oracle.base import MONTH_TITLE, avg, grow, hu, label, query, ratio, total
from aislelens.plans.oracle.delivery import share

_TITLE = MONTH_TITLE.format("order_date")


def _performance(join_on: str) -> str:
    return query(
        """select *, lag(order_cnt) over w as prev_ord_cnt, lag(aov) over w as prev_aov,
             lag(avg_delivery_delay) over w as prev_avg_delivery_delay,
             lag(avg_promised_delivery_delay) over w as prev_avg_promised_delivery_delay
           from m window w as (order by order_month)""",
        m=f"""
          select order_month_start as order_month, cast(quarter(order_month_start) as int) as quarter,
            count(*) as order_cnt, {avg('order_total')} as aov, {avg('rating')} as avg_rating,
            {avg('delivery_gap_in_minutes')} as avg_delivery_delay,
            {avg('gap_between_promised_actual_time')} as avg_promised_delivery_delay
          from r_orders join (select {join_on}, rating from r_feedback) using ({join_on}) group by 1, 2""",
    )


SQL = {
    "qoq_growth": query(
        f"""select order_year, order_quarter, total_cost_price, prev_cost_price,
              {grow('total_cost_price', 'prev_cost_price')} as qoq_cost_price_growth,
              total_order_value, prev_total_order_value,
              {grow('total_order_value', 'prev_total_order_value')} as qoq_order_value_growth
            from (select *, lag(total_cost_price) over w as prev_cost_price,
                    lag(total_order_value) over w as prev_total_order_value
                  from q window w as (order by order_year, order_quarter))""",
        q=f"""select cast(year(order_date) as int) as order_year, cast(quarter(order_date) as int) as order_quarter,
                {total('price')} as total_cost_price, {total('order_total')} as total_order_value
              from r_lines group by 1, 2""",
    ),
    "mom_growth_calendar_month": query(
        f"""select *, {grow('order_cnt', 'prev_month_order_cnt')} as mom_order_size_growth_pct,
              {grow('tov', 'prev_month_tov')} as mom_revenue_growth_pct
            from (select *, lag(order_cnt) over w as prev_month_order_cnt, lag(tov) over w as prev_month_tov
                  from m window w as (order by order_month_idx))""",
        m=f"""select cast(month(order_date) as int) as order_month_idx, {_TITLE} as order_month,
                count(*) as order_cnt, {total('order_total')} as tov from r_orders group by 1, 2""",
    ),
    "mom_revenue": query(
        f"""select *, coalesce({grow('order_count', 'prev_order_count')}, 0) as mom_order_growth,
              coalesce({grow('total_order_value', 'prev_month_total_order_value')}, 0) as mom_growth
            from (select *, lag(order_count, 1, 0) over w as prev_order_count,
                    lag(total_order_value, 1, 0) over w as prev_month_total_order_value
                  from m window w as (order by order_month))""",
        m=f"""select order_month_start as order_month, count(*) as order_count,
                {total('order_total')} as total_order_value from r_orders group by 1""",
    ),
    "mau_growth": query(
        f"""select *, {grow('order_cnt', 'prev_order_cnt')} as mom_order_cnt_growth,
              {grow('aov', 'prev_aov_cnt')} as mom_avg_aov_growth
            from (select *, lag(order_cnt) over w as prev_order_cnt, lag(aov) over w as prev_aov_cnt
                  from m window w as (order by order_month))""",
        m=f"""select order_month_start as order_month, count(*) as order_cnt, {avg('order_total')} as aov
              from r_reviewed group by 1""",
    ),
    "quarterly_performance": _performance("customer_id"),
    "quarterly_performance_own_feedback": _performance("order_id"),
    "hourly_orders_rank": query(
        f"""select *, cast(dense_rank() over (partition by timing_division_per_day order by aov desc nulls last) as int)
              as aov_rank
            from (select cast(hour(order_date) as int) as order_hour,
                    {label('hour(order_date)', L.DAY_PART_BANDS, L.DAY_PART_OTHER)} as timing_division_per_day,
                    count(*) as order_cnt, {avg('order_total')} as aov
                  from r_orders group by 1, 2)"""
    ),
    "month_week_sales": query(
        f"""select *, cast(dense_rank() over (partition by order_month order by aov desc nulls last) as int) as aov_rank
            from (select {_TITLE} as order_month, 'Week ' || ((day(order_date) + 6) // 7) as week,
                    count(*) as order_cnt, {avg('order_total')} as aov
                  from r_orders group by 1, 2)"""
    ),
    "price_vs_revenue_monthly": query(
        f"""select cast(year(order_date) as int) as order_year, cast(month(order_date) as int) as order_month,
              {total('order_total')} as total_order_value, {total('unit_price * quantity')} as total_original_price,
              {hu('(sum(order_total) - sum(unit_price * quantity))')} as total_revenue,
              {hu(f"({ratio('sum(unit_price * quantity)', 'sum(order_total)')})", 6)} as total_revenue_ratio
            from r_orders join r_items using (order_id) group by 1, 2"""
    ),
    "monthly_avg_sales": query(
        f"select cast(month(order_date) as int) as order_month, {avg('order_total', 6)} as avg_sales_value "
        "from r_orders group by 1"
    ),
    "yearly_revenue": query(
        f"select cast(year(o.order_date) as int) as order_year, {total('o.order_total')} as order_total "
        "from r_orders o group by 1"
    ),
    "registrations_by_year": share(
        "r_customers", "cast(year(registration_date) as int)", "registration_year", "total_count", "regt_share"
    ),
}
