from aislelens.functions import labels as L
from aislelens.plans.oracle.base import avg, hu, label, pct, query, total

_GAP_FLAG = label("delivery_gap_in_minutes", L.DELIVERY_GAP_BANDS, L.DELIVERY_GAP_OTHER)
_DISTANCE = label("distance_km", L.DISTANCE_FLAG_BANDS, L.DISTANCE_FLAG_OTHER)
_AHEAD = "gap_between_promised_actual_time"
_PATTERN = f"case when {_AHEAD} < 0 then '{L.LATE}' else '{L.ON_TIME}' end"
_NEXT = f"""
  select *, lead(order_date) over w as next_date, lead(order_total) over w as next_total,
    lead({_AHEAD}) over w as next_ahead
  from r_orders window w as (partition by customer_id order by order_date, order_id)"""
_BAD = "sentiment = 'negative'"
_BAD_DELIVERY = f"{_BAD} and feedback_category = 'delivery'"
_MOVES = "\n".join(
    f"when sign(next_total - order_total) = {v} and sign(next_ahead - {_AHEAD}) = {t} then '{text}'"
    for (v, t), text in L.VALUE_AND_TIMING.items()
)


def share(table: str, key: str, name: str, count: str, part: str, where: str = "true") -> str:
    return query(
        f"""select {name}, n as {count}, {hu('(n * 100.0::double / sum(n) over ())', 6)} as {part}
            from (select {key} as {name}, count(*) as n from {table} where {where} group by 1)"""
    )


SQL = {
    "delivery_timing_feedback": query(
        f"""select delivery_timing_range, {hu('gap')} as avg_gap_between_promised_and_actual_time, order_cnt,
              bad as negative_fdbk_cnt, bad_delivery as neg_fdbk_for_delivery_cnt,
              {pct('bad_delivery', 'bad')} as neg_fdbk_for_delivery_among_all_neg_reviews_pct,
              {pct('bad_delivery', 'sum(n) over ()')} as neg_review_for_delivery_among_all_orders_pct,
              {pct('order_cnt', 'sum(order_cnt) over ()')} as order_contribution_pct
            from (
              select {label(_AHEAD, L.DELIVERY_TIMING_BANDS, L.DELIVERY_TIMING_OTHER)} as delivery_timing_range,
                avg({_AHEAD}) as gap, count(o.order_id) as order_cnt, count(*) as n,
                count(*) filter ({_BAD}) as bad, count(*) filter ({_BAD_DELIVERY}) as bad_delivery
              from r_feedback f left join r_orders o on o.order_id = f.order_id group by 1)"""
    ),
    "hourly_delivery": query(
        f"""select cast(hour(order_date) as int) as order_hour, count(*) as customer_visit_count,
              {avg(_AHEAD)} as avg_promised_delivery_gap_timing,
              count(*) filter ({_AHEAD} > 0) as on_time_delivery_count,
              count(*) filter ({_AHEAD} < 0) as late_delivery_count
            from r_orders group by 1"""
    ),
    "late_penalty": query(
        f"""select {_PATTERN} as delivery_pattern, count(*) as sample_size, {avg('days')} as avg_delivery_delay,
              cast(quantile_cont(days, 0.5) as double) as median_days_to_next_order
            from (select *, datediff('day', cast(order_date as date), cast(next_date as date)) as days from followed)
            where days is not null group by 1""",
        followed=_NEXT,
    ),
    "churn_after_delivery": query(
        f"""select {_PATTERN} as delivery_pattern, count(*) as total_order_count,
              {pct('(count(*) - count(next_date))', 'count(*)')} as churn_rate_pct from followed group by 1""",
        followed=_NEXT,
    ),
    "gap_flag_revenue": query(
        f"""select {_GAP_FLAG} as delivery_gap_flag, count(*) as total_order_cnt,
              {total('order_total')} as avg_total_value, {avg('delivery_gap_in_minutes')} as avg_delivery_gap
            from r_orders where delivery_gap_in_minutes <> 0 group by 1"""
    ),
    "late_rate_buckets": query(
        f"""select {label('late_rate', L.LATE_RATE_BANDS, L.LATE_RATE_OTHER)} as delivery_pattern,
              count(*) as customer_count, {hu('avg(aov)')} as avg_order_value, {total('spent')} as total_order_value
            from (select customer_id, {pct(f'count(*) filter ({_AHEAD} < 0)', 'count(*)')} as late_rate,
                    {avg('order_total')} as aov, sum(order_total) as spent
                  from r_orders group by 1 having count(*) > 1)
            group by 1"""
    ),
    "revenue_leakage": query(
        f"""select case sign(next_total - order_total) when -1 then '{L.VALUE_DOWN}' when 1 then '{L.VALUE_UP}'
                     else '{L.VALUE_SAME}' end as penalty_order_analysis,
              count(*) as cust_count,
              {pct('count(distinct customer_id)', '(select count(distinct customer_id) from r_orders)')} as customer_share_pct
            from (select distinct customer_id, order_total, next_total from followed where next_total is not null)
            group by 1""",
        followed=_NEXT,
    ),
    "delay_vs_next_value": query(
        f"""select case {_MOVES} else '{L.VALUE_AND_TIMING_OTHER}' end as delivery_corr_order_volume,
              count(*) as order_count, {avg('order_total')} as avg_total_order_value,
              {pct('count(*)', '(select count(*) from r_orders)')} as order_count_pct
            from followed where next_total is not null and next_ahead is not null group by 1""",
        followed=_NEXT,
    ),
    "recovered_delivery_pct": query(
        f"""select {pct(f'count(*) filter (next_ahead > {_AHEAD})', 'count(*)')} as next_order_good_delivery_pct,
              {pct(f'count(*) filter (next_ahead > {_AHEAD} and next_ahead >= 0)', 'count(*)')}
                as nxt_delivery_ordered_before_promised_timing_pct
            from followed""",
        followed=_NEXT,
    ),
    "area_delivery": query(
        f"""select area, feedback_category, count(distinct customer_id) as customer_count_per_area,
              count(*) as order_cnt, {avg('order_total')} as aov, {avg('rating')} as avg_rating_per_category,
              {avg('delivery_gap_in_minutes')} as avg_delivery_delay, {avg(_AHEAD)} as avg_promised_delivery_delay
            from r_reviewed join r_customers using (customer_id) group by area, feedback_category"""
    ),
    "hourly_delivery_feedback": query(
        f"""select *, cast(dense_rank() over (order by order_cnt desc nulls last) as int) as order_cnt_rnk,
              cast(dense_rank() over (order by bad_delivery_related_fdbk_pct desc nulls last) as int)
                as bad_delivery_fdbk_pct_rnk
            from (select cast(hour(order_date) as int) as order_hour, {avg('order_total')} as avg_order_total,
                    count(*) as order_cnt, count(*) filter ({_AHEAD} < 0) as late_delivery_cnt,
                    count(*) filter ({_BAD_DELIVERY}) as bad_delivery_related_fdbk_cnt,
                    {pct(f'count(*) filter ({_BAD_DELIVERY})', f'count(*) filter ({_AHEAD} < 0)')}
                      as bad_delivery_related_fdbk_pct
                  from r_reviewed join r_customers using (customer_id) group by 1)"""
    ),
    "delivery_by_distance_year": query(
        f"""select cast(year(promised_time) as int) as delivery_year, {_DISTANCE} as delivery_distance_flag,
              count(*) as order_cnt, {avg('delivery_time_minutes')} as avg_delivery_timing
            from r_delivery group by 1, 2"""
    ),
    "delivery_monthly_time": query(
        f"""select cast(year(promised_time) as int) as delivery_year, cast(month(promised_time) as int) as delivery_month,
              {avg('delivery_time_minutes')} as avg_delivery_time_in_minutes from r_delivery group by 1, 2"""
    ),
    "segment_bad_delivery": query(
        f"""select customer_segment, count(*) as count_of_orders,
              count(*) filter (feedback_category = 'delivery') as delivery_related_reviews,
              count(*) filter ({_BAD_DELIVERY}) as neg_delivery_review,
              cast(count(*) filter ({_BAD_DELIVERY}) * 100 // count(*) as double) as bad_delivery_review_pct
            from r_customers join r_feedback using (customer_id) group by 1"""
    ),
    "delay_reason_share": share("r_delivery", "reasons_if_delayed", "reasons_if_delayed", "delivery_count", "reasons"),
    "traffic_delay_monthly": share(
        "r_delivery", "cast(month(promised_time) as int)", "delivery_month", "traffic_delay_cnt",
        "bad_delivery_total_pct", "reasons_if_delayed = 'traffic'",
    ),
    "traffic_delay_weekly": query(
        f"""select cast(week(promised_time) as int) as delivery_week, {avg('order_id', 6)} as avg_delivery_cnt,
              count(*) as traffic_delay_cnt
            from r_delivery where reasons_if_delayed = 'traffic' group by 1"""
    ),
    "reason_avg_time": query(
        f"""select reasons_if_delayed, {avg('delivery_time_minutes', 6)} as avg_late_timing, count(*) as delivery_cnt
            from r_delivery group by 1"""
    ),
    "partner_delivery_count": query(
        "select delivery_partner_id, count(*) as delivery_count from r_delivery group by 1"
    ),
    "distance_share": share(
        "r_delivery", _DISTANCE, "delivery_distance_flag", "total_delivery_count", "pct_to_total_delivery"
    ),
    "gap_flag_count": query(
        f"select {_GAP_FLAG} as delivery_gap_flag, count(*) as order_count from r_orders group by 1"
    ),
}
