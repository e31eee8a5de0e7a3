from aislelens.plans.oracle.base import avg, grow, pct, query
from aislelens.plans.oracle.delivery import share

_BAD = "sentiment = 'negative'"
_BAD_DELIVERY = f"{_BAD} and feedback_category = 'delivery'"
_MONTHLY = f"""
  select *, {pct('negative_rev_cnt', 'feedback_cnt')} as neg_to_category_fdbk_ratio,
    {pct('negative_rev_cnt', 'total_order_cnt')} as neg_to_monthly_total_fdbk_ratio,
    cast(dense_rank() over (partition by feedback_month order by negative_rev_cnt desc nulls last) as int) as neg_rev_rank
  from (select cast(date_trunc('month', feedback_date) as date) as feedback_month, feedback_category,
          count(*) as feedback_cnt, count(*) filter (sentiment = 'negative') as negative_rev_cnt
        from r_feedback group by 1, 2)
  join (select cast(date_trunc('month', feedback_date) as date) as feedback_month, count(*) as total_order_cnt
        from r_feedback group by 1) using (feedback_month)"""


def _when(sentiment: str, column: str) -> str:
    return avg(f"case sentiment when '{sentiment}' then {column} end", 6)


SQL = {
    "monthly_negative_rank": query(_MONTHLY),
    "negative_rank_frequency": query(
        f"""select feedback_category, neg_rev_rank, count(*) as num_of_first_ranks from ({_MONTHLY}) group by 1, 2"""
    ),
    "monthly_delivery_review": query(
        f"""select cast(month(order_date) as int) as order_month, count(*) as order_cnt,
              count(feedback_id) as feedback_cnt, count(*) filter ({_BAD}) as neg_rev_cnt,
              count(*) filter ({_BAD_DELIVERY}) as neg_rev_for_delivery_cnt,
              {pct(f'count(*) filter ({_BAD_DELIVERY})', f'count(*) filter ({_BAD})')} as neg_delivery_review_pct,
              {pct(f'count(*) filter ({_BAD_DELIVERY})', 'count(*)')} as neg_delivery_fdbk_to_all_order_pct
            from r_reviewed group by 1"""
    ),
    "monthly_feedback_ratio": query(
        f"""select order_month, n as total_order, {grow('n', 'lag(n) over (order by order_month)')} as order_cnt_growth,
              {pct('bad', 'n')} as bad_feedback_rate, {pct('neutral', 'n')} as neutral_feedback_rate,
              {pct('(n - bad - neutral)', 'n')} as good_feedback_rate
            from (select order_month_start as order_month, count(*) as n, count(*) filter ({_BAD}) as bad,
                    count(*) filter (sentiment = 'neutral') as neutral
                  from r_reviewed group by 1)"""
    ),
    "churn_after_bad_review": query(
        f"""select order_month, count(distinct customer_id) as total_customer_cnt,
              count(*) filter (lost) as customer_churn_cnt,
              {pct('count(*) filter (lost)', 'count(distinct customer_id)')} as churn_pct
            from (select customer_id, order_month_start as order_month,
                    {_BAD} and row_number() over (partition by customer_id
                                                  order by order_date desc, order_id desc, feedback_id desc) = 1 as lost
                  from r_reviewed)
            group by 1"""
    ),
    "bad_review_reasons": query(
        "select customer_id, feedback_category, count(*) as total_order_cnt, " + ", ".join(
            f"{_when(s, column)} as {name}_{s}_feedback"
            for s in ("negative", "neutral", "positive")
            for name, column in (("aov", "order_total"), ("delivery_gap", "delivery_gap_in_minutes"))
        ) + " from r_reviewed group by 1, 2"
    ),
    "worst_category_per_month": query(
        f"""select order_month, feedback_category, avg_rating, total_fdbk_received, neg_fdbk_cnt, 1 as neg_fdbk_rnk
            from (select order_month_start as order_month, feedback_category, {avg('rating')} as avg_rating,
                    count(*) as total_fdbk_received, count(*) filter ({_BAD}) as neg_fdbk_cnt
                  from r_reviewed join r_customers using (customer_id) group by 1, 2)
            qualify neg_fdbk_cnt = max(neg_fdbk_cnt) over (partition by order_month)"""
    ),
    "area_negative_feedback": query(
        f"""select area, feedback_category, sentiment, count(*) as feedbk_size
            from r_reviewed join r_customers using (customer_id) where {_BAD} group by 1, 2, 3"""
    ),
    "product_quality_sentiment": query(
        f"""select * from (
              select *, cast(dense_rank() over (partition by product_name order by fdbk_received desc) as int)
                as most_fdbk_received_rnk
              from (select product_name, sentiment, {avg('order_total')} as avg_order_value,
                      count(*) as fdbk_received, {avg('rating')} as avg_rating
                    from r_feedback join r_lines using (order_id)
                    where feedback_category = 'product quality' group by 1, 2))
            qualify avg_order_value = max(avg_order_value) over (partition by product_name)"""
    ),
    "sentiment_share": share("r_feedback", "sentiment", "sentiment", "count", "feedback_share_pct"),
    "category_avg_rating": query(
        f"select feedback_category, {avg('rating', 6)} as avg_rating from r_feedback group by 1"
    ),
    "rating_share": share("r_feedback", "rating", "rating", "rating_count", "rating_share"),
    "year_sentiment_count": query(
        "select cast(year(feedback_date) as int) as feedback_year, sentiment, count(*) as sentimental_count "
        "from r_feedback group by 1, 2"
    ),
}
