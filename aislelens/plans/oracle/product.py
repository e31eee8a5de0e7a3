from aislelens.functions import labels as L
from aislelens.plans.oracle.base import avg, big, hu, label, mean, pct, query, ratio, total

_ALL_LINES = "r_orders left join r_items using (order_id) left join r_products using (product_id)"
_MARGIN = f"""
  select margin_percentage, category, product_name, count(*) as order_cnt, {avg('price')} as avg_price,
    {avg('mrp')} as avg_mrp, {avg('order_total')} as aov
  from {_ALL_LINES} group by 1, 2, 3"""
_RATIO = f"""
  select order_id, {big('sum(quantity)')} as total_quantities_sold,
    {hu('(sum(quantity) * sum(unit_price))')} as calc_order_value, {total('order_total')} as given_order_value,
    {hu(f"({ratio('sum(order_total)', '(sum(quantity) * sum(unit_price))')})")} as calc_to_given_order_value_ratio
  from r_lines group by 1"""
_R = "calc_to_given_order_value_ratio"


def _monthly(name: str) -> str:
    return f"""
      select *, cast(dense_rank() over (partition by order_month order by total_order_value desc nulls last) as int)
        as order_value_rnk
      from (select cast(month(order_date) as int) as order_month, {name}, count(*) as order_size,
              {total('order_total')} as total_order_value
            from r_lines group by 1, 2)"""


def _tally(name: str, n: int) -> str:
    return query(
        f"select {name}, count(*) as repetition_size from m where order_value_rnk <= {n} group by 1", m=_monthly(name)
    )


SQL = {
    "monthly_category_contribution": query(
        """select *,
             cast(dense_rank() over (partition by order_month
               order by monthly_order_value_contribution_pct desc nulls last) as int) as monthly_order_value_cont_rank,
             cast(dense_rank() over (partition by order_month
               order by mthly_total_order_count_contribution_pct desc nulls last) as int) as monthly_order_count_cont_rank
           from shares""",
        cells=f"""
          select order_month_start as order_month, category, count(*) as order_cnt, {avg('order_total')} as aov,
            {total('order_total')} as order_total_value
          from r_lines group by 1, 2""",
        months=f"""
          select order_month_start as order_month, count(*) as order_count_mth, {avg('order_total')} as monthly_aov,
            {total('order_total')} as mth_total_order_value
          from r_orders group by 1""",
        shares=f"""
          select *, {pct('order_cnt', 'order_count_mth')} as mthly_total_order_count_contribution_pct,
            {pct('order_total_value', 'mth_total_order_value')} as monthly_order_value_contribution_pct
          from cells left join months using (order_month)""",
    ),
    "margin_tier_summary": query(
        f"""select margin_percentage, count(distinct category) as category_cnt, count(distinct p.product_id) as prod_cnt,
              count(*) as order_cnt, {avg('mrp')} as avg_mrp, {avg('order_total')} as aov,
              {pct(mean('mrp'), mean('order_total'))} as avg_mrp_to_order_value_ratio
            from r_orders o left join r_items i on i.order_id = o.order_id
              left join r_products p on p.product_id = i.product_id
            group by 1"""
    ),
    "margin_product": query(_MARGIN),
    "margin_category_rollup": query(
        f"""select margin_percentage, category, {big('sum(order_cnt)')} as total_order_cnt,
              {hu('avg(avg_price)')} as avg_price, {hu('avg(avg_mrp)')} as avg_mrp, {hu('avg(aov)')} as avg_aov
            from ({_MARGIN}) group by 1, 2"""
    ),
    "area_product_rank": query(
        f"""select area, product_id, product_name, order_size, {hu('worth')} as aov,
              dense_rank() over (partition by area order by {hu('worth', 6)} desc nulls last) as aov_rnk
            from (select area, product_id, product_name, count(*) as order_size, {mean('order_total')} as worth
                  from r_known_lines group by 1, 2, 3 having count(*) > 1)"""
    ),
    "product_contribution": query(
        f"""select product_name, {total('order_total')} as total_order_value,
              {pct('sum(order_total)', '(select sum(order_total) from r_orders)')} as contribution_pct
            from r_lines group by 1"""
    ),
    "monthly_top5_products": query(
        f"""select order_month, product_name, order_size, total_order_value, order_value_rnk,
              {pct('order_size', 'all_orders')} as order_size_contribution_to_monthly_total_order_size,
              {pct('total_order_value', 'all_value')} as order_value_contribution_to_monthly_total_order_value
            from (select *, sum(order_size) over (partition by order_month) as all_orders,
                    sum(total_order_value) over (partition by order_month) as all_value from m)
            where order_value_rnk <= 5""",
        m=_monthly("product_name"),
    ),
    "monthly_top1_product_tally": _tally("product_name", 1),
    "monthly_top3_category_tally": _tally("category", 3),
    "best_selling_product": query(
        f"""select product_id, product_name, count(*) as order_frequency, {big('sum(quantity)')} as total_quantities_sold
            from r_items join r_products using (product_id) group by 1, 2
            order by total_quantities_sold desc nulls last, product_id limit 1"""
    ),
    "order_value_audit": query(
        f"""select outlier_classification, n as row_cnts, {pct('n', 'sum(n) over ()')} as pct_of_outlier_portions
            from (select {label(_R, L.ORDER_VALUE_BANDS, L.ORDER_VALUE_OTHER)} as outlier_classification, count(*) as n
                  from ratios group by 1)""",
        ratios=_RATIO,
    ),
    "order_value_ratio_extremes": query(
        f"select min({_R}) as minimum_level_outlier, max({_R}) as maximum_level_outlier from ratios", ratios=_RATIO
    ),
    "valid_orders_filter": query(f"select * from ratios where {_R} > 0.5 and {_R} < 1.25", ratios=_RATIO),
    "iqr_inliers_orders": query(
        """select order_id, cast(order_total as double) as order_total, q1, q3, lower_bound, upper_bound, iqr from r_orders, bounds
           where order_total > lower_bound and order_total < upper_bound""",
        bounds="""select q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_bound, q3 + 1.5 * (q3 - q1) as upper_bound
                  from (select quantile_cont(cast(order_total as double), 0.25) as q1,
                          quantile_cont(cast(order_total as double), 0.75) as q3 from r_orders)""",
    ),
    "iqr_inliers": query(
        """select event_id, value, q1, q3, lower_bound, upper_bound, iqr from events, bounds
           where value > lower_bound and value < upper_bound""",
        quartiles="select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events",
        bounds="""select q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_bound,
                    q3 + 1.5 * (q3 - q1) as upper_bound from quartiles""",
    ),
    "category_avg_mrp": query(f"select category, {avg('p.mrp')} as mrp from r_products p group by 1"),
    "category_stock_value": query(
        f"""select category, {avg('p.min_stock_level')} as avg_min_stock, {avg('p.price')} as avg_price,
              {hu(f"({mean('p.min_stock_level')} * {mean('p.price')})")} as avg_maintaining_stock_value
            from r_products p group by 1"""
    ),
    "item_count_by_product": query("select product_id, count(*) as count from r_items group by 1"),
}
