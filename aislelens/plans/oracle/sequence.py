from aislelens.plans.oracle.base import avg, hu, mean, query, total

_THEN = "over (partition by customer_id order by order_date, order_id)"
_FOLLOWED = f"""
  select *, lead(product_name) {_THEN} as next_product, lead(product_name, 2) {_THEN} as product_after_next,
    lead(category) {_THEN} as next_category, lead(order_total) {_THEN} as next_total
  from r_known_lines"""
_PROPENSITY = f"""
  select curr_category, next_category, pair_ordering_size, {hu('revenue')} as avg_revenue_per_pair,
    cast(dense_rank() over (partition by curr_category order by {hu('revenue', 6)} desc nulls last) as int) as revenue_rank
  from (select category as curr_category, next_category, count(*) as pair_ordering_size,
          {mean('(order_total + next_total)')} as revenue
        from followed where next_category is not null group by all having count(*) > 1)"""

SQL = {
    "next_product_symmetry": query(
        f"""select a.x as item_x, a.y as item_y, a.n as x_to_y_count, a.revenue as x_to_y_avg_revenue,
              b.x as item_x_reverse, b.y as item_y_reverse, b.n as y_to_x_count, b.revenue as y_to_x_avg_revenue,
              {hu('(a.revenue - b.revenue)')} as avg_revenue_gap
            from pairs a, pairs b where a.x = b.y and a.y = b.x and a.x > a.y""",
        steps="""
          select product_name as x, order_total,
            lead(product_name) over w as y, lead(order_total) over w as next_total
          from (select distinct customer_id, order_date, product_name, order_total from r_known_lines)
          window w as (partition by customer_id order by order_date, product_name, order_total)""",
        pairs=f"""
          select x, y, count(*) as n, {avg('(order_total + next_total)')} as revenue
          from steps where y is not null group by all having count(*) > 1""",
    ),
    "next_category_propensity": query("select * from propensity", followed=_FOLLOWED, propensity=_PROPENSITY),
    "next_category_top": query(
        "select * from propensity where revenue_rank = 1", followed=_FOLLOWED, propensity=_PROPENSITY
    ),
    "next_category_demand": query(
        f"""select next_category, count(*) as next_order_cnt, {total('next_total')} as tov_for_next_category,
              {avg('next_total')} as aov_for_next_category
            from (select lead(category) {_THEN} as next_category, lead(order_total) {_THEN} as next_total
                  from r_orders left join r_items using (order_id) left join r_products using (product_id))
            where next_category is not null group by all"""
    ),
    "next_product_value": query(
        f"""select product_name as curr_prod_txn, next_product as nxt_prod_txn, count(*) as txn_cnt,
              {total('(order_total + next_total)')} as total_order_value
            from followed where next_product is not null group by all""",
        followed=_FOLLOWED,
    ),
    "next_category_value": query(
        f"""select category as curr_category, next_category, count(*) as txn_cnt,
              {total('(order_total + next_total)')} as total_order_value
            from followed where next_category is not null and next_total is not null group by all""",
        followed=_FOLLOWED,
    ),
    "triple_repeat_product": query(
        """select customer_id, product_name as fst_purchase, next_product as snd_purchase,
             product_after_next as trd_purchase
           from followed where product_name = next_product and next_product = product_after_next""",
        followed=_FOLLOWED,
    ),
    "same_product_gap": query(
        """select a.customer_id, a.product_id, a.product_name, a.order_date as first_buying_date,
             b.next_buying_date,
             cast(datediff('day', cast(a.order_date as date), cast(b.next_buying_date as date)) as int) as order_day_gap,
             cast(datediff('day', cast(a.earliest as date), cast(a.order_date as date)) as int) as days_since_first,
             a.purchases, n.purchases as next_purchases
           from moments a join later b using (customer_id, product_id, order_date)
           join moments n on n.customer_id = a.customer_id and n.product_id = a.product_id
             and n.order_date = b.next_buying_date""",
        moments="""
          select *, min(order_date) over (partition by customer_id, product_id) as earliest
          from (select customer_id, product_id, product_name, order_date, count(*) as purchases
                from r_known_lines group by all)""",
        later="""
          select a.customer_id, a.product_id, a.order_date, min(b.order_date) as next_buying_date
          from moments a join moments b
            on b.customer_id = a.customer_id and b.product_id = a.product_id and b.order_date > a.order_date
          group by all""",
    ),
    "product_reorder_gap": query(
        """select product_id, product_name, cast(floor(avg(days)) as bigint) as avg_day_gap
           from (select product_id, product_name,
                   datesub('day', order_date,
                     lead(order_date) over (partition by product_id order by order_date, order_id)) as days
                 from r_lines)
           group by all"""
    ),
}
