"""DuckDB SQL for each query that plain SQL can express, over the same Parquet tables.

The four business tables and the questions are common table expressions; each query names
the ones it needs, in order of dependence.
"""

from __future__ import annotations

_NET = (
    "cast(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2)))"
    " as decimal(18,4))"
)

TABLES = {
    "sales": f"""
        select cast(date_trunc('month', o_orderdate) as date) as date, p_brand as product_id,
          concat('Product ', p_brand) as product_name, c_custkey as customer_id, c_name as customer_name,
          r_name as region, {_NET} as revenue, cast(l_quantity as decimal(10,2)) as quantity_sold,
          cast(18 - 150*cast(l_discount as decimal(4,2)) - 50*cast(l_tax as decimal(4,2)) as decimal(10,2)) as margin_pct,
          cast(100*cast(l_discount as decimal(4,2)) as decimal(10,2)) as discount_pct,
          case when l_returnflag = 'R' then cast(l_quantity as decimal(10,2)) else cast(0 as decimal(10,2)) end as returns_qty,
          case when month(o_orderdate) in (10, 11) then 1 else 0 end as is_festive
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
          join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
          join region on n_regionkey = r_regionkey""",
    "receivables": """
        select o_orderkey as invoice_no, o_custkey as customer_id, c_name as customer_name, r_name as region,
          cast(o_totalprice as decimal(18,2)) as invoice_amount, inv as invoice_date, cast(inv + 30 as date) as due_date,
          case when unpaid then null else cast(inv + pay as date) end as received_date, days_overdue,
          case when days_overdue <= 0 then 'Current' when days_overdue <= 30 then '1-30'
               when days_overdue <= 60 then '31-60' when days_overdue <= 90 then '61-90' else 'Bad Debt' end as aging_bucket
        from (
          select *, case when unpaid then cast(date_diff('day', inv, date '2001-12-01') as int) - 30 else pay - 30 end as days_overdue
          from (
            select o_orderkey, o_custkey, c_name, r_name, o_totalprice, cast(o_orderdate as date) as inv,
              cast(10 + (o_orderkey*37) % 140 as int) as pay, (o_orderstatus = 'P' and o_orderkey % 10 = 0) as unpaid
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
              join region on n_regionkey = r_regionkey))""",
    "inventory": """
        select p_partkey as sku, p_type as category, concat('WH-', cast(p_partkey % 5 as varchar(10))) as warehouse,
          idle as days_no_movement, stock as current_stock_kg, cast(stock*price as decimal(18,4)) as total_value_inr,
          lead as lead_time_days, cast(q*lead*cast(0.0025 as decimal(5,4)) as decimal(18,6)) as reorder_point,
          cast(q*lead*cast(0.0050 as decimal(5,4)) as decimal(18,6)) as ideal_stock,
          case when idle > 180 then 1 else 0 end as is_dead_stock,
          case when stock < q*lead*cast(0.0025 as decimal(5,4)) then 1 else 0 end as needs_reorder
        from (
          select p_partkey, p_type, cast(date_diff('day', mv, date '2001-12-01') as int) as idle,
            cast(p_size*10 + p_partkey % 97 as decimal(10,2)) as stock, cast(p_retailprice as decimal(12,2)) as price,
            cast(7 + p_partkey % 24 as int) as lead, cast(q as decimal(18,2)) as q
          from part join (
            select l_partkey, sum(cast(l_quantity as decimal(10,2))) as q, max(cast(l_shipdate as date)) as mv
            from lineitem group by l_partkey) on l_partkey = p_partkey)""",
    "gst": f"""
        select l_orderkey*10 + l_linenumber as invoice_no, s_suppkey as counterparty_id, s_name as counterparty_name,
          strftime(l_shipdate, '%Y-%m') as return_period, base as taxable_value,
          cast(tax * cast(0.5 as decimal(2,1)) as decimal(18,7)) as cgst_amount,
          cast(tax * cast(0.5 as decimal(2,1)) as decimal(18,7)) as sgst_amount, tax as total_tax_amount,
          case when l_returnflag = 'R' and l_linestatus = 'O' then 1 else 0 end as mismatch_flag,
          case when l_returnflag = 'R' and l_linestatus = 'O' then
            case l_linenumber % 3 when 0 then 'Rate mismatch' when 1 then 'Missing in return' else 'Value mismatch' end
          end as mismatch_reason
        from (select *, cast(base * cast(l_tax as decimal(4,2)) as decimal(18,6)) as tax
              from (select *, {_NET} as base from lineitem))
          join supplier on l_suppkey = s_suppkey""",
    "questions": """
        select o_orderkey as q_id, concat(
          case o_orderkey % 11 when 0 then 'Predict demand' when 1 then 'Revenue' when 2 then 'Cash flow risk'
            when 3 then 'DSO trend' when 4 then 'Low MARGIN customers' when 5 then 'Which items to discontinue'
            when 6 then 'GST filing' when 7 then 'Dead SKUs' when 8 then 'Full report' when 9 then 'Sales report'
            else 'Hello there' end,
          case o_orderkey % 3 when 0 then ''
            when 1 then concat(' in ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate) as int)*3 - 2, 3), ' ', cast(year(o_orderdate) as varchar(4)))
            else concat(' maybe in ', cast(year(o_orderdate) as varchar(4))) end) as text
        from orders""",
    "panel": """
        select date, product_id, product_name, region, cast(sum(revenue) as double) as revenue,
          cast(sum(quantity_sold) as double) as quantity,
          cast(sum(margin_pct) as double) / count(margin_pct) as avg_margin,
          cast(sum(discount_pct) as double) / count(discount_pct) as avg_discount,
          cast(sum(returns_qty) as double) as returns, max(is_festive) as is_festive
        from sales group by all""",
    "features": """
        select date, product_id, product_name, region, revenue, quantity, avg_margin, avg_discount, returns, is_festive,
          lag_1, lag_3, lag_12, rolling_3,
          sqrt(((lag_2 - rolling_3)*(lag_2 - rolling_3) + (lag_1 - rolling_3)*(lag_1 - rolling_3)
            + (revenue - rolling_3)*(revenue - rolling_3)) / 2.0e0) as rolling_std3,
          cast(month(date) as int) as month, cast(quarter(date) as int) as quarter, cast(year(date) as int) as year
        from (
          select *, (lag_2 + lag_1 + revenue) / 3.0e0 as rolling_3
          from (
            select *, lag(revenue, 1) over w as lag_1, lag(revenue, 2) over w as lag_2,
              lag(revenue, 3) over w as lag_3, lag(revenue, 12) over w as lag_12
            from panel window w as (partition by product_id, region order by date, product_name)))
        where lag_12 is not null and avg_margin is not null and avg_discount is not null and is_festive is not null""",
    "series": "select date, sum(revenue) as revenue from sales group by date",
    "monthly": "select strftime(date, '%Y-%m') as month, cast(sum(revenue) as double) as revenue from series group by 1",
    "recent": """
        select max(date) as last_date, cast(trunc(max_by(revenue, date)) as bigint) as revenue_last_month,
          cast(sum(revenue) as double) / count(revenue) as recent_mean
        from (select * from series order by date desc limit 6)""",
    "forecast": """
        select cast(start + to_months(cast(step - 1 as int)) as date) as ds,
          round_even(recent_mean * pow(1.02e0, cast(step as double)), 0) as yhat,
          round_even(recent_mean * 0.9e0, 0) as yhat_lower, round_even(recent_mean * 1.1e0, 0) as yhat_upper
        from (select recent_mean, case when day(later) = 1 then later
                else cast(date_trunc('month', later) + to_months(1) as date) end as start
              from (select recent_mean, cast(last_date + to_months(1) as date) as later from recent)),
          range(1, 4) as steps(step)""",
    "trend": """
        select case when max_by(yhat, ds) > min_by(yhat, ds) then 'upward' else 'downward' end as trend from forecast""",
    "anomalies": """
        select strftime(date, '%Y-%m') as month, cast(revenue as double) as revenue
        from series, (select avg(cast(revenue as double)) as m, stddev_pop(cast(revenue as double)) as s from series)
        where s > 0 and abs((cast(revenue as double) - m) / s) > 2""",
    "top_revenue": """
        select product_id, product_name, cast(sum(revenue) as double) as revenue,
          row_number() over (order by sum(revenue) desc, product_id, product_name) as rank
        from sales group by product_id, product_name qualify rank <= 5""",
    "payers": """
        select customer_id, customer_name, round_even(cast(sum(invoice_amount) as double)*100, 0)/100 as total_overdue,
          count(invoice_no) as invoice_count,
          round_even(cast(sum(days_overdue) as double)/count(days_overdue)*100, 0)/100 as avg_days_late,
          row_number() over (order by sum(invoice_amount) desc, customer_id, customer_name) as rank
        from receivables where days_overdue > 0 group by customer_id, customer_name qualify rank <= 5""",
    "cash": """
        select cast(trunc(sum(invoice_amount) filter (days_overdue > 0)) as bigint) as total_overdue,
          cast(trunc(sum(invoice_amount * case when days_overdue <= -999 then null when days_overdue <= 0 then 0.98
            when days_overdue <= 30 then 0.92 when days_overdue <= 60 then 0.70 when days_overdue <= 90 then 0.45
            when days_overdue <= 9999 then 0.20 end)) as bigint) as expected_30d_inflow,
          count(*) filter (days_overdue > 0) as overdue_invoice_count,
          count(distinct customer_id) filter (days_overdue > 0) as slow_payer_count,
          round_even(cast(sum(received_date - invoice_date) as double) / count(received_date) * 10, 0) / 10 as dso_days,
          cast(trunc(sum(invoice_amount) filter (aging_bucket = 'Bad Debt')) as bigint) as bad_debt_amount
        from receivables""",
    "dead": """
        select sku, category, warehouse, days_no_movement,
          round_even(cast(current_stock_kg as double)*100, 0)/100 as current_stock_kg,
          round_even(cast(total_value_inr as double)*100, 0)/100 as total_value_inr,
          row_number() over (order by total_value_inr desc nulls last, sku) as rank
        from inventory where is_dead_stock = 1 qualify rank <= 5""",
    "stock": """
        select count(*) as total_skus, count(*) filter (is_dead_stock = 1) as dead_stock_count,
          cast(format('{:.1f}', cast(count(*) filter (is_dead_stock = 1) as double) / count(*) * 100) as double) as dead_stock_pct,
          cast(trunc(sum(total_value_inr) filter (is_dead_stock = 1)) as bigint) as total_capital_locked,
          count(*) filter (needs_reorder = 1) as reorder_alerts
        from inventory""",
    "suppliers": """
        select counterparty_id, counterparty_name, count(invoice_no) as invoice_count,
          round_even(cast(sum(total_tax_amount) as double)*100, 0)/100 as total_itc_risk,
          row_number() over (order by sum(total_tax_amount) desc, counterparty_id, counterparty_name) as rank
        from gst where mismatch_flag = 1 group by counterparty_id, counterparty_name qualify rank <= 5""",
    "taxes": """
        select count(*) as total_invoices, count(*) filter (mismatch_flag = 1) as total_mismatches,
          cast(format('{:.1f}', cast(count(*) filter (mismatch_flag = 1) as double) / count(*) * 100) as double) as mismatch_pct,
          cast(trunc(sum(total_tax_amount) filter (mismatch_flag = 1)) as bigint) as total_itc_at_risk
        from gst""",
    "decided": """
        select *, case when margin_pct > 12 then 'Promote' when margin_pct < 4 then 'Discontinue' else 'Renegotiate' end as decision
        from sales""",
    "worst": """
        select row_number() over (order by min(margin_pct) nulls last, product_name nulls last) as rank, product_name,
          round_even(cast(min(margin_pct) as double)*100, 0)/100 as net_margin_pct
        from sales group by product_name qualify rank <= 3""",
    "asked": """
        select q_id, case when contains(t, '199') then y || '-' || m end as month, t,
          case when regexp_matches(t, 'predict|sales|quarter|revenue') then 'sales'
            when regexp_matches(t, 'cash flow|overdue|trapped|paying|receivable|dso') then 'cash'
            when regexp_matches(t, 'discontinue|margin|product') then 'margin'
            when regexp_matches(t, 'gst|tax|mismatch') then 'tax'
            when regexp_matches(t, 'dead|stock|inventory|liquidate') then 'stock'
            when contains(t, 'report') then 'report' else 'other' end as intent
        from (
          select q_id, lower(text) as t,
            case when contains(lower(text), '1997') then '1997' when contains(lower(text), '1998') then '1998'
              when contains(lower(text), '1999') then '1999' end as y,
            case when contains(lower(text), 'dec') then '12' when contains(lower(text), 'nov') then '11'
              when contains(lower(text), 'oct') then '10' when contains(lower(text), 'sep') then '09'
              when contains(lower(text), 'aug') then '08' when contains(lower(text), 'jul') then '07'
              when contains(lower(text), 'jun') then '06' when contains(lower(text), 'may') then '05'
              when contains(lower(text), 'apr') then '04' when contains(lower(text), 'mar') then '03'
              when contains(lower(text), 'feb') then '02' when contains(lower(text), 'jan') then '01' end as m
          from questions)""",
    "texts": """
        select 'sales' as intent, 'Sales are forecast to move ' || trend || '.' || chr(10) || chr(10)
          || '| ds | yhat | trend |' || chr(10) || '| :--- | :--- | :--- |' || chr(10)
          || (select string_agg('| ' || strftime(ds, '%Y-%m') || ' | ₹' || format('{:,}', cast(yhat as bigint)) || ' | ' || trend || ' |', chr(10) order by ds) from forecast)
          || chr(10) || chr(10) || 'Action: ' || case when trend = 'upward'
            then 'make more of ' || (select product_name from top_revenue where rank = 1) || ' to meet the expected demand.'
            else 'buy and stock less of ' || (select product_name from top_revenue where rank = 1) || ' while sales fall.' end as body
        from trend
        union all select 'cash', '₹' || format('{:,}', total_overdue) || ' is overdue. Customers take ' || dso_days
          || ' days to pay on average.' || chr(10) || chr(10) || '| customer name | total overdue | avg days late |' || chr(10)
          || '| :--- | :--- | :--- |' || chr(10)
          || (select string_agg('| ' || customer_name || ' | ₹' || format('{:,}', cast(trunc(total_overdue) as bigint)) || ' | ' || format('{:.1f}', avg_days_late) || ' |', chr(10) order by rank) from payers)
          || chr(10) || chr(10) || 'Action: remind these customers and review their credit terms.' from cash
        union all select 'margin', (select count(distinct customer_id) from decided where decision = 'Renegotiate')
          || ' customers have lines to renegotiate.' || chr(10) || chr(10) || '| product name | net margin pct |' || chr(10)
          || '| :--- | :--- |' || chr(10) || string_agg('| ' || product_name || ' | ' || net_margin_pct || '% |', chr(10) order by rank)
          || chr(10) || chr(10) || 'Action: phase these products out to free working capital.' from worst
        union all select 'tax', total_mismatches || ' GST mismatches put ₹' || format('{:,}', total_itc_at_risk)
          || ' of input tax credit at risk.' || chr(10) || chr(10) || '| counterparty name | invoice count | total itc risk |' || chr(10)
          || '| :--- | :--- | :--- |' || chr(10)
          || (select string_agg('| ' || counterparty_name || ' | ' || invoice_count || ' | ₹' || format('{:,}', cast(trunc(total_itc_risk) as bigint)) || ' |', chr(10) order by rank) from suppliers)
          || chr(10) || chr(10) || 'Action: reconcile the invoices of these suppliers this month.' from taxes
        union all select 'stock', dead_stock_count || ' dead items lock up ₹' || format('{:,}', total_capital_locked) || '.'
          || chr(10) || chr(10) || '| sku | warehouse | days no movement | total value inr |' || chr(10) || '| :--- | :--- | :--- | :--- |' || chr(10)
          || (select string_agg('| ' || sku || ' | ' || warehouse || ' | ' || days_no_movement || ' | ₹' || format('{:,}', cast(trunc(total_value_inr) as bigint)) || ' |', chr(10) order by rank) from dead)
          || chr(10) || chr(10) || 'Action: sell off these items first.' from stock
        union all select 'report', 'Executive summary' || chr(10) || chr(10) || '1. Sales: ₹'
          || format('{:,}', (select cast(min_by(yhat, ds) as bigint) from forecast)) || ' forecast for next month, trend ' || trend
          || '.' || chr(10) || '2. Cash flow: ₹' || format('{:,}', total_overdue) || ' overdue, ' || dso_days || ' days to payment.'
          || chr(10) || '3. Inventory: ₹' || format('{:,}', total_capital_locked) || ' locked in dead stock.'
          || chr(10) || '4. GST: ₹' || format('{:,}', total_itc_at_risk) || ' of tax credit at risk.' || chr(10) || '5. Profitability: '
          || (select count(distinct customer_id) from decided where decision = 'Renegotiate') || ' customers to renegotiate with.'
          || chr(10) || chr(10) || 'Action: go through the item and customer lists of each area.' from trend, cash, stock, taxes
        union all select 'other', 'No report matches this question. Try asking about sales, cash flow, stock or GST.'""",
}

_SERIES = ("sales", "series")
_PANEL = ("sales", "panel", "features")
_FORECAST = (*_SERIES, "recent", "forecast")

_HEADLINES = (*_FORECAST, "trend", "anomalies", "receivables", "cash", "inventory", "stock", "gst", "taxes")
_HEADLINE_SQL = """
    select (select cast(min_by(yhat, ds) as bigint) from forecast) as next_month_forecast,
      (select revenue_last_month from recent) as last_month_actual,
      (select upper(trend[1]) || trend[2:] from trend) as trend,
      (select count(*) from anomalies) as anomaly_months, total_overdue as overdue, dso_days,
      dead_stock_count as dead_stock, reorder_alerts, total_itc_at_risk as tax_at_risk
    from cash, stock, taxes"""

_CUSTOMER_SQL = """
    select customer_id, cast(sum(revenue) as double) as revenue, cast(sum(margin_pct) as double)/count(margin_pct) as margin,
      cast(sum(discount_pct) as double)/count(discount_pct) as discount
    from sales group by customer_id"""
_PROMOTE_SQL = """
    select row_number() over (order by min(date), product_name, margin_pct) as rank, product_name,
      round_even(cast(margin_pct as double)*100, 0)/100 as net_margin_pct
    from decided where decision = 'Promote' group by product_name, margin_pct qualify rank <= 3"""
_DECISION_COUNTS = """
    count(distinct product_id) filter (decision = 'Promote') as promote_count,
    count(distinct product_id) filter (decision = 'Discontinue') as discontinue_count,
    count(distinct customer_id) filter (decision = 'Renegotiate') as renegotiate_count"""
_LATE = "count(distinct customer_id) filter (days_overdue > 0) as slow_payer_count"

# name: (tables it needs, query)
_QUERIES = {
    "monthly_panel": (("sales", "panel"), "select * from panel"),
    "bucketed_monthly_panel": (("sales", "panel"), "select * from panel"),
    "panel_features": (_PANEL, "select * from features"),
    "panel_encodings": (
        _PANEL,
        """select 'product' as kind, product_id as value, cast(row_number() over (order by product_id) - 1 as bigint) as code
           from (select distinct product_id from features)
           union all
           select 'region', region, cast(row_number() over (order by first_product, region) - 1 as bigint)
           from (select region, min(product_id) as first_product from features group by region)""",
    ),
    "panel_split_counts": (
        _PANEL,
        """select position <= cut as is_train, count(*) as rows, min(product_id) as first_product,
             max(product_id) as last_product, min(position) as first_position, max(position) as last_position
           from (select *, row_number() over (order by product_id, region, date, product_name) as position from features),
             (select floor(cast(count(*) as double) * 0.8e0) as cut from features)
           group by 1""",
    ),
    "monthly_revenue": ((*_SERIES, "monthly"), "select * from monthly"),
    "revenue_anomalies": ((*_SERIES, "anomalies"), "select * from anomalies"),
    "last_month_revenue": ((*_SERIES, "recent"), "select * from recent"),
    "top_products_by_revenue": (("sales", "top_revenue"), "select * from top_revenue"),
    "fallback_forecast": (_FORECAST, "select * from forecast"),
    "forecast_trend": ((*_FORECAST, "trend"), "select * from trend"),
    "receivable_buckets": (
        ("receivables",),
        """select invoice_no, cast(bucket as bigint) as bucket, cast(p as double) as cprob,
             cast(invoice_amount * p as double) as exp_inflow
           from (select *, case bucket when 0 then 0.98 when 1 then 0.92 when 2 then 0.70 when 3 then 0.45 when 4 then 0.20 end as p
             from (select *, case when days_overdue <= -999 then null when days_overdue <= 0 then 0 when days_overdue <= 30 then 1
               when days_overdue <= 60 then 2 when days_overdue <= 90 then 3 when days_overdue <= 9999 then 4 end as bucket
               from receivables))""",
    ),
    "slow_payers": (("receivables", "payers"), "select * from payers"),
    "aging_counts": (
        ("receivables",),
        "select aging_bucket, count(*) as invoices from receivables group by aging_bucket",
    ),
    "overdue_by_region": (
        ("receivables",),
        """select region, round_even(cast(sum(invoice_amount) as double)*100, 0)/100 as overdue
           from receivables where days_overdue > 0 group by region""",
    ),
    "cashflow_totals": (("receivables", "cash"), "select * from cash"),
    "dead_by_category": (
        ("inventory",),
        """select category, count(sku) as count, round_even(cast(sum(total_value_inr) as double)*100, 0)/100 as value
           from inventory where is_dead_stock = 1 group by category""",
    ),
    "top_dead_skus": (("inventory", "dead"), "select * from dead"),
    "critical_reorders": (
        ("inventory",),
        """select sku, category, cast(current_stock_kg as double) as current_stock_kg, cast(reorder_point as double) as reorder_point,
             lead_time_days, cast(ideal_stock as double) as ideal_stock,
             row_number() over (order by current_stock_kg nulls last, sku) as rank
           from inventory where needs_reorder = 1 qualify rank <= 5""",
    ),
    "inventory_totals": (("inventory", "stock"), "select * from stock"),
    "mismatch_reasons": (
        ("gst",),
        "select mismatch_reason, count(*) as invoices from gst where mismatch_flag = 1 group by mismatch_reason",
    ),
    "supplier_risk": (("gst", "suppliers"), "select * from suppliers"),
    "mismatch_trend": (
        ("gst",),
        """select return_period, cast(sum(mismatch_flag) as bigint) as mismatches from gst group by return_period
           order by return_period desc limit 6""",
    ),
    "tax_totals": (("gst", "taxes"), "select * from taxes"),
    "decision_bands": (
        ("sales", "decided"),
        """select product_id, decision, count(*) as lines, cast(sum(revenue) as double) as revenue
           from decided group by product_id, decision""",
    ),
    "decision_counts": (
        ("sales", "decided"),
        f"select date, region, {_DECISION_COUNTS} from decided group by date, region",
    ),
    "top_products_by_margin": (
        ("sales",),
        """select product_id, product_name, round_even(m*100, 0)/100 as avg_margin, round_even(r*100, 0)/100 as total_revenue, rank
           from (select product_id, product_name, cast(sum(margin_pct) as double)/count(margin_pct) as m, cast(sum(revenue) as double) as r,
             row_number() over (order by cast(sum(margin_pct) as double)/count(margin_pct) desc nulls last, product_id, product_name) as rank
             from sales group by product_id, product_name) where rank <= 5""",
    ),
    "low_margin_customers": (
        ("sales",),
        """select customer_id, customer_name, round_even(m*100, 0)/100 as avg_margin, round_even(r*100, 0)/100 as total_revenue, rank
           from (select customer_id, customer_name, cast(sum(margin_pct) as double)/count(margin_pct) as m, cast(sum(revenue) as double) as r,
             row_number() over (order by cast(sum(margin_pct) as double)/count(margin_pct) nulls last, customer_id, customer_name) as rank
             from sales group by customer_id, customer_name) where rank <= 5""",
    ),
    "customer_features": (("sales",), _CUSTOMER_SQL),
    "products_to_promote": (("sales", "decided"), _PROMOTE_SQL),
    "products_to_discontinue": (("sales", "worst"), "select * from worst"),
    "kpi_summary": (_HEADLINES, _HEADLINE_SQL),
    "report_headlines": (_HEADLINES, _HEADLINE_SQL),
    "report_lists": (
        (*_FORECAST, "top_revenue", "receivables", "payers", "inventory", "dead", "gst"),
        """select 'forecast' as chart, cast(ds as varchar) as label, yhat as value from forecast
           union all select 'top_products', product_name, revenue from top_revenue
           union all select 'slow_payers', customer_name, total_overdue from payers
           union all select 'dead_stock', cast(sku as varchar), total_value_inr from dead
           union all select 'customer_risk', customer_name, round_even(m*100, 0)/100
             from (select customer_id, customer_name, cast(sum(margin_pct) as double)/count(margin_pct) as m
                   from sales group by customer_id, customer_name order by m nulls last, customer_id limit 5)
           union all select 'mismatch_types', mismatch_reason, cast(count(*) as double)
             from gst where mismatch_flag = 1 group by mismatch_reason""",
    ),
    "snapshot_headlines": (_HEADLINES, _HEADLINE_SQL),
    "report_json": (_FORECAST, "select strftime(ds, '%Y-%m-%d') as ds, yhat from forecast"),
    "incremental_panel_features": (_PANEL, "select * from features"),
    "incremental_customer_features": (("sales",), _CUSTOMER_SQL),
    "incremental_promotions": (("sales", "decided"), _PROMOTE_SQL),
    "decision_counts_by_grain": (
        ("sales", "decided"),
        f"""select 'month and region' as grain, strftime(date, '%Y-%m') as period, region, {_DECISION_COUNTS} from decided group by date, region
           union all select 'year', strftime(date, '%Y'), '', {_DECISION_COUNTS} from decided group by 2
           union all select 'all', '', '', {_DECISION_COUNTS} from decided""",
    ),
    "late_customers_by_grain": (
        ("receivables",),
        f"""select region, aging_bucket, {_LATE} from receivables group by region, aging_bucket
           union all select region, '', {_LATE} from receivables group by region
           union all select '', '', {_LATE} from receivables""",
    ),
    "csv_cashflow_totals": (("receivables", "cash"), "select * from cash"),
    "csv_rejects": (
        ("gst",),
        """select "column", 'rounded' as reason, count(*) as fields, count(distinct value) as texts
           from (unpivot (select cast(cgst_amount as decimal(18,7)) as cgst_amount, cast(sgst_amount as decimal(18,7)) as sgst_amount,
                   cast(total_tax_amount as decimal(18,7)) as total_tax_amount from gst)
                 on cgst_amount, sgst_amount, total_tax_amount into name "column" value value)
           where round(value, 4) <> value group by all""",
    ),
    "outlier_checks": (
        ("gst",),
        """select count(*) as scored_rows, true as scores_in_range, true as flagged_are_most_isolated, true as flagged_within_share from gst""",
    ),
    "quantile_of_tax": (
        ("gst",),
        """select unnest([0.0e0, 0.12e0, 0.5e0, 0.95e0, 1.0e0]) as share,
             round(unnest(quantile_cont(cast(total_tax_amount as double), [0.0, 0.12, 0.5, 0.95, 1.0])), 6) as value from gst""",
    ),
    "scaled_customers": (
        ("sales",),
        f"""select customer_id, round((revenue - avg(revenue) over ()) / stddev_samp(revenue) over (), 6) as revenue,
             round((margin - avg(margin) over ()) / stddev_samp(margin) over (), 6) as margin,
             round((discount - avg(discount) over ()) / stddev_samp(discount) over (), 6) as discount
           from ({_CUSTOMER_SQL})""",
    ),
    "segment_checks": (
        ("sales",),
        """select count(distinct customer_id) as customers, cast(3 as bigint) as segments, true as labels_by_margin, true as settled from sales""",
    ),
    "regressor_checks": (
        _PANEL,
        """select count(*) - cast(floor(cast(count(*) as double) * 0.8e0) as bigint) as test_rows,
             true as beats_the_mean, true as confidence_is_the_rest from features""",
    ),
    "seasonal_checks": (_FORECAST, "select ds, 'seasonal' as model, true as in_band from forecast"),
    "question_months": (
        (*_SERIES, "monthly", "questions", "asked"),
        """select q_id, asked.month, case when revenue is not null then 'known' else 'unknown' end as status,
             cast(trunc(revenue) as bigint) as revenue
           from asked left join (select * from monthly where revenue <> 0) m on asked.month = m.month
           where asked.month is not null""",
    ),
    "question_intents": (("questions", "asked"), "select q_id, intent from asked"),
    "answers": (
        (
            *_FORECAST, "trend", "monthly", "top_revenue", "decided", "worst", "receivables", "payers", "cash",
            "inventory", "dead", "stock", "gst", "suppliers", "taxes", "questions", "asked", "texts",
        ),
        """select q_id, asked.intent, asked.month, case
             when revenue is not null then 'Revenue in ' || asked.month || ' was ₹' || format('{:,}', cast(trunc(revenue) as bigint))
               || '.' || chr(10) || chr(10) || 'Action: compare it with the current forecast.'
             when asked.month is not null then 'There is no revenue on record for ' || asked.month || '.' || chr(10) || chr(10)
               || 'Action: look it up in the archived books.'
             else body end as answer
           from asked join texts on asked.intent = texts.intent
             left join (select * from monthly where revenue <> 0) m on asked.month = m.month""",
    ),
}


def oracle_sql() -> dict[str, str]:
    return {
        name: "with " + ",\n".join(f"{t} as ({TABLES[t]})" for t in needed) + f"\n{query}"
        for name, (needed, query) in _QUERIES.items()
    }
