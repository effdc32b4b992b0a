"""Registry entries beyond Q1-Q10: documented examples, described
computations, pivot, table-operation reports and metric expressions."""

from __future__ import annotations

from shopstar.plans import examples as D


def _examples(on):
    return {
        "d01_star_join": on(D.star_join, customer_cols=("customer_id", "state"), promo_cols=("promo_name",)),
        "d02_monthly_store_revenue": on(D.monthly_store_revenue),
        "d03_holiday_revenue": on(D.holiday_revenue),
        "d04_revenue_by_education": on(D.revenue_by_education),
        "d05_top_customer_states": on(D.top_customer_states),
        "d06_preferred_revenue": on(D.preferred_revenue),
        "d07_store_category_revenue": on(D.store_category_revenue),
        "d08_brand_margin": on(D.brand_margin),
        "d09_promoted_vs_not": on(D.promoted_vs_not),
        "d10_promo_channel_effect": on(D.promo_channel_effect),
        "d11_roi_by_purpose": on(D.roi_by_purpose),
        "d11_roi_by_purpose_corrected": on(D.roi_by_purpose, corrected=True),
        "d12_store_state_revenue": on(D.store_state_revenue),
        "d13_store_size_revenue": on(D.store_size_revenue),
        "d14_catalog_category_revenue": on(D.catalog_category_revenue),
        "d15_catalog_promotions": on(D.catalog_promotions),
        "d16_channel_union_revenue": on(D.channel_union_revenue),
        "d17_top_products": on(D.top_products),
        "d18_avg_basket_size": on(D.avg_basket_size),
        "d19_web_monthly_total": on(D.web_monthly_total),
        "d20_gift_line_items": on(D.gift_line_items),
        "d21_channel_totals": on(D.channel_totals),
        "d22_catalog_department_revenue": on(D.catalog_department_revenue),
        "d23_lowest_current_stock": on(D.lowest_current_stock),
        "d24_item_stock_trend": on(D.item_stock_trend),
        "d25_low_stock": on(D.low_stock),
        "d26_top_return_reasons": on(D.top_return_reasons),
        "d27_return_rate_by_category": on(D.return_rate_by_category),
        "d28_sales_by_shift": on(D.sales_by_shift),
        "d29_stock_by_warehouse": on(D.stock_by_warehouse),
        "d29_stock_by_warehouse_latest": on(D.stock_by_warehouse, latest_only=True),
        "d30_web_page_type_revenue": on(D.web_page_type_revenue),
        "d31_recent_runs": on(D.recent_runs),
        "d32_hours_since_success": on(D.hours_since_success),
    }


def more_queries(on):
    out = {}
    out.update(_examples(on))
    from shopstar.plans import described as N
    from shopstar.plans import layoutops as Y
    from shopstar.plans import operations as O
    from shopstar.plans import tableops as X
    from shopstar.plans import tables as T
    out.update(N.registry(on))
    out.update(O.registry(on))
    out.update(T.registry(on))
    out.update(X.registry(on))
    out.update(Y.registry(on))
    return out


def more_sql():
    from shopstar.plans.examples_sql import SQL as DSQL
    out = dict(DSQL)
    from shopstar.plans.described_sql import SQL as NSQL
    from shopstar.plans.layoutops_sql import SQL as YSQL
    from shopstar.plans.operations_sql import SQL as OSQL
    from shopstar.plans.tableops_sql import SQL as XSQL
    from shopstar.plans.tables_sql import SQL as TSQL
    out.update(NSQL)
    out.update(OSQL)
    out.update(TSQL)
    out.update(XSQL)
    out.update(YSQL)
    return out
