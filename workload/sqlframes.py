"""The derivations of ``frames.py`` in SQL, as named parts that queries put together."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {
    "weekly": """
        SELECT l_suppkey AS security_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS lines,
               CAST(sum(l_partkey % 97) AS BIGINT) AS mix
        FROM lineitem GROUP BY 1, 2""",
    "price": """
        SELECT w.date, printf('%06d.SH', w.security_id) AS symbol, CAST(cents AS DOUBLE) / CAST(qty AS DOUBLE) / 100.0 AS close,
               CAST(cents AS DOUBLE) / 100.0 AS amount, qty AS volume, s_acctbal / 100.0 AS pe_ttm
        FROM weekly w JOIN supplier s ON s.s_suppkey = w.security_id""",
    "daily_vol": """
        SELECT printf('%06d.SH', security_id) AS symbol, date AS trade_date, CAST(mix + 1 AS DOUBLE) / 1000.0 AS volatility FROM weekly""",
    "event_days": """
        SELECT symbol, CAST(ts AS DATE) AS day, stddev_samp(r) AS volatility FROM (
          SELECT *, close / lag(close) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) - 1.0 AS r FROM (
            SELECT printf('%06d.SH', user_id % (SELECT count(*) FROM supplier)) AS symbol, ts, max(value) AS close FROM events GROUP BY 1, 2)) GROUP BY symbol, CAST(ts AS DATE)""",
    "event_vol": """
        SELECT d.symbol, c.date AS trade_date, d.volatility FROM event_days d
        JOIN calendar c ON c.market_index % (SELECT CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) + 1 FROM events) = d.day - (SELECT CAST(min(ts) AS DATE) FROM events)""",
    "pb": """
        SELECT date, printf('%06d.SH', security_id) AS symbol, CAST(qty AS DOUBLE) / CAST(lines AS DOUBLE) / 10.0 AS pb_ratio_lf FROM weekly""",
    "ord": """
        SELECT printf('%06d.SH', o_custkey % (SELECT count(*) FROM supplier)) AS symbol, o_custkey % (SELECT count(*) FROM supplier) AS security_id,
               CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders""",
    "dividends": """
        SELECT symbol, year, day AS announce_date, day AS record_date, day + 1 AS operate_date, day + 20 AS payment_date,
               cents / CAST(orders AS DOUBLE) / 100000.0 AS cash_dividend_before_tax
        FROM (SELECT symbol, CAST(year(day) AS INTEGER) AS year, min(day) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS cents, count(*) AS orders
              FROM ord GROUP BY 1, 2)""",
    "shares": """
        SELECT symbol, day AS publish_date, max(CAST(round(o_totalprice * 1000) AS BIGINT)) AS total_shares, day - 30 AS report_date
        FROM ord GROUP BY symbol, day""",
    "factors": """
        SELECT symbol, operate_date, 1.0::DOUBLE + CAST(row_number() OVER (PARTITION BY symbol ORDER BY operate_date) AS DOUBLE) / 1000.0 AS back_adjust_factor
        FROM (SELECT DISTINCT symbol, day AS operate_date FROM ord)""",
    "fcoverage": """
        SELECT printf('%06d.SH', security_id) AS symbol, make_date(y, 1, 1) AS start, make_date(y, 12, 31) AS "end"
        FROM (SELECT security_id, unnest(generate_series(CAST(year(min(date)) AS BIGINT), CAST(year(max(date)) AS BIGINT))) AS y
              FROM weekly GROUP BY security_id)""",
    "dqueries": """
        SELECT printf('%06d.SH', s_suppkey) AS symbol, CAST(unnest(generate_series(1992, 2002)) AS INTEGER) AS year FROM supplier""",
    "minute_raw": """
        SELECT event_type AS symbol, date_trunc('minute', ts) AS datetime, event_id, value AS close, value AS open, value AS high, value AS low,
               1.0::DOUBLE AS volume, value AS total_turnover FROM events""",
    "minute": """
        SELECT symbol, datetime, arg_min(open, event_id) AS open, max(high) AS high, min(low) AS low, arg_max(close, event_id) AS close,
               CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(round(close * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS total_turnover
        FROM minute_raw GROUP BY symbol, datetime""",
    "minute_days": """
        SELECT symbol, CAST(unnest(generate_series(CAST(a AS TIMESTAMP) - INTERVAL 2 DAY, CAST(b AS TIMESTAMP) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS trade_date
        FROM (SELECT symbol, CAST(min(datetime) AS DATE) AS a, CAST(max(datetime) AS DATE) AS b FROM minute_raw GROUP BY symbol)""",
    "month_ends": """
        SELECT max(date) AS date, CAST(date_trunc('month', date) AS DATE) AS period FROM weekly GROUP BY 2""",
    "history": """
        SELECT e.date, t.symbol
        FROM (SELECT quarter, printf('%06d.SH', security_id) AS symbol FROM (
                SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY cents DESC, security_id) AS n
                FROM (SELECT CAST(date_trunc('quarter', date) AS DATE) AS quarter, security_id, CAST(sum(cents) AS BIGINT) AS cents FROM weekly GROUP BY 1, 2))
              WHERE n <= 20) t
        JOIN month_ends e ON CAST(date_trunc('quarter', e.date) AS DATE) = t.quarter""",
    "constituents": "SELECT date AS effective_date, 'H30269' AS index_code, symbol FROM history",
    "index_close": """
        SELECT date, CAST(sum(cents) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) / 100.0 AS close FROM weekly GROUP BY date""",
    "calendar": """
        SELECT date, row_number() OVER (ORDER BY date) AS market_index, lead(date) OVER (ORDER BY date) AS next_date
        FROM (SELECT DISTINCT date FROM weekly)""",
    "as_of": """
        SELECT max(date) AS as_of_date FROM weekly WHERE date BETWEEN DATE '1998-01-01' AND DATE '2001-06-30' GROUP BY date_trunc('month', date)""",
    # Features of every quote, by plain joins and windows.
    "caps": """
        SELECT p.*, c.market_index, s.publish_date, s.total_shares, p.close * s.total_shares AS total_market_cap
        FROM price p JOIN calendar c USING (date) ASOF LEFT JOIN shares s ON p.symbol = s.symbol AND p.date >= s.publish_date""",
    "adjusted": """
        SELECT p.date, p.symbol, p.close, p.close * coalesce(f.back_adjust_factor, 1.0) AS adjusted_close
        FROM price p ASOF LEFT JOIN factors f ON p.symbol = f.symbol AND p.date >= f.operate_date""",
    "ttm": """
        SELECT p.symbol, p.date, coalesce(sum(d.cash_dividend_before_tax), 0.0) * 0.9 AS cash_ttm
        FROM price p LEFT JOIN dividends d ON d.symbol = p.symbol AND d.announce_date <= p.date AND d.announce_date > p.date - 365
        GROUP BY 1, 2""",
    "features": """
        SELECT c.symbol, c.date, c.market_index, c.close, c.amount, c.pe_ttm, c.total_market_cap, t.cash_ttm, a.adjusted_close,
               t.cash_ttm / c.close AS dividend_yield_ttm, a.adjusted_close / lag(a.adjusted_close) OVER w - 1.0 AS ret,
               row_number() OVER w AS observation_count,
               avg(c.total_market_cap) OVER (PARTITION BY c.symbol ORDER BY c.market_index RANGE BETWEEN 25 PRECEDING AND CURRENT ROW) AS avg_market_cap_240d,
               avg(c.amount) OVER (PARTITION BY c.symbol ORDER BY c.market_index RANGE BETWEEN 25 PRECEDING AND CURRENT ROW) AS avg_amount_240d,
               avg(t.cash_ttm / c.close) OVER (PARTITION BY c.symbol ORDER BY c.date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS avg_dividend_yield_3y
        FROM caps c JOIN ttm t ON t.symbol = c.symbol AND t.date = c.date JOIN adjusted a ON a.symbol = c.symbol AND a.date = c.date
        WINDOW w AS (PARTITION BY c.symbol ORDER BY c.date)""",
    "vols": """
        SELECT *, CASE WHEN observation_count >= 12 THEN
                 stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) END AS volatility_240d
        FROM features""",
    "snapshot": "SELECT v.* FROM vols v JOIN as_of a ON a.as_of_date = v.date WHERE v.market_index >= 26",
    "market_pass": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY date ORDER BY avg_market_cap_240d DESC NULLS LAST, symbol) AS cap_rank,
                 row_number() OVER (PARTITION BY date ORDER BY avg_amount_240d DESC NULLS LAST, symbol) AS amount_rank,
                 count(avg_market_cap_240d) OVER (PARTITION BY date) AS cap_n, count(avg_amount_240d) OVER (PARTITION BY date) AS amount_n
          FROM snapshot)
        WHERE avg_market_cap_240d IS NOT NULL AND cap_rank <= floor(cap_n * CAST(0.8 AS DOUBLE))
          AND amount_rank <= floor(amount_n * CAST(0.8 AS DOUBLE)) AND observation_count >= 52""",
    "annual": """
        SELECT m.symbol, m.date, k.k AS back, coalesce(sum(d.cash_dividend_before_tax), 0.0) * 0.9 AS cash
        FROM market_pass m CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(k)
        LEFT JOIN dividends d ON d.symbol = m.symbol AND d.announce_date <= m.date AND year(d.announce_date) = year(m.date) - k.k
        GROUP BY 1, 2, 3""",
    "years": """
        SELECT symbol, date, max(cash) FILTER (back = 0) AS y0, max(cash) FILTER (back = 1) AS y1, max(cash) FILTER (back = 2) AS y2,
               max(cash) FILTER (back = 3) AS y3 FROM annual GROUP BY 1, 2""",
    "quality": """
        SELECT *, CASE WHEN late THEN y0 > 0 AND y1 > 0 AND y2 > 0 ELSE y1 > 0 AND y2 > 0 AND y3 > 0 END AS consecutive_dividends,
               CASE WHEN abs(raw_slope) <= 1e-12 THEN 0.0 ELSE raw_slope END AS dividend_growth_slope
        FROM (SELECT m.*, y0, y1, y2, y3, month(m.date) = 12 AND day(m.date) >= 21 AS late,
                     CASE WHEN y0 > 0 THEN (y0 - y2) / 2.0 ELSE (y1 - y3) / 2.0 END AS raw_slope,
                     m.dividend_yield_ttm * m.pe_ttm AS payout_ratio
              FROM market_pass m JOIN years y ON y.symbol = m.symbol AND y.date = m.date)""",
    "universe": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY payout_ratio DESC NULLS LAST, symbol) AS payout_rank,
                              count(payout_ratio) OVER (PARTITION BY date) AS payout_n FROM quality WHERE consecutive_dividends)
        WHERE payout_ratio >= 0 AND dividend_growth_slope >= 0 AND NOT payout_rank <= floor(payout_n * CAST(0.05 AS DOUBLE))""",
    "candidates": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY avg_dividend_yield_3y DESC, symbol) AS dividend_yield_rank FROM universe)
        WHERE dividend_yield_rank <= 15""",
    "chosen": """
        SELECT *, avg_dividend_yield_3y / sum(avg_dividend_yield_3y) OVER (PARTITION BY date) AS weight
        FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volatility_240d, symbol) AS volatility_rank FROM candidates WHERE volatility_240d IS NOT NULL)
        WHERE volatility_rank <= 8 QUALIFY count(*) OVER (PARTITION BY date) = 8""",
    # Intraday factor of the candidates.
    "member_dates": """
        SELECT as_of_date, trade_date FROM (
          SELECT c.date AS as_of_date, p.date AS trade_date, row_number() OVER (PARTITION BY c.date ORDER BY p.date DESC) AS n
          FROM (SELECT DISTINCT c.date, p.date AS d FROM candidates c JOIN price p ON p.symbol = c.symbol AND p.date <= c.date) c(date, d)
          JOIN (SELECT DISTINCT date FROM price) p ON p.date = c.d) WHERE n <= 12""",
    "member_cv": """
        SELECT c.date AS as_of_date, c.symbol, stddev_samp(v.volatility) / avg(v.volatility) AS cv
        FROM candidates c JOIN member_dates m ON m.as_of_date = c.date JOIN event_vol v ON v.symbol = c.symbol AND v.trade_date = m.trade_date
        WHERE v.volatility > 0 GROUP BY 1, 2 HAVING count(*) >= 4""",
    "member_size": """
        SELECT m.*, ln(k.total_market_cap) AS log_market_cap FROM member_cv m
        ASOF JOIN (SELECT symbol, date, total_market_cap FROM caps WHERE total_market_cap > 0) k ON k.symbol = m.symbol AND m.as_of_date >= k.date""",
    "hf": """
        SELECT f.as_of_date, f.symbol, f.cv AS intraday_volatility_cv, f.log_market_cap,
               f.cv - (g.my + coalesce(g.b, 0.0) * (f.log_market_cap - g.mx)) AS minute_return_volatility
        FROM member_size f JOIN (SELECT as_of_date, regr_slope(cv, log_market_cap) AS b, avg(cv) AS my, avg(log_market_cap) AS mx
                                 FROM member_size GROUP BY 1 HAVING count(*) >= 2) g USING (as_of_date)""",
    "hf_candidates": """
        SELECT * FROM (SELECT c.*, h.intraday_volatility_cv, h.log_market_cap, h.minute_return_volatility, count(*) OVER (PARTITION BY c.date) AS joined_n
                       FROM candidates c JOIN hf h ON h.as_of_date = c.date AND h.symbol = c.symbol) WHERE joined_n >= 8""",
    "hf_chosen": """
        SELECT *, avg_dividend_yield_3y / sum(avg_dividend_yield_3y) OVER (PARTITION BY date) AS weight
        FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY minute_return_volatility, symbol) AS volatility_rank FROM hf_candidates)
        WHERE volatility_rank <= 8""",
}


def parts(select: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause of every named part the query reaches, then the query."""
    known = {**PARTS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                needed.append(name)

    visit(select)
    clauses = ",\n".join(f"{name} AS ({known[name].strip()})" for name in needed)
    return f"WITH {clauses}\n{select.strip()}" if clauses else select.strip()


def nav_parts(weights: str, prices: str = "adjusted", close: str = "adjusted_close") -> dict[str, str]:
    """Parts that value portfolios between their weight dates without costs.

    ``weights`` selects (portfolio, date, symbol, weight); prices are carried forward.
    """
    return {
        "wts": weights,
        "wdates": "SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM wts)",
        "held": f"""
            SELECT w.portfolio, w.date, w.symbol, w.weight, d.next_date, a.{close} AS p0
            FROM wts w JOIN wdates d USING (date) ASOF LEFT JOIN {prices} a ON a.symbol = w.symbol AND w.date >= a.date""",
        "grown": f"""
            SELECT h.portfolio, h.date, h.next_date, h.symbol, h.weight, h.p0, b.{close} AS p1
            FROM (SELECT * FROM held WHERE next_date IS NOT NULL) h ASOF LEFT JOIN {prices} b ON b.symbol = h.symbol AND h.next_date >= b.date""",
        "steps": """
            SELECT portfolio, date, 0.0::DOUBLE AS r FROM (SELECT portfolio, min(date) AS date FROM wts GROUP BY 1)
            UNION ALL SELECT portfolio, next_date, sum(weight * p1 / p0) - 1.0 FROM grown GROUP BY 1, 2""",
        "nav": """
            SELECT portfolio, date, r, product(1.0 + r) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM steps""",
    }
