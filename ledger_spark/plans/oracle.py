"""SQL twins of the named queries, for DuckDB on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from ledger_spark.plans.queries import CUT, EXPLORE

_MONTHS = "month(date) AS month, year(date) AS year, strftime(date, '%Y-%m') AS year_month"

_ORDERS_RAW = """
SELECT CAST(o_custkey AS VARCHAR) AS statement_id, o_orderkey AS seq, o_custkey AS account_id,
  o_orderdate AS date, 'CUST ' || CAST(o_custkey AS VARCHAR) AS description,
  CAST(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END
    AS DECIMAL(18,2)) AS raw,
  CASE o_orderstatus WHEN 'O' THEN 'credit' WHEN 'F' THEN 'debit' END AS type,
  nullif(o_orderpriority, '5-LOW') AS raw_category
FROM orders"""

_LINES_RAW = """
SELECT CAST(l_suppkey AS VARCHAR) AS statement_id, l_suppkey AS account_id, l_shipdate AS date,
  p_name AS description, CAST(l_extendedprice AS DECIMAL(18,2)) AS raw,
  CASE WHEN l_returnflag = 'A' THEN 'credit' ELSE 'debit' END AS type, p_brand AS raw_category
FROM lineitem JOIN part ON l_partkey = p_partkey"""

_EVENTS_RAW = """
SELECT CAST(user_id AS VARCHAR) AS statement_id, event_id AS seq, user_id AS account_id,
  ts AS date, event_type || ' ' || json_extract_string(props, '$.k') AS description,
  CAST(CAST(value AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) AS raw,
  CASE WHEN event_type = 'purchase' THEN 'credit' ELSE 'debit' END AS type,
  event_type AS raw_category
FROM events"""


def _signed(raw: str) -> str:
    return f"""
SELECT * EXCLUDE (raw, raw_category),
  CASE type WHEN 'debit' THEN -abs(raw) WHEN 'credit' THEN abs(raw) ELSE raw END AS amount,
  coalesce(raw_category, 'Other') AS category, {_MONTHS}
FROM ({raw})"""


ORDERS, LINES, EVENTS = _signed(_ORDERS_RAW), _signed(_LINES_RAW), _signed(_EVENTS_RAW)


def _list(account: bool, *more: str) -> str:
    return ", ".join((["account_id"] if account else []) + list(more))


def _pre(account: bool) -> str:
    return "account_id, " if account else ""


def _group(account: bool, *more: str) -> str:
    columns = _list(account, *more)
    return f"GROUP BY {columns}" if columns else ""


def _over(account: bool, order: str) -> str:
    return f"({'PARTITION BY account_id ' if account else ''}ORDER BY {order})"


def _join(account: bool) -> str:
    return "USING (account_id)" if account else "ON TRUE"


def _d(text: str, name: str) -> str:
    return f"CAST({text} AS DOUBLE) AS {name}"


_RATE = (
    "CASE WHEN income = 0 THEN 0.0 ELSE round_even(CAST(income - expenses AS DOUBLE) "
    "/ CAST(income AS DOUBLE) * 100.0 * 100.0, 0) / 100.0 END"
)


def _months(source: str, account: bool) -> str:
    by = _list(account, "year_month")
    return f"""
SELECT {by}, coalesce(sum(amount) FILTER (amount > 0), 0) AS income,
  abs(coalesce(sum(amount) FILTER (amount < 0), 0)) AS expenses
FROM ({source}) WHERE year_month IS NOT NULL AND amount <> 0 GROUP BY {by}"""


def _spent(source: str, *by: str) -> str:
    columns = ", ".join(by)
    return (
        f"SELECT {columns}, abs(sum(amount)) AS amount FROM ({source}) "
        f"WHERE amount < 0 GROUP BY {columns}"
    )


def _ranked(source: str, account: bool, order: str) -> str:
    return f"SELECT *, row_number() OVER {_over(account, order)} AS rank FROM ({source})"


def monthly_cash_flow(source: str, account: bool) -> str:
    by = _list(account, "year_month")
    return f"""SELECT {by}, {_d('coalesce(sum(amount), 0)', 'net_flow')},
  count(amount) AS num_transactions
FROM ({source}) WHERE year_month IS NOT NULL GROUP BY {by}"""


def monthly_income_vs_expenses(source: str, account: bool) -> str:
    return f"""SELECT {_list(account, 'year_month')}, {_d('income', 'income')},
  {_d('expenses', 'expenses')}, {_d('income - expenses', 'savings')}, {_RATE} AS savings_rate
FROM ({_months(source, account)})"""


def monthly_bars(source: str, account: bool) -> str:
    return f"""SELECT {_list(account, 'year_month')}, {_d('income', 'income')},
  {_d('expenses', 'expenses')} FROM ({_months(source, account)})"""


def savings_rate_series(source: str, account: bool) -> str:
    return f"""SELECT {_list(account, 'year_month')}, {_RATE} AS savings_rate,
  CAST(20 AS DOUBLE) AS target FROM ({_months(source, account)})"""


def category_spending(source: str, account: bool) -> str:
    by = _list(account, "category")
    return f"SELECT {by}, {_d('amount', 'amount')} FROM ({_spent(source, by)})"


def monthly_category_spending(source: str, account: bool) -> str:
    by = _list(account, "year_month", "category")
    return f"""SELECT {by}, {_d('amount', 'amount')} FROM ({_spent(source, by)})
WHERE year_month IS NOT NULL"""


def top_categories(source: str, account: bool) -> str:
    by = _list(account, "category")
    ranked = _ranked(_spent(source, by), account, "amount DESC, category")
    return f"SELECT {by}, {_d('amount', 'amount')} FROM ({ranked}) WHERE rank <= 5"


def spending_breakdown(source: str, account: bool) -> str:
    by = _list(account, "category")
    partition = "PARTITION BY account_id" if account else ""
    return f"""WITH ranked AS (
  SELECT *, row_number() OVER {_over(account, 'amount DESC, category')} AS rank,
    count(*) OVER ({partition}) AS labels, sum(amount) OVER ({partition}) AS total
  FROM ({_spent(source, by)})),
sliced AS (
  SELECT {_pre(account)} CASE WHEN labels > 10 AND rank > 9 THEN 'Other' ELSE category END
      AS category, labels > 10 AND rank > 9 AS is_bucket, amount, total FROM ranked)
SELECT {_list(account, 'category', 'is_bucket')}, {_d('sum(amount)', 'amount')},
  CAST(sum(amount) AS DOUBLE) / CAST(max(total) AS DOUBLE) * 100.0 AS share
FROM sliced GROUP BY {_list(account, 'category', 'is_bucket')}"""


def category_trend(source: str, account: bool) -> str:
    by = _list(account, "category")
    both = _list(account, "year_month", "category")
    ranked = _ranked(_spent(source, by), account, "amount DESC, category")
    match = "(account_id, category)" if account else "category"
    return f"""WITH top AS (SELECT {by} FROM ({ranked}) WHERE rank <= 5)
SELECT {both}, {_d('amount', 'amount')} FROM ({_spent(source, both)})
WHERE year_month IS NOT NULL AND {match} IN (SELECT {match} FROM top)"""


def _profile(source: str, account: bool) -> str:
    k = _pre(account)
    by = _list(account, "category")
    return f"""WITH months AS ({_months(source, account)}),
means AS (
  SELECT {k} CAST(sum(income) AS DOUBLE) / count(*) AS avg_monthly_income,
    CAST(sum(expenses) AS DOUBLE) / count(*) AS avg_monthly_expenses,
    CAST(sum(CAST({_RATE} AS DECIMAL(38,2))) AS DOUBLE) / count(*) AS avg_savings_rate
  FROM months {_group(account)}),
labels AS ({_ranked(_spent(source, by), account, 'amount DESC, category')}),
tops AS (
  SELECT {k} max(category) FILTER (rank = 1) AS top_expense_category,
    max(amount) FILTER (rank = 1) AS top_amount, count(*) AS expense_categories
  FROM labels {_group(account)}),
totals AS (
  SELECT {k} coalesce(sum(amount) FILTER (amount > 0), 0) AS income,
    abs(coalesce(sum(amount) FILTER (amount < 0), 0)) AS expenses,
    coalesce(sum(amount), 0) AS net, count(*) AS transaction_count,
    strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') AS date_range
  FROM ({source}) {_group(account)})
SELECT {k} {_d('income', 'total_income')}, {_d('expenses', 'total_expenses')},
  {_d('net', 'net_flow')}, avg_monthly_income, avg_monthly_expenses, avg_savings_rate,
  top_expense_category, {_d('coalesce(top_amount, 0)', 'top_expense_amount')},
  transaction_count, date_range, coalesce(expense_categories, 0) AS expense_categories
FROM totals LEFT JOIN means {_join(account)} LEFT JOIN tops {_join(account)}"""


def summary(source: str, account: bool) -> str:
    return f"SELECT * EXCLUDE (expense_categories) FROM ({_profile(source, account)})"


def running_balance(source: str, account: bool) -> str:
    order = "date ASC NULLS LAST, statement_id, seq"
    partition = "PARTITION BY account_id" if account else ""
    return f"""SELECT {_pre(account)} statement_id, seq, date,
  CAST(CASE WHEN amount IS NOT NULL THEN sum(coalesce(amount, 0)) OVER ({partition}
    ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS DOUBLE)
    AS running_balance
FROM ({source})"""


def balance_line() -> str:
    return f"SELECT date, running_balance FROM ({running_balance(ORDERS, False)})"


def _opened_balance(source: str, account: bool) -> str:
    opening = "CAST(account_id * 10 + 0.25 AS DECIMAL(28,2))" if account else "100.50"
    order = "date ASC NULLS LAST, statement_id, seq"
    partition = "PARTITION BY account_id" if account else ""
    return f"""SELECT {_pre(account)} statement_id, seq, date, CAST(CASE WHEN amount IS NOT NULL THEN {opening}
  + sum(coalesce(amount, 0)) OVER ({partition} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END
  AS DOUBLE) AS running_balance FROM ({source})"""


# Event transactions whose text is spoilt here and there; each case is spelled out.
_DIRTY = f"""SELECT statement_id, seq, account_id, description, type, raw_category AS category,
  CASE seq % 17 WHEN 0 THEN 'abc' WHEN 1 THEN '100000000000000000' WHEN 2 THEN '' WHEN 3 THEN NULL
    WHEN 4 THEN ' -12.5 ' WHEN 5 THEN '1e400' WHEN 6 THEN 'nan' ELSE CAST(raw AS VARCHAR) END AS text,
  CASE WHEN seq % 17 = 4 THEN -12.50 WHEN seq % 17 > 6 THEN raw END AS raw,
  CASE WHEN seq % 13 = 4 THEN TIMESTAMP '2024-01-05 06:07:08'
    WHEN seq % 13 > 5 THEN CAST(CAST(date AS DATE) AS TIMESTAMP) END AS date
FROM ({_EVENTS_RAW})"""


def _dirty_normalized() -> str:
    return f"""SELECT statement_id, seq, account_id, description, type, category, date, {_MONTHS},
  {_d("CASE type WHEN 'debit' THEN -abs(raw) WHEN 'credit' THEN abs(raw) ELSE raw END", 'amount')} FROM ({_DIRTY})"""


def _rejected_amounts() -> str:
    return f"""SELECT statement_id, seq, account_id, text AS amount,
  CASE WHEN seq % 17 IN (1, 5) THEN 'too large' ELSE 'not a number' END AS reason
FROM ({_DIRTY}) WHERE seq % 17 IN (0, 1, 2, 5, 6)"""


def _amount_counts(source: str, account: bool) -> str:
    return f"""SELECT {_pre(account)} count(*) AS rows, count(raw) AS amounts, count(*) FILTER (text IS NULL) AS missing,
  count(*) FILTER (seq % 17 IN (0, 2, 6)) AS not_numbers, count(*) FILTER (seq % 17 IN (1, 5)) AS too_large
FROM ({source}) {_group(account)}"""


def balance_bounds(source: str, account: bool) -> str:
    return f"""SELECT {_pre(account)} min(date) AS start_date, max(date) AS end_date,
  CAST(0 AS DOUBLE) AS zero FROM ({source}) {_group(account)}"""


def _income(source: str, account: bool) -> str:
    by = _list(account, "description")
    return (
        f"SELECT {by}, sum(amount) AS amount FROM ({source}) "
        f"WHERE amount > 0 AND description IS NOT NULL GROUP BY {by}"
    )


def income_by_description(source: str, account: bool) -> str:
    return f"""SELECT {_list(account, 'description')}, {_d('amount', 'amount')}
FROM ({_income(source, account)})"""


def _top_income(source: str, account: bool) -> str:
    ranked = _ranked(_income(source, account), account, "amount DESC, description")
    return f"SELECT * FROM ({ranked}) WHERE rank <= 3"


def top_income_sources(source: str, account: bool) -> str:
    return f"""SELECT {_list(account, 'description')}, {_d('amount', 'amount')}
FROM ({_top_income(source, account)})"""


def expense_frequency(source: str, account: bool) -> str:
    by = _list(account, "description")
    return f"""SELECT {by}, count(*) AS frequency FROM ({source})
WHERE amount < 0 AND description IS NOT NULL GROUP BY {by}"""


def _recurring(source: str, account: bool) -> str:
    repeated = f"SELECT * FROM ({expense_frequency(source, account)}) WHERE frequency > 1"
    ranked = _ranked(repeated, account, "frequency DESC, description")
    return f"SELECT * FROM ({ranked}) WHERE rank <= 5"


def recurring_expenses(source: str, account: bool) -> str:
    return f"""SELECT {_list(account, 'description', 'frequency')}
FROM ({_recurring(source, account)})"""


def _moments(source: str, account: bool) -> str:
    """Counts, sums and sums of squares of expenses in whole cents."""
    cents = "CAST(-amount * 100 AS HUGEINT)"
    return f"""SELECT {_pre(account)} count(*) AS rows, count(*) FILTER (amount < 0) AS n,
  sum(amount) FILTER (amount < 0) AS expense_sum,
  sum({cents}) FILTER (amount < 0) AS s, sum({cents} * {cents}) FILTER (amount < 0) AS q,
  count(*) FILTER (amount < 0 AND amount > -500) AS small_expenses
FROM ({source}) {_group(account)}"""


def expense_stats(source: str, account: bool) -> str:
    n = "CAST(n AS DOUBLE)"
    spread = "CAST(CAST(n * q - s * s AS VARCHAR) AS DOUBLE)"
    # the lowest whole number of cents that is too large, less one: found by trial around the rounded root
    by = "AND m.account_id IS NOT DISTINCT FROM t.account_id" if account else ""
    return f"""WITH m AS ({_moments(source, account)}),
tried AS (SELECT {_pre(account)} max(x) AS limit_cents FROM (
    SELECT {_pre(account)} n, s, q, unnest(range(-3, 4)) + CAST(floor((s + sqrt(4.0 * n * (n * q - s * s) / (n - 1))) / n)
      AS BIGINT) AS x FROM m WHERE n > 1)
  WHERE n * x <= s OR CAST(n * x - s AS HUGEINT) * (n * x - s) * (n - 1) <= 4 * CAST(n AS HUGEINT) * (n * q - s * s)
  {_group(account)})
SELECT {', '.join('m.' + c for c in (['account_id'] if account else []) + ['rows'])}, n AS expenses,
  {_d('expense_sum', 'expense_sum')},
  CAST(expense_sum AS DOUBLE) / nullif({n}, 0) AS expense_mean,
  sqrt({spread} / ({n} * nullif(CAST(n - 1 AS DOUBLE), 0))) / 100.0 AS expense_stddev, small_expenses,
  -CAST(limit_cents AS DOUBLE) / 100.0 AS large_bound
FROM m LEFT JOIN tried t ON TRUE {by}"""


def small_expense_count(source: str, account: bool) -> str:
    return f"""SELECT {_pre(account)}
  count(*) FILTER (amount < 0 AND amount > -500) AS small_expenses
FROM ({source}) {_group(account)}"""


def _large(source: str, account: bool) -> str:
    columns = _list(account, "statement_id", "seq", "date", "description", "amount")
    excess = "(n * CAST(-amount * 100 AS HUGEINT) - s)"
    return f"""SELECT {columns} FROM (SELECT * FROM ({source}) WHERE amount < 0)
JOIN ({_moments(source, account)}) {_join(account)}
WHERE n > 1 AND {excess} > 0 AND {excess} * {excess} * (n - 1) > 4 * n * (n * q - s * s)"""


def large_expenses(source: str, account: bool) -> str:
    return f"""SELECT * EXCLUDE (amount), {_d('amount', 'amount')}
FROM ({_large(source, account)})"""


def _first_large(source: str, account: bool) -> str:
    ranked = _ranked(_large(source, account), account, "statement_id, seq")
    return f"SELECT * FROM ({ranked}) WHERE rank <= 3"


def first_large_expenses(source: str, account: bool) -> str:
    return f"""SELECT * EXCLUDE (amount, rank), {_d('amount', 'amount')}
FROM ({_first_large(source, account)})"""


def _money(value: str) -> str:
    return f"'₹' || format('{{:,.2f}}', CAST({value} AS DOUBLE))"


def _pattern_lines(source: str, account: bool) -> str:
    k, join = _pre(account), _join(account)
    by = _list(account, "category")
    labels = _ranked(_spent(source, by), account, "amount DESC, category")
    large = (
        "'- ' || coalesce(strftime(date, '%Y-%m-%d'), '') || ' | ' || coalesce(description, '') "
        f"|| ' | ' || {_money('amount')}"
    )
    return f"""WITH keyed AS ({small_expense_count(source, account)}),
income AS (SELECT {k} string_agg('- ' || description || ': ' || {_money('amount')}, chr(10)
  ORDER BY rank) AS lines FROM ({_top_income(source, account)}) {_group(account)}),
labels AS (SELECT {k} string_agg('- ' || category || ': ' || {_money('amount')}, chr(10)
  ORDER BY rank) AS lines FROM ({labels}) {_group(account)}),
repeated AS (SELECT {k} string_agg(description, ', ' ORDER BY rank) AS list,
  string_agg('- ' || description, chr(10) ORDER BY rank) AS lines
  FROM ({_recurring(source, account)}) {_group(account)}),
large AS (SELECT {k} string_agg({large}, chr(10) ORDER BY rank) AS lines
  FROM ({_first_large(source, account)}) {_group(account)})
SELECT {k} coalesce(income.lines, '') AS income_lines,
  coalesce(labels.lines, '') AS category_lines,
  coalesce(repeated.list, 'None identified') AS recurring_list,
  coalesce(repeated.lines, 'None identified') AS recurring_lines,
  coalesce(large.lines, 'None identified') AS large_lines,
  small_expenses AS small_expense_count
FROM keyed LEFT JOIN income {join} LEFT JOIN labels {join} LEFT JOIN repeated {join}
  LEFT JOIN large {join}"""


def _health(source: str, account: bool) -> str:
    k, join = _pre(account), _join(account)
    step = "WHEN savings_rate > 30 THEN 15 WHEN savings_rate > 20 THEN 10 WHEN savings_rate > 10 THEN 5"
    return f"""WITH profile AS ({_profile(source, account)}),
sources AS (SELECT {k} count(*) AS n FROM ({_income(source, account)}) {_group(account)}),
large AS (SELECT {k} count(*) AS n FROM ({_first_large(source, account)}) {_group(account)}),
small AS ({small_expense_count(source, account)}),
facts AS (SELECT {k} net_flow, avg_savings_rate AS savings_rate, expense_categories,
    coalesce(sources.n, 0) AS income_sources, coalesce(large.n, 0) AS large_expenses,
    small_expenses
  FROM profile LEFT JOIN sources {join} LEFT JOIN large {join} LEFT JOIN small {join})
SELECT *, CAST(greatest(0, least(100, 50
  + CASE WHEN net_flow > 0 THEN 10 ELSE 0 END
  + CASE {step} WHEN savings_rate < 0 THEN -15 ELSE 0 END
  + CASE WHEN income_sources > 2 THEN 5 ELSE 0 END
  + CASE WHEN expense_categories > 8 THEN -5 ELSE 0 END
  + CASE WHEN large_expenses > 2 THEN -5 ELSE 0 END
  + CASE WHEN small_expenses > 20 THEN -5 ELSE 0 END))
  AS INTEGER) AS health_score
FROM facts"""


def health_bands(source: str, account: bool) -> str:
    return f"""SELECT {_list(account, 'health_score')},
  CASE WHEN health_score >= 70 THEN '#28a745' WHEN health_score >= 40 THEN '#ffc107' ELSE '#dc3545' END AS health_color,
  CASE WHEN health_score >= 80 THEN 'Excellent financial health! Keep it up!'
    WHEN health_score >= 60 THEN 'Good financial standing with room for improvement.'
    WHEN health_score >= 40 THEN 'Average financial health. Consider the tips below.'
    WHEN health_score >= 20 THEN 'Financial warning signs. Action recommended.'
    ELSE 'Immediate financial attention needed.' END AS health_message FROM ({_health(source, account)})"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _narrative(refused: bool) -> Callable[[str, bool], str]:
    tips = "'first tip' || chr(10) || 'second tip'" if refused else "'only tip'"
    advice = "advice after a refusal" if refused else "advice after a failure"

    def sql(source: str, account: bool) -> str:
        return f"""SELECT {_pre(account)} {_figures(refused)} AS summary, {tips} AS tips,
  {_quoted(advice)} AS custom_advice FROM ({_profile(source, account)})"""

    return sql


def _figures(with_rate: bool) -> str:
    rate = " || ', saved ' || coalesce(format('{:.1f}', avg_savings_rate) || '%', 'n/a')" if with_rate else ""
    return f"""'in ' || {_money('total_income')} || ', out ' || {_money('total_expenses')}
  || ', left ' || {_money('net_flow')}{rate}"""


def facts_block(source: str, account: bool) -> str:
    parts = [
        "'[Score]'",
        "'points: ' || CAST(health_score AS VARCHAR)",
        "'[Money]'",
        f"'in: ' || {_money('total_income')}",
        f"'out: ' || {_money('total_expenses')}",
        f"'left: ' || {_money('net_flow')}",
        "'saved: ' || coalesce(format('{:.1f}', avg_savings_rate) || '%', 'n/a')",
        "'[Most spent on]'",
        "'category: ' || coalesce(top_expense_category, 'n/a')",
        f"'amount: ' || {_money('top_expense_amount')}",
        "'[By category]'",
        "category_lines",
        "'[From]'",
        "income_lines",
        "'[Again and again]'",
        "recurring_list",
        "'[Out of line]'",
        "large_lines",
        "'below the small bound: ' || CAST(small_expense_count AS VARCHAR)",
        "'[Days]'",
        "coalesce(date_range, 'n/a')",
    ]
    join = _join(account)
    health = f"SELECT {_list(account, 'health_score')} FROM ({_health(source, account)})"
    return f"""SELECT {_pre(account)} concat_ws(chr(10), {', '.join(parts)}) AS facts
FROM ({_profile(source, account)}) JOIN ({_pattern_lines(source, account)}) {join}
  JOIN ({health}) {join}"""


def advice_requests(source: str, account: bool) -> str:
    temperature, length = 0.7, 2000
    return f"""SELECT {_pre(account)} 'You explain account figures.' AS system_text,
  facts || chr(10) || chr(10) || 'Reply as JSON.' AS user_text,
  CAST({temperature} AS DOUBLE) AS temperature, CAST({length} AS BIGINT) AS max_tokens,
  'json_object' AS response_format FROM ({facts_block(source, account)})"""


def _explored() -> str:
    e = EXPLORE
    return f"""SELECT * FROM ({ORDERS})
WHERE CAST(date AS DATE) BETWEEN DATE '{e['start']}' AND DATE '{e['end']}'
  AND category = '{e['category']}' AND type = '{e['type']}'
  AND contains(lower(description), lower('{e['term']}'))"""


def _clean(text: str) -> str:
    steps = [(r"Page \d+ of \d+", ""), (r"\s+", " "), (r"l(\d)", r"1\1"), (r"O(\d)", r"0\1")]
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


_EXTRACTION = (
    "Give one record per booking as JSON. Columns: date timestamp_ntz; description string; "
    "amount decimal(18,2); type string; category string; labels Income/Housing/Utilities/Food/"
    "Transportation/Entertainment/Shopping/Health/Education/Personal/Travel/Insurance/Investments/"
    "Transfers/Fees/Other"
)

_PAGES = """SELECT CAST(conv_id AS VARCHAR) AS statement_id,
  string_agg(text || chr(10) || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY ALL"""

_REPLY_RECORDS = f"""SELECT *, CAST(account_id AS VARCHAR) || '-' || CAST(run AS VARCHAR)
    AS reply_id, count(*) OVER (PARTITION BY account_id, run) AS n,
  row_number() OVER (PARTITION BY account_id, run ORDER BY seq) - 1 AS position
FROM (SELECT *, CAST(floor(seq / 1000) AS BIGINT) AS run FROM ({_ORDERS_RAW}))"""


def _reply_rows(condition: str) -> str:
    return f"""SELECT reply_id AS statement_id, account_id, position AS seq,
  CAST(CAST(date AS DATE) AS TIMESTAMP) AS date, description, {_d('raw', 'amount')}, type,
  raw_category AS category, CAST(seq AS VARCHAR) AS order_number
FROM ({_REPLY_RECORDS}) WHERE {condition}"""


def _dirty_replies() -> str:
    amount = "CASE seq % 11 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 7.13 ELSE raw END"
    return f"""SELECT reply_id AS statement_id, account_id, position AS seq,
  CASE WHEN seq % 11 > 1 THEN CAST(CAST(date AS DATE) AS TIMESTAMP) END AS date, description, {_d(amount, 'amount')},
  type, raw_category AS category, CAST(seq AS VARCHAR) AS order_number,
  CASE WHEN seq % 11 = 2 THEN '300000000000000000000' END AS amount_text
FROM ({_REPLY_RECORDS})"""


def _rejected() -> str:
    """Cut replies of one record, as the text they were."""

    def field(name: str, value: str) -> str:
        return f"""coalesce(',"{name}":"' || {value} || '"', '')"""

    record = f"""'{{"Date":"' || strftime(date, '%Y-%m-%d') || '"' || {field('description', 'description')}
    || ',"Amount":' || CAST(raw AS VARCHAR) || {field('type', 'type')} || {field('category', 'raw_category')}
    || {field('order', 'CAST(seq AS VARCHAR)')} || '}}'"""
    content = f"""CASE WHEN run % 2 = 0 THEN '{{"transactions":[' || {record} || ']}}' ELSE '[' || {record} || ']' END"""
    return f"""SELECT reply_id AS statement_id, account_id, '{{"choices":[{{"message":{{"content":"'
    || replace(left(content, length(content) - 10), '"', '\\"') || '"}},"finish_reason":"length"}}]}}' AS response
FROM (SELECT *, {content} AS content FROM ({_REPLY_RECORDS}) WHERE n = 1)"""


def _insights() -> str:
    return f"""SELECT account_id,
  CASE account_id % 4 WHEN 0 THEN {_figures(True)}
    WHEN 1 THEN 'Account ' || CAST(account_id AS VARCHAR) ELSE {_figures(False)} END AS summary,
  CASE account_id % 4 WHEN 0 THEN 'first tip' || chr(10) || 'second tip'
    WHEN 1 THEN 'one' || chr(10) || 'two' ELSE 'only tip' END AS tips,
  health_score,
  CASE account_id % 4 WHEN 0 THEN 'advice after a refusal' WHEN 1 THEN ''
    ELSE 'advice after a failure' END AS custom_advice
FROM ({_profile(EVENTS, True)})
  JOIN (SELECT account_id, health_score FROM ({_health(EVENTS, True)})) USING (account_id)"""


def _report_set() -> str:
    tables = {
        "Transactions": ("amount", f"SELECT CAST(amount AS DOUBLE) AS amount FROM ({ORDERS})"),
        "Monthly Cash Flow": ("net_flow", monthly_cash_flow(ORDERS, False)),
        "Income vs Expenses": ("savings", monthly_income_vs_expenses(ORDERS, False)),
        "Category Spending": ("amount", category_spending(ORDERS, False)),
        "Summary": ("net_flow", summary(ORDERS, False)),
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS report, count(*) AS rows, "
        f"{_d(f'sum(CAST({column} AS DECIMAL(18,2)))', 'total')} FROM ({sql})"
        for name, (column, sql) in tables.items()
    )


def statements() -> dict[str, str]:
    """SQL by query name."""
    temperature, length = 0.1, 8000
    marker = (
        "'Page ' || CAST(doc_id % 9 + 1 AS VARCHAR) || ' of 9' || chr(10) || chr(9) || 'l' || "
        "CAST(doc_id % 7 AS VARCHAR) || ' O' || CAST(doc_id % 5 AS VARCHAR) || '  '"
    )
    money_out = f"* EXCLUDE (amount), {_d('amount', 'amount')}"
    cut_status = f"""SELECT reply_id AS statement_id, 'length' AS finish_reason,
  CASE WHEN n > 1 THEN 'repaired' ELSE 'rejected' END AS status,
  CASE WHEN n > 1 THEN n - 1 END AS records
FROM ({_REPLY_RECORDS}) WHERE position = 0"""
    plain = {
        "normalized_transactions": f"SELECT {money_out} FROM ({ORDERS})",
        "explore_filtered": f"SELECT {money_out} FROM ({_explored()})",
        "explore_display": f"""SELECT seq, CAST(date AS DATE) AS date, description,
  '₹' || format('{{:.2f}}', CAST(amount AS DOUBLE)) AS amount, type, category
FROM ({_explored()})""",
        "explore_summary": f"""SELECT count(*) AS records,
  {_d('coalesce(sum(amount) FILTER (amount > 0), 0)', 'total_credits')},
  {_d('abs(coalesce(sum(amount) FILTER (amount < 0), 0))', 'total_debits')},
  {_d('coalesce(sum(amount), 0)', 'net_amount')} FROM ({_explored()})""",
        "page_assembly": _PAGES,
        "clean_statement_text": f"""SELECT doc_id, {_clean(f"({marker} || coalesce(text, ''))")}
  AS text FROM documents""",
        "extraction_requests": f"""SELECT statement_id,
  {_quoted(_EXTRACTION)} AS system_text, {_clean('text')} AS user_text,
  CAST({temperature} AS DOUBLE) AS temperature, CAST({length} AS BIGINT) AS max_tokens,
  'json_object' AS response_format FROM ({_PAGES})""",
        "parse_responses": _reply_rows("TRUE"),
        "repair_truncated": _reply_rows("position < n - 1"),
        "response_status": cut_status,
        "rejected_responses": _rejected(),
        "written_responses": _reply_rows("position < n - 1"),
        "parse_dirty_responses": _dirty_replies(),
        "loaded_csv": f"SELECT {money_out} FROM ({ORDERS})",
        "loaded_parquet": f"SELECT {money_out} FROM ({ORDERS})",
        "normalized_dirty": _dirty_normalized(),
        "rejected_amounts": _rejected_amounts(),
        "explore_stored": f"SELECT {money_out} FROM ({_explored()})",
        "reports_from_responses": monthly_income_vs_expenses(ORDERS, False),
        "insight_records_by_account": _insights(),
        "csv_export": f"SELECT {money_out} FROM ({EVENTS})",
        "report_set": _report_set(),
        "facet_categories": f"""SELECT 'All' AS choice, TRUE AS is_all UNION ALL
SELECT DISTINCT category, FALSE FROM ({ORDERS})""",
        "date_bounds": f"""SELECT CAST(min(date) AS DATE) AS min_date,
  CAST(max(date) AS DATE) AS max_date FROM ({ORDERS})""",
        "balance_line": balance_line(),
    }
    assert CUT == 10  # the twins of truncated replies expect the last record to be cut
    dated = ", ".join(
        f"CASE WHEN seq % 7 <> 0 THEN {c} END AS {c}" for c in ("date", "month", "year", "year_month")
    )
    gaps = f"""SELECT * REPLACE ({dated}, CASE WHEN seq % 11 <> 0 THEN amount END AS amount,
  CASE WHEN seq % 13 <> 0 THEN description END AS description) FROM ({EVENTS})"""
    both: dict[str, tuple[str, Callable[[str, bool], str]]] = {
        "monthly_cash_flow": (ORDERS, monthly_cash_flow),
        "monthly_income_vs_expenses": (ORDERS, monthly_income_vs_expenses),
        "monthly_bars": (ORDERS, monthly_bars),
        "savings_rate_series": (ORDERS, savings_rate_series),
        "category_spending": (ORDERS, category_spending),
        "monthly_category_spending": (ORDERS, monthly_category_spending),
        "top_categories": (LINES, top_categories),
        "spending_breakdown": (LINES, spending_breakdown),
        "category_trend": (LINES, category_trend),
        "summary": (ORDERS, summary),
        "running_balance": (EVENTS, running_balance),
        "running_balance_with_opening": (EVENTS, _opened_balance),
        "required_monthly_cash_flow": (EVENTS, monthly_cash_flow),
        "amount_counts": (_DIRTY, _amount_counts),
        "balance_bounds": (EVENTS, balance_bounds),
        "running_balance_with_gaps": (gaps, running_balance),
        "monthly_cash_flow_with_gaps": (gaps, monthly_cash_flow),
        "summary_with_gaps": (gaps, summary),
        "income_by_description": (EVENTS, income_by_description),
        "top_income_sources": (EVENTS, top_income_sources),
        "expense_category_map_rows": (EVENTS, category_spending),
        "expense_frequency": (EVENTS, expense_frequency),
        "recurring_expenses": (EVENTS, recurring_expenses),
        "expense_stats": (EVENTS, expense_stats),
        "small_expense_count": (EVENTS, small_expense_count),
        "large_expenses": (EVENTS, large_expenses),
        "first_large_expenses": (EVENTS, first_large_expenses),
        "pattern_lines": (EVENTS, _pattern_lines),
        "health_score": (EVENTS, _health),
        "health_bands": (ORDERS, health_bands),
        "template_narrative": (ORDERS, _narrative(True)),
        "template_narrative_failed": (ORDERS, _narrative(False)),
        "facts_block": (EVENTS, facts_block),
        "advice_requests": (EVENTS, advice_requests),
    }
    for fmt in ("parquet", "csv"):
        plain[f"report_set_{fmt}_transactions"] = f"SELECT {money_out} FROM ({ORDERS})"
        plain[f"report_set_{fmt}_monthly_cash_flow"] = monthly_cash_flow(ORDERS, False)
        plain[f"report_set_{fmt}_income_vs_expenses"] = monthly_income_vs_expenses(ORDERS, False)
        plain[f"report_set_{fmt}_category_spending"] = category_spending(ORDERS, False)
        plain[f"report_set_{fmt}_summary"] = summary(ORDERS, False)
    for name, (source, sql) in both.items():
        plain[name] = sql(source, False)
        plain[f"{name}_by_account"] = sql(source, True)
    return plain
