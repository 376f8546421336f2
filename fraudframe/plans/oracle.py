"""DuckDB oracle SQL for the registered queries.

Independent restatements in plain SQL over the same FX views: window
functions, ``quantile_cont`` and ``dense_rank`` where the engine uses
order-statistics tables.  Doubles are rounded to 6 places.
"""

from __future__ import annotations

from ..sources.tables import FIXTURE_MAPPINGS, QUOTED_SQL, fixture_cte

VIEW_COLUMNS = {
    "fx1": ["transaction_id", "transaction_amount", "is_fraud", "created_at", "payment_method",
            "city", "customer_id"],
    "fx2": ["transaction_id", "price", "fraud", "transaction_date", "merchant_name", "country",
            "payment_method", "customer_id"],
    "fx3": ["amount", "label", "date", "vendor", "type"],
    "fx4": ["id", "amount", "fraud"],
    "fx6": ["transaction_id", "amount", "is_fraud", "date"],
    "fx7": ["transaction_id", "amount", "is_fraud", "predicted_fraud", "fraud_probability"],
    "fx8": ["transaction_id", "amount", "label", "date", "merchant_category"],
}

LABEL_CASE = """case lower(trim(cast({c} as varchar)))
 when 'true' then 1 when 'false' then 0 when '1' then 1 when '0' then 0
 when 'yes' then 1 when 'no' then 0 when 'fraud' then 1 when 'legitimate' then 0
 when 'normal' then 0 when 'fraudulent' then 1 when 'genuine' then 0 end"""

NUMBER_TEXT = r"""case when regexp_full_match(cast({c} as varchar), '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')
 then try_cast(trim(cast({c} as varchar)) as double) end"""

# Output columns and types of the processed views (double ones get rounded).
DOUBLE_COLS = {"amount", "amount_log", "amount_percentile", "merchant_frequency_log",
               "location_frequency_log", "transaction_amount", "price", "fraud_probability"}


def renamed_sql(fx: str) -> str:
    inv = {}
    for canon, src in FIXTURE_MAPPINGS[fx].items():
        inv[src] = canon
    cols = ", ".join(f"{c} as {inv[c]}" if c in inv else c for c in VIEW_COLUMNS[fx])
    return f"select {cols} from {fx}"


def processed_cte(fx: str, text_amount: bool = False, drop_ts: bool = False, ts_format: str | None = None) -> tuple[str, list[str]]:
    """``with`` clause ending in view ``p`` and the list of its columns."""
    mapping = FIXTURE_MAPPINGS[fx]
    canon_cols = []
    inv = {src: canon for canon, src in mapping.items()}
    for c in VIEW_COLUMNS[fx]:
        canon_cols.append(inv.get(c, c))
    amount = NUMBER_TEXT.format(c="amount") if text_amount else "cast(amount as double)"
    cats = [c for c in ["merchant", "location", "card_type"] if c in canon_cols]
    has_ts = "timestamp" in canon_cols and not drop_ts
    parts = [fixture_cte(fx).rstrip() + ","]
    parts.append(f"r as ({renamed_sql(fx)}),")
    parsed = f", strptime(timestamp, '{ts_format}') as timestamp" if ts_format else ""
    parts.append(f"a as (select * replace ({amount} as amount{parsed}) from r),")
    parts.append(f"l as (select *, {LABEL_CASE.format(c='fraud_label')} as is_fraud from a "
                 "where amount is not null and amount >= 0),")
    t_cols = ""
    if has_ts:
        t_cols = (", cast(hour(timestamp) as integer) as hour,"
                  " cast(isodow(timestamp) - 1 as integer) as day_of_week,"
                  " coalesce(isodow(timestamp) - 1 in (5, 6), false) as is_weekend")
    excl = "fraud_label" + (", timestamp" if drop_ts and "timestamp" in canon_cols else "")
    parts.append(f"t as (select * exclude ({excl}){t_cols} from l where is_fraud is not null),")
    c_cols = []
    for c in cats:
        c_cols.append(f"case when {c} is null then -1 else cast(dense_rank() over "
                      f"(partition by {c} is null order by {c}) - 1 as integer) end as {c}_encoded")
        c_cols.append(f"case when {c} is null then null else count(*) over (partition by {c}) end "
                      f"as {c}_frequency")
    c_cols += [
        "ln(1 + amount) as amount_log",
        "cast(coalesce(amount % 1 = 0, false) as integer) as amount_rounded",
        "(cast(rank() over (order by amount) as double) + (count(*) over (partition by amount) - 1)"
        " / 2.0::double) / count(*) over () as amount_percentile",
        "cast(coalesce(amount > (select quantile_cont(amount, 0.95) from t), false) as integer)"
        " as is_high_amount",
    ]
    if has_ts:
        c_cols += ["cast(coalesce(hour < 6 or hour > 22, false) as integer) as is_night",
                   "cast(coalesce(hour >= 9 and hour <= 17, false) as integer) as is_business_hours"]
    parts.append("c as (select *, " + ",\n ".join(c_cols) + " from t),")
    f_cols = []
    for c in ["merchant", "location"]:
        if c in cats:
            f_cols += [f"ln(1 + {c}_frequency) as {c}_frequency_log",
                       f"cast(coalesce({c}_frequency <= 5, false) as integer) as is_rare_{c}"]
    parts.append("p as (select *" + ("".join(", " + x for x in f_cols)) + " from c)")
    # Column list of p (order is irrelevant to the comparison).
    out = [c for c in canon_cols if c != "fraud_label" and not (drop_ts and c == "timestamp")]
    out.append("is_fraud")
    if has_ts:
        out += ["hour", "day_of_week", "is_weekend"]
    for c in cats:
        out += [f"{c}_encoded", f"{c}_frequency"]
    out += ["amount_log", "amount_rounded", "amount_percentile", "is_high_amount"]
    if has_ts:
        out += ["is_night", "is_business_hours"]
    for c in ["merchant", "location"]:
        if c in cats:
            out += [f"{c}_frequency_log", f"is_rare_{c}"]
    return "\n".join(parts) + "\n", out


TS_COLS = {"timestamp", "created_at"}


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') as {c}"


def rounded(cols: list[str], doubles: set[str] = DOUBLE_COLS) -> str:
    return ", ".join(f"round({c}, 6) as {c}" if c in doubles else ts_text(c) if c in TS_COLS else c
                     for c in cols)


def on_processed(fx: str, body: str, **kw) -> str:
    cte, _ = processed_cte(fx, **kw)
    return cte + body


def build_features_sql(fx: str, **kw) -> str:
    cte, cols = processed_cte(fx, **kw)
    return cte + f"select {rounded(cols)} from p"


def correlation_sql(fx: str, cols: list[str]) -> str:
    cte, _ = processed_cte(fx)
    aggs, sels = [], []
    for i, x in enumerate(cols):
        for j in range(i, len(cols)):
            y = cols[j]
            xd, yd = f"cast({x} as double)", f"cast({y} as double)"
            den = (f"stddev_pop(case when {y} is not null then {xd} end) * "
                   f"stddev_pop(case when {x} is not null then {yd} end)")
            aggs.append(f"covar_pop({xd}, {yd}) / nullif({den}, 0) as r{i}_{j}")
            sels.append(f"select '{x}' as x, '{y}' as y, round(r{i}_{j}, 6) as r from m")
            if i != j:
                sels.append(f"select '{y}' as x, '{x}' as y, round(r{i}_{j}, 6) as r from m")
    return (cte.rstrip() + ",\nm as (select " + ",\n ".join(aggs) + " from p)\n"
            + "\nunion all\n".join(sels))


FX1_NUMERIC = ["transaction_id", "amount", "customer_id", "is_fraud", "hour", "day_of_week",
               "location_encoded", "location_frequency", "card_type_encoded", "card_type_frequency",
               "amount_log", "amount_rounded", "amount_percentile", "is_high_amount", "is_night",
               "is_business_hours", "location_frequency_log", "is_rare_location"]


ORACLE: dict[str, str] = {}

# --- sources / mapping ---------------------------------------------------------------
ORACLE["preview"] = fixture_cte("fx1") + (
    "select transaction_id, round(transaction_amount, 6) as transaction_amount, is_fraud,"
    f" {ts_text('created_at')}, payment_method, city, customer_id from fx1 order by transaction_id limit 10")
ORACLE["dataset_shape"] = fixture_cte("fx1") + "select count(*) as n_rows, 7 as n_columns from fx1"
ORACLE["validate_source"] = fixture_cte("fx1") + (
    "select 7 as n_columns, count(*) > 0 as non_empty, count(*) > 0 as ok,"
    " case when count(*) > 0 then 'File validation successful' else 'Uploaded file is empty' end"
    " as message from (select * from fx1 limit 1)")
ORACLE["readable_sample"] = fixture_cte("fx7") + (
    "select 'table' as input, count(*) > 0 as ok, 'File validation successful' as message from fx7"
    " union all select 'one_column', false, 'File must have at least 2 columns'"
    " union all select 'empty', false, 'Uploaded file is empty'")
ORACLE["validate_mapping"] = (
    "select 'good' as mapping, true as ok, 'Mapping valid' as message"
    " union all select 'missing', false, 'Missing required mappings: fraud_label'"
    " union all select 'absent', false, 'Mapped columns not found: shop'"
    " union all select 'twice', false, 'A source column is mapped to more than one field'")
ORACLE["rename_mapped"] = fixture_cte("fx1") + (
    "select transaction_id, round(transaction_amount, 6) as amount, is_fraud as fraud_label,"
    " strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as timestamp, payment_method as card_type,"
    " city as location, customer_id from fx1")
ORACLE["validate_model_input"] = on_processed("fx1", (
    "select count(*) >= 10 and count(distinct is_fraud) >= 2 as ok,"
    " case when count(*) < 10 then 'Insufficient data. Need at least 10 rows for model training.'"
    " when count(distinct is_fraud) < 2 then 'Dataset must contain both fraud and legitimate transactions.'"
    " else 'Validation successful' end as message from p"))

# Detection: the name candidates are fixed by the column names; the SQL
# re-checks each candidate's content rule on the data.
_LABEL_SETS = [("0", "1"), ("true", "false"), ("yes", "no"), ("fraud", "legitimate"),
               ("fraud", "normal")]


def _label_ok(view: str, col: str) -> str:
    conds = []
    for s in _LABEL_SETS:
        lst = ", ".join(f"'{v}'" for v in s)
        sub = f"(select count(*) from {view} where {col} is not null and lower(cast({col} as varchar)) not in ({lst})) = 0"
        sup = " and ".join(f"(select count(*) from {view} where lower(cast({col} as varchar)) = '{v}') > 0" for v in s)
        conds.append(f"({sub} or ({sup}))")
    return " or ".join(conds)


def _detect_rows(view: str, checks: list[tuple[str, str, str]]) -> str:
    sels = [f"select '{f}' as field, '{c}' as source_column where {cond}" for f, c, cond in checks]
    return fixture_cte(view) + "\nunion all\n".join(sels)


def _amount_ok(view, col):
    return (f"(select count({col}) > 0 and count(case when {col} >= 0 then 1 end) > 0 from "
            f"(select cast({col} as double) as {col} from {view}))")


def _cat_ok(view, col):
    return f"(select count(distinct {col}) + max(case when {col} is null then 1 else 0 end) > 1 from {view})"


def _ts_text_ok(view, col):
    return (f"(select count(*) = count(try_cast({col} as timestamp)) from "
            f"(select {col} from {view} where {col} is not null))")


def _uid_ok(view, col):
    return (f"(select (count(distinct {col}) + max(case when {col} is null then 1 else 0 end))"
            f" / count(*) > 0.1 from {view})")


ORACLE["detect_columns_fx1"] = _detect_rows("fx1", [
    ("amount", "transaction_amount", _amount_ok("fx1", "transaction_amount")),
    ("fraud_label", "is_fraud", _label_ok("fx1", "is_fraud")),
    ("timestamp", "created_at", "true"),
    ("location", "city", _cat_ok("fx1", "city")),
    ("card_type", "payment_method", _cat_ok("fx1", "payment_method")),
    ("user_id", "customer_id", _uid_ok("fx1", "customer_id")),
])
ORACLE["detect_columns_fx2"] = _detect_rows("fx2", [
    ("amount", "price", _amount_ok("fx2", "price")),
    ("fraud_label", "fraud", _label_ok("fx2", "fraud")),
    ("timestamp", "transaction_date", "true"),
    ("merchant", "merchant_name", _cat_ok("fx2", "merchant_name")),
    ("location", "country", _cat_ok("fx2", "country")),
    ("card_type", "payment_method", _cat_ok("fx2", "payment_method")),
    ("user_id", "customer_id", _uid_ok("fx2", "customer_id")),
])
ORACLE["detect_columns_fx3"] = _detect_rows("fx3", [
    ("amount", "amount", _amount_ok("fx3", "amount")),
    ("fraud_label", "label", _label_ok("fx3", "label")),
    ("timestamp", "date", "true"),
    ("merchant", "vendor", _cat_ok("fx3", "vendor")),
    ("card_type", "type", _cat_ok("fx3", "type")),
])
ORACLE["detect_columns_fx4"] = _detect_rows("fx4", [
    ("amount", "amount",
     f"(select count(x) > 0 and count(case when x >= 0 then 1 end) > 0 from "
     f"(select {NUMBER_TEXT.format(c='amount')} as x from fx4))"),
    ("fraud_label", "fraud", _label_ok("fx4", "fraud")),
    ("user_id", "id", _uid_ok("fx4", "id")),
])
ORACLE["detect_columns_fx5"] = _detect_rows("fx5", [
    ("location", "location", _cat_ok("fx5", "location")),
])
ORACLE["detect_columns_fx6"] = _detect_rows("fx6", [
    ("amount", "amount", _amount_ok("fx6", "amount")),
    ("fraud_label", "is_fraud", _label_ok("fx6", "is_fraud")),
    ("timestamp", "date", _ts_text_ok("fx6", "date")),
])

ORACLE["detect_columns_fx8"] = _detect_rows("fx8", [
    ("amount", "amount", _amount_ok("fx8", "amount")),
    ("fraud_label", "label", _label_ok("fx8", "label")),
    ("timestamp", "date", "(select count(*) = count(try_strptime(date, '%m/%d/%Y %H:%M')) from fx8 where date is not null)"),
])

# --- cleaning and features ------------------------------------------------------------
_FX4_A = fixture_cte("fx4") + f"select id, round({NUMBER_TEXT.format(c='amount')}, 6) as amount from fx4"
ORACLE["coerce_amount"] = _FX4_A
ORACLE["filter_amount"] = fixture_cte("fx4") + (
    f"select id, round(x, 6) as amount from (select id, {NUMBER_TEXT.format(c='amount')} as x from fx4)"
    " where x is not null and x >= 0")
ORACLE["standardize_label"] = fixture_cte("fx4") + (
    f"select id, round(x, 6) as amount, is_fraud from (select id, {NUMBER_TEXT.format(c='amount')} as x,"
    f" {LABEL_CASE.format(c='fraud')} as is_fraud from fx4) where x is not null and x >= 0"
    " and is_fraud is not null")
ORACLE["standardize_label_numeric"] = fixture_cte("fx7") + (
    "select transaction_id, case when transaction_id % 4 = 0 then 1 else 0 end as is_fraud"
    " from fx7 where amount is not null and amount >= 0")
_TIMES = (f"select transaction_id, {ts_text('timestamp')}, hour, day_of_week, is_weekend, is_night,"
          " is_business_hours from p")
_US = "%m/%d/%Y %H:%M"
ORACLE["time_features_us"] = on_processed("fx8", _TIMES, ts_format=_US)
ORACLE["category_codes_missing"] = on_processed("fx8", (
    "select transaction_id, merchant, merchant_encoded, merchant_frequency from p"), ts_format=_US)
ORACLE["time_features"] = on_processed("fx1", (
    f"select transaction_id, {ts_text('timestamp')}, hour, day_of_week, is_weekend, is_night,"
    " is_business_hours from p"))
ORACLE["drop_bad_timestamp"] = build_features_sql("fx6", drop_ts=True)
ORACLE["category_codes"] = on_processed("fx2", (
    "select transaction_id, merchant, merchant_encoded, location_encoded, card_type_encoded from p"))
ORACLE["category_frequency"] = on_processed("fx2", (
    "select transaction_id, merchant_frequency, location_frequency, card_type_frequency from p"))
ORACLE["rarity_flags"] = on_processed("fx1", (
    "select transaction_id, location_frequency, round(location_frequency_log, 6) as location_frequency_log,"
    " is_rare_location from p"))
ORACLE["amount_features"] = on_processed("fx1", (
    "select transaction_id, round(amount, 6) as amount, round(amount_log, 6) as amount_log,"
    " amount_rounded from p"))
ORACLE["amount_percentile"] = on_processed("fx3", (
    "select round(amount, 6) as amount, round(amount_percentile, 6) as amount_percentile,"
    " 2 * rank() over (order by amount) + count(*) over (partition by amount) - 1 as amount_rank2 from p"))
ORACLE["is_high_amount"] = on_processed("fx2", (
    "select transaction_id, round(amount, 6) as amount, is_high_amount from p"))
for _key in ["category_codes", "amount_percentile", "is_high_amount"]:
    ORACLE[f"{_key}_ranged"] = ORACLE[_key]
for _fx in ["fx1", "fx2", "fx3"]:
    ORACLE[f"build_features_{_fx}"] = build_features_sql(_fx)

# --- profiling -------------------------------------------------------------------------
_HEADLINE = ("select count(*) as total_transactions, count(*) filter (where is_fraud = 1) as fraud_transactions,"
             " round_even(coalesce(count(*) filter (where is_fraud = 1) * 100.0::double / nullif(count(*), 0), 0), 2)"
             " as fraud_rate,"
             " round_even(coalesce(avg(case when is_fraud = 1 then amount end), 0), 2) as avg_fraud_amount from p")
ORACLE["headline_metrics"] = on_processed("fx1", _HEADLINE)
ORACLE["headline_metrics_fx2"] = on_processed("fx2", _HEADLINE)
ORACLE["fraud_counts"] = on_processed("fx1", (
    "select count(*) filter (where is_fraud = 1) as fraud_count,"
    " count(*) filter (where is_fraud = 0) as legitimate_count,"
    " round(coalesce(count(*) filter (where is_fraud = 1)::double / nullif(count(*), 0), 0), 6)"
    " as fraud_rate from p"))
ORACLE["amount_stats_by_class"] = on_processed("fx2", (
    "select k.is_fraud, coalesce(s.n, 0) as count, round(coalesce(s.mean, 0), 6) as mean,"
    " round(coalesce(s.median, 0), 6) as median,"
    " round(case when coalesce(s.n, 0) = 0 then 0 else s.std end, 6) as std,"
    " round(coalesce(s.total, 0), 2) as total"
    " from (select unnest([0, 1]) as is_fraud) k left join"
    " (select is_fraud, count(*) as n, avg(amount) as mean, quantile_cont(amount, 0.5) as median,"
    " stddev_samp(amount) as std, sum(amount) as total from p group by is_fraud) s"
    " on k.is_fraud = s.is_fraud"))
ORACLE["total_fraud_amount"] = on_processed("fx1", (
    "select round(coalesce(sum(case when is_fraud = 1 then amount end), 0), 6) as total_fraud_amount from p"))
ORACLE["fraud_by_hour"] = on_processed("fx1", (
    "select hour, count(*) as fraud_count from p where is_fraud = 1 and hour is not null"
    " group by hour order by hour"))


def _top(fx, col, n=10, **kw):
    return on_processed(fx, (
        f"select {col}, count(*) as fraud_count from p where is_fraud = 1 and {col} is not null"
        f" group by {col} order by fraud_count desc, {col} asc limit {n}"), **kw)


ORACLE["top_fraud_location"] = _top("fx1", "location")
ORACLE["top_fraud_card_type"] = _top("fx1", "card_type")
ORACLE["top_fraud_merchant"] = _top("fx2", "merchant")
ORACLE["fraud_distribution"] = on_processed("fx1", (
    "select k.is_fraud, case when k.is_fraud = 1 then 'Fraud' else 'Legitimate' end as label,"
    " coalesce(s.n, 0) as count from (select unnest([0, 1]) as is_fraud) k left join"
    " (select is_fraud, count(*) as n from p group by is_fraud) s on k.is_fraud = s.is_fraud"))
_DAILY_BODY = (
    "select cast(cast(timestamp as date) as varchar) as date, count(*) as total_count,"
    " count(*) filter (where is_fraud = 1) as fraud_count,"
    " round(count(*) filter (where is_fraud = 1) * 100.0::double / count(*), 6) as fraud_rate"
    " from p where timestamp is not null group by cast(timestamp as date)")
_DAILY = on_processed("fx1", _DAILY_BODY)
ORACLE["daily_timeline"] = _DAILY
ORACLE["daily_timeline_join"] = _DAILY
ORACLE["amount_histogram"] = on_processed("fx1", (
    "select is_fraud, bin, round(lo + bin * w, 6) as bin_start,"
    " round(case when hi > lo then lo + (bin + 1) * w else hi end, 6) as bin_end, count(*) as count"
    " from (select p.is_fraud, lo, hi, (hi - lo) / 50 as w,"
    " case when hi > lo then cast(least(49, floor((amount - lo) / ((hi - lo) / 50))) as integer)"
    " else 0 end as bin from p join (select is_fraud, min(amount) as lo, max(amount) as hi from p"
    " group by is_fraud) r on p.is_fraud = r.is_fraud) group by is_fraud, bin, lo, hi, w"))
ORACLE["correlation_matrix"] = correlation_sql("fx1", FX1_NUMERIC)
_, _FX1_COLS = processed_cte("fx1")
ORACLE["fraud_rows"] = on_processed("fx1", f"select {rounded(_FX1_COLS)} from p where is_fraud = 1")
ORACLE["legit_rows"] = on_processed("fx1", f"select {rounded(_FX1_COLS)} from p where is_fraud = 0")
ORACLE["fraud_head"] = on_processed("fx1", (
    f"select {rounded(_FX1_COLS)} from p where is_fraud = 1 order by transaction_id limit 20"))
_, _CLEAN_COLS = processed_cte("fx1")
_CLEAN_COLS = [c for c in _CLEAN_COLS if not c.startswith(("location_", "card_type_", "is_rare", "amount_percentile", "is_high"))]
ORACLE["fraud_by_amount"] = on_processed("fx1", (
    f"select {rounded(_CLEAN_COLS)}, row_number() over (order by amount desc, transaction_id) as place from p where is_fraud = 1"))
ORACLE["fraud_amount_range"] = on_processed("fx1", (
    f"select {rounded(_CLEAN_COLS)} from p where is_fraud = 1 and amount between 20 and 160"))
ORACLE["fraud_amount_maximum"] = on_processed("fx1", (
    "select round(coalesce(max(amount), 0), 6) as max_fraud_amount from p where is_fraud = 1"))
ORACLE["union_sources"] = fixture_cte("fx7", "fx4") + (
    "select transaction_id, round(amount, 6) as amount, is_fraud, null::varchar as note from fx7 union all"
    " select id, null, null, fraud from fx4 union all"
    " select transaction_id, round(amount, 6), is_fraud, null from fx7 where is_fraud = 1")
ORACLE["amount_stats_by_class_ranged"] = ORACLE["amount_stats_by_class"]
ORACLE["top_fraud_merchant_category"] = _top("fx8", "merchant", ts_format=_US)
ORACLE["daily_timeline_us"] = on_processed("fx8", _DAILY_BODY, ts_format=_US)
ORACLE["class_weights"] = on_processed("fx1", (
    "select is_fraud, n_rows, round(sum(n_rows) over () / (count(*) over () * n_rows), 6) as weight,"
    " round(coalesce(max(case when is_fraud = 0 then n_rows end) over ()::double"
    " / max(case when is_fraud = 1 then n_rows end) over (), 1), 6) as scale_pos_weight"
    " from (select is_fraud, count(*) as n_rows from p group by is_fraud)"))
ORACLE["summary_report"] = on_processed("fx2", (
    "select * from (values"
    " ('overview', 1, 'total_transactions', 'Total Transactions: ' || format('{:,}', (select count(*) from p))),"
    " ('overview', 2, 'columns', 'Number of Columns: 27'),"
    " ('overview', 3, 'date_range', 'Date Range: ' || (select cast(min(timestamp) as varchar) || ' to '"
    " || cast(max(timestamp) as varchar) from p)),"
    " ('fraud', 4, 'fraud_transactions', 'Fraud Transactions: ' || format('{:,}', (select count(*) from p where is_fraud = 1))),"
    " ('fraud', 5, 'legitimate_transactions', 'Legitimate Transactions: ' || format('{:,}', (select count(*) from p where is_fraud = 0))),"
    " ('fraud', 6, 'fraud_rate', 'Fraud Rate: ' || printf('%.2f%%', (select count(*) filter (where is_fraud = 1) * 100.0::double / count(*) from p))),"
    " ('amount', 7, 'average_fraud_amount', 'Average Fraud Amount: $' || printf('%.2f', (select coalesce(avg(amount), 0) from p where is_fraud = 1))),"
    " ('amount', 8, 'total_fraud_amount', 'Total Fraud Amount: $' || format('{:,.2f}', (select coalesce(sum(amount), 0) from p where is_fraud = 1))),"
    " ('amount', 9, 'median_fraud_amount', 'Median Fraud Amount: $' || printf('%.2f', (select coalesce(quantile_cont(amount, 0.5), 0) from p where is_fraud = 1)))"
    ") t(section, line, metric, value)"
    " union all select 'top_merchants', 10 + row_number() over (order by fraud_count desc, merchant),"
    " merchant, printf('- %s: %d transactions', merchant, fraud_count) from"
    " (select merchant, count(*) as fraud_count from p where is_fraud = 1 and merchant is not null"
    " group by merchant order by fraud_count desc, merchant limit 5)"))

# --- quality ---------------------------------------------------------------------------------
ORACLE["basic_stats"] = fixture_cte("fx4") + (
    "select 'amount' as column, count(x) as count, round(avg(x), 6) as mean,"
    " round(quantile_cont(x, 0.5), 6) as median, round(stddev_samp(x), 6) as std,"
    " round(min(x), 6) as min, round(max(x), 6) as max, round(quantile_cont(x, 0.25), 6) as q25,"
    f" round(quantile_cont(x, 0.75), 6) as q75 from (select {NUMBER_TEXT.format(c='amount')} as x from fx4)"
    " where x is not null having count(x) > 0")
ORACLE["missing_counts"] = fixture_cte("fx5") + (
    "select * from (select 'nation' as column, count(*) filter (where nation is null) as missing_count from fx5"
    " union all select 'segment', count(*) filter (where segment is null) from fx5"
    " union all select 'amount_bucket', count(*) filter (where amount_bucket is null) from fx5"
    " union all select 'location', count(*) filter (where location is null) from fx5)"
    " where missing_count > 0")
ORACLE["duplicate_rows"] = fixture_cte("fx5") + (
    "select coalesce(sum(n - 1), 0)::bigint as duplicate_rows from"
    " (select count(*) as n from fx5 group by nation, segment, amount_bucket, location)")
ORACLE["amount_sign_issues"] = fixture_cte("fx5") + (
    "select count(*) filter (where amount_bucket < 0) as negative_amounts,"
    " count(*) filter (where amount_bucket = 0) as zero_amounts from fx5")
ORACLE["iqr_outliers"] = fixture_cte("fx5") + (
    "select 'amount_bucket' as column, round(q1, 6) as q1, round(q3, 6) as q3,"
    " (select count(*) from fx5 where amount_bucket < q1 - 1.5 * (q3 - q1)"
    " or amount_bucket > q3 + 1.5 * (q3 - q1)) as outliers from"
    " (select quantile_cont(amount_bucket, 0.25) as q1, quantile_cont(amount_bucket, 0.75) as q3 from fx5)")

ORACLE["basic_stats_ranged"] = ORACLE["basic_stats"]
ORACLE["iqr_outliers_amount"] = fixture_cte("fx7") + (
    "select 'amount' as column, round(q1, 6) as q1, round(q3, 6) as q3,"
    " (select count(*) from fx7 where amount < q1 - 1.5 * (q3 - q1) or amount > q3 + 1.5 * (q3 - q1)) as outliers from"
    " (select quantile_cont(amount, 0.25) as q1, quantile_cont(amount, 0.75) as q3 from fx7)")

# --- scored rows -------------------------------------------------------------------------------
_FX7 = fixture_cte("fx7")
ORACLE["classification_metrics"] = _FX7 + (
    "select tp, fp, fn, tn, round(coalesce((tp + tn)::double / nullif(n, 0), 0), 6) as accuracy,"
    " round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision,"
    " round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall,"
    " round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from"
    " (select count(*) filter (where is_fraud = 1 and predicted_fraud = 1) as tp,"
    " count(*) filter (where is_fraud = 0 and predicted_fraud = 1) as fp,"
    " count(*) filter (where is_fraud = 1 and predicted_fraud = 0) as fn,"
    " count(*) filter (where is_fraud = 0 and predicted_fraud = 0) as tn, count(*) as n from fx7)")
ORACLE["roc_auc"] = _FX7 + (
    "select round(case when n1 > 0 and n0 > 0 then (r1 - n1 * (n1 + 1) / 2.0::double) / (n1 * n0)"
    " else 0.5 end, 6) as auc from (select sum(case when is_fraud = 1 then rk end) as r1,"
    " count(*) filter (where is_fraud = 1)::double as n1,"
    " count(*) filter (where is_fraud = 0)::double as n0 from"
    " (select is_fraud, rank() over (order by fraud_probability) + (count(*) over"
    " (partition by fraud_probability) - 1) / 2.0::double as rk from fx7"
    " where fraud_probability is not null and is_fraud is not null))")
ORACLE["roc_auc_ranged"] = ORACLE["roc_auc"]
ORACLE["prediction_summary"] = _FX7 + (
    "select count(*) as total_transactions, coalesce(sum(predicted_fraud), 0)::bigint as predicted_fraud,"
    " count(*) filter (where fraud_probability > 0.7) as high_risk_count,"
    " least(count(*) filter (where fraud_probability > 0.7), 20) as high_risk_shown from fx7")
_FX7_COLS = ("transaction_id, round(amount, 6) as amount, is_fraud, predicted_fraud,"
             " round(fraud_probability, 6) as fraud_probability")
ORACLE["high_risk_api"] = _FX7 + (
    f"select {_FX7_COLS} from fx7 where fraud_probability > 0.7 order by transaction_id limit 20")
ORACLE["high_risk_ui"] = _FX7 + (
    f"select {_FX7_COLS} from fx7 where fraud_probability > 0.5"
    " order by fraud_probability desc, transaction_id limit 20")
ORACLE["score_rows"] = _FX7 + (
    f"select {_FX7_COLS}, is_fraud = predicted_fraud as prediction_correct from fx7")
ORACLE["amount_vs_probability"] = _FX7 + (
    "select round(amount, 6) as amount, round(fraud_probability, 6) as probability,"
    " case when is_fraud = 1 then 'red' else 'green' end as color,"
    " printf('Amount: $%.2f<br>Fraud: %s', amount, case when is_fraud = 1 then 'Yes' else 'No' end)"
    " as hover_text from fx7")
ORACLE["pseudo_probability"] = _FX7 + (
    "select transaction_id, predicted_fraud,"
    " case when predicted_fraud = 1 then 0.8::double else 0.2::double end as fraud_probability from fx7")
ORACLE["format_currency"] = _FX7 + (
    "select transaction_id, '$' || format('{:,.2f}', amount) as amount_text from fx7")
ORACLE["format_percentage"] = _FX7 + (
    "select transaction_id, printf('%.2f%%', fraud_probability * 100) as probability_text from fx7")
ORACLE["merchant_risk"] = on_processed("fx8", (
    "select transaction_id, merchant, round(case merchant when 'Gas Station' then 0.8"
    " when 'ATM Withdrawal' then 0.7 when 'Online Store' then 0.6 when 'Restaurant' then 0.3"
    " when 'Grocery Store' then 0.2 when 'Pharmacy' then 0.2 else 0.4 end::double, 6)"
    " as merchant_risk_score from p"), ts_format=_US)

# --- model inputs ----------------------------------------------------------------------------
_FX1_FEATURES = ["amount", "customer_id", "hour", "day_of_week", "is_weekend", "location_encoded",
                 "location_frequency", "card_type_encoded", "card_type_frequency", "amount_log",
                 "amount_rounded", "amount_percentile", "is_high_amount", "is_night",
                 "is_business_hours", "location_frequency_log", "is_rare_location"]
ORACLE["assemble_features"] = on_processed("fx1", "select transaction_id, cast(is_fraud as double) as label, " + ", ".join(
    f"round(coalesce(cast({c} as double), 0), 6) as {c}" for c in _FX1_FEATURES) + " from p")
ORACLE["assemble_features_missing"] = on_processed("fx8", (
    "select transaction_id, cast(is_fraud as double) as label, cast(merchant_encoded as double) as merchant_encoded,"
    " cast(coalesce(merchant_frequency, 0) as double) as merchant_frequency,"
    " round(coalesce(merchant_frequency_log, 0), 6) as merchant_frequency_log,"
    " cast(is_rare_merchant as double) as is_rare_merchant from p"), ts_format=_US)
ORACLE["scale_features"] = on_processed("fx1", "select transaction_id, " + ", ".join(
    f"round((coalesce(cast({c} as double), 0) - avg(coalesce(cast({c} as double), 0)) over ())"
    f" / coalesce(nullif(stddev_pop(coalesce(cast({c} as double), 0)) over (), 0), 1), 5) + 0.0 as {c}" for c in _FX1_FEATURES)
    + " from p")
_SPLIT = ("select transaction_id, is_fraud, row_number() over (partition by is_fraud order by md5('{seed}:' ||"
          " cast(transaction_id as varchar))) as place, count(*) over (partition by is_fraud) as n from p")
ORACLE["stratified_split"] = on_processed("fx1", (
    "select transaction_id, is_fraud, case when place <= floor(n * 0.2::double + 0.5) then 'test' else 'train' end as split"
    f" from ({_SPLIT.format(seed=42)})"))
ORACLE["stratified_folds"] = on_processed("fx1", (
    "select transaction_id, is_fraud, cast(" + " + ".join(
        f"case when place > floor(n * {f / 5!r}::double + 0.5) then 1 else 0 end" for f in range(1, 5))
    + f" as integer) as fold from ({_SPLIT.format(seed=43)})"))
_CODED = ["place", "merchant_name", "payment_method"]
ORACLE["encode_text"] = fixture_cte("fx2") + (
    ", d as (select transaction_id, country || '-' || cast(customer_id as varchar) as place, merchant_name, payment_method from fx2)"
    + "".join(f", k{i} as (select {c}, row_number() over (order by {c}) - 1 as code from"
              f" (select distinct coalesce({c}, 'nan') as {c} from d where transaction_id % 4 <> 0))" for i, c in enumerate(_CODED))
    + " select transaction_id, " + ", ".join(
        f"cast(coalesce(k{i}.code, (select count(*) from k{i})) as integer) as {c}_code" for i, c in enumerate(_CODED))
    + " from d " + " ".join(f"left join k{i} on coalesce(d.{c}, 'nan') = k{i}.{c}" for i, c in enumerate(_CODED))
).replace("\n, d as", ", d as")
ORACLE["score_model"] = on_processed("fx1", (
    "select transaction_id, is_fraud, true as in_range, true as consistent, true as flag_right from p"))
_, _FX6_COLS = processed_cte("fx6", drop_ts=True)
ORACLE["align_features"] = on_processed("fx6", "select transaction_id, " + ", ".join(
    (f"round({c}, 6) as {c}" if c in DOUBLE_COLS else c) if c in _FX6_COLS
    else f"0.0::double as {c}" for c in _FX1_FEATURES) + " from p", drop_ts=True)

# --- sources and sinks --------------------------------------------------------------------------
ORACLE["scan_csv"] = fixture_cte("fx4") + "select * from fx4"
ORACLE["scan_csv_inferred"] = _FX7 + (
    "select transaction_id, round(round(amount, 2), 6) as amount, case when transaction_id % 3 = 0 then null else 'a' end as note,"
    " case when transaction_id % 5 = 1 then 1 else 0 end as is_fraud,"
    " 'amount:double,fraud_label:bigint,note:string,transaction_id:bigint' as types"
    " from fx7 where transaction_id % 10 not in (3, 4) and amount >= 0")
ORACLE["export_json"] = _FX7 + f"select {_FX7_COLS} from fx7"
ORACLE["export_csv"] = on_processed("fx1", (
    "select transaction_id, round(amount, 6) as amount, location, card_type, is_fraud,"
    " round(amount_percentile, 6) as amount_percentile from p where is_fraud = 1"))

# --- column types (DuckDB type names mapped to Spark's) -----------------------------------------
ORACLE["column_types"] = fixture_cte("fx5") + (
    "select column_name as column, case column_type when 'BIGINT' then 'bigint'"
    " when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string'"
    " when 'BOOLEAN' then 'boolean' when 'TIMESTAMP' then 'timestamp_ntz' when 'DATE' then 'date'"
    " else lower(column_type) end as data_type, present from (describe (select * from fx5)) join ("
    + " union all ".join(f"select '{c}' as name, count({c}) as present from fx5" for c in ("nation", "segment", "amount_bucket", "location"))
    + ") on name = column_name")

# --- CSV as it comes, types over sources, file order ------------------------------------------------
ORACLE["scan_csv_quoted"] = fixture_cte("fx7") + (
    "select transaction_id, account, merchant, reference, round(amount, 6) as amount,"
    " 'account:bigint,amount:double,merchant:string,reference:decimal(38,0),transaction_id:bigint' as types"
    f" from ({QUOTED_SQL.strip()})")
ORACLE["scan_csv_rejects"] = fixture_cte("fx7") + (
    "select transaction_id, case when transaction_id % 13 = 0 or transaction_id % 7 = 0 or transaction_id % 11 = 0 then null"
    " else transaction_id::double end as amount, case when transaction_id % 13 = 0 then 'wrong number of fields'"
    " when transaction_id % 7 = 0 then 'amount: not a double' else 'good' end as cause from fx7")
ORACLE["union_sources_types"] = fixture_cte("fx7") + (
    "select transaction_id, (transaction_id % 7)::varchar as code, case when is_fraud = 1 then 'True' else 'False' end as flag,"
    " (transaction_id % 100)::double as amount from fx7 union all"
    " select transaction_id, 'x' || (transaction_id % 5), is_fraud::varchar, round(amount, 6) from fx7 union all"
    " select transaction_id, (transaction_id * 3)::varchar, null, null from fx7")
_LINES = fixture_cte("fx3").rstrip() + ", o as (select *, row_number() over () - 1 as row_number from fx3) "
ORACLE["preview_file_order"] = "select * replace (%s) from lineitem limit 10" % ", ".join(
    ["strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') as l_shipdate"] + [
        f"round({c}, 6) as {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
ORACLE["row_numbers"] = _LINES + "select row_number, round(amount, 6) as amount, label, vendor from o"
ORACLE["fraud_head_file_order"] = _LINES + (
    "select round(amount, 6) as amount, vendor as merchant, type as card_type, 1 as is_fraud from o where label = 1 and amount >= 0"
    " order by row_number limit 20")
ORACLE["high_risk_file_order"] = _FX7 + (
    f"select {_FX7_COLS} from (select *, row_number() over () as rn from fx7) where fraud_probability > 0.7 order by rn limit 20")
ORACLE["top_fraud_location_first_seen"] = fixture_cte("fx1").rstrip() + (
    ", o as (select *, row_number() over () as rn from fx1) select city as location, count(*) as fraud_count from o"
    " where is_fraud = 'Fraud' and transaction_amount >= 0 and city is not null group by city order by fraud_count desc, min(rn) limit 10")
ORACLE["top_fraud_merchant_first_seen"] = fixture_cte("fx8").rstrip() + (
    ", o as (select *, row_number() over () as rn from fx8) select merchant_category as merchant, count(*) as fraud_count from o"
    " where label = 'Fraud' and amount >= 0 and merchant_category is not null"
    " group by merchant_category order by fraud_count desc, min(rn) limit 10")
ORACLE["detect_columns_by_file"] = ORACLE["detect_columns_fx1"]
