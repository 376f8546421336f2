"""Canonical field names and the fixed values that results depend on.

Everything under "Fixed values" must stay exactly as written: column-name
patterns, label spellings, generator vocabularies.  They are data, stated
plainly and in their natural order.
"""

from __future__ import annotations

# Canonical logical fields, in detection order.
CANONICAL_FIELDS = ["amount", "fraud_label", "timestamp", "merchant", "location",
                    "card_type", "user_id"]
REQUIRED_FIELDS = ["amount", "fraud_label"]
CATEGORICAL_FIELDS = ["merchant", "location", "card_type"]
# Categorical fields that also get a log-frequency and a rarity flag.
RARITY_FIELDS = ["merchant", "location"]

# ---------------------------------------------------------------------------
# Fixed values (must match the reference for identical results)
# ---------------------------------------------------------------------------

# Name patterns per canonical field, in the order they are tried.
COLUMN_PATTERNS = {
    "amount": ["amount", "value", "transaction_amount", "trans_amount", "sum", "price"],
    "fraud_label": ["fraud", "is_fraud", "fraudulent", "label", "class", "target", "isfraud"],
    "timestamp": ["timestamp", "date", "time", "transaction_date", "trans_date", "created_at"],
    "merchant": ["merchant", "vendor", "shop", "store", "business", "merchant_name"],
    "location": ["location", "city", "state", "country", "region", "zip", "zipcode"],
    "card_type": ["card_type", "card", "payment_method", "type", "category"],
    "user_id": ["user_id", "customer_id", "account", "id", "userid", "customerid"],
}
EXACT_NAME_SCORE = 100.0
PARTIAL_NAME_WEIGHT = 50.0
MIN_NAME_SCORE = 30.0
USER_ID_MIN_UNIQUE_RATIO = 0.1

# Label spellings (lower-cased, stripped) and their class.
LABEL_VALUES = {
    "true": 1, "false": 0,
    "1": 1, "0": 0,
    "yes": 1, "no": 0,
    "fraud": 1, "legitimate": 0, "normal": 0,
    "fraudulent": 1, "genuine": 0,
}

# Value sets a label column must be a subset or superset of.
BINARY_LABEL_SETS = [
    ("0", "1"), ("true", "false"), ("yes", "no"),
    ("fraud", "legitimate"), ("fraud", "normal"),
]

# Columns never used as model features.
MODEL_EXCLUDED_COLUMNS = ["is_fraud", "timestamp", "merchant", "location", "card_type", "user_id"]

# Feature thresholds.
HIGH_AMOUNT_QUANTILE = 0.95
RARE_FREQUENCY_MAX = 5
NIGHT_BEFORE_HOUR = 6
NIGHT_AFTER_HOUR = 22
BUSINESS_FIRST_HOUR = 9
BUSINESS_LAST_HOUR = 17
WEEKEND_DAYS = (5, 6)  # Monday = 0

# Scoring thresholds: the API lists rows above 0.7, the UI above 0.5.
HIGH_RISK_API = 0.7
HIGH_RISK_UI = 0.5
HIGH_RISK_ROWS = 20
HEAD_ROWS = 20
TOP_CATEGORIES = 10
REPORT_TOP_MERCHANTS = 5
HISTOGRAM_BINS = 50
PSEUDO_PROBABILITY_POSITIVE = 0.8
PSEUDO_PROBABILITY_NEGATIVE = 0.2

# Text pandas reads as missing in a CSV file (besides the empty field).
CSV_MISSING_TOKENS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                      "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                      "nan", "null"]

# Synthetic generator vocabularies.
MERCHANTS_BY_TYPE = {
    "credit_card": ["Amazon", "Walmart", "Target", "Best Buy", "Home Depot", "Gas Station",
                    "Restaurant", "Hotel"],
    "mobile_money": ["MTN Mobile", "Airtel Money", "Orange Money", "M-Pesa", "Tigo Cash",
                     "Mobile Transfer", "Agent"],
    "debit_card": ["ATM Withdrawal", "POS Terminal", "Online Store", "Grocery Store", "Pharmacy",
                   "Bank Transfer"],
}
LOCATIONS = ["New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia",
             "San Antonio", "San Diego", "Dallas", "San Jose", "Austin", "Jacksonville",
             "Fort Worth", "Columbus", "Charlotte", "San Francisco", "Indianapolis", "Seattle"]
FOREIGN_LOCATIONS = ["Dubai", "London", "Tokyo", "Mumbai", "Lagos", "Moscow", "Unknown"]
CARD_TYPES = ["Visa", "Mastercard", "American Express", "Discover"]
HIGH_RISK_MERCHANTS = ["Gas Station", "ATM Withdrawal"]
ROUND_FRAUD_AMOUNTS = [100.0, 200.0, 500.0, 1000.0, 1500.0, 2000.0]
NIGHT_HOURS = [0, 1, 2, 3, 4, 5]
MERCHANT_RISK = {
    "Gas Station": 0.8, "ATM Withdrawal": 0.7, "Online Store": 0.6,
    "Restaurant": 0.3, "Grocery Store": 0.2, "Pharmacy": 0.2,
}
DEFAULT_MERCHANT_RISK = 0.4
CARD_DATASET_TYPES = ["credit_card", "debit_card"]
