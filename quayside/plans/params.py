"""Parameters of the registered report queries on the test star schema.

The reference runs its report for one cutoff day and a handful of named
targets; these are the equivalents on the test tables. The SQL oracles
use the same values.
"""

# ---------------------------------------------------------------------------
# Fixed parameters.
CUTOFF_DAY = "2000-12-31"          # orders span 1995-01-01 .. 2001-08-01
POS_CHANNEL = "1-URGENT"           # the channel the weekday calendar studies
BUSINESS_STATUSES = ("F", "O")     # statuses counted as business orders
CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MIN_CATEGORIES = 23                # brand breadth for a loyal customer
TOP_CUSTOMERS = 10
FORECAST_TRAIN_END = "2000-12-01"  # last training month
FORECAST_TEST_MONTHS = 3
FORECAST_WINDOW = 3
FORECAST_PRODUCT = "red plate"     # single-name view (several part ids)
REFERENCE_PRODUCT = "red plate"    # similarity reference (first id of the name)
REFERENCE_SET = ("red plate", "blue anvil")
SIMILAR_TOP_N = 5
WORST_SUPPLIERS = 8
IQR_FACTORS = (1.5, 3.0)
EVENTS_CUTOFF_DAY = "2024-01-15"   # microsecond timestamps: the end-of-day rule on real data
# ---------------------------------------------------------------------------
