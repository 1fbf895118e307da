"""The words, limits and labels that results must carry exactly."""

FUNNEL_STAGES = ["view", "click", "add_to_cart", "purchase"]
FUNNEL_LABELS = {"view": "View", "click": "Click", "add_to_cart": "Add to Cart", "purchase": "Purchase"}
LOYALTY_TIERS = ["Bronze", "Silver", "Gold", "Platinum"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# RFM segments, best first, with the lowest score each one takes; below all of them is "Lost".
SEGMENT_FLOORS = {"Champions": 13, "Loyal": 10, "Potential Loyalist": 7, "At Risk": 5}
LOWEST_SEGMENT = "Lost"
SEGMENTS = [*SEGMENT_FLOORS, LOWEST_SEGMENT]
RFM_BUCKETS = 5

NO_CAMPAIGN = 0
AB_CONTROL, AB_VARIANT = "Control", "Variant_A"
SIGNIFICANCE_LEVEL = 0.05

AGE_BINS = 30
REVENUE_BINS, REVENUE_FLOOR, REVENUE_CEILING = 50, -200, 600
COHORT_LAST_MONTH = 11
DATA_SHEET_ROWS = 50_000

# Text that stands for a missing value in a CSV file.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Every character that counts as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
