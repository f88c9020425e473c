"""Fixed values.

Everything in this file must keep exactly these texts for results to be right: tokens already
stored in tables, tags already set in a catalog, and the default detection rules.
Regular expressions are in Python syntax; ``functions.patterns`` gives their Spark form.
"""

# Token format
TOKEN_PREFIX = "tok_"
TOKEN_SUFFIX = "_poc"
TOKEN_PATTERN = r"^tok_[A-Za-z0-9+/=]+_poc$"

# Dataset URN: platform URN, dotted name, environment
DATASET_URN_PATTERN = r"^urn:li:dataset:\((urn:li:dataPlatform:[^,]+),([^,]+),([^)]+)\)$"
PLATFORM_URN_PREFIX = "urn:li:dataPlatform:"
TAG_URN_PREFIX = "urn:li:tag:"
DEFAULT_DATABASE = "default"
THREE_PART_PLATFORM = "databricks"

# Default detection rules
NAME_PATTERNS = ("email", "e_mail", "phone", "mobile", "contact", "ssn", "aadhaar")
VALIDATORS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": r"^[+0-9()\-\s]{7,}$",
}
PII_TAG_SUFFIXES = ("pii", "pii.email", "pii.phone", "pii.contact", "sensitive")

# Tags of the run state machine
RUN_TAG = "urn:li:tag:tokenize/run"
DONE_TAG = "urn:li:tag:tokenize/done"
SUCCESS_TAG = "urn:li:tag:tokenize/status:SUCCESS"
FAILED_TAG = "urn:li:tag:tokenize/status:FAILED"
TOKENIZED_TAG = "urn:li:tag:tokenized"

# Run status
SUCCESS = "SUCCESS"
FAILED = "FAILED"
STATUS_PROPERTY = "last_tokenization_run"
NO_COLUMNS_MESSAGE = "No PII columns detected; nothing to tokenise."
SUCCESS_MESSAGE = "Tokenised columns %s; updated %d rows, skipped %d."
UNSUPPORTED_PLATFORM_MESSAGE = "Unsupported platform: %s"

# Demo rows
SEED_EMAIL = "user%d@example.com"
SEED_PHONE_PREFIX = "+1-555-"
SEED_PHONE_DIGITS = 4
