"""Names, limits and texts that results must carry exactly."""

# --- status vocabularies -------------------------------------------------
ENTRY_STATUSES = ("PENDING", "SENDING", "SENT", "FAILED", "INVALID")

# --- queues ---------------------------------------------------------------
QUEUE_MAIN = "mailing.jobs.process"
QUEUE_RETRY_1 = "mailing.jobs.retry.1"
QUEUE_RETRY_2 = "mailing.jobs.retry.2"
QUEUE_DEAD = "mailing.jobs.dlq"
RETRY_1_SECONDS = 60
RETRY_2_SECONDS = 300

# --- limits ---------------------------------------------------------------
JOB_MAX_ATTEMPTS = 3
ENTRY_MAX_ATTEMPTS = 3
OUTBOX_MAX_ATTEMPTS = 5
OUTBOX_BATCH = 10
FAILURE_THRESHOLD = 0.2
CHECKPOINT_LINES = 100
CLAIM_STALE_SECONDS = 30
RECOVERY_STALE_SECONDS = 300
BACKOFF_BASE_MS = 1000
BACKOFF_CAP_MS = 300000
BACKOFF_JITTER_PERCENT = 20
PACE_MARGIN_MS = 1000
RATE_PER_MINUTE = 6
REASON_CHARS = 50
PAGE_LIMIT_DEFAULT = 100
PAGE_LIMIT_MAX = 1000
ENCODING_HEAD_BYTES = 4096
BUCKETS = 256
FENCE_ROWS = 10_000
LOCAL_PART_MAX = 64
DOMAIN_MAX = 255

# --- address verdicts -------------------------------------------------------
REASON_SYNTAX = "syntax"
REASON_DISPOSABLE = "disposable"
REASON_MX = "mx-fail"
DETAIL_MISSING = "Email is empty or not a string"
DETAIL_EMPTY = "Email is empty"
DETAIL_SYNTAX = "Invalid email syntax"
DETAIL_FORMAT = "Invalid email format"
DETAIL_LOCAL = "Local part exceeds 64 characters"
DETAIL_DOMAIN = "Domain exceeds 255 characters"
DETAIL_DOT = "Domain must have at least one dot"

# --- send-error classification ----------------------------------------------
NETWORK_WORDS = ("ECONNREFUSED", "ENOTFOUND", "ETIMEDOUT", "network")
TIMEOUT_WORD = "timeout"
TEXT_NETWORK = "Network error - connection failed"
TEXT_TIMEOUT = "Request timeout"
TEXT_UNKNOWN = "Unknown error - will retry"
CLIENT_ERROR_TEXT = {
    400: "400 Bad Request - invalid request format",
    401: "401 Unauthorized - invalid credentials",
    403: "403 Forbidden - access denied",
    404: "404 Not Found - resource does not exist",
    408: "408 Request Timeout",
    422: "422 Unprocessable Entity - validation failed",
    429: "429 Too Many Requests - rate limit exceeded",
}
SERVER_ERROR_TEXT = {
    500: "500 Internal Server Error",
    502: "502 Bad Gateway",
    503: "503 Service Unavailable",
    504: "504 Gateway Timeout",
}

# --- message texts -----------------------------------------------------------
SUBJECT = "Complete your registration"
BODY = "Thank you for signing up. Please verify your token %s to continue."
POOL_BODY = "Your token: %s"
TOKEN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
JOB_RETRY_TEXT = "Processing failed, will retry"
JOB_DEAD_TEXT = "Max retry attempts exceeded"
OUTBOX_DEAD_TEXT = "Max attempts exceeded"
NO_ANSWER_TEXT = "No answer from the broker in time"

# --- metric series -----------------------------------------------------------
SEND_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
API_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0)
CSV_BOUNDS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
METRIC_EMAILS = "mailing_emails_total"
METRIC_API = "mailing_api_requests_total"
METRIC_RETRIES = "mailing_retries_total"
METRIC_RENEWALS = "token_renewals_total"
METRIC_RECOVERIES = "mailing_crash_recoveries_total"
METRIC_SEND_SECONDS = "mailing_duration_seconds"
METRIC_API_SECONDS = "mailing_api_duration_seconds"
METRIC_CSV_SECONDS = "mailing_csv_processing_duration_seconds"
METRIC_QUEUE = "mailing_queue_size"
METRIC_WORKERS = "mailing_active_workers"
METRIC_PROGRESS = "mailing_progress_percentage"

# --- event log ---------------------------------------------------------------
LOG_EVENTS = (
    "mailing.uploaded", "csv.progress", "checkpoint.saved", "email.validated", "email.sending", "email.sent",
    "email.failed", "email.dead_letter", "token.renewed", "token.renewal_failed", "crash.recovery",
    "shutdown.started", "shutdown.completed",
)
