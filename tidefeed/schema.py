"""Table schemas and the fixed values of the feed model."""

from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

# ---- fixed values -----------------------------------------------------------------
PAGE_SIZE = 20                     # rows on one feed page
TTL_SECONDS = 3 * 24 * 60 * 60     # retention of the TTL dialects: 3 days
CHUNK_RETENTION_DAYS = 30          # whole day chunks older than this are dropped
SALT_BUCKETS = 6                   # salted key space
COUNTER_SLICES = 16                # slices of one trailing-count interval
MEASUREMENT = "notifications"      # measurement / metric name of the point forms
MS_PER_SECOND = 1_000
MS_PER_DAY = 86_400_000
MS_PER_HOUR = 3_600_000
# -----------------------------------------------------------------------------------

NOTIFICATIONS = StructType([
    StructField("user_id", StringType()),
    StructField("notify_id", StringType()),
    StructField("timestamp", LongType()),      # epoch milliseconds
    StructField("data", StringType()),         # a JSON object
])

# ``ingest_seq`` is unique per written row; it says which of two writes came later.
INGESTED = StructType(NOTIFICATIONS.fields + [StructField("ingest_seq", LongType())])

# A stored feed: one directory per day.
STORED = StructType(INGESTED.fields + [StructField("day", DateType())])

# A feed behind the store interface: the number of the write that a row came with.
WRITTEN = StructType(
    INGESTED.fields + [StructField("write_no", LongType()), StructField("day", DateType())]
)

MONITOR_LOG = StructType([
    StructField("requestID", StringType()),
    StructField("userID", StringType()),
    StructField("groupID", StringType()),
    StructField("step", StringType()),
    StructField("duration", LongType()),
    StructField("nodeName", StringType()),
    StructField("timestamp", LongType()),
    StructField("extension", StringType()),    # a JSON object
])
