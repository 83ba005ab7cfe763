"""Column names, file schemas and vocabulary constants shared by every operator."""

# The field names and types of the input and hand-off files, and the token vocabulary.
INTERACTION_SCHEMA = (
    "rating DOUBLE, asin STRING, parent_asin STRING, user_id STRING, timestamp BIGINT, "
    "helpful_vote BIGINT, verified_purchase BOOLEAN"
)
ITEM_SCHEMA = (
    "parent_asin STRING, title STRING, description ARRAY<STRING>, categories ARRAY<STRING>, store STRING, "
    "main_category STRING, price STRING, average_rating DOUBLE, rating_number BIGINT"
)
SEQUENCE_SCHEMA = "user_id STRING, chunk BIGINT, items ARRAY<STRING>, n BIGINT, n_train BIGINT"
TOKEN_EXAMPLE_SCHEMA = "user_id STRING, t BIGINT, inp ARRAY<INT>, tgt ARRAY<INT>"
VALID_ID_SCHEMA = "parent_asin STRING, tokens ARRAY<INT>"
CODES_PER_LEVEL = 256
LEVEL_OFFSETS = (0, 256, 512, 768)
PAD, BOS, EOS = 1024, 1025, 1026
VOCAB_SIZE = 1027
HISTORY_ITEMS = 20
INPUT_LENGTH = 81

USER = "user_id"
ITEM = "parent_asin"
TS = "ts_ms"
INTERACTION_KEY = (USER, ITEM, TS)
CLEAN_COLUMNS = (
    "user_id", "parent_asin", "asin", "rating", "verified_purchase", "helpful_vote", "ts_ms", "event_ts", "category",
)
LABELLED_COLUMNS = (
    "user_id", "parent_asin", "rating", "ts_ms", "event_ts", "category", "pos", "rev_pos", "split",
)
ITEM_COLUMNS = tuple(field.split()[0] for field in ITEM_SCHEMA.split(", "))
