"""Schemas of the engine's tables, as DDL."""

URL_PARTS = "struct<href: string, scheme: string, host: string, port: int, path: string, query: string, fragment: string, origin: string>"
REQUEST = (
    "id string, url string, unique_key string, method string, payload string, headers map<string,string>, user_data string, label string, "
    "skip_navigation boolean, crawl_depth int, session_id string, max_retries int, enqueue_strategy string, state smallint, no_retry boolean, "
    "retry_count int, error_messages array<string>, loaded_url string, handled_at timestamp"
)
QUEUE = f"{REQUEST}, order_no bigint, in_progress boolean"
RESPONSE = "status int, headers array<struct<name: string, value: string>>, url string, redirects array<string>, body binary, mime string, charset string"
DATASET = "seq bigint, item string"
KEY_VALUE = "key string, value binary, content_type string, seq bigint, deleted boolean"
STORAGE = "kind string, id string, name string, created_at timestamp, modified_at timestamp, accessed_at timestamp"
ATTEMPT = (
    "request_id string, attempt int, outcome string, error_kind string, error_message string, status int, duration_ms bigint, retry_count int, "
    "session_id string, started_at timestamp"
)
SNAPSHOT = "signal string, created_at timestamp, is_overloaded boolean"
