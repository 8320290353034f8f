"""Schemas of the tables this library reads and writes. They are given to readers; nothing is inferred."""

REQUESTS = (
    "id long, url string, method string, headers map<string,string>, body string, user_data string, label string, unique_key string, priority double, seq long, depth int, "
    "parent_id long, retry_count int, max_retries int, no_retry boolean, state string, error_messages array<string>, created_at timestamp, processed_at timestamp"
)
RESPONSES = "request_id long, url string, status int, headers map<string,array<string>>, content_type string, body string, redirect_chain array<string>, started_at timestamp, duration_ms long"
PAGES = "page_id long, url string, html string"
LINKS = "page_id long, page_url string, url string, source string, text string, rank int, pos int"
ROBOTS_FILES = "host string, body string, fetch_ok boolean"
COOKIE = "struct<name:string,value:string,domain:string,path:string,expires:timestamp,http_only:boolean,secure:boolean,same_site:string>"
SESSIONS = f"id string, created_at timestamp, last_used_at timestamp, usage_count int, max_usage_count int, is_blocked boolean, error_score double, headers map<string,string>, user_data string, cookies array<{COOKIE}>"
JOBS = "id string, target_url string, host string, status string, depth int, discovered long, crawled long, started_at timestamp, completed_at timestamp, agent_count int, title string"
JOB_LOGS = "job_id string, seq long, ts timestamp, agent_id int, line string, level string"
EVENTS = "type string, ts timestamp, payload string"
HISTORY = "host string, method string, url string, created_at timestamp"
INTERCEPTED = "ts timestamp, host string, port int, tls boolean, path string, in_scope boolean"
SITEMAP = "url string, job_id string"
