"""Table schemas shared by sources, operators and streams."""

FILES = "repository_id string, commit string, path string, length long, content binary"

INDEXED_FILES = (
    "file_id string, repository_id string, path string, language string, content_hash string"
)

SPAN = "struct<symbol:string,kind:string,start_line:int,end_line:int,content:string>"
SPANS = f"array<{SPAN}>"

CHUNKS = (
    "chunk_id string, repository_id string, file_id string, file_path string, language string, "
    "symbol string, kind string, start_line int, end_line int, content string, "
    "content_hash string, occurrence_no int"
)

VECTORS = "chunk_id string, repository_id string, content_hash string, embedding array<float>"

EDGES = "repository_id string, from_chunk_id string, to_chunk_id string, edge_type string"

ISSUES = (
    "repository_id string, github_issue_id long, number int, title string, body string, author string, "
    "labels array<string>, state string, html_url string, github_created_at timestamp, "
    "github_updated_at timestamp, github_closed_at timestamp"
)

# Shape of one row of an issue feed. `pull_request` is read as text: only its presence matters.
ISSUE_FEED = (
    "id long, number int, title string, body string, user struct<login:string>, "
    "labels array<string>, state string, html_url string, created_at string, updated_at string, "
    "closed_at string, pull_request string"
)

DELIVERIES = (
    "delivery_id string, event_type string, signature string, received_at timestamp, body binary"
)

PUSH = (
    "struct<ref:string,before:string,after:string,deleted:boolean,"
    "repository:struct<id:bigint,full_name:string,default_branch:string>,"
    "sender:struct<login:string>>"
)

PLAN = (
    "struct<citations:array<struct<file_path:string,start_line:int,end_line:int,claim:string>>,"
    "affected_files:array<string>,"
    "implementation_steps:array<struct<step_number:int,depends_on_steps:array<int>>>,"
    "confidence:double>"
)

PROGRESS = (
    "repository_id string, ts timestamp, event string, "
    "data struct<count:long,path:string,status:string,error:string,no_op:boolean,"
    "fell_back_to_full_index:boolean,files_discovered:long,files_added:long,files_modified:long,"
    "files_deleted:long,files_renamed:long,chunks_created:long,chunks_deleted:long,errors:long,"
    "duration_seconds:double>"
)

RUN_EVENTS = "run_id string, ts timestamp, seq long, event string"

# Limits of the search, planning and graph features.
DENSE_CANDIDATES = 20
BM25_CANDIDATES = 20
RRF_K = 60
DEFAULT_TOP_K = 10
MAX_TOP_K = 50
CHAT_TOP_K = 8
PLANNING_TOP_K = 8
PLANNING_CHUNKS = 15
PLANNING_ISSUES = 5
PLANNING_COMMITS = 8
COMMITS_PER_TERM = 3
HISTORY_QUERIES = 5
MIN_TERM_LENGTH = 3
EDGE_CAP = 25
MIN_SYMBOL_LENGTH = 3
NEIGHBOUR_CAP = 20
LINES_PER_WINDOW = 60
MAX_FILE_BYTES = 1_000_000
BINARY_WINDOW = 8192
RECENT_FILES = 8
INVALID_PLAN_CONFIDENCE = 0.4
EMBEDDING_DIMS = 768
