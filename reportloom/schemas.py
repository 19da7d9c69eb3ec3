"""Schemas of the record tables (names and types are fixed by the data model)."""

from __future__ import annotations

# Schemas are DDL strings: every reader, cast and UDF takes them, and they need no session.
PATIENTS = "patient_id string, full_name string, first_seen date, last_seen date"
REPORTS = (
    "report_id string, patient_id string, test_type string, report_date date, "
    "src_path string, pages int"
)
# obs_no (the line of the report) replaces a serial id: it is stable under re-runs.
OBSERVATIONS = (
    "report_id string, obs_no int, analyte string, value string, unit string, "
    "ref_range string, page int"
)
# Confidence is double, not single precision, so 0.93 compares equal to 0.93.
NAME_EVIDENCE = "patient_id string, source_report string, name string, confidence double"
INGESTED_FILES = (
    "sha256 string, report_id string, patient_id string, src_path string, "
    "mtime bigint, size_bytes bigint, ingested_at timestamp"
)
USERS = "id string, email string, password_hash string, created_at timestamp"
CHAT_SESSIONS = (
    "id string, user_id string, title string, created_at timestamp, updated_at timestamp"
)
CHAT_MESSAGES = (
    "id bigint, session_id string, role string, content string, created_at timestamp"
)
USAGE_LOG = (
    "timestamp timestamp, user_id string, session_id string, operation_type string, "
    "model_name string, input_tokens int, output_tokens int, total_tokens int, "
    "input_cost decimal(10,6), output_cost decimal(10,6), total_cost decimal(10,6), "
    "metadata string"
)
PARSE_LOG = (
    "report_id string, pdf_path string, status string, return_code int, start_time string, "
    "end_time string, duration_sec double, thread_name string, thread_id bigint, "
    "stderr_tail string"
)

CONTENT_ITEM_FIELDS = (
    "type string, text string, text_level int, page_idx int, img_path string, "
    "image_caption array<string>, image_footnote array<string>, table_body string, "
    "table_caption array<string>, table_footnote array<string>, latex string, "
    "text_format string, raw string"
)
CONTENT_LIST_DDL = "array<struct<" + CONTENT_ITEM_FIELDS.replace(" ", ":").replace(",:", ",") + ">>"

ENTITIES_DDL = (
    "struct<patient_name:string,patient_id:string,test_type:string,test_date:string,"
    "analytes:array<struct<name:string,value:string,unit:string,range:string,status:string>>>"
)
MODAL_DDL = (
    "struct<detailed_description:string,"
    "entity_info:struct<entity_name:string,entity_type:string,summary:string>>"
)

# Tables a store must have before records are appended to it.
REQUIRED_TABLES = {
    "patients": PATIENTS,
    "reports": REPORTS,
    "observations": OBSERVATIONS,
    "name_evidence": NAME_EVIDENCE,
    "ingested_files": INGESTED_FILES,
}
CHAT_TABLES = {"users": USERS, "chat_sessions": CHAT_SESSIONS, "chat_messages": CHAT_MESSAGES}

# States a document passes through (fixed values).
DOC_STATUSES = ("ready", "handling", "pending", "processing", "processed", "failed")
