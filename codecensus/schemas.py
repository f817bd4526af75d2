"""Explicit schemas, as DDL, of every table the engine reads or keeps."""

from __future__ import annotations

FILES = (
    "repo_id string, file_ord bigint, path string, type string, sha string, "
    "size bigint, content string"
)
ARTIFACTS = (
    "repo_id string, run_id string, file_ord bigint, filename string, content string"
)
DEBUG_LOG = (
    "ts timestamp, level string, category string, message string, details string"
)
ATTEMPT_EVENTS = (
    "event_id bigint, repo_id string, ts timestamp, kind string, error_type string, "
    "error_message string, context string, decision string, patterns array<string>, "
    "package string, issue string, "
    "stack struct<backend:string,frontend:string,database:string>"
)
# field names of the stored per-repository documents are fixed values
MEMORY = (
    "repo_url string, repo_id string, created_at string, last_resurrection string, "
    "total_attempts bigint, successful_attempts bigint, failed_attempts bigint, "
    "tech_stack struct<detected_backend:string,detected_frontend:string,"
    "detected_database:string,preferred_modernization:string>, "
    "decisions array<struct<timestamp:string,decision:string,reasoning:string,outcome:string>>, "
    "failures array<struct<timestamp:string,error_type:string,error_message:string,"
    "context:string,lesson_learned:string>>, "
    "dependency_issues array<struct<package:string,issue:string,timestamp:string>>, "
    "successful_patterns array<string>, "
    "user_preferences struct<keep_original_paths:boolean,preferred_css_framework:string,"
    "preferred_frontend_framework:string,avoid_frameworks:array<string>>, "
    "resurrection_history array<struct<timestamp:string,outcome:string,decisions:array<string>>>"
)
STREAM_EVENT = (
    "type string, content string, session_id string, id string, title string, "
    "description string, files array<string>, data string"
)
CHECKPOINTS = "session_id string, checkpoint_id string, ts timestamp"
RESPONSES = (
    "session_id string, action string, feedback string, ts timestamp"
)
RECOMMENDATIONS = (
    "summary string, health_score int, "
    "project_understanding struct<purpose:string,architecture:string,data_flow:string>, "
    "drawbacks array<struct<id:string,title:string,description:string,severity:string,"
    "category:string>>, "
    "workflow_table array<struct<phase:string,task:string,description:string,duration:string,"
    "dependencies:string,status:string>>, "
    "recommendations array<struct<category:string,current:string,recommended:string,"
    "reason:string,priority:string,effort:string>>, "
    "workflow_steps array<struct<step:int,title:string,description:string,status:string>>, "
    "risks array<string>, estimated_impact string"
)


def struct(ddl: str):
    """Schema object of a DDL text; needs a running session."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
