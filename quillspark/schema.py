"""The explicit schemas of the data model; nothing is inferred."""

from __future__ import annotations

import re


def names(spec: str) -> list[str]:
    """The column names of a schema string."""
    flat = spec
    while "<" in flat:
        flat = re.sub(r"<[^<>]*>", "", flat)
    return [part.split()[0] for part in flat.split(",")]


PARAMETER = "struct<name: string, type: string, required: boolean, description: string>"
RELATION = "struct<kind: string, target_name: string, target_url: string, description: string>"

LIBRARIES = "id string, name string, description string, source_url string, version string, trust_score double, snippet_count int, crawled_at timestamp, created_at timestamp, updated_at timestamp"
ENTITIES = "id long, library_id string, slug string, name string, kind string, description string, source_file string, source_code string, url string, created_at timestamp, updated_at timestamp"
PROPERTIES = "id long, entity_id long, name string, type string, description string, visibility string, since string"
METHODS = f"id long, entity_id long, slug string, name string, signature string, description string, parameters array<{PARAMETER}>, return_type string, return_desc string, source_code string, wrapped_source string, wrapped_method string, url string, since string, created_at timestamp, updated_at timestamp"
RELATIONS = "id long, method_id long, kind string, target_name string, target_url string, description string"
#: One row for each indexed class or method; method_id is null for a class.
SEARCH_DOCS = "row_id long, library_id string, entity_name string, method_name string, content string, entity_id long, method_id long, snippet_type string"
SEARCH_TOKENS = "library_id string, row_id long, tokens array<array<string>>"
POSTINGS = "library_id string, row_id long, col int, pos int, term string"
DOC_LENGTHS = "library_id string, row_id long, dl long"
#: One row: the index's documents and their mean length.
SEARCH_STATS = "n_docs long, avgdl double"
SESSIONS = "id long, library_id string, status string, total_urls int, success_count int, fail_count int, skip_count int, started_at timestamp, completed_at timestamp"
PROGRESS = "id long, session_id long, url string, item_type string, status string, error_type string, error_message string, parent_entity string, processed_at timestamp"

TABLES = {"libraries": LIBRARIES, "entities": ENTITIES, "properties": PROPERTIES, "methods": METHODS, "relations": RELATIONS, "sessions": SESSIONS, "progress": PROGRESS}
#: Each table's natural key, on which upserts replace rows.
KEYS = {"libraries": ["id"], "entities": ["library_id", "slug"], "properties": ["entity_id", "name"], "methods": ["entity_id", "slug"], "relations": ["id"], "sessions": ["id"], "progress": ["session_id", "url"]}
VERSION = "2"
