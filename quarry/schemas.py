"""The fixed tables of a store."""

from __future__ import annotations

VERSION = 4

FILES = "path string, mtime bigint, length bigint"
DOCUMENTS = "id bigint, path string"
CHUNKS = "doc_id bigint, line_start int, line_end int, text string, doc_path string"
VECTORS = "doc_id bigint, line_start int, line_end int, doc_path string, text string, text_hash string, embedding array<float>"
POSTINGS = "trigram string, doc_id bigint, line_start int"
PENDING = "doc_id bigint, line_start int, text_hash string"
META = "key string, value string"
HITS = "line_start int, line_end int, text string, score double"
RESULTS = f"id bigint, path string, score double, chunks array<struct<{HITS}>>"
DEVICES = "id string, name string, hostname string, app_id string, app_version string, platform string, arch string, registered_at timestamp, updated_at timestamp"
CONTEXTS = "id string, name string, hostname string, app_id string, app_version string, platform string, arch string, updated_at timestamp"

TABLES = {"files": FILES, "documents": DOCUMENTS, "chunks": CHUNKS, "chunk_vectors": VECTORS, "postings": POSTINGS, "pending": PENDING, "vec_meta": META}
