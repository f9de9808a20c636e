"""Schemas of the stages' tables."""

from __future__ import annotations

from dataclasses import dataclass

PAGES = (
    "document_id string, filename string, page_number int, text string, text_sha256 string, char_count int, word_count int, "
    "page_width double, page_height double, extraction_status string, extraction_error string"
)
WORDS = "page_id string, word_index int, x0 double, x1 double, top double, text string, upright boolean"
CELLS = "page_id string, x0 double, top double, x1 double, bottom double"
CHUNKS = "chunk_id string, document_id string, page_number int, chunk_index int, text string"
EMBEDDINGS = "chunk_id string, document_id string, page_number int, vector array<double>"
CATALOG = "document_id string, document_name string, source string, publication_date string, version string, ingestion_date string"
MANIFEST = "filename string, document_id string, expected_sha256 string, expected_pages int"
CASES = "case_id string, document_id string, query string, expected_chunk_ids array<string>, label_source string, ambiguous boolean, note string"
QUERIES = "query_id string, query string"
EVIDENCE = "struct<rank:int,chunk_id:string,document_id:string,page_number:int,score:double,text:string,document_name:string>"


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters: aimed at, never exceeded by joining, and merged below. Fixed values."""

    target_chars: int = 1200
    max_chars: int = 1800
    min_chars: int = 200
