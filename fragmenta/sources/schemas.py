"""The tables of the store, as schemas, and rows made to fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of each table. Columns that came later stand at the end.
TABLES = {
    "authorities": "id long, code string, name string, full_name string, description string",
    "regulations": "id string, authority_id long, regulation_type string, regulation_number string, title string, year int, effective_date string, status string, supersedes_id string, description string, source_url string, local_file string, document_hash string, created_at string, supersedes_kind string",
    "source_documents": "id string, regulation_id string, title string, document_type string, local_path string, file_size_bytes long, document_hash string, extracted_at string, notes string, created_at string, book_title string, book_author string, book_year string, book_publisher string, book_identity_source string",
    "source_fragments": "id string, document_id string, page_number int, section string, paragraph int, text string, text_hash string, char_count int, created_at string, extraction_method string",
    "learning_outcomes": "id string, subject string, phase string, element string, text string, source_page int, source_document string, created_at string, curriculum_version_id string, education_system string, institution_type string, education_level string, subject_id string, phase_id string, element_id string, sub_element string, program_type string, track string, source_document_id string, source_fragment_id string, source_section string, version string, status string",
    "cognitive_operators": "id long, level string, level_name string, order_number int, examples string, description string",
    "generated_modules": "generation_id string, module_json string, context_json string, created_at string, updated_at string, archived int, archived_at string",
    "generation_logs": "id long, generation_id string, stage string, attempt int, prompt_version string, prompt_hash string, model string, provider string, status string, error_category string, error string, duration_ms double, response_chars int, empty_flag int, truncated_flag int, output_tokens int, is_retry int, created_at string",
    "async_jobs": "job_id string, kind string, status string, payload_json string, result_json string, timing_json string, progress int, tahap string, created_at string, updated_at string",
    "module_versions": "generation_id string, version_no int, parent_version_no int, status string, alignment_status string, changed_sections string, warnings string, module_json string, validation_json string, created_at string",
}
STATUSES = ("draft", "active", "superseded", "revoked")


def fitted(rows: DataFrame, ddl: str) -> DataFrame:
    """rows with the columns of a schema in its order and types: missing ones are typed nulls, others go."""
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)))
