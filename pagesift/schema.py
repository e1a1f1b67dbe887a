"""Shapes of the tables this package reads and writes, as DDL."""

# Landed paged documents: what a decoder found in a file, one row per document.
GRID = "struct<page_no: int, table_index: int, grid: array<array<string>>>"
DOCUMENTS = (
    "doc_id bigint, url string, meta map<string, string>, pages array<string>, "
    f"grids array<{GRID}>"
)
TEXT_PAGES = "array<struct<page_no: int, text: string>>"
DOC_TABLE = (
    "struct<page_no: int, table_index: int, caption: string, headers: array<string>, "
    "rows: array<array<string>>, row_count: int, col_count: int>"
)
JOBS = (
    "id bigint, job_id bigint, job_type string, status string, request_json string, "
    "result_json string, error_text string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
OUTPUT = "struct<type: string, file: string, source: string>"

# Operations, formats and the limits of a summary.
DOC_OPS = ("extract", "summarize", "tables", "all")
FORMATS = ("json", "csv", "txt", "md")
PROMPT_CHARS = 8000
DEFAULT_PROMPT = (
    "Summarize this document concisely. "
    "Include: main topic, key findings or arguments, and any clear action items or conclusions."
)
PROMPT_JOINT = "\n\nDocument text:\n"
NO_TEXT_NOTICE = "[No text content found to summarize.]"

# Defaults of a request.
REQUEST_DEFAULTS = {
    "scrape": {
        "mode": "all",
        "format": "json",
        "selector": "",
        "include_meta": False,
        "no_clean": False,
        "output_dir": "output",
    },
    "run": {
        "scrape_mode": "all",
        "scrape_format": "json",
        "follow_pdfs": False,
        "pdf_op": "all",
        "pdf_format": "md",
        "output_dir": "output",
        "delay": 0.0,
        "ai_prompt": None,
    },
}
REQUEST_TYPES = {
    "scrape": "url string, mode string, format string, selector string, include_meta boolean, "
    "no_clean boolean, output_dir string",
    "run": "url string, scrape_mode string, scrape_format string, follow_pdfs boolean, "
    "pdf_op string, pdf_format string, output_dir string, delay double, ai_prompt string",
}


def check_choice(kind: str, value: str, valid: tuple[str, ...]) -> None:
    """Raise ``ValueError`` before anything runs when a name is unknown."""
    if value not in valid:
        raise ValueError(f"Unknown {kind} '{value}'. Valid: {list(valid)}")
