"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

DOCUMENTS = (
    "doc_id string, source string, original_id string, status string, retries int, title string, period string, "
    "script_style string, scraped_at timestamp, error_msg string, metadata_json string"
)
IMAGES = "id int, doc_id string, file_path string, file_size int, width int, height int, created_at timestamp"
TEXTS = "id int, doc_id string, text_type string, version string, file_path string, char_count int, created_at timestamp"
TRANSCRIPTS = "doc_id string, transcript string"
VOCABULARY = "char string, frequency long"
FILTER_LOG = "filename string, status string"
TRANSLATION_PAIRS = "doc_id string, pun_transcription string, translation string"
KEY_VALUES = "doc_id string, field string, value string"
PDF_ENTRIES = "source_pdf string, entry_number string, name_kor string, name_hanja string, era string, year string, face_caption string, original_text string, image_path string"
PAGE_LINES = "pdf string, page_index int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double"
OCR_RESULT = "results array<struct<order:int,type:string,box:array<double>>>"

# Names of the image quality metrics, and the direction in which each is bad.
BAD_HIGH = ["illumination_variance", "blur_score", "smear_noise_ratio", "deterioration_mask_ratio", "bleed_through_likelihood"]
BAD_LOW = ["global_contrast", "local_contrast"]
QUALITY = "filename string, illumination_variance double, global_contrast double, local_contrast double, blur_score double, smear_noise_ratio double, deterioration_mask_ratio double, bleed_through_likelihood double"

#: Defaults of the catalogue's columns, as SQL.
DEFAULTS = {"status": "'pending'", "retries": "0", "scraped_at": "current_timestamp()", "created_at": "current_timestamp()"}
