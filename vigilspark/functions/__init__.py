from .columns import iso_text, json_list, present, short_id, words_in
from .redaction import redact, redact_json, redact_map

__all__ = ["iso_text", "json_list", "present", "redact", "redact_json", "redact_map", "short_id", "words_in"]
