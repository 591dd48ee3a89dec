"""Errors with stable codes."""

from __future__ import annotations

#: What each code means; {} takes the details.
CODES = {
    "alpha_invalid": "alpha must be a finite number above zero: {}",
    "kind_mismatch": "a model of the first kind can't be used as the second: {}",
    "format_newer": "format version {} is newer than this library reads",
    "format_invalid": "the payload isn't a model: {}",
    "mode_mismatch": "a model in token layout can't be read as a payload: {}",
    "name_invalid": "not a usable model name: {}",
    "name_required": "the model has no name",
    "model_missing": "no such model: {}",
    "untrained": "the model isn't trained",
    "training_empty": "the training set is empty",
    "category_unknown": "unknown category: {}",
    "label_unknown": "unknown label: {}",
    "label_invalid": "labels must be non-empty and differ from the background: {}",
    "background_empty": "the background category must have a name",
    "candidates_empty": "no candidates were given",
    "candidates_blank": "all candidates are blank",
    "pattern_invalid": "the pattern can't be compiled: {}",
    "tokenizer_unknown": "unknown tokenizer: {}",
    "calibration_invalid": "calibration parameters must be finite (temperature above zero): {}",
    "calibration_empty": "no usable calibration sample",
    "generation_conflict": "another writer published generation {} first",
    "text_too_long": "the text has more than {} bytes",
    "candidates_too_many": "more than {} candidates",
    "action_unknown": "unknown action: {}",
    "parameter_invalid": "invalid parameter: {}",
    "storage_mode_invalid": "the storage mode must be 'payload' or 'token': {}",
    "folder_missing": "spark.checkpoint.dir must name a folder that all executors share",
    "payload_too_large": "the model has too many cells for one document: {}",
    "kind_unknown": "no kind of model has this name: {}",
    "unscorable": "no category can score the document",
    "table_invalid": "not a usable table name: {}",
}

#: Response status for the codes that a request can cause.
STATUS = {"untrained": 503, "model_missing": 503, "text_too_long": 413, "candidates_too_many": 413}


class BayesError(ValueError):
    def __init__(self, code: str, detail: object = ""):
        super().__init__(CODES[code].format(detail))
        self.code = code

    @property
    def status(self) -> int:
        return STATUS.get(self.code, 400)
