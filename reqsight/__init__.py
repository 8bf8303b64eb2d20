"""reqsight: HTTP-request threat analytics on Spark.

The common entry points, re-exported; see the sub-packages for everything else.
"""

from reqsight.fixed import CLASSES
from reqsight.functions.decide import api_record, argmax, decide, outcome, softmax, verdict
from reqsight.functions.encode import encode_chars, encode_cls_chars
from reqsight.functions.payload import (assemble_payload, body_args, decoded_views, first_form_values,
                                        normalise_payload, split_url)
from reqsight.functions.rules import categorize, class_from_payload, class_from_title, clean_label
from reqsight.operators.evaluate import (class_distribution, classification_report, confusion_matrix,
                                         roc_auc, weighted_prf)
from reqsight.operators.labelling import augment_dataset, hybrid_dataset, label_lines, split_empty_payloads
from reqsight.operators.sampling import cap_per_class, random_split, stratified_split
from reqsight.session import build_session
from reqsight.sources.readers import read_labelled_lines, read_request_log, read_samples, write_samples

__all__ = [
    "CLASSES", "build_session",
    "read_labelled_lines", "read_request_log", "read_samples", "write_samples",
    "label_lines", "hybrid_dataset", "augment_dataset", "split_empty_payloads",
    "categorize", "class_from_title", "class_from_payload", "clean_label",
    "assemble_payload", "body_args", "first_form_values", "split_url", "normalise_payload", "decoded_views",
    "encode_chars", "encode_cls_chars",
    "cap_per_class", "random_split", "stratified_split",
    "softmax", "argmax", "decide", "verdict", "api_record", "outcome",
    "class_distribution", "confusion_matrix", "weighted_prf", "classification_report", "roc_auc",
]
