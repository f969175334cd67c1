"""The queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from cubespark.llm.decontaminate import op8_decontamination
from cubespark.llm.language import op6_language_id
from cubespark.llm.near import op7_ngram_jaccard
from cubespark.llm.packing import op4_packing
from cubespark.llm.pii import op10_personal_data
from cubespark.llm.pitman_yor import op2_pitman_yor
from cubespark.llm.quality import op3_quality_classifier
from cubespark.llm.rules import OP5_SQL, op5_quality_rules
from cubespark.llm.secrets import op1_secret_scan
from cubespark.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_personal_data": op10_personal_data,
}
SQL = {
    "op5_quality_rules": OP5_SQL,
    "op9_warc": OP9_SQL,
}
