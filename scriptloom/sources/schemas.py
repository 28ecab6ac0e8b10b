"""Declared shapes of the records that files hold; nothing is inferred."""

from __future__ import annotations

PROBABILITIES = "array<struct<label:string,p:double>>"
ANSWER = f"struct<type:string,value_num:double,value_str:string,label:string,max_probability:double,reported_confidence:double,probabilities:{PROBABILITIES}>"
#: One JSON document for each script that a run asked about.
PREDICTION = f"script_id string, origin string, answers map<string,{ANSWER}>, input_tokens long, elapsed_ms double, ms_per_question double"
OUTCOME = "script string, question string, gold string, predicted string, gradable boolean, agree boolean, confidence double, confidence_band string, verifiable boolean, band_gap long"
JUDGEMENT = "origin string, purpose string, rewrite_strategy string, needs_human_review boolean, rationale string"
PICK = "id string, origin string, rubric_points long, rubric_band string, selected_because array<string>, corpus_percentile map<string,long>"
