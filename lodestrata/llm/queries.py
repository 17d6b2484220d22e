"""The registered query of each training-data operator."""

from __future__ import annotations

from .html import op3_html
from .itq import op8_near_vectors
from .knn import op2_knn
from .licenses import op6_licenses, op6_sql
from .mixing import op7_mixing, op7_sql
from .ngrams import op4_lm_score
from .packing import op1_packing
from .probminhash import op9_near_documents
from .toxicity import op5_toxicity
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_packing, op2_knn, op3_html, op4_lm_score, op5_toxicity, op6_licenses, op7_mixing, op8_near_vectors, op9_near_documents, op10_warc)}
ORACLE = {"op6_licenses": op6_sql(), "op7_mixing": op7_sql()}
