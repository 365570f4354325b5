"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import quality, suffix_dedup
from .fingerprints import op2_fingerprints
from .html_text import op8_html_text
from .licenses import op1_license_scan
from .minhash import op9_minhash
from .packing import op7_best_fit_packing
from .quality import op6_quality_rules
from .rans import op10_token_files
from .sentencepiece import op4_sentencepiece
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_fingerprints, op3_toxicity, op4_sentencepiece, op5_suffix_dedup,
        op6_quality_rules, op7_best_fit_packing, op8_html_text, op9_minhash, op10_token_files,
    )
}

#: The others have no form that DuckDB evaluates on whole tables: models, tokenizers,
#: sketches and bins. Their tests hold them against brute force, the libraries, exact
#: round trips or held-out rows.
SQL: dict[str, str] = {"op5_suffix_dedup": suffix_dedup.SQL, "op6_quality_rules": quality.SQL}
