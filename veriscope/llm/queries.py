"""One query per operator over its whole table, and SQL where SQL can express it."""

from .html_text import op5_html_extraction
from .jaccard import OP12_SQL, op12_ngram_jaccard
from .licenses import op9_license_scan
from .mixing import OP6_SQL, op6_mixing
from .neighbours import op4_cross_polytope
from .packing import op1_packing
from .perplexity import op7_quality_classifier
from .rules import op3_quality_rules
from .simhash import op2_simhash
from .substrings import OP8_SQL, op8_substring_dedup
from .suffixes import op10_suffix_dedup
from .variants import OP13_SQL, op13_spelling_variants
from .whitening import op11_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_html_extraction": op5_html_extraction,
    "op6_mixing": op6_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_ngram_jaccard": op12_ngram_jaccard,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op6_mixing": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op12_ngram_jaccard": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
