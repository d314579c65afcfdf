"""The queries of this subpackage and their SQL, for the registry at the top of the repository."""

from . import pipeline
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .language_id import op1_language_id
from .packing import op6_packing
from .piece_codec import op5_piece_codec
from .quality import OP9_SQL, op9_quality_rules
from .secret_scan import op3_secret_scan
from .simhash import op2_simhash
from .substring_dedup import op4_substring_dedup
from .token_counts import op10_token_counts
from .url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_piece_codec": op5_piece_codec,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "pipeline": pipeline.run,
}
SQL = {"op7_url_filter": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_quality_rules": OP9_SQL}
if pipeline.ORACLE_SQL:
    SQL["pipeline"] = pipeline.ORACLE_SQL
