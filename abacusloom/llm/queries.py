"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from .bpe import op9_bpe
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .fingerprints import fingerprint_classes, op1_fingerprints
from .language_id import op5_language_id
from .license_scan import op8_license_scan
from .line_dedup import op10_line_dedup
from .near_dedup import op6_near_dedup
from .packing import op4_packing
from .quality import op7_quality
from .search import OP11_SQL, op11_ranked_search
from .secrets import op13_secret_scan
from .url_filter import op2_url_filter
from .whitening import op12_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        fingerprint_classes,
        op2_url_filter,
        op3_exact_dedup,
        op4_packing,
        op5_language_id,
        op6_near_dedup,
        op7_quality,
        op8_license_scan,
        op9_bpe,
        op10_line_dedup,
        op11_ranked_search,
        op12_embedding_whitening,
        op13_secret_scan,
    )
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op11_ranked_search": OP11_SQL}
