from guidescape.functions.labels import cluster_guide_key, default_control, is_wild_type, parse_guide
from guidescape.functions.tails import (
    chi2_upper,
    hypergeom_tails,
    normal_upper,
    student_two_sided,
)

__all__ = [
    "chi2_upper",
    "cluster_guide_key",
    "default_control",
    "hypergeom_tails",
    "is_wild_type",
    "normal_upper",
    "parse_guide",
    "student_two_sided",
]
