from guidescape.sources.sampling import marker_subset, sample_cells, sample_fraction
from guidescape.sources.tables import (
    export_obs,
    read_cells,
    read_cells_with_expression,
    read_cluster_genes,
    read_expression,
    read_feature_lists,
    read_guide_genes,
    snapshot,
    write_cell_table,
    write_expression,
    write_result,
)

__all__ = [
    "export_obs",
    "marker_subset",
    "read_cells",
    "read_cells_with_expression",
    "read_cluster_genes",
    "read_expression",
    "read_feature_lists",
    "read_guide_genes",
    "sample_cells",
    "sample_fraction",
    "snapshot",
    "write_cell_table",
    "write_expression",
    "write_result",
]
