"""DataFrame operators. Shared column names: ``cell_id``, ``louvain``, ``guide``, ``gene``, ``value``."""
