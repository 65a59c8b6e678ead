"""Driver workload: stand-in inputs, registered queries and their SQL oracles."""


def load():
    """Import every query module (registration happens at import)."""
    from workload import q_stat, q_particles, q_grid, q_files, q_sqlite  # noqa: F401
    from workload.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
