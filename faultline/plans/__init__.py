"""Registered queries and the inputs they run on."""


def load() -> None:
    """Import the query modules, which register themselves."""
    from . import q_answers, q_context, q_io, q_lineage, q_logs, q_text  # noqa: F401
