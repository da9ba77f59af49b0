"""Limits and labels that steer the operators."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """How much context one failure may pull in."""

    max_upstream: int = 6
    max_impact: int = 5
    max_macros: int = 4
    max_definitions: int = 3
    pinned_chunks: int = 2
    top_chunks: int = 5
    chunk_chars: int = 900
    chunk_overlap: int = 120
    focus_chars: int = 1600
    section_chars: int = 700
    compiled_chars: int = 3000
    definition_chars: int = 1600
    prompt_chars: int = 24000


@dataclass(frozen=True)
class Labels:
    """Names printed into outbox rows; every deployment sets its own."""

    tool: str = "faultline"
    branch_prefix: str = "feature/faultline_patch_"
    base_branch: str = "main"
    # fixed values: wording of the two notifications
    message_with_files: str = (
        "При попытке теста обновленных моделей найдены ошибки в файлах %s"
        "\nPR/MR с предположительным решением ошибки: %s"
    )
    message_without_files: str = "Упал пайплайн при попытке сборки коммита с обновленными моделями"


LIMITS = Limits()
LABELS = Labels()
SHRINKING_PROVIDER = "ollama"  # fixed value: the one provider whose context is shortened
