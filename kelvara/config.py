"""Settings of the engine. The defaults of chunking, search and memory."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Chunking:
    """Sizes in characters; out-of-range values are clamped."""

    size: int = 1200
    overlap: int = 200
    least: int = 120

    def clamped(self) -> Chunking:
        size = max(300, self.size)
        return Chunking(size, max(0, min(self.overlap, size // 2)), max(50, self.least))

    @property
    def longest(self) -> int:
        """A paragraph up to this length stays whole."""
        return int(self.clamped().size * 1.5)


@dataclass(frozen=True)
class Search:
    top_k: int = 5
    min_score: float = 0.15
    semantic_weight: float = 0.7
    lexical_weight: float = 0.3
    vocabulary: int = 50_000
    query_step: int = 20


CHUNKING, SEARCH = Chunking(), Search()
MEMORY_RECORDS = 300
EMBEDDING_BATCH = 32
EXTENSIONS = (".pdf", ".docx", ".doc", ".rtf")
