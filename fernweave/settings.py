"""All settings that define results, with their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 220
    chunk_overlap: int = 40
    min_chunk_words: int = 25
    dense_top_k: int = 20
    lexical_top_k: int = 20
    final_top_k: int = 5
    rrf_k: int = 60
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    embedding_backend: str = "hash"
    embedding_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    embedding_dim: int = 512
    embed_batch_size: int = 32
    max_retries: int = 5
    retry_base_delay: float = 2.0
    request_timeout_ms: int = 60_000
    llm_backend: str = "auto"
    temperature: float = 0.0
    max_output_tokens: int = 1024
    extractive_min_similarity: float = 0.45
    max_upload_mb: int = 25

    def resolved_llm_backend(self, hosted: bool) -> str:
        """What `auto` means: the hosted engine where there is one, else extraction."""
        if self.llm_backend == "auto":
            return "hosted" if hosted else "extractive"
        if self.llm_backend not in ("hosted", "extractive"):
            raise ValueError(f"unknown answering backend: {self.llm_backend!r}")
        if self.llm_backend == "hosted" and not hosted:
            raise RuntimeError("a hosted answering model needs the engine that calls it")
        return self.llm_backend

    @classmethod
    def from_env(cls, prefix: str = "RAG_") -> Settings:
        """Defaults, overridden by environment variables such as RAG_CHUNK_SIZE."""
        given = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items()})


DEFAULT = Settings()
