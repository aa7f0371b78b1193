"""One-sentence answers from a language model that the caller brings."""

from __future__ import annotations

from typing import Protocol


class AnswerWriter(Protocol):
    def __call__(self, prompt: str, *, max_tokens: int, timeout: float) -> str: ...


class NoWriter(RuntimeError):
    """No answer writer is set up."""


def answer(query: str, writer: AnswerWriter | None, *, max_tokens: int = 50, timeout: float = 10.0) -> str:
    """A short answer to the query. An empty query is an error, as is a missing writer."""
    if not query.strip():
        raise ValueError("query must not be empty")
    if writer is None:
        raise NoWriter("no answer writer is configured")
    return writer(f"In a single sentence, answer this search query: {query.strip()}", max_tokens=max_tokens, timeout=timeout).strip()
