"""One error type for each stage; records are never dropped in silence."""


class StageError(Exception):
    """Base of the stages' errors."""


class IngestionError(StageError):
    pass


class ChunkError(StageError, ValueError):
    pass


class EmbeddingError(StageError):
    pass


class RetrievalError(StageError):
    pass


class ContextError(StageError):
    pass


class GenerationError(StageError):
    """Carries the provider's HTTP status and the number of attempts, where known."""

    def __init__(self, message: str, status: int | None = None, attempts: int | None = None) -> None:
        super().__init__(message)
        self.status = status
        self.attempts = attempts


class EvaluationError(StageError, ValueError):
    pass
