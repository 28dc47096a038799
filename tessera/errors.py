"""Errors that operators raise."""


class EngineError(Exception):
    """Base of all errors of this package."""


class InvalidParameter(EngineError, ValueError):
    """A setting is outside its domain."""


class ShapeMismatch(EngineError, ValueError):
    """Columns that an operator was fitted on are missing."""


class InsufficientSamples(EngineError, ValueError):
    """There are fewer rows than the operator needs."""


class NotFinite(EngineError, ValueError):
    """A value is infinite, or missing where that isn't allowed."""
