"""Errors of the engine, raised when a plan is built; errors in data are raised by Spark when it runs."""


class EngineError(Exception):
    """Root of all errors of the engine."""


class FrameError(EngineError):
    """A frame operation can't be done."""


class ColumnNotFoundError(FrameError):
    """A column that isn't in the frame."""


class SchemaError(EngineError):
    """Schemas that don't fit."""


class ComputeError(EngineError):
    """A computation with impossible parameters."""


class ShapeError(EngineError):
    """Heights or lengths that don't fit."""


class InvalidArgumentError(EngineError):
    """An argument outside what is allowed."""


class IOStreamError(EngineError):
    """Reading or writing failed."""
