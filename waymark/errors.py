"""Errors of the library."""


class Error(Exception):
    """Any error of the library."""


class InvalidInput(Error, ValueError):
    """Input or a parameter out of range."""


class ModelError(Error, ValueError):
    """A model that is malformed, too large or of the wrong width."""


class IoError(Error, OSError):
    """A model file that can't be read or written."""
