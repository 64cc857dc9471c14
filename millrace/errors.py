"""Errors that the engine raises for statements it refuses."""


class Refused(ValueError):
    """A statement, type or option that is not supported; nothing has run."""
