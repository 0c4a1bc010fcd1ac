"""Errors: bad data, a bad environment, and a transport that may be tried again."""


class DataError(ValueError):
    """Input that breaks a stated rule."""


class EnvironmentFault(RuntimeError):
    """Something outside the data is missing."""


class TransportError(EnvironmentFault):
    """A provider could not be reached; the only kind that is retried."""
