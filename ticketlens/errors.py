"""Errors raised by the checks that stop a run."""


class DataContractError(ValueError):
    """An input table breaks its contract."""


class GroundingError(RuntimeError):
    """Machine-written output breaks the evidence rules as a whole."""
