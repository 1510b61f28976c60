"""What is raised on purpose: one error with a short code and free details."""

from __future__ import annotations

from typing import Any


class CounterpaneError(ValueError):
    """`code` says what was refused (`parameter` or `data`), `details` name it."""

    def __init__(self, code: str, message: str, **details: Any) -> None:
        super().__init__(message)
        self.code, self.details = code, {k: v for k, v in details.items() if v is not None}

    def __str__(self) -> str:
        named = ", ".join(f"{k}: {v}" for k, v in self.details.items())
        return f"{self.args[0]} [{named}]" if named else str(self.args[0])


def bad_parameter(message: str, **details: Any) -> CounterpaneError:
    """A parameter, or a combination of them, that cannot be used."""
    return CounterpaneError("parameter", message, **details)


def bad_data(message: str, **details: Any) -> CounterpaneError:
    """An input of the wrong type, shape or completeness."""
    return CounterpaneError("data", message, **details)
