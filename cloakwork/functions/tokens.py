"""Token codec as Column expressions, and the registry of token modes.

The built-in mode ``dummy`` is a reversible encoding for pipelines and tests. It does not protect
the values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TOKEN_PATTERN, TOKEN_PREFIX, TOKEN_SUFFIX
from .patterns import matches


def generate_token(value: Column) -> Column:
    """Deterministic token of a string; NULL gives NULL. Existing tokens are encoded again."""
    # base64() breaks lines every 76 characters, that is 57 bytes, unless a session setting says
    # otherwise. Most values are shorter and need no second pass.
    lines = F.base64(value.cast("binary"))
    body = F.when(F.octet_length(value) <= 57, lines).otherwise(
        F.replace(lines, F.lit("\r\n"), F.lit(""))
    )
    return F.concat(F.lit(TOKEN_PREFIX), body, F.lit(TOKEN_SUFFIX))


def is_token(value: Column) -> Column:
    """True for a value in token format, false for anything else and for NULL."""
    # The prefix test works on bytes and spares plaintext the regular expression.
    return F.coalesce(
        value.startswith(TOKEN_PREFIX) & matches(value, TOKEN_PATTERN), F.lit(False)
    )


@dataclass(frozen=True)
class TokenMode:
    """How one mode makes and recognizes tokens.

    ``token`` maps a string Column to its token Column; it may wrap a pandas UDF where the token
    comes from an outside library. ``is_token`` must never return NULL.
    """

    name: str
    token: Callable[[Column], Column]
    is_token: Callable[[Column], Column] = is_token


_MODES = {"dummy": TokenMode("dummy", generate_token)}


def register_mode(mode: TokenMode) -> None:
    _MODES[mode.name] = mode


def token_mode(mode: str | TokenMode = "dummy") -> TokenMode:
    if isinstance(mode, TokenMode):
        return mode
    if mode not in _MODES:
        raise NotImplementedError(f"Token mode {mode!r} is not registered")
    return _MODES[mode]


def needs_token(
    value: Column, mode: str | TokenMode = "dummy", *, skip_empty: bool = False
) -> Column:
    """Cell guard: holds plaintext. Never NULL."""
    guard = value.isNotNull() & ~token_mode(mode).is_token(value)
    return guard & (value != "") if skip_empty else guard


def any_needs_token(
    values: list[Column], mode: str | TokenMode = "dummy", *, skip_empty: bool = False
) -> Column:
    """Row guard: at least one of the cells holds plaintext."""
    guards = [needs_token(v, mode, skip_empty=skip_empty) for v in values]
    return reduce(or_, guards) if guards else F.lit(False)


def tokenize_if_needed(
    value: Column, mode: str | TokenMode = "dummy", *, skip_empty: bool = False
) -> Column:
    """The value's token; NULL and existing tokens stay as they are."""
    guard = needs_token(value, mode, skip_empty=skip_empty)
    return F.when(guard, token_mode(mode).token(value)).otherwise(value)


def tokenize_many(values: Column, mode: str | TokenMode = "dummy") -> Column:
    """Token of every element of an array, without the existing-token check."""
    return F.transform(values, token_mode(mode).token)
