"""Registered queries; the registry loads their modules in order, whichever is imported first."""

from . import registry  # noqa: F401
