

from . import catalogue, checks, fields, numeric  # noqa: F401
