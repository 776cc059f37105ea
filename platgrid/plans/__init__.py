"""Options and schemas: what a query is built from on the driver."""

from .options import ConfigError, DefaultEWError, DefaultNSError, LAYOUTS, Options  # noqa: F401
