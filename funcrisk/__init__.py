"""Function-risk analytics over fleets of compiled firmware images, as Spark jobs."""

from funcrisk.config import Config

__all__ = ["Config"]
