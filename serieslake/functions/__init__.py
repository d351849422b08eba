"""Column expressions; everything here stays inside the JVM."""

from serieslake.functions import dates, numbers, text

__all__ = ["dates", "numbers", "text"]
