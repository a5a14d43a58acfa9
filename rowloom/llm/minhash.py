"""The exact comparison under the name that it had while MinHash found the candidates; `near` holds it now."""

from rowloom.llm.near import forest

__all__ = ["forest"]
