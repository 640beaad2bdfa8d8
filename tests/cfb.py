"""Sheets for tests come from the library's writer."""

from copperline.sources.writer import container, sheet, stream

__all__ = ["container", "sheet", "stream"]
