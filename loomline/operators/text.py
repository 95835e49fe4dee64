"""Markdown text on the driver."""

from __future__ import annotations

import re


def plain(text: object) -> str:
    """Text in which Markdown's signs mean nothing, on one line."""
    return re.sub(r"([\\`*_\[\]<>#|])", r"\\\1", re.sub(r"\r\n|\r|\n", " ", str(text)))


def code(text: object) -> str:
    flat = re.sub(r"\r\n|\r|\n", " ", str(text)).replace("|", "&#124;")
    longest = max(map(len, re.findall("`+", flat)), default=0)
    fence, pad = "`" * (longest + 1), " " * bool(longest)
    return fence + pad + flat + pad + fence
