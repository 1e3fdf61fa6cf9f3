"""Instructions for language models, one text file each. They are fixed texts of the package; values in braces are filled in by name."""

from __future__ import annotations

from functools import lru_cache
from importlib.resources import files

#: Instructions by the kind of block that they are for, and by the format of a dialogue.
BLOCKS = {"table": "table", "code": "code", "list": "list", "metadata": "metadata", "translate": "translate"}
DIALOGUES = {"two_hosts": "two_hosts", "host_guest": "host_guest"}


@lru_cache
def prompt(name: str) -> str:
    """The text of an instruction, without space around it."""
    return files(__package__).joinpath(f"{name}.txt").read_text("utf-8").strip()
