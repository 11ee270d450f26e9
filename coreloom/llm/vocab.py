"""Where the public vocabulary files lie; every function that needs one takes its path."""

from __future__ import annotations


def path(name: str) -> str:
    """The file's place on this machine (the same on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)
