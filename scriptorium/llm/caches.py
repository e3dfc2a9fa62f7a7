"""Bounded caches of what workers have computed."""

from __future__ import annotations

from itertools import islice


def forget_newest(cache: dict, limit: int) -> None:
    """Beyond limit entries, keep the older half: frequent keys come early, rare ones hardly come again."""
    if len(cache) > limit:
        kept = dict(islice(cache.items(), limit // 2))
        cache.clear()
        cache.update(kept)
