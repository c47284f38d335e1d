"""The catalog for asyncio: every method runs in a thread."""

from __future__ import annotations

import asyncio
from typing import Any


class Async:
    """``await Async(collection).search(...)``; databases and collections that are returned are wrapped too."""

    def __init__(self, inner: Any):
        self.inner = inner

    def __getattr__(self, name: str) -> Any:
        from .plans.catalog import Collection, Database

        f = getattr(self.inner, name)
        if not callable(f):
            return f

        async def call(*args: Any, **kw: Any) -> Any:
            out = await asyncio.to_thread(f, *args, **kw)
            return Async(out) if isinstance(out, (Collection, Database)) else out

        return call
