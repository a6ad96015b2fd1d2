"""Coded errors of the view engine."""

from __future__ import annotations

CATEGORIES = {1: "unsupported query", 2: "catalog", 3: "change propagation", 4: "validation", 5: "persistence"}


class ViewError(Exception):
    """code: three digits, the first of which is the category; hint: what to do instead."""

    def __init__(self, code: int, message: str, hint: str = ""):
        self.code, self.hint = f"RV-E{code}", hint
        super().__init__(f"{self.code} ({CATEGORIES[code // 100]}): {message}" + (f" Hint: {hint}" if hint else ""))
