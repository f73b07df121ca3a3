"""How many steps a source may take."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class BudgetFault(Exception):
    """A source took more steps than it may."""

    def __init__(self, budget: int):
        super().__init__(f"more than {budget} steps")


class _Account:
    budget: int | None = None
    spent = 0


@contextmanager
def limited(budget: int | None) -> Iterator[None]:
    """What is spent inside counts against a budget; None is no limit."""
    before = _Account.budget, _Account.spent
    _Account.budget, _Account.spent = budget, 0
    try:
        yield
    finally:
        _Account.budget, _Account.spent = before


def spend(steps: int) -> None:
    if _Account.budget is not None:
        _Account.spent += steps
        if _Account.spent > _Account.budget:
            raise BudgetFault(_Account.budget)
