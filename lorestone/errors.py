"""Error classes of the single-request facade; bulk operators put the class's name in an error column."""


class StoreError(Exception):
    """Base of the store's errors."""


class InvalidInput(StoreError):
    """A request that breaks a rule on its fields."""


class HumanGated(StoreError):
    """An agent asked for what only humans may do."""


class NotFound(StoreError):
    """No current row has the id."""


class Conflict(StoreError):
    """The row's status doesn't allow the change."""
