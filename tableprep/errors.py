"""One exception type for every refused request (bad spec, missing column, bad file)."""


class TablePrepError(ValueError):
    """Raised when a task spec, a column reference or an input file is invalid."""
