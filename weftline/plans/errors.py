"""Errors. Their messages carry no input data."""


class SchemaMismatch(ValueError):
    """All the differences between a declared schema and a frame's."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


class InvalidPlan(ValueError):
    """A plan that cannot be carried out, such as a join on keys of different types."""
