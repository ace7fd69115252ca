"""Collects the queries of one module."""


class Registry:
    """``queries`` maps names to plans, ``oracles`` to DuckDB SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def query(self, oracle: str | None = None):
        """Register the decorated ``(spark, sf_dir) -> DataFrame`` under its own name."""

        def add(plan):
            if plan.__name__ in self.queries:
                raise ValueError(f"{plan.__name__} is registered twice")
            self.queries[plan.__name__] = plan
            if oracle:
                self.oracles[plan.__name__] = oracle
            return plan

        return add
